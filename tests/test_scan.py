"""The search without an index: the same scores, from one pass over the texts."""

from __future__ import annotations

import collections
import random

import pytest
from tests.test_search_index import FIELDS, MATCHES, WORDS, asked, close, frame, made, scores

from recollect.functions.analysis import plain_tokens, stemmed_tokens
from recollect.operators import lexical as L
from recollect.operators import scan as X
from recollect.plans import registry

ODD = {1000: (None, None), 1001: ("", ""), 1002: ("x" * 500, "ünïcode　漢字\x1c " * 50), 1003: ("the", "table"), 1004: ("the the the the", "ÉtA ΟΔΟΣ the\x85table"), 1005: ("a-b_c", "running,the ́ b")}


@pytest.mark.parametrize("analyser", ["plain", "stemmed"])
@pytest.mark.parametrize("small", [False, True])
def test_a_scan_is_the_formula(spark, analyser, small, monkeypatch):
    if small:  # parts, blocks and what is remembered end within the texts
        for name, value in {"ROWS": 7, "CHARS": 300, "QUERY_BLOCK": 2, "PIECES": 20}.items():
            monkeypatch.setattr(X, name, value)
    docs = made(random.Random(4), 300, WORDS) | ODD
    matches = MATCHES | {7: ["ünïcode 漢字", "été", "οδος"], 8: ["a b c", "ünïcode"]}
    analyse = plain_tokens if analyser == "plain" else stemmed_tokens
    for weights in ((1.0, 1.0), (3.0, 0.5)):
        got = X.search_texts(frame(spark, docs), FIELDS, asked(spark, matches), analyser=analyser, weights=[*weights]).collect()
        close(got, scores(docs, matches, analyse, weights))
    assert X.search_texts(frame(spark, docs), FIELDS, asked(spark, matches).limit(0)).count() == 0
    assert X.search_texts(frame(spark, docs).limit(0), FIELDS, asked(spark, matches)).count() == 0


def test_a_scan_gives_the_best_and_keeps_to_what_is_given(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 50)
    rng = random.Random(5)
    docs = made(rng, 900, WORDS)
    whole = scores(docs, MATCHES)
    want = collections.defaultdict(list)
    for (q, i), x in whole.items():
        want[q].append((-round(x, 9), i))
    got = collections.defaultdict(list)
    for r in X.search_texts(frame(spark, docs), FIELDS, asked(spark, MATCHES), 5).collect():
        got[r.query_id].append((-round(r.bm25, 9), r.id))
    assert want.keys() == got.keys()
    for q, rows in want.items():
        assert sorted(got[q])[:5] == sorted(rows)[:5]
    some = spark.createDataFrame([(i, -i) for i in [*range(0, 900, 5), 0, 5, 5000]], "id long, value long")
    close(X.search_texts(frame(spark, docs), FIELDS, asked(spark, MATCHES), among=some.select("id")).collect(), {k: x for k, x in whole.items() if k[1] % 5 == 0})
    first = collections.defaultdict(set)
    for r in X.search_texts(frame(spark, docs), FIELDS, asked(spark, MATCHES), 3, among=some).collect():
        first[r.query_id].add(r.id)
    for q in want:
        assert first[q] >= {*sorted(i for p, i in whole if p == q and i % 5 == 0)[:3]}


@pytest.mark.parametrize("name", ["i2_bm25", "i5_lexical_mode", "i7_hybrid_rrf", "i9_mmr", "i15_agent_decisions", "i18_ask"])
def test_a_batch_of_questions_writes_no_postings(spark, sf, name, monkeypatch):
    def none(*_, **__):
        raise AssertionError("an index is built")

    monkeypatch.setattr(L.TextIndex, "create", none)
    monkeypatch.setattr(L.TextIndex, "search", none)
    assert registry.queries()[name](spark, sf).count() > 0


def test_more_questions_than_a_scan_takes_go_to_the_index(spark, sf, monkeypatch):
    scanned = {(r.query_id, r.id, r.bm25) for r in registry.queries()["i2_bm25"](spark, sf).collect()}
    monkeypatch.setattr(X, "MOST_QUERIES", 3)
    assert scanned == {(r.query_id, r.id, r.bm25) for r in registry.queries()["i2_bm25"](spark, sf).collect()}
    with pytest.raises(ValueError):
        X.search_texts(frame(spark, {1: ("a", "b")}), FIELDS, asked(spark, {q: ["a"] for q in range(4)}))
