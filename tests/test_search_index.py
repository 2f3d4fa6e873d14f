"""The text index against a plain form of the same scores: phrases, fields, stems, changes, merges and what a search reads."""

from __future__ import annotations

import collections
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from recollect.functions.analysis import fold, plain_tokens, stem, stemmed_tokens
from recollect.operators import lexical as L

FIELDS = ["title", "body"]
# Published pairs of the stemmer.
STEMS = """caresses caress ponies poni ties ti cats cat agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop
falling fall hissing hiss filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit radicalli radic vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensibiliti sensibl triplicate triplic formative form electrical electr
goodness good revival reviv allowance allow adjustable adjust replacement replac adoption adopt communism commun homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil yes ye by by""".split()


def test_published_stems():
    for word, want in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert stem(word) == want
    assert fold("Éß Ñandú") == "eß nandu" and stemmed_tokens("Running, naïve_runs!") == ["run", "naiv", "run"] and plain_tokens("Été_2") == ["été", "2"]


def scores(docs, matches, analyse=stemmed_tokens, weights=(1.0, 1.0)):
    """Each query's score of each document, straight from the formula."""
    held = {i: [analyse(t or "") for t in texts] for i, texts in docs.items()}
    size = {i: sum(map(len, fields)) for i, fields in held.items()}
    average = sum(size.values()) / max(len(size), 1) or 1.0
    out = {}
    for q, phrases in matches.items():
        for p in phrases:
            terms = analyse(p)
            if not terms:
                continue
            tf = {i: sum(w * sum(f[k : k + len(terms)] == terms for k in range(len(f))) for w, f in zip(weights, fields, strict=True)) for i, fields in held.items()}
            tf = {i: n for i, n in tf.items() if n}
            idf = max(math.log((len(held) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6) if tf else 0
            for i, n in tf.items():
                out[q, i] = out.get((q, i), 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * size[i] / average))
    return out


def made(rng, n, words):
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    return {i: (line(rng.randrange(5)) if rng.random() < 0.9 else None, line(rng.randrange(40))) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, b) for i, (t, b) in docs.items()], "id long, title string, body string")


def asked(spark, matches):
    quoted = lambda p: '"' + p.replace('"', '""') + '"'
    return spark.createDataFrame([(q, " OR ".join(map(quoted, ps))) for q, ps in matches.items()], "query_id int, match string")


def close(rows, want):
    got = {(r.query_id, r.id): r.bm25 for r in rows}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


WORDS = "run running runner the the the the naïve naive café table tables relational a b c d".split()
MATCHES = {0: ["the table", "table"], 1: ["running the"], 2: ['say "nothing"', "!!"], 3: ["the the the", "the"], 4: ["cafe tables run", "naive"], 5: ["b", "b"], 6: []}


@pytest.mark.parametrize("analyser", ["plain", "stemmed"])
def test_search_is_the_formula(spark, analyser):
    docs = made(random.Random(1), 300, WORDS) | {1000: (None, None), 1001: ("", ""), 1002: ("x" * 500, "ünïcode 漢字 " * 50)}
    index = L.TextIndex.create(frame(spark, docs), FIELDS, analyser)
    analyse = plain_tokens if analyser == "plain" else stemmed_tokens
    close(index.search(asked(spark, MATCHES)).collect(), scores(docs, MATCHES, analyse))
    close(index.search(asked(spark, MATCHES), weights=[3.0, 0.5]).collect(), scores(docs, MATCHES, analyse, (3.0, 0.5)))
    assert index.search(asked(spark, MATCHES).limit(0)).count() == 0


def test_a_phrase_stands_above_its_words_apart(spark):
    docs = {i: (None, "some other text of no use") for i in range(20)} | {50: (None, "red ring and small stone"), 51: (None, "stone and small red ring")}
    index = L.TextIndex.create(frame(spark, docs), FIELDS)
    rows = {r.id: r.bm25 for r in index.search(asked(spark, {0: ["small stone", "small", "stone"]})).collect()}
    assert rows[50] > rows[51] > 0


def bytes_of(folder):
    return sum(p.stat().st_size for p in Path(folder.removeprefix("file:")).rglob("*.parquet"))


def test_an_index_follows_its_documents(spark, tmp_path):
    rng = random.Random(2)
    docs = made(rng, 400, WORDS)
    index = L.TextIndex.create(frame(spark, docs), FIELDS, folder=f"{tmp_path}/index")
    for step in range(3):
        before = bytes_of(index.folder)
        for i in rng.sample(sorted(docs), 5):
            del docs[i]
        docs |= {i: ("new table", f"changed {step} " + "the run " * step) for i in rng.sample(sorted(docs), 5)} | {1000 + step: ("fresh", None)}
        assert index.sync(frame(spark, docs)) == (6, 5) and index.sync(frame(spark, docs)) == (0, 0)
        close(index.search(asked(spark, MATCHES)).collect(), scores(docs, MATCHES))
        if step == 0:
            assert bytes_of(index.folder) - before < 0.5 * before  # small files weigh little against fixed parts
    assert len(index.state().segments) == 4
    index.merge()
    state = index.state()
    assert len(state.segments) == 1 and state.documents == len(docs)
    close(index.search(asked(spark, MATCHES)).collect(), scores(docs, MATCHES))
    index.apply(deleted=spark.createDataFrame([(i,) for i in [*docs][:50]] + [(10**9,)], "id long"))
    close(index.search(asked(spark, MATCHES)).collect(), scores({i: t for i, t in docs.items() if i not in [*docs][:50]}, MATCHES))
    empty = L.TextIndex.create(frame(spark, docs).limit(0), FIELDS)
    assert empty.search(asked(spark, MATCHES)).count() == 0


def test_best_k_reads_a_part_and_misses_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 16)
    rng = random.Random(3)
    words = [f"w{int(1 / (rng.random() + 0.002))}" for _ in range(4000)]
    docs = made(rng, 1500, words)
    index = L.TextIndex.create(frame(spark, docs), FIELDS)
    matches = {q: [*(text := docs[rng.randrange(1500)][1].split()[:8]), " ".join(text)] for q in range(20)}
    want = collections.defaultdict(list)
    for (q, i), x in scores(docs, matches).items():
        want[q].append((-round(x, 9), i))
    got = collections.defaultdict(list)
    for r in index.search(asked(spark, matches), k=5).collect():
        got[r.query_id].append((-round(r.bm25, 9), r.id))
    for q, rows in want.items():
        assert sorted(got[q])[:5] == sorted(rows)[:5]
    assert index.share_read(asked(spark, matches), 5) < 0.9
    # no row holds a hot term whole
    blocks = index._blocks(index.state())
    hot = blocks.groupBy("term").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).orderBy(F.desc("n")).first()
    assert hot.n > 300 and hot.rows > 10 and blocks.agg(F.max("n")).first()[0] <= 48
