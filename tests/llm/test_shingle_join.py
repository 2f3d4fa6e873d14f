"""Near copies of the pipeline against brute force over all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest

from recollect.llm import shingle_join, simhash


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def survivors(rows):
    """Ids that stay, by union of all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and find(a) != find(b) and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                top[max(find(a), find(b))] = min(find(a), find(b))
    return {i for i in sets if find(i) == i}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def edited():
    """Texts with a phrase in common; copies of some with words replaced, so that similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(7)
    phrase, rows = "all of these words stand in each text alike".split(), [(1, None), (2, ""), (3, "one"), (4, "One"), (5, "two words here")]
    for _ in range(6):
        base = phrase + [f"w{x}" for x in rng.integers(0, 5000, rng.integers(40, 300))]
        for _ in range(9):
            words = list(base)
            for at in rng.choice(len(words), int(len(words) * rng.uniform(0, 0.05)), replace=False):
                words[at] = f"z{rng.integers(0, 10**6)}"
            rows.append((len(rows) + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize(("centres", "crowd", "chunk"), [(4, 16, 512), (1, 16, 5)])
def test_near_copies_as_by_brute_force(spark, edited, centres, crowd, chunk):
    want = survivors(edited)
    assert 10 < len(want) < len(edited) - 10
    assert {r.doc_id for r in shingle_join.drop_near_copies(frame(spark, edited), centres=centres, crowd=crowd, chunk=chunk).collect()} == want


def test_crowds_whose_texts_are_near_but_not_to_every_centre(spark):
    """Each of 80 texts differs from a base by a tenth of its words: some pairs are at 0.8, most are not."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(80):
        words = list(base)
        at = int(rng.integers(0, 180))
        words[at : at + 14] = [f"v{i}x{k}" for k in range(14)]
        rows.append((i, " ".join(words)))
    assert {r.doc_id for r in shingle_join.drop_near_copies(frame(spark, rows), centres=1, chunk=30).collect()} == survivors(rows)


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(11)
    missed = 0
    for _ in range(300):
        both, one, other = (np.unique(rng.integers(-(2**63), 2**63, n)) for n in (160, 20, 20))
        x, y = np.sort(np.concatenate([both, one])), np.sort(np.concatenate([both, other]))
        keys = shingle_join.band_keys(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0


def test_stage_drops_copies_that_differ_by_many_bits(spark, edited):
    """Copies above 0.8 go from the pipeline though their fingerprints differ by more than two bits."""
    import corpus_pipeline as cp

    base = edited[10][1].split()
    copy = base[:-8] + [f"new{i}" for i in range(4)] + base[-8:]
    rows = [(1, " ".join(base)), (2, " ".join(copy))]
    a, b = (shingles(t) for _, t in rows)
    prints = simhash.fingerprint_texts([t.encode() for _, t in rows])
    assert len(a & b) / len(a | b) >= 0.8 and int(prints[0] ^ prints[1]).bit_count() > 2
    assert [r.doc_id for r in cp.drop_near_copies(spark, frame(spark, rows), "").collect()] == [1]


def test_shared_and_missing_ids_and_no_rows(spark, edited):
    text, other = edited[10][1], edited[40][1]
    rows = [(None, text), (7, text), (5, text), (5, other), (9, other), (8, "apart")]
    got = [r.doc_id for r in shingle_join.drop_near_copies(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == [5, 5, 8, None]
    assert shingle_join.drop_near_copies(frame(spark, [])).collect() == []
