"""What a search over all texts or vectors does once a batch or task, not once a word or batch."""

from __future__ import annotations

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from recollect.functions import analysis as A
from recollect.operators import retrieval as R
from recollect.operators import scan as X

MARKS = [chr(c) for c in range(0x300, 0x300 + A.MANY_MARKS + 4)]
ODD = ["ΟΔΟΣ", "ΣΑΣ.Σ", "É", "a_b-c", "...", "", "x²٣", "漢字", "yes", "Y", "caresses", "flying", "ñ́a", "".join(f"o{m}" for m in MARKS), "İSTANBUL", "z" * 70, "agreed", "hopping"]


def test_new_pieces_of_a_batch_are_analysed_together(monkeypatch):
    calls = []

    class Counted:
        category = staticmethod(A.unicodedata.category)

        @staticmethod
        def normalize(form, text):
            calls.append(len(text))
            return __import__("unicodedata").normalize(form, text)

    monkeypatch.setattr(A, "unicodedata", Counted)
    texts = [" ".join(f"wörd{n * 50 + i}" for i in range(50)) for n in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], ["id", "a"])
    (out,) = X._counter([["word7"], ["word1999"]], "stemmed", [1.0])(iter([batch]))
    assert out.column("dl").to_pylist() == [50] * 40 and out.column("units").to_pylist()[39] == [1]
    assert len(calls) <= 2  # once a piece before: 2,000


@pytest.mark.parametrize("analyser", ["plain", "stemmed"])
def test_lines_have_the_terms_of_each(analyser):
    rng = random.Random(2)
    lines = ODD + ["".join(rng.choice("abesyÉΣ́.-_7é漢") for _ in range(rng.randrange(9))) + rng.choice(["", "ing", "ational", "sses", "ies", "ll"]) for _ in range(3000)]
    for some in (lines, [x for x in lines if x.isascii()], []):
        pieces = X._Pieces(analyser, code := {t: n + 1 for n, t in enumerate(dict.fromkeys(t for x in some for t in A.ANALYSERS[analyser](x)))})
        at = [pieces[x] for x in some]
        sizes, first, codes = pieces.table()
        for x, n in zip(some, at, strict=True):
            assert codes[first[n] : first[n] + sizes[n]].tolist() == [code[t] for t in A.ANALYSERS[analyser](x)]


@pytest.mark.parametrize("name", [int, "n{:05}".format])
def test_a_task_gives_k_rows_a_query_however_many_batches(name):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (900, 4)).astype(float)  # many ties
    ids = rng.permutation(900)
    batches = [pa.RecordBatch.from_arrays([pa.array([name(int(i)) for i in ids[a : a + 7]]), pa.array([*v[a : a + 7]], pa.list_(pa.float64()))], ["id", "v"]) for a in range(0, 900, 7)]
    asked = [SimpleNamespace(query_id=n, q=[*q]) for n, q in enumerate(v[:3])] + [SimpleNamespace(query_id=3, q=None)]
    got = pa.Table.from_batches(R.nearest(asked, 20)(iter(batches)))
    assert got.num_rows == 4 * 20  # before, 20 rows of each larger batch: all 900 of these small ones
    for n, r in enumerate(asked):
        size = np.linalg.norm(v, axis=1) * (np.linalg.norm(r.q) if r.q else 0)
        far = np.round(1 - np.divide(v @ np.array(r.q or [0.0] * 4), size, out=np.zeros(900), where=size > 0), 9)
        want = sorted(zip(far.tolist(), ids.tolist(), strict=True))[:20]
        rows = [x for x in got.to_pylist() if x["query_id"] == n]
        assert sorted((x["distance"], x["id"]) for x in rows) == [(d, name(i)) for d, i in want]
    assert not [*R.nearest(asked, 20)(iter([]))]
