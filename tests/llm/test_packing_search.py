"""The local search ends only at the least number of bins or where no exchange is left."""

from __future__ import annotations

import numpy as np
import pytest

from recollect.llm import packing


@pytest.mark.parametrize(("low", "high", "pieces", "room"), [(800, 2600, 600, 4096), (1, 30, 300, 100), (1, 400, 500, 4096)])
def test_no_exchange_is_left(low, high, pieces, room):
    lengths = np.random.default_rng(2).integers(low, high + 1, pieces)
    done = packing.local_search(lengths, [[i] for i in range(pieces)], room)
    assert sorted(i for b in done for i in b) == list(range(pieces)) and all(lengths[b].sum() <= room for b in done)
    if len(done) == -(-int(lengths.sum()) // room):
        return
    held = sorted((sorted((int(lengths[i]), i) for i in b) for b in done), key=lambda b: sum(n for n, _ in b))
    for k, spare in enumerate(held):
        for full in held[k + 1 :]:
            assert packing._improve(full, spare, room - sum(n for n, _ in full)) is None


def test_search_goes_on_over_thousands_of_open_bins():
    lengths = np.random.default_rng(1).integers(800, 2601, 16_384)
    start = packing.best_fit(lengths, 4096)
    assert (len(start), len(packing.local_search(lengths, start, 4096))) == (6930, 6838)  # with 20,000 tries: 6929; at least 6819
