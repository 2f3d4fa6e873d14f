"""Best-fit packing of token sequences, improved by swap-based local search.

Only lengths move: documents are tokenised where they are read, and groups of
about GROUP pieces, dealt by a hash of document, piece and place, are packed apart from
each other. A group's loss is at most about one sequence, so a corpus of any size packs
as tightly as one group does, and no task grows with the input.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, slices, tidy
from .word_bpe import text_ids

CAPACITY = 4096
#: Pieces that one task packs; the number of groups follows the input.
GROUP = 16_384
END_ID = 1

def token_pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with END_ID behind, cut every `capacity` ids. A null text is an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_ids(tokenizer_file)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, edges = encoder.ids(batch.column(1), END_ID)
                size = np.diff(edges)
                parts = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                at = 4 * (edges[row] + start)
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                crc = [zlib.crc32(raw[b : b + n]) for b, n in zip(at.tolist(), (4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bound_batches(docs).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(tidy(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int, order: np.ndarray | None = None) -> list[list[int]]:
    """Best fit: each item, in `order` (longest first, if None), goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left
    left: list[int] = []  # the values of free that hold bins, sorted
    for i in (np.argsort(-lengths, kind="stable") if order is None else order).tolist():
        n = int(lengths[i])
        k = bisect_left(left, n)
        if k < len(left):
            room = left[k]
            b = free[room].pop()
            if not free[room]:
                left.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= n
        if room:
            if not free[room]:
                insort(left, room)
            free[room].append(b)
    return bins


def _improve(full: list[tuple[int, int]], spare: list[tuple[int, int]], gap: int) -> tuple[list[int], list[int]] | None:
    """What to take from `spare` and to give from `full` so that `full` grows most, within its gap: a move, one for one, two for one or one for two. Lists of (length, item), sorted."""
    best, found = 0, None

    def offer(gain: int, take: list[int], give: list[int]) -> None:
        nonlocal best, found
        if best < gain <= gap:
            best, found = gain, (take, give)

    k = bisect_right(spare, (gap, 1 << 60))
    if k:
        offer(spare[k - 1][0], [spare[k - 1][1]], [])
    for n, y in full:
        if best == gap:
            break
        k = bisect_right(spare, (n + gap, 1 << 60))
        if k:
            offer(spare[k - 1][0] - n, [spare[k - 1][1]], [y])
    for one, two, sign in ((full, spare, 1), (spare, full, -1)):  # two of `two` against one of `one`
        if best == gap or len(two) < 2:
            continue
        for n, y in one:
            lo, hi = 0, len(two) - 1
            while lo < hi:
                gain = sign * (two[lo][0] + two[hi][0] - n)
                pair, single = [two[lo][1], two[hi][1]], [y]
                if 0 < gain <= gap:
                    offer(gain, pair if sign > 0 else single, single if sign > 0 else pair)
                too_large = gain > gap if sign > 0 else gain <= 0
                if too_large:
                    hi -= 1
                else:
                    lo += 1
    return found


#: Bins of more items are always tried; for the rest a scan tells first whether an exchange exists.
_FEW = 8
_NONE = 1 << 40


class _Bins:
    """Bins by number, with the lengths of bins of few items in a matrix, so that many are scanned at once."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]]):
        self.items = [sorted((int(lengths[i]), i) for i in b) for b in bins]
        self.fill = np.array([sum(n for n, _ in b) for b in self.items], np.int64)
        self.one = np.full((len(bins), _FEW + 1), _NONE, np.int64)
        self.one[:, 0] = 0  # nothing is given for what is taken
        self.two = np.full((len(bins), _FEW * (_FEW - 1) // 2), _NONE, np.int64)
        self.many = np.zeros(len(bins), bool)
        for b in range(len(bins)):
            self.note(b)

    def note(self, b: int) -> None:
        n = [x for x, _ in self.items[b]]
        self.many[b] = len(n) > _FEW
        if not self.many[b]:
            self.one[b, 1:] = n + [_NONE] * (_FEW - len(n))
            pairs = [x + y for k, x in enumerate(n) for y in n[:k]]
            self.two[b] = pairs + [_NONE] * (self.two.shape[1] - len(pairs))

    def can_take(self, at: np.ndarray, spare: list[tuple[int, int]], capacity: int) -> np.ndarray:
        """Which of the bins `at` an exchange with `spare` may fill better: exact for bins of few items."""
        n = np.array([x for x, _ in spare], np.int64)
        if len(n) > 64:
            return np.ones(len(at), bool)
        pairs = (n[:, None] + n[None, :])[np.triu_indices(len(n), 1)]
        gap = (capacity - self.fill[at])[:, None]
        out = self.many[at]
        for given, taken in ((self.one[at], np.unique(np.concatenate([n, pairs]))), (self.two[at], np.unique(n))):
            taken = np.append(taken, 4 * _NONE)
            out = out | (taken[np.searchsorted(taken, given, "right")] - given <= gap).any(axis=1)
        return out


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Exchange documents between underfull bins while squared fill grows, until bins empty or nothing improves.

    In each round every bin, emptiest first, gives to those at least as full, fullest first. Each step moves fill from a bin to one at least as full, so the sum of squares grows and the search ends: when the number of bins is the least possible, or a round moves nothing. A giver looks only at bins that changed since it last found nothing.
    """
    least = -(-int(lengths.sum()) // capacity)
    count = len(bins)
    if count <= least:
        return [b for b in bins if b]
    now = _Bins(lengths, bins)
    fill = now.fill
    clock, changed, looked = 1, np.ones(len(bins), np.int64), np.zeros(len(bins), np.int64)
    moved = True
    while moved and count > least:
        moved = False
        for giver in np.argsort(fill, kind="stable").tolist():
            while 0 < fill[giver] < capacity and count > least:
                since = looked[giver] if changed[giver] <= looked[giver] else 0
                others = np.flatnonzero((fill >= fill[giver]) & (fill < capacity) & (changed > since))
                others = others[others != giver]
                others = others[np.argsort(-fill[others], kind="stable")]
                spare, gave, at, step = now.items[giver], False, 0, 128
                while at < len(others) and spare:
                    hit = np.flatnonzero(now.can_take(others[at : at + step], spare, capacity))
                    if not len(hit):
                        at, step = at + step, min(2 * step, 4096)
                        continue
                    b = int(others[at + hit[0]])
                    at, step = at + int(hit[0]) + 1, 128
                    full, before = now.items[b], spare
                    while spare and fill[b] < capacity and (found := _improve(full, spare, int(capacity - fill[b]))):
                        take, give = found
                        gain = int(sum(lengths[i] for i in take) - sum(lengths[i] for i in give))
                        full = sorted([x for x in full if x[1] not in give] + [(int(lengths[i]), i) for i in take])
                        spare = sorted([x for x in spare if x[1] not in take] + [(int(lengths[i]), i) for i in give])
                        fill[b] += gain
                        fill[giver] -= gain
                    if spare is not before:
                        gave, clock = True, clock + 1
                        now.items[b], now.items[giver] = full, spare
                        changed[b] = changed[giver] = clock
                        now.note(b), now.note(giver)
                if not gave:
                    looked[giver] = clock
                    break
                moved = True
                count -= not spare
    return [[i for _, i in b] for b in now.items if b]


def pack_group(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of items: best fit as the items come leaves slack, which the local search gathers until bins empty.

    If it ends above the least possible number, it searches again from best fit with the longest first, and the fewer bins are taken, the first of equals.
    """
    bins = local_search(lengths, best_fit(lengths, capacity, np.arange(len(lengths))), capacity)
    if len(bins) > -(-int(lengths.sum()) // capacity):
        bins = min(bins, local_search(lengths, best_fit(lengths, capacity), capacity), key=len)
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (1 to `capacity`).

    Repeated rows are packed as they come; an empty table gives an empty one. The rows are read twice and numbered as they lie, so they must be stored.
    """
    groups = max(1, -(-pieces.count() // group))
    schema = pieces.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    names = pieces.columns

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, items in enumerate(pack_group(lengths, capacity)):
            seq[items] = (int(key[0]) << 32) + k
            off[items] = np.cumsum(lengths[items]) - lengths[items]
        return pdf[names].assign(sequence_id=seq, offset=off)

    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))  # repeated rows are dealt apart
    return dealt.groupBy("_g").applyInPandas(run, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    Null and empty texts have the one id END_ID; longer documents than `capacity` are cut, no other; extra columns are left out.
    """
    return pack(materialize(token_pieces(docs, tokenizer_file, capacity=capacity)), capacity, group)
