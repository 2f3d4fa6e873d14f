"""SimHash near-deduplication through deletion-variant signatures.

Fingerprints within two bits of each other agree, in one of two 32-bit segments, but
for one bit at most. So each fingerprint is posted under its segments with one bit
deleted (64 rows) and under its whole segments (2 rows); an equality join of the
postings proposes pairs, and the bits that differ are counted. Work is on distinct
fingerprints: copies of a text, however many, are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Rounds, as_bytes, bound_batches, materialize, short_shuffles, slices, tidy

SEED = 42
WORDS = 3
#: Distinct fingerprints that share a whole segment beyond which their pairs are not enumerated, but found by equality of keys with two bits deleted.
CROWD = 256
#: Steps in which a crowd's two-bit keys are compared, so that few of them lie on disk at once.
PARTS = 8

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))  # fixed values of XXH64
_LONG = 255


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _hash_equal_length(buf: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of the n bytes from each of the places `at`; buf has at least 8 bytes behind the last."""
    lane = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    half = np.ndarray((len(buf) - 3,), "<u4", buffer=buf, strides=(1,))
    s = np.full(len(at), seed, np.uint64)
    p = 0
    if n >= 32:
        v = [s + _P1 + _P2, s + _P2, s.copy(), s - _P1]
        while p + 32 <= n:
            for i in range(4):
                v[i] = _rotl(v[i] + lane[at + (p + 8 * i)] * _P2, 31) * _P1
            p += 32
        h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            h = (h ^ (_rotl(x * _P2, 31) * _P1)) * _P1 + _P4
    else:
        h = s + _P5
    h = h + np.uint64(n)
    while p + 8 <= n:
        h = _rotl(h ^ (_rotl(lane[at + p] * _P2, 31) * _P1), 27) * _P1 + _P4
        p += 8
    if p + 4 <= n:
        h = _rotl(h ^ (half[at + p].astype(np.uint64) * _P1), 23) * _P2 + _P3
        p += 4
    while p < n:
        h = _rotl(h ^ (buf[at + p].astype(np.uint64) * _P5), 11) * _P1
        p += 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def hash_spans(buf: np.ndarray, at: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of a buffer, those of equal length together."""
    out = np.zeros(len(at), np.uint64)
    kind = np.minimum(size, _LONG + 1).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    edges = np.flatnonzero(np.diff(kind[order])) + 1
    for part in np.split(order, edges):
        if not len(part):
            continue
        if kind[part[0]] > _LONG:
            raw = buf.tobytes()
            for i in part.tolist():
                out[i] = xxhash.xxh64_intdigest(raw[at[i] : at[i] + size[i]], seed)
        else:
            out[part] = _hash_equal_length(buf, at[part], int(kind[part[0]]), seed)
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.uint64(0x0101010101010101)


def fingerprint_texts(texts: list[bytes], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprint of each text. A text of fewer words is one shingle; one of none has fingerprint zero."""
    out = np.zeros(len(texts), np.uint64)
    if not texts:
        return out
    buf = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    doc_at = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    word = ~_SPACE[buf]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
    if not len(starts):
        return out
    flat = np.concatenate([np.where(word, buf, np.uint8(32))[word | before], np.zeros(16, np.uint8)])  # one space behind each word
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    of = np.searchsorted(doc_at, starts, "right") - 1
    count = np.bincount(of, minlength=len(texts))
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):
        last = first[few] + count[few] - 1
        out[few] = hash_spans(flat, at[first[few]], at[last] + size[last] - at[first[few]], seed)
    full = np.flatnonzero(count >= words)
    if not len(full):
        return out
    w = words - 1
    head = np.flatnonzero(of[w:] == of[: len(of) - w]) if w else np.arange(len(of))
    h = hash_spans(flat, at[head], at[head + w] + size[head + w] - at[head], seed)
    n = count[full] - w
    begin = np.cumsum(n) - n
    runs = -(-n // 255)  # bytes count to 255
    run_first = np.cumsum(runs) - runs
    run_at = np.repeat(begin, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(run_first, runs))
    bits = np.zeros(len(full), np.uint64)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & _BYTES, run_at).astype("<u8").view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums.astype(np.int64), run_first, axis=0)
        for j in range(8):
            bits |= (2 * total[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 2 << 20):
                fp = fingerprint_texts(as_bytes(batch.column(1)), words)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bound_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(tidy(run), f"doc_id {kind}, fp bigint")


def _stars(keyed: DataFrame) -> DataFrame:
    """Of fingerprints with a key in common, links of each to the smallest. A key leaves two bits open, so four share it at most, and one shuffle brings them together. The links are stored, for the rows behind them are many."""
    least = F.min("fp").over(Window.partitionBy("k"))
    return materialize(keyed.select("fp", least.alias("a")).filter("fp <> a").select("a", F.col("fp").alias("b")).distinct())


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` at one or two differing bits. They connect all that such pairs connect.

    Pairs are enumerated but within crowds; there a link to the smallest fingerprint under each two-bit deletion key stands for the pairs of that key.
    """
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    whole = distinct.selectExpr("fp", f"explode(array({low}, ({high}) | 4294967296L)) AS seg")
    sizes = whole.groupBy("seg").count().filter("count > 1")
    shared = materialize(whole.join(sizes, "seg"))
    calm = shared.filter(F.col("count") <= crowd)
    same = calm.select("seg", F.col("fp").alias("a")).join(calm.select("seg", F.col("fp").alias("b")), "seg").filter("a < b AND bit_count(a ^ b) <= 2").select("a", "b")
    crowded = shared.filter(F.col("count") > crowd)
    packed = not crowded.isEmpty()
    one_off = "fp", "b", "shiftleft(CAST(b AS BIGINT), 32) | IF(b < 32, m & 4294967295L, shiftrightunsigned(m, 32)) AS k", "(fp ^ m) <> 0 AS one"
    posted = distinct.selectExpr("fp", "explode(sequence(0, 63)) AS b").selectExpr("fp", "b", "fp & ~shiftleft(1L, b) AS m").selectExpr(*one_off)
    if packed:
        crowds = crowded.selectExpr("fp", "IF(seg >= 4294967296L, 1, 0) AS side")
        flags = crowds.groupBy("fp").agg(F.max(F.col("side") == 0).alias("low"), F.max(F.col("side") == 1).alias("high"))
        posted = posted.join(flags, "fp", "left").selectExpr("fp", "b", "k", "one", "coalesce(IF(b < 32, low, high), false) AS hot")
    else:
        posted = posted.selectExpr("fp", "k", "one", "false AS hot")
    zero, one = posted.filter("NOT one").selectExpr("k", "fp AS a", "hot AS ha"), posted.filter("one").selectExpr("k", "fp AS b", "hot AS hb")
    pairs = zero.filter("NOT ha").join(one, "k")
    if packed:  # members of two crowds meet by their two-bit keys below, never all with all
        pairs = pairs.unionByName(zero.filter("ha").join(one.filter("NOT hb"), "k"))
    found = same.unionByName(pairs.filter("bit_count(a ^ b) <= 2").select("a", "b"))
    if packed:
        other = f"IF(seg >= 4294967296L, {low}, {high})"
        two = crowded.selectExpr("fp", "seg", f"{other} AS o", "explode(sequence(0, 30)) AS p").selectExpr("fp", "seg", "o", "p", "explode(sequence(p + 1, 31)) AS q")
        found = found.unionByName(_stars(two.selectExpr("fp", "struct(seg, p, q, o & ~shiftleft(1L, p) & ~shiftleft(1L, q) AS o) AS k")))
        for part in range(PARTS):  # a key has its first bit in it, so keys of different bits never meet
            hot = posted.filter(f"hot AND b % {PARTS} = {part}").selectExpr("fp", "b", "k AS s", f"IF(b < 32, {high}, {low}) AS o", "explode(sequence(0, 31)) AS q")
            found = found.unionByName(_stars(hot.selectExpr("fp", "struct(s, q, o & ~shiftleft(1L, q) AS o) AS k")))
    return found.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for nodes that have an edge (a, b), a < b.

    Alternating large and small stars: each round links neighbours to the smallest node in reach, until nothing changes; the rounds grow with the logarithm of the nodes.
    """
    with short_shuffles(edges.sparkSession):
        now = _contracted(edges)
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))


def _contracted(edges: DataFrame) -> DataFrame:
    """Links of each node to the smallest of its component."""
    rounds, seen = Rounds(edges.sparkSession), None
    now = rounds.keep(edges.select("a", "b"))
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return now
        seen = state
        both = now.unionByName(now.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS node", "least(a, m) AS m")
        large = both.filter("b > a").join(least, F.col("a") == F.col("node")).selectExpr("m AS a", "b").filter("a <> b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "node")
        kept = least.selectExpr("m AS a", "node AS b")
        moved = large.join(least, F.col("b") == F.col("node")).filter("a <> m").selectExpr("m AS a", "a AS b")
        now = rounds.keep(kept.unionByName(moved).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable over links of two bits or fewer) of every row.

    Null and empty texts have fingerprint zero, linked like any other. Null ids are never a component's id, unless it has no other.
    """
    with short_shuffles(docs.sparkSession):
        prints = materialize(fingerprints(docs, id_col, text_col, words))
        nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
        labels = components(links(nodes.select("fp"), crowd))
    joined = nodes.join(labels, F.col("fp") == F.col("node"), "left")
    loose = joined.filter("label IS NULL").select("fp", F.col("least").alias("component_id"))
    linked = nodes.join(labels.unionByName(labels.selectExpr("label AS node", "label").distinct()), F.col("fp") == F.col("node")).select("fp", "label", "least")
    tops = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    tied = linked.join(tops, "label").select("fp", "component_id")
    roots = loose.join(tied.select("fp"), "fp", "left_anti")
    return prints.join(tied.unionByName(roots), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which each component keeps its smallest id; rows that share an id are one document, and rows without id stay."""
    found = near_duplicates(docs, id_col, text_col)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
