"""Near copies: texts whose sets of five-word shingles have Jaccard similarity 0.8 or more.

Two searches propose pairs, and the whole sets decide. SimHash (`simhash.links`) proposes texts
whose fingerprints differ by two bits at most; sets of similarity 0.8 differ by ten on average, so
it finds the nearest only. Bands of minima find the rest: a text is posted under BANDS keys, each of
ROWS minima of its shingle hashes, and a pair at the threshold shares a key but for one in twenty million.

Only what joins components counts, so no group is compared all against all: its texts meet a few
centres first, the one with most company among them. Those that are still apart are compared in blocks, as
products of matrices, which give only the pairs that are similar. Texts with the same set are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, materialize, short_shuffles, slices, stage_table, tidy
from .simhash import _LOWER, _SPACE, SEED, components, fingerprint_texts, hash_spans, links

WORDS = 5
#: Of a pair at 0.8 a band's minima agree with chance 0.8 ** ROWS; that all bands miss it has chance 5e-8.
BANDS, ROWS = 32, 4
#: Texts of a group that all its texts are compared with first, and how many they must be for more than one of them.
CENTRES, CROWD = 4, 16
#: Texts of one side of a block.
CHUNK = 512
#: Bits of the fixed filter that picks texts before their sets are made again.
SLOTS = 1 << 21

# similar: |A & B| / |A | B| >= 4/5, so 9 |A & B| >= 4 (|A| + |B|)
_SIZES = "5 * least(sa, sb) >= 4 * greatest(sa, sb)"


def shingle_sets(texts: list[bytes], words: int = WORDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and where each text's begin and end. A text of fewer words is one shingle; one of none has none."""
    none = np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    if not texts:
        return none
    buf = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    doc_at = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    word = ~_SPACE[buf]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(~word & before)
    if not len(starts):
        return none
    flat = np.concatenate([np.where(word, buf, np.uint8(32))[word | before], np.zeros(16, np.uint8)])  # one space behind each word
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    of = np.searchsorted(doc_at, starts, "right") - 1
    count = np.bincount(of, minlength=len(texts))
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < words))
    w = words - 1
    head = np.flatnonzero(of[w:] == of[: len(of) - w])
    begin, last = np.concatenate([head, first[few]]), np.concatenate([head + w, first[few] + count[few] - 1])
    h = hash_spans(flat, at[begin], at[last] + size[last] - at[begin], seed).view(np.int64)
    doc = of[begin]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def band_keys(h: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> np.ndarray:
    """The key of each band of each set; sets without shingles have zeros. Each minimum is over a permutation of all 64-bit hashes."""
    made = np.random.default_rng(seed).integers(0, 2**64, (2, bands * rows + 1), np.uint64)
    mask, times = made[0], made[1] | np.uint64(1)
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, bands), np.uint64)
    if not len(some):
        return out.view(np.int64)
    raw, begin = h.view(np.uint64), at[:-1][some]
    for b in range(bands):
        key = np.full(len(some), b, np.uint64)
        for j in range(b * rows, b * rows + rows):
            least = np.minimum.reduceat((raw ^ mask[j]) * times[j], begin)
            key = (key ^ least) * times[-1]
            key ^= key >> np.uint64(31)
        out[some, b] = key
    return out.view(np.int64)


def _slot(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(SLOTS))


def _digest(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(h[b:e].tobytes(), SEED) if e > b else 0 for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node (digest of the set), size, fp (the SimHash fingerprint of five-word shingles), and the keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in slices(large, 1, 1 << 20):
                texts = as_bytes(batch.column(1))
                h, at = shingle_sets(texts)
                keys = band_keys(h, at)
                posts = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                fp = fingerprint_texts(texts, WORDS).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_digest(h, at)), pa.array(np.diff(at), pa.int64()), pa.array(fp), posts], ["doc_id", "node", "size", "fp", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bound_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(tidy(run), f"doc_id {kind}, node bigint, size bigint, fp bigint, keys array<bigint>")


def _sets(docs: DataFrame, id_col: str, text_col: str, picked: np.ndarray) -> DataFrame:
    """node, size and shingles of the rows whose id is in a slot that is `picked`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            large = large.filter(pa.array(picked[large.column(1).to_numpy()]))
            for batch in slices(large, 0, 1 << 20):
                h, at = shingle_sets(as_bytes(batch.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(_digest(h, at)), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h, pa.int64()))], ["node", "size", "shingles"])

    return bound_batches(docs).select(F.col(text_col).alias("t"), _slot(id_col).alias("slot")).mapInArrow(tidy(run), "node bigint, size bigint, shingles array<bigint>")


def _whole_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, size and shingles of the wanted nodes. Only their texts are made into sets again."""
    ids = materialize(nodes.select("node", "least").join(wanted, "node", "left_semi"))
    picked = np.zeros(SLOTS, bool)
    bits = ids.select(_slot("least").alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits"))
    for r in bits.collect():  # SLOTS bits at most
        own = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
        at = np.flatnonzero(own) + (r.n - 1) * len(own) + 1  # buckets count from one, and begin at one
        picked[at[(at >= 0) & (at < SLOTS)]] = True
        picked[0] = True
    return stage_table(_sets(docs, id_col, text_col, picked).join(ids, "node", "left_semi").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar."""
    x = sets.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("shingles").alias("y"))
    return materialize(pairs.join(x, "a").join(y, "b").filter("9 * size(array_intersect(x, y)) >= 4 * (sa + sb)").select("a", "b"))


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many shingles each two of the sets share."""
    size = np.array([len(x) for x in sets], np.int64)
    every, column, held = np.unique(np.concatenate(sets) if len(sets) else np.zeros(0, np.int64), return_inverse=True, return_counts=True)
    number = np.cumsum(held > 1) - 1  # those that one set alone holds are in no overlap
    row = np.repeat(np.arange(len(sets)), size)
    shared = held[column] > 1
    row, column = row[shared], number[column[shared]]
    out = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(number[-1]) + 1 if len(every) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[lo:hi], column[lo:hi] - start] = 1
        out += (part @ part.T).astype(np.int64)
    np.fill_diagonal(out, size)
    return out


def _in_blocks(members: DataFrame, sets: DataFrame, chunk: int) -> DataFrame:
    """Links between nodes of different labels in one cluster, which is what keys (k, node, label) hold together. A cluster is dealt to chunks, and each two chunks are one task."""
    edges = members.join(members.groupBy("k").agg(F.min("node").alias("a")), "k").filter("node > a").select("a", F.col("node").alias("b")).distinct()
    tops = components(edges).withColumnRenamed("label", "cluster")
    placed = members.select("node", "label").distinct().join(tops, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    many = placed.groupBy("cluster").agg(F.ceil(F.count("*") / chunk).alias("m"))
    dealt = placed.join(many, "cluster").withColumn("c", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("m")))
    rows = dealt.join(sets, "node").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    rows = rows.select("cluster", F.least("c", "j").alias("lo"), F.greatest("c", "j").alias("hi"), "c", "node", "label", "size", "shingles")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        node, label, size, c = (pdf[x].to_numpy(np.int64) for x in ("node", "label", "size", "c"))
        alike = 9 * overlaps([np.asarray(x, np.int64) for x in pdf["shingles"]]) >= 4 * (size[:, None] + size)
        alike &= (label[:, None] != label) & (node[:, None] < node)
        if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
            alike &= c[:, None] != c
        a, b = np.nonzero(alike)
        return pd.DataFrame({"a": node[a], "b": node[b]})

    return rows.groupBy("cluster", "lo", "hi").applyInPandas(run, "a bigint, b bigint")


def _near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes by SimHash: those of one fingerprint with its first, and the first ones of fingerprints within two bits."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    one = nodes.select("fp", "node").join(firsts, "fp").selectExpr("first AS a", "node AS b")
    near = links(firsts.select("fp"))
    x, y = firsts.selectExpr("fp AS a", "first AS x"), firsts.selectExpr("fp AS b", "first AS y")
    return one.unionByName(near.join(x, "a").join(y, "b").selectExpr("x AS a", "y AS b"))


def similar_links(docs: DataFrame, prints: DataFrame, nodes: DataFrame, id_col: str, text_col: str, centres: int = CENTRES, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b), a < b, between nodes of similarity 0.8 or more. They connect all that such pairs connect.

    Keys whose texts are all in one component leave after the centres; what is left is compared in blocks of two chunks.
    """
    first_of = nodes.select(F.col("node").alias("own"), "least")
    posted = prints.join(first_of, F.col("node").eqNullSafe(F.col("own")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "size", F.explode("keys").alias("k"))
    counts = posted.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    member = posted.join(counts, "k")
    company = member.groupBy("node").agg(F.sum("n").alias("company"))
    members = materialize(member.join(company, "node").select("k", "node", "size", "company"))
    picks = ["max_by(struct(node, size), struct(company, node))", *[f"min_by(struct(node, size), xxhash64(node, {j}))" for j in range(1, centres)]]
    middle = members.groupBy("k").agg(F.count("*").alias("n"), *[F.expr(p).alias(f"c{j}") for j, p in enumerate(picks)])
    middle = middle.select("k", F.expr(f"IF(n > {crowd}, array({', '.join(f'c{j}' for j in range(centres))}), array(c0)) AS centres"))
    met = members.join(middle, "k").selectExpr("node AS a", "size AS sa", "explode(centres) AS c").selectExpr("a", "c.node AS b", "sa", "c.size AS sb").filter(_SIZES).select("a", "b")
    pairs = met.unionByName(_near_fingerprints(nodes)).filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    tried = materialize(pairs)
    near = _verified(tried, _whole_sets(tried.selectExpr("explode(array(a, b)) AS node").distinct(), nodes, docs, id_col, text_col))
    told = members.select("k", "node").join(components(near), "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = told.groupBy("k").agg(F.min("label").alias("l"), F.max("label").alias("m")).filter("l <> m").select("k")
    rest = materialize(told.join(apart, "k", "left_semi").select("k", "node", "label"))
    if rest.isEmpty():
        return near
    sets = _whole_sets(rest.select("node").distinct(), nodes, docs, id_col, text_col)
    return materialize(near.unionByName(_in_blocks(rest, sets, chunk)).distinct())


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", centres: int = CENTRES, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs of which each component of similar texts keeps its smallest id; rows that share an id are one document, and rows without id stay.

    The text is read several times, so docs should be stored. Null and texts without words are alike.
    """
    with short_shuffles(docs.sparkSession):
        prints = stage_table(_prints(docs, id_col, text_col))
        nodes = materialize(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("fp").alias("fp")).filter("size > 0"))
        labels = components(similar_links(docs, prints, nodes, id_col, text_col, centres, crowd, chunk))
    told = prints.select("doc_id", "node").join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("label"))
    tops = told.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    gone = told.join(tops, "label").filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
