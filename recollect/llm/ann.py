"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order. Vectors are posted in their
pivots' inverted files; for a query the files of its own pivots are read, vectors
ranked by footrule distance of the two orders, and the best reranked by cosine.

The index is cut into blocks by a hash of the id, and the query set into blocks too, so the work of a
task is bounded and copies of one vector spread over all blocks. Each block has its own inverted files; a
query reads DEPTH of PIVOTS of them, an eighth of all postings. Vectors without structure need that much:
shorter orders or fewer files lose the nearest (see the README for figures).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pivots are taken from a sample of PIVOTS * 4 vectors; each vector is posted under its nearest DEPTH.
PIVOTS, DEPTH = 512, 64
#: Rows of an index block and of a query block.
BLOCK, QUERIES = 16_384, 8192
#: Of a block of n vectors so many times the root of n are reranked: neighbours stand out from a larger block by more, so the part that must be read falls.
RERANK = 8.0


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Distinct unit vectors from a bounded sample by a hash of the id, of its most frequent dimension (the largest of equals)."""
    rows = vectors.select("i", "v").orderBy(F.xxhash64("i"), "i").limit(4 * pivots).collect()
    found: dict[bytes, np.ndarray] = {}
    sizes = [len(r.v) for r in rows]
    dim = max(sizes, key=lambda n: (sizes.count(n), n), default=0)
    for r in rows:
        if len(r.v) == dim:
            v = unscaled(np.array([r.v], float))[0]
            v = v / np.linalg.norm(v)
            found.setdefault(v.tobytes(), v)
    return np.array(list(found.values())[:pivots])


def unscaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their largest component: squares neither overflow nor vanish, and cosines keep every bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def orders(vectors: DataFrame, pivots: np.ndarray, depth: int = DEPTH) -> DataFrame:
    """Adds `order`: the numbers of the nearest pivots, nearest first, two bytes each."""
    kind = vectors.schema["i"].dataType.simpleString()
    element = vectors.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unscaled(np.array(b.column(1).to_pylist(), float))
            near = np.argsort(-(x @ pivots.T) / np.linalg.norm(x, axis=1, keepdims=True), axis=1, kind="stable")[:, :depth].astype("<u2")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in near], pa.binary())], ["i", "v", "order"])

    return vectors.select("i", "v").mapInArrow(run, f"i {kind}, v {element}, order binary")


def search_block(ids: np.ndarray, x: np.ndarray, order: np.ndarray, qids: np.ndarray, q: np.ndarray, qorder: np.ndarray, pivots: int, k: int, rerank: float = RERANK) -> list[tuple[int, int, float]]:
    """(query, vector, cosine): the k best of a block for each query. ids ascend, without repeats."""
    n, depth = order.shape
    pivot = order.ravel()
    place = np.argsort(pivot, kind="stable")
    row, rank = (place // depth).astype(np.int64), (place % depth).astype(np.int64)
    ends = np.cumsum(np.bincount(pivot, minlength=pivots))
    norm = np.sqrt((x * x).sum(1))
    want = min(n, math.ceil(rerank * math.sqrt(n)) + k)
    out = []
    for a, v, own in zip(qids.tolist(), q, qorder, strict=True):
        # 0 would be no pivot in common; each common pivot saves twice the depth, less what the orders differ by
        saved = np.zeros(n, np.int64)
        for at, p in enumerate(own.tolist()):
            lo, hi = (int(ends[p - 1]) if p else 0), int(ends[p])
            saved[row[lo:hi]] += (depth - at) + (depth - rank[lo:hi]) - np.abs(rank[lo:hi] - at)
        key = saved * -n + np.arange(n)  # ties to the smaller id
        near = np.argpartition(key, want - 1)[:want]
        near = near[ids[near] != a]
        if not len(near):
            continue
        cosine = (x[near] * v).sum(1) / (norm[near] * np.sqrt((v * v).sum()))
        best = np.lexsort((ids[near], -cosine))[:k]
        out += [(a, int(ids[near[j]]), float(cosine[j])) for j in best]
    return out


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, depth: int = DEPTH, block: int = BLOCK, rerank: float = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, by cosine, of the rows for which `queries` (a condition on columns of vectors) holds.

    Rows whose vector is null, zero, of another dimension, or has a null or non-finite component take no part, and neither do null ids; rows that share
    an id are one vector, the least of them; equal scores rank by smaller id; with fewer candidates all come. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("i"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("i").isNotNull() & usable(F.col("v")))
    points = choose_pivots(rows, pivots)
    schema = "query_id bigint, vec_id bigint, score double"
    if not len(points):
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.filter(F.size("v") == points.shape[1])
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("asks"))).first()
    blocks, qblocks = max(1, -(-n // block)), max(1, -(-asked // QUERIES))
    index = orders(rows, points, depth).withColumn("_b", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    asking = orders(rows.filter("asks"), points, depth).withColumn("_q", F.pmod(F.xxhash64("i"), F.lit(qblocks)))
    index = index.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(qblocks - 1).cast("bigint"))))
    asking = asking.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

        def of(pdf: pd.DataFrame) -> tuple:
            pdf = pdf.sort_values("i", kind="stable")
            if (same := pdf["i"].duplicated(keep=False).to_numpy()).any():  # of an id the least vector; all its rows are in this block
                least = pdf[same].assign(t=[tuple(v) for v in pdf["v"][same]]).sort_values(["i", "t"]).drop_duplicates("i").drop(columns="t")
                pdf = pd.concat([pdf[~same], least]).sort_values("i", kind="stable")
            order = np.frombuffer(b"".join(pdf["order"]), "<u2").reshape(len(pdf), -1).astype(np.int64)
            return pdf["i"].to_numpy(np.int64), unscaled(np.stack(pdf["v"].to_numpy()).astype(float)), order

        return pd.DataFrame(search_block(*of(left), *of(right), len(points), k, rerank), columns=["query_id", "vec_id", "score"])

    found = index.groupBy("_b", "_q").cogroup(asking.groupBy("_b", "_q")).applyInPandas(run, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
