"""Spelling variants: words one insertion, deletion or replacement apart, and the frequent form each belongs to.

A symmetric-delete join: every word posts itself and its distinct single deletions, and two words that are one
edit apart share a post. A post is a 64-bit hash of the shorter string, made for all places of a word from running
sums, so that a word of any length posts a few bytes a place; equal hashes propose and the strings decide. A post is
shared by as many words at most as its places and the alphabet allow, whatever the corpus holds.

Words, posts and pairs grow with the corpus while their files stay small, so every join is a sort-merge join by hint: by
file sizes Spark would gather and broadcast them, many times as large, through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, slices, stage_table

#: Least code points and least occurrences of a word, how often a form must be to a word, and the modulus of runs that lose a code point.
LENGTH, LEAST, RATIO, DAMAGE = 5, 3, 2, 97
# The runs of letters, and the letters that are lower-cased.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def runs(text: Column) -> Column:
    """The runs of letters of a text, A to Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(RUN), F.lit(0))


def damaged(run: Column, doc_id: Column) -> Column:
    """The run, without one code point where the checksum of document and run says so. A null id counts as empty text."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """word, n of the words with enough code points and occurrences. Null texts have none; rows that share an id count each."""
    found = docs.select(F.col(id_col).alias("i"), F.explode(runs(F.col(text_col))).alias("r")).filter(F.length("r") >= length)
    return found.select(damaged(F.col("r"), F.col("i")).alias("word")).filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def posts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word its number and the hashes of itself and of its distinct single deletions.

    A string's hash is the sum of mixed code points times powers of an odd number, modulo 2 ** 64; without place i it is the sum before i, and the sum behind i moved one place on.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    mixed = (code + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    first = np.cumsum(size) - size
    place = np.arange(len(code)) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, _BASE, np.uint64))
    value = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers[place])])  # sums wrap, so differences hold
    start, end = value[first], value[first + size]
    own = np.repeat(np.arange(len(texts)), size)
    drop = (value[:-1] - start[own]) + (end[own] - value[1:]) * np.uint64(_BACK)
    last = np.zeros(len(code), bool)
    last[1:] = (code[1:] == code[:-1]) & (own[1:] == own[:-1])  # of equal signs in a row any may go
    number, key = np.concatenate([np.arange(len(texts)), own[~last]]), np.concatenate([end - start, drop[~last]])
    return number, key.view(np.int64)


def _posted(table: DataFrame) -> DataFrame:
    """key, id: the posts of each word of a table (id, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                number, key = posts([w.decode() for w in as_bytes(batch.column(1))])
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(number))], ["key", "id"])

    return table.select("id", "word").mapInArrow(run, "key bigint, id bigint")


def _merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    return left.hint("merge").join(right.hint("merge"), on, how)


def near_words(table: DataFrame) -> DataFrame:
    """id, other: both directions of all pairs of words (id, word) exactly one edit apart."""
    posted = _posted(table)
    pairs = _merged(posted.select("key", F.col("id").alias("a")), posted.select("key", F.col("id").alias("b")), "key").filter("a < b").select("a", "b").distinct()
    x, y = table.select(F.col("id").alias("a"), F.col("word").alias("x")), table.select(F.col("id").alias("b"), F.col("word").alias("y"))
    near = materialize(_merged(_merged(pairs, x, "a"), y, "b").filter(F.levenshtein("x", "y", 1) == 1).select("a", "b"))
    return near.selectExpr("a AS id", "b AS other").unionByName(near.selectExpr("b AS id", "a AS other"))


def roots(forms: DataFrame) -> DataFrame:
    """id, root: the last word that forms (id, form), which never close a circle, lead to. Each join doubles the steps taken, so their number grows with the logarithm of the longest chain."""
    now = materialize(forms.select("id", F.coalesce("form", "id").alias("root")))
    while True:
        onward = now.filter("id <> root").select(F.col("id").alias("root"), F.col("root").alias("next"))  # only words that go on themselves
        after = materialize(_merged(now, onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("id", "root")
        if after.filter("moved").isEmpty():
            return now


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    A word's form is its near word of most occurrences (of equals the first in code-point order), if that has `ratio` times the word's own; else null.
    An empty table, or one of null texts, gives no word. Other columns of docs are left out.
    """
    table = stage_table(words(docs, id_col, text_col, length, least).withColumn("id", F.monotonically_increasing_id()))
    other = table.select(F.col("id").alias("other"), F.struct((-F.col("n")).alias("m"), "word", F.col("id").alias("id")).alias("o"))
    best = _merged(near_words(table), other, "other").groupBy("id").agg(F.count("*").alias("n_near"), F.min("o").alias("o"))
    told = _merged(table, best, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("o.m") >= ratio * F.col("n"), F.col("o")).alias("o"))
    told = stage_table(told.select("id", "word", "n", "n_near", F.col("o.word").alias("form"), F.col("o.id").alias("form_id"), (-F.col("o.m")).alias("form_n")))
    ends = roots(told.select("id", F.col("form_id").alias("form")))
    tops = _merged(ends.filter("id <> root"), told.select(F.col("id").alias("root"), F.col("word").alias("top")), "root").select("id", "top")
    return _merged(told, tops, "id", "left").select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")
