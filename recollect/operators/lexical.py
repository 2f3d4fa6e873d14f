"""Text search over a stored index with positions and fields, which follows its documents.

The index is a folder of immutable segments. A segment holds its documents, their postings in blocks, and by how much
it changes each term's document frequency; rows of `gone` end documents of earlier segments. A change writes a segment
of its own size, a manifest names the segments that hold, and a merge makes one of all.

A block is the postings of one term in one range of documents (about BLOCK of like length), with bounds on their
impact. So a term of most documents is many blocks, in as many tasks. The blocks that queries ask for meet by range: there phrases are told by
their places, and all queries score the range's documents as a matrix, of which a task hands on its best k of each query. So a posting is
shuffled once, however many queries ask for it. A search for the best k of few postings sums the bounds by range and scores the
most promising ranges; the k-th score found there is a floor for ranges, for terms that propose documents, and for the documents proposed.

Queries come as a table of match strings: quoted phrases joined by OR, each of which counts on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.functions.analysis import ANALYSERS
from recollect.sources.store import new_path, stored

K1, B = 1.2, 0.75
#: The weight of terms that half of the documents or more hold.
LEAST_IDF = 1e-6
#: Documents of a range, about, and ranges of a query that are scored first.
BLOCK, FIRST = 128, 4
#: How many times the ranges must outnumber the documents asked for, before bounds are looked at; with fewer, all hits are scored.
SPARSE = 4
#: Postings, counted for each query that asks, up to which bounds are looked at: each is a row there.
PAIRS = 2_000_000
#: Rows that a task holds before it cuts them to the best k, tokens of a task that makes blocks, and how far scores may differ that count as equal.
HELD, TOKENS, EQUAL = 1_000_000, 4_000_000, 2e-9
#: Documents that a task turns into postings at once.
ROWS = 256
_SEGMENT = 1 << 40


def analysed(texts: Column, analyser: str) -> Column:
    """The terms of a text, as an array. A null text has none."""
    run = ANALYSERS[analyser]

    @F.pandas_udf("array<string>")
    def terms(column: pd.Series) -> pd.Series:
        return column.map(lambda t: run(t) if t else [])

    return terms(texts)


def units_of(queries: DataFrame, analyser: str, query_id: str, match: str) -> DataFrame:
    """query_id, unit, key and terms of every phrase of the match strings; phrases without a term are none."""
    quoted = F.regexp_extract_all(F.col(match), F.lit(r'"((?:[^"]|"")*)"'), F.lit(1))
    units = queries.select(F.col(query_id).alias("query_id"), F.posexplode(quoted).alias("unit", "phrase"))
    units = units.withColumn("terms", analysed(F.regexp_replace("phrase", '""', '"'), analyser)).filter(F.size("terms") > 0)
    return units.select("query_id", "unit", F.array_join("terms", " ").alias("key"), "terms")


def gain(tf: Column, dl: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average or 1.0)))


@dataclass(frozen=True)
class State:
    """What a manifest says: its version, the segments that hold, live documents and their terms."""

    version: int
    segments: list[int]
    documents: int
    tokens: int


class TextIndex:
    """An index in a folder that driver and executors share. Documents have a unique id (bigint) and text fields; null fields are empty."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[str], analyser: str = "stemmed"):
        self.spark, self.folder, self.fields, self.analyser = spark, folder, fields, analyser

    @classmethod
    def create(cls, docs: DataFrame, fields: list[str], analyser: str = "stemmed", doc_id: str = "id", folder: str | None = None) -> TextIndex:
        index = cls(docs.sparkSession, folder or new_path(docs.sparkSession, "text-index"), fields, analyser)
        index._commit(State(0, [], 0, 0))
        index.apply(docs, doc_id=doc_id)
        return index

    # what is stored

    def state(self) -> State:
        rows = self.spark.read.schema("segments array<bigint>, documents bigint, tokens bigint, version bigint").parquet(f"{self.folder}/manifest")
        r = rows.orderBy(F.desc("version")).first()
        return State(r.version, [*r.segments], r.documents, r.tokens)

    def _commit(self, s: State) -> None:
        row = self.spark.createDataFrame([(s.segments, s.documents, s.tokens)], "segments array<bigint>, documents bigint, tokens bigint")
        row.coalesce(1).write.parquet(f"{self.folder}/manifest/version={s.version}")

    def _table(self, name: str, segments: list[int], schema: str) -> DataFrame:
        """The rows of the segments; a segment's own folder is read and no other."""
        if not segments:
            return self.spark.createDataFrame([], f"{schema}, segment bigint")
        paths = [f"{self.folder}/{name}/segment={s}" for s in segments]
        return self.spark.read.schema(f"{schema}, segment bigint").option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def _docs(self, s: State) -> DataFrame:
        return self._table("docs", s.segments, "id bigint, dl bigint, digest bigint, terms array<string>, range bigint")

    def _blocks(self, s: State) -> DataFrame:
        posts = "array<struct<id:bigint,dl:bigint,tf:array<int>>>"
        return self._table("blocks", s.segments, f"term string, range bigint, n bigint, most array<int>, least_dl bigint, posts {posts}, places array<array<array<int>>>")

    def _gone(self, s: State) -> DataFrame:
        return self._table("gone", s.segments, "id bigint").select("id", F.col("segment").alias("until"))

    def _live(self, rows: DataFrame, s: State, segment: Column) -> DataFrame:
        """The rows whose document no later segment has ended. With one segment there is nothing to end."""
        if len(s.segments) < 2:
            return rows
        last = self._gone(s).groupBy("id").agg(F.max("until").alias("until"))
        return rows.withColumn("_s", segment).join(last.withColumnRenamed("id", "_id"), (F.col("id") == F.col("_id")) & (F.col("until") > F.col("_s")), "left_anti").drop("_s")

    def documents(self, s: State | None = None) -> DataFrame:
        """id, dl, digest and terms of the live documents."""
        s = s or self.state()
        return self._live(self._docs(s), s, F.col("segment"))

    # changes

    def _read(self, docs: DataFrame, doc_id: str) -> DataFrame:
        """id, digest, dl, and each term with its number and places by field. One pass of Python over the texts."""
        run, count = ANALYSERS[self.analyser], len(self.fields)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
                number: dict[str, int] = {}
                codes, size = [], []
                for texts in zip(*(batch.column(2 + f).to_pylist() for f in range(count)), strict=True):
                    for text in texts:
                        before = len(codes)
                        codes += [number.setdefault(term, len(number)) for term in (run(text) if text else ())]
                        size.append(len(codes) - before)
                per_field = np.array(size, np.int64)
                field = np.repeat(np.arange(len(size)), per_field)  # of all documents' fields
                place = np.arange(len(codes)) - np.repeat(np.cumsum(per_field) - per_field, per_field)
                term = (field // count) * max(len(number), 1) + np.array(codes, np.int64)
                order = np.lexsort((field, term))  # stable, so places rise
                held, at = np.unique(term, return_inverse=True)
                tfs = np.bincount(at * count + field % count, minlength=len(held) * count)
                doc = np.bincount(held // max(len(number), 1), minlength=batch.num_rows)
                words = pa.array([*number], pa.string()).take(pa.array(held % max(len(number), 1)))
                each = np.full(len(held), count)
                columns = [pa.array(per_field.reshape(-1, count).sum(1)), lists(doc, words), lists(doc, lists(each, pa.array(tfs, pa.int32()))), lists(doc, lists(each, lists(tfs, pa.array(place[order], pa.int32()))))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "digest", "dl", "terms", "tfs", "places"])

        source = docs.select(F.col(doc_id).cast("bigint").alias("id"), self._digest(), *[F.coalesce(F.col(f), F.lit("")).alias(f"_f{k}") for k, f in enumerate(self.fields)])
        return source.mapInArrow(read, "id bigint, digest bigint, dl bigint, terms array<string>, tfs array<array<int>>, places array<array<array<int>>>")

    def _digest(self) -> Column:
        return F.xxhash64(*[F.coalesce(F.col(f), F.lit("")) for f in self.fields]).alias("digest")

    def _write(self, segment: int, docs: DataFrame) -> None:
        """docs, a stored table: id, dl, digest, terms, tfs, places. Documents meet by range in one shuffle, and become blocks there."""
        path = lambda name: f"{self.folder}/{name}/segment={segment}"
        docs = docs.withColumn("like", F.floor(4 * F.log2(F.col("dl") + 1)))  # documents of like length: at most some 250 kinds
        shares = docs.groupBy("like").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        dealt = docs.join(F.broadcast(shares), "like").withColumn("range", F.lit(segment) * _SEGMENT + F.col("like") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("parts")))
        dealt.select("id", "dl", "digest", "terms", "range").write.parquet(path("docs"))
        tasks = (docs.agg(F.sum("dl")).first()[0] or 0) // TOKENS + 1
        near = dealt.select("range", "id", "dl", "terms", "tfs", "places").repartition(tasks, "range")
        each = near.select("range", "id", "dl", F.explode(F.arrays_zip("terms", "tfs", "places")).alias("x")).select("range", F.col("x.terms").alias("term"), "id", "dl", F.col("x.tfs").alias("tf"), F.col("x.places").alias("places"))
        most = F.array(*[F.max(F.get("tf", F.lit(f))) for f in range(len(self.fields))])
        row = F.struct(F.struct("id", "dl", "tf").alias("post"), "places")
        blocks = each.groupBy("range", "term").agg(F.count("*").alias("n"), most.alias("most"), F.min("dl").alias("least_dl"), F.collect_list(row).alias("r"))  # BLOCK documents, about
        blocks.select("term", "range", "n", "most", "least_dl", F.col("r.post").alias("posts"), F.col("r.places").alias("places")).write.parquet(path("blocks"))

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None, doc_id: str = "id") -> None:
        """Adds or replaces the documents `changed` and ends the ids `deleted` (column id), as one new segment. It writes what the change holds and no more."""
        s = self.state()
        segment = max(s.segments, default=0) + 1
        if changed is None:
            changed = self.spark.createDataFrame([], ", ".join(["id bigint", *(f"{f} string" for f in self.fields)]))
            doc_id = "id"
        new = stored(self._read(changed, doc_id), "texts")
        ids = new.select("id") if deleted is None else new.select("id").unionByName(deleted.select(F.col("id").cast("bigint")))
        old = self.documents(s).join(ids.distinct(), "id", "left_semi").select("id", "dl", "terms")
        old = stored(old, "ended") if s.segments else old.limit(0)
        old.select("id").write.parquet(f"{self.folder}/gone/segment={segment}")
        each = new.select(F.explode("terms").alias("term"), F.lit(1).alias("one")).unionByName(old.select(F.explode("terms").alias("term"), F.lit(-1).alias("one")))
        each.groupBy("term").agg(F.sum("one").alias("df")).filter("df <> 0").write.parquet(f"{self.folder}/dfs/segment={segment}")
        self._write(segment, new)
        total = lambda d: d.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        (more, added), (less, ended) = total(new), total(old)
        self._commit(State(s.version + 1, [*s.segments, segment], s.documents + more - less, s.tokens + added - ended))

    def sync(self, docs: DataFrame, doc_id: str = "id") -> tuple[int, int]:
        """Makes the index that of `docs`: digests tell which documents are new, changed or gone. Gives how many changed and how many ended."""
        held = self.documents().select("id", F.col("digest").alias("_d"))
        now = docs.withColumn("id", F.col(doc_id).cast("bigint")).select("id", *self.fields, self._digest())
        changed = stored(now.join(held, "id", "left").filter(F.col("_d").isNull() | (F.col("_d") != F.col("digest"))).select("id", *self.fields), "changed")
        deleted = stored(held.join(now.select("id"), "id", "left_anti").select("id"), "deleted")
        counts = changed.count(), deleted.count()
        if any(counts):
            self.apply(changed, deleted)
        return counts

    def merge(self) -> None:
        """One segment in place of all, without what is gone. Earlier segments stay for searches that have begun."""
        s = self.state()
        segment = max(s.segments, default=0) + 1
        posts = self._blocks(s).select("term", "range", F.explode(F.arrays_zip("posts", "places")).alias("x")).select("term", F.col("range"), F.col("x.posts.id").alias("id"), F.col("x.posts.tf").alias("tf"), F.col("x.places").alias("places"))
        held = self._live(posts, s, F.expr(f"range div {_SEGMENT}")).groupBy("id").agg(F.collect_list(F.struct("term", "tf", "places")).alias("x"))
        docs = self.documents(s).select("id", "dl", "digest").join(held, "id", "left")
        part = lambda name, kind: F.coalesce(F.col(f"x.{name}"), F.array().cast(kind)).alias(f"{name}s".replace("placess", "places"))
        self._write(segment, stored(docs.select("id", "dl", "digest", part("term", "array<string>"), part("tf", "array<array<int>>"), part("places", "array<array<array<int>>>")), "merged"))
        self.spark.createDataFrame([], "id bigint").write.parquet(f"{self.folder}/gone/segment={segment}")
        self._table("dfs", s.segments, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0").write.parquet(f"{self.folder}/dfs/segment={segment}")
        self._commit(State(s.version + 1, [segment], s.documents, s.tokens))

    # search

    def _phrases(self, s: State, units: DataFrame, dfs: DataFrame, weights: list[float]) -> DataFrame:
        """key, range, id, dl and tf of the documents that hold a phrase of two terms or more: the blocks of its terms meet by range."""
        long = units.filter(F.size("terms") > 1).select("key", "terms").distinct()
        terms = long.select("key", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term")).join(dfs.select("term"), "term")
        whole = terms.groupBy("key").agg(F.count("*").alias("known"), F.first("length").alias("length")).filter("known = length").select("key")
        uses = stored(terms.join(whole, "key").groupBy("term").agg(F.collect_list("key").alias("keys"), F.collect_list("offset").alias("offsets"), F.collect_list("length").alias("lengths")), "uses")
        near = self._blocks(s).join(uses, "term").select("range", F.col("posts.id").alias("ids"), F.col("posts.dl").alias("dls"), "places", "keys", "offsets", "lengths")
        found = near.repartition("range").sortWithinPartitions("range").mapInArrow(_phrase_matcher(weights), "key string, range bigint, id bigint, dl bigint, tf double")
        return stored(self._live(found, s, F.expr(f"range div {_SEGMENT}")), "phrases")

    def _ready(self, queries: DataFrame, weights: list[float] | None, query_id: str, match: str) -> tuple[State, DataFrame, DataFrame, list[float], int]:
        """The state, single terms (query_id, term, idf), phrase hits (query_id, range, id, part), and for how many postings the single terms ask."""
        s, weights = self.state(), weights or [1.0] * len(self.fields)
        average = s.tokens / s.documents if s.documents else 1.0
        idf = lambda df: F.greatest(F.log((s.documents - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        units = stored(units_of(queries, self.analyser, query_id, match), "units")
        wanted = units.select(F.explode("terms").alias("term")).distinct()
        dfs = stored(self._table("dfs", s.segments, "term string, df bigint").join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0"), "frequencies")
        single = units.filter(F.size("terms") == 1).select("query_id", F.col("key").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")).join(dfs, "term")
        single = stored(single.select("query_id", "term", "df", (F.col("times") * idf(F.col("df"))).alias("idf")), "terms")
        pairs = single.agg(F.sum("df")).first()[0] or 0
        hits = self._phrases(s, units, dfs, weights)
        held = hits.groupBy("key").agg(F.count("*").alias("df"))
        asked = units.filter(F.size("terms") > 1).groupBy("query_id", "key").agg(F.count("*").alias("times"))
        phrase = hits.join(held, "key").join(asked, "key").select("query_id", "range", "id", (F.col("times") * idf(F.col("df")) * gain(F.col("tf"), F.col("dl"), average)).alias("part"))
        return s, single.drop("df"), phrase, weights, pairs

    def _scored(self, s: State, single: DataFrame, phrase: DataFrame, weights: list[float], k: int | None, among: DataFrame | None) -> DataFrame:
        """query_id, id and score of the hits; with k at least each query's k best, by each task's own. `among` as for `search`."""
        kind = single.schema["query_id"].dataType.simpleString()
        average = s.tokens / s.documents if s.documents else 1.0
        none = {"ids": "array<bigint>", "x": "array<double>", "asks": f"array<{kind}>", "w": "array<double>"}
        side = lambda d, n, **given: d.select("range", F.lit(n).alias("kind"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in none.items()])
        asks = stored(single.groupBy("term").agg(F.collect_list("query_id").alias("asks"), F.collect_list("idf").alias("w")), "asks")
        posts = F.transform("posts", lambda p: gain(_weighed(p["tf"], weights), p["dl"], average))
        rows = side(self._blocks(s).join(asks, "term"), 0, ids=F.col("posts.id"), x=posts, asks=F.col("asks"), w=F.col("w"))
        spoken = phrase.groupBy("query_id", "range").agg(F.collect_list("id").alias("ids"), F.collect_list("part").alias("x"))  # documents of a range at most, for each phrase
        rows = rows.unionByName(side(spoken, 1, ids=F.col("ids"), x=F.col("x"), asks=F.array("query_id")))
        if among is not None:
            value = F.col("value").cast("double") if "value" in among.columns else F.lit(None).cast("double")
            of = among.select(F.col("id").cast("bigint").alias("id"), value.alias("v")).groupBy("id").agg(F.max("v").alias("v")).join(self._docs(s).select("id", "range"), "id")
            rows = rows.unionByName(side(of.groupBy("range").agg(F.collect_list(F.struct("id", F.coalesce("v", F.lit(0.0)).alias("v"))).alias("r")), 2, ids=F.col("r.id"), x=F.col("r.v")))
        if len(s.segments) > 1:
            ended = self._docs(s).select("id", "range").join(self._live(self._docs(s), s, F.col("segment")).select("id", "range"), ["id", "range"], "left_anti")
            rows = rows.unionByName(side(ended.groupBy("range").agg(F.collect_list("id").alias("ids")), 3, ids=F.col("ids")))
        run = _matrix_scorer(k, among is not None, among is not None and "value" in among.columns)
        return rows.repartition("range").sortWithinPartitions("range").mapInArrow(run, f"query_id {kind}, id bigint, bm25 double")

    def _parts(self, s: State, single: DataFrame, phrase: DataFrame, weights: list[float], picked: DataFrame) -> DataFrame:
        """query_id, range, id and score of the documents in the picked ranges (query_id, range), by these terms and phrases."""
        blocks = self._blocks(s).select("term", "range", "posts")
        rows = single.join(picked, "query_id").join(blocks, ["term", "range"])
        phrase = phrase.join(picked, ["query_id", "range"], "left_semi")
        rows = rows.select("query_id", "idf", "range", F.explode("posts").alias("p")).select("query_id", "range", F.col("p.id").alias("id"), self._part(s, weights, F.col("idf")).alias("part"))
        rows = self._live(rows, s, F.expr(f"range div {_SEGMENT}"))
        return rows.unionByName(phrase.select("query_id", "range", "id", "part")).groupBy("query_id", "range", "id").agg(F.sum("part").alias("part"))

    def _part(self, s: State, weights: list[float], idf: Column) -> Column:
        return idf * gain(_weighed("p.tf", weights), F.col("p.dl"), s.tokens / s.documents if s.documents else 1.0)

    def _candidates(self, s: State, single: DataFrame, phrase: DataFrame, weights: list[float], k: int) -> tuple[DataFrame, DataFrame]:
        """Documents that can be among a query's k best, with their score so far, and the terms (query_id, term, idf) that it lacks.

        The k-th score in the most promising ranges is a floor. A range whose bounds sum to less is left out. The terms of least bounds that together stay
        below the floor bring nobody in, so only the others propose; and of those proposed, documents that the rest cannot lift to the floor go.
        """
        average = s.tokens / s.documents if s.documents else 1.0
        bound = F.col("idf") * gain(_weighed("most", weights), F.col("least_dl"), average)
        bounds = stored(self._blocks(s).select("term", "range", "most", "least_dl").join(single, "term").select("query_id", "term", "idf", "range", bound.alias("b")), "bounds")
        spoken = phrase.groupBy("query_id", "range", "id").agg(F.sum("part").alias("b")).groupBy("query_id", "range").agg(F.max("b").alias("b"))
        ranges = bounds.select("query_id", "range", "b").unionByName(spoken).groupBy("query_id", "range").agg(F.sum("b").alias("b"))
        first = ranges.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("b"), "range"))).filter(F.col("r") <= FIRST).select("query_id", "range")
        best = self._parts(s, single, phrase, weights, first).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "id"))).filter(F.col("r") <= k)
        floor = stored(best.groupBy("query_id").agg((F.when(F.count("*") >= k, F.min("part")).otherwise(0.0) - 1e-7).alias("floor")), "floors")
        terms = bounds.groupBy("query_id", "term", "idf").agg(F.max("b").alias("b")).join(floor, "query_id")  # a query's own terms
        upto = F.sum("b").over(Window.partitionBy("query_id").orderBy("b", "term").rowsBetween(Window.unboundedPreceding, 0))
        terms = stored(terms.withColumn("upto", upto).select("query_id", "term", "idf", "upto", (F.col("upto") >= F.col("floor")).alias("proposes")), "terms")
        picked = ranges.join(floor, "query_id").filter(F.col("b") >= F.col("floor")).select("query_id", "range")
        found = self._parts(s, terms.filter("proposes").select("query_id", "term", "idf"), phrase, weights, picked)
        lacking = terms.filter("NOT proposes")
        most = lacking.groupBy("query_id").agg(F.max("upto").alias("rest"))
        found = found.join(floor, "query_id").join(most, "query_id", "left").filter(F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.col("floor"))
        return stored(found.select("query_id", "range", "id", "part"), "candidates"), lacking.select("query_id", "term", "idf")

    def _opened(self, s: State, found: DataFrame, lacking: DataFrame) -> DataFrame:
        """The blocks that the candidates need yet: query_id, idf, n, posts, and the candidates' ids (of one range)."""
        ids = found.groupBy("query_id", "range").agg(F.collect_list("id").alias("ids"))  # documents of a range at most
        return lacking.join(ids, "query_id").join(self._blocks(s).select("term", "range", "n", "posts"), ["term", "range"])

    def search(self, queries: DataFrame, k: int | None = None, weights: list[float] | None = None, query_id: str = "query_id", match: str = "match", among: DataFrame | None = None) -> DataFrame:
        """query_id, id, bm25 (larger is better) of documents that hold any phrase of a query: all of them, or at least each query's k best with their ties. A query of no terms has no rows.

        `among` (id, and value or not) restricts what is given to these documents; with a value, the best are those of the largest value."""
        s, single, phrase, weights, pairs = self._ready(queries, weights, query_id, match)
        if k is None or among is not None or pairs > PAIRS or s.documents <= SPARSE * k * BLOCK:  # the best may well be in every range
            return self._scored(s, single, phrase, weights, k, among).withColumnRenamed("query_id", query_id)
        found, lacking = self._candidates(s, single, phrase, weights, k)
        more = self._opened(s, found, lacking).select("query_id", "range", "idf", "ids", F.explode("posts").alias("p")).filter(F.array_contains("ids", F.col("p.id")))
        parts = found.unionByName(more.select("query_id", "range", F.col("p.id").alias("id"), self._part(s, weights, F.col("idf")).alias("part")))
        return parts.groupBy("query_id", "id").agg(F.sum("part").alias("bm25")).withColumnRenamed("query_id", query_id)

    def share_read(self, queries: DataFrame, k: int, query_id: str = "query_id", match: str = "match") -> float:
        """The part of the queries' postings that stand in blocks which a search for the best k opens, those of the first ranges left aside."""
        s, single, phrase, weights, _ = self._ready(queries, None, query_id, match)
        blocks = self._blocks(s).select("term", "range", "n")
        whole = blocks.join(single, "term").agg(F.sum("n")).first()[0] or 1
        found, lacking = self._candidates(s, single, phrase, weights, k)
        later = self._opened(s, found, lacking).agg(F.sum("n")).first()[0] or 0
        proposing = single.join(lacking, ["query_id", "term"], "left_anti").join(blocks, "term").agg(F.sum("n")).first()[0] or 0
        return (later + proposing) / whole


def _weighed(tf: str | Column, weights: list[float]) -> Column:
    """The weighted sum over a posting's fields."""
    out = F.lit(0.0)
    for f, w in enumerate(weights):
        out = out + w * F.get(tf, F.lit(f))
    return out


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Each range with its rows, of a table in order of its first column, the range."""
    of, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        ranges = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and ranges[a] != of:
                yield of, held
                held = []
            of = int(ranges[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield of, held


def lists(size: np.ndarray, values: pa.Array) -> pa.Array:
    """A column of lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), values)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each row's begin; one place more for the end."""
    column = batch.column(name)
    size = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])


def _phrase_matcher(weights: list[float]):
    """A batch function: of each range's blocks, the documents in which all terms of a phrase stand in their places. Places are numbers of document, field and place, so a phrase is an intersection."""
    fields, weight = len(weights), np.array(weights)

    def places(column: pa.Array, docs: np.ndarray) -> np.ndarray:
        by_field = column.flatten().flatten()
        size = pc.list_value_length(by_field).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.repeat((docs[:, None] * fields + np.arange(fields)).ravel() << 32, size) + by_field.flatten().to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, rows in _by_range(batches):
            asked: dict[tuple[str, int], dict[int, tuple[int, int]]] = {}
            for j, batch in enumerate(rows):
                for r, (keys, offsets, lengths) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("keys", "offsets", "lengths")), strict=True)):
                    for key, offset, length in zip(keys, offsets, lengths, strict=True):
                        asked.setdefault((key, length), {})[offset] = j, r
            asked = {key: at for key, at in asked.items() if len(at) == key[1]}
            if not asked:
                continue
            ids = np.concatenate([_lists(b, "ids")[0] for b in rows])
            known, first = np.unique(ids, return_index=True)
            dls = np.concatenate([_lists(b, "dls")[0] for b in rows])[first]
            held: dict[tuple[int, int], np.ndarray] = {}
            out: list[tuple] = []
            for (key, _), at in asked.items():
                for j, r in at.values():
                    if (j, r) not in held:
                        one = rows[j].slice(r, 1)
                        held[j, r] = places(one.column("places"), np.searchsorted(known, _lists(one, "ids")[0]))
                starts = None
                for offset, place in sorted(at.items(), key=lambda x: len(held[x[1]])):
                    codes = held[place]
                    codes = codes[(codes & 0xFFFFFFFF) >= offset] - offset
                    starts = codes if starts is None else np.intersect1d(starts, codes, assume_unique=True)
                    if not len(starts):
                        break
                if len(starts):
                    lists = starts >> 32
                    tf = np.bincount(lists // fields, weight[lists % fields], len(known))
                    found = np.unique(lists // fields)
                    out.append((key, found, tf[found]))
            if out:
                number = np.repeat(np.arange(len(out)), [len(x[1]) for x in out])
                docs = np.concatenate([x[1] for x in out])
                columns = [pa.array([x[0] for x in out]).take(pa.array(number)), pa.array(np.full(len(docs), of)), pa.array(known[docs]), pa.array(dls[docs]), pa.array(np.concatenate([x[2] for x in out]))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "range", "id", "dl", "tf"])

    return run


class Best:
    """Each query's k best of the rows that a task has seen, and their ties; all of them where k is None. Rows are columns: queries, ids, scores, and what they are ordered by."""

    def __init__(self, k: int | None, margin: float):
        self.k, self.margin, self.floors, self.held, self.size = k, margin, {}, [], 0

    def floor(self, names: np.ndarray) -> np.ndarray:
        """What a row of each query must reach."""
        return np.array([self.floors.get(n, -np.inf) for n in names.tolist()])

    def add(self, rows: tuple) -> list[tuple]:
        """Takes rows; what it gives goes on at once."""
        if self.k is None:
            return [rows]
        self.held.append(rows)
        self.size += len(rows[0])
        if self.size <= HELD:
            return []
        self.held = [self._cut()]
        self.size = len(self.held[0][0])
        if 2 * self.size <= HELD:
            return []
        out, self.held, self.size = self.held, [], 0
        return out

    def rest(self) -> list[tuple]:
        return [self._cut()] if self.held else []

    def _cut(self) -> tuple:
        q, ids, scores, by = (np.concatenate(x) for x in zip(*self.held, strict=True))
        names, number = np.unique(q, return_inverse=True)
        order = np.lexsort((-by, number))
        begin = np.searchsorted(number[order], np.arange(len(names)))
        count = np.diff([*begin, len(order)])
        floor = np.where(count >= self.k, by[order[np.minimum(begin + self.k, len(order)) - 1]], -np.inf) - self.margin
        self.floors.update(zip(names.tolist(), floor.tolist(), strict=True))
        keep = by >= floor[number]
        return q[keep], ids[keep], scores[keep], by[keep]


def _matrix_scorer(k: int | None, restricted: bool, valued: bool):
    """A batch function: of each range's rows the scores of its documents by query, as a matrix. With k a task gives each query's k best and their ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, 0.0 if valued else EQUAL)

        def given(rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[0], schema_type), pa.array(rows[1]), pa.array(rows[2])], ["query_id", "id", "bm25"])

        for _, rows in _by_range(batches):
            schema_type = rows[0].schema.field("asks").type.value_type
            flat = [(*_lists(b, "ids"), _lists(b, "x")[0], *_lists(b, "asks"), *_lists(b, "w"), b.column("kind").to_numpy()) for b in rows]
            asks = [f[3] for f in flat if len(f[3])]
            if not asks:
                continue
            known, names = np.unique(np.concatenate([f[0] for f in flat])), np.unique(np.concatenate(asks))
            scores, hit = np.zeros((len(names), len(known))), np.zeros((len(names), len(known)), bool)
            allowed, by = np.full(len(known), not restricted), np.zeros(len(known))
            ended = np.zeros(len(known), bool)
            for ids, at, x, of, asked, w, weighed, kinds in flat:
                docs, queries = np.searchsorted(known, ids), np.searchsorted(names, of)
                valued_at = np.concatenate([[0], np.cumsum(np.where(kinds == 3, 0, np.diff(at)))])  # ended ids have no values
                for r, kind in enumerate(kinds.tolist()):
                    d, v = docs[at[r] : at[r + 1]], x[valued_at[r] : valued_at[r + 1]]
                    if kind == 0:
                        cells = queries[asked[r] : asked[r + 1], None], d
                        scores[cells] += w[weighed[r] : weighed[r + 1], None] * v
                        hit[cells] = True
                    elif kind == 1:  # several phrases of a query may be in one document
                        one = queries[asked[r]]
                        np.add.at(scores[one], d, v)
                        hit[one, d] = True
                    elif kind == 2:
                        allowed[d], by[d] = True, v
                    else:
                        ended[d] = True
            hit &= allowed & ~ended
            if k is not None:
                hit &= (by[None, :] if valued else scores) >= best.floor(names)[:, None]
            q, d = np.nonzero(hit)
            if not len(q):
                continue
            new = names[q], known[d], scores[q, d], by[d] if valued else scores[q, d]
            yield from map(given, best.add(new))
        yield from map(given, best.rest())

    return run
