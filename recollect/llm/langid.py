"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of slots holds a bitmask of languages in each slot, so a lookup of an
n-gram answers for all languages at once: the masks of its slots, ANDed. Each language's
share of a text's n-grams, corrected for the filter's false positives, decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, fold_of, slices, tidy

N = 4
#: Labelled documents that each language's n-grams are learnt from, about: rows are taken by a hash of the id.
SAMPLE = 3000
#: An n-gram enters a language's filter if it makes up this share of the language's n-grams, and this part of its largest share in any language.
LEAST_SHARE, LEAST_PART = 2e-6, 0.25
SLOT_BITS, HASHES = 20, 2


def _grams(text: str) -> np.ndarray:
    """A 64-bit code for each n-gram of letters and single spaces of the lower-cased text."""
    cp = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
    table = _letters()
    cp = np.where(table[np.minimum(cp, len(table) - 1)], cp, np.uint32(32))
    keep = np.empty(len(cp), bool)
    if len(cp):
        keep[0] = True
        keep[1:] = (cp[1:] != 32) | (cp[:-1] != 32)
    cp = np.concatenate([[32], cp[keep], [32]]).astype(np.uint64)
    if len(cp) < N:
        return np.empty(0, np.uint64)
    code = np.zeros(len(cp) - N + 1, np.uint64)
    for i in range(N):
        code = (code + cp[i : len(cp) - N + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


_letter_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters; the last entry stands for none."""
    global _letter_table
    if _letter_table is None:
        _letter_table = np.fromiter((i < 0x110000 and chr(i).isalpha() for i in range(0x110001)), bool, 0x110001)
    return _letter_table


def _slots(code: np.ndarray, k: int) -> np.ndarray:
    mixed = (code ^ np.uint64(0xD6E8FEB86659FD93 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((mixed ^ (mixed >> np.uint64(32))) >> np.uint64(64 - SLOT_BITS - 12)) & np.uint64((1 << SLOT_BITS) - 1)


@dataclass
class LanguageFilter:
    languages: list[str]
    table: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray  # of each language

    @classmethod
    def of_bits(cls, bits: Iterable[tuple[str, np.ndarray]], names: list[str]) -> LanguageFilter:
        """From pairs of a language and slots that its n-grams have; a language may come several times. The masks are as wide as there are names."""
        place = {name: i for i, name in enumerate(names)}
        table = np.zeros((1 << SLOT_BITS, max(1, -(-len(names) // 64))), np.uint64)
        for name, slots in bits:
            table[slots, place[name] // 64] |= np.uint64(1 << (place[name] % 64))
        fill = np.array([((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])
        return cls(names, table, fill**HASHES)

    @classmethod
    def build(cls, grams: dict[str, np.ndarray]) -> LanguageFilter:
        return cls.of_bits(((name, _slots(codes, k)) for name, codes in grams.items() for k in range(HASHES)), sorted(grams))

    def counts(self, code: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter holds."""
        mask = self.table[_slots(code, 0)]
        for k in range(1, HASHES):
            mask = mask & self.table[_slots(code, k)]
        if len(self.languages) <= 32:
            return np.array([np.count_nonzero(mask[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(self.languages))], float)
        total = np.zeros(64 * mask.shape[1])
        for at in range(0, len(mask), 4096):
            total += np.unpackbits(mask[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8 * mask.shape[1]), axis=1, bitorder="little").sum(axis=0)
        return total[: len(self.languages)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the largest corrected count and its part of all; `und` without a letter. Ties go to the first name, also where no language holds any n-gram: then each has the same part."""
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return "und", 0.0
        code = _grams(text)
        held = np.clip((self.counts(code) - len(code) * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, None)
        if not held.sum():
            return self.languages[0], 1 / len(self.languages)
        best = int(held.argmax())
        return self.languages[best], float(held[best] / held.sum())


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> LanguageFilter:
    """Learn from rows with text and language; of each language about `sample` rows, by a hash of the id, all if it has fewer.

    All languages are learnt, and the masks are as wide as there are. An n-gram that a language has once counts like any other: what enters a filter is decided by its
    share of the language's text alone. Tables with a row for each language are broadcast, as the filter is, which has as many. The filters' bits are set on
    the executors, and come to the driver as bitmaps of a fixed size for each language.
    """
    rows = train.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    sizes = rows.groupBy("l").agg(F.count("*").alias("rows"))
    share = F.least(F.lit(1.0), sample / F.col("rows"))
    taken = rows.join(F.broadcast(sizes), "l").filter(F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < share * (1 << 20)).select("l", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1, 8 << 20):
                by: dict[str, list[np.ndarray]] = {}
                for name, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                    by.setdefault(name, []).append(_grams(raw.decode("utf-8", "replace")))
                for name, codes in by.items():
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n.astype(np.int64))], ["l", "g", "n"])

    grams = taken.mapInArrow(tidy(run), "l string, g bigint, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n"))
    length = taken.groupBy("l").agg(F.greatest(F.sum(F.length("t")), F.lit(1)).alias("length"))
    parts = grams.join(F.broadcast(length), "l").select("g", "l", (F.col("n") / F.col("length")).alias("p")).filter(F.col("p") >= LEAST_SHARE)
    kept = parts.join(parts.groupBy("g").agg(F.max("p").alias("top")), "g").filter(F.col("p") >= LEAST_PART * F.col("top")).select("l", "g")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(1).to_numpy().view(np.uint64)
            for k in range(HASHES):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_slots(code, k).astype(np.int64))], ["l", "slot"])

    slots = kept.mapInArrow(placed, "l string, slot bigint").withColumn("slot", F.col("slot") + 1)  # buckets count from one
    bitmaps = slots.groupBy("l", F.expr("bitmap_bucket_number(slot)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    names = sorted(r.l for r in sizes.select("l").collect())

    def bits() -> Iterator[tuple[str, np.ndarray]]:
        for r in bitmaps.toLocalIterator():
            own = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
            yield r.l, np.flatnonzero(own) + (r.n - 1) * len(own)

    return LanguageFilter.of_bits(bits(), names)


def identify(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's part of all corrected counts) of every row. A null or letterless text is `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by SLOT_BITS and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for batch in slices(whole, 2):
                said = [m.predict(raw.decode("utf-8", "replace")) for raw in as_bytes(batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in said], pa.string()), pa.array([min(1.0, x) for _, x in said], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = bound_batches(docs).select(F.col(id_col).alias("doc_id"), (fold_of(F.col(id_col)) == 1).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
