"""Toxicity scores of texts whose disguises are undone by a noisy-channel model.

The channel writes letters as look-alike signs, puts signs or spaces between them and
repeats them. A token that may be so disguised is a lattice of characters; Viterbi decoding under
a character trigram model of the corpus picks its reading. A noisy-or over a
lexicon, learnt from labelled rows, scores the restored words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_batches, fold_of, slices, tidy

#: Labelled rows, by a hash of the id, that the lexicon is learnt from at most.
SAMPLE = 12_000
#: Toxic texts, not yet explained by a better word, that a word of the lexicon must be in.
SUPPORT = 3
#: Part of the texts with the word that must be toxic.
PRECISION = 0.8
#: Chance that a lexicon learnt from unrelated labels has any word by the test of significance.
CHANCE = 0.01
#: Lengths of word beginnings that may stand for all words with them.
STEMS = (4, 5, 6)
#: Letters of the longest word that a lexicon takes.
LONGEST = 64
THRESHOLD = 0.7
#: Tokens whose readings a task remembers, about; that only saves work.
REMEMBERED = 100_000
#: Part of the corpus's trigrams that each word of the lexicon counts for in the character model.
WORD_SHARE = 1e-3

# The letters that signs stand for.
SIGNS = {"4": "a", "@": "a", "^": "a", "8": "b", "(": "c", "<": "c", "3": "e", "€": "e", "6": "g", "9": "g", "#": "h", "1": "il", "!": "il", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}
#: Costs (negative log probabilities) of the channel: a sign for a letter, a sign put in, a sign that ends a word, more of a letter; and what a sign that looks like a letter costs besides if it is none.
SWAP, INSERTED, BREAK, REPEAT, NO_LETTER = 0.8, 0.7, 0.5, 0.3, 2.5

_SYMBOLS = 27
_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_RUN = re.compile(r"(.)\1{2,}", re.S)
_EDGE = ".,;:!?\"'()[]{}«»¿¡*#%&$+-_=~"


def _fold_table() -> np.ndarray:
    """Latin-1 bytes to 0 (no letter) or 1 to 26."""
    import unicodedata

    table = np.zeros(256, np.int32)
    for i in range(256):
        c = unicodedata.normalize("NFD", chr(i).lower())[0]
        if "a" <= c <= "z":
            table[i] = ord(c) - 96
    return table


_FOLD = _fold_table()


def symbol(c: str) -> int:
    i = ord(c)
    return int(_FOLD[i]) if i < 256 else 0


@dataclass
class Model:
    counts: np.ndarray  # of trigrams in the corpus, 27 x 27 x 27
    lexicon: dict[str, float] = field(default_factory=dict)  # word: probability that it makes a text toxic
    leak: float = 0.0  # probability that a text without such words is toxic

    def __post_init__(self) -> None:
        """-log P(c | a, b), with add-half smoothing. The lexicon's words, rare in any corpus, count WORD_SHARE of it each, so that their disguises can be read."""
        table = self.counts + 0.5
        for word in self.lexicon:
            if word[-1] == "*":
                continue
            s = [0, 0, *(symbol(c) for c in word), 0]
            for a, b, c in zip(s, s[1:], s[2:], strict=False):
                table[a, b, c] += WORD_SHARE * float(self.counts.sum())
        self.trigrams = -np.log(table / table.sum(axis=2, keepdims=True))

    def decode(self, token: str) -> str:
        """The likeliest reading of a lower-cased token: letters and spaces."""
        token = _RUN.sub(lambda m: m[1] * 3, token)
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        i = 0
        while i < len(token):
            c = token[i]
            if c.isalpha():
                if token[i : i + 3] == c * 3:
                    options, i = [(c, REPEAT), (c + c, REPEAT)], i + 3
                else:
                    options, i = [(c, 0.0)], i + 1
            else:
                looks = SIGNS.get(c, "")
                more = NO_LETTER if looks else 0.0
                options, i = [("", INSERTED + more), (" ", BREAK + more), *((x, SWAP) for x in looks)], i + 1
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in beam.items():
                for text, price in options:
                    x, y, total = a, b, cost + price
                    for ch in text:
                        z = symbol(ch)
                        if z or y:  # a second space is none
                            total += float(self.trigrams[x, y, z])
                            x, y = y, z
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, (path, text) if text else path)
            beam = after
        end = min(beam, key=lambda s: beam[s][0] + (float(self.trigrams[s[0], s[1], 0]) if s[1] else 0.0))
        parts, link = [], beam[end][1]
        while link is not None:
            link, part = link
            parts.append(part)
        return re.sub(" +", " ", "".join(reversed(parts))).strip()

    def words_of(self, token: str) -> list[str]:
        """The words that a lower-cased token may stand for."""
        bare = token.strip(_EDGE)
        if bare.isalpha() and not _RUN.search(bare):
            if bare == token.strip(".,;:\"'()[]{}") or not any(c in SIGNS for c in token):
                return [bare]
        return [*_WORD.findall(token), *self.decode(token).split()]

    def restored(self, text: str, known: dict[str, list[str]] | None = None) -> set[str]:
        """The words of a text, after restoring: distinct tokens, and single characters that spaces part."""
        low = text.lower()
        words: set[str] = set()
        known = {} if known is None else known
        for token in set(low.split()):
            got = known.get(token)
            if got is None:
                got = self.words_of(token)
                if len(token) <= 40:
                    known[token] = got
            words.update(got)
        for m in _SPACED.finditer(low):
            words.update(self.decode(m[0]).split())
        return words

    def known_by(self, word: str) -> list[str]:
        """The entries of the lexicon that a word meets: itself, beginnings, which end in a star, and those that need a second word, which end in two."""
        mine = forms(word)
        return [f for f in [*mine, *(f + "*" for f in mine[1:])] if f in self.lexicon]

    def score(self, text: str | None, known: dict[str, tuple[tuple[str, str], ...]] | None = None) -> float:
        hits = self.hits(text or "", {} if known is None else known)
        miss = 1 - self.leak
        for w in hits:
            miss *= 1 - self.lexicon[w]
        return min(1.0, max(0.0, 1 - miss))

    def hits(self, text: str, known: dict[str, tuple[tuple[str, str], ...]]) -> set[str]:
        low = text.lower()
        found: dict[str, set[str]] = {}
        for token in set(low.split()):
            got = known.get(token)
            if got is None:
                got = tuple({(f, w) for w in self.words_of(token) for f in self.known_by(w)})
                if len(token) <= 40:
                    known[token] = got
            for f, w in got:
                found.setdefault(f, set()).add(w)
        for m in _SPACED.finditer(low):
            for w in self.decode(m[0]).split():
                for f in self.known_by(w):
                    found.setdefault(f, set()).add(w)
        return {f for f, words in found.items() if len(words) > 1 or f[-2:] != "**"}


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of trigrams over a to z (accents dropped) and the space, from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for whole in batches:
            for batch in slices(whole, 0, 1 << 20):
                text = " ".join(x.decode("utf-8", "replace") for x in as_bytes(batch.column(0))).lower()
                s = _FOLD[np.frombuffer(f"  {text} ".encode("latin-1", "replace"), np.uint8)]
                keep = np.ones(len(s), bool)
                keep[2:] = (s[2:] != 0) | (s[1:-1] != 0)
                s = s[keep]
                total += np.bincount((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:], minlength=_SYMBOLS**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["c", "n"])

    counts = bound_batches(docs).select(F.col(text_col).alias("t")).mapInArrow(tidy(run), "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    table = np.zeros(_SYMBOLS**3)
    for r in counts.collect():  # at most 27 cubed rows
        table[r.c] += r.n
    return table.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)


def forms(word: str) -> list[str]:
    """A word and its beginnings, which end in a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def doubled(words: set[str]) -> list[str]:
    """The beginnings that two or more of the words share, which end in two stars."""
    count = Counter(f for w in words for f in forms(w)[1:])
    return [f + "*" for f, n in count.items() if n > 1]


def significant(bad: int, good: int, rate: float, words: int) -> bool:
    """Whether a word is toxic more often than `rate` explains, by the Chernoff bound, among so many words."""
    n = bad + good
    p = min(bad / n, 1 - 1e-12)
    if p <= rate:
        return False
    gain = p * math.log(p / rate) + (1 - p) * math.log((1 - p) / (1 - rate))
    return n * gain >= math.log(max(words, 1) / CHANCE)


def learn_lexicon(rows: list[list[str]], bad: dict[str, int], good: dict[str, int], rate: float, words: int, kin: dict[str, int] | None = None, support: int = SUPPORT, precision: float = PRECISION) -> dict[str, float]:
    """Entries with the probability that they make a text toxic, from the forms in each toxic text.

    bad and good count families of texts, so copies and near copies count little. Significant words join at once: among all words, or, with a beginning that is
    itself significant, among the words that share it (kin: how many do). Then the form in most
    texts not yet explained joins, and explains them, so what merely stands beside other words stays out. Ties go to the shorter, then the first.
    """
    fit = {w for w in bad if bad[w] >= precision * (bad[w] + good.get(w, 0))}
    kin = kin or {}
    among = lambda w: min([words, *(kin[f] for f in forms(w)[1:] if f in kin)])
    sure = {w for w in fit if w[-1] != "*" and significant(bad[w], good.get(w, 0), rate, among(w))}
    holders: dict[str, set[int]] = defaultdict(set)
    for i, ws in enumerate(rows):
        if not sure.intersection(ws):
            for w in fit.intersection(ws):
                holders[w].add(i)
    chosen = sorted(sure)
    while holders:
        word = min(holders, key=lambda w: (-len(holders[w]), len(w), w))
        covered = holders.pop(word)
        if len(covered) < support:
            break
        chosen.append(word)
        for w in list(holders):
            holders[w] -= covered
            if len(holders[w]) < support:
                del holders[w]
    return {w: (bad[w] + 0.5) / (bad[w] + good.get(w, 0) + 1) for w in chosen}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Character model from all texts of docs; lexicon from at most `sample` labelled rows of the folds 0 and 2.

    Null labels and ids do not teach; of several labels of one id, or of equal texts, the largest counts; equal texts count once.
    """
    model = Model(character_model(docs, text_col))
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).filter("i IS NOT NULL AND y IS NOT NULL").filter(fold_of(F.col("i")) != 1)
    known = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample)
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(known), "i")  # `sample` rows at most
    texts = texts.groupBy(F.sha2(F.col("t").cast("binary"), 256).alias("h")).agg(F.max("y").alias("y"), F.min("t").alias("t")).select("y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[str]] = {}
        for whole in batches:
            for batch in slices(whole, 1, 1 << 18):
                if len(seen) > REMEMBERED:
                    seen.clear()
                words = [model.restored(x.decode("utf-8", "replace"), seen) for x in as_bytes(batch.column(1))]
                family = [min((zlib.crc32(w.encode()) for w in ws), default=0) for ws in words]
                shown = [sorted({f for w in ws for f in forms(w)}.union(doubled(ws))) for ws in words]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(family, pa.int64()), pa.array(shown, pa.list_(pa.string()))], ["y", "f", "w"])

    bags = texts.mapInArrow(tidy(run), "y bigint, f bigint, w array<string>").persist()
    families = bags.select("y", "f", F.explode("w").alias("w")).distinct()  # near copies mostly share their word of least hash
    families = families.filter(F.length("w") <= LONGEST)
    counts = families.groupBy("w").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good")).filter("bad > 0").persist()
    words = counts.filter(~F.col("w").endswith("*")).count()
    n = bags.groupBy("y").agg(F.count_distinct("f").alias("n")).collect()
    toxic, clean = (sum(r.n for r in n if r.y == y) for y in (1, 0))
    likely = counts.filter((F.col("bad") >= SUPPORT) & (F.col("bad") >= PRECISION * (F.col("bad") + F.col("good"))))
    kept = likely.collect()  # bounded by the sample, and in bytes by LONGEST
    rate = max(toxic, 1) / max(toxic + clean, 1)
    starts = counts.filter(F.col("w").endswith("*") & ~F.col("w").endswith("**"))
    begun = F.array(*[F.when(F.length("w") > n, F.concat(F.substring("w", 1, n), F.lit("*"))) for n in STEMS])
    shared = counts.filter(~F.col("w").endswith("*")).select(F.explode(F.array_compact(begun)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    number = starts.count()
    kin = {r.w: r.n for r in starts.filter(F.col("bad") >= SUPPORT).join(shared, "w").collect() if significant(r.bad, r.good, rate, number)}
    bad, good = {r.w: r.bad for r in kept}, {r.w: r.good for r in kept}
    known_forms = docs.sparkSession.createDataFrame([(w,) for w in bad], "w string")
    numbered = bags.filter("y = 1").withColumn("i", F.monotonically_increasing_id())
    mine = numbered.select("i", F.explode("w").alias("w")).join(F.broadcast(known_forms), "w", "left_semi")  # bounded by the sample
    rows = [r.w for r in mine.groupBy("i").agg(F.collect_list("w").alias("w")).collect()]
    model = Model(model.counts, learn_lexicon(rows, bad, good, rate, words, kin))
    inside = F.size(F.array_intersect("w", F.array(*[F.lit(w) for w in model.lexicon]).cast("array<string>"))) > 0
    rest = bags.filter(~inside).agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("bad")).first()
    model.leak = min(0.5, (rest.bad + 0.5) / (rest.n + 1))
    bags.unpersist()
    counts.unpersist()
    return model


def score_rows(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, below: float | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) and `_score`; with `below`, only rows whose score is less, and no score. A null text counts as empty."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by `sample`
    kept = [docs.schema[c] for c in keep]
    names = [f"c{i}" for i in range(len(keep))]
    at = keep.index(text_col) if text_col in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known: dict[str, tuple[tuple[str, str], ...]] = {}
        for whole in batches:
            for batch in slices(whole, at, 1 << 20):
                if len(known) > REMEMBERED:
                    known.clear()
                scores = pa.array([m.score(x.decode("utf-8", "replace"), known) for x in as_bytes(batch.column(at))], pa.float64())
                out = pa.RecordBatch.from_arrays([*batch.columns[: len(names)], scores], [*names, "_score"])
                if below is not None:
                    out = out.filter(pa.array(np.asarray(scores) < below))
                yield out

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept, strict=True))
    rows = bound_batches(docs).select(*[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)], *([] if at < len(keep) else [F.col(text_col).alias("t")]))
    out = rows.mapInArrow(tidy(run), f"{schema}{', ' if schema else ''}_score double")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *(["_score"] if below is None else []))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = score_rows(rows, model, "text", ["doc_id"])
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, whatever their names."""
    return score_rows(docs, fit(docs, labels), below=threshold)
