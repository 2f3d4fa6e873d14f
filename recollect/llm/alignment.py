"""Alignment of two tokenizers over the same texts, and how often their tokens are linked in a corpus.

Both tokenizers' token ends are running sums of token lengths; the ends that both have cut a text into
groups, and every overlap of a token of A with one of B is a link. A text falls into units at spaces, where no
token of either goes on, so a worker aligns each distinct unit once, many units together in arrays, and a text
is what its units give in order. How many documents hold a linked pair is counted over the whole corpus in two
shuffles, the first salted. The most frequent pairs, a fixed number, go to every task; all others come back by a join.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitCache, bound_batches, materialize, slices, stage_table, tidy
from .word_bpe import _byte_letters, _joined, _spread

#: Pairs whose counts every task has at hand (17 bytes each), parts that a pair's rows are salted to, and bytes of units that a worker remembers.
HEAD, SALTS, MEMORY = 1 << 17, 16, 96 << 20
#: Units of one step of alignment, in bytes.
STEP = 2 << 20
# The first tokenizer's units, as its file names them by kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁".encode()


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(n.sum())), n


class ByteBpe:
    """Tokenizer A: byte-level byte-pair encoding from its JSON file. Names of special tokens are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        letters = {c: b for b, c in _byte_letters().items()}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {w: i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.bytes = [b""] * (max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
        for w, i in vocab.items():
            self.bytes[i] = bytes(map(letters.__getitem__, w))
        for w in special:
            self.bytes[spec["model"]["vocab"].get(w, -1)] = w.encode()
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        merges = ["".join(m.split(" ")) if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec["normalizer"] and not model.get("ignore_merges") and not model.get("dropout")
        rank = [vocab.get(m, -1) for m in merges]
        self.tik = None
        if plain and rank == sorted(rank) and rank[:1] != [-1] and len(vocab) == 256 + len(merges):  # ids rise as ranks do, so the faster library gives the same ids
            import tiktoken

            self.tik = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocab.values()}, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_str(text)
            self.tok.encode_special_tokens = True

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units in order, and how many each has. Units that no white space ends stand apart in one text as well, so they are encoded as one."""
        if self.tik is None:
            return _flat([e.ids for e in self.tok.encode_batch(units, add_special_tokens=False)])
        open_ = [k for k, u in enumerate(units) if u[-1].isspace()]
        own = {k: self.tik.encode_ordinary(units[k]) for k in open_}
        rest = [u for k, u in enumerate(units) if k not in own] if own else units
        ids = self.tik.encode_to_numpy("".join(rest)).astype(np.int64)
        ends = np.cumsum(np.fromiter((len(u.encode()) for u in rest), np.int64, len(rest)))
        n = np.diff(np.searchsorted(np.cumsum(self.size[ids]), ends, "right"), prepend=0)
        if not own:
            return ids, n
        whole, at = np.zeros(len(units), np.int64), np.setdiff1d(np.arange(len(units)), open_)
        whole[at] = n
        whole[open_] = [len(own[k]) for k in open_]
        first, out = np.cumsum(whole) - whole, np.empty(int(whole.sum()), np.int64)
        out[_spread(first[at], n)] = ids
        for k in open_:
            out[first[k] : first[k] + whole[k]] = own[k]
        return out, whole


class PieceBpe:
    """Tokenizer B: pieces with byte fallback. It puts a space in front by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.encode().replace(MARK, b" ") for i, p in enumerate(pieces)]
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.space = [self.sp.piece_to_id("▁")]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on over a space, so texts do not fall into units")

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As A's, of units with their space in front. A space alone is a piece too, though the library has no id for an empty text."""
        return _flat([x or self.space for x in self.sp.encode([u[1:] for u in units], num_threads=1)])


def unit_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units begin: at the texts' own beginnings `first` (each a space), and at each space that stands behind a sign that is no white space."""
    if not len(data):
        return first
    p1, p2, p3 = (np.concatenate([np.full(k, 32, np.uint8), data[:-k]])[: len(data)] for k in (1, 2, 3))
    blank = (p1 <= 32) | (p1 == 127) | (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 == 0xE1) & (p2 == 0x9A) | (p3 == 0xE2) & ((p2 == 0x80) | (p2 == 0x81)) | (p3 == 0xE3) & (p2 == 0x80)
    begin = (data == 32) & ~blank
    begin[first] = True
    return np.flatnonzero(begin)


def align(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common cuts, each token's group by A and by B, and the links as places of A tokens and of B tokens, in order. Both sides cover the same bytes."""
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    of_a, of_b = np.searchsorted(cuts, end_a, "left"), np.searchsorted(cuts, end_b, "left")
    low, high = np.searchsorted(end_b, end_a - len_a, "right"), np.searchsorted(end_b, end_a, "left")
    n = high - low + 1
    return cuts, of_a, of_b, np.repeat(np.arange(len(end_a)), n), _spread(low, n)


class Aligner:
    """Both tokenizers, and what a worker remembers of units: number of tokens of A and B, groups and links, the linked pairs as a * (B's pieces) + b, and the groups written out."""

    def __init__(self, file_a: str, file_b: str):
        self.a, self.b = ByteBpe(file_a), PieceBpe(file_b)
        self.size_a, self.size_b = self.a.size, self.b.size
        self.most = max(len(self.size_a), len(self.size_b))
        self.signs = pa.array([f"{i}{s}".encode() for s in ",|;" for i in range(self.most)], pa.large_binary())
        self.bits = (len(self.size_a) * len(self.size_b)).bit_length()
        self.cache = UnitCache(self.align_units, MEMORY)

    def align_units(self, units: list[bytes]) -> list[bytes]:
        out, at = [], 0
        size = np.cumsum([len(u) for u in units])
        while at < len(units):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + STEP, "right")))
            out += self._step(units[at:end])
            at = end
        return out

    def _step(self, units: list[bytes]) -> list[bytes]:
        """What is remembered of each unit, as bytes: five numbers (the last 1 if both sides have the unit's bytes), the pairs, the groups."""
        texts = [u.decode() for u in units]
        ids, n = map(list, zip(*(t.encode(texts) for t in (self.a, self.b)), strict=True))
        good = np.ones(len(units), bool)
        for side, ids_, n_ in zip((self.a, self.b), ids, n, strict=True):
            parts = [*map(side.bytes.__getitem__, ids_.tolist())]
            if b"".join(parts) != b"".join(units):
                edges = np.cumsum(n_).tolist()
                good &= [b"".join(parts[e - k : e]) == u for e, k, u in zip(edges, n_.tolist(), units, strict=True)]
        ok = np.flatnonzero(good)
        if len(ok) < len(units):
            ids = [x[np.repeat(good, k)] for x, k in zip(ids, n, strict=True)]
        _, of_a, of_b, link_a, link_b = align(self.size_a[ids[0]], self.size_b[ids[1]])
        unit_a, unit_b = np.repeat(ok, n[0][ok]), np.repeat(ok, n[1][ok])
        count = lambda of: np.bincount(of, minlength=len(units))
        last = np.ones(len(of_a), bool)
        last[:-1] = of_a[1:] != of_a[:-1]
        groups, links = count(unit_a[last]), count(unit_a[link_a])
        pairs = (ids[0][link_a] * len(self.size_b) + ids[1][link_b]).astype("<i8").tobytes()
        # a group's tokens of A, then those of B; the sign behind each says what comes next
        group = np.concatenate([of_a, of_b])
        order = np.argsort(group * 2 + np.repeat([0, 1], [len(of_a), len(of_b)]), kind="stable")
        every, side = np.concatenate(ids)[order], np.repeat([0, 1], [len(of_a), len(of_b)])[order]
        group = group[order]
        sign = np.full(len(every), 2)
        sign[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        written = self.signs.take(pa.array(sign * self.most + every))
        ends = np.frombuffer(written.buffers()[1], np.int64, len(written) + 1)
        data = (written.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        tokens = ends[np.cumsum(np.where(good, n[0] + n[1], 0))].tolist()
        made = (np.cumsum(links) * 8).tolist()
        head = np.stack([np.where(good, n[0], 0), np.where(good, n[1], 0), groups, links, good], axis=1).astype("<i4").tobytes()
        out, t, p = [], 0, 0
        for k, (te, pe) in enumerate(zip(tokens, made, strict=True)):
            out.append(head[20 * k : 20 * k + 20] + pairs[p:pe] + data[t:te])
            t, p = te, pe
        return out

    def texts(self, column: pa.Array) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups_sha256, and the distinct pairs with how many links each has, of each text."""
        texts = column.cast(pa.binary())
        some = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
        rows = len(column)
        data = np.frombuffer(b"".join(b" " + t for t in texts.take(pa.array(some)).to_pylist()) or b"", np.uint8)
        length = pc.binary_length(texts.take(pa.array(some))).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        first = np.cumsum(length) - length
        starts = unit_starts(data, first)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        code = units.indices.to_numpy().astype(np.int64)
        held = self.cache.of(units.dictionary.to_pylist())
        head = np.frombuffer(b"".join([x[:20] for x in held]), "<i4").reshape(-1, 5).astype(np.int64)
        flat, at, n = _joined64([x[20 : 20 + 8 * k] for x, k in zip(held, head[:, 3].tolist(), strict=True)])
        written = pa.array([x[20 + 8 * k : -1] for x, k in zip(held, head[:, 3].tolist(), strict=True)], pa.large_binary())
        edges = np.searchsorted(starts, np.append(first, len(data)))
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(head[code, :4], axis=0)])
        wrong = np.concatenate([[0], np.cumsum(head[code, 4] == 0)])
        good = (np.diff(wrong[edges]) == 0) if len(some) else np.zeros(0, bool)
        numbers = np.zeros((rows, 4), np.int64)
        numbers[some] = np.where(good[:, None], np.diff(sums[edges], axis=0), 0)
        digests = [""] * rows
        for k, (row, lo, hi) in enumerate(zip(some.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if good[k]:
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, hi - lo], pa.int64()), written.take(pa.array(code[lo:hi]))), pa.scalar(b";", pa.large_binary()))
                digests[row] = hashlib.sha256(joined[0].as_buffer()).hexdigest()
        # the distinct pairs of each good text
        valid = np.repeat(good, np.diff(edges))
        count = np.where(valid, n[code], 0)
        pair = flat[_spread(at[code], count)]
        of = np.repeat(np.repeat(some, np.diff(edges)), count)
        key = np.sort((of << self.bits) | pair)
        place = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(place, len(key)))
        key = key[place]
        lists = pa.array(np.searchsorted(key, np.arange(rows + 1) << self.bits), pa.int32())
        out = [pa.array(numbers[:, j]) for j in range(4)]
        return [*out, pa.array(digests, pa.string()), pa.ListArray.from_arrays(lists, pa.array(key & ((1 << self.bits) - 1))), pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))]


def _joined64(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, parts), np.int64, len(parts)) // 8
    return np.frombuffer(b"".join(parts), "<i8"), np.cumsum(n) - n, n


_open: dict[tuple[str, str], Aligner] = {}


def aligner(file_a: str, file_b: str) -> Aligner:
    """The worker's own, kept over batches and tasks."""
    if (file_a, file_b) not in _open:
        _open[file_a, file_b] = Aligner(file_a, file_b)
    return _open[file_a, file_b]


_NUMBERS = "n_a", "n_b", "n_groups", "n_links", "groups_sha256"


def aligned(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct linked pairs, rising), times (links of each) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(file_a, file_b)
        for whole in batches:
            for batch in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([batch.column(0), *own.texts(batch.column(1))], ["doc_id", *_NUMBERS, "pairs", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"
    return bound_batches(docs).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(tidy(run), schema)


def pair_counts(table: DataFrame, per_a: int, salts: int = SALTS) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of the same A token has more). Rows of `table` have row and pairs; per_a: B's pieces."""
    posted = table.select(F.explode("pairs").alias("pair"), F.pmod(F.xxhash64("row"), F.lit(salts)).alias("salt"))
    counts = posted.groupBy("pair", "salt").agg(F.count("*").alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialize(counts.select("pair", "n", F.expr(f"pair div {per_a}").alias("a")))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))  # at most B's pieces of a key
    return materialize(counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (rising), n and best of all pairs over a number of documents, the least power of two that leaves `most` pairs or fewer."""
    level = counts.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect()  # 64 rows at most
    least, held = 64, 0
    for r in level:
        held += r["count"]
        if held > most:
            break
        least = r["level"]
    rows = counts.filter(F.floor(F.log2("n")) >= least).orderBy("pair").toArrow() if least < 64 else None  # `most` rows at most
    if rows is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(rows.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))


def _weighed(table: DataFrame, head: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """row, doc_id and numbers with n_best and count_sum over the frequent pairs, and the other pairs with their times."""
    pair, n, best = head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
            own = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
            known = pair[at] == own if len(pair) else np.zeros(len(own), bool)
            gain = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])
            total, tops = (gain(np.where(known, times * n[at], 0)), gain(np.where(known & best[at], times, 0))) if len(pair) else (gain(times * 0),) * 2
            rest = pa.array(np.concatenate([[0], np.cumsum(~known)])[edges], pa.int32())
            left = [pa.ListArray.from_arrays(rest, pa.array(own[~known])), pa.ListArray.from_arrays(rest, pa.array(times[~known]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", *_NUMBERS)), pa.array(tops), pa.array(total), *left], ["row", "doc_id", *_NUMBERS, "n_best", "count_sum", "pairs", "times"])

    kind = table.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>"
    return table.select("row", "doc_id", *_NUMBERS, "pairs", "times").mapInArrow(run, schema)


def align_tokenizers(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; rows that share an id are documents of their own.

    Texts that are null, empty or not given back by both tokenizers have zeros and an empty groups_sha256. Other columns are left out.
    """
    table = stage_table(aligned(docs, file_a, file_b, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(table, len(PieceBpe(file_b).bytes))
    known = _weighed(table, frequent(counts, head))
    rest = known.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("t"))
    rest = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_b"), F.sum(F.col("t") * F.col("n")).alias("_s"))
    whole = known.join(rest, "row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_s", F.lit(0))).alias("count_sum"), "groups_sha256")
