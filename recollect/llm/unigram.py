"""Unigram tokenisation with a given piece vocabulary: encoding, decoding, and counts without ids.

Encoding is Viterbi over a double-array trie of pieces. Counting is the same dynamic
program over matches that an Aho-Corasick automaton enumerates; it carries the best score and
its number of pieces, and no path. Both follow the public tokenizer's ties: candidates of one
end are taken by ascending start and replace only what scores less, so the longest piece wins.

Text between spaces is a unit of its own, since no piece goes over a space; that is
checked when a vocabulary is loaded. Units are encoded in batches of arrays, one step for a
position in all units, and workers remember them.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnitCache, as_bytes, bound_batches, slices, tidy

MARK = "▁".encode()
#: Taken off the least score for a character that no piece covers, as in the public tokenizer.
UNKNOWN = 10.0
#: Bytes of a unit up to which array steps run over units together; longer ones are walked alone.
WIDE = 128

_UNIT = re.compile(rb" +[^ ]*|[^ ]+")
_CHAR = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)  # bytes of a character by its first byte


@dataclass
class Vocabulary:
    """Pieces with log scores (ids[i] is the id of piece i), and the ids of the 256 byte pieces."""

    pieces: list[bytes]
    scores: np.ndarray
    ids: np.ndarray
    byte_ids: np.ndarray
    unknown: float

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """From a sentencepiece model file with byte fallback. Its ranks become log scores by Zipf's law, in steps of 1/256, so that sums are exact."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        pieces = [sp.id_to_piece(i).encode() for i in normal]
        rank = np.array([min(-sp.get_score(i), n) for i in normal])
        return cls.of(pieces, -np.round(256 * np.log(rank + 2)) / 256, np.array(normal), byte_ids)

    @classmethod
    def of(cls, pieces: list[bytes], scores: np.ndarray, ids: np.ndarray, byte_ids: np.ndarray) -> Vocabulary:
        over = [p for p in pieces if MARK in re.sub(rb"^(?:%s)+" % MARK, b"", p)]
        if over:
            raise ValueError(f"pieces go over a space: {over[:3]}")
        return cls(pieces, np.asarray(scores, float), np.asarray(ids), byte_ids, float(np.min(scores)) - UNKNOWN)


def double_array(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check, value: from state s byte c leads to base[s] + c if check of that is s; value is a piece or -1. State 0 is the root."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for k, p in enumerate(pieces):
        node = 0
        for c in p:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][c]
        ends[node] = k
    room = 4 * len(children) + 1024
    base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    free = np.ones(room, bool)
    free[0] = False
    state = {0: 0}
    value[0] = ends[0]
    low = 1
    queue = [0]
    for node in queue:
        kids = sorted(children[node].items())
        if not kids:
            continue
        while np.count_nonzero(free[low : low + 1024]) < 32:  # nearly full: not searched again
            low += 1024
        first = kids[0][0]
        at = max(low, first + 1)
        while True:
            window = np.flatnonzero(free[at : at + 1024]) + at - first
            good = np.ones(len(window), bool)
            for c, _ in kids[1:]:
                good &= free[np.minimum(window + c, room - 1)]
            if good.any():
                b = int(window[good.argmax()])
                break
            at += 1024
        s = state[node]
        base[s] = b
        for c, kid in kids:
            free[b + c] = False
            check[b + c] = s
            value[b + c] = ends[kid]
            state[kid] = b + c
            queue.append(kid)
    top = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
    return base[:top], check[:top], value[:top]


class Encoder:
    """Units to ids (little-endian unsigned 32-bit), and ids to text."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.base, self.check, self.value = double_array(vocabulary.pieces)
        self.longest = max(map(len, vocabulary.pieces), default=0)
        self.texts = {int(i): p for i, p in zip(vocabulary.ids, vocabulary.pieces, strict=True)} | {int(i): bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}

    def walk(self, unit: bytes) -> tuple[list[int], int]:
        """Ids of one unit of any length, and their number."""
        n, v = len(unit), self.v
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.base, self.check, self.value, v.scores
        for s in range(n):
            if best[s] == -np.inf:
                continue
            state, size, single = 0, min(int(_CHAR[unit[s]]), n - s), False
            for e in range(s, n):
                t = int(base[state]) + unit[e]
                if check[t] != state:
                    break
                state = t
                k = int(value[t])
                if k >= 0:
                    single |= e + 1 - s == size
                    if best[s] + scores[k] > best[e + 1]:
                        best[e + 1], back[e + 1], piece[e + 1] = best[s] + scores[k], s, k
            if not single and best[s] + v.unknown > best[s + size]:
                best[s + size], back[s + size], piece[s + size] = best[s] + v.unknown, s, -1
        out: list[int] = []
        e = n
        while e:
            s = back[e]
            out += [int(v.ids[piece[e]])] if piece[e] >= 0 else [int(v.byte_ids[b]) for b in reversed(unit[s:e])]
            e = s
        return out[::-1], len(out)

    def encode_units(self, units: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(units)
        size = np.array([len(u) for u in units])
        for low, high in ((-1, 8), (8, 16), (16, 32), (32, WIDE)):
            of = np.flatnonzero((size > low) & (size <= high))
            if len(of):
                for i, ids in zip(of.tolist(), self._together([units[i] for i in of], size[of]), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(size > WIDE).tolist():
            out[i] = np.array(self.walk(units[i])[0], "<u4").tobytes()
        return out

    def _together(self, units: list[bytes], size: np.ndarray) -> list[bytes]:
        v, n, wide = self.v, len(units), int(size.max(initial=0))
        text = np.frombuffer(b"".join(u.ljust(wide + 1, b"\0") for u in units), np.uint8).reshape(n, wide + 1)
        best = np.full((n, wide + 5), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, wide + 5), np.int16), np.full((n, wide + 5), -1, np.int32)
        for s in range(wide):
            act = np.flatnonzero((size > s) & (best[:, s] > -np.inf))
            if not len(act):
                continue
            char = np.minimum(_CHAR[text[act, s]], size[act] - s)
            single = np.zeros(n, bool)
            width = np.zeros(n, np.int64)
            width[act] = char
            rows, state = act, np.zeros(len(act), np.int64)
            for k in range(min(self.longest, wide - s)):
                inside = size[rows] > s + k
                rows, state = rows[inside], state[inside]
                t = self.base[state] + text[rows, s + k].astype(np.int64)
                ok = self.check[t] == state
                rows, state = rows[ok], t[ok]
                if not len(rows):
                    break
                got = self.value[state]
                hit = got >= 0
                r, got = rows[hit], got[hit]
                single[r[width[r] == k + 1]] = True
                cand = best[r, s] + v.scores[got]
                up = cand > best[r, s + k + 1]
                r = r[up]
                best[r, s + k + 1], back[r, s + k + 1], piece[r, s + k + 1] = cand[up], s, got[up]
            lost = act[~single[act]]
            if len(lost):
                e = s + width[lost]
                cand = best[lost, s] + v.unknown
                up = cand > best[lost, e]
                lost, e = lost[up], e[up]
                best[lost, e], back[lost, e], piece[lost, e] = cand[up], s, -1
        at, steps, unknown = size.copy(), [], np.zeros(n, bool)
        every = np.arange(n)
        while at.any():
            got = np.where(at > 0, piece[every, at], -2)
            unknown |= got == -1
            steps.append(got)
            at = np.where(at > 0, back[every, at], 0)
        if not steps:
            return [b""] * n
        path = np.stack(steps[::-1], axis=1)
        ids = v.ids[path[path >= 0]].astype("<u4").tobytes()
        end = np.cumsum((path >= 0).sum(1)) * 4
        out = [ids[a:b] for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True)]
        for i in np.flatnonzero(unknown).tolist():
            out[i] = np.array(self.walk(units[i])[0], "<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids: pieces joined, markers as spaces, without the space put in front."""
        text = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist())).replace(MARK, b" ")
        return text[1:] if text[:1] == b" " else text


def units_of(text: bytes) -> list[bytes]:
    """The units of a text as keys: a space in front as the public tokenizer puts it, then every run of spaces with what follows. No unit for an empty text."""
    return _UNIT.findall(b" " + text) if text else []


def marked(unit: bytes) -> bytes:
    return unit.replace(b" ", MARK)


class Counter:
    """Numbers of pieces of units, without paths."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = vocabulary
        self.sizes = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(vocabulary.pieces):
            self.automaton.add_word(p.decode("latin-1"), k)
        self.automaton.make_automaton()

    def count_units(self, units: list[bytes]) -> list[int]:
        if not units:
            return []
        text = b"\0".join(units) + b"\0"
        size = np.array([len(u) for u in units], np.int64)
        first = np.cumsum(size + 1) - (size + 1)
        raw = np.frombuffer(text, np.uint8)
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        long = self.sizes[piece]
        start = end - long
        unit = np.repeat(np.arange(len(units)), size + 1)
        # characters that are no piece of their own
        head = np.flatnonzero((raw & 0xC0) != 0x80)
        head = head[head < first[unit[head]] + size[unit[head]]]
        width = np.minimum(_CHAR[raw[head]], first[unit[head]] + size[unit[head]] - head)
        covered = np.zeros(len(raw) + 1, bool)
        char = np.zeros(len(raw) + 1, np.int64)
        char[head] = width
        covered[start[char[start] == long]] = True
        lost = head[~covered[head]]
        score = np.concatenate([self.v.scores[piece], np.full(len(lost), self.v.unknown)])
        pieces = np.concatenate([np.ones(len(piece), np.int64), char[lost]])
        start, end = np.concatenate([start, lost]), np.concatenate([end, lost + char[lost]])
        place = end - first[unit[start]]
        order = np.argsort((place << 32) + end, kind="stable")  # the automaton gives longer pieces of one end first
        start, end, score, pieces, place = start[order], end[order], score[order], pieces[order], place[order]
        best, count = np.full(len(raw) + 1, -np.inf), np.zeros(len(raw) + 1, np.int64)
        best[first] = 0
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
        for lo, hi in itertools.pairwise(cuts.tolist()):
            if lo == hi:
                continue
            cand = best[start[lo:hi]] + score[lo:hi]
            e = end[lo:hi]
            run = np.concatenate([[0], np.flatnonzero(np.diff(e)) + 1])
            top = np.maximum.reduceat(cand, run)
            of = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(e))))
            wins = np.flatnonzero(cand == top[of])
            lead = wins[np.concatenate([[True], np.diff(of[wins]) > 0])]  # the first: the smallest start
            best[e[lead]], count[e[lead]] = cand[lead], count[start[lo:hi][lead]] + pieces[lo:hi][lead]
        return count[first + size].tolist()


_caches: dict[tuple[str, str], UnitCache] = {}
_encoders: dict[str, Encoder] = {}


def encoder(model_file: str) -> Encoder:
    if model_file not in _encoders:
        _encoders[model_file] = Encoder(Vocabulary.load(model_file))
    return _encoders[model_file]


def _cache(model_file: str, kind: str) -> UnitCache:
    if (model_file, kind) not in _caches:
        work = encoder(model_file).encode_units if kind == "ids" else Counter(Vocabulary.load(model_file)).count_units
        _caches[model_file, kind] = UnitCache(lambda units: work([marked(u) for u in units]), 128 << 20)
    return _caches[model_file, kind]


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of unsigned little-endian 32-bit ids), round_trip (decoding gives the text back) and, if asked, ids (array of int) of every row.

    Null and empty texts have no ids. A marker that is part of a text decodes as a space, as in the public tokenizer, and the round trip is held against that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, decode = _cache(model_file, "ids"), encoder(model_file).decode
        for whole in batches:
            for batch in slices(whole, 1):
                texts = as_bytes(batch.column(1))
                split = [units_of(t) for t in texts]
                known = cache.prepare(u for us in split for u in us)
                coded = [b"".join(map(known.__getitem__, us)) for us in split]
                columns = [batch.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array([decode(c) == t.replace(MARK, b" ") for c, t in zip(coded, texts, strict=True)], pa.bool_())]
                if ids:
                    edges = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(coded), "<i4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    return bound_batches(docs).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(tidy(run), f"doc_id {kind}, n_ids bigint, ids_crc32 bigint, round_trip boolean{', ids array<int>' if ids else ''}")


def decode(coded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of every row. Null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = encoder(model_file).decode
        for batch in batches:
            texts = [None if x is None else back(np.array(x, "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("i"), F.col(ids_col).alias("t")).mapInArrow(tidy(run), f"doc_id {kind}, text string")


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens of every row: as many as `encode` gives ids. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(model_file, "count")
        for whole in batches:
            for batch in slices(whole, 1):
                split = [units_of(t) for t in as_bytes(batch.column(1))]
                known = cache.prepare(u for us in split for u in us)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sum(map(known.__getitem__, us)) for us in split], pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bound_batches(docs).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(tidy(run), f"doc_id {kind}, n_tokens bigint")
