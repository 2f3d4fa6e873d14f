"""Byte-pair encoding of many words at once, for vocabularies of a word-level byte tokenizer.

The public tokenizer spends most of its time around the merges: offsets, regular
expressions, one object a token. A plain word (lower-case letters a to z and of Latin-1)
needs none of it: it is one unit whose adjacent symbols are merged, lowest rank first and
leftmost of equals, until no pair has a rank. Here all words of about equal length
make one step together. Any other chunk of text goes to the tokenizer unchanged.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import UnitCache

_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(2**31 - 1)
#: Bytes of a word up to which it is encoded in arrays, and words of one step.
LONGEST, BLOCK = 48, 16_384
#: A plain word and a closing stop or comma.
_PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+[.,]?$"
# The tokenizer's units, for letters of a plain word and other ASCII signs, and the parts of its file that the arrays rest on.
_UNITS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[^\x00-\x20a-zA-Z0-9\x7f-\xff]+")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 signs for themselves, the rest from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class WordBpe:
    """Ids (little-endian unsigned 32-bit) of plain words."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        ranks = {(vocab[a], vocab[b]): i for i, (a, b) in reversed(list(enumerate(pairs)))}
        keys = np.array([(a << 32) | b for a, b in ranks], np.uint64)
        rank = np.fromiter(ranks.values(), np.int32, len(ranks))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = max(10, int(2 * len(keys)).bit_length() + 2)
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, np.uint64(2**64 - 1)), np.full(size, _NONE, np.int32)
        at = self._slot(keys)
        self.probes, left = 0, np.arange(len(keys))
        while len(left):  # all that find their slot free settle, the rest move on by one
            self.probes += 1
            free = self.keys[at[left]] == np.uint64(2**64 - 1)
            took, first = np.unique(at[left][free], return_index=True)
            own = left[free][first]
            self.keys[took], self.ranks[took] = keys[own], rank[own]
            left = np.setdiff1d(left, own)
            at[left] = (at[left] + 1) & (size - 1)

        inner, last = (np.broadcast_to(x, (256, 256)) for x in (self.inner[:, None], self.last))
        self.first = [self._rank(inner.ravel(), x.ravel()).reshape(256, 256) for x in (np.broadcast_to(self.inner, (256, 256)), last)]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE for those that are never merged."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], _NONE)
        more = np.flatnonzero((held != key) & (held != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(more):
                break
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            held = self.keys[at[more]]
            hit = held == key[more]
            out[more[hit]] = self.ranks[at[more[hit]]]
            more = more[~hit & (held != np.uint64(2**64 - 1))]
        return out

    def encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words of 1 to LONGEST bytes in a buffer: all ids, and where each word's begin and how many there are."""
        at, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        flat, done = [], 0
        order = np.argsort(size, kind="stable")
        for part in np.array_split(order, -(-len(order) // BLOCK)) if len(order) else ():
            ids, n = self._merge(data, start[part], size[part])
            flat.append(ids)
            at[part], count[part] = done + np.cumsum(n) - n, n
            done += len(ids)
        return np.concatenate(flat) if flat else np.zeros(0, np.uint32), at, count

    def _merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = int(size.max())
        columns = np.arange(wide)
        raw = data[np.minimum(start[:, None] + columns, len(data) - 1)]
        rows = np.arange(len(size))
        sym = self.inner[raw]
        sym[rows, size - 1] = self.last[raw[rows, size - 1]]
        ranks = np.full(sym.shape, _NONE, np.int32)
        if wide > 1:
            ranks[:, :-1] = self.first[0][raw[:, :-1], raw[:, 1:]]
            pair = np.flatnonzero(size > 1)
            ranks[pair, size[pair] - 2] = self.first[1][raw[pair, size[pair] - 2], raw[pair, size[pair] - 1]]
            ranks[columns >= (size - 1)[:, None]] = _NONE
        length, done = size.copy(), np.zeros(sym.shape, np.uint32)
        while len(rows):
            at = ranks.argmin(axis=1)
            own = np.arange(len(rows))
            best = ranks[own, at]
            if (over := best == _NONE).any():
                done[rows[over], : sym.shape[1]] = sym[over]
                stay = ~over
                rows, sym, ranks, at, best = rows[stay], sym[stay], ranks[stay], at[stay], best[stay]
                own = own[: len(rows)]
                if not len(rows):
                    break
            length[rows] -= 1
            now = length[rows]
            sym[own, at] = self.made[best]
            keep = columns[: sym.shape[1]] != (at + 1)[:, None]  # each row loses the one symbol behind
            sym, ranks = sym[keep].reshape(len(rows), -1), ranks[keep].reshape(len(rows), -1)
            left, right = at > 0, at + 1 < now  # the pairs that the new symbol is in
            ranks[own, at] = _NONE
            ranks[own[left], at[left] - 1] = self._rank(sym[own[left], at[left] - 1], sym[own[left], at[left]])
            ranks[own[right], at[right]] = self._rank(sym[own[right], at[right]], sym[own[right], at[right] + 1])
        return done[columns < length[:, None]], length


class TextIds:
    """Ids of whole texts by a tokenizer's file. A text's ids are those of its chunks between ASCII white space in order, since no token goes over white space."""

    def __init__(self, tokenizer_file: str, library: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.bpe = None if library or not self._fits(spec) else WordBpe(spec)
        self.cache = UnitCache(lambda chunks: [self.ask(c) for c in chunks])

    @staticmethod
    def _fits(spec: dict) -> bool:
        """Whether the file is of the kind that the arrays follow; else the tokenizer encodes all."""
        model, parts = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        same = kinds == ["NFC", "Replace", "Lowercase"] and parts[0].get("pattern", {}).get("Regex") == _SPLIT and parts[-1].get("type") == "ByteLevel"
        return same and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges") and not parts[-1].get("add_prefix_space") and bool(model.get("end_of_word_suffix"))

    def ask(self, chunk: bytes) -> bytes:
        """A chunk's ids by the tokenizer itself. Case counts: the name of a special token is one only as it is written."""
        return np.array(self.tok.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def table(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of distinct chunks, and where each chunk's begin and how many there are."""
        if self.bpe is None:
            return _joined(self.cache.of(chunks.cast(pa.binary()).to_pylist()))
        plain = pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False)
        size = pc.binary_length(chunks).to_numpy().astype(np.int64)
        edges = np.frombuffer(chunks.buffers()[1], np.int32, len(chunks) + 1, 4 * chunks.offset).astype(np.int64)
        data = np.frombuffer(chunks.buffers()[2] or b"\0", np.uint8)
        start, stem = edges[:-1], size.copy()
        tail = np.zeros(len(size), np.uint8)
        some = np.flatnonzero(size)
        tail[some] = data[start[some] + size[some] - 1]
        closed = (tail == 46) | (tail == 44)
        stem[closed] -= 1
        plain &= (stem > 0) & (stem <= LONGEST)
        ids, at, count = self.bpe.encode(data, start[plain], stem[plain])
        out_at, out_n = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        # a closed word's ids and the sign's stand together
        mine = np.flatnonzero(plain)
        more = closed[mine].astype(np.int64)
        total = count + more
        begin = np.cumsum(total) - total
        flat = np.empty(int(total.sum()), np.uint32)
        flat[_spread(begin, count)] = ids[_spread(at, count)]
        flat[begin[more == 1] + count[more == 1]] = self.bpe.last[tail[mine[more == 1]]]
        out_at[mine], out_n[mine] = begin, total
        other = np.flatnonzero(~plain & (size > 0))
        if len(other):
            rest, rest_at, rest_n = _joined(self._units(chunks.take(pa.array(other)).cast(pa.binary()).to_pylist()))
            out_at[other], out_n[other] = len(flat) + rest_at, rest_n
            flat = np.concatenate([flat, rest])
        return flat, out_at, out_n

    def _units(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks that are no plain words: those of plain letters and ASCII signs are cut into the tokenizer's units here, the rest goes to it as it is."""
        parts = []
        for c in chunks:
            low = c.lower()
            units = [] if b"<|" in c else _UNITS.findall(low)
            parts.append(units if sum(map(len, units)) == len(low) and max(map(len, units), default=0) <= LONGEST else None)
        distinct = list({u for units in parts if units for u in units})
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        ids, at, count = self.bpe.encode(np.frombuffer(b"".join(distinct) or b"\0", np.uint8), np.cumsum(size) - size, size)
        known = {u: ids[a : a + n].tobytes() for u, a, n in zip(distinct, at.tolist(), count.tolist(), strict=True)}
        rest = iter(self.cache.of([c for c, units in zip(chunks, parts, strict=True) if units is None]))
        return [next(rest) if units is None else b"".join([known[u] for u in units]) for units in parts]

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, `end` behind each, and where each text's begin and end. A null text is an empty one."""
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        marked = pc.match_substring(texts, "<|")
        if pc.any(marked).as_py():  # may name special tokens, which have their case
            low = pc.if_else(marked, texts, low)
        lists = pc.ascii_split_whitespace(low)
        words = lists.flatten().dictionary_encode()
        flat, at, count = self.table(words.dictionary)
        flat = np.append(flat, np.uint32(end))
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
        code = np.insert(words.indices.to_numpy().astype(np.int64), edges[1:], len(at))
        at, count = np.append(at, len(flat) - 1), np.append(count, 1)
        n = count[code]
        held = np.concatenate([[0], np.cumsum(n)])
        return flat[_spread(at[code], n)], held[edges + np.arange(len(edges))]


def _spread(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places at[i], at[i] + 1 and so on, count[i] of each."""
    return np.repeat(at - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return np.frombuffer(b"".join(parts), "<u4"), np.cumsum(n) - n, n


_open: dict[str, TextIds] = {}


def text_ids(tokenizer_file: str) -> TextIds:
    """The worker's own, kept over batches and tasks."""
    if tokenizer_file not in _open:
        _open[tokenizer_file] = TextIds(tokenizer_file)
    return _open[tokenizer_file]
