"""Token ids of whole texts, with the tokenizers library, at the cost of one encoding per distinct piece.

A tokenizer's own pre-tokenizer cuts a text into pieces that it encodes one by one. For the two pre-tokenizers known
here the same cuts are found in numpy, each distinct piece is encoded once, and a bounded cache of the worker keeps its
ids. A text with a character whose class the byte tables don't settle is encoded by the library as a whole, and so is
every text of a tokenizer of another kind.

The cache is a hash table in numpy: a block's pieces are looked up together, and adding some doesn't touch the others.
A piece that nothing normalises or cuts again goes straight to the library's model.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import _MASK, BLOCK, U, blocks, lanes, ragged, range_hashes, text_buffers

_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[np.r_[65:91, 97:123, 128:256]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
#: First bytes of two-byte characters that are letters but for U+00D7 and U+00F7.
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xCA] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[28:32] = True
#: The character by which byte-level models name each byte: itself if printable, else the next one from U+0100 on.
_PRINTED = np.zeros(256, bool)
_PRINTED[np.r_[33:127, 161:173, 174:256]] = True
_NAME = np.where(_PRINTED, np.arange(256), 255 + np.cumsum(~_PRINTED)).astype("<u2")
CACHE = 1_000_000


class Encoder:
    """Encodes batches of texts; one per worker and tokenizer file."""

    _made: dict[str, "Encoder"] = {}

    @classmethod
    def get(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        self.kind = ""
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal:
            self.kind = "spaced"
        elif pre.get("type") == "Sequence" and [x["type"] for x in pre["pretokenizers"]] == ["Split", "ByteLevel"] and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in str(pre["pretokenizers"][0]["pattern"].get("Regex")) and pre["pretokenizers"][0]["invert"] and not pre["pretokenizers"][1]["add_prefix_space"]:
            self.kind = "dropped"
        self.model = self.tokenizer.model if self.kind == "spaced" and all(t["special"] for t in spec.get("added_tokens") or []) else None
        self._reset()

    def _reset(self) -> None:
        self.count = 0
        self.table = np.zeros(1 << 12, np.int32)  # by key modulo its length, or the next place: 1 + the entry; 0 if free
        self.entry = np.zeros((1 << 10, 4), np.uint64)  # key, first eight bytes, last eight, start in ids << 32 | number of ids
        self.size = np.zeros(1 << 10, np.uint8)  # 17 for all that are longer
        self.long: dict[int, bytes] = {}  # the bytes of longer pieces, by entry
        self.ids, self.used = np.zeros(1 << 12, np.uint32), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _cuts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of a block."""
        n = len(data)
        kind = _CLASS[data]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        prev = np.zeros(n, np.uint8)
        prev[1:] = kind[:-1]
        space = kind == _SPACE
        cut = first[:n] | (kind != prev)
        if self.kind == "dropped":
            cut |= kind == _DIGIT
        # an apostrophe may begin a contraction: the library cuts such a word itself
        if (data == 39).any():
            word = first[:n] | (space != (prev == _SPACE))
            begin = np.flatnonzero(word)
            has = np.maximum.reduceat((data == 39).astype(np.uint8), begin).astype(bool)
            inside = np.repeat(has, np.diff(np.append(begin, n)))
            cut &= ~inside | word
        last = first[1:].copy()  # the last byte of a text
        if self.kind == "spaced":
            # of a run of spaces before a word the last one stands alone, and a blank joins the word
            nxt = np.zeros(n, np.uint8)
            nxt[:-1] = kind[1:]
            final = space & (nxt != _SPACE) & ~last
            cut |= final
            joins = final & (data == 32)
            after = np.flatnonzero(joins) + 1
            cut[after] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        if self.kind == "dropped":
            keep = ~space[start]
            start, end = start[keep], end[keep]
        return start, end

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each)."""
        data, offs = text_buffers(column)
        if not self.kind:
            return self._join(self._whole(["" if x is None else x for x in column.to_pylist()]))
        got = [self._block(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], column, lo) for lo, hi in blocks(offs, BLOCK)]
        if not got:
            return self._join([])
        return np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])

    def _block(self, d: np.ndarray, o: np.ndarray, column: pa.Array, lo: int) -> tuple[np.ndarray, np.ndarray]:
        """`encode` for some rows of the column, from row lo on."""
        n = len(o) - 1
        if not len(d):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        high = d >= 0x80
        bad = _CONTROL[d]
        if high.any():
            lead, tail = _LEAD[d], _TAIL[d]
            ok = np.zeros(len(d), bool)
            ok[:-1] = lead[:-1] & tail[1:]
            times = np.zeros(len(d), bool)
            times[:-1] = (d[:-1] == 0xC3) & ((d[1:] == 0x97) | (d[1:] == 0xB7))
            ok &= ~times
            ok[1:] |= ok[:-1] & tail[1:]
            bad |= high & ~ok
        odd = np.zeros(n, bool)
        if bad.any():
            c = np.zeros(len(d) + 1, np.int64)
            np.cumsum(bad, out=c[1:])
            odd = c[o[1:]] > c[o[:-1]]
        start, end = self._cuts(d, o)
        pieces = np.diff(np.searchsorted(start, o))
        if odd.any():
            good = np.repeat(~odd, pieces)
            start, end, pieces = start[good], end[good], np.where(odd, 0, pieces)
        at, length, false = self._find(d, start, end)
        if false.any():
            odd[np.repeat(np.arange(n), pieces)[false]] = True
        ids = self.ids[ragged(at, length)]
        ends = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        edges = np.zeros(n + 1, np.int64)
        edges[1:] = ends[np.cumsum(pieces)]
        if not odd.any():
            return ids, np.diff(edges)
        whole = np.flatnonzero(odd)
        extra = dict(zip(whole.tolist(), self._whole(["" if x is None else x for x in column.take(pa.array(whole + lo)).to_pylist()]), strict=True))
        return self._join([extra[i] if i in extra else ids[edges[i] : edges[i + 1]] for i in range(n)])

    def _find(self, d: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each piece where its ids begin in `ids`, their number, and whether they are those of another piece of its key."""
        size = end - start
        key = range_hashes(d, start, end, 5)
        eight, few = lanes(d), np.minimum(size, 8)
        head, tail, short = eight[start] & _MASK[few], eight[end - few] & _MASK[few], np.minimum(size, 17).astype(np.uint8)
        slot = self._lookup(key)
        new = np.flatnonzero(slot < 0)
        if len(new):
            found, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            if self.count and (self.count + len(found) > CACHE or self.used > 16 * CACHE):
                self._reset()
                new = np.arange(len(key))
                found, first, back = np.unique(key, return_index=True, return_inverse=True)
            slot[new] = self.count + back
            first = new[first]
            self._add(found, head[first], tail[first], short[first], d, start[first], size[first])
        have = self.entry.take(slot, axis=0)
        false = (have[:, 1] != head) | (have[:, 2] != tail) | (self.size[slot] != short)
        for i in np.flatnonzero((size > 16) & ~false):
            false[i] = self.long[int(slot[i])] != d[start[i] : end[i]].tobytes()
        return (have[:, 3] >> U(32)).astype(np.int64), (have[:, 3] & _MASK[4]).astype(np.int64), false

    def _lookup(self, key: np.ndarray) -> np.ndarray:
        """The entry of each key; -1 where there is none."""
        last = len(self.table) - 1
        place = (key & U(last)).astype(np.int64)
        slot = self.table[place].astype(np.int64) - 1
        todo = np.flatnonzero((slot >= 0) & (self.entry[slot, 0] != key))
        while len(todo):
            place[todo] = (place[todo] + 1) & last
            slot[todo] = s = self.table[place[todo]].astype(np.int64) - 1
            todo = todo[(s >= 0) & (self.entry[s, 0] != key[todo])]
        return slot

    def _place(self, key: np.ndarray, slot: np.ndarray) -> None:
        """Enter keys that the table lacks."""
        last = len(self.table) - 1
        place, value = (key & U(last)).astype(np.int64), (slot + 1).astype(np.int32)
        while len(place):
            free = self.table[place] == 0
            self.table[place[free]] = value[free]
            lost = self.table[place] != value
            place, value = (place[lost] + 1) & last, value[lost]

    def _add(self, key: np.ndarray, head: np.ndarray, tail: np.ndarray, short: np.ndarray, d: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Encode pieces of distinct keys that the cache lacks."""
        lo, hi = self.count, self.count + len(key)
        ids = self._pieces(d[ragged(start, size)], size)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))
        self.entry, self.size, self.ids = _room(self.entry, hi), _room(self.size, hi), _room(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(length) - length
        self.entry[lo:hi] = np.stack([key, head, tail, (at.astype(np.uint64) << U(32)) | length.astype(np.uint64)], axis=1)
        self.size[lo:hi] = short
        self.long.update((lo + i, d[start[i] : start[i] + size[i]].tobytes()) for i in np.flatnonzero(short == 17).tolist())
        self.count, self.used = hi, self.used + len(flat)
        if 2 * hi > len(self.table):
            self.table, lo = np.zeros(1 << (2 * hi).bit_length(), np.int32), 0
        self._place(self.entry[lo:hi, 0], np.arange(lo, hi))

    def _pieces(self, flat: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """The ids of pieces that lie one after another, from the library."""
        ends = np.cumsum(size)
        at = list(zip((ends - size).tolist(), ends.tolist(), strict=True))
        # an apostrophe may begin a contraction, which the pre-tokenizer must cut
        cut = np.ones(len(size), bool) if self.model is None else np.logical_or.reduceat(flat == 39, ends - size)
        out: list = [None] * len(size)
        if not cut.all():
            named, tokenize = _NAME[flat].tobytes().decode("utf-16-le"), self.model.tokenize
            for i in np.flatnonzero(~cut).tolist():
                out[i] = [t.id for t in tokenize(named[at[i][0] : at[i][1]])]
        if cut.any():
            raw, rest = flat.tobytes(), np.flatnonzero(cut).tolist()
            for i, x in zip(rest, self.tokenizer.encode_batch([raw[at[i][0] : at[i][1]].decode("utf-8") for i in rest], add_special_tokens=False), strict=True):
                out[i] = x.ids
        return out

    @staticmethod
    def _join(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), np.array([len(x) for x in parts], np.int64)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, or a copy with room for n rows and as many again."""
    if n <= len(x):
        return x
    more = np.zeros((2 * n, *x.shape[1:]), x.dtype)
    more[: len(x)] = x
    return more


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the id `end` to each text."""
    edges = np.cumsum(counts)
    return np.insert(ids, edges, np.uint32(end)), counts + 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
