"""Subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks at both ends) and itself, all hashed into buckets; its vector is
the mean of their embeddings. A text is the mean of its words' vectors, and a linear softmax reads that mean. So a
misspelling that training never saw shares most of its vectors with the word it stands for.

Training takes place in one task of an executor, on a sample whose rows and bytes are bounded, and sends the driver the
scores alone; a lost executor has the task run again, with the same result.

For scoring, embeddings and softmax fold into one row of class scores per bucket; the class scores of words that a
worker has met are cached up to a bound.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Roller, U, Words, batch, blocks, mix, ragged, range_hashes, small_batches, text_buffers

#: Everything in ASCII but letters and digits parts words.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
CACHE = 1_000_000


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    base = int(offsets[0])
    return Words(_PLAIN[data[base : int(offsets[-1])]], offsets - base)


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, lengths: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, number of subwords of each word), grouped by word."""
    n = end - start
    size = n + 2
    at = np.cumsum(size) - size
    buf = np.full(int(size.sum()), 1, np.uint8)
    buf[ragged(at + 1, n)] = data[ragged(start, n)]
    owner = np.repeat(np.arange(len(n)), size)
    rows, values = [np.arange(len(n))], [range_hashes(buf, at, at + size, 7)]
    roller = Roller(buf, 7)
    for k in lengths:
        h = roller.grams(k)
        good = owner[: len(h)] == owner[k - 1 :] if len(h) else np.zeros(0, bool)
        rows.append(owner[: len(h)][good])
        values.append(h[good])
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.argsort(row, kind="stable")
    return (value[order] % U(buckets)).astype(np.int64), np.bincount(row, minlength=len(n))


class Model:
    def __init__(self, scores: np.ndarray, bias: np.ndarray, scale: float, lengths: tuple[int, ...]):
        self.scores, self.bias, self.scale, self.lengths = scores.astype(np.float32), bias, scale, lengths
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(bias)), np.float32)

    def __getstate__(self):
        return self.scores, self.bias, self.scale, self.lengths

    def __setstate__(self, state):
        self.__init__(*state)

    def word_scores(self, w: Words) -> np.ndarray:
        """Class scores of each word of a block."""
        found, where, back = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.keys) + len(found) > CACHE:
            self.keys, self.values = self.keys[:0], self.values[:0]
        p = np.searchsorted(self.keys, found)
        known = p < len(self.keys)
        known[known] = self.keys[p[known]] == found[known]
        new = np.flatnonzero(~known)
        if len(new):
            bucket, count = grams(w.data, w.start[where[new]], w.end[where[new]], self.lengths, len(self.scores))
            sums = np.add.reduceat(self.scores[bucket], np.cumsum(count) - count, axis=0) / count[:, None]
            keys, values = np.concatenate([self.keys, found[new]]), np.concatenate([self.values, sums.astype(np.float32)])
            order = np.argsort(keys, kind="stable")
            self.keys, self.values = keys[order], values[order]
            p = np.searchsorted(self.keys, found)
        return self.values[p[back]]

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(class probabilities, words) of each text; a text without words gets the bias alone."""
        data, offs = text_buffers(column)
        out, counts = np.zeros((len(offs) - 1, len(self.bias))), np.zeros(len(offs) - 1, np.int64)
        for lo, hi in blocks(offs):
            w = words_of(data, offs[lo : hi + 1])
            counts[lo:hi] = np.diff(w.first)
            if len(w.hash):
                s = self.word_scores(w)
                for k in range(len(self.bias)):
                    out[lo:hi, k] = np.bincount(w.doc, weights=s[:, k], minlength=hi - lo)
        z = out / np.maximum(counts, 1)[:, None] * self.scale + self.bias
        z -= z.max(axis=1, keepdims=True) if len(z) else 0
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), counts


def train(texts: list[str], labels: np.ndarray, classes: int, dim: int = 4, buckets: int = 1 << 18, lengths: tuple[int, ...] = (3, 4, 5), epochs: int = 100, rate: float = 0.1, scale: float = 100.0, decay: float = 1e-4, seen: int = 3, seed: int = 7) -> Model:
    """Full-batch Adam over a bounded sample; the same sample in the same order gives the same model."""
    rng = np.random.default_rng(seed)
    labels = np.asarray(labels, np.int64)
    if not len(texts):
        return Model(np.zeros((buckets, classes)), np.zeros(classes), scale, lengths)
    data, offs = text_buffers(pa.array(texts, pa.string()))
    pairs_doc, pairs_key, pairs_n = [], [], []
    vocabulary: dict = {}
    known, bucket_parts, count_parts = np.zeros(0, np.uint64), [], []
    for lo, hi in blocks(offs):
        w = words_of(data, offs[lo : hi + 1])
        if not len(w.hash):
            continue
        found, where = np.unique(w.hash, return_index=True)
        new = ~np.isin(found, known)
        b, c = grams(w.data, w.start[where[new]], w.end[where[new]], lengths, buckets)
        bucket_parts.append(b)
        count_parts.append(c)
        vocabulary[len(vocabulary)] = found[new]
        known = np.concatenate([known, found[new]])
        key = mix(w.hash + w.doc.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        pairs_doc.append(w.doc[at] + lo)
        pairs_key.append(w.hash[at])
        pairs_n.append(n)
    if not bucket_parts:
        return Model(np.zeros((buckets, classes)), np.log((np.bincount(labels, minlength=classes) + 1) / (len(labels) + classes)), scale, lengths)
    order = np.argsort(known, kind="stable")
    word = order[np.searchsorted(known[order], np.concatenate(pairs_key))]
    doc, n = np.concatenate(pairs_doc), np.concatenate(pairs_n).astype(float)
    bucket, count = np.concatenate(bucket_parts), np.concatenate(count_parts)
    total = np.bincount(doc, weights=n, minlength=len(texts))
    # words of fewer than `seen` texts teach nothing that their n-grams don't teach elsewhere
    often = np.bincount(word, minlength=len(count)) >= seen
    keep = often[word]
    word, doc, n = np.cumsum(often)[word[keep]] - 1, doc[keep], n[keep]
    bucket, count = bucket[np.repeat(often, count)], count[often]
    if not len(count):
        return Model(np.zeros((buckets, classes)), np.log((np.bincount(labels, minlength=classes) + 1) / (len(labels) + classes)), scale, lengths)
    used, gram = np.unique(bucket, return_inverse=True)
    owner = np.repeat(np.arange(len(count)), count)

    def spread(row, col, weight, rows):
        """Sums of weighted rows of a table by `row`, as a function of the table."""

        def apply(table):
            return np.stack([np.bincount(row, weights=table[:, j][col] * weight, minlength=rows) for j in range(table.shape[1])], axis=1)

        return apply

    wt, gt = n / total[doc], (1.0 / count)[owner]
    to_word, from_word = spread(owner, gram, gt, len(count)), spread(gram, owner, gt, len(used))
    to_doc, from_doc = spread(doc, word, wt, len(texts)), spread(word, doc, wt, len(count))
    E = rng.normal(0, 0.1, (len(used), dim))
    W = rng.normal(0, 0.5, (dim, classes))
    b = np.zeros(classes)
    target = np.eye(classes)[labels]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (E, W, b)]
    for t in range(1, epochs + 1):
        v = to_doc(to_word(E)) * scale
        z = v @ W + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) / len(texts)
        grads = [from_word(from_doc(g @ W.T * scale)) + decay * E, v.T @ g + decay * W, g.sum(axis=0)]
        for param, grad, (m, s) in zip((E, W, b), grads, state, strict=True):
            m += 0.1 * (grad - m)
            s += 0.01 * (grad * grad - s)
            param -= (rate * (1 - t / (epochs + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8))
    scores = np.zeros((buckets, classes), np.float32)
    scores[used] = E @ W
    return Model(scores, b.astype(float), scale, lengths)


def trained(sample: DataFrame, classes: int, most_bytes: int = 32 << 20, both: bool = False, **options) -> Model:
    """A model of the rows (label, text) of a bounded sample: in its order, texts are taken whole while they fit in most_bytes.

    With `both`, a sample that lacks a class teaches nothing.
    """
    small_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, size = [], [], 0
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                n = len(text.encode())
                if size + n <= most_bytes:
                    size += n
                    texts.append(text)
                    labels.append(label)
        if both and len(set(labels)) < classes:
            texts, labels = [], []
        model = train(texts, np.array(labels, np.int64), classes, **options)
        yield batch(model=pa.array([zlib.compress(pickle.dumps(model), 1)], pa.binary()))

    rows = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(zlib.decompress(rows[0].model)) if rows else train([], np.zeros(0, np.int64), classes, **options)
