"""Quality rules over whole documents: text rules and cross-document line frequency.

Text rules need one document only. Line frequency needs the corpus: each line is normalised (lower case, digits as 0,
white space squeezed, trimmed) and hashed; for each host the distinct documents that hold a line are counted: equal
texts are copies of one document, texts that differ in anything are two. A line held by more than `line_share` of a
host's documents, and by more than `line_min` of them, is above the limit. A document that keeps less than `least_left`
of its words without such lines, or fewer than `least_words`, is depleted and rejected, as is one that fails the text
rules. `apply` takes the lines above the limit out of the texts it returns.

Counts are aggregated before each shuffle, and the join that brings frequent lines back to documents is salted: a line
or host held by a third of all documents is spread over `SALTS` keys.

Rows and texts are named by 128 bits, lines by 64: two lines of equal hash are taken for one.

Null text: no words, so it fails the text rules. Null host: a host of its own. Repeated rows: judged alike, each kept
or rejected. Empty table: empty result. Further columns are carried by `apply`, whose n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, batch, blocks, free_name, mix, range_hashes, row_key, small_batches, text_buffers, text_key, windows, written

SALTS = 32
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[edges[1:]] - c[edges[:-1]]


def _repeats(w: Words, k: int) -> np.ndarray:
    """Words of each row that lie in a k-word window found at least twice in it."""
    h = windows(w.hash, k)
    m = len(h)
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if m:
        doc = w.doc[:m]
        good = doc == w.doc[k - 1 :]
        key = mix(h + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        at = np.flatnonzero(good)
        order = at[np.argsort(key[at], kind="stable")]
        s = key[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:]
        hit = order[same]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + k, -1)
    return _sums((np.cumsum(covered[:-1]) > 0).astype(np.int64), w.first)


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, exact hash, normalised hash, words, order of each \\n-split line that has a word."""
    breaks = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    start = start[start < len(w.data)]
    end = np.append(start[1:], len(w.data))
    end = np.where((end > start) & (w.data[np.maximum(end - 1, 0)] == 10), end - 1, end) if len(start) else end
    row = np.searchsorted(w.offsets, start, "right") - 1
    f, g = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    n = g - f
    has = n > 0
    start, end, row, f, g, n = (x[has] for x in (start, end, row, f, g, n))
    exact = range_hashes(w.data, start, end, 2)
    low = w.data.copy()
    up = (low >= 65) & (low <= 90)
    low[up] += 32
    low[(low >= 48) & (low <= 57)] = 48
    word = range_hashes(low, w.start, w.end, 3)
    # a line's normal form: its normalised words in order
    normal = range_hashes(word.view(np.uint8), 8 * f, 8 * g, 4)
    return row, exact, normal, n, end - start


MEASURED = "doc_id long, rk binary, text_key binary, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<long>"


def _measure(batches: Iterator[pa.RecordBatch], host: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offs = text_buffers(b.column("text"))
        for lo, hi in blocks(offs):
            w = Words(data, offs[lo : hi + 1])
            head = (w.data & 0xC0) != 0x80
            c = np.zeros(len(head) + 1, np.int64)
            np.cumsum(head, out=c[1:])
            row, exact, normal, n, _ = _lines(w)
            key = mix(exact + row.astype(np.uint64) * U(0x9E3779B97F4A7C15))
            _, once = np.unique(key, return_index=True)
            dup = np.ones(len(key), bool)
            dup[once] = False
            per = np.searchsorted(row, np.arange(hi - lo + 1))
            offs32 = per.astype(np.int32)
            yield batch(
                doc_id=b.column("doc_id").slice(lo, hi - lo), rk=b.column("rk").slice(lo, hi - lo), text_key=b.column("text_key").slice(lo, hi - lo), host=b.column(host).slice(lo, hi - lo),
                n_words=np.diff(w.first), word_chars=_sums(c[w.end] - c[w.start], w.first), n_symbols=_sums(_SYMBOL[w.data], w.offsets),
                n_dup_lines=_sums(dup.astype(np.int64), per), n_repeat_words=_repeats(w, 3),
                line_hash=pa.ListArray.from_arrays(offs32, pa.array(normal.view(np.int64))), line_words=pa.ListArray.from_arrays(offs32, pa.array(n.astype(np.int64))),
            )


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: the counts of the text rules and its normalised lines."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(host).cast("string").alias("host"), row_key().alias("rk"), text_key().alias("text_key"))
    return narrow.mapInArrow(lambda it: _measure(it, "host"), MEASURED)


def frequent_lines(measured: DataFrame, line_share: float, line_min: int) -> DataFrame:
    """host, line: those held by too many of a host's documents."""
    texts = measured.select(F.coalesce("host", F.lit("\x00")).alias("host"), "rk", "text_key", "line_hash")
    size = texts.groupBy("host", "text_key").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_texts"))
    held = texts.select("host", "text_key", F.explode(F.array_distinct("line_hash")).alias("line"))
    held = held.groupBy("host", "line", "text_key").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("n"))
    held = held.filter(F.col("n") > line_min)
    return held.join(size, "host").filter(F.col("n") > line_share * F.col("host_texts")).select("host", "line")


def _judged(docs: DataFrame, host: str = "source", line_share: float = 0.1, line_min: int = 10, least_left: float = 0.5, least_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """What `judge` gives, and rk, host, lines: the hashes of the lines above the limit that a document holds."""
    m = written(measure(docs, host), "quality")
    bad = frequent_lines(m, line_share, line_min).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.hash("rk", "line"), F.lit(SALTS))
    mine = m.select("rk", F.coalesce("host", F.lit("\x00")).alias("host"), F.explode(F.arrays_zip("line_hash", "line_words")).alias("x"))
    mine = mine.select("rk", "host", F.col("x.line_hash").alias("line"), F.col("x.line_words").alias("words"))
    # rows that repeat share rk and lines: count each line of a document once for each time it stands in it
    mine = mine.groupBy("rk", "host", "line").agg(F.sum("words").alias("words"), F.count("*").alias("c")).withColumn("salt", salt)
    # rows that share a text may differ in host, and so in what is above the limit
    held = written(mine.join(bad, ["host", "line", "salt"]).groupBy("rk", "host").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("lines")), "held")
    lost = held.groupBy("rk").agg(F.sum("lost").alias("lost"))
    copies = F.count("*").alias("copies")
    lost = m.groupBy("rk").agg(copies).join(lost, "rk").select("rk", (F.col("lost") / F.col("copies")).cast("long").alias("lost"))
    out = m.join(lost, "rk", "left").withColumn("words_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= F.greatest(F.lit(least_words), least_left * F.col("n_words")))).drop("line_hash", "line_words", "lost", "text_key", "host")
    return out, held.select("rk", "host", "lines")


def judge(docs: DataFrame, **options) -> DataFrame:
    """doc_id, rk, the counts, words_left, base_failed and kept; one row per row of docs."""
    return _judged(docs, **options)[0]


def _without(texts: pa.Array, lines: list[list[int] | None]) -> list[str | None]:
    """The texts without the lines whose normalised hashes are given; each goes with the break that ends it."""
    out = texts.to_pylist()
    for i, bad in enumerate(lines):
        if bad:
            raw = out[i].encode()
            data = np.frombuffer(raw, np.uint8)
            _, _, normal, _, _ = _lines(w := Words(data, np.array([0, len(data)])))
            gone, at, kept = np.isin(normal.view(np.int64), np.array(bad, np.int64)), 0, []
            pieces = raw.split(b"\n")
            bounds = np.cumsum([0] + [len(x) + 1 for x in pieces])
            for j, x in enumerate(pieces):
                worded = np.searchsorted(w.start, bounds[j]) < np.searchsorted(w.start, bounds[j] + len(x))
                if not (worded and gone[at]):
                    kept.append(x)
                at += int(worded)
            out[i] = b"\n".join(kept).decode()
    return out


def apply(docs: DataFrame, host: str = "source", **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns, their texts without the lines above the limit; n_chars follows the text."""
    schema = docs.schema
    rk, hk, lk = (free_name(docs, x) for x in ("rk", "host_key", "lines"))
    verdict, held = _judged(docs, host=host, **options)
    verdict = verdict.filter("kept").select(F.col("rk").alias(rk)).distinct()
    gone = held.select(F.col("rk").alias(rk), F.col("host").alias(hk), F.col("lines").alias(lk))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {n: b.column(n) for n in schema.names}
            lines = b.column(lk).to_pylist()
            if any(lines):
                text = _without(columns["text"], lines)
                columns["text"] = pa.array(text, columns["text"].type)
                if "n_chars" in columns:
                    old = columns["n_chars"].to_pylist()
                    new = [len(t) if x else n for t, x, n in zip(text, lines, old, strict=True)]
                    columns["n_chars"] = pa.array(new, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    mine = docs.withColumn(rk, row_key()).join(verdict, rk, "left_semi")
    mine = mine.withColumn(hk, F.coalesce(F.col(host).cast("string"), F.lit("\x00")))
    return mine.join(gone, [rk, hk], "left").select(*schema.names, lk).mapInArrow(run, schema)
