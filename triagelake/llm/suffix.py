"""Exact removal of byte strings that occur more than once, by a sparse suffix array.

Every string of `width` bytes holds one or more anchors: positions whose `gram`-byte hash is least among those of some
such string. Anchors depend on content alone, so two equal strings have theirs at equal places, and only suffixes that
start at anchors need sorting. Splitters sampled from these suffixes range-partition them by their leading bytes; each
bucket sorts its suffixes by multikey quicksort (`multikey_order`: eight bytes at a time, only ties go on to the next
eight) to a depth of `gram` bytes and compares neighbours. Splitters go on to the text a suffix belongs to, so a group of
equal suffixes of any size is parted too; suffixes with the leading bytes of a splitter, which may lie on both sides of a
boundary, are compared across buckets in the next step.

An anchor whose whole surroundings (what any of its strings could cover) occur twice covers all of them. Where only the
leading bytes are shared, the suffixes go on to greater depth: the surroundings are fetched, range-partitioned and sorted
by over half a string around the anchor, and of neighbours that are equal so far each string through the anchor is
compared. Groups of more than `hot` such anchors are compared string by string through an aggregation instead.

Texts are UTF-8 bytes; null is empty; matches never cross documents, and overlapping ones in one document count.
Repeated rows: each other's copies, wholly removed from `width` bytes on. Null doc_id: takes part. Empty table: empty
result. Very long texts: a text is one value and handled as one. Further columns don't matter. Order and groups are by
the bytes themselves; whole surroundings and single strings are equal if two hashes of different bases and byte tables
are, 128 bits in all. Rows are named by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK, Roller, U, batch, blocks, long_binary, mix, partitions, ragged, row_key, signed, small_batches, text_buffers, written

SALTS = 16


def _slide(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over each w values in a row, by blocks of w."""
    n = len(x) - w + 1
    fill = np.iinfo(x.dtype).max if f is np.minimum else 0
    pad = np.full(-len(x) % w, fill, x.dtype)
    grid = np.concatenate([x, pad]).reshape(-1, w)
    ahead = f.accumulate(grid, axis=1).ravel()
    back = f.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes of the anchors of a block of texts."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < width:
        return none
    h = Roller(data, 11).grams(gram)
    w = width - gram + 1
    least = _slide(h, w, np.minimum)
    # strings that begin in one text and end in another
    for end in offsets[1:-1]:
        least[max(0, end - width + 1) : end] = 0
    most = _slide(np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    at = np.flatnonzero((most == h) & (most > 0))
    return at, h[at]


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their keys: a three-way partition by one key, then of its ties by the next."""
    order = np.argsort(keys[0], kind="stable")
    s = keys[0][order]
    group = np.cumsum(np.append(False, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    for key in keys[1:]:
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        inner = np.lexsort((key[order[at]], group[at]))
        order[at] = order[at[inner]]
        value = key[order]
        new = np.append(False, (group[1:] != group[:-1]) | (tied[1:] & (value[1:] != value[:-1])))
        group = np.cumsum(new)
    return order


class _Suffixes:
    """Columns of the anchors of some texts: leading bytes, hashes of the surroundings, text, place, extent."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, width: int, gram: int):
        parts = []
        for lo, hi in blocks(offs):
            o = offs[lo : hi + 1] - offs[lo]
            d = data[offs[lo] : offs[hi]]
            at, _ = anchors(d, o, width, gram)
            if not len(at):
                continue
            row = np.searchsorted(o, at, "right") - 1
            left = np.minimum(at - o[row], width - gram)
            right = np.minimum(o[row + 1] - at, width)
            context = [mix(Roller(d, seed).ranges(at - left, at + right) + left.astype(np.uint64)) for seed in (12, 15)]
            head = np.zeros((len(at), -(-gram // 8) * 8), np.uint8)
            head[:, :gram] = np.lib.stride_tricks.sliding_window_view(d, gram)[at]
            parts.append((head, *context, row + lo, at - o[row], left, right))
        empty = [np.zeros((0, -(-gram // 8) * 8), np.uint8), *(np.zeros(0, t) for t in (np.uint64,) * 2 + (np.int64,) * 4)]
        self.head, self.one, self.two, self.row, self.pos, self.left, self.right = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty


def _chunks(column: pa.Array, limit: int = 8 * BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of ranges of rows with some megabytes each."""
    data, offs = text_buffers(column)
    for lo, hi in blocks(offs, limit):
        yield lo, data, offs[lo : hi + 1]


def _names(column: pa.Array) -> np.ndarray:
    """Row names as two numbers each."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)


def _raw(names: np.ndarray) -> pa.Array:
    return long_binary(names.astype(">u8").ravel(), np.full(len(names), 2, np.int64))


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(row_key().alias("rk"), "text")


def _keys(head: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """Leading bytes and columns of each row as one string of bytes that sorts as they do."""
    wide = np.concatenate([head, *(c.astype(">u8").reshape(len(head), -1).view(np.uint8) for c in columns)], axis=1)
    return np.ascontiguousarray(wide).view(f"S{wide.shape[1]}").ravel()


def _splitters(docs: DataFrame, buckets: int, width: int, gram: int) -> np.ndarray:
    """Keys of buckets - 1 suffixes of a sample whose size depends on the buckets alone.

    A key is leading bytes, hashes of the surroundings and text, so even copies of one suffix can be parted.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    want = 64 * buckets
    every = max(1, int(2 * size / (width - gram + 1)) // want)
    by_text, by_place = min(every, 64), max(1, every // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rk = _names(b.column("rk"))
            for lo, data, offs in _chunks(b.column("text")):
                s = _Suffixes(data, offs, width, gram)
                name = rk[s.row + lo]
                pick = mix(name[:, 0] + s.pos.astype(np.uint64)) % U(by_place) == 0
                keys = _keys(s.head[pick], s.one[pick], s.two[pick], name[pick])
                yield batch(key=long_binary(keys.view(np.uint8), np.full(len(keys), keys.itemsize, np.int64)))

    some = _narrow(docs).filter(F.pmod(F.xxhash64("rk"), F.lit(by_text)) == 0).mapInArrow(run, "key binary")
    rows = some.orderBy(F.xxhash64("key"), "key").limit(4 * want).collect()
    wide = -(-gram // 8) * 8 + 32
    keys = np.sort(np.frombuffer(b"".join(bytes(r.key) for r in rows), f"S{wide}"))
    return np.unique(keys[np.linspace(0, len(keys) - 1, buckets + 1).astype(int)[1:-1]]) if len(keys) else keys


FOUND = "kind int, rk binary, pos int, l int, r int"
FULL, ASK = 0, 1


def _bucketed(docs: DataFrame, cuts, width: int, gram: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(cuts)
    wide = -(-gram // 8) * 8

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            names = _names(b.column("rk"))
            for base, data, offs in _chunks(b.column("text")):
                s = _Suffixes(data, offs, width, gram)
                if not len(s.row):
                    continue
                rk = names[base:]
                bucket = np.searchsorted(shared.value, _keys(s.head, s.one, s.two, rk[s.row]), "left")
                order = np.lexsort((s.head[:, 0], bucket))
                which, first = np.unique(bucket[order], return_index=True)
                blobs = []
                for lo, hi in zip(first, np.append(first[1:], len(order)), strict=True):
                    i = order[lo:hi]
                    texts, at = np.unique(s.row[i], return_inverse=True)
                    blobs.append(z.compress(b"".join(x.tobytes() for x in (np.array([len(texts), len(i)], "<u4"), rk[texts], s.head[i], s.one[i], s.two[i], s.pos[i].astype("<u4"), at.astype("<u4"), s.left[i].astype("<u2"), s.right[i].astype("<u2")))))
                yield batch(bucket=pa.array(which, pa.int32()), blob=pa.array(blobs, pa.binary()))

    def unpack(blob: bytes):
        blob = zstandard.ZstdDecompressor().decompress(blob)
        d, m = (int(x) for x in np.frombuffer(blob, "<u4", 2))
        at, out = 8 + 16 * d, []
        for kind, n in ((np.uint8, wide), (np.uint64, 1), (np.uint64, 1), ("<u4", 1), ("<u4", 1), ("<u2", 1), ("<u2", 1)):
            out.append(np.frombuffer(blob, kind, m * n, at))
            at += m * n * np.dtype(kind).itemsize
        out[0] = out[0].reshape(m, wide)
        out[4] = np.frombuffer(blob, np.uint64, 2 * d, 8).reshape(d, 2)[out[4]]
        return out

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x) for b in batches for x in b.column("blob").to_pylist()]
        if not parts:
            return
        head, one, two, pos, rk, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        words = [np.ascontiguousarray(w).astype(np.uint64) for w in head.view(">u8").T]
        order = multikey_order([*words, one, two, rk[:, 0], rk[:, 1], pos])
        # neighbours that are equal to the depth of the leading bytes
        group = np.ones(max(0, len(order) - 1), bool)
        for w in words:
            w = w[order]
            group &= w[1:] == w[:-1]
        lead = words[0][order]
        del words
        one, two, rk, pos, left, right = (x[order] for x in (one, two, rk, pos, left, right))
        equal = group & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        before, after = np.append(False, equal), np.append(equal, False)
        full = before | after
        # the first of each run of equal surroundings stands for it where its group holds others, or may do so in the
        # next bucket, having the leading bytes of a splitter: what is asked for is compared wherever it lies
        start = np.flatnonzero(~np.append(False, group))
        runs = np.add.reduceat((~before).astype(np.int64), start)
        splitters = np.frombuffer(shared.value.tobytes(), np.uint8).reshape(-1, wide + 32)[:, :wide]
        edge = np.isin(lead[start], np.ascontiguousarray(splitters[:, :8]).view(">u8").ravel().astype(np.uint64))
        edge[edge] = np.isin(_keys(head[order[start[edge]]]), _keys(splitters))
        del head
        many = np.repeat((runs > 1) | edge, np.diff(np.append(start, len(order))))
        ask = ~before & many
        for kind, pick in ((FULL, np.flatnonzero(full)), (ASK, np.flatnonzero(ask))):
            for lo in range(0, len(pick), 50_000):
                i = pick[lo : lo + 50_000]
                yield batch(kind=np.full(len(i), kind, np.int32), rk=_raw(rk[i]), pos=pos[i].astype(np.int32), l=left[i].astype(np.int32), r=right[i].astype(np.int32))

    packed = _narrow(docs).mapInArrow(pack, "bucket int, blob binary")
    return packed.repartition(partitions(docs.sparkSession), "bucket").mapInArrow(compare, FOUND)


def _zipped(docs: DataFrame) -> DataFrame:
    """doc_id, rk and compressed text: what goes through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield batch(doc_id=b.column("doc_id"), rk=b.column("rk"), z=pa.array([z.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "text").mapInArrow(run, "doc_id long, rk binary, z binary")


CONTEXT = "rk binary, pos int, half int, left int, body binary"


def _contexts(docs: DataFrame, asked: DataFrame, width: int, gram: int) -> DataFrame:
    """The surroundings of the anchors asked for: one row for the strings that reach far right, one for the others; key: a hash of what they share."""
    split = (width - gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for rk, raw, asks in zip(b.column("rk").to_pylist(), b.column("z").to_pylist(), b.column("asks").to_pylist(), strict=True):
                text = z.decompress(raw)
                for a in asks:
                    p, left, right = a["pos"], a["l"], a["r"]
                    if right >= width - split:  # strings that begin at most `split` bytes before the anchor
                        n = min(left, split)
                        out.append((rk, p, 0, n, text[p - n : p + right]))
                    if left > split:
                        out.append((rk, p, 1, left, text[p - left : p + min(right, width - split - 1)]))
            if out:
                rk, pos, half, left, body = zip(*out, strict=True)
                yield batch(rk=pa.array(rk, pa.binary()), pos=pa.array(pos, pa.int32()), half=pa.array(half, pa.int32()), left=pa.array(left, pa.int32()), body=pa.array(body, pa.binary()))

    asks = asked.groupBy("rk").agg(F.collect_list(F.struct("pos", "l", "r")).alias("asks"))
    found = _zipped(docs).select("rk", "z").join(asks, "rk").mapInArrow(run, CONTEXT)
    return found.withColumn("key", F.xxhash64("half", _lead(width, gram)))


def _lead(width: int, gram: int) -> Column:
    """What all strings of a context share, over half a string around the anchor."""
    split = (width - gram) // 2
    return F.expr(f"CASE WHEN half = 0 THEN substring(body, left + 1, {width - split}) ELSE substring(body, left - {split}, {split + 1 + gram}) END")


def _strings(half: np.ndarray, left: np.ndarray, bodies: list[bytes], width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, how far before the anchor it begins, two hashes) of each string through the anchors."""
    split = (width - gram) // 2
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    right = size - left
    least = np.maximum(np.where(half == 0, 0, split + 1), width - right)
    count = np.maximum(left - least + 1, 0)
    row = np.repeat(np.arange(len(bodies)), count)
    back = ragged(least, count)
    one, two = np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)
    ends = np.append(0, np.cumsum(count))
    for lo, hi in blocks(np.append(0, np.cumsum(size))):
        at = slice(ends[lo], ends[hi])
        base = np.cumsum(size[lo:hi]) - size[lo:hi]
        start = base[row[at] - lo] + left[row[at]] - back[at]
        data = np.frombuffer(b"".join(bodies[lo:hi]), np.uint8)
        one[at], two[at] = (Roller(data, seed).ranges(start, start + width) for seed in (13, 14))
    return row, back, mix(one + back.astype(np.uint64) * U(0x9E3779B97F4A7C15)), two


SPANS = "rk binary, s int, e int"


def _whole_leads(batches: Iterator[pa.RecordBatch], least: int = 2000) -> Iterator[pa.Table]:
    """Tables of some thousand rows that hold all rows of their leads, from batches that are ordered by half and lead."""
    rest, waiting = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        waiting += b.num_rows
        if waiting < least:
            continue
        waiting = 0
        leads, halves = rest.column("lead"), rest.column("half").to_numpy()
        n = rest.num_rows
        last = pc.equal(leads, leads[n - 1]).to_numpy() & (halves == halves[-1])
        cut = int(np.argmax(last))
        if cut:
            yield rest.slice(0, cut).combine_chunks()
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _matched(contexts: DataFrame, width: int, gram: int, hot: int) -> DataFrame:
    """rk, s, e: what the strings that occur twice cover."""

    def spans(rk: pa.Array, pos, row, back, twice):
        row, back = row[twice], back[twice]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        r = row[first]
        far, near = np.maximum.reduceat(back, first), np.minimum.reduceat(back, first)
        return batch(rk=rk.take(pa.array(r)), s=(pos[r] - far).astype(np.int32), e=(pos[r] - near + width).astype(np.int32))

    def repeated(one, two):
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        twice = np.zeros(len(one), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        return twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_leads(batches):
            lead, half, rk, pos = (t.column(c).combine_chunks() for c in ("lead", "half", "rk", "pos"))
            h, p = half.to_numpy(), pos.to_numpy()
            same = pc.equal(lead[1:], lead[:-1]).to_numpy(zero_copy_only=False) & (h[1:] == h[:-1])
            # rows of documents that repeat come twice
            again = np.append(False, same & pc.equal(rk[1:], rk[:-1]).to_numpy(zero_copy_only=False) & (p[1:] == p[:-1]))
            group = np.cumsum(np.append(True, ~same))
            keep = np.flatnonzero(~again)
            group = group[keep]
            keep = keep[np.bincount(group)[group] > 1]
            if not len(keep):
                continue
            at = pa.array(keep)
            row, back, one, two = _strings(h[keep], t.column("left").to_numpy()[keep].astype(np.int64), t.column("body").take(at).to_pylist(), width, gram)
            twice = repeated(one, two)
            if twice.any():
                yield spans(rk.take(at), p[keep].astype(np.int64), row, back, twice)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                c = b.slice(at, 2000)
                row, back, one, two = _strings(c.column("half").to_numpy(), c.column("left").to_numpy().astype(np.int64), c.column("body").to_pylist(), width, gram)
                yield batch(one=signed(one), two=signed(two), rk=c.column("rk").take(pa.array(row)), pos=c.column("pos").to_numpy()[row], back=back.astype(np.int32))

    hot_keys = written(contexts.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("key"), "hot")
    cold = contexts.join(hot_keys, "key", "left_anti").select("half", "rk", "pos", "left", "body")
    lead = _lead(width, gram)
    cold = cold.repartitionByRange(partitions(contexts.sparkSession), "half", lead).sortWithinPartitions("half", lead, "rk", "pos")
    out = cold.withColumn("lead", lead).mapInArrow(run, SPANS)
    if hot_keys.head(1):
        large = contexts.join(hot_keys, "key", "left_semi").select("half", "left", "body", "rk", "pos")
        strings = written(large.mapInArrow(explode, "one long, two long, rk binary, pos int, back int"), "strings").dropDuplicates(["one", "two", "rk", "pos", "back"])
        twice = strings.groupBy("one", "two").agg(F.count("*").alias("c")).filter("c > 1").select("one", "two", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        hit = strings.withColumn("salt", F.pmod(F.hash("rk", "pos"), F.lit(SALTS))).join(twice, ["one", "two", "salt"])
        more = hit.groupBy("rk", "pos").agg(F.max("back").alias("far"), F.min("back").alias("near"))
        out = out.union(more.select("rk", (F.col("pos") - F.col("far")).cast("int"), (F.col("pos") - F.col("near") + width).cast("int")))
    return out


def repeats(docs: DataFrame, width: int = 200, gram: int = 64, hot: int = 20_000) -> DataFrame:
    """rk, spans: the byte ranges of each document that repeated strings cover; overlaps are not yet joined."""
    spark = docs.sparkSession
    small_batches(spark)
    cuts = _splitters(docs, 2 * partitions(spark), width, gram)
    found = written(_bucketed(docs, cuts, width, gram), "suffixes")
    contexts = written(_contexts(docs, found.filter(F.col("kind") == ASK), width, gram), "contexts")
    whole = found.filter(F.col("kind") == FULL).select("rk", (F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.col("r")).alias("e"))
    return whole.union(_matched(contexts, width, gram, hot)).groupBy("rk").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<s:int,e:int>>, kept binary"


def remove(docs: DataFrame, width: int = 200, gram: int = 64, hot: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (maximal runs, joined) and the kept bytes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            lists = b.column("spans")
            rows, size = [], 0
            for i, (doc, raw) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("z").to_pylist(), strict=True)):
                text = z.decompress(raw)
                runs: list[list[int]] = []
                for s, e in sorted((x["s"], x["e"]) for x in lists[i].as_py() or ()):
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], e)
                    else:
                        runs.append([s, e])
                at, kept = 0, []
                for s, e in runs:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                rows.append((doc, len(text), sum(e - s for s, e in runs), len(runs), [{"s": s, "e": e} for s, e in runs], b"".join(kept)))
                size += len(text)
                if size > 4 << 20:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)

    spans = repeats(docs, width, gram, hot)
    return _zipped(docs).join(spans, "rk", "left").select("doc_id", "z", "spans").mapInArrow(run, CLEANED)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc, n, gone, count, spans, kept = zip(*rows, strict=True)
    return batch(doc_id=pa.array(doc, pa.int64()), n_bytes=pa.array(n, pa.int64()), n_removed=pa.array(gone, pa.int64()), n_spans=pa.array(count, pa.int64()), spans=pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), kept=pa.array(kept, pa.binary()))
