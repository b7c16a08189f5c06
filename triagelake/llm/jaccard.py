"""Similarity join of documents by the Jaccard similarity of their 5-word shingle sets.

Documents with equal sets are one set from the start. Tokens (shingles) have one order for all sets: those outside the
frequent class first, by hash; then the frequent class, rarest first. Two sets of similarity >= t share all but a few
tokens, so their first common token lies among the first n - ceil(t n) + 1 of each, and the second among one more. Either
the first is rare, and both sets stand under it in the index; or both are frequent, and both stand under the pair. Sets
with more than `combine` frequent tokens in the prefix stand under each of them instead; to be found from there, sets with
fewer stand under theirs as guests. A set of one token stands under it. An entry carries how much of its set is left from
there on, which bounds what two sets can share: entries that no partner in the list can match, by size and by this bound,
leave the list.

The frequent class is a table of at most `class_size` tokens. Any table gives the same links, since it only sets the
order; it is estimated from all sets, with bounded memory in each task.

Equal lists of sets under several keys count once. Rounds of stars come first: in each list, one set of each component
so far is compared with one set of the list's centre, the component of least hash, which is the same in most lists of a
group. What is joined by then is left alone. Sets of one list that are still in different components are judged where the
list lies, by size and by parity sketches, which rule out for sure: a list is dealt to tasks as pairs of blocks of about
`block` sets, and a pair leaves its task only if nothing rules it out, and from the first list alone that the two share.
What leaves is compared exactly, on the whole texts. So every link between components is found, and a large group of near
copies makes rows for pairs that may link, not for all pairs; the sketches of sets that stay apart are compared with those
of all the lists they stand in.

Null text or no words: an empty set, linked with nothing, its own component. Null doc_id: takes part; a component's id
is its least doc_id that isn't null. Repeated rows: equal sets. Empty table: empty result. Further columns don't matter.
Sets are named by 64-bit hashes of their tokens, rows by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, Words, batch, blocks, free_name, mix, partitions, ragged, row_key, shingles, signed, small_batches, text_buffers, written
from .graph import components

SALTS = 16
#: What is left of a set from an entry on is kept as so many parts of its size, rounded up.
PARTS = 65_535
#: Lists of a set that go with it where pairs are judged.
OWN = 48


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """lo, hi, edges, tokens and names of the sets of each block of rows; tokens of row lo + i: edges[i]:edges[i + 1]."""
    data, offs = text_buffers(column)
    for lo, hi in blocks(offs):
        row, value = shingles(Words(data, offs[lo : hi + 1], lower=True), k)
        edges = np.searchsorted(row, np.arange(hi - lo + 1))
        c = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(mix(value + U(0x632BE59BD9B4E019)), out=c[1:])
        n = np.diff(edges).astype(np.uint64)
        yield lo, hi, edges, value, mix(c[edges[1:]] - c[edges[:-1]] + n * U(0x9E3779B97F4A7C15))


def sketches(edges: np.ndarray, value: np.ndarray) -> list[bytes]:
    """For each set, the parity of its tokens in two to four bits per token.

    Sets differ in at least as many tokens as their sketches differ in bits, so a sketch can rule a pair out for sure.
    """
    n = np.diff(edges)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    base = np.cumsum(bits) - bits
    at = np.repeat(base, n) + ((value >> U(20)) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(bool)).tobytes()
    return [packed[b : b + m] for b, m in zip((base >> 3).tolist(), (bits >> 3).tolist(), strict=True)]


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many bits each pair of sketches differs, the longer one being folded to the length of the other."""
    a, b = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    out = np.zeros(len(x), np.int64)
    for p, q in {*zip(a.tolist(), b.tolist(), strict=True)}:
        at = np.flatnonzero((a == p) & (b == q))
        grid = []
        for side, size in ((x, p), (y, q)):
            m = np.frombuffer(b"".join([side[i] for i in at]), np.uint8).reshape(len(at), size)
            grid.append(np.bitwise_xor.reduce(m.reshape(len(at), -1, min(p, q)), axis=1))
        out[at] = np.bitwise_count(grid[0] ^ grid[1]).sum(axis=1)
    return out


class _Recent:
    """Names met lately in a task, up to a bound: a map-side combine for equal sets."""

    def __init__(self, most: int = 200_000):
        self.most, self.seen = most, set()

    def new(self, names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), bool)
        for i, x in enumerate(names.tolist()):
            if x not in self.seen:
                out[i] = True
                self.seen.add(x)
        if len(self.seen) > self.most:
            self.seen.clear()
        return out


def measure(docs: DataFrame, k: int, keep: int) -> DataFrame:
    """kind 0: doc_id, rk, set, n, sketch of each row. kind 1: token, count of tokens that a task has met in several sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, tokens, counts = _Recent(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            parts = []
            for lo, hi, edges, value, names in _sets(b.column("text"), k):
                n = np.diff(edges)
                yield batch(kind=np.zeros(hi - lo, np.int32), doc_id=b.column("doc_id").slice(lo, hi - lo), rk=b.column("rk").slice(lo, hi - lo), set=signed(names), n=n, sketch=pa.array(sketches(edges, value), pa.binary()))
                fresh = np.flatnonzero(recent.new(names))
                parts.append(value[ragged(edges[fresh], n[fresh])])
            found, c = np.unique(np.concatenate(parts) if parts else tokens[:0], return_counts=True)
            more = c > 1
            # tokens that are single in a batch can hardly be frequent; the class need not be exact
            tokens, back = np.unique(np.concatenate([tokens, found[more]]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, c[more]]), minlength=len(tokens)).astype(np.int64)
            if len(tokens) > 2 * keep:
                top = np.sort(np.argpartition(-counts, keep)[:keep])
                tokens, counts = tokens[top], counts[top]
        more = counts > 3
        if more.any():
            m = int(more.sum())
            yield batch(kind=np.ones(m, np.int32), doc_id=pa.nulls(m, pa.int64()), rk=pa.nulls(m, pa.binary()), set=signed(tokens[more]), n=counts[more], sketch=pa.nulls(m, pa.binary()))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("rk"))
    return narrow.mapInArrow(run, "kind int, doc_id long, rk binary, set long, n long, sketch binary")


def _index(docs: DataFrame, k: int, percent: int, ranks: tuple[np.ndarray, np.ndarray], combine: int, buckets: int) -> DataFrame:
    """bucket, blob: the index entries of a batch of sets, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def entries(edges, value, pick):
        """keys, set number, guest mark and rest of the sets `pick` of a block."""
        keys_known, rank_known = shared.value
        keys, owner, guests, rests = [], [], [], []
        n = np.diff(edges)
        size = np.minimum(n - -(-percent * n // 100) + 1, n)
        if len(keys_known):
            p = np.minimum(np.searchsorted(keys_known, value), len(keys_known) - 1)
            hit = keys_known[p] == value
            c = np.zeros(len(value) + 1, np.int64)
            np.cumsum(hit, out=c[1:])
            mixed = (c[edges[1:]] > c[edges[:-1]]) & (n > 1)
        else:
            mixed = np.zeros(len(n), bool)
        plain = pick[~mixed[pick]]
        at = ragged(edges[plain], size[plain])
        keys.append(value[at])
        owner.append(np.repeat(plain, size[plain]))
        guests.append(np.zeros(len(at), bool))
        rests.append(edges[owner[0] + 1] - at)
        for i in pick[mixed[pick]]:
            v = value[edges[i] : edges[i + 1]]
            r = np.where(hit[edges[i] : edges[i + 1]], rank_known[p[edges[i] : edges[i + 1]]] + 1, 0)
            order = np.lexsort((v, r))[: size[i] + 1]
            v, r = v[order], r[order]
            rest = n[i] - np.arange(len(v))
            single, few = slice(0, size[i]), (r > 0).sum() <= combine
            mine = [np.where(r > 0, mix(v ^ U(0xA5A5A5A55A5A5A5A)), v)[single]]
            theirs, left = [(few & (r > 0))[single]], [rest[single]]
            if few and (r > 0).sum() > 1:
                often, after = v[r > 0], rest[r > 0]
                by_value = np.argsort(often)
                often, after = often[by_value], after[by_value]
                x, y = np.triu_indices(len(often), 1)
                mine.append(mix(often[x] * U(0xC2B2AE3D27D4EB4F) + often[y]))
                theirs.append(np.zeros(len(x), bool))
                left.append(np.minimum(after[x], after[y]) + 1)
            keys += mine
            guests += theirs
            rests += left
            owner.append(np.full(sum(map(len, mine)), i))
        return np.concatenate(keys), np.concatenate(owner), np.concatenate(guests), np.concatenate(rests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = _Recent()
        for b in batches:
            parts, names, sizes, at = [], [], [], 0
            for _, _, edges, value, name in _sets(b.column("text"), k):
                n = np.diff(edges)
                pick = np.flatnonzero((n > 0) & recent.new(name))
                a, o, g, r = entries(edges, value, pick)
                part = -(-np.minimum(r, n[o]) * PARTS // np.maximum(n[o], 1))
                parts.append((a, o + at, g, part))
                names.append(name)
                sizes.append(n)
                at += len(name)
            if not at:
                continue
            key, own, guest, part = (np.concatenate(x) for x in zip(*parts, strict=True))
            name, n = np.concatenate(names), np.concatenate(sizes)
            if not len(key):
                continue
            bucket = (key % U(buckets)).astype(np.int64)
            order = np.lexsort((own, bucket))
            key, own, guest, part, bucket = key[order], own[order], guest[order], part[order], bucket[order]
            which, first = np.unique(bucket, return_index=True)
            blobs = []
            for lo, hi in zip(first, np.append(first[1:], len(bucket)), strict=True):
                for s in range(lo, hi, 1 << 20):
                    e = min(hi, s + (1 << 20))
                    docs_, at_ = np.unique(own[s:e], return_inverse=True)
                    wide = at_.astype(np.uint32) | (guest[s:e].astype(np.uint32) << np.uint32(31))
                    blobs.append((int(bucket[lo]), np.array([len(docs_)], "<u4").tobytes() + name[docs_].tobytes() + n[docs_].astype("<u4").tobytes() + wide.tobytes() + key[s:e].tobytes() + part[s:e].astype("<u2").tobytes()))
            if blobs:
                yield batch(bucket=pa.array([x for x, _ in blobs], pa.int32()), blob=pa.array([x for _, x in blobs], pa.binary()))

    return docs.select("text").mapInArrow(run, "bucket int, blob binary")


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """key, set, size, guest mark and rest (a bound from above) of each entry."""
    d = int(np.frombuffer(blob, "<u4", 1)[0])
    m = (len(blob) - 4 - 12 * d) // 14
    name = np.frombuffer(blob, np.uint64, d, 4)
    n = np.frombuffer(blob, "<u4", d, 4 + 8 * d)
    wide = np.frombuffer(blob, np.uint32, m, 4 + 12 * d)
    at = wide & np.uint32(0x7FFFFFFF)
    n = n[at].astype(np.int64)
    part = np.frombuffer(blob, "<u2", m, 4 + 12 * d + 12 * m).astype(np.int64)
    return np.frombuffer(blob, np.uint64, m, 4 + 12 * d + 4 * m), name[at], n, (wide >> np.uint32(31)).astype(bool), part * n // PARTS + (part * n % PARTS > 0)


def _partnered(group: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Whether an entry, ordered by group and size, may match any other of its group.

    The smallest partner that its size allows asks least of what it has left.
    """
    code = group * (1 << 32) + n
    first = np.searchsorted(code, group * (1 << 32) + -(-percent * n // 100))
    here = np.arange(len(n))
    other = np.where(first == here, here + 1, first)
    ok = other < len(n)
    other = np.minimum(other, len(n) - 1)
    ok &= (group[other] == group) & (percent * n[other] <= 100 * n)
    return ok & ((100 + percent) * rest >= percent * (n + n[other]))


def _lists(index: DataFrame, percent: int) -> DataFrame:
    """list, set, n: the sets that stand under one key, equal lists once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(x) for b in batches for x in b.column("blob").to_pylist()]
        if not parts:
            return
        key, name, n, guest, rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        # keys that stand alone go first: they are most of all
        order = np.argsort(key, kind="stable")
        s = key[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:]
        order = order[same]
        key, name, n, guest, rest = (x[order] for x in (key, name, n, guest, rest))
        order = np.lexsort((guest, -rest, name, n, key))
        key, name, n, guest, rest = (x[order] for x in (key, name, n, guest, rest))
        if not len(key):
            return
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, n, guest, rest = (x[new] for x in (key, name, n, guest, rest))
        for _ in range(2):
            group = np.cumsum(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            keep = _partnered(group, n, rest, percent)
            key, name, n, guest, rest = (x[keep] for x in (key, name, n, guest, rest))
        if not len(key):
            return
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        hosts = np.add.reduceat((~guest).astype(np.int64), first)
        lid = mix(np.add.reduceat(mix(name), first))
        _, once = np.unique(np.where((size > 1) & (hosts > 0), lid, 0), return_index=True)
        keep = np.zeros(len(first), bool)
        keep[once] = True
        keep &= (size > 1) & (hosts > 0)
        first, size, lid = first[keep], size[keep], lid[keep]
        if not len(first):
            return
        at = ragged(first, size)
        owner = np.repeat(np.arange(len(first)), size)
        name, n = name[at], n[at]
        for lo in range(0, len(name), 50_000):
            s = slice(lo, lo + 50_000)
            yield batch(list=signed(lid[owner[s]]), set=signed(name[s]), n=n[s])

    return index.mapInArrow(run, "list long, set long, n long")


def _zipped(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, z: the compressed text of one row of each wanted set (rk, set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield batch(rk=b.column("rk"), z=pa.array([z.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary()))

    packed = docs.select(row_key().alias("rk"), "text").mapInArrow(run, "rk binary, z binary")
    return packed.join(wanted, "rk").dropDuplicates(["rk", "set"]).select("set", "z")


def possible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches don't rule out; known: set, n, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column("na").to_numpy() + b.column("nb").to_numpy()
            d = differing(b.column("sa").to_pylist(), b.column("sb").to_pylist())
            # shared >= percent / 100 of the union leaves at most this share of both sizes to differ
            ok = pa.array((100 + percent) * d <= (100 - percent) * total)
            yield batch(a=b.column("a").filter(ok), b=b.column("b").filter(ok))

    side = lambda c: known.select(F.col("set").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity, by their whole shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            za, zb = b.column("za").to_pylist(), b.column("zb").to_pylist()
            lo = 0
            while lo < len(za):
                hi, size, texts_ = lo, 0, []
                while hi < len(za) and size < 1 << 20:
                    texts_ += [z.decompress(za[hi]), z.decompress(zb[hi])]
                    size += len(texts_[-1]) + len(texts_[-2])
                    hi += 1
                data, offs = text_buffers(pa.array(texts_, pa.binary()))
                row, value = shingles(Words(data, offs, lower=True), k)
                n = np.bincount(row, minlength=len(texts_))
                pair = row >> 1
                order = np.lexsort((value, pair))
                v, p = value[order], pair[order]
                both = np.flatnonzero((v[1:] == v[:-1]) & (p[1:] == p[:-1]))
                shared = np.bincount(p[both], minlength=hi - lo)
                union = n[0::2] + n[1::2] - shared
                ok = pa.array((100 * shared >= percent * union) & (shared > 0))
                yield batch(a=b.column("a").slice(lo, hi - lo).filter(ok), b=b.column("b").slice(lo, hi - lo).filter(ok))
                lo = hi

    small_batches(pairs.sparkSession)
    left = pairs.join(texts.select(F.col("set").alias("a"), F.col("z").alias("za")), "a")
    both = left.join(texts.select(F.col("set").alias("b"), F.col("z").alias("zb")), "b")
    return both.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _stars(apart: DataFrame, step: int) -> DataFrame:
    """a, b, na, nb: in each list one set of a component, the same one in most lists, with one set of each other."""
    one = apart.groupBy("list", "root").agg(F.min_by(F.struct("set", "n"), F.struct(F.xxhash64("set", F.lit(step)), "set")).alias("x"))
    centre = one.groupBy("list").agg(F.min_by(F.struct("root", "x"), F.struct(F.xxhash64("root", F.lit(step)), "root")).alias("c"))
    both = one.join(centre, "list").filter(F.col("root") != F.col("c.root"))
    return both.select(F.col("c.x.set").alias("a"), F.col("x.set").alias("b"), F.col("c.x.n").alias("na"), F.col("x.n").alias("nb"))


def _cells(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole cells, some thousand rows each, from batches that are ordered by the keys."""
    rest, waiting = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        rest = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        waiting += b.num_rows
        if waiting < least:
            continue
        last = np.ones(rest.num_rows, bool)
        for k in keys:
            c = rest.column(k).to_numpy()
            last &= c == c[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield rest.slice(0, cut).combine_chunks()
            rest = rest.slice(cut)
        waiting = 0
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _judge(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a table of cells that neither sizes nor sketches rule out."""
    cell_keys = [t.column(c).to_numpy() for c in ("list", "lo", "hi")]
    root, block, n = (t.column(c).to_numpy() for c in ("root", "block", "n"))
    # cells side by side, within them the sets of one component: partners are the rows of the cell beyond it
    order = np.lexsort((root, *cell_keys[::-1]))
    cell_keys, root, block, n = [k[order] for k in cell_keys], root[order], block[order], n[order]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in cell_keys], axis=0)) if len(order) else np.zeros(0, bool)
    run = new | np.append(True, root[1:] != root[:-1]) if len(order) else new
    ends = lambda flags: np.append(np.flatnonzero(flags)[1:], len(flags))[np.cumsum(flags) - 1]
    cell_end, run_end = ends(new), ends(run)
    data, offs = text_buffers(t.column("sketch").take(pa.array(order)))
    words = np.frombuffer(data[offs[0] : offs[-1]].tobytes(), np.uint64)
    offs, size = (offs[:-1] - offs[0]) >> 3, np.diff(offs) >> 3
    across = cell_keys[1] != cell_keys[2]
    count, found = cell_end - run_end, []
    steps = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + 1, 1 << 19)) if len(count) else []
    bounds = np.unique(np.append(steps, len(count)).astype(np.int64))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        j = ragged(run_end[lo:hi], count[lo:hi])
        ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (~across[i] | (block[i] != block[j]))
        i, j = i[ok], j[ok]
        swap = size[i] > size[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        for p, q in {*zip(size[i].tolist(), size[j].tolist(), strict=True)}:
            at = np.flatnonzero((size[i] == p) & (size[j] == q))
            for s in range(0, len(at), max(1, (1 << 20) // q)):
                x, y = i[at[s : s + max(1, (1 << 20) // q)]], j[at[s : s + max(1, (1 << 20) // q)]]
                folded = np.bitwise_xor.reduce(words[offs[y][:, None] + np.arange(q)].reshape(len(y), -1, p), axis=1)
                d = np.bitwise_count(words[offs[x][:, None] + np.arange(p)] ^ folded).sum(axis=1).astype(np.int64)
                # shared >= percent / 100 of the union leaves at most this share of both sizes to differ
                may = (100 + percent) * d <= (100 - percent) * (n[x] + n[y])
                found.append((order[x[may]], order[y[may]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _across(apart: DataFrame, standing: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b: the sets of a list that are still in different components, but for those that can't be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(batches, ["list", "lo", "hi"]):
            i, j = _judge(t, percent)
            if not len(i):
                continue
            used, back = np.unique(np.append(i, j), return_inverse=True)
            # the lists before this one in which each set stands
            own = [set(x) for x in t.column("own").take(pa.array(used)).to_pylist()]
            first = np.fromiter((own[a].isdisjoint(own[b]) for a, b in zip(back[: len(i)].tolist(), back[len(i) :].tolist(), strict=True)), bool, len(i))
            sets = t.column("set").to_numpy()
            yield batch(a=np.minimum(sets[i[first]], sets[j[first]]), b=np.maximum(sets[i[first]], sets[j[first]]))

    spark = apart.sparkSession
    size = apart.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # the least lists of a set are enough: a pair leaves the first list it shares, and a few others if that is none of these
    own = apart.groupBy("set").agg(F.slice(F.array_sort(F.collect_list("list")), 1, OWN).alias("all"))
    rows = apart.join(size, "list").join(own.join(standing.select("set", "sketch"), "set"), "set")
    rows = rows.withColumn("block", F.pmod(F.hash("set"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("own", F.filter("all", lambda z: z < F.col("list")))
    rows = rows.select("list", "set", "n", "root", "sketch", "own", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    dealt = rows.repartition(partitions(spark), "list", "lo", "hi").sortWithinPartitions("list", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long")


def _merged(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root: the components that links (a, b) make of those found so far; only links between these are followed."""
    if found is None:
        return components(links)
    at = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left")
    between = between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct()
    more = written(components(written(between, "between")), "merged").select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = found.join(more, found.root == more.old, "left").select("node", F.coalesce("new", "root").alias("root"))
    return moved.union(more.join(found.select("node"), more.old == found.node, "left_anti").select("old", "new"))


def link(docs: DataFrame, k: int = 5, percent: int = 75, combine: int = 12, frequent: int = 64, class_size: int = 100_000, rounds: int = 2, block: int = 512) -> DataFrame:
    """doc_id, rk, n_shingles and component_id of each row, and kept, the row key of the row that stands for its component."""
    spark = docs.sparkSession
    small_batches(spark)
    m = written(measure(docs, k, class_size), "sets")
    rows = m.filter("kind = 0").select("doc_id", "rk", F.when(F.col("n") > 0, F.col("set")).alias("set"), "n")
    # at most class_size tokens come to the driver
    top = m.filter("kind = 1").groupBy("set").agg(F.sum("n").alias("n")).filter(F.col("n") >= frequent).orderBy(F.desc("n"), "set").limit(class_size)
    top = sorted((int(r.n), int(r.set) & (2**64 - 1)) for r in top.collect())
    token = np.array([t for _, t in top], np.uint64)
    order = np.argsort(token)
    ranks = (token[order], order.astype(np.int64))
    buckets = 2 * partitions(spark)
    index = _index(docs, k, percent, ranks, combine, buckets).repartition(partitions(spark), "bucket")
    members = written(written(_lists(index, percent), "lists").distinct(), "members")
    # one row stands for each set of a list
    standing = m.filter("kind = 0").join(members.select("set").distinct(), "set", "left_semi")
    standing = written(standing.select("set", "rk", "n", "sketch").dropDuplicates(["set"]), "standing")
    texts = written(_zipped(docs, standing.select("rk", "set")), "texts")

    def placed(found: DataFrame | None) -> DataFrame:
        """The lists that hold sets of several components, with these."""
        if found is None:
            at = members.withColumn("root", F.col("set"))
        else:
            at = members.join(found, members.set == found.node, "left").select("list", "set", "n", F.coalesce("root", "set").alias("root"))
        several = at.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("list")
        return written(at.join(several, "list", "left_semi"), "apart")

    found = None
    for step in range(rounds):
        pairs = _stars(placed(found), step).filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        found = written(_merged(found, written(verify(written(possible(pairs, standing, percent), "possible"), texts, k, percent), "links")), "components")
    found = written(_merged(found, written(verify(written(_across(placed(found), standing, percent, block), "possible"), texts, k, percent), "links")), "components")

    # the least doc_id of each component, then back to rows; a set held by many rows is salted
    held = rows.filter("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "rk")).alias("one"), F.count("*").alias("c"))
    root = held.join(found, held.set == found.node, "left").select("set", "least", "one", "c", F.coalesce("root", "set").alias("root"))
    names = root.groupBy("root").agg(F.min("least").alias("component_id"), F.min("one").alias("one"), F.sum("c").alias("c")).filter("c > 1")
    named = root.select("set", "root").join(names, "root").select("set", "component_id", F.col("one.rk").alias("kept"))
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("salt", F.pmod(F.hash("rk", "doc_id"), F.lit(SALTS))).join(named, ["set", "salt"], "left")
    return out.select("doc_id", "rk", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("kept", "rk").alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, with all its columns: the one with the least doc_id, then the least row key.

    Rows without a link stay, whatever their doc_id; of rows equal in doc_id and text one stays.
    """
    keep = link(docs, **options).filter("rk = kept").select("rk").distinct()
    key = free_name(docs, "rk")
    return docs.withColumn(key, row_key()).join(keep.withColumnRenamed("rk", key), key, "left_semi").dropDuplicates([key]).drop(key)
