"""Approximate nearest neighbours by cosine: NN-descent graphs and greedy search on them.

Rows are dealt to shards by a hash of their vector, so equal vectors meet: they are one node, which keeps its `members`
smallest ids, enough to answer any query of that many neighbours. Copies within an Arrow batch are joined before rows
are dealt, so a vector that a third of all rows share is a few rows for its shard. A shard is one task's work, bounded in
rows and bytes, and has a graph of its own. The graph starts from small leaves of random trees with median cuts. Each
round of NN-descent compares a node's neighbours, in both directions, with each other: the new ones with all, the others
only with new ones, a sample of fixed size of each, as the method has it. Rounds end when few edges change. The index is
a written table of nodes with their lists; nodes that few lists name are added to those of their neighbours.

A query walks every shard's graph greedily: it keeps the `beam` best nodes it has seen, and each step expands the best
ones not yet expanded, until none is left. It starts from its own node, if the shard holds its vector, and from the best
of a bounded sample of others. So each row can be found in its shard; the best of all shards are the result. Recall is
measured against brute force in the tests.

Work for a query grows with the shards, and they with the rows once shards are of full size. Graph and walk are in single
precision, but in double in a shard that has near copies, and what a walk finds is scored anew in double.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, neither
as rows nor as queries. Equal scores: the smaller id first. Rows that repeat an id: each is a member. Fewer rows than
neighbours asked for: all of them. Empty table: empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, batch, long_binary, mix, written

SALTS = 16
#: Rows of a shard at least, so that graphs are worth it; shards until they reach the bytes of vectors that one may hold.
LEAST, SPREAD, SHARD_BYTES = 8192, 12, 24 << 20
#: Neighbours nearer than this to one are near copies: single precision can't tell them apart.
NEAR_COPY = 1 - 1e-4
NONE = -3.0
#: The place of queries, which come after all nodes of a shard.
LAST = 2**31 - 1


def valid(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id and vec (doubles) of the rows that take part."""
    x = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")).filter("id IS NOT NULL")
    fine = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0)
    return x.filter(fine)


def _given(df: DataFrame, id_column: str, vector: str) -> tuple[DataFrame, str]:
    """id and vec, and how vectors are packed: floats as floats, all else as doubles, so nothing is lost and near copies stay apart."""
    single = df.schema[vector].dataType.simpleString() == "array<float>"
    vec = F.col(vector) if single else F.col(vector).cast("array<double>")
    return df.select(F.col(id_column).cast("long").alias("id"), vec.alias("vec")), "<f4" if single else "<f8"


def _parts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components, start, length) of the rows that take part; of others the length is 0."""
    vec = b.column("vec")
    ends = vec.offsets.to_numpy().astype(np.int64)
    x = vec.values.to_numpy(zero_copy_only=False)  # nulls become NaN
    start, length = ends[:-1], np.diff(ends)
    bad, some = np.append(0, np.cumsum(~np.isfinite(x))), np.append(0, np.cumsum(x != 0))
    fine = (bad[ends[1:]] == bad[start]) & (some[ends[1:]] > some[start])
    for c in (vec, b.column("id")):
        fine &= c.is_valid().to_numpy(zero_copy_only=False)
    return x, start, np.where(fine, length, 0)


def _hash(x: np.ndarray) -> np.ndarray:
    """64 bits of each row of packed components."""
    words = x.view(np.uint32 if x.itemsize == 4 else np.uint64).astype(np.uint64)
    return mix((mix(words) * (mix(np.arange(1, x.shape[1] + 1, dtype=np.uint64)) | U(1))).sum(axis=1, dtype=np.uint64))


def _same(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of one of each distinct row, the number of each row's); rows are compared byte by byte."""
    _, at, which = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}").ravel(), return_index=True, return_inverse=True)
    return at, which.ravel()


def _least(which: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many) of the `count` least ids of each number, one after another."""
    order = np.lexsort((ids, which))
    which = which[order]
    first = np.arange(len(which)) - np.searchsorted(which, which) < count
    return ids[order][first], np.bincount(which[first])


def _unit(x: np.ndarray, dtype) -> np.ndarray:
    """Rows of length one."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x.astype(dtype)


def _top(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, in no order."""
    width = score.shape[1]
    return np.argpartition(score, width - k, axis=1)[:, width - k :] if k < width else np.broadcast_to(np.arange(width), score.shape)


def _merge(near: np.ndarray, score: np.ndarray, age: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct entries of each row; -1 is none. Of two equal ones, the one of less age (0 to 2) stays."""
    take = np.take_along_axis
    order = np.argsort(near * 4 + age, axis=1)
    near, score, age = take(near, order, 1), take(score, order, 1), take(age, order, 1)
    score[:, 1:][near[:, 1:] == near[:, :-1]] = NONE
    score[near < 0] = NONE
    best = _top(score, k)
    near, score, age = take(near, best, 1), take(score, best, 1), take(age, best, 1)
    near[score == NONE] = -1
    return near, score, np.where(near >= 0, age, 0)


def _padded(key: np.ndarray, rank: np.ndarray, rows: int, *columns: tuple[np.ndarray, float]) -> list[np.ndarray]:
    """Each column as a table: a row for each key, values at their rank, else the filler."""
    out = []
    for values, filler in columns:
        x = np.full((rows, int(rank.max(initial=-1)) + 1), filler, values.dtype)
        x[key, rank] = values
        out.append(x)
    return out


def _named_by(lists: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """A sample of at most `most` of the nodes that name each node in their list; -1 is none."""
    at = np.flatnonzero(lists >= 0)
    node, other = at // max(1, lists.shape[1]), lists.ravel()[at]
    order = np.argsort(other.astype(np.uint64) << U(32) | rng.integers(0, 1 << 32, len(other), np.uint64))
    node, other = node[order], other[order]
    rank = np.arange(len(other)) - np.searchsorted(other, other)
    fits = rank < most
    out = np.full((len(lists), most), -1, np.int32)
    out[other[fits], rank[fits]] = node[fits]
    return out


def _seed(x: np.ndarray, k: int, trees: int, leaf: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """First lists: the best of each node within its leaf of each tree. Each level cuts every part at the median along a direction."""
    n, dim = x.shape
    near, score = np.full((n, k), -1, np.int32), np.full((n, k), NONE, x.dtype)
    leaf = min(leaf, n)
    levels = int(np.ceil(np.log2(n / leaf)))
    starts, few, block = np.minimum(np.arange(0, n, leaf), n - leaf), min(k, 8, leaf - 1), max(1, (1 << 20) // leaf**2)
    for _ in range(trees):
        along, order = x @ rng.normal(size=(dim, levels)).astype(x.dtype), np.arange(n)
        for level in range(levels):
            order = order[np.lexsort((along[order, level], np.arange(n) * (1 << level) // n))]
        for lo in range(0, len(starts), block):
            rows = order[starts[lo : lo + block, None] + np.arange(leaf)]
            v = x[rows]
            s = v @ v.transpose(0, 2, 1)
            s[:, np.arange(leaf), np.arange(leaf)] = NONE
            s = s.reshape(-1, leaf)
            at = _top(s, few)
            node, first = np.unique(rows, return_index=True)  # the last leaf overlaps the one before
            ids = np.take_along_axis(np.repeat(rows, leaf, 0), at, 1)[first].astype(np.int32)
            found = np.concatenate([near[node], ids], 1), np.concatenate([score[node], np.take_along_axis(s, at, 1)[first]], 1)
            near[node], score[node], _ = _merge(*found, np.zeros(found[0].shape, np.int8), k)
    return near, score


class _Lists:
    """The best k of each node, with whether they are new, and proposals that wait to be taken in."""

    def __init__(self, near: np.ndarray, score: np.ndarray):
        self.near, self.score, self.new = near, score, near >= 0
        self.bar, self.waiting, self.size, self.changed = score.min(axis=1), [], 0, 0

    def propose(self, node: np.ndarray, other: np.ndarray, score: np.ndarray) -> None:
        good = score > self.bar[node]
        self.waiting.append((node[good], other[good], score[good]))
        self.size += len(self.waiting[-1][0])
        if self.size > 1_500_000:
            self.settle()

    def settle(self) -> None:
        if not self.size:
            return
        node, other, score = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.size, k = [], 0, self.near.shape[1]
        if score.dtype == np.float32:  # node and falling score in one number, which sorts faster
            order = np.argsort(node.astype(np.uint64) << U(32) | (np.float32(2) - score).view(np.uint32))
        else:
            order = np.lexsort((other, -score, node))
        node, other, score = node[order], other[order], score[order]
        once = np.append(True, (node[1:] != node[:-1]) | (other[1:] != other[:-1]))
        node, other, score = node[once], other[once], score[once]
        rank = np.arange(len(node)) - np.searchsorted(node, node)
        fits = rank < k
        rows, which = np.unique(node[fits], return_inverse=True)
        ids, s = _padded(which, rank[fits], len(rows), (other[fits].astype(np.int32), -1), (score[fits], NONE))
        for lo in range(0, len(rows), 20_000):
            r, i, v = rows[lo : lo + 20_000], ids[lo : lo + 20_000], s[lo : lo + 20_000]
            # of age 0 if compared, 1 if not, 2 for proposals
            near, best, age = _merge(np.concatenate([self.near[r], i], 1), np.concatenate([self.score[r], v], 1), np.concatenate([self.new[r].astype(np.int8), np.full(i.shape, 2, np.int8)], 1), k)
            self.changed += int((age == 2).sum())
            self.near[r], self.score[r], self.new[r], self.bar[r] = near, best, age > 0, best.min(axis=1)


def _descend(x: np.ndarray, near: np.ndarray, score: np.ndarray, sample: int, delta: float, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Rounds of NN-descent, until one changes at most `delta` of the entries."""
    n, k = near.shape
    lists, sample = _Lists(near, score), min(sample, k)
    width = 2 * sample
    # new ones with each other once, and with the others
    pairs = np.concatenate([np.triu(np.ones((width, width), bool), 1), np.ones((width, width), bool)], 1)
    for _ in range(rounds):
        chance = rng.random((n, k), np.float32)

        def drawn(among: np.ndarray, chance=chance) -> tuple[np.ndarray, np.ndarray]:
            at = _top(np.where(among, chance, -1), sample)
            return at, np.where(np.take_along_axis(among, at, 1), np.take_along_axis(lists.near, at, 1), -1)

        at, new = drawn(lists.new)
        _, old = drawn((lists.near >= 0) & ~lists.new)
        np.put_along_axis(lists.new, at, False, 1)
        new, old = (np.concatenate([f, _named_by(f, sample, rng)], 1) for f in (new, old))
        lists.changed, hubs = 0, np.flatnonzero((new >= 0).any(axis=1))
        for lo in range(0, len(hubs), 256):
            ids = np.concatenate([new[hubs[lo : lo + 256]], old[hubs[lo : lo + 256]]], 1)
            v = x[ids]
            s = v[:, :width] @ v.transpose(0, 2, 1)
            bar = np.where(ids >= 0, lists.bar[ids], 9).astype(x.dtype)
            good = (s > np.minimum(bar[:, :width, None], bar[:, None, :])) & pairs
            at = np.flatnonzero(good)
            row, j = at // (2 * width), at % (2 * width)
            q = row // width
            a, b, s = ids.ravel().take(q * (2 * width) + row % width), ids.ravel().take(q * (2 * width) + j), s.ravel().take(at)
            real = (a != b) & (a >= 0) & (b >= 0)
            a, b, s = a[real], b[real], s[real]
            lists.propose(a, b, s)
            lists.propose(b, a, s)
        lists.settle()
        if lists.changed <= delta * n * k:
            return lists.near
    raise RuntimeError("the graph did not settle")


def _graph(x: np.ndarray, k: int, fan: int, sample: int, delta: float, rounds: int, trees: int, leaf: int) -> tuple[np.ndarray, bool]:
    """The places to which each row of x leads (-1 is none), and whether the rows need double precision."""
    rng, n = np.random.default_rng(11), len(x)
    if n < 2:
        return np.full((n, 0), -1, np.int32), True
    k = min(k, n - 1)
    unit = _unit(x, np.float32)
    near, score = _seed(unit, k, trees, leaf, rng)
    wide = bool(score.max() > NEAR_COPY)
    if wide:
        unit = _unit(x, np.float64)
        near, score = _seed(unit, k, trees, leaf, rng)
    near = _descend(unit, near, score, sample, delta, rounds, rng)
    # the other direction where few lead to a node: most are named by many, and wider lists made walks longer but hardly better
    rare = np.bincount(near[near >= 0], minlength=n) < fan
    return np.concatenate([near, _named_by(np.where(rare[:, None], near, -1), fan, rng)], 1), wide


def _walk(x: np.ndarray, lists: np.ndarray, query: np.ndarray, start: np.ndarray, beam: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The best nodes that each query sees, and their scores; -1 is none. Each step expands nodes not expanded before, so it ends."""
    n, take = len(x), np.take_along_axis
    ids, score, done = np.full((len(query), beam), -1, np.int64), np.full((len(query), beam), NONE, x.dtype), np.ones((len(query), beam), bool)
    seen = np.zeros(len(query) * n, bool)
    q, to = np.repeat(np.arange(len(query)), start.shape[1]), start.ravel().astype(np.int64)
    while True:
        fresh = to >= 0
        q, to = q[fresh], to[fresh]
        key = q * n + to
        fresh = ~seen.take(key)
        q, to, key = q[fresh], to[fresh], key[fresh]
        seen[key] = True
        ends, far, s = np.searchsorted(q, np.arange(len(query) + 1)), x.take(to, axis=0), np.empty(len(q), x.dtype)
        for i in np.flatnonzero(ends[1:] > ends[:-1]):
            np.dot(far[ends[i] : ends[i + 1]], query[i], out=s[ends[i] : ends[i + 1]])
        good = s > score.min(axis=1)[q]
        _, once = np.unique(key[good], return_index=True)  # some came twice; they stay ordered by query
        q, to, s = q[good][once], to[good][once], s[good][once]
        if len(q):
            more, at = _padded(q, np.arange(len(q)) - np.searchsorted(q, q), len(query), (to, -1), (s, NONE))
            ids, score, done = np.concatenate([ids, more], 1), np.concatenate([score, at], 1), np.concatenate([done, more < 0], 1)
            best = _top(score, beam)
            ids, score, done = take(ids, best, 1), take(score, best, 1), take(done, best, 1)
        open_ = np.where(done, NONE - 1, score)
        at = _top(open_, min(step, beam))
        row, place = np.nonzero(take(open_, at, 1) >= NONE)
        if not len(row):
            return ids, score
        node = take(ids, at, 1)[row, place]
        np.put_along_axis(done, at, True, 1)
        q, to = np.repeat(row, lists.shape[1]), lists[node].ravel().astype(np.int64)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Along the last axis, one component after another."""
    out = a[..., 0] * b[..., 0]
    for i in range(1, a.shape[-1]):
        out = out + a[..., i] * b[..., i]
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Doubles times a power of two that brings the largest component near one: exact, so squares neither vanish nor overflow."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Each shard with its batches, from batches that are ordered by shard."""
    rest: list[pa.RecordBatch] = []

    def run(shard: int) -> Iterator[pa.RecordBatch]:
        while rest or (b := next(batches, None)) is not None:
            b = rest.pop() if rest else b
            s = b.column("shard").to_numpy()
            cut = int(np.searchsorted(s, shard, "right"))
            if cut:
                yield b.slice(0, cut)
            if cut < len(s):
                rest.append(b.slice(cut))
                return

    while rest or (b := next(batches, None)) is not None:
        if not rest:
            rest.append(b)
        if not rest[0].num_rows:
            rest.pop()
            continue
        shard = rest[0].column("shard")[0].as_py()
        mine = run(shard)
        yield shard, mine
        for _ in mine:
            pass


def _bytes(column: pa.Array) -> np.ndarray:
    """All values of a binary column, one after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)


def _cells(values: np.ndarray) -> pa.Array:
    """A binary value for each row."""
    return long_binary(np.ascontiguousarray(values).ravel(), np.full(len(values), values.shape[1]))


def breadth(rows: int) -> int:
    """Nodes in the beam of a walk: grows with the square root of a shard's rows, as near ones are harder to reach."""
    return max(96, round(112 * np.sqrt(rows / 40_000)))


class Index:
    """A written table of nodes: shard, place (in the shard), node (its least id), members (its smallest ids, packed), unit (its vector, packed), near (places of its list, packed), wide."""

    def __init__(self, table: DataFrame, shards: int, dim: int, members: int, kind: str):
        self.table, self.shards, self.dim, self.members, self.kind = table, shards, dim, members, kind

    @property
    def graph(self) -> DataFrame:
        """node, other: the edges that walks follow."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, parts in _shards(batches):
                t = pa.Table.from_batches(list(parts))
                node = t.column("node").to_numpy()
                at = np.concatenate([np.frombuffer(v, np.int32) for v in t.column("near").to_pylist()])
                own = np.repeat(node, [len(v) // 4 for v in t.column("near").to_pylist()])
                yield batch(node=own[at >= 0], other=node[at[at >= 0]])

        t = self.table.select("shard", "place", "node", "near").repartitionById(self.shards, F.col("shard")).sortWithinPartitions("shard", "place")
        return t.mapInArrow(run, "node long, other long").distinct()


TABLE = "shard int, place int, node long, members binary, unit binary, near binary, wide boolean"


def build(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", members: int = 6, k: int = 48, fan: int = 16, delta: float = 0.01, rounds: int = 30, trees: int = 8, leaf: int = 128, sample: int = 10) -> Index:
    """The graph of a shard is settled when a round changes at most `delta` of its edges."""
    given, kind = _given(df, id_column, vector)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, n = np.unique(_parts(b)[2], return_counts=True)
            yield batch(d=d.astype(np.int64), n=n.astype(np.int64))

    most = given.mapInArrow(sizes, "d long, n long").filter("d > 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").first()
    dim, total = (most.d, most.n) if most else (1, 0)
    shards = max(1, min(SPREAD, round(total / LEAST)), -(-total * dim * 4 // SHARD_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, start, length = _parts(b)
            rows = np.flatnonzero(length == dim)
            if not len(rows):
                continue
            x = x[start[rows, None] + np.arange(dim)].astype(kind) + np.zeros(1, kind)  # one zero only
            at, which = _same(x)
            ids, held = _least(which, b.column("id").to_numpy(zero_copy_only=False)[rows].astype(np.int64), members)
            yield batch(shard=(_hash(x[at]) % U(shards)).astype(np.int32), members=long_binary(ids, held), unit=_cells(x[at]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in _shards(batches):
            raw, ids, held = [], [], []
            for b in parts:
                raw.append(_bytes(b.column("unit")).view(kind))
                ids.append(_bytes(b.column("members")).view(np.int64))
                held.append(np.diff(np.frombuffer(b.column("members").buffers()[1], np.int32)[b.column("members").offset :][: b.num_rows + 1]) // 8)
            x = np.concatenate(raw).reshape(-1, dim)
            del raw
            at, which = _same(x)
            ids, held = _least(np.repeat(which, np.concatenate(held)), np.concatenate(ids), members)
            x = x[at]
            near, wide = _graph(x, k, fan, sample, delta, rounds, trees, leaf)
            ends = np.append(0, np.cumsum(held))
            for lo in range(0, len(x), 5000):
                hi = min(len(x), lo + 5000)
                place = np.arange(lo, hi, dtype=np.int32)
                packed = long_binary(ids[ends[lo] : ends[hi]], held[lo:hi])
                yield batch(shard=np.full(hi - lo, shard, np.int32), place=place, node=ids[ends[lo:hi]], members=packed, unit=_cells(x[lo:hi]), near=_cells(near[lo:hi]), wide=np.full(hi - lo, wide))

    dealt = given.mapInArrow(pack, "shard int, members binary, unit binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    return Index(written(dealt.mapInArrow(index, TABLE), "index"), shards, dim, members, kind)


def search(index: Index, queries: DataFrame, count: int, beam: int | None = None, step: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest of each query (id, vec) among rows with another id.

    count is at most one less than the members that the index keeps of equal vectors.
    """
    if count >= index.members:
        raise ValueError(f"the index keeps {index.members} ids of equal vectors, too few for {count} neighbours: build it with members={count + 1}")
    dim, kind, shards = index.dim, index.kind, index.shards
    asked = queries.filter(F.size("vec") == dim).select("id", F.transform("vec", lambda v: v + F.lit(0.0)).alias("vec"))
    # queries with one vector walk once
    q = written(asked.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("query", F.monotonically_increasing_id()), "queries")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(v, np.float64) for v in b.column("vec").to_pylist()]
            with np.errstate(over="ignore"):
                short = [v.astype(np.float32) for v in x]
            yield batch(node=b.column("query"), unit=pa.array([(s if (s == v).all() else v).tobytes() for s, v in zip(short, x, strict=True)], pa.binary()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _shards(batches):
            held, asked = [], []
            for b in parts:
                first = int((b.column("place").to_numpy() < LAST).sum())
                held.append(b.slice(0, first))
                if first < b.num_rows:
                    asked.append(b.slice(first))
                    break
            if not asked:
                continue
            raw = np.concatenate([_bytes(b.column("unit")).view(kind) for b in held]).reshape(-1, dim) if sum(b.num_rows for b in held) else np.zeros((0, dim), kind)
            if not len(raw):
                continue
            near = np.concatenate([_bytes(b.column("near")).view(np.int32) for b in held]).reshape(len(raw), -1)
            members = [v for b in held for v in b.column("members").to_pylist()]
            node = np.concatenate([b.column("node").to_numpy() for b in held])
            x = _unit(raw, np.float64 if next(b for b in held if b.num_rows).column("wide")[0].as_py() else np.float32)
            del held
            hashed = _hash(raw)
            by = np.argsort(hashed)
            rng = np.random.default_rng(9)
            some = rng.permutation(len(raw))[: min(4096, max(256, len(raw) // 16))]
            room = max(1, min(256, (1 << 25) // len(raw)))
            width = max(beam or breadth(len(raw)), 4 * (count + 1))

            def answer(b: pa.RecordBatch, width=width, raw=raw, near=near, members=members, node=node, x=x, hashed=hashed, by=by, some=some) -> pa.RecordBatch:
                given = np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in b.column("unit").to_pylist()], np.float64)
                unit = _unit(given, x.dtype)
                near_some = unit @ x[some].T
                start = some[_top(near_some, min(8, len(some)))]
                with np.errstate(over="ignore"):
                    mine = given.astype(kind)
                at = by[np.minimum(np.searchsorted(hashed, _hash(mine), sorter=by), len(by) - 1)]
                own = np.where((raw[at] == mine).all(axis=1), at, -1)
                ids, score = _walk(x, near, unit, np.concatenate([own[:, None], start], 1), width, step)
                # the exact measure, in doubles on the vectors as given, of more than are wanted
                best = _top(score, 4 * (count + 1))
                ids = np.take_along_axis(ids, best, 1)
                v, m = _scaled(raw[ids]), _scaled(given)[:, None, :]
                exact = np.where(ids >= 0, _dot(m, v) / (np.sqrt(_dot(m, m)) * np.sqrt(_dot(v, v))), -np.inf)
                order = np.lexsort((node[ids], -exact), axis=1)[:, : count + 1]
                ids, exact = np.take_along_axis(ids, order, 1), np.take_along_axis(exact, order, 1)
                r, c = np.nonzero(ids >= 0)
                found = [np.frombuffer(members[i], np.int64) for i in ids[r, c]]
                held = [len(f) for f in found]
                return batch(query=np.repeat(b.column("node").to_numpy()[r], held), d=np.repeat(-exact[r, c], held), vec_id=np.concatenate(found))

            for b in (b for source in (asked, parts) for b in source):
                for lo in range(0, b.num_rows, room):
                    yield answer(b.slice(lo, room))

    each = q.mapInArrow(pack, "node long, unit binary").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "node", "unit")
    none = [F.lit(None).cast(kind_).alias(name) for name, kind_ in (("members", "binary"), ("near", "binary"), ("wide", "boolean"))]
    columns = ["shard", "place", "node", "members", "unit", "near", "wide"]
    each = each.select("*", F.lit(LAST).alias("place"), *none).select(columns)
    dealt = index.table.select(columns).union(each).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place")
    pair = dealt.mapInArrow(walk, "query long, d double, vec_id long")
    # one more than asked for, as a query leaves itself out
    top = pair.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "vec_id"))), 1, count + 1).alias("x")).join(q, "query")
    alone = top.filter("n = 1").select("id", "x")
    shared = top.filter("n > 1").select("vec", "x", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    several = asked.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(shared, ["vec", "salt"]).select("id", "x")
    found = alone.union(several)
    found = found.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("x", lambda e: e["vec_id"] != F.col("id")), 1, count)).alias("p", "x"))
    return found.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.d")).alias("score"))
