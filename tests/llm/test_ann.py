import numpy as np
import pytest

from triagelake.llm import ann


def brute(ids, x, queries, count):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        i = ids.index(q)
        s = u @ u[i]
        order = np.lexsort((ids, -np.round(s, 12)))
        out[q] = [(ids[j], s[j]) for j in order if ids[j] != q][:count]
    return out


def frame(spark, ids, x, extra=()):
    rows = [(int(i), [float(c) for c in v], "z") for i, v in zip(ids, x, strict=True)]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<double>, node string")


def run(df, every, count):
    index = ann.build(df)
    q = ann.valid(df, "vec_id", "embedding").filter(f"id % {every} = 0")
    found = {}
    for r in ann.search(index, q, count).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in found.items()}


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall(spark, clusters):
    r = np.random.default_rng(5)
    n = 3000
    x = r.normal(size=(n, 24))
    if clusters:
        x = r.normal(size=(clusters, 24))[r.integers(0, clusters, n)] + 0.3 * x
    x[100:400] = x[100]
    ids = list(range(n))
    bad = [(10_000, None, "z"), (10_050, [0.0] * 24, "z"), (10_100, [float("nan")] * 24, "z"), (10_150, [None] * 24, "z"), (10_200, [1.0], "z"), (None, [1.0] * 24, "z")]
    got = run(frame(spark, ids, x, bad), 50, 5)
    want = brute(ids, x, [i for i in ids if i % 50 == 0], 5)
    assert set(got) == set(want)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    for q in want:
        assert [p for p, _, _ in got[q]] == [1, 2, 3, 4, 5]
        if 100 <= q < 400:
            assert [v for _, v, _ in got[q]] == [v for v in range(100, 107) if v != q][:5]
        u = x[q] / np.linalg.norm(x[q])
        assert all(abs(s - u @ x[v] / np.linalg.norm(x[v])) < 1e-12 for _, v, s in got[q])


@pytest.mark.parametrize("noise", [0.01, 1e-4])
def test_tight_cluster(spark, noise):
    r = np.random.default_rng(6)
    n = 5000
    x = r.normal(size=64) + noise * r.normal(size=(n, 64))
    ids = list(range(n))
    got = run(frame(spark, ids, x), 50, 5)
    want = brute(ids, x, [i for i in ids if i % 50 == 0], 5)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_rounds_settle_the_graph(spark):
    r = np.random.default_rng(7)
    n = 4000
    x = r.normal(size=(n, 24))
    index = ann.build(frame(spark, range(n), x), trees=2, leaf=4)  # so poor a start that the rounds must find the neighbours
    edges = {(e.node, e.other) for e in index.graph.collect()}
    want = brute(list(range(n)), x, range(0, n, 20), 10)
    hits = sum((q, v) in edges for q in want for v, _ in want[q])
    assert hits >= 0.9 * 10 * len(want)


def test_few_rows(spark):
    x = np.array([[1.0, 0], [1, 1], [0, 1]])
    got = run(frame(spark, [0, 50, 7], x), 50, 5)
    assert [v for _, v, _ in got[0]] == [50, 7] and [v for _, v, _ in got[50]] == [0, 7]
    assert run(frame(spark, [0], x[:1]), 50, 5) == {}
    assert run(frame(spark, [], x[:0]), 50, 5) == {}


def test_very_small_and_large_components(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(60, 8))
    ids = list(range(60))
    scaled = x * np.array([1e-200, 1e200, 1.0, 5e-300, 1e150] * 12)[:, None]
    got, want = run(frame(spark, ids, scaled), 10, 5), brute(ids, x, range(0, 60, 10), 5)
    for q, found in got.items():
        assert [v for _, v, _ in found] == [v for v, _ in want[q]] and np.allclose([s for _, _, s in found], [s for _, s in want[q]])


def test_more_neighbours_than_kept_ids(spark):
    df = frame(spark, list(range(31)), np.array([[1.0, 0.0]] * 30 + [[0.0, 1.0]]))
    q = ann.valid(df, "vec_id", "embedding").filter("id = 0")
    with pytest.raises(ValueError, match="members=21"):
        ann.search(ann.build(df), q, 20)
    assert [r.vec_id for r in ann.search(ann.build(df, members=21), q, 20).orderBy("rank").collect()] == list(range(1, 21))


def shuffled(spark):
    """Rows that all stages so far have dealt."""
    gateway = spark.sparkContext._gateway
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_rows_are_dealt_few_times(spark):
    r = np.random.default_rng(9)
    df = frame(spark, range(3000), r.normal(size=(3000, 24)))
    before = shuffled(spark)
    run(df, 50, 5)
    assert 3000 <= shuffled(spark) - before <= 10 * 3000  # to the graph and to the walks, not for each edge and round


@pytest.mark.parametrize("scale", [1.0, 1e-4])
def test_many_shards(spark, monkeypatch, scale):
    monkeypatch.setattr(ann, "LEAST", 250, raising=False)
    r = np.random.default_rng(10)
    n = 3000
    x = r.normal(size=(30, 16))[r.integers(0, 30, n)] + scale * r.normal(size=(n, 16))
    x[::3] = x[0]  # a third of all rows are one vector, asked for by many
    ids = [int(i) for i in r.permutation(n)]
    index = ann.build(frame(spark, ids, x))
    assert index.shards == 12 and {row.shard for row in index.table.select("shard").distinct().collect()} == set(range(12))
    assert index.table.count() == 2001
    got = run(frame(spark, ids, x), 50, 5)
    want = brute(ids, x, [i for i in ids if i % 50 == 0], 5)
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.95 * 5 * len(want)
    same = sorted(ids[::3])
    for q in set(same) & set(got):
        assert [v for _, v, _ in got[q]] == [v for v in same if v != q][:5]
