import numpy as np

from triagelake.llm import mixing
from triagelake.llm.subword import Model


def brute(p, n, target, most, rounds=200_000):
    """Plain projected gradient over all rates, scaled by 1 / n."""
    r, a = np.ones(len(p)), p * n[:, None]
    eta = 0.9 / np.linalg.eigvalsh(a.T @ p).max()
    for _ in range(rounds):
        r = np.clip(r - eta * p @ (a.T @ r - target), 0, most)
    return np.sum((a.T @ r - target) ** 2)


def test_solver_meets_targets(spark):
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([0.3, 0.5, 0.2], 400), rng.integers(1, 900, 400).astype(float)
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "tokens long, p array<double>")
    for weights, most in (([0.2, 0.7, 0.1], np.inf), ([0.05, 0.9, 0.05], 1.0), ([0.1, 0.8, 0.1], 3.0)):
        steps, have, target = mixing.solve(df, weights, most=most)
        r = mixing.rates(p, steps, most)
        assert (r >= 0).all() and (r <= most).all() and np.allclose((r * n) @ p, have)
        assert np.sum((have - target) ** 2) <= brute(p, n, target, most, 3000) * 1.2 + (2e-3 * target.sum()) ** 2


def tables(spark):
    words = {0: "junk noise", 1: "fine prose", 2: "nasty slur"}
    rows = [(i, " ".join([words[i % 3]] * (3 + i % 7)), "s") for i in range(90)] + [(None, "fine prose", "s"), (200, None, "s"), (201, "", "s"), (4, "fine prose prose", "s")]
    labels = [(i, int(i % 3 != 0), int(i % 3 == 2)) for i in range(60)] + [(61, None, None), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, rate string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rates_by_domain(spark):
    docs, labels = tables(spark)
    out = mixing.rate(docs, labels, [0.1, 0.8, 0.1]).collect()
    assert len(out) == docs.count()
    by = {k: np.mean([r.rate for r in out if r.tokens and int(np.argmax(r.p)) == k]) for k in range(3)}
    assert by[0] < 0.5 and by[2] < 0.5 and 0.8 < by[1] < 1.3
    assert all(r.rate == 1 for r in out if not r.tokens)
    reached = np.sum([np.array(r.p) * r.rate * r.tokens for r in out], axis=0)
    assert np.allclose(reached, out[0].reached) and out[0].met == bool(np.abs(reached - out[0].target).max() <= 1e-3 * sum(out[0].target))
    assert not mixing.rate(docs, labels, [0.98, 0.01, 0.01], most=1.0, slack=3.0).first().met
    kept = mixing.select(docs, labels, [0.05, 0.9, 0.05], most=1.0, slack=1.05)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert sum(t.startswith("fine") for t in texts if t) >= 30 and sum(t.startswith("nasty") for t in texts if t) < 15


def test_empty_tables(spark):
    docs, labels = tables(spark)
    assert mixing.rate(docs.limit(0), labels, [1, 1, 1]).count() == 0
    assert all(abs(r.rate - 1) < 1e-6 for r in mixing.rate(docs, labels.limit(0), [1, 1, 1]).collect())
    assert isinstance(mixing.fit(docs, labels.limit(0)), Model)


def test_relative_targets_are_met(spark):
    docs, labels = tables(spark)
    out = mixing.rate(docs, labels, [0.9, 0.98, 0.4], most=1.0, relative=True).collect()
    plain = np.sum([np.array(r.p) * r.tokens for r in out], axis=0)
    assert np.allclose(out[0].target, plain * [0.9, 0.98, 0.4]) and out[0].met and all(0 <= r.rate <= 1 for r in out)
