"""Mixing to target weights with soft domain membership.

A classifier fitted on the labelled table gives each document a posterior over domains. Document d, with n_d tokens and
posteriors p_d, gets a rate r_d >= 0: how often it is to be read. The expected tokens of domain k are
sum_d r_d n_d p_dk; the rates make these meet the targets by least squares,

    minimise  | sum_d r_d n_d p_d - target |^2   over 0 <= r <= most,

by projected gradient. Steps are scaled by 1 / n_d, so a long document moves no faster than a short one. A round tries the
gradient in several lengths, as it is and scaled by the inverse of the domains' second moments, all in one aggregation of
a few sums per domain, and takes the projected step that leaves the least error. From r = 1 a step adds g . p_d to every rate and cuts it at the bounds: a rate follows from the list of steps (rounds x domains
numbers on the driver) and the document's own posteriors, and no state is kept or joined.

Targets are weights of the domains. Their total is set so that one domain keeps its expected tokens and so a rate near
1: `whole`, or else the domain whose target is largest relative to its tokens. `slack` scales the total, which can also
be given. With `relative`, the weights are factors of each domain's own expected tokens instead: 0.4 is a cut to two fifths.

`rate` says with each row what the targets are, what the rates reach and whether that is within `close` of the total:
bounds on the rates, or domains that the classifier can't tell apart, can put a target out of reach.

Null text or no words: no tokens, rate 1, posterior of the class frequencies. Null doc_id: takes part, never labelled.
Labels outside the domains are not learned from. Repeated rows: rated alike. No labels: equal posteriors. A domain
without expected tokens can't be met; its target stays unmet. Empty table: empty result. `select` carries all columns.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, free_name, row_key, small_batches, written
from .subword import Model, trained
from .toxicity import labelled_sample

#: Domains of the labelled table: neither good nor toxic, good, toxic.
DOMAINS = ("poor", "good", "toxic")


def domain() -> Column:
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).when((F.col("quality") == 0) & (F.col("toxic") == 0), 0)


def fit(docs: DataFrame, labels: DataFrame, per_label: tuple[int, ...] = (1000, 2000, 1000), **options) -> Model:
    """A subword classifier of domains, fitted on at most per_label[k] labelled documents of domain k."""
    return trained(labelled_sample(docs, labels, domain(), per_label), len(DOMAINS), **options)


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, rk, tokens and p (one share per domain) of each row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p, n = m.predict(b.column("text"))
            offs = np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)
            yield batch(doc_id=b.column("doc_id"), rk=b.column("rk"), tokens=n, p=pa.ListArray.from_arrays(offs, pa.array(p.ravel())))

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "text")
    return narrow.mapInArrow(run, "doc_id long, rk binary, tokens long, p array<double>")


def _shares(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def rates(p: np.ndarray, steps: list[np.ndarray], most: float) -> np.ndarray:
    """The rates after the steps."""
    r = np.ones(len(p))
    for g in steps:
        r = np.clip(r + p @ g, 0, most)
    return r


def _totals(table: DataFrame, k: int, tries: list[list[np.ndarray]], most: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each list of steps, the expected tokens of each domain, and second moments over documents not held at a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(tries), k + k * k))
        for b in batches:
            p, n = _shares(b.column("p"), k), b.column("tokens").to_numpy().astype(float)
            for at, steps in enumerate(tries):
                r = rates(p, steps, most)
                free = (r > 0) & (r < most) if steps else r > 0
                out[at, :k] += (r * n) @ p
                out[at, k:] += ((p[free] * n[free, None]).T @ p[free]).ravel()
        yield batch(i=np.arange(out.size), v=out.ravel())

    v = np.zeros(len(tries) * (k + k * k))
    for r in table.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        v[r.i] = r.v
    return [(x[:k], x[k:].reshape(k, k)) for x in v.reshape(len(tries), -1)]


def solve(table: DataFrame, weights: list[float], total: float | None = None, most: float = np.inf, slack: float = 1.0, whole: int | None = None, rounds: int = 40, close: float = 1e-3, relative: bool = False) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(steps, expected tokens reached, targets); it ends when the targets are met or no step comes nearer."""
    k = len(weights)
    w = np.array(weights, float) / sum(weights)
    steps: list[np.ndarray] = []
    have, moments = _totals(table, k, [steps], np.inf)[0]
    if total is None:
        some = (w > 0) & (have > 0)
        if whole is not None and some[whole]:
            some = np.arange(k) == whole
        total = float((have[some] / w[some]).min()) if some.any() else 0.0
    target = np.array(weights, float) * have if relative else w * total * slack
    steepest = float(np.linalg.eigvalsh(moments)[-1]) or 1.0  # a gradient step over this never overshoots
    for _ in range(rounds):
        error = target - have
        if met(have, target, close):
            break
        ridge = 1e-6 * np.trace(moments) * np.eye(k) + 1e-12 * np.eye(k)
        scaled = np.linalg.lstsq(moments + ridge, error, rcond=None)[0]
        tries = [[*steps, step] for step in (scaled, scaled / 2, scaled / 8, 16 * error / steepest, 4 * error / steepest, error / steepest)]
        results = _totals(table, k, tries, most)
        losses = [np.sum((target - got) ** 2) for got, _ in results]
        best = int(np.argmin(losses))
        if losses[best] >= np.sum(error**2) * (1 - 1e-4):
            break
        steps, (have, moments) = tries[best], results[best]
    return steps, have, target


def met(have: np.ndarray, target: np.ndarray, close: float = 1e-3) -> bool:
    return bool(np.abs(target - have).max() <= close * max(target.sum(), 1.0)) if len(target) else True


def rate(docs: DataFrame, labels: DataFrame, weights: list[float], total: float | None = None, model: Model | None = None, most: float = np.inf, slack: float = 1.0, whole: int | None = None, close: float = 1e-3, relative: bool = False) -> DataFrame:
    """doc_id, rk, tokens, p and rate of each row, and of all rows together target, reached (tokens by domain) and met."""
    model = fit(docs, labels) if model is None else model
    table = written(posteriors(docs, model), "posteriors")
    steps, have, target = solve(table.select("tokens", "p"), weights, total, most, slack, whole, close=close, relative=relative)
    if not met(have, target, close):
        logging.getLogger(__name__).warning("targets %s not met: %s reached", target.tolist(), have.tolist())
    k = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("tokens").to_numpy()
            r = np.where(n > 0, rates(_shares(b.column("p"), k), steps, most), 1.0) if b.num_rows else np.zeros(0)
            yield batch(doc_id=b.column("doc_id"), rk=b.column("rk"), tokens=n, p=b.column("p"), rate=r)

    rated = table.mapInArrow(run, "doc_id long, rk binary, tokens long, p array<double>, rate double")
    numbers = lambda v: F.array(*(F.lit(float(x)) for x in v))
    return rated.select("*", numbers(target).alias("target"), numbers(have).alias("reached"), F.lit(met(have, target, close)).alias("met"))


def select(docs: DataFrame, labels: DataFrame, weights: list[float], total: float | None = None, salt: int = 17, **bounds) -> DataFrame:
    """docs with each row as often as its rate says: the whole part always, and the rest by a hash of the row."""
    rk, times, copy = (free_name(docs, x) for x in ("rk", "times", "copy"))
    rated = rate(docs, labels, weights, total, **bounds).groupBy("rk").agg(F.first("rate").alias("rate"))
    chance = F.pmod(F.xxhash64("rk", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    often = (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    rated = rated.select(F.col("rk").alias(rk), often.alias(times)).filter(F.col(times) > 0)
    out = docs.withColumn(rk, row_key()).join(rated, rk)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(rk, times, copy)
