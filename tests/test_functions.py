import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
from triagelake.functions import text as X
from triagelake.operators import groups, pipeline, tier


def values(spark, f, texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r.x for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_scalars(spark):
    assert values(spark, X.parse_bool, ["Yes", " no", "listed", "maybe", None]) == [True, False, True, None, None]
    assert values(spark, X.parse_float, ["1,234.5", "-.5", "1e3", "x", None]) == [1234.5, -0.5, None, None, None]
    assert values(spark, X.parse_epss, ["85%", "0.3", "85", "101%"]) == [0.85, 0.3, None, None]
    assert values(spark, X.parse_cvss, ["10", "10.1", "-1"]) == [10.0, None, None]
    assert values(spark, X.parse_port, ["443", "0", "70000", "1.5"]) == [443, None, None, None]
    assert values(spark, X.parse_time, ["2024-01-02T03:04:05+01:00", "bad", None]) == ["2024-01-02T02:04:05Z", None, None]
    assert values(spark, X.as_list, ["a, b;;c", "", None]) == [["a", "b", "c"], [], []]
    assert values(spark, lambda c: X.unique_text(X.as_list(c)), ["A, a, b, B, A"]) == [["A", "b"]]
    assert values(spark, X.identifiers, ["see cve-2024-1234, CWE-79 and GHSA-aaaa-bbbb-cccc", None]) == [["CVE-2024-1234", "CWE-79", "GHSA-AAAA-BBBB-CCCC"], None]
    assert values(spark, X.severity, ["Crit", "4", "7.5", "0", "x"]) == ["critical", "critical", "high", "none", "unknown"]
    assert values(spark, lambda c: X.severity(c, native_ordinal=True), ["5", "3", "9", "7.5", "0", "11", "High"]) == ["critical", "high", "critical", "high", "none", "unknown", "high"]
    assert values(spark, lambda c: X.severity(c, F.lit(5.0)), ["x", "11", "-1", None]) == ["medium"] * 4 and values(spark, lambda c: X.severity(c, F.lit(50.0)), ["x"]) == ["unknown"]
    assert values(spark, lambda c: X.severity_basis(c)["basis"], ["3", "6.5", "Low", "?"]) == ["numeric_provider_severity", "numeric_cvss_like_score", "text_alias:low", "unrecognized_or_missing"]
    assert values(spark, X.status, ["Fixed", "Risk-Accepted", "In Review"]) == ["remediated", "accepted_risk", "in_review"]
    assert values(spark, X.disposition, ["Fixed", "In Review", None]) == ["remediated", "confirmed", "confirmed"]
    assert values(spark, X.pointer_escape, ["a/b~c"]) == ["a~1b~0c"]
    assert values(spark, X.csv_safe, ["=1", " @x", "ok"]) == ["'=1", "' @x", "ok"]
    assert values(spark, X.norm_key, ["CVSS3 Base-Score"]) == ["cvss3basescore"]


def test_controls(spark):
    assert values(spark, tier.control_state, ["WAF blocks it", "not effective", "a firewall", None]) == ["effective", "ineffective", "unknown", "unknown"]
    assert values(spark, lambda c: tier.isolated(F.lit(None), c), ["network isolated", "restricted", "not isolated"]) == [True, False, False]


def test_actions(spark):
    none = F.lit(None).cast("string")
    key = lambda c: groups.action_key(c, none, none, F.lit("Pack"), none, none, none, none, F.lit("V"), F.lit("f1"))["kind"]
    assert values(spark, key, ["apply PATCH-A1 soon", "Upgrade it", "rotate the keys", None]) == ["explicit_action", "finding", "targeted_solution", "finding"]


def test_action_tokens_and_targets(spark):
    none = F.lit(None).cast("string")
    assert values(spark, lambda c: groups.explicit_action(c, none, none), ["see FIX-A- now", "ms12 KB1234x KB123", "BULLETIN_9"]) == ["fix-a", "kb123", "bulletin_9"]
    key = lambda entity, target: lambda c: groups.action_key(c, none, none, none, none, F.lit("g"), entity, target, F.lit("V"), F.lit("f1"))["key"]
    target = "target:" + hashlib.sha256(b'["10.0.0.1"]').hexdigest()[:16]
    assert values(spark, key(none, F.lit("10.0.0.1")), ["Upgrade  it"]) == [f"g|{target}|solution:upgrade it"]
    assert values(spark, key(F.lit("se-1"), F.lit("h")), ["Upgrade it"]) == ["g|entity:se-1|solution:upgrade it"]


def test_impact_takes_the_higher_of_severity_and_score(spark):
    rows = [("medium", 9.8, None, None, "critical"), ("high", 2.0, None, None, "high"), ("unknown", None, None, None, "low"), ("low", None, "allows SSRF", None, "high"), ("low", 1.0, "x", "injection flaw", "high")]
    df = spark.createDataFrame([(*r, None) for r in rows], "severity string, cvss double, title string, cwe string, want string, technical_impact string").withColumn("description", F.lit(None).cast("string"))
    assert all(r.got == r.want for r in df.select(pipeline.technical_impact().alias("got"), "want").collect())


def test_components_and_baseline(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in groups.components(e, "a", "b").collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    state = groups.longitudinal(spark.range(0, 5).toDF("e"), spark.range(3, 8).toDF("e"), "e")
    assert {r.e: r.state for r in state.collect()} == {0: "new", 1: "new", 2: "new", 3: "recurring", 4: "recurring", 5: "stale", 6: "stale", 7: "stale"}


def test_components_of_all_part_supplier_edges(spark, tmp_path):
    pairs = [(p, 1 + p // 3) for p in range(0, 600, 2)] + [(7, 900), (507, 900), (1007, 500), (7, 900), (507, 1300), (None, 5)]
    rows = [(i, 2 + i % 3, float(i % 50), p, s) for i, (p, s) in enumerate(pairs)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for p, s in pairs:
        if p is not None:
            a, b = root(2 * p), root(2 * s + 1)
            up[max(a, b)] = min(a, b)
    got = entry.queries()["connected_components"](spark, str(tmp_path)).collect()
    assert len(got) == len(up) and {r.node: r.root for r in got} == {x: root(x) for x in up}


def test_reconciled_counts_entities_without_pairs(spark):
    known = [("a", 1), ("a", 1), ("b", 1), ("a", 2), ("c", 2), ("c", 3), ("b", 4), ("d", 5), ("d", None), (None, 6)]
    now = [(1, "a"), (2, "b"), (2, "d"), (2, "b"), (3, "a"), (3, "b"), (3, "c"), (4, "d"), (4, None), (5, None), (6, "x"), (7, "x"), (7, "d"), (8, "x"), (8, "y"), (None, "c"), (9, "a"), (9, "c"), (10, "b"), (10, "a"), (10, "c")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {r.n: (r.candidates, r.state, r.e) for r in groups.reconciled(df(now, "n int, m string"), df(known, "m string, e int"), "n", "m", "e").collect()}
    want = {}
    for n in {n for n, _ in now}:
        c = {e for m, e in known if e is not None and m is not None and (n, m) in now}
        want[n] = (len(c), ("unreconciled", "matched", "ambiguous")[min(len(c), 2)], min(c) if len(c) == 1 else None)
    assert got == want and {s for _, s, _ in got.values()} == {"unreconciled", "matched", "ambiguous"}
    # an alias that all hold: no step may make a row for each pair
    holders = spark.range(1000).selectExpr("id AS n", "'a' AS m")
    hot = groups.reconciled(holders, spark.range(300).selectExpr("'a' AS m", "id AS e"), "n", "m", "e")
    assert {r.candidates for r in hot.collect()} == {300}
    store = spark._jsparkSession.sharedState().statusStore()
    last = max(store.executionsList().apply(i).executionId() for i in range(store.executionsList().size()))
    made, nodes, values = [], store.planGraph(last).allNodes(), store.executionMetrics(last)
    for node in (nodes.apply(i) for i in range(nodes.size())):
        for metric in (node.metrics().apply(i) for i in range(node.metrics().size())):
            if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                made.append(int(values.apply(metric.accumulatorId()).replace(",", "")))
    assert made and max(made) <= 1000
