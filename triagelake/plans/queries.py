"""Each operator over the order tables, beside the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.functions import text as X
from triagelake.functions.aliases import field
from triagelake.operators import entities as E
from triagelake.operators import explain as W
from triagelake.operators import grouping, remediation
from triagelake.operators import groups as G
from triagelake.operators import pipeline as P
from triagelake.operators import report as R
from triagelake.operators import tier as T
from triagelake.plans.views import FINDINGS_SQL, findings, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def with_f(sql: str) -> str:
    return f"WITH {FINDINGS_SQL} {sql}"


@query(with_f("SELECT tier, disposition, count(*) AS findings, CAST(sum(CASE WHEN effective IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS effective FROM t GROUP BY tier, disposition"))
def tier_decision(spark, d):
    return T.tiered(findings(spark, d)).groupBy("tier", "disposition").agg(F.count("*").alias("findings"), F.count("effective").alias("effective"))


@query(with_f("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, tier, effective FROM t"))
def tier_rows(spark, d):
    return T.tiered(findings(spark, d)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tier", "effective")


@query(with_f("SELECT count(*) FILTER (active AND tier_rank > 2) AS below_floor, count(*) FILTER (active AND raw_rank > 2) AS raised FROM t"))
def tier_floor_guard(spark, d):
    f = T.tiered(findings(spark, d))
    free = T.base_rank(F.col("impact"), F.lit(False), F.col("internet"), F.col("crit"), F.col("epss"), F.col("mature"))
    able = (F.col("impact") >= 1) & (F.col("internet") | (F.col("crit") >= 2) | F.coalesce(F.col("epss") >= 0.5, F.lit(False)))
    return f.agg(F.count_if(F.col("active") & (F.col("tier_rank") > 2)).alias("below_floor"), F.count_if(F.col("active") & (free > 2) & ~able).alias("raised"))


@query(with_f("SELECT 'P' || base_rank AS before, tier AS after, count(*) AS findings FROM t WHERE eased GROUP BY 1, 2"))
def tier_deescalation(spark, d):
    f = T.tiered(findings(spark, d)).filter("eased")
    return f.groupBy(F.concat(F.lit("P"), F.col("base_rank").cast("string")).alias("before"), F.col("tier").alias("after")).agg(F.count("*").alias("findings"))


@query(with_f("""SELECT array_to_string(list_filter([CASE WHEN impact >= 3 THEN 'impact' END, CASE WHEN active THEN 'active_exploitation' END, CASE WHEN mature THEN 'functional_exploit' END,
  CASE WHEN epss >= 0.5 THEN 'likelihood' END, CASE WHEN internet THEN 'internet_exposure' END, CASE WHEN crit >= 2 THEN 'critical_asset' END, CASE WHEN eased THEN 'mitigation_applied' END], lambda x: x IS NOT NULL), ',') AS drivers,
  count(*) AS findings FROM t GROUP BY 1"""))
def tier_drivers(spark, d):
    f = T.tiered(findings(spark, d))
    return f.groupBy(F.array_join(T.drivers(f), ",").alias("drivers")).agg(F.count("*").alias("findings"))


QUIET = "NOT (active OR internet OR mature OR epss >= 0.5)"
GUARD_SQL = [
    "active", "active AND raw_rank > 2", "internet AND crit >= 2", "mature", "base_rank = 0", "strong", "isolated", "strong", f"strong AND {QUIET}", f"isolated AND {QUIET}", "eased", "false", "false",
]
GUARD_ROWS = ", ".join(f"{{'name': '{name}', 'triggered': {test}, 'a': '{yes}', 'b': '{no}'}}" for (name, yes, no), test in zip(W.GUARDS, GUARD_SQL, strict=True))


@query(with_f(f"""SELECT g.name, g.triggered, CASE WHEN g.name LIKE 'active%' AND active THEN 'P2' END AS minimum_priority,
  CASE WHEN g.name = 'active_exploitation_minimum_guard' AND active AND NOT g.triggered THEN '{W.FLOOR_NOT_NEEDED}' WHEN g.name = 'mitigation_selection_applied' AND g.triggered AND crit >= 3 THEN '{W.RETAINED}'
    WHEN g.triggered THEN g.a ELSE g.b END AS reason, count(*) AS findings FROM (SELECT active, crit, unnest([{GUARD_ROWS}]) AS g FROM t) GROUP BY ALL"""))
def tier_guards(spark, d):
    f = T.tiered(findings(spark, d)).withColumn("compensating_controls", F.when(F.col("strong"), "none; filter").otherwise("N/A"))
    return f.select(F.explode(W.guards(f)).alias("g")).groupBy("g.name", "g.triggered", "g.minimum_priority", "g.reason").agg(F.count("*").alias("findings"))


IMPACT_SQL_NAME = "list_extract(['unknown', 'low', 'medium', 'high', 'critical'], impact + 1)"


@query(with_f(f"""SELECT CASE WHEN base_rank = 0 THEN replace(replace('{W.INCIDENT}', '{{note}}', CASE WHEN mature THEN '{W.INCIDENT_MATURE}' ELSE '{W.INCIDENT_ACTIVE}' END), '{{impact}}', {IMPACT_SQL_NAME})
  WHEN tier = 'P4' THEN '{W.BACKLOG}' ELSE replace(replace('{W.BECAUSE}', '{{tier}}', tier), '{{impact}}', {IMPACT_SQL_NAME}) END AS explanation,
  'technical_impact=' || {IMPACT_SQL_NAME} || ' EPSS=' || printf('%g', epss) || CASE WHEN internet THEN ' internet_exposed=true' ELSE '' END || CASE crit WHEN 3 THEN ' critical_asset=critical critical_business_or_asset_consequence=true' WHEN 2 THEN ' critical_asset=high' ELSE '' END
    || CASE WHEN strong THEN ' strong_compensating_controls=true' ELSE '' END || CASE WHEN isolated THEN ' network_isolation=true' ELSE '' END AS evidence, count(*) AS findings FROM t GROUP BY ALL"""))
def tier_explanation(spark, d):
    f = W.explained(T.tiered(findings(spark, d)))
    return f.groupBy("explanation", F.array_join("evidence", " ").alias("evidence")).agg(F.count("*").alias("findings"))


@query(with_f("SELECT p.tier, count(t.l_orderkey) AS findings FROM (VALUES ('P0'), ('P1'), ('P2'), ('P3'), ('P4'), ('unassigned')) p(tier) LEFT JOIN t ON coalesce(t.effective, 'unassigned') = p.tier GROUP BY 1"))
def priority_summary(spark, d):
    names = spark.createDataFrame([(x,) for x in [*T.TIERS, "unassigned"]], "tier string")
    n = T.tiered(findings(spark, d)).groupBy(F.coalesce("effective", F.lit("unassigned")).alias("tier")).agg(F.count("*").alias("n"))
    return names.join(n, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("findings"))


@query("""SELECT CASE o_orderstatus WHEN 'O' THEN 'confirmed' WHEN 'F' THEN 'remediated' ELSE 'accepted_risk' END AS disposition, count(*) AS findings FROM orders GROUP BY 1""")
def disposition_counts(spark, d):
    word = F.when(F.col("o_orderstatus") == "O", "Open").when(F.col("o_orderstatus") == "F", " fixed").otherwise("risk-accepted")
    return table(spark, d, "orders").groupBy(X.disposition(word).alias("disposition")).agg(F.count("*").alias("findings"))


@query(with_f("SELECT tier, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS quantity FROM t WHERE disposition = 'confirmed' ORDER BY tier_rank, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice LIMIT 100"))
def active_queue_topk(spark, d):
    f = T.tiered(findings(spark, d)).filter("disposition = 'confirmed'").orderBy("tier_rank", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return f.limit(100).select("tier", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("double").alias("quantity"))


@query(with_f("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM t WHERE tier = 'P1' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50"))
def findings_limit(spark, d):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return T.tiered(findings(spark, d)).filter("tier = 'P1'").orderBy(*cols).limit(50).select(*cols)


@query("""WITH b AS (SELECT p_size, CASE WHEN p_size = 4 THEN 'critical' WHEN p_size = 3 THEN 'high' WHEN p_size = 2 THEN 'medium' WHEN p_size = 1 THEN 'low' WHEN p_size = 0 THEN 'none' WHEN p_size BETWEEN 9 AND 10 THEN 'critical' WHEN p_size BETWEEN 7 AND 10 THEN 'high' WHEN p_size BETWEEN 4 AND 10 THEN 'medium' ELSE 'unknown' END AS banded FROM part)
SELECT p_size, CASE WHEN p_size = 5 THEN 'critical' WHEN p_size IN (3, 4) THEN 'high' WHEN p_size = 2 THEN 'medium' WHEN p_size = 1 THEN 'low' ELSE banded END AS native, banded, count(*) AS n FROM b GROUP BY ALL""")
def severity_normalize(spark, d):
    s = F.col("p_size").cast("string")
    return table(spark, d, "part").groupBy("p_size", X.severity(s, native_ordinal=True).alias("native"), X.severity(s).alias("banded")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN value BETWEEN 0 AND 10 THEN value END AS cvss, CASE WHEN value / 100 BETWEEN 0 AND 1 THEN value / 100 END AS epss,
  CAST(CASE WHEN floor(value) BETWEEN 1 AND 65535 THEN floor(value) END AS INTEGER) AS port FROM events""")
def bounded_parse(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", X.bounded(v, 0, 10).alias("cvss"), X.bounded(v / 100, 0, 1).alias("epss"), X.parse_port(F.floor(v).cast("string")).alias("port"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN true WHEN o_orderstatus = 'F' THEN false END AS flag FROM orders""")
def bool_parse(spark, d):
    word = F.when(F.col("o_orderstatus") == "O", " Yes").when(F.col("o_orderstatus") == "F", "Not Listed").otherwise("maybe")
    return table(spark, d, "orders").select("o_orderkey", X.parse_bool(word).alias("flag"))


@query("""SELECT p_partkey, 'CVE-2024-' || (10000 + p_partkey) || ',CWE-' || p_size AS ids FROM part""")
def identifier_extract(spark, d):
    text = F.concat(F.lit("cwe-"), F.col("p_size").cast("string"), F.lit(" in "), "p_name", F.lit(", see cve-2024-"), (F.col("p_partkey") + 10000).cast("string"), F.lit("; CWE-"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.identifiers(text), ",").alias("ids"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(replace(p_name, ' ', ', '), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part""")
def list_split(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(X.as_list(F.regexp_replace("p_name", " ", ", ")), "|").alias("parts"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_selector(spark, d):
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT 'supplier' AS source, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name, c_nationkey FROM customer""")
def alias_coalesce(spark, d):
    return named(spark, d).select("source", field("asset_id").alias("id"), field("title").alias("name"), "nation")


def named(spark, d):
    """Two sources that call one thing by different names, as indexes of their fields."""
    index = lambda *kv: F.create_map(*[F.lit(x) if i % 2 == 0 else F.col(x).cast("string") for i, x in enumerate(kv)])
    none = F.create_map().cast("map<string,string>")
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.lit("generic_json").alias("provider"), index("name", "s_name", "hostid", "s_suppkey").alias("exact"), none.alias("leaf"), F.col("s_nationkey").alias("nation"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.lit("tenable").alias("provider"), index("pluginname", "c_name").alias("exact"), index("uuid", "c_custkey", "title", "c_mktsegment").alias("leaf"), F.col("c_nationkey").alias("nation"))
    return s.union(c)


ADMISSION_SQL = """SELECT CASE WHEN user_id % 7 = 0 OR value < 1 THEN 'quarantined' WHEN event_type = 'error' THEN 'accepted_with_warnings' ELSE 'accepted' END AS state FROM events"""


def admitted(spark, d):
    """Events as raw records: some without a usable vulnerability or target, or without an id of their own."""
    known = {
        "cve": F.when(F.col("user_id") % 7 == 0, " N/A ").otherwise(F.concat(F.lit("cve-2024-"), (F.col("user_id") + 10000).cast("string"))), "assetid": F.when(F.col("value") < 1, "unknown").otherwise("host"),
        "title": F.when(F.col("event_type") != "error", F.col("event_type")), "severity": F.lit("low"), "id": F.when(F.col("event_type") != "error", F.concat(F.lit("e"), F.col("event_id").cast("string"))),
    }
    exact = F.map_filter(F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    raw = table(spark, d, "events").select(
        F.col("event_id").alias("ordinal"), F.lit("generic_json").alias("provider"), F.lit("f").alias("report_sha256"), F.col("event_id").cast("string").alias("record_pointer"), F.lit("{}").alias("original_record"),
        exact.alias("exact"), F.create_map().cast("map<string,string>").alias("leaf"), F.lit(False).alias("duplicate_keys"), F.lit(None).cast("string").alias("malformed"),
    )
    return P.normalise(raw)


@query(f"SELECT s.state, count(a.state) AS records FROM (VALUES ('accepted'), ('accepted_with_warnings'), ('quarantined'), ('rejected')) s(state) LEFT JOIN ({ADMISSION_SQL}) a USING (state) GROUP BY 1")
def admission_quarantine(spark, d):
    return P.accounting(admitted(spark, d))


@query(f"SELECT count(*) AS total, count(*) FILTER (state LIKE 'accepted%') AS accepted, count(*) FILTER (state NOT LIKE 'accepted%') AS refused, true AS balanced FROM ({ADMISSION_SQL})")
def accounting_invariant(spark, d):
    n, yes = F.sum("records"), F.col("state").startswith("accepted")
    part = lambda c: F.sum(F.when(c, F.col("records")).otherwise(0))
    a = P.accounting(admitted(spark, d)).agg(n.alias("total"), part(yes).alias("accepted"), part(~yes).alias("refused"))
    return a.withColumn("balanced", F.col("total") == F.col("accepted") + F.col("refused"))


@query("""SELECT c_custkey, substr(sha256('["' || c_name || '","' || c_custkey || '"]'), 1, 24) AS id FROM customer""")
def stable_id_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.stable_id(F.col("c_name"), F.col("c_custkey")).alias("id"))


@query("""SELECT sha256(source || '|' || text) AS fingerprint, count(*) AS copies, min(doc_id) AS canonical FROM documents GROUP BY 1 HAVING count(*) > 1""")
def fingerprint_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.concat_ws("|", "source", "text"), 256).alias("fingerprint")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("canonical")).filter("copies > 1")


@query("""SELECT relation, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1 THEN 'canonical' ELSE 'duplicate' END AS relation FROM lineitem) GROUP BY 1""")
def exact_duplicate_relation(spark, d):
    return G.exact_duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"]).groupBy("relation").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey, c_custkey, n_name || '/' || a AS alias FROM nation JOIN (SELECT c_custkey, c_nationkey, unnest([c_name, 'seg:' || c_mktsegment]) AS a FROM customer) ON n_nationkey = c_nationkey""")
def alias_cross_product(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    v, t = F.array("n_name"), F.array(F.col("c_name"), F.concat(F.lit("seg:"), "c_mktsegment"))
    crossed = F.array_sort(F.flatten(F.transform(v, lambda x: F.transform(t, lambda y: F.concat_ws("/", x, y)))))
    return both.select("n_nationkey", "c_custkey", F.explode(crossed).alias("alias"))


@query("""SELECT DISTINCT owner, o_orderkey FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS owner FROM orders) WHERE owner <> o_orderkey""")
def blocking_edges(spark, d):
    return G.blocking_edges(table(spark, d, "orders"), "o_orderkey", ["o_custkey", "o_orderdate"], "o_orderkey")


CC_SQL = """WITH RECURSIVE e AS (SELECT 2 * o_custkey AS a, 2 * o_orderkey + 1 AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r(node, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node"""


@query(CC_SQL)
def components_of_orders(spark, d):
    """All customer-order edges with ids as they are."""
    return G.components(table(spark, d, "orders").select((F.col("o_custkey").cast("long") * 2).alias("a"), (F.col("o_orderkey").cast("long") * 2 + 1).alias("b")), "a", "b")


@query()
def connected_components(spark, d):
    """All part-supplier edges with ids as they are, parts even and suppliers odd: no SQL, which is too slow on them."""
    e = table(spark, d, "lineitem").filter("l_partkey IS NOT NULL AND l_suppkey IS NOT NULL")
    return G.components(e.select((F.col("l_partkey").cast("long") * 2).alias("a"), (F.col("l_suppkey").cast("long") * 2 + 1).alias("b")).distinct(), "a", "b")


@query("""SELECT l_orderkey, count(*) AS members, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS sources, array_to_string(list_sort(list_distinct(list(CAST(l_linenumber AS VARCHAR)))), ',') AS ranks, arg_min(l_partkey, {'a': l_linenumber, 'b': l_partkey}) AS canonical FROM lineitem GROUP BY 1""")
def group_summary(spark, d):
    return G.group_summary(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_partkey", "l_linenumber")


@query("""WITH m AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem), s AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM m GROUP BY 1)
SELECT l_orderkey, l_returnflag FROM (SELECT l_orderkey, l_returnflag, count(DISTINCT l_linenumber) AS n FROM m GROUP BY 1, 2) JOIN s USING (l_orderkey, n)""")
def alias_intersection(spark, d):
    return G.shared_aliases(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query("""SELECT nation, count(*) AS members, count(DISTINCT source) AS sources, count(DISTINCT source) > 1 AS crosses FROM (SELECT s_nationkey AS nation, 's' AS source FROM supplier UNION ALL SELECT c_nationkey, 'c' FROM customer) GROUP BY 1""")
def cross_source_groups(spark, d):
    return G.crossing(named(spark, d), "nation", "source")


@query("""SELECT o_custkey, count(DISTINCT o_orderpriority) AS severities, count(*) AS findings FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1""")
def conflict_groups(spark, d):
    return G.disagreeing(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("""SELECT p_brand, count(*) AS findings, count(DISTINCT l_orderkey) AS groups, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS providers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def vulnerability_rollup(spark, d):
    f = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return G.rollup(f, "p_brand", "l_orderkey", "l_returnflag")


@query("""WITH b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) < 1998), c AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) >= 1998)
SELECT coalesce(c.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.o_custkey IS NULL THEN 'new' WHEN c.o_custkey IS NULL THEN 'stale' ELSE 'recurring' END AS state FROM c FULL JOIN b ON b.o_custkey = c.o_custkey""")
def baseline_recurring_new_stale(spark, d):
    o = table(spark, d, "orders")
    late = F.year("o_orderdate") >= 1998
    return G.longitudinal(o.filter(late), o.filter(~late), "o_custkey")


@query("""WITH b AS (SELECT DISTINCT s_nationkey AS alias, s_suppkey AS entity FROM supplier), x AS (SELECT c_custkey, count(DISTINCT entity) AS candidates, min(entity) AS e FROM customer LEFT JOIN b ON c_nationkey = alias GROUP BY 1)
SELECT c_custkey, CAST(candidates AS INTEGER) AS candidates, CASE WHEN candidates = 0 THEN 'unreconciled' WHEN candidates = 1 THEN 'matched' ELSE 'ambiguous' END AS state, CASE WHEN candidates = 1 THEN e END AS entity FROM x""")
def baseline_reconcile_state(spark, d):
    current = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("alias"))
    return G.reconciled(current, table(spark, d, "supplier").select(F.col("s_nationkey").alias("alias"), F.col("s_suppkey").alias("entity")), "c_custkey", "alias", "entity")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'explicit_action' WHEN p_size > 25 THEN 'package_upgrade' WHEN p_partkey % 3 = 0 THEN 'correlated_solution' ELSE 'finding' END AS kind,
  CASE WHEN p_partkey % 11 = 0 THEN 'kb' || (1000 + p_partkey) WHEN p_size > 25 THEN lower(p_brand) || '|' || p_size WHEN p_partkey % 3 = 0 THEN 'g' || p_partkey || '|entity:e' || p_size || '|solution:upgrade' ELSE CAST(p_partkey AS VARCHAR) END AS key FROM part""")
def action_key(spark, d):
    p, k, none = table(spark, d, "part"), F.col("p_partkey"), F.lit(None).cast("string")
    solution = F.when(k % 11 == 0, F.concat(F.lit("Install  KB"), (k + 1000).cast("string"), F.lit(" now"))).otherwise("Upgrade")
    key = G.action_key(solution, F.lit("N/A"), none, F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")), F.when(k % 3 == 0, F.concat(F.lit("g"), k.cast("string"))), F.concat(F.lit("e"), F.col("p_size").cast("string")), none, F.lit("v"), k.cast("string"))
    return p.select("p_partkey", key.alias("x")).select("p_partkey", "x.kind", "x.key")


ACTIONS_SQL = """, a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, l_returnflag ORDER BY l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey) AS r FROM t)
SELECT p_brand, l_returnflag, count(*) AS members, min(tier_rank) AS highest, min(CASE WHEN disposition = 'confirmed' THEN tier_rank END) AS highest_active,
  array_to_string(list_sort(list(l_orderkey * 10 + l_linenumber) FILTER (r <= 25)), ',') AS sample FROM a GROUP BY 1, 2"""


@query(f"WITH {FINDINGS_SQL} {ACTIONS_SQL}")
def action_groups(spark, d):
    f = T.tiered(findings(spark, d)).withColumn("member", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return G.actions(f, ["p_brand", "l_returnflag"], "tier_rank", "member")


MAP_SQL = "array_to_string(list_filter([{}], lambda x: x NOT LIKE '%:0'), ' ')"


def map_sql(column: str, names: tuple[str, ...], among: str = "true") -> str:
    return MAP_SQL.format(", ".join(f"'{n}:' || count(*) FILTER ({among} AND {column} = '{n}')" for n in names))


def map_text(c: str) -> Column:
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), " ").alias(c)


@query(with_f(f"""SELECT 'RA-' || p_brand || '-' || l_returnflag AS action_id, count(*) AS members, count(DISTINCT l_orderkey * 10 + l_linenumber) AS occurrences, count(DISTINCT o_custkey) AS assets,
  array_to_string(list_sort(list_distinct(list(CAST(l_suppkey % 3 AS VARCHAR)))), ',') AS providers, {map_sql("tier", T.TIERS)} AS priorities, {map_sql("tier", T.TIERS, "disposition = 'confirmed'")} AS active_priorities,
  {map_sql("disposition", R.DISPOSITIONS)} AS dispositions, min(tier_rank) AS highest, min(tier_rank) FILTER (disposition = 'confirmed') AS highest_active, CAST(least(25, count(*)) AS INTEGER) AS sampled, 'Upgrade ' || p_brand AS action
  FROM t WHERE disposition <> 'remediated' GROUP BY p_brand, l_returnflag"""))
def action_table(spark, d):
    text = lambda c: F.col(c).cast("string")
    f = T.tiered(findings(spark, d)).withColumns({
        "action_id": F.concat_ws("-", F.lit("RA"), "p_brand", "l_returnflag"), "action_kind": F.lit("fixed_version"), "action_key": F.col("p_brand"), "id": (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"),
        "ordinal": F.col("l_orderkey"), "provider": (F.col("l_suppkey") % 3).cast("string"), "asset_id": text("o_custkey"),
    })
    a = remediation.summaries(remediation.live(f))
    joined = F.array_join("providers", ",").alias("providers")
    return a.select("action_id", "members", "occurrences", "assets", joined, *(map_text(c) for c in ("priorities", "active_priorities", "dispositions")), "highest", "highest_active", F.size("sample").alias("sampled"), "action")


@query("""WITH m AS (SELECT DISTINCT o_custkey, o_orderkey, unnest(['n|target:' || CASE WHEN o_custkey % 2 = 0 THEN 'ip:' ELSE 'hostname:' END || o_custkey, 'a' || o_orderstatus]) AS alias FROM orders), s AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1)
SELECT o_custkey AS root, min(alias) FILTER (alias LIKE 'n|%') AS alias FROM (SELECT o_custkey, alias, count(*) AS n FROM m GROUP BY 1, 2) JOIN s USING (o_custkey, n) GROUP BY 1""")
def preferred_alias(spark, d):
    """Each customer's orders as one group: all have the customer's target, some also the same status."""
    target = F.concat(F.lit("n|target:"), F.when(F.col("o_custkey") % 2 == 0, "ip:").otherwise("hostname:"), F.col("o_custkey").cast("string"))
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("id"), F.array(F.concat(F.lit("a"), "o_orderstatus"), target).alias("aliases"))
    return grouping.common_alias(f)


@query("""WITH f AS (SELECT o_custkey AS g, o_orderkey AS id, 'CVE-' || o_custkey % 7 AS v, o_orderstatus AS p, o_orderpriority AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
t AS (SELECT g, min(v) AS v, count(*) AS members, count(DISTINCT p) AS providers, count(DISTINCT s) AS severities, count(*) FILTER (r > 1 AND r % 2 = 0) AS duplicates, count(*) FILTER (r > 1 AND r % 2 = 1) AS related FROM f GROUP BY 1)
SELECT CAST(sum(members) AS BIGINT) AS records, count(*) AS groups, CAST(sum(duplicates) AS BIGINT) AS duplicates, count(*) FILTER (duplicates > 0) AS exact_duplicate_groups, CAST(sum(related) AS BIGINT) AS related,
  count(*) FILTER (providers > 1) AS cross_provider_groups, 0 AS cross_provider_duplicate_groups, 0 AS cross_provider_duplicate_records, count(*) FILTER (severities > 1) AS conflicting_groups, CAST(sum(members) // 2 AS BIGINT) AS blocked_conflict_edges FROM t""")
def correlation_stats(spark, d):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    f = table(spark, d, "orders").select(
        F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("canonical"), F.lit("e").alias("stable_entity"), F.concat(F.lit("CVE-"), (F.col("o_custkey") % 7).cast("string")).alias("vulnerability"), F.col("o_orderstatus").alias("provider"),
        F.col("o_orderpriority").alias("severity"), F.lit("P1").alias("tier"), F.when(r == 1, None).when(r % 2 == 0, "duplicate").otherwise("related").alias("relation"), F.lit(1).alias("conflicts"),
    )
    return grouping.stats(grouping.table(f))


@query(with_f("""SELECT p_brand, CAST(sum(id) AS BIGINT) AS ids, count(*) AS sampled FROM (SELECT p_brand, l_orderkey * 10 + l_linenumber AS id, row_number() OVER (PARTITION BY p_brand ORDER BY l_orderkey * 10 + l_linenumber, l_partkey, l_suppkey) AS r FROM t) WHERE r <= 25 GROUP BY 1"""))
def evidence_sample_25(spark, d):
    f = findings(spark, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    r = F.row_number().over(Window.partitionBy("p_brand").orderBy("id", "l_partkey", "l_suppkey"))
    return f.withColumn("r", r).filter("r <= 25").groupBy("p_brand").agg(F.sum("id").alias("ids"), F.count("*").alias("sampled"))


@query(with_f("""SELECT l_orderkey, l_linenumber, l_partkey, n AS shared FROM t JOIN (SELECT p_brand, l_returnflag, count(*) AS n FROM t WHERE disposition <> 'accepted_risk' GROUP BY 1, 2) USING (p_brand, l_returnflag)"""))
def action_join_back(spark, d):
    f = T.tiered(findings(spark, d))
    return G.shared_actions(f, ["p_brand", "l_returnflag"], F.col("disposition") != "accepted_risk").select("l_orderkey", "l_linenumber", "l_partkey", "shared")


@query(r"""SELECT page_id, url, CASE WHEN url IS NOT NULL THEN '[REDACTED]' END AS api_key, '[REDACTED_PATH]' AS place, '[REDACTED_SOURCE_RECORD sha256:' || sha256(html) || ']' AS original_record FROM pages""")
def redaction(spark, d):
    return R.shareable(table(spark, d, "pages").select("page_id", "url", F.col("url").alias("api_key"), F.lit("/srv/exports/a.json").alias("place"), F.col("url").alias("source_path"), F.col("html").alias("original_record")))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(ltrim(text), '^[=+\-@]') THEN '''' || text ELSE text END AS text FROM documents""")
def csv_safe(spark, d):
    return table(spark, d, "documents").select("doc_id", X.csv_safe(F.col("text")).alias("text"))


@query("""SELECT event_type, count(*) AS records, round(avg(CASE WHEN value >= 1 THEN 1.0 ELSE 0.0 END), 6) AS value_rate, round(avg(CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS k_rate FROM events GROUP BY 1""")
def mapping_coverage(spark, d):
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("records"), share(F.col("value") >= 1).alias("value_rate"), share(F.get_json_object("props", "$.k").isNotNull()).alias("k_rate"))


IMPACT_SQL = " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{level}'" for level, words in (("critical", P.CRITICAL), ("high", P.HIGH), ("medium", P.MEDIUM)))


@query(f"SELECT CASE {IMPACT_SQL} WHEN n > 15000 THEN 'critical' WHEN n > 200 THEN 'medium' ELSE 'low' END AS impact, count(*) AS documents FROM (SELECT lower(text) AS t, n_chars AS n FROM documents) GROUP BY 1")
def impact_keywords(spark, d):
    none = F.lit(None).cast("string")
    f = table(spark, d, "documents").select(none.alias("title"), F.col("text").alias("description"), none.alias("technical_impact"), none.alias("cwe"), F.when(F.col("n_chars") > 200, "medium").otherwise("unknown").alias("severity"), F.when(F.col("n_chars") > 15000, 9.5).alias("cvss"))
    return f.groupBy(P.technical_impact().alias("impact")).agg(F.count("*").alias("documents"))


@query("""SELECT user_id, event_id, r AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r % 10 = 1""")
def stride_sample(spark, d):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", r.alias("place")).filter("place % 10 = 1")


@query("""SELECT o_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(nullif(l_returnflag, 'A'), o_orderstatus) AS context FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def host_item_explode(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.coalesce(F.nullif("l_returnflag", F.lit("A")), "o_orderstatus").alias("context"))


def observations(spark, d):
    """Customers as observations of a vulnerability on a host; every other one has an asset id."""
    c, none = table(spark, d, "customer"), F.lit(None).cast("string")
    return c.select(
        F.lower("c_mktsegment").alias("provider"), F.col("c_custkey").cast("string").alias("id"), none.alias("source_record_id"), F.array(F.concat(F.lit(" cve-"), F.col("c_nationkey").cast("string"))).alias("cves"),
        none.alias("vulnerability_identifier"), F.concat(F.lit(" "), "c_name", F.lit(".")).alias("hostname"), none.alias("fqdn"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).alias("asset_id"),
        F.array().cast("array<string>").alias("ip_addresses"),
    )


OBSERVED_SQL = """o AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey, c_mktsegment, list_sort(list_filter(['vulnerability:cve:CVE-' || c_nationkey || '|target:hostname:' || lower(c_name),
  CASE WHEN c_custkey % 2 = 0 THEN 'vulnerability:cve:CVE-' || c_nationkey || '|target:asset-id:' || lower(c_mktsegment) || ':' || c_custkey END], lambda x: x IS NOT NULL)) AS a FROM customer),
s AS (SELECT *, 'obs-' || substr(sha256('["observation",["' || array_to_string(a, '","') || '"]]'), 1, 24) AS signature FROM o),
h AS (SELECT *, 'se-' || substr(sha256('["independent-run","' || signature || '"]'), 1, 24) AS entity FROM s)"""


@query(f"WITH {OBSERVED_SQL} SELECT id, array_to_string(a, ' ') AS aliases, signature, entity FROM h")
def semantic_entities(spark, d):
    return E.observed(observations(spark, d)).select("id", F.array_join("aliases", " ").alias("aliases"), "signature", "entity")


@query(f"""WITH {OBSERVED_SQL}, x AS (SELECT *, CASE WHEN c_mktsegment = 'BUILDING' OR (c_mktsegment = 'MACHINERY' AND c_custkey % 2 = 1) THEN 0 WHEN c_mktsegment = 'AUTOMOBILE' THEN 2 ELSE 1 END AS candidates FROM h)
SELECT id, candidates, CASE candidates WHEN 0 THEN 'unreconciled' WHEN 2 THEN 'ambiguous' ELSE CASE WHEN c_mktsegment = 'MACHINERY' THEN 'conflict' ELSE 'reconciled' END END AS state,
  CASE WHEN candidates = 1 AND c_mktsegment <> 'MACHINERY' THEN 'known-' || id ELSE entity END AS entity FROM x""")
def baseline_conflict(spark, d):
    """A baseline without one provider; another's hosts have been renamed, a third's are known as two entities."""
    now = E.observed(observations(spark, d))
    renamed = observations(spark, d).withColumn("hostname", F.when(F.col("provider") == "machinery", F.concat(F.lit("old-"), F.trim("hostname"))).otherwise(F.col("hostname")))
    known = E.observed(renamed.filter("provider <> 'building'")).withColumn("entity", F.concat(F.lit("known-"), "id"))
    twice = known.filter("provider = 'automobile'").withColumn("entity", F.concat(F.lit("again-"), "id"))
    return E.reconciled(now, E.registry(known.union(twice))).select("id", F.size("candidates").alias("candidates"), "state", "entity")
