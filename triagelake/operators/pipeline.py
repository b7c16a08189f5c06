"""The stages from raw records to remediation actions, each a DataFrame to DataFrame function.

normalise, assess and tiers are narrow projections; correlate and actions shuffle by key.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from triagelake.functions import text as X
from triagelake.functions.aliases import FIELDS, field
from triagelake.operators import entities as E
from triagelake.operators import groups as G
from triagelake.operators import assessment, diagnostics, grouping, remediation
from triagelake.operators import tier as T
from triagelake.operators.explain import explained

# Fixed values.
CRITICAL = ["remote code execution", "rce", "command execution", "arbitrary code"]
HIGH = ["authentication bypass", "privilege escalation", "data breach", "injection", "sql injection", "ssrf"]
MEDIUM = ["denial of service", "dos", "exposure", "disclosure", "sensitive data"]
NOT_VALID = ["false", "no", "0", "invalid", "malformed"]
INVALID_KEYS = ["invalidrecordtype", "malformed", "malformedrecord"]
INVALID = ["true", "yes", "1", "invalid", "malformed"]


@F.pandas_udf(ArrayType(StringType()))
def addresses(values: pd.Series) -> pd.Series:
    """The canonical IP addresses of a text; parts that are none are left out."""

    def parse(v):
        out = set()
        for part in (v or "").replace(",", " ").replace(";", " ").split():
            try:
                out.add(str(ipaddress.ip_address(part)))
            except ValueError:
                pass
        return sorted(out)

    return values.map(parse)


def marked_invalid() -> Column:
    """Whether a record says of itself, at any depth or in its title, that it is none."""
    said = lambda k, words: F.coalesce(F.lower(F.trim(F.element_at("leaf", k))).isin(words), F.lit(False))
    t = F.lower(F.coalesce("title", F.lit("")))
    marked = said("isvalid", NOT_VALID) | t.contains("malformed") | t.contains("invalid record")
    for k in INVALID_KEYS:
        marked |= said(k, INVALID)
    return marked


def normalise(raw: DataFrame) -> DataFrame:
    """One row per raw record: canonical fields, state (accepted, accepted_with_warnings, quarantined, rejected) and reason.

    No record is lost: what can't be used is kept with its reason.
    """
    f = raw.withColumns({name: field(name) for name in FIELDS}).withColumns({"port_given": F.col("port"), "severity_original": F.col("severity"), "invalid_ips": diagnostics.strays(F.col("ip"))})
    ids = X.identifiers(F.concat_ws(" ", "cve", "vulnerability_identifier", "title", "description"))
    stated = X.identifiers(F.concat_ws(" ", "cve", "vulnerability_identifier"))
    pick = lambda a: F.filter(a, lambda x: x.startswith("CVE-"))
    f = f.withColumns({
        "cves": F.when(F.size(pick(stated)) > 0, pick(stated)).otherwise(pick(ids)), "cvss": X.parse_cvss(F.col("cvss_score")), "epss": X.parse_epss(F.col("epss")),
        "ip_addresses": addresses(F.col("ip")), "port": X.parse_port(F.col("port")), "status": X.status(F.col("status")), "kev": X.parse_bool(F.col("kev")),
        "exploited_in_wild": X.parse_bool(F.col("exploited_in_wild")), "internet_exposed": X.parse_bool(F.col("internet_exposed")), "first_seen": X.parse_time(F.col("first_seen")), "last_seen": X.parse_time(F.col("last_seen")),
    })
    said = F.when(F.col("provider") == "qualys", X.severity_basis(F.col("severity"), F.col("cvss"), native_ordinal=True)).otherwise(X.severity_basis(F.col("severity"), F.col("cvss")))
    f = f.withColumn("__s", said).withColumns({"severity": F.col("__s.severity"), "severity_basis": F.col("__s.basis")}).drop("__s")
    f = f.withColumns({
        "cwes": F.filter(F.coalesce(X.identifiers(F.col("cwe")), F.array().cast("array<string>")), lambda x: x.startswith("CWE-")), "cvss_version": X.parse_float(F.col("cvss_version")),
        "vendor_risk_score": X.parse_float(F.col("vendor_risk_score")), "patch_available": X.parse_bool(F.col("patch_available")), "tags": X.unique_text(X.as_list(F.col("tags"))),
    })
    native = F.when(X.usable(F.col("vulnerability_identifier"), X.PLACEHOLDERS), F.upper(F.trim("vulnerability_identifier")))
    f = f.withColumn("vulnerability", F.when(F.size("cves") > 0, F.array_join("cves", ",")).otherwise(native))
    target = X.usable(F.col("asset_id")) | X.usable(F.col("hostname")) | X.usable(F.col("fqdn")) | (F.size("ip_addresses") > 0)
    marked = marked_invalid()
    reason = (
        F.when(F.col("malformed").isNotNull(), F.col("malformed")).when(F.col("duplicate_keys"), "duplicate keys").when(F.col("vulnerability").isNull(), "missing required vulnerability identity")
        .when(~target, "missing required target identity").when(marked, "semantic validation failed")
    )
    f = f.withColumn("warnings", diagnostics.warnings(F.col("port_given"), target, marked)).drop("port_given").withColumn("mapping_confidence", diagnostics.confidence(F.col("warnings")))
    warned = F.size("warnings") > 0
    state = F.when(F.col("malformed").isNotNull() | F.col("duplicate_keys") | reason.startswith("missing") | reason.startswith("semantic"), "quarantined").when(warned, "accepted_with_warnings").otherwise("accepted")
    occurrence = F.coalesce(F.when(X.usable(F.col("source_record_id"), X.PLACEHOLDERS), F.col("source_record_id")), F.col("record_pointer"))
    finding = F.concat(F.lit("f-"), X.stable_id(F.col("provider"), occurrence, F.col("report_sha256"), F.col("record_pointer")))
    return f.withColumns({"reason": reason, "state": state, "id": finding, "fingerprint": F.sha2(F.concat_ws("|", "provider", "original_record"), 256)})


def accepted(f: DataFrame) -> DataFrame:
    return f.filter(F.col("state").startswith("accepted"))


def accounting(f: DataFrame) -> DataFrame:
    """state, records, over all four states; their sum is the number of raw records."""
    names = f.sparkSession.createDataFrame([(s,) for s in ("accepted", "accepted_with_warnings", "quarantined", "rejected")], "state string")
    return names.join(f.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("records"))


def technical_impact() -> Column:
    t = F.lower(F.concat_ws(" ", "title", "description", "technical_impact", "cwe"))
    own = F.lower(F.coalesce("technical_impact", F.lit("")))
    # severity or score, whichever says more
    level = F.greatest(T.impact_rank(F.col("severity")), T.score_rank(F.col("cvss")))
    by_level = F.when(level >= 4, "critical").when(level >= 3, "high").when(level >= 2, "medium").otherwise("low")
    return (
        F.when(own.isin("critical", "rce", "auth_bypass") | T.any_of(t, CRITICAL), "critical").when(own.isin("high", "injection", "data_exposure", "data_tampering") | T.any_of(t, HIGH), "high")
        .when((own == "medium") | T.any_of(t, MEDIUM), "medium").otherwise(by_level)
    )


def assess(f: DataFrame) -> DataFrame:
    """disposition, impact_level and what the evidence says of exposure, threat and confidence."""
    return assessment.analysed(f.withColumns({"disposition": X.disposition(F.col("status")), "impact_level": technical_impact()}))


def tiers(f: DataFrame) -> DataFrame:
    """The inputs of the tier cascade from assessed findings, then the cascade."""
    rank = F.greatest(T.impact_rank(F.col("impact_level"), F.col("severity")), T.score_rank(F.col("cvss")))
    f = f.withColumns({
        "impact": rank, "active": T.truth(F.col("exploited_in_wild")) | T.truth(F.col("kev")), "internet": T.truth(F.col("internet_exposed")),
        "mature": F.coalesce(F.translate(F.lower("exploit_maturity"), "- ", "__").isin(T.MATURE), F.lit(False)), "crit": F.greatest(T.criticality_rank(F.col("asset_criticality")), T.criticality_rank(F.col("business_criticality"))),
        "strong": assessment.strong_control(F.col("compensating_controls")), "isolated": T.isolated(X.parse_bool(F.col("isolation")), F.col("isolation"), F.col("network_zone")),
    })
    out = T.tiered(f)
    return explained(out.withColumn("drivers", T.drivers(out)))


def asset_tokens() -> Column:
    """What a finding's target can be recognised by in other sources."""
    name = lambda c: F.when(X.usable(F.col(c)), F.concat(F.lit("asset-name:"), F.lower(F.trim(c))))
    own = F.when(X.usable(F.col("asset_id")), F.concat_ws(":", F.lit("asset-id"), "provider", F.lower(F.trim("asset_id"))))
    ips = F.transform("ip_addresses", lambda x: F.concat(F.lit("asset-ip:"), x))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(own, name("hostname"), name("fqdn"))), ips)))


def correlate(f: DataFrame) -> DataFrame:
    """f with group_id, stable_entity, canonical, relation, the number of exact copies of a row, and of links refused.

    Findings are linked if they share a vulnerability and a target token. A link by address alone is refused where both
    ends name hosts and share none.
    """
    f = E.observed(f).withColumn("tokens", asset_tokens()).withColumn("hosts", F.filter("tokens", lambda t: t.startswith("asset-name:")))
    ends = f.select("id", "ordinal", "vulnerability", "hosts", F.explode("tokens").alias("token"))
    first = ends.groupBy("vulnerability", "token").agg(F.min_by(F.struct("id", "hosts"), F.struct("ordinal", "id")).alias("o"))
    links = ends.join(first, ["vulnerability", "token"]).filter(F.col("id") != F.col("o.id"))
    apart = F.col("token").startswith("asset-ip:") & (F.size("hosts") > 0) & (F.size("o.hosts") > 0) & ~F.arrays_overlap("hosts", "o.hosts")
    edges = G.written(links.withColumn("blocked", apart).select("id", F.col("o.id").alias("owner"), "blocked"), "links")
    root = G.components(edges.filter("NOT blocked").select("id", "owner").distinct(), "owner", "id")
    f = f.join(root.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rank = F.coalesce("tier_rank", F.lit(9))
    if "reconciled" not in f.columns:
        f = f.withColumn("reconciled", F.lit(False))
    g = f.groupBy("root").agg(
        F.min_by("id", F.struct(rank, "id")).alias("canonical"), F.countDistinct("provider").alias("sources"), F.count("*").alias("members"), G.joined(F.collect_set("severity")).alias("severities"),
    ).join(grouping.stable(f), "root")
    ends = edges.filter("blocked").select("id", F.col("owner").alias("other")).union(edges.filter("blocked").select("owner", "id"))
    f = f.join(ends.distinct().groupBy("id").agg(F.count("*").alias("conflicts")), "id", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)))
    copies = f.groupBy("root", "fingerprint").agg(F.min("id").alias("first_copy"), F.count("*").alias("copies"))
    out = f.join(g, "root").join(copies, ["root", "fingerprint"])
    relation = F.when(F.col("id") == F.col("canonical"), None).when((F.col("copies") > 1), "duplicate").when(F.col("sources") > 1, "cross_provider_duplicate").otherwise("related")
    return out.withColumn("relation", relation).drop("root", "first_copy")


def remediate(f: DataFrame) -> DataFrame:
    """f with the kind and key of its action, and action_id."""
    target = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in ("fqdn", "hostname", "asset_id")), F.get("ip_addresses", F.lit(0)))
    key = G.action_key(F.col("solution"), F.col("remediation_action_id"), F.col("remediation_id"), F.col("package"), F.col("fixed_version"), F.col("group_id"), F.col("entity"), target, F.col("vulnerability"), F.col("id"))
    f = f.withColumn("__a", key).withColumns({"action_kind": F.col("__a.kind"), "action_key": F.col("__a.key")}).drop("__a")
    return f.withColumn("action_id", F.concat(F.lit("RA-"), F.upper(X.stable_id(F.col("action_kind"), F.col("action_key"), length=12))))


def actions(f: DataFrame) -> DataFrame:
    """One row per action over findings that are neither false positives, done, nor unconfirmed."""
    return remediation.summaries(remediate(remediation.live(f)))


def run(raw: DataFrame) -> dict[str, DataFrame]:
    """All stages; tables are written where later stages read them twice."""
    normal = G.written(normalise(raw), "normalised")
    ranked = G.written(tiers(assess(accepted(normal))), "tiers")
    grouped = G.written(correlate(ranked), "correlated")
    groups = G.written(grouping.table(grouped), "groups")
    return {
        "normalised": normal, "accounting": accounting(normal), "tiers": ranked, "correlated": grouped, "groups": groups, "correlation_stats": grouping.stats(groups), "rollups": grouping.rollup(grouped, groups),
        "actions": actions(grouped), "action_evidence": remediation.evidence(remediate(remediation.live(grouped))),
    }
