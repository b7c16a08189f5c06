"""What is known of each correlated group, of the run as a whole, and of each vulnerability across groups.

Findings have root (the component), id, provider, vulnerability, tier, severity, relation and what `entities.observed` gives. A
group may hold a third of all rows: its lists are of values with few kinds (providers, severities), and the rest are counts
or long tables with a row per value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import stable_id
from triagelake.operators.remediation import _counts
from triagelake.operators.report import TIERS

# Target kinds of an alias from the one preferred on.
PREFERRED = ["|target:fqdn:", "|target:hostname:", "|target:ip:"]
UNKNOWN = "unknown-vulnerability"


def preference(alias: Column) -> Column:
    """struct to order aliases by: the kind of target, then the text."""
    kind = F.lit(len(PREFERRED))
    for i in range(len(PREFERRED) - 1, -1, -1):
        kind = F.when(alias.contains(PREFERRED[i]), i).otherwise(kind)
    return F.struct(kind, alias)


def common_alias(f: DataFrame) -> DataFrame:
    """root, alias: the preferred one of the aliases that all findings of a group have."""
    size = f.groupBy("root").agg(F.countDistinct("id").alias("size"))
    held = f.select("root", "id", F.explode("aliases").alias("alias")).distinct().groupBy("root", "alias").agg(F.count("*").alias("held"))
    return held.join(size, "root").filter("held = size").groupBy("root").agg(F.min_by("alias", preference(F.col("alias"))).alias("alias"))


def anchor() -> Column:
    """What a finding is known by from run to run: its occurrence, else its target's name, address or id."""
    source = F.lower(F.trim(F.coalesce("provider", F.lit("unknown"))))
    occurrence = F.nullif(F.lower(F.trim(F.coalesce("source_record_id", F.lit("")))), F.lit(""))
    by_target = F.coalesce(
        F.concat(F.lit("asset-name:"), F.array_min("names")), F.concat(F.lit("asset-ip:"), F.array_min("ips")), F.concat(F.lit("asset-id:"), F.array_min("owned")),
    )
    return F.coalesce(F.when(occurrence.isNotNull(), F.concat_ws(":", F.lit("occurrence"), source, occurrence)), by_target)


def stable(f: DataFrame) -> DataFrame:
    """root, group_id, stable_entity: ids that stay the same from run to run while the evidence does.

    By the one reconciled entity or else the one entity; else, over several sources, by the common alias; else by the least anchor, or the
    least id where there is none. Needs reconciled (boolean) beside the rest.
    """
    g = f.groupBy("root").agg(
        F.min("entity").alias("e"), F.max("entity").alias("e2"), F.min(F.when(F.col("reconciled"), F.col("entity"))).alias("r"), F.max(F.when(F.col("reconciled"), F.col("entity"))).alias("r2"),
        F.countDistinct("provider").alias("sources"), F.min("vulnerability").alias("v"), F.min(anchor()).alias("anchor"), F.min("id").alias("least"),
    )
    g = g.join(common_alias(f), "root", "left")
    entity = F.when(F.col("r") == F.col("r2"), F.col("r")).when(F.col("e") == F.col("e2"), F.col("e"))
    named = F.when((F.col("sources") > 1) & F.col("alias").isNotNull(), stable_id(F.col("v"), F.lit("global-alias"), F.col("alias"))).otherwise(stable_id(F.col("v"), F.coalesce("anchor", "least")))
    made = F.when(entity.isNotNull(), stable_id(F.lit("entity-group"), entity)).otherwise(named)
    return g.select("root", F.concat(F.lit("g-"), made).alias("group_id"), entity.alias("stable_entity"))


def table(f: DataFrame) -> DataFrame:
    """One row per group: members, providers, severities where they conflict, tiers, counts by relation, and blocked links."""
    severities = F.array_sort(F.collect_set(F.coalesce("severity", F.lit("unknown"))))
    kind = lambda r: F.count_if(F.col("relation") == r)
    return f.groupBy("group_id").agg(
        F.first("canonical").alias("canonical"), F.first("stable_entity").alias("stable_entity"), F.min(F.coalesce("vulnerability", F.lit(UNKNOWN))).alias("vulnerability"), F.count("*").alias("members"),
        F.array_sort(F.collect_set("provider")).alias("providers"), F.when(F.size(severities) > 1, severities).otherwise(F.array().cast("array<string>")).alias("conflicting_severities"),
        _counts("tier", TIERS).alias("priorities"), kind("duplicate").alias("duplicates"), kind("cross_provider_duplicate").alias("cross_provider_duplicates"), kind("related").alias("related"),
        F.sum("conflicts").alias("conflict_ends"),
    )


def stats(groups: DataFrame) -> DataFrame:
    """One row: records, groups and how many of each kind, over the rows of `table`. conflict_ends counts both ends of a link."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return groups.agg(
        total("members").alias("records"), F.count("*").alias("groups"), total("duplicates").alias("duplicates"), F.count_if(F.col("duplicates") > 0).alias("exact_duplicate_groups"), total("related").alias("related"),
        F.count_if(F.size("providers") > 1).alias("cross_provider_groups"), F.count_if(F.col("cross_provider_duplicates") > 0).alias("cross_provider_duplicate_groups"),
        total("cross_provider_duplicates").alias("cross_provider_duplicate_records"), F.count_if(F.size("conflicting_severities") > 1).alias("conflicting_groups"), (total("conflict_ends") / 2).cast("long").alias("blocked_conflict_edges"),
    )


def rollup(f: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per known vulnerability across groups: findings, groups, distinct target tokens, providers.

    f gives the tokens by vulnerability, groups the rest; which groups belong to it are the rows of `groups`.
    """
    known = groups.filter(F.col("vulnerability") != UNKNOWN)
    totals = known.groupBy("vulnerability").agg(F.sum("members").alias("findings"), F.count("*").alias("groups"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("providers")))).alias("providers"))
    assets = f.select("vulnerability", F.explode("tokens").alias("token")).distinct().groupBy("vulnerability").agg(F.count("*").alias("assets"))
    out = totals.join(assets, "vulnerability", "left").withColumn("assets", F.coalesce("assets", F.lit(0)))
    return out.withColumn("rollup_id", F.concat(F.lit("vr-"), stable_id(F.col("vulnerability"), length=16)))
