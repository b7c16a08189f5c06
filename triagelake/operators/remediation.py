"""Shared remediation actions: one row per action with bounded columns, and a long table of all that belongs to each.

An action may stand on a third of all findings, so no list of its findings or assets is ever made: `evidence` has a row per
action, role and value, and the counts of `summaries` come from that table by aggregations with map-side partial results.

Findings have action_id, action_kind, action_key, id, ordinal, provider, tier, tier_rank and disposition; other columns are
used where they are there. Rows that repeat count once per id in `occurrences`, each in `members`. Nulls give no evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions.text import squeezed
from triagelake.operators.explain import optional
from triagelake.operators.report import DISPOSITIONS, TIERS

KEYS = ["action_id", "action_kind", "action_key"]
# Fixed values.
EXCLUDED = ["false_positive", "remediated", "unconfirmed"]
UPGRADE = ["package_upgrade", "fixed_version"]
UNSTATED = "Investigate and remediate the finding"


def live(f: DataFrame) -> DataFrame:
    """The findings that something is still to be done about."""
    return f.filter(~F.col("disposition").isin(EXCLUDED))


def _value(c: Column) -> Column:
    """Trimmed text, null if empty."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def canonical_asset(f: DataFrame) -> Column:
    """The name by which a target is counted: the first of fqdn, hostname, asset id and address."""
    ips = F.col("ip_addresses") if "ip_addresses" in f.columns else F.array().cast("array<string>")
    return F.coalesce(*(F.lower(_value(optional(f, c))) for c in ("fqdn", "hostname", "asset_id")), F.lower(_value(F.get(ips, F.lit(0)))))


def evidence(f: DataFrame) -> DataFrame:
    """action_id, role, value: everything an action rests on, each value once."""
    many = lambda c: F.col(c).cast("array<string>") if c in f.columns else F.array().cast("array<string>")
    one = lambda c: F.array(_value(c))
    fixed, package = optional(f, "fixed_version"), F.coalesce(_value(optional(f, "package")), _value(optional(f, "application")))
    native = F.when(_value(optional(f, "vulnerability_identifier")).isNotNull(), F.concat_ws(":", "provider", F.lit("vulnerability"), F.trim(optional(f, "vulnerability_identifier"))))
    roles = {
        "finding": one(F.col("id")), "asset_id": one(optional(f, "asset_id")), "canonical_asset": F.array(canonical_asset(f)), "correlation_group": one(optional(f, "group_id")),
        "asset_observation": F.transform(F.concat(F.array(optional(f, "fqdn"), optional(f, "hostname")), F.coalesce(many("ip_addresses"), F.array().cast("array<string>"))), lambda x: F.lower(_value(x))),
        "identifier": F.concat(F.coalesce(many("cves"), F.array().cast("array<string>")), F.array(native)), "solution": F.array(F.nullif(squeezed(optional(f, "solution")), F.lit(""))), "source_solution": one(optional(f, "solution")),
        "remediation_action_id": one(optional(f, "remediation_action_id")), "remediation_id": one(optional(f, "remediation_id")), "fixed_version": one(fixed), "package": F.array(package),
    }
    tag = lambda role: lambda x: F.struct(F.lit(role).alias("role"), x.alias("value"))
    pairs = F.flatten(F.array(*[F.transform(values, tag(role)) for role, values in roles.items()]))
    return f.select("action_id", F.explode(pairs).alias("p")).select("action_id", "p.role", "p.value").filter("value IS NOT NULL").distinct()


def text(f: DataFrame) -> Column:
    """What an action says, as its first finding in order has it."""
    upgrade = F.when(F.col("action_kind").isin(UPGRADE), F.concat(F.lit("Upgrade "), "action_key"))
    return F.coalesce(_value(optional(f, "solution")), upgrade, F.lit(UNSTATED))


def _counts(column: str, names: tuple[str, ...], among: Column | None = None) -> Column:
    """map of the names that occur to their counts."""
    among = F.lit(True) if among is None else among
    all_of = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.count_if(among & (F.col(column) == n)) for n in names]))
    return F.map_filter(all_of, lambda _, n: n > 0)


def summaries(f: DataFrame, sample: int = 25) -> DataFrame:
    """One row per action.

    action_id, action_kind, action_key, action (text), members, occurrences, assets, groups (distinct counts), providers (sorted),
    priorities, active_priorities, dispositions (maps to counts), highest (rank among all), highest_active (among confirmed), and sample: up to
    `sample` findings by ordinal and id with their tiers and evidence.
    """
    said = evidence(f).groupBy("action_id").agg(*(F.count_if(F.col("role") == role).alias(name) for role, name in (("finding", "occurrences"), ("canonical_asset", "assets"), ("correlation_group", "groups"))))
    confirmed = F.col("disposition") == "confirmed"
    totals = f.groupBy(*KEYS).agg(
        F.min_by(text(f), F.struct("ordinal", "id")).alias("action"), F.count("*").alias("members"), F.array_sort(F.collect_set("provider")).alias("providers"), _counts("tier", TIERS).alias("priorities"),
        _counts("tier", TIERS, confirmed).alias("active_priorities"), _counts("disposition", DISPOSITIONS).alias("dispositions"), F.min("tier_rank").alias("highest"), F.min(F.when(confirmed, F.col("tier_rank"))).alias("highest_active"),
    )
    # the planner keeps at most `sample` rows per action before the shuffle
    first = f.withColumn("__r", F.row_number().over(Window.partitionBy("action_id").orderBy("ordinal", "id"))).filter(F.col("__r") <= sample)
    drivers = F.col("evidence") if "evidence" in f.columns else F.array().cast("array<string>")
    refs = first.select("action_id", F.struct(F.col("__r").alias("place"), "id", "provider", optional(f, "group_id").alias("group_id"), optional(f, "effective").alias("effective"), "tier", drivers.alias("drivers")).alias("ref"))
    refs = refs.groupBy("action_id").agg(F.array_sort(F.collect_list("ref")).alias("sample"))
    return totals.join(said, "action_id", "left").join(refs, "action_id")
