"""The tier of a finding: a cascade over independent evidence, one narrow projection without shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ["P0", "P1", "P2", "P3", "P4"]
# Fixed values.
MATURE = ["functional", "weaponized", "mature", "public", "in_the_wild", "reliable", "public_exploit", "active_exploitation", "functional_exploit", "weaponized_exploit"]
CONTROL_NEGATIVE = [
    "failed", "failure", "bypassed", "misconfigured", "degraded", "expired", "unavailable", "monitor only", "audit only", "disabled", "ineffective",
    "unsegmented", "unisolated", "not ", "without ", "no ",
]
CONTROL_POSITIVE = [
    "effective", "strong", "blocks", "block ", "deny", "prevents", "contained", "segmented", "isolated", "air gap", "air-gapped", "virtual patch", "mitigat", "compensat",
]
ISOLATION = ["isolated", "air-gapped", "airgapped", "segmented", "restricted", "quarantined"]


def truth(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def any_of(c: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found |= c.contains(t)
    return found


def control_state(c: Column) -> Column:
    """ineffective, effective or unknown, by the terms of a text; a negation goes first."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(any_of(t, CONTROL_NEGATIVE), "ineffective").when(any_of(t, CONTROL_POSITIVE), "effective").otherwise("unknown")


def isolated(flag: Column, *texts: Column) -> Column:
    out = truth(flag)
    for t in texts:
        out |= (control_state(t) == "effective") & any_of(F.lower(F.coalesce(t, F.lit(""))), ISOLATION)
    return out


def score_rank(score: Column) -> Column:
    return F.when(score >= 9, 4).when(score >= 7, 3).when(score >= 4, 2).when(score > 0, 1).otherwise(0)


def impact_rank(*words: Column) -> Column:
    ranks = [F.when(F.lower(w) == "critical", 4).when(F.lower(w) == "high", 3).when(F.lower(w) == "medium", 2).when(F.lower(w) == "low", 1).otherwise(0) for w in words]
    return F.greatest(*ranks) if len(ranks) > 1 else ranks[0]


def criticality_rank(c: Column) -> Column:
    return F.when(F.lower(c) == "critical", 3).when(F.lower(c) == "high", 2).when(F.lower(c) == "medium", 1).otherwise(0)


def chosen_rank(impact: Column, active: Column, internet: Column, crit: Column, epss: Column, mature: Column) -> Column:
    """0 to 4, before the floor and controls."""
    above = lambda x: F.coalesce(epss >= x, F.lit(False))
    asset, consequence = crit >= 2, crit >= 3
    reach, near = internet | asset, internet | consequence
    first = (impact >= 4) & active & internet & consequence
    second = (active & (impact >= 2) & reach) | ((mature | above(0.85)) & (impact >= 3) & near)
    third = (active & (impact >= 1) & (reach | above(0.5))) | (mature & (impact >= 2) & reach) | (above(0.5) & (impact >= 3)) | ((impact >= 3) & near) | ((impact >= 2) & reach & (mature | above(0.2)))
    return F.when(first, 0).when(second, 1).when(third, 2).when(impact >= 2, 3).otherwise(4)


def base_rank(impact: Column, active: Column, internet: Column, crit: Column, epss: Column, mature: Column) -> Column:
    """0 to 4, before controls; active exploitation is never below 2."""
    rank = chosen_rank(impact, active, internet, crit, epss, mature)
    return F.when(active, F.least(rank, F.lit(2))).otherwise(rank)


def any_floor() -> Column:
    """Whether active exploitation raised a finding to the floor."""
    evidence = [truth(F.col(c)) if c in ("active", "internet", "mature") else F.col(c) for c in ("impact", "active", "internet", "crit", "epss", "mature")]
    return truth(F.col("active")) & (chosen_rank(*evidence) > 2)


def tiered(f: DataFrame) -> DataFrame:
    """f with base_rank, tier_rank, tier and effective.

    f has impact (0-4), active, internet, mature, strong, isolated (booleans), crit (0-3), epss and disposition.
    """
    flags = {c: truth(F.col(c)) for c in ("active", "internet", "mature", "strong", "isolated")}
    f = f.withColumns(flags)
    base = base_rank(F.col("impact"), F.col("active"), F.col("internet"), F.col("crit"), F.col("epss"), F.col("mature"))
    f = f.withColumn("base_rank", base)
    eased = (F.col("strong") | F.col("isolated")) & ~(F.col("active") | F.col("internet") | F.col("mature") | F.coalesce(F.col("epss") >= 0.5, F.lit(False))) & (F.col("base_rank") > 1)
    f = f.withColumn("eased", eased).withColumn("tier_rank", F.when(eased, F.when(F.col("crit") >= 3, 3).otherwise(4)).otherwise(F.col("base_rank")))
    f = f.withColumn("tier", F.concat(F.lit("P"), F.col("tier_rank").cast("string")))
    return f.withColumn("effective", F.when(F.col("disposition") == "confirmed", F.col("tier")))


def drivers(f: DataFrame) -> Column:
    """Why a finding has its tier: the evidence that speaks for urgency, in a fixed order."""
    parts = [
        F.when(F.col("impact") >= 3, "impact"), F.when(F.col("active"), "active_exploitation"), F.when(F.col("mature"), "functional_exploit"),
        F.when(F.col("epss") >= 0.5, "likelihood"), F.when(F.col("internet"), "internet_exposure"), F.when(F.col("crit") >= 2, "critical_asset"),
        F.when(F.col("eased"), "mitigation_applied"),
    ]
    return F.array_compact(F.array(*parts))
