"""Semantic entities: a vulnerability on a target, recognised across providers and runs.

An observation's aliases pair each of its vulnerability's names with each of its target's names. A baseline's registry holds
what an earlier run knew of each entity; an observation inherits the one entity that shares an alias with it and whose
target evidence does not contradict it, and else keeps a handle of its own.

Findings have provider, id, source_record_id, cves, vulnerability_identifier, hostname, fqdn, asset_id, ip_addresses. Nulls
are no evidence. Counts of candidates and the evidence of entities come from aggregations; a join by alias is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import stable_id


def _clean(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))


def _name(c: str) -> Column:
    return F.rtrim(_clean(c), F.lit("."))


def _some(value: Column, prefix: Column | str) -> Column:
    """The value with its prefix, or null if it is empty."""
    return F.when(value != "", F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, value))


def source() -> Column:
    return F.coalesce(F.nullif(_clean("provider"), F.lit("")), F.lit("unknown"))


def vulnerability_names() -> Column:
    native = F.upper(F.trim(F.coalesce(F.col("vulnerability_identifier").cast("string"), F.lit(""))))
    cves = F.transform(F.coalesce("cves", F.array().cast("array<string>")), lambda v: _upper("cve:", v))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(cves, F.array(_some(native, F.concat(source(), F.lit(":vulnerability:"))))))))


def _upper(prefix: str, v: Column) -> Column:
    return F.when(F.trim(v) != "", F.concat(F.lit(prefix), F.upper(F.trim(v))))


def target_names() -> Column:
    ips = F.transform(F.coalesce("ip_addresses", F.array().cast("array<string>")), lambda v: F.when(F.trim(v) != "", F.concat(F.lit("ip:"), F.lower(F.trim(v)))))
    own = _some(_clean("asset_id"), F.concat(F.lit("asset-id:"), source(), F.lit(":")))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(_some(_name("fqdn"), "fqdn:"), _some(_name("hostname"), "hostname:"), own), ips))))


def aliases() -> Column:
    """Every name of the vulnerability on every name of the target, sorted."""
    pair = lambda v, t: F.concat(F.lit("vulnerability:"), v, F.lit("|target:"), t)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(vulnerability_names(), lambda v: F.transform(target_names(), lambda t: pair(v, t))))))


def signature(names: Column) -> Column:
    """What an observation shows of its identity; by its occurrence where it has no alias."""
    seen = F.substring(F.sha2(F.concat(F.lit('["observation",'), F.to_json(names), F.lit("]")), 256), 1, 24)
    occurrence = F.coalesce(F.nullif(F.trim(F.col("source_record_id").cast("string")), F.lit("")), F.col("id"))
    return F.concat(F.lit("obs-"), F.when(F.size(names) > 0, seen).otherwise(stable_id(F.lit("observation"), source(), occurrence)))


def observed(f: DataFrame) -> DataFrame:
    """f with aliases, signature, entity (a handle of its own) and the target evidence names, ips, owned."""
    names = F.array_distinct(F.array_compact(F.array(F.nullif(_name("fqdn"), F.lit("")), F.nullif(_name("hostname"), F.lit("")))))
    ips = F.array_distinct(F.transform(F.coalesce("ip_addresses", F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))))
    owned = F.array_compact(F.array(_some(_clean("asset_id"), F.concat(source(), F.lit(":")))))
    f = f.withColumns({"aliases": aliases(), "names": names, "ips": ips, "owned": owned})
    f = f.withColumn("signature", signature(F.col("aliases")))
    return f.withColumn("entity", F.concat(F.lit("se-"), stable_id(F.lit("independent-run"), F.col("signature"))))


def registry(baseline: DataFrame) -> DataFrame:
    """entity, aliases, names, ips, owned: all that the observations of each entity show."""
    union = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    return baseline.groupBy("entity").agg(*(union(c) for c in ("aliases", "names", "ips", "owned")))


def contradicts(a: str, b: str) -> Column:
    """Whether the target evidence of two sides (column prefixes) has both of a kind and nothing in common.

    Asset ids count only where both sides have one of the same provider.
    """
    apart = lambda x, y: (F.size(x) > 0) & (F.size(y) > 0) & ~F.arrays_overlap(x, y)
    provider = lambda c: F.transform(c, lambda v: F.element_at(F.split(v, ":"), 1))
    mine, theirs = F.col(f"{a}owned"), F.col(f"{b}owned")
    return apart(F.col(f"{a}names"), F.col(f"{b}names")) | apart(F.col(f"{a}ips"), F.col(f"{b}ips")) | (F.arrays_overlap(provider(mine), provider(theirs)) & ~F.arrays_overlap(mine, theirs))


def reconciled(current: DataFrame, known: DataFrame) -> DataFrame:
    """current with candidates (sorted entities), state and entity, which is the baseline's where state is reconciled.

    current: what `observed` gives, with a unique id; known: what `registry` gives. state: reconciled, conflict (the one
    candidate's target evidence contradicts), ambiguous (several candidates) or unreconciled (none).
    """
    owners = known.select(F.explode("aliases").alias("alias"), F.col("entity").alias("owner"))
    found = current.select("id", F.explode("aliases").alias("alias")).join(owners, "alias").groupBy("id").agg(F.array_sort(F.collect_set("owner")).alias("candidates"))
    rows = current.join(found, "id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    one = rows.withColumn("one", F.when(F.size("candidates") == 1, F.col("candidates")[0]))
    evidence = known.select(F.col("entity").alias("one"), *(F.col(c).alias(f"known_{c}") for c in ("names", "ips", "owned")))
    both = one.join(evidence, "one", "left")
    n = F.size("candidates")
    state = F.when(n > 1, "ambiguous").when(n == 0, "unreconciled").when(F.coalesce(contradicts("", "known_"), F.lit(False)), "conflict").otherwise("reconciled")
    both = both.withColumn("state", state).withColumn("entity", F.when(F.col("state") == "reconciled", F.col("one")).otherwise(F.col("entity")))
    return both.drop("one", "known_names", "known_ips", "known_owned")
