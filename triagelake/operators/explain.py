"""Why a finding has its tier: guards, drivers with their values, and a sentence. Narrow projections over tiered findings.

Columns of tier.tiered are needed. Others (compensating_controls, exploit_available, kev, ...) are used where they are there.
Nulls count as no evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import as_list
from triagelake.operators.tier import any_floor, truth

# Fixed values.
IMPACT_NAMES = ["unknown", "low", "medium", "high", "critical"]
CRITICALITY_NAMES = ["low", "medium", "high", "critical"]
NO_CONTROL = ["none", "no", "false", "n/a", "na", "unknown"]
#: Name, reason if triggered, reason if not.
GUARDS = [
    ("active_exploitation_guard", "KEV or exploited-in-wild evidence; final priority cannot be lower than P2", "no active exploitation evidence"),
    ("active_exploitation_minimum_guard", "active exploitation/KEV floor enforced", "no active exploitation/KEV floor applies"),
    ("internet_critical_asset_guard", "internet exposure and critical asset context", "internet/critical-asset combination not established"),
    ("functional_exploit_guard", "explicit mature/reliable exploit maturity", "mature exploit not established"),
    ("incident_priority_guard", "critical impact, active exploitation/KEV, internet exposure, and critical consequence; strong controls do not neutralize incident evidence", "incident guard combination not established"),
    ("control_effectiveness_guard", "strong compensating control evidence", "strong compensating control not established"),
    ("network_isolation_guard", "isolated or segmented network placement", "isolated network placement not established"),
    ("mitigation_reduction_guard", "compensating controls recorded", "no compensating controls recorded"),
    ("control_deescalation_guard", "strong controls materially reduce a non-urgent, low-likelihood finding", "strong evidence or insufficient control/de-escalation conditions"),
    ("isolation_deescalation_guard", "isolation materially reduces a non-urgent, low-likelihood finding", "strong evidence or insufficient isolation/de-escalation conditions"),
    ("mitigation_selection_applied", "selected P4 because low likelihood and internal/controlled or isolated placement support backlog treatment", "no eligible de-escalation; stronger exploitation, exposure, likelihood, or consequence evidence governs"),
    ("mitigation_reduction_applied", "", "no generic post-tier reduction; mitigation was part of tier selection"),
    ("isolation_reduction_applied", "", "no generic post-tier reduction; isolation was part of tier selection"),
]
FLOOR_NOT_NEEDED = "active exploitation/KEV floor not needed"
EXISTS_ONLY = "exploit maturity is not mature; exploit_available establishes existence only"
RETAINED = "retained P3 because critical business/asset consequence warrants monitored remediation despite controls/isolation"
BECAUSE = "{tier} because {impact} impact was evaluated with independent threat, exposure, asset criticality, and mitigation evidence."
INCIDENT = (
    "P0 because active exploitation/KEV, internet exposure, and critical consequence triggered the incident guard; {note}; strong controls are recorded but do not neutralize that stronger evidence; "
    "technical impact evidence was evaluated as {impact}."
)
INCIDENT_MATURE = "mature exploit evidence also supports the decision"
INCIDENT_ACTIVE = "genuine active exploitation/KEV evidence is sufficient without mature-exploit classification"
BACKLOG = "P4 because no urgent exploitation/exposure path is established and low context, strong controls, or isolation keep the finding in the hygiene/backlog tier."


def number(x: Column) -> Column:
    """A number with up to six significant digits and no zeros at its end, as in 0.55, 3 and 5e-05."""
    short = F.lower(F.call_function("format_number", x.cast("double"), F.lit("0.#####E00")))
    plain = F.regexp_replace(short.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    size = F.abs(x)
    return F.when(size == 0, "0").when(size >= 1e6, F.replace(short, F.lit("e"), F.lit("e+"))).when(size < 1e-4, short).otherwise(plain)


def named(rank: Column, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), rank.cast("int"))


def optional(f: DataFrame, name: str, kind: str = "string") -> Column:
    """A column that need not be there."""
    return F.col(name).cast(kind) if name in f.columns else F.lit(None).cast(kind)


def controls(f: DataFrame) -> Column:
    """The compensating controls that a finding names."""
    return F.filter(as_list(optional(f, "compensating_controls")), lambda c: ~F.lower(c).isin(NO_CONTROL))


def _conditions(f: DataFrame) -> list[Column]:
    """What triggers each guard, in the order of GUARDS."""
    active, internet, mature, strong, apart = (truth(F.col(c)) for c in ("active", "internet", "mature", "strong", "isolated"))
    quiet = ~(active | internet | mature | F.coalesce(F.col("epss") >= 0.5, F.lit(False)))
    recorded = F.size(controls(f)) > 0
    never = F.lit(False)
    return [
        active, any_floor(), internet & (F.col("crit") >= 2), mature, F.col("base_rank") == 0, strong, apart, recorded,
        strong & quiet, apart & quiet, F.col("eased"), never, never,
    ]


def guards(f: DataFrame) -> Column:
    """array of struct(name, triggered, minimum_priority, reason): the thirteen guards of a decision in their order."""
    active, exists = truth(F.col("active")), truth(optional(f, "exploit_available", "boolean"))
    special = {
        "active_exploitation_minimum_guard": lambda yes, said: F.when(~yes & active, FLOOR_NOT_NEEDED).otherwise(said),
        "functional_exploit_guard": lambda yes, said: F.when(~yes & exists, EXISTS_ONLY).otherwise(said),
        "mitigation_selection_applied": lambda yes, said: F.when(yes & (F.col("crit") >= 3), RETAINED).otherwise(said),
    }
    out = []
    for (name, if_so, if_not), raw in zip(GUARDS, _conditions(f), strict=True):
        yes = F.coalesce(raw, F.lit(False))
        reason = special.get(name, lambda _, said: said)(yes, F.when(yes, if_so).otherwise(if_not))
        least = F.when(active, "P2") if name.startswith("active_exploitation") else F.lit(None).cast("string")
        out.append(F.struct(F.lit(name).alias("name"), yes.alias("triggered"), least.alias("minimum_priority"), reason.alias("reason")))
    return F.array(*out)


def explanation() -> Column:
    """One sentence on the tier."""
    impact = named(F.col("impact"), IMPACT_NAMES)
    fill = lambda text, **parts: reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), kv[1]), parts.items(), F.lit(text))
    note = F.when(truth(F.col("mature")), INCIDENT_MATURE).otherwise(INCIDENT_ACTIVE)
    return F.when(F.col("base_rank") == 0, fill(INCIDENT, note=note, impact=impact)).when(F.col("tier") == "P4", BACKLOG).otherwise(fill(BECAUSE, tier=F.col("tier"), impact=impact))


def evidence(f: DataFrame) -> Column:
    """Each piece of evidence with its value, in a fixed order; pieces that are not there are left out."""
    text = lambda name, label=None: F.concat(F.lit(f"{label or name}="), F.nullif(F.trim(optional(f, name)), F.lit("")))
    yes = lambda c, said: F.when(truth(c), said)
    flag = lambda name: truth(optional(f, name, "boolean"))
    own, crit = F.lower(optional(f, "impact_level")), F.col("crit")
    held = controls(f)
    context = " (context; no standalone tier promotion)"
    patch = optional(f, "patch_available", "boolean")
    return F.array_compact(F.array(
        F.concat(F.lit("technical_impact="), named(F.col("impact"), IMPACT_NAMES)),
        F.when(own != named(F.col("impact"), IMPACT_NAMES), F.concat(F.lit("analysis_technical_impact="), own)),
        F.when(F.col("impact") > F.coalesce(F.array_position(F.array(*[F.lit(n) for n in IMPACT_NAMES]), own) - 1, F.lit(0)), "technical_impact_floor=source severity/CVSS evidence") if "impact_level" in f.columns else F.lit(None).cast("string"),
        text("severity_original", "source_severity"), yes(flag("kev"), "CISA_KEV=true"), yes(flag("exploited_in_wild"), "exploited_in_wild=true"), yes(flag("exploit_available"), "exploit_available=true"),
        F.lower(text("exploit_maturity")), F.concat(F.lit("EPSS="), number(F.col("epss"))), yes(F.col("internet"), "internet_exposed=true"),
        F.when(crit >= 2, F.concat(F.lit("critical_asset="), named(crit, CRITICALITY_NAMES))), F.when(crit >= 3, "critical_business_or_asset_consequence=true"),
        F.when(F.size(held) > 0, F.concat(F.lit("compensating_controls="), F.array_join(F.slice(held, 1, 3), ", "))), yes(F.col("strong"), "strong_compensating_controls=true"),
        yes(F.col("isolated"), "network_isolation=true"), text("network_zone"), F.concat(F.lit("analysis_confidence="), number(optional(f, "confidence", "double"))),
        text("prevalence"), F.concat(text("data_sensitivity"), F.lit(context)), F.concat(text("environment"), F.lit(context)),
        F.when(patch.isNotNull(), F.concat(F.lit("patch_available="), F.when(patch, "True").otherwise("False"), F.lit(" (remediation planning context)"))),
        F.concat(text("vendor_risk_score"), F.lit(" (provider context; no standalone tier promotion)")),
    ))


def explained(f: DataFrame) -> DataFrame:
    """f with guards, evidence and explanation."""
    return f.withColumns({"guards": guards(f), "evidence": evidence(f), "explanation": explanation()})
