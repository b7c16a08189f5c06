"""What a finding's evidence says before it is given a tier: exposure, threat, exploitability, what is missing, seven views.

All narrow projections. Nulls are missing evidence. Columns that a table lacks count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.text import as_list
from triagelake.operators.explain import optional
from triagelake.operators.tier import control_state, truth

# Fixed values.
CONTROL_NEGATIVE = (
    r"\b(?:failed?|failure|bypass(?:ed)?|misconfigured?|degraded|expired|unavailable|"
    r"monitor\s+only|audit\s+only|disabled|ineffective|unsegmented|unisolated|"
    r"not|without|no)\b"
)
CONTROL_POSITIVE = (
    r"\b(?:effective|strong|blocks?|den(?:y|ies|ied)|prevents?|contained|"
    r"segmented|isolated|air[- ]?gapped|virtual\s+patch(?:ed)?|mitigat(?:es?|ed|ion)|"
    r"compensat(?:es?|ed|ing))\b"
)
NO_CONTROL = ["none", "no", "false", "not applicable", "n/a", "na", "unknown"]
MATURE = ["functional", "weaponized", "mature", "public", "in_the_wild", "reliable"]
JUDGE = "evidence retained with explicit uncertainty"
CHALLENGER = "cross-finding challenge deferred until correlation"
VENDOR_CONFLICT = "provider severity conflicts with vendor risk score"
#: Role, the statement it makes, the fields it looks at.
ROLES = [
    ("Exploitability Expert", "exploitability", ["exploit_available", "exploit_maturity", "epss"]),
    ("Exposure / Attack Path Expert", "exposure", ["internet_exposed", "asset_id", "hostname"]),
    ("Threat Intelligence Expert", "threat", ["kev", "exploited_in_wild", "epss"]),
    ("Asset / Business Criticality Expert", "business_criticality", ["business_criticality", "asset_criticality", "data_sensitivity"]),
    ("Remediation Expert", "remediation", ["solution", "fixed_version", "patch_available"]),
]


def control_evidence(c: Column) -> Column:
    """array of struct(text, state, effective) for each control that a text names; a control's name alone proves nothing."""

    def one(text: Column) -> Column:
        t = F.lower(text)
        state = F.when(t.isin(NO_CONTROL), "unknown").when(t.rlike(CONTROL_NEGATIVE), "ineffective").when(t.rlike(CONTROL_POSITIVE), "effective").otherwise("unknown")
        return F.struct(text.alias("text"), state.alias("state"), (state == "effective").alias("effective"))

    return F.transform(as_list(c), one)


def strong_control(c: Column) -> Column:
    """Whether any control that a text names is said to work."""
    return F.exists(control_evidence(c), lambda e: e["effective"] | (control_state(e["text"]) == "effective"))


def _some(f: DataFrame, name: str) -> Column:
    return F.coalesce(F.trim(optional(f, name)) != "", F.lit(False))


def remediation_available(f: DataFrame) -> Column:
    return _some(f, "solution") | _some(f, "fixed_version") | optional(f, "patch_available").isNotNull()


def analysed(f: DataFrame) -> DataFrame:
    """f with exposure, threat, exploitability, business_impact, missing_evidence, conflicts, confidence and council.

    Needs severity, epss, internet_exposed, exploited_in_wild and kev.
    """
    epss, wild, internet = F.col("epss").cast("double"), optional(f, "exploited_in_wild", "boolean"), optional(f, "internet_exposed", "boolean")
    listed, exploit = truth(optional(f, "kev", "boolean")), truth(optional(f, "exploit_available", "boolean"))
    maturity = F.translate(F.lower(F.trim(F.coalesce(optional(f, "exploit_maturity"), F.lit("")))), "- ", "__")
    mature, active = maturity.isin(MATURE), truth(wild) | listed
    above = lambda x: F.coalesce(epss >= x, F.lit(False))
    gaps = {
        "internet_exposure": internet.isNull(), "business_criticality": ~_some(f, "business_criticality") & ~_some(f, "asset_criticality"),
        "threat_intelligence": epss.isNull() & wild.isNull() & ~listed, "remediation_path": ~remediation_available(f),
    }
    score, level = optional(f, "vendor_risk_score", "double"), F.col("severity")
    odd = F.coalesce((level.isin("critical", "high") & (score < 4)) | (level.isin("low", "none") & (score >= 8)), F.lit(False))
    out = f.withColumns({
        "exposure": F.when(internet, "internet").when(~internet, "network").otherwise("unknown"),
        "threat": F.when(active, "active_exploitation").when(mature | (exploit & (maturity == "")) | above(0.7), "high_likelihood").otherwise("unconfirmed"),
        "exploitability": F.when(active, "active").when(mature, "mature").when(maturity != "", "poc").when(exploit, "public").when(above(0.7), "high").when(above(0.3), "moderate").otherwise("unknown"),
        "business_impact": F.coalesce(F.nullif(F.lower(F.trim(optional(f, "business_criticality"))), F.lit("")), F.lit("unknown")),
        "missing_evidence": F.array_compact(F.array(*[F.when(test, name) for name, test in gaps.items()])), "conflicts_noted": F.array_compact(F.array(F.when(odd, VENDOR_CONFLICT))),
        "remediation_known": F.when(remediation_available(f), "available").otherwise("unknown"),
    })
    return out.withColumn("confidence", F.round(F.greatest(F.lit(0.25), 1 - 0.08 * F.size("missing_evidence")), 2))


def council(f: DataFrame) -> Column:
    """array of struct(role, conclusion, confidence, evidence_refs, missing_evidence): seven views of an analysed finding."""
    said = {"exploitability": "exploitability", "exposure": "exposure", "threat": "threat", "business_criticality": "business_impact", "remediation": "remediation_known"}
    texts = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>") if names else F.array().cast("array<string>")

    def view(role: str, conclusion: Column, refs: list[str], missing: Column, confidence: Column | None = None) -> Column:
        sure = F.col("confidence") if confidence is None else confidence
        return F.struct(F.lit(role).alias("role"), conclusion.alias("conclusion"), sure.cast("double").alias("confidence"), texts(refs).alias("evidence_refs"), missing.alias("missing_evidence"))

    views = [view(role, F.concat(F.lit(f"{name}="), said[name]), [r for r in refs if r in f.columns], F.array_intersect("missing_evidence", texts(refs))) for role, name, refs in ROLES]
    judge = view("Judge", F.lit(JUDGE), ["original_record", "mapping_confidence"], F.col("missing_evidence"))
    return F.array(*views, judge, view("Red Team / Challenge Reviewer", F.lit(CHALLENGER), ["original_record"], texts([]), F.lit(0.8)))
