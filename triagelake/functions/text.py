"""Scalar functions over source text, as Column expressions: all stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRUE_WORDS = ["true", "yes", "y", "1", "on", "active", "open", "listed", "exploited"]
FALSE_WORDS = ["false", "no", "n", "0", "off", "inactive", "closed", "not listed", "none"]
PLACEHOLDERS = ["", "none", "null", "unknown", "n/a", "na", "not available", "not_applicable", "placeholder", "record", "0", "-"]
TARGET_PLACEHOLDERS = [*PLACEHOLDERS, "unk", "not applicable", "value", "empty", "nil", "false", "--"]
SEVERITY_WORDS = {
    "critical": "critical", "crit": "critical", "severe": "high", "high": "high", "medium": "medium", "moderate": "medium", "med": "medium",
    "low": "low", "info": "none", "informational": "none", "none": "none", "negligible": "none",
}
STATUS_WORDS = {
    "fixed": "remediated", "resolved": "remediated", "closed": "remediated", "remediated": "remediated", "false_positive": "false_positive", "falsepositive": "false_positive",
    "accepted_risk": "accepted_risk", "risk_accepted": "accepted_risk", "accepted": "accepted_risk", "mitigated": "mitigated", "open": "confirmed", "active": "confirmed",
}
IDENTIFIER = r"(?i)\b(CVE-\d{4}-\d{4,}|GHSA(?:-[0-9a-z]{4}){3}|OSV-\d{4}-\d+|CWE-\d+)\b"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)$"


def norm_key(c: Column) -> Column:
    """Lower case without anything but letters and digits of ASCII."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def squeezed(c: Column) -> Column:
    """Trimmed, lower case, runs of white space as one blank; null as empty."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The table's value of c, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def parse_bool(c: Column) -> Column:
    """True, false or null by a fixed set of words."""
    w = F.lower(F.trim(c))
    return F.when(w.isin(TRUE_WORDS), True).when(w.isin(FALSE_WORDS), False)


def parse_float(c: Column) -> Column:
    """A plain decimal number, commas left out; no exponents."""
    t = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def bounded(x: Column, lo: float, hi: float) -> Column:
    return F.when((x >= lo) & (x <= hi), x)


def parse_cvss(c: Column) -> Column:
    return bounded(parse_float(c), 0, 10)


def parse_epss(c: Column) -> Column:
    """A share of 0 to 1; a percentage only if it ends with the sign."""
    t = F.trim(c)
    share = F.when(t.endswith("%"), parse_float(F.regexp_replace(t, "%$", "")) / 100).otherwise(parse_float(t))
    return bounded(share, 0, 1)


def parse_port(c: Column) -> Column:
    x = parse_float(c)
    return F.when((x == F.floor(x)) & (x >= 1) & (x <= 65535), x.cast("int"))


def parse_time(c: Column) -> Column:
    """ISO 8601 as UTC text ending in Z; a time without a zone is UTC."""
    t = F.try_to_timestamp(F.trim(c))
    return F.when(t.isNotNull(), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def as_list(c: Column) -> Column:
    """Parts between commas and semicolons, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def unique_text(c: Column) -> Column:
    """The first of each text of a list, whatever its case, in order."""
    step = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x))
    return F.aggregate(c, F.array().cast("array<string>"), step)


def identifiers(c: Column) -> Column:
    """The distinct vulnerability and weakness identifiers of a text, upper case, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(IDENTIFIER), 1), F.upper)))


def score_band(x: Column) -> Column:
    """The severity of a score of 0 to 10, else null."""
    return F.when((x < 0) | (x > 10), None).when(x >= 9, "critical").when(x >= 7, "high").when(x >= 4, "medium").when(x > 0, "low").when(x == 0, "none")


def severity_basis(c: Column, cvss: Column | None = None, native_ordinal: bool = False) -> Column:
    """struct(severity, basis): a plain number by the provider's ordinals, small ordinals or bands of 0 to 10; then words; then the score.

    severity is critical, high, medium, low, none or unknown. native_ordinal: 1 to 5, as some providers count.
    """
    x = F.when(c.rlike(r"^\s*\d+(\.\d+)?\s*$"), parse_float(c))
    whole = x == F.floor(x)
    five = F.when(x == 5, "critical").when(x.isin(3, 4), "high").when(x == 2, "medium").when(x == 1, "low")
    four = F.when(x == 4, "critical").when(x == 3, "high").when(x == 2, "medium").when(x == 1, "low").when(x == 0, "none")
    word = F.lower(F.trim(c))
    said = lambda level, basis: F.struct(level.alias("severity"), (F.lit(basis) if isinstance(basis, str) else basis).alias("basis"))
    out = F.when(F.lit(native_ordinal) & whole & five.isNotNull(), said(five, "qualys_native_ordinal_1_5")).when(whole & four.isNotNull(), said(four, "numeric_provider_severity"))
    out = out.when(score_band(x).isNotNull(), said(score_band(x), "numeric_cvss_like_score"))
    out = out.when(lookup(word, SEVERITY_WORDS).isNotNull(), said(lookup(word, SEVERITY_WORDS), F.concat(F.lit("text_alias:"), word)))
    if cvss is not None:
        out = out.when(score_band(cvss).isNotNull(), said(score_band(cvss), "numeric_cvss_like_score"))
    return out.otherwise(said(F.lit("unknown"), "unrecognized_or_missing"))


def severity(c: Column, cvss: Column | None = None, native_ordinal: bool = False) -> Column:
    return severity_basis(c, cvss, native_ordinal)["severity"]


def status(c: Column) -> Column:
    """The common name of a workflow status; an unknown one as it is, in lower case with underscores."""
    t = F.translate(F.lower(F.trim(c)), "- ", "__")
    return F.coalesce(lookup(t, STATUS_WORDS), t)


def disposition(c: Column) -> Column:
    """What a status says of a finding; anything unknown is confirmed."""
    s = status(c)
    return F.when(s.isin("confirmed", "remediated", "false_positive", "accepted_risk", "mitigated", "unconfirmed"), s).otherwise("confirmed")


def pointer_escape(c: Column) -> Column:
    """One step of a JSON pointer."""
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def csv_safe(c: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def stable_id(*parts: Column, length: int = 24) -> Column:
    """The first characters of the SHA-256 of the parts as a compact JSON array."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256), 1, length)


def usable(c: Column, placeholders: list[str] = TARGET_PLACEHOLDERS) -> Column:
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(placeholders)
