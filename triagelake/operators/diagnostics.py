"""What is doubtful in a mapped record, as warnings and a confidence; and a bounded summary of a provider's mapping.

Warnings are native expressions but for the addresses, which an Arrow batch function parses.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from triagelake.functions import text as X
from triagelake.sources import inference

# Fixed values.
EXTRA_COLUMNS = "CSV row contains extra columns; preserved as opaque source data"
NO_CVE = "vulnerability value is not a valid CVE; source value preserved"
NO_OCCURRENCE = "provider occurrence identifier unavailable; import-instance identity uses the source pointer"
NO_VULNERABILITY = "required vulnerability identity is missing"
NO_TITLE = "title and vulnerability identifier are missing"
NO_ASSET = "asset identity is missing"
NO_SEVERITY = "source severity and CVSS score are missing"
INVALID_MARKER = "record contains an explicit malformed/invalid marker"
BAD_ADDRESS = "invalid IP observations were preserved but excluded from canonical asset identity"
BAD_PORT = "port is outside the valid range 1-65535 or is not an integer"
BAD_SCORE = "CVSS score is outside the valid range 0-10 or is not numeric"


@F.pandas_udf(ArrayType(StringType()))
def strays(values: pd.Series) -> pd.Series:
    """The parts of a text that stand for an address and are none."""
    import ipaddress

    def bad(part: str) -> bool:
        try:
            ipaddress.ip_address(part)
        except ValueError:
            return part.lower() not in X.TARGET_PLACEHOLDERS
        return False

    return values.map(lambda v: sorted({p for p in (v or "").replace(",", " ").replace(";", " ").split() if bad(p)}))


def warnings(port_given: Column, target: Column, marked: Column) -> Column:
    """The warnings of a mapped record, in a fixed order.

    Of the record: title, severity_original, cve, cves, cvss_score, cvss, port, source_record_id, vulnerability_identifier, invalid_ips, exact.
    """
    some = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    has_vulnerability = (F.size("cves") > 0) | some("vulnerability_identifier")
    occurrence = X.usable(F.col("source_record_id"), X.PLACEHOLDERS)
    tests = [
        (F.element_at("exact", "extracolumns").isNotNull(), EXTRA_COLUMNS), (some("cve") & ~F.col("cve").rlike(r"(?i)\bCVE-\d{4}-\d{4,}\b"), NO_CVE), (~occurrence & has_vulnerability, NO_OCCURRENCE),
        (~has_vulnerability, NO_VULNERABILITY), (~some("title") & ~has_vulnerability, NO_TITLE), (~target, NO_ASSET), (~some("severity_original") & ~some("cvss_score"), NO_SEVERITY), (marked, INVALID_MARKER),
        (F.size("invalid_ips") > 0, BAD_ADDRESS), (F.coalesce(F.trim(port_given) != "", F.lit(False)) & F.col("port").isNull(), BAD_PORT), (some("cvss_score") & F.col("cvss").isNull(), BAD_SCORE),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), said) for test, said in tests]))


def confidence(warned: Column) -> Column:
    """1 without warnings, 0.12 less for each, 0.55 at least."""
    return F.round(F.greatest(F.lit(0.55), 1 - 0.12 * F.size(warned)), 2)


def mapping_summaries(raw: DataFrame, samples: int = 3) -> list[dict]:
    """For each provider, from its first records by ordinal: where fields are found, what is left over, and an inferred mapping.

    At most `samples` records per provider come to the driver; there are eight providers.
    """
    place = F.row_number().over(Window.partitionBy("provider").orderBy("ordinal"))
    # malformed rows can't be mapped; a limit per provider is applied before the shuffle
    head = raw.filter("malformed IS NULL").select("provider", "ordinal", "original_record", place.alias("place")).filter(F.col("place") <= samples).orderBy("provider", "place").collect()
    out = []
    for provider in sorted({r.provider for r in head}):
        records = [json.loads(r.original_record) for r in head if r.provider == provider]
        out.append({"adapter": provider, **inference.summary(records, provider)})
    return out
