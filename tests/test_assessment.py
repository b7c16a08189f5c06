from pyspark.sql import functions as F

from triagelake.operators import assessment

COLUMNS = (
    "severity string, epss double, internet_exposed boolean, exploited_in_wild boolean, kev boolean, exploit_available boolean, exploit_maturity string, business_criticality string, asset_criticality string, "
    "solution string, fixed_version string, patch_available boolean, vendor_risk_score double"
)


def test_controls(spark):
    text = "WAF blocks it; IDS disabled, a firewall; none; virtual patched; no-one denies"
    got = spark.range(1).select(assessment.control_evidence(F.lit(text)).alias("e"), assessment.strong_control(F.lit(text)).alias("s"), assessment.strong_control(F.lit("not effective; n/a")).alias("n"), assessment.strong_control(F.lit(None).cast("string")).alias("z")).first()
    assert [e.state for e in got.e] == ["effective", "ineffective", "unknown", "unknown", "effective", "ineffective"] and got.s and not got.n and not got.z


def test_analysis(spark):
    rows = [
        ("critical", 0.9, True, True, False, True, "PoC", "High", None, "patch", None, None, 3.0),
        ("low", 0.4, False, None, None, None, "Functional", None, "low", None, "2.0", None, 8.0),
        ("high", 0.7, None, False, None, True, None, " ", "", None, None, False, 5.0),
        (None,) * 13,
    ]
    f = assessment.analysed(spark.createDataFrame(rows, COLUMNS))
    a, b, c, d = f.withColumn("council", assessment.council(f)).collect()
    assert [(r.exposure, r.threat, r.exploitability) for r in (a, b, c, d)] == [("internet", "active_exploitation", "active"), ("network", "high_likelihood", "mature"), ("unknown", "high_likelihood", "public"), ("unknown", "unconfirmed", "unknown")]
    assert a.missing_evidence == [] and a.confidence == 1.0 and a.conflicts_noted == [assessment.VENDOR_CONFLICT] == b.conflicts_noted and c.conflicts_noted == []
    assert c.missing_evidence == ["internet_exposure", "business_criticality"] and c.confidence == 0.84 and len(d.missing_evidence) == 4 and d.confidence == 0.68
    assert [v.role for v in a.council][-2:] == ["Judge", "Red Team / Challenge Reviewer"] and len(a.council) == 7 and a.council[4].conclusion == "remediation=available" and d.council[5].missing_evidence == d.missing_evidence
