import pytest
from pyspark.sql import functions as F

from triagelake.operators import explain, tier

COLUMNS = "impact int, active boolean, internet boolean, mature boolean, strong boolean, isolated boolean, crit int, epss double, disposition string, compensating_controls string, exploit_available boolean, kev boolean"


def decide(spark, *rows):
    return explain.explained(tier.tiered(spark.createDataFrame(list(rows), COLUMNS))).collect()


@pytest.mark.parametrize("x", [0.55, 0.0, 3.0, 100.0, 0.00005, 1234567.0, 0.1234567, 2.5e-7])
def test_numbers(spark, x):
    assert spark.range(1).select(explain.number(F.lit(x))).first()[0] == f"{x:g}"


def test_guards_and_text(spark):
    worst, quiet, none = decide(
        spark, (4, True, True, False, True, False, 3, 0.9, "confirmed", "waf; none", True, True), (2, False, False, False, True, False, 3, 0.1, "confirmed", None, None, None), (None,) * 12,
    )
    by = {g.name: g for g in worst.guards}
    assert len(worst.guards) == 13 and by["incident_priority_guard"].triggered and by["mitigation_reduction_guard"].triggered
    assert by["active_exploitation_minimum_guard"].reason == explain.FLOOR_NOT_NEEDED and by["functional_exploit_guard"].reason == explain.EXISTS_ONLY
    assert worst.tier == "P0" and explain.INCIDENT_ACTIVE in worst.explanation and worst.explanation.endswith("as critical.")
    assert "EPSS=0.9" in worst.evidence and "CISA_KEV=true" in worst.evidence and "compensating_controls=waf" in worst.evidence
    assert quiet.tier == "P3" and {g.name: g.reason for g in quiet.guards}["mitigation_selection_applied"] == explain.RETAINED
    assert none.tier == "P4" and not any(g.triggered for g in none.guards) and none.explanation == explain.BACKLOG
