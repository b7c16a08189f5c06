"""Report formats, redaction at any depth, and what a replay refuses."""

import io
import json

import pytest
from pyspark.sql import functions as F

from triagelake.operators import explain, report, tier

COLUMNS = (
    "id string, provider string, source_record_id string, title string, impact int, active boolean, internet boolean, mature boolean, strong boolean, isolated boolean, crit int, epss double, disposition string, "
    "cves array<string>, vulnerability_identifier string, asset_id string, hostname string, fqdn string, ip_addresses array<string>, original_record string, source_path string, api_key string, group_id string, action_id string"
)


def row(i, **kw):
    base = {
        "id": f"f{i}", "provider": "qualys", "source_record_id": None, "title": f"<b>{i}</b>", "impact": i % 5, "active": i % 2 == 0, "internet": True, "mature": False, "strong": False, "isolated": False, "crit": 3, "epss": None,
        "disposition": "confirmed" if i % 3 else "remediated", "cves": [f"CVE-2024-{1000 + i}"], "vulnerability_identifier": None, "asset_id": f"a{i}", "hostname": "=cmd", "fqdn": None, "ip_addresses": ["192.0.2.1"],
        "original_record": '{"a":1}', "source_path": "/x", "api_key": "k", "group_id": None, "action_id": None,
    }
    return tuple((base | kw).values())


@pytest.fixture(scope="module")
def findings(spark):
    f = spark.createDataFrame([row(i) for i in range(12)], COLUMNS)
    return explain.explained(tier.tiered(f)).cache()


@pytest.fixture(scope="module")
def actions(spark):
    return spark.createDataFrame([("RA-2", None), ("RA-1", 1), ("RA-0", 2)], "action_id string, highest_active int")


def test_json(spark, findings, actions):
    none, out = findings.limit(0), io.StringIO()
    report.write_json(out, findings, actions, none, {"run_dir": "/tmp/x", "name": "r"}, most=5)
    got = json.loads(out.getvalue())
    assert got["run"] == {"name": "r"} and got["summary"]["total_findings"] == 12 == len(got["findings"]) and got["quarantine"] == []
    assert got["active_queue_truncated"] and len(got["active_queue"]) == 5 and got["active_queue"][0]["tier"] == "P0"
    assert [a["action_id"] for a in got["remediation_actions"]] == ["RA-1", "RA-0", "RA-2"]
    assert {r["disposition"] for r in got["dispositions"]["records"]} == {"remediated"} and len(got["dispositions"]["records"]) == 4
    assert got["findings"][0]["api_key"] == "[REDACTED]" and "source_path" not in got["findings"][0]
    assert got["validation"]["provider_status"]["qualys"]["end_to_end_file_import_tested"] and not got["validation"]["provider_status"]["nessus"]["end_to_end_file_import_tested"]
    whole = report.payload(findings, actions, none)
    assert len(whole["active_queue"]) == 8 and whole["summary"] == got["summary"]
    assert json.loads(report.payload(findings, actions, none, raw=True)["findings"][0]["original_record"]) == {"a": 1}


def test_other_formats(spark, findings, actions, tmp_path):
    none = findings.limit(0)
    page = open(report.report(findings, actions, none, "html", str(tmp_path / "r.html"))).read()
    assert "&lt;b&gt;7&lt;/b&gt;" in page and "<b>7</b>" not in page and page.count("<tr>") == 13
    text = open(report.report(findings, actions, none, "table", str(tmp_path / "r.txt"))).read()
    assert "Total findings: 12 | Active queue: 8 | Remediation actions: 3" in text and text.count(" qualys ") == 8
    assert "... 6 more active findings" in report.table_text(findings, 0, 0, 2)
    report.report(findings, actions, none, "csv", str(tmp_path / "csv"))
    rows = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert rows.columns == list(report.CSV_COLUMNS) and len(rows.columns) == 18
    first = rows.orderBy("id").first()
    assert first.hostname == "'=cmd" and json.loads(first.cve) == ["CVE-2024-1000"]
    empty = io.StringIO()
    report.write_json(empty, none, actions.limit(0), none)
    assert json.loads(empty.getvalue())["findings"] == []
    with pytest.raises(ValueError):
        report.report(findings, actions, none, "pdf", "x")


def test_redaction_at_depth(spark):
    value = {"a": [{"Client-Secret": 1, "b": "C:\\x", "my_token": None}], "path": "p", "raw_record": {"z": 1}, "original": "kept", "n": 1}
    got = report.redacted(value)
    assert got["a"] == [{"Client-Secret": "[REDACTED]", "b": "[REDACTED_PATH]", "my_token": "[REDACTED]"}]
    assert "path" not in got and got["raw_record"].startswith("[REDACTED_SOURCE_RECORD sha256:") and got["original"] == "kept" and got["n"] == 1
    df = spark.createDataFrame([(json.dumps(value),), ("not json",), (None,)], "j string").select(report.redacted_json(F.col("j")).alias("j"))
    assert [None if r.j is None else json.loads(r.j) for r in df.collect()] == [got, "[REDACTED]", None]


def test_replay_refuses(spark, findings):
    report.require_valid(findings)
    bad = spark.createDataFrame([
        row(1, id=None), row(2, cves=["CVE-1"]), row(3, cves=[]), row(4, ip_addresses=["x"]), row(5, asset_id=" ", hostname=None, ip_addresses=None), row(6, cves=None, vulnerability_identifier="Q1"),
    ], COLUMNS)
    errors = [list(r.e) for r in bad.select(report.replay_errors(bad).alias("e")).collect()]
    assert [len(e) for e in errors] == [1, 1, 1, 1, 1, 0] and errors[4] == ["target identity is missing"]
    with pytest.raises(ValueError, match="asset contains an invalid IP"):
        report.require_valid(bad)
