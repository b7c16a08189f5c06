"""Exports of several families, written here, through all stages."""

import json

import pytest

from triagelake.operators import pipeline, report, tier
from triagelake.sources import scan

EXPORTS = {
    "a/tenable.json": json.dumps({"findings": [
        {"pluginID": "T1", "pluginName": "Remote code execution in gateway", "cve": "CVE-2024-1111", "severity": "Critical", "cvss3BaseScore": 9.8, "exploitedInWild": True, "internetExposed": True,
         "businessCriticality": "critical", "asset": {"uuid": "u-1", "hostname": "Gate01", "ipv4": "192.0.2.10"}, "solution": "Install KB12345 now"},
        {"pluginID": "T2", "pluginName": "Old library", "cve": "CVE-2024-2222", "severity": "medium", "asset": {"uuid": "u-2", "hostname": "db02"}},
    ]}),
    "b/qualys.json": json.dumps({"vulnerabilities": [{"QID": "900", "TITLE": "RCE gateway", "CVE_ID": "cve-2024-1111", "SEVERITY": 5, "HOSTNAME": "gate01", "INTERNET_EXPOSED": "yes", "SOLUTION": "Patch it"}]}),
    "c/machines.json": json.dumps({"value": [{"id": "d1", "machineId": "m1", "cveId": "CVE-2024-3333", "severity": "Low", "productName": "tool", "status": "Fixed"}]}),
    "d/lines.jsonl": '{"id": "G1", "title": "weak", "cve": "CVE-2024-4444", "severity": "low", "asset_id": "x1"}\n\nnot json\n{"id": "G2", "id": "G3", "cve": "CVE-2024-5555", "asset_id": "x2"}\n{"id": "G4", "title": "no target", "cve": "CVE-2024-6666"}\n[1]\n',
    "e/table.csv": "﻿issue_id,title,cve,severity,hostname,status,solution\nC1,Café,CVE-2024-7777,high,web01,Risk-Accepted,=1+1\nC1,Café,CVE-2024-7777,high,web01,Risk-Accepted,=1+1\nC3,short\n",
    "f/scan.nessus": '<?xml version="1.0"?><NessusClientData_v2><Report><ReportHost name="n01"><HostProperties><tag name="host-ip">192.0.2.77</tag></HostProperties>'
    '<ReportItem port="443" severity="2" pluginID="55" pluginName="TLS"><cve>CVE-2024-8888</cve><risk_factor>Medium</risk_factor></ReportItem></ReportHost></Report></NessusClientData_v2>',
    "g/evil.xml": '<!DOCTYPE x [<!ENTITY a "b">]><HOST>&a;</HOST>',
    "g/notes.txt": "ignored",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("exports")
    for name, text in EXPORTS.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    return pipeline.run(scan.read_raw(spark, str(root)))


def test_nothing_is_lost(tables):
    rows = tables["normalised"].collect()
    assert len(rows) == 2 + 1 + 1 + 5 + 3 + 1 + 1
    assert {r.provider for r in rows if not r.malformed} == {"tenable", "qualys", "defender", "generic_json", "generic_csv", "nessus"}
    count = {r.state: r.records for r in tables["accounting"].collect()}
    assert sum(count.values()) == len(rows) and count["quarantined"] == 6
    why = {r.record_pointer: r.reason for r in rows if r.state == "quarantined"}
    assert why["/lines/4"] == "duplicate keys" and why["/lines/5"] == "missing required target identity" and "bad line" in why["/lines/3"]


def test_tiers_and_groups(tables):
    by = {r.source_record_id or r.vulnerability_identifier: r for r in tables["correlated"].collect()}
    assert by["T1"].tier == "P0" and by["T1"].vulnerability == "CVE-2024-1111" and by["T1"].hostname == "Gate01"
    assert by["900"].group_id == by["T1"].group_id and by["900"].relation == "cross_provider_duplicate" and by["T1"].relation is None
    assert by["d1"].disposition == "remediated" and by["d1"].effective is None
    assert by["C1"].disposition == "accepted_risk"
    assert [r.relation for r in tables["correlated"].filter("provider = 'generic_csv'").orderBy("ordinal").collect()].count("duplicate") == 1
    nessus = tables["correlated"].filter("provider = 'nessus'").first()
    assert nessus.hostname == "n01" and nessus.ip_addresses == ["192.0.2.77"] and nessus.port == 443 and nessus.severity == "medium"


def test_actions(tables):
    a = {r.action_kind: r for r in tables["actions"].collect()}
    assert a["explicit_action"].action_key == "kb12345" and a["explicit_action"].highest_active == 0
    assert sum(r.members for r in tables["actions"].collect()) == tables["correlated"].filter("disposition <> 'remediated'").count()


def test_action_table(tables):
    a = {r.action_kind: r for r in tables["actions"].collect()}["explicit_action"]
    assert a.action == "Install KB12345 now" and (a.members, a.occurrences, a.assets) == (1, 1, 1) and a.priorities == {"P0": 1} == a.active_priorities and a.dispositions == {"confirmed": 1}
    assert a.providers == ["tenable"] and a.sample[0].tier == "P0" and "CISA_KEV=true" not in a.sample[0].drivers and "exploited_in_wild=true" in a.sample[0].drivers
    held = {(r.role, r.value) for r in tables["action_evidence"].filter(f"action_id = '{a.action_id}'").collect()}
    assert {("identifier", "CVE-2024-1111"), ("identifier", "tenable:vulnerability:T1"), ("canonical_asset", "gate01"), ("asset_observation", "192.0.2.10"), ("solution", "install kb12345 now")} <= held
    stated = {r.action for r in tables["actions"].collect()}
    assert "Investigate and remediate the finding" in stated


def test_group_tables(tables):
    groups = tables["groups"].collect()
    assert sum(g.members for g in groups) == tables["correlated"].count() and len({g.group_id for g in groups}) == len(groups)
    shared = next(g for g in groups if len(g.providers) > 1)
    assert shared.providers == ["qualys", "tenable"] and shared.cross_provider_duplicates == 1 and shared.conflicting_severities == [] and sum(shared.priorities.values()) == 2
    s = tables["correlation_stats"].first()
    assert s.records == tables["correlated"].count() and s.groups == len(groups) and s.duplicates == 1 == s.exact_duplicate_groups and s.cross_provider_groups == 1 and s.blocked_conflict_edges == 0
    r = {r.vulnerability: r for r in tables["rollups"].collect()}["CVE-2024-1111"]
    assert r.findings == 2 and r.groups == 1 and r.assets == 3 and r.rollup_id.startswith("vr-")


def test_reports(tables, tmp_path):
    f = pipeline.remediate(tables["correlated"])
    counts = {r.measure: r.value for r in report.summary(f).collect()}
    assert counts["total"] == f.count() and sum(counts[f"P{i}"] for i in range(5)) + counts["unassigned"] == counts["total"]
    assert report.queue(f, 1).first().tier == "P0"
    csv = report.csv_rows(f).collect()
    assert len(csv) == counts["total"]
    assert "source_path" not in report.shareable(f).columns and report.shareable(f).first().original_record.startswith("[REDACTED_SOURCE_RECORD sha256:")
    lines = report.replay(f)
    path = str(tmp_path / "replay.jsonl")
    report.export(lines, path)
    assert report.validate(path)
    assert report.fingerprint(lines).collect() == report.fingerprint(lines.repartition(7)).collect()
    (tmp_path / "bad.jsonl").write_text(open(path).read().replace("Gate01", "Gate02"))
    assert not report.validate(str(tmp_path / "bad.jsonl"))


def test_golden_grid(spark):
    """Active exploitation is never below P2, over a grid of inputs."""
    grid = spark.range(0, 2 * 5 * 2 * 4 * 2).selectExpr(
        "id % 2 = 1 AS internet", "cast(id / 2 as int) % 5 AS impact", "cast(id / 10 as int) % 2 = 1 AS mature", "cast(id / 20 as int) % 4 AS crit", "cast(id / 80 as int) % 2 = 1 AS strong", "true AS active", "false AS isolated", "cast(null as double) AS epss", "'confirmed' AS disposition"
    )
    out = tier.tiered(grid)
    assert out.filter("tier_rank > 2").count() == 0 and out.filter("tier = 'P0'").count() == out.filter("impact >= 4 AND internet AND crit >= 3").count()
