import json

import pytest

from triagelake.operators import diagnostics as D
from triagelake.operators import pipeline
from triagelake.sources import inference, scan, selectors


def test_warnings(spark, tmp_path):
    rows = [
        {"id": "1", "title": "t", "cve": "CVE-2024-1111", "severity": "low", "hostname": "h"},
        {"title": "t", "cve": "CVE-2024-1111", "severity": "low", "hostname": "h", "ip": "10.0.0.1, 10.0.0.999; n/a", "port": "70000", "cvss_score": "11"},
        {"id": "3", "title": "t", "cve": "odd", "hostname": "h", "vulnerability_id": "V1"},
        {"id": "4", "title": "Malformed thing", "cve": "CVE-2024-1112", "severity": "low", "hostname": "h"},
        {"id": "5", "title": "t", "cve": "CVE-2024-1113", "severity": "low", "hostname": "h", "meta": {"isValid": "no"}},
        {"id": "6"},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    raw = scan.read_raw(spark, str(tmp_path))
    got = pipeline.normalise(raw).orderBy("ordinal").collect()
    assert got[0].warnings == [] and got[0].state == "accepted" and got[0].mapping_confidence == 1.0
    assert got[1].warnings == [D.NO_OCCURRENCE, D.BAD_ADDRESS, D.BAD_PORT, D.BAD_SCORE] and got[1].invalid_ips == ["10.0.0.999"] and got[1].mapping_confidence == 0.55 and got[1].state == "accepted_with_warnings"
    assert got[2].warnings == [D.NO_CVE, D.NO_SEVERITY] and got[2].mapping_confidence == 0.76 and got[2].vulnerability == "V1"
    assert [r.state for r in got[3:]] == ["quarantined"] * 3 and [r.reason for r in got[3:5]] == ["semantic validation failed"] * 2
    assert got[5].warnings == [D.NO_VULNERABILITY, D.NO_TITLE, D.NO_ASSET, D.NO_SEVERITY]
    (one,) = D.mapping_summaries(raw)
    assert one["adapter"] == "generic_json" and one["fields"]["cve"] == "cve" and one["mapping_validation"]["inspected"] == 3 and one["unmapped"] == []


def test_inference():
    records = [{"id": 1, "Title": "t", "asset": {"asset-id": "a", "x": {"y": 1}}, "cve": "CVE-2024-1111", "odd key": 2}, {"id": 2}, 7]
    m = inference.infer(records, "generic_json")
    assert m["fields"] == {"source_record_id": "$.id", "title": "$.Title", "cve": "$.cve", "asset_id": '$.asset["asset-id"]'}
    got = inference.fit(m, records)
    assert got["coverage"]["source_record_id"] == 2 / 3 and got["identifier_rate"] == 1 / 3 and got["errors"] == ["non-object record encountered"]
    assert got["confidence"] == pytest.approx(0.45 / 3 + 0.35 * (2 + 1 + 1 + 1) / 12 + 0.2 / 3)
    assert "asset.x.y" in inference.summary(records, "generic_json")["unmapped"] and inference.infer([], "x")["fields"] == {"title": "$.title"}
    assert selectors.select(records[0], m["fields"]["asset_id"]) == [("a", "/asset/asset-id")]
    for bad in ({}, {"name": "", "records": "$", "fields": {"title": "$"}}, {"name": "n", "records": "$", "fields": {"zzz": "$"}}, {"name": "n", "records": "$", "fields": {"title": 1}}, {"name": "n", "records": "x", "fields": {"title": "$"}}):
        with pytest.raises(ValueError):
            inference.validated(bad)
