"""Identity across providers and runs, and the synthetic corpus through all stages."""

import hashlib
import json

from triagelake.operators import entities as E
from triagelake.operators import pipeline
from triagelake.sources import scan, synthetic

SCHEMA = "provider string, id string, source_record_id string, cves array<string>, vulnerability_identifier string, hostname string, fqdn string, asset_id string, ip_addresses array<string>"


def sha(*parts):
    return hashlib.sha256(json.dumps(parts, separators=(",", ":")).encode()).hexdigest()[:24]


def test_aliases_and_handles(spark):
    rows = [("Nessus", "f1", None, ["cve-2024-1 "], " 55 ", "Web01.", None, "A9", ["10.0.0.1"]), (None, "f2", " occ ", None, None, "h", None, None, None), ("x", "f3", None, ["CVE-1"], None, None, " ", "", [])]
    got = {r.id: r for r in E.observed(spark.createDataFrame(rows, SCHEMA)).collect()}
    names = [f"vulnerability:{v}|target:{t}" for v in ("cve:CVE-2024-1", "nessus:vulnerability:55") for t in ("asset-id:nessus:a9", "hostname:web01", "ip:10.0.0.1")]
    assert got["f1"].aliases == sorted(names) and got["f1"].signature == "obs-" + sha("observation", sorted(names))
    assert got["f1"].entity == "se-" + sha("independent-run", got["f1"].signature)
    assert got["f2"].aliases == [] and got["f2"].signature == "obs-" + sha("observation", "unknown", "occ")
    assert got["f3"].aliases == [] and got["f3"].signature == "obs-" + sha("observation", "x", "f3")


def test_reconciliation(spark):
    one = lambda i, host=None, ip=(), asset=None, provider="p": (provider, i, None, ["CVE-1"], None, host, None, asset, list(ip))
    base = E.observed(spark.createDataFrame([one("b1", "web", ["10.0.0.1"], "a1"), one("b2", "db", ["10.0.0.2"])], SCHEMA)).withColumn("entity", E.F.concat(E.F.lit("e-"), "id"))
    now = [one("same", "WEB."), one("moved", "other", ["10.0.0.1"]), one("both", None, ["10.0.0.1", "10.0.0.2"]), one("new", "mail"), one("swapped", "web", (), "a2"), one("elsewhere", "web", (), "a2", "q")]
    got = {r.id: (r.state, r.entity if r.entity.startswith("e-") else None, r.candidates) for r in E.reconciled(E.observed(spark.createDataFrame(now, SCHEMA)), E.registry(base)).collect()}
    assert got == {
        "same": ("reconciled", "e-b1", ["e-b1"]), "moved": ("conflict", None, ["e-b1"]), "both": ("ambiguous", None, ["e-b1", "e-b2"]), "new": ("unreconciled", None, []),
        "swapped": ("conflict", None, ["e-b1"]), "elsewhere": ("reconciled", "e-b1", ["e-b1"]),
    }


def test_synthetic_corpus(spark, tmp_path):
    synthetic.write(spark, 60, f"{tmp_path}/corpus", 3)
    tables = pipeline.run(scan.read_raw(spark, f"{tmp_path}/corpus"))
    rows = {r.source_record_id: r for r in tables["correlated"].collect()}
    assert len(rows) == 60 and rows["synthetic-00000010"].tier == "P0" and rows["synthetic-00000013"].severity == "medium"
    assert rows["synthetic-00000011"].vulnerability == "CVE-2099-1011" and rows["synthetic-00000011"].hostname == "host-00011.example"
    assert {r.state: r.records for r in tables["accounting"].collect()}["accepted"] == 60
    assert all(r.action == "Apply the synthetic vendor update" for r in tables["actions"].collect())
