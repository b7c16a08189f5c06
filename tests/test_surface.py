import json

import pytest

from triagelake import cli
from triagelake.sources import paginated, selectors
from triagelake.store import STAGES, Run
from triagelake.streaming import findings


def line(i):
    return json.dumps({"id": f"G{i}", "title": "weak", "cve": f"CVE-2024-{4000 + i}", "severity": "high", "asset_id": f"x{i}", "last_seen": "2024-01-02T03:04:05Z"})


def test_selectors(spark):
    v = {"a": {"b/c": [{"k": 1}, {"k": 2}]}}
    assert selectors.select(v, '$.a["b/c"][*].k') == [(1, "/a/b~1c/0/k"), (2, "/a/b~1c/1/k")]
    for bad in ("a", "$.", "$[x]", "$" + ".a" * 65, "$" + "." * 600):
        with pytest.raises(ValueError):
            selectors.steps(bad)
    df = spark.createDataFrame([('{"a": {"b": [5, "x"]}}',), ("{}",), ("bad",), (None,)], "j string")
    out = selectors.apply(df, "j", {"one": "$.a.b[1]", "two": "$.a.b[0]"})
    assert [(r.one, r.two) for r in out.collect()] == [("x", "5"), (None, None), (None, None), (None, None)]
    assert {r.field: r.share for r in selectors.coverage(out, ["one"]).collect()} == {"one": 0.25}


def test_pages(spark):
    slept, calls = [], []

    def request(at):
        calls.append(at)
        if len(calls) == 2:
            raise paginated.RateLimited
        return {"items": [{"n": at or 0}], "next": (at or 0) + 1 if (at or 0) < 2 else None}

    assert [x["n"] for x in paginated.pages(request, sleep=slept.append)] == [0, 1, 2] and slept == [0.25]
    with pytest.raises(paginated.PermanentError):
        list(paginated.pages(lambda at: {"items": [], "next": "same"}))
    with pytest.raises(paginated.PermanentError):
        list(paginated.pages(lambda at: {"items": None}))
    got = paginated.read(spark, lambda at: {"items": [{"n": at}], "next": None if at else "t"})
    assert got.count() == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(line(i % 5) for i in range(12)))
    run = str(tmp_path / "run")
    assert cli.main(["run-all", run, str(tmp_path / "in")]) == 0 and '"accepted": 12' in capsys.readouterr().out
    assert cli.main(["findings", run, "--limit", "7"]) == 0 and len(capsys.readouterr().out.splitlines()) == 7
    assert cli.main(["export", run, str(tmp_path / "x.jsonl")]) == 0 and cli.main(["validate", str(tmp_path / "x.jsonl")]) == 0
    r = Run(run)
    r.write("tiers", r.read(spark, "tiers").limit(3))
    assert cli.main(["findings", run]) == 1


def test_stages_one_by_one(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.jsonl").write_text("\n".join(line(i) for i in range(5)))
    run = str(tmp_path / "run")
    assert cli.main(["normalise", run]) == 1
    for command in cli.COMMANDS:
        assert cli.main([command, run, *([str(tmp_path / "a.jsonl")] if command == "ingest" else [])]) == 0
    capsys.readouterr()
    assert cli.main(["status", run]) == 0
    state = json.loads(capsys.readouterr().out)
    assert state["status"] == "complete" and list(state["stages"]) == sorted(STAGES) and state["resources"]["disk_bytes"] > 0 and Run(run).complete(spark)
    for form in ("json", "html", "table"):
        assert cli.main(["report", run, str(tmp_path / form), "--format", form]) == 0
    assert len(json.loads((tmp_path / "json").read_text())["findings"]) == 5
    kinds = [json.loads(x)["event_type"] for x in (tmp_path / "run" / "events.jsonl").read_text().splitlines()]
    assert kinds[:3] == ["raw.started", "raw.completed", "normalised.started"]
    monkeypatch.setenv("TRIAGELAKE_MAX_RUN_DISK_BYTES", "10")
    assert cli.main(["triage", run]) == 1
    assert Run(run).load()["status"] == "failed" and not Run(run).complete(spark)


def test_remote_manifest(spark, tmp_path):
    """A folder named by a scheme goes through Spark's own file systems."""
    run = Run(f"file://{tmp_path}/r")
    run.write("raw", spark.range(3).toDF("id"))
    run.write("raw", spark.range(4).toDF("id"))
    assert json.loads((tmp_path / "r" / "run.json").read_text())["stages"]["raw"]["input"] is None and run.read(spark, "raw").count() == 4
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        run.write("normalised", spark.range(3).selectExpr("id / 0 AS x"))
    assert run.load()["status"] == "failed" and "DIVIDE_BY_ZERO" in run.load()["errors"][0]["reason"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(line(1) + "\n" + line(2))
    for i in (0, 1):
        if i:
            (tmp_path / "in" / "b.jsonl").write_text(line(2) + "\n" + line(3))
        stream = findings.tiers(findings.raw_stream(spark, str(tmp_path / "in")))
        findings.store_batches(stream, str(tmp_path / "registry"), str(tmp_path / "mark")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "registry")).collect()
    assert sorted((r.source_record_id, r.new) for r in rows) == [("G1", True), ("G2", False), ("G2", True), ("G3", True)]
    assert findings.counts(findings.tiers(findings.raw_stream(spark, str(tmp_path / "in")))).isStreaming
