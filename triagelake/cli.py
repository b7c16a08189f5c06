"""Command line: the stages one by one or all at once, status, reports, findings, export and validation."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from triagelake import settings
from triagelake.events import Events
from triagelake.operators import pipeline, report
from triagelake.sources import scan
from triagelake.store import STAGES, Run, _remote


def stage(spark: SparkSession, run: Run, name: str, inputs: list[str]) -> DataFrame:
    """One stage, from the table of the one before it."""
    before = None if name == "raw" else run.read(spark, STAGES[STAGES.index(name) - 1])
    # the names of an action's columns are made anew by the last stage
    made = {
        "raw": lambda: scan.read_raw(spark, *inputs), "normalised": lambda: pipeline.normalise(before), "tiers": lambda: pipeline.tiers(pipeline.assess(pipeline.accepted(before))),
        "correlated": lambda: pipeline.remediate(pipeline.correlate(before)), "actions": lambda: pipeline.actions(before.drop("action_kind", "action_key", "action_id")),
    }
    # a remote folder has no log of events: appending is for local files
    events = None if _remote(run.folder) else Events(f"{run.folder}/events.jsonl")
    if events:
        events.emit(f"{name}.started", run.folder)
    out = run.write(name, made[name]())
    if events:
        events.emit(f"{name}.completed", run.folder, run.load()["stages"][name])
    return out


def run_all(spark: SparkSession, folder: str, inputs: list[str], limits: settings.Settings | None = None) -> dict:
    run = Run(folder, limits)
    tables = {name: stage(spark, run, name, inputs) for name in STAGES}
    return {r.state: r.records for r in pipeline.accounting(tables["normalised"]).collect()}


COMMANDS = {"ingest": "raw", "normalise": "normalised", "triage": "tiers", "correlate": "correlated", "remediate": "actions"}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="triagelake")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run-all", *COMMANDS, "status", "report", "findings", "export", "validate"):
        s = sub.add_parser(name)
        s.add_argument("folder")
        if name in ("run-all", "ingest"):
            s.add_argument("inputs", nargs="+")
        if name in ("report", "export"):
            s.add_argument("output")
        if name == "report":
            s.add_argument("--format", choices=("json", "csv", "html", "table"), default="csv")
            s.add_argument("--include-raw", action="store_true")
        if name == "findings":
            s.add_argument("--tier")
            s.add_argument("--limit", type=int, default=20)
    a = p.parse_args(args)
    if a.command == "validate":
        return 0 if report.validate(a.folder) else 1
    spark = SparkSession.builder.appName("triagelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    limits = settings.load()
    run = Run(a.folder, limits)
    try:
        if a.command == "run-all":
            print(json.dumps(run_all(spark, a.folder, a.inputs, limits)))
            return 0
        if a.command in COMMANDS:
            print(json.dumps({COMMANDS[a.command]: stage(spark, run, COMMANDS[a.command], getattr(a, "inputs", [])).count()}))
            return 0
    except Exception as e:  # noqa: BLE001 - the manifest has the reason; the exit code says that it failed
        print(f"{type(e).__name__}: {str(e)[:500]}", file=sys.stderr)
        return 1
    if a.command == "status":
        print(json.dumps(run.load(), sort_keys=True))
        return 0
    if not run.complete(spark):
        print("the run is not complete, or a stage was changed after it", file=sys.stderr)
        return 1
    f = run.read(spark, "correlated")
    if a.command == "report":
        quarantine = run.read(spark, "normalised").filter("state IN ('quarantined', 'rejected')")
        report.report(f, run.read(spark, "actions"), quarantine, a.format, a.output, run.load(), a.include_raw)
    elif a.command == "export":
        report.require_valid(f)
        print(report.export(report.replay(f), a.output))
    else:
        rows = (f.filter(f.tier == a.tier) if a.tier else f).orderBy("ordinal").limit(a.limit)
        for r in rows.select("id", "tier", "effective", "title").toLocalIterator():
            print(json.dumps(r.asDict()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
