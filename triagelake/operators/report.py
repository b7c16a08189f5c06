"""Reports over the last stage: summaries, the queue, redaction, CSV and JSON sections, and hash-checked replay."""

from __future__ import annotations

import hashlib
import html
import ipaddress
import json
import re
from collections.abc import Iterator
from typing import Any, TextIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructType

from triagelake.functions.text import csv_safe
from triagelake.operators.explain import optional

TIERS = ("P0", "P1", "P2", "P3", "P4")
DISPOSITIONS = ("confirmed", "remediated", "false_positive", "accepted_risk", "mitigated", "unconfirmed")
# Fixed values.
SECRETS = {"token", "access_token", "api_key", "apikey", "password", "secret", "authorization", "client_secret"}
SECRET_PARTS = ("token", "password", "secret")
PATHS = {"run_dir", "input_paths", "source_path", "source_snapshot_path", "quarantine_path", "path", "partial_artifacts"}
RAW = {"original_record", "originalrecord", "original", "raw_record", "rawrecord", "raw_source_record", "rawsourcerecord", "source_record", "sourcerecord"}
ALWAYS_RAW = {"original_record", "originalrecord"}
ABSOLUTE = r"^(/|\\|[A-Za-z]:[\\/])"
PROVIDERS = ["tenable", "qualys", "rapid7", "defender", "crowdstrike", "nessus", "generic_json", "generic_csv"]
#: Column of the CSV report, what it is taken from.
CSV_COLUMNS = {
    "id": "id", "source": "provider", "source_finding_id": "source_record_id", "title": "title", "calculated_priority": "tier", "effective_priority": "effective", "priority": "effective", "disposition": "disposition",
    "cve": "cves", "asset_id": "asset_id", "hostname": "hostname", "internet_exposed": "internet_exposed", "business_criticality": "business_criticality", "epss": "epss", "kev": "kev",
    "triage_explanation": "explanation", "correlation_group_id": "group_id", "remediation_action_id": "action_id",
}
HTML_COLUMNS = {
    "Finding ID": "id", "Calculated": "tier", "Effective": "effective", "Provider": "provider", "Finding": "title", "Disposition": "disposition", "Why": "explanation", "Correlation": "group_id", "Action": "action_id",
}
STYLE = "body{font:14px system-ui;margin:2rem}table{border-collapse:collapse;width:100%}td,th{border:1px solid #ddd;padding:.45rem;text-align:left}th{background:#17324d;color:white}"


def summary(f: DataFrame) -> DataFrame:
    """measure, value: totals, dispositions and tiers in one aggregation."""
    parts = {"total": F.count("*"), "active": F.count_if(F.col("disposition") == "confirmed"), "unassigned": F.count_if(F.col("effective").isNull())}
    parts |= {t: F.count_if(F.col("effective") == t) for t in TIERS}
    parts |= {f"calculated_{t}": F.count_if(F.col("tier") == t) for t in TIERS}
    parts |= {d: F.count_if(F.col("disposition") == d) for d in DISPOSITIONS}
    one = f.agg(*[v.alias(k) for k, v in parts.items()])
    return one.select(F.explode(F.create_map(*[x for k in parts for x in (F.lit(k), F.col(k))])).alias("measure", "value"))


def queue(f: DataFrame, most: int = 100) -> DataFrame:
    """The confirmed findings that come first, by tier and id."""
    return f.filter("disposition = 'confirmed'").orderBy("tier_rank", "id").limit(most)


def _kind(name: str) -> str:
    """What a key's name says of its value: secret, path, record or plain."""
    k = name.lower().replace("-", "_")
    if k in SECRETS or any(part in k for part in SECRET_PARTS):
        return "secret"
    if k in PATHS or k.endswith("_path"):
        return "path"
    return "record" if k in RAW else "plain"


def redacted(value: Any) -> Any:
    """A JSON value at any depth without secrets, paths and raw records."""
    if isinstance(value, list):
        return [redacted(x) for x in value]
    if isinstance(value, str):
        return "[REDACTED_PATH]" if re.match(ABSOLUTE, value) else value
    if not isinstance(value, dict):
        return value
    out = {}
    for name, inner in value.items():
        kind = _kind(name)
        if kind == "secret":
            out[name] = "[REDACTED]"
        elif kind == "record" and (name.lower().replace("-", "_") in ALWAYS_RAW or isinstance(inner, dict | list)):
            text = json.dumps(inner, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)
            out[name] = f"[REDACTED_SOURCE_RECORD sha256:{hashlib.sha256(text.encode()).hexdigest()}]"
        elif kind != "path":
            out[name] = redacted(inner)
    return out


@F.pandas_udf(StringType())
def redacted_json(texts: pd.Series) -> pd.Series:
    """JSON texts, redacted at any depth; what is no JSON becomes a marker."""

    def one(t):
        if t is None:
            return None
        try:
            return json.dumps(redacted(json.loads(t)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return '"[REDACTED]"'

    return texts.map(one)


def _hidden(c: Column) -> Column:
    return F.when(c.rlike(ABSOLUTE), "[REDACTED_PATH]").otherwise(c)


def shareable(f: DataFrame) -> DataFrame:
    """f without secrets, paths and raw records: those become markers, hashes, or go. Arrays of structs are left as they are."""
    out = []
    for field in f.schema.fields:
        c, kind, t = F.col(f"`{field.name}`"), _kind(field.name), field.dataType
        if kind == "path" or isinstance(t, MapType):
            continue
        if kind == "secret":
            c = F.when(c.isNotNull(), F.lit("[REDACTED]"))
        elif kind == "record" and (field.name.lower() in ALWAYS_RAW or isinstance(t, ArrayType | StructType)):
            text = c if isinstance(t, StringType) else F.to_json(c)
            c = F.when(c.isNotNull(), F.concat(F.lit("[REDACTED_SOURCE_RECORD sha256:"), F.sha2(text, 256), F.lit("]")))
        elif isinstance(t, StringType):
            c = _hidden(c)
        elif isinstance(t, ArrayType) and isinstance(t.elementType, StringType):
            c = F.transform(c, _hidden)
        out.append(c.alias(field.name))
    return f.select(*out)


def csv_rows(f: DataFrame) -> DataFrame:
    """The columns of the CSV report as text that no spreadsheet runs; lists are JSON. Columns that f lacks are empty."""
    f = shareable(f)
    kind = dict(f.dtypes)
    text = lambda c: F.lit("") if c not in kind else F.to_json(F.col(c)) if kind[c].startswith("array") else F.col(c).cast("string")
    return f.select(*[csv_safe(F.coalesce(text(c), F.lit(""))).alias(name) for name, c in CSV_COLUMNS.items()])


def write_csv(f: DataFrame, path: str) -> None:
    csv_rows(f).orderBy("id").write.option("header", True).option("escape", '"').csv(path)


def inactive(f: DataFrame) -> DataFrame:
    """The findings that are not confirmed, with what was decided and why."""
    names = {"id": "id", "disposition": "disposition", "calculated_priority": "tier", "effective_priority": "effective", "title": "title", "source": "provider", "group_id": "group_id", "reason": "explanation"}
    return f.filter("disposition <> 'confirmed'").select(*[optional(f, c).alias(name) for name, c in names.items()])


def full_queue(f: DataFrame) -> DataFrame:
    """All confirmed findings, by tier and id."""
    return f.filter("disposition = 'confirmed'").orderBy("tier_rank", "id")


def ordered_actions(actions: DataFrame) -> DataFrame:
    """Actions by their most urgent confirmed finding, those without any last."""
    return actions.orderBy(F.coalesce("highest_active", F.lit(9)), "action_id")


def validation(providers: set[str]) -> dict:
    """What a report may claim of each provider: only that this run read its files."""
    claims = ("unit_tested", "fixture_tested", "mock_api_tested", "live_provider_tested", "live_provider_end_to_end_validated")
    status = {p: {"implemented": True, "end_to_end_file_import_tested": p in providers, **dict.fromkeys(claims, False)} for p in PROVIDERS}
    return {"reference_provider_live_validation": False, "provider_status": status}


def summarised(f: DataFrame, actions: int, quarantined: int) -> dict:
    """The summary of a report, in one pass over the findings."""
    n = {r.measure: r.value for r in summary(f).collect()}
    effective = {t: n[t] for t in TIERS}
    return {
        "total_findings": n["total"], "active_queue": n["active"], "priority_counts": effective, "calculated_priority_counts": {t: n[f"calculated_{t}"] for t in TIERS}, "effective_priority_counts": effective,
        "unassigned": n["unassigned"], "disposition_counts": {d: n[d] for d in DISPOSITIONS}, "remediation_actions": actions, "quarantined_records": quarantined,
    }


def _json_lines(df: DataFrame, raw: bool) -> Iterator[str]:
    """A section's rows as JSON, made where the rows are, one partition at a time on the driver."""
    shown = df if raw else shareable(df)
    for row in shown.select(F.to_json(F.struct(*sorted(f"`{c}`" for c in shown.columns)), {"ignoreNullFields": "false"}).alias("line")).toLocalIterator():
        yield row.line


def _array(out: TextIO, lines: Iterator[str]) -> None:
    out.write("[")
    for i, line in enumerate(lines):
        out.write(("," if i else "") + line)
    out.write("]")


def payload(f: DataFrame, actions: DataFrame, quarantine: DataFrame, run: dict | None = None, raw: bool = False) -> dict:
    """The JSON report as a value, with the whole queue: for runs that the driver can hold."""
    load = lambda df: [json.loads(x) for x in _json_lines(df, raw)]
    sections = {"findings": load(f), "active_queue": load(full_queue(f)), "dispositions": load(inactive(f)), "remediation_actions": load(ordered_actions(actions)), "quarantine": load(quarantine)}
    about = summarised(f, len(sections["remediation_actions"]), len(sections["quarantine"]))
    sections["dispositions"] = {"counts": about["disposition_counts"], "records": sections["dispositions"]}
    providers = {r.provider for r in f.select("provider").distinct().collect()}
    return {"run": run or {} if raw else redacted(run or {}), "summary": about, **sections, "validation": validation(providers)}


def write_json(out: TextIO, f: DataFrame, actions: DataFrame, quarantine: DataFrame, run: dict | None = None, raw: bool = False, most: int = 100) -> None:
    """The JSON report: run, summary, findings, the head of the queue, dispositions, actions, quarantine and validation.

    Rows pass through the driver one partition at a time; sections are read one after another.
    """
    about = summarised(f, actions.count(), quarantine.count())
    providers = {r.provider for r in f.select("provider").distinct().collect()}
    dump = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)
    out.write(f'{{"run":{dump(run or {} if raw else redacted(run or {}))},"summary":{dump(about)},"findings":')
    _array(out, _json_lines(f, raw))
    out.write(f',"active_queue_top_n":{most},"active_queue_truncated":{dump(about["active_queue"] > most)},"active_queue":')
    _array(out, _json_lines(queue(f, most), raw))
    out.write(f',"dispositions":{{"counts":{dump(about["disposition_counts"])},"records":')
    _array(out, _json_lines(inactive(f), raw))
    out.write('},"remediation_actions":')
    _array(out, _json_lines(ordered_actions(actions), raw))
    out.write(',"quarantine":')
    _array(out, _json_lines(quarantine, raw))
    out.write(f',"validation":{dump(validation(providers))}}}\n')


def write_html(out: TextIO, f: DataFrame, actions: int, quarantined: int) -> None:
    """The whole table of findings as a page; all text is escaped."""
    about = summarised(f, actions, quarantined)
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    out.write(f"<!doctype html><html><head><meta charset='utf-8'><title>Findings</title><style>{STYLE}</style></head><body><h1>Vulnerability report</h1>")
    out.write(f"<p>Total findings: <b>{about['total_findings']}</b>; active queue: <b>{about['active_queue']}</b>; remediation actions: <b>{about['remediation_actions']}</b></p>")
    out.write(f"<table><thead><tr>{''.join(cell('th', h) for h in HTML_COLUMNS)}</tr></thead><tbody>")
    shown = shareable(f)
    for row in shown.select(*[optional(shown, c).alias(h) for h, c in HTML_COLUMNS.items()]).toLocalIterator():
        out.write(f"<tr>{''.join(cell('td', x) for x in row)}</tr>")
    out.write("</tbody></table></body></html>\n")


def table_text(f: DataFrame, actions: int, quarantined: int, most: int = 100) -> str:
    """Counts by tier and the head of the queue as text."""
    about = summarised(f, actions, quarantined)
    lines = ["Vulnerability remediation queue", "", f"Total findings: {about['total_findings']} | Active queue: {about['active_queue']} | Remediation actions: {actions}", "Priority  Count"]
    lines += [f"{t:<8}{n}" for t, n in about["priority_counts"].items()] + ["", "Active findings:"]
    head = shareable(queue(f, most))
    lines += [f"{r.tier:<3} {r.provider} {r.title} | {r.why or ''}" for r in head.select("tier", "provider", "title", optional(head, "explanation").alias("why")).collect()]
    if about["active_queue"] > most:
        lines.append(f"... {about['active_queue'] - most} more active findings")
    return "\n".join(lines) + "\n"


def report(f: DataFrame, actions: DataFrame, quarantine: DataFrame, form: str, output: str, run: dict | None = None, raw: bool = False) -> str:
    """Write a report as json, html, table (files of the driver) or csv (a folder, written in parallel)."""
    if form == "csv":
        write_csv(f, output)
    elif form in ("json", "html", "table"):
        with open(output, "w", encoding="utf-8", newline="") as out:
            if form == "json":
                write_json(out, f, actions, quarantine, run, raw)
            elif form == "html":
                write_html(out, f, actions.count(), quarantine.count())
            else:
                out.write(table_text(f, actions.count(), quarantine.count()))
    else:
        raise ValueError(f"unknown report format: {form}")
    return output


@F.pandas_udf(BooleanType())
def bad_address(lists: pd.Series) -> pd.Series:
    """Whether a list holds anything that is no IP address."""

    def bad(values):
        try:
            for v in values if values is not None else ():
                ipaddress.ip_address(str(v))
        except ValueError:
            return True
        return False

    return lists.map(bad)


def replay_errors(f: DataFrame) -> Column:
    """What keeps a finding from being replayed, as a list of texts; empty for a valid one."""
    blank = lambda c: F.trim(F.coalesce(optional(f, c), F.lit(""))) == ""
    no_cve, no_native = F.coalesce(F.size("cves"), F.lit(0)) <= 0, blank("vulnerability_identifier")
    wrong_cve = F.exists(F.coalesce("cves", F.array().cast("array<string>")), lambda v: ~F.coalesce(v.rlike(r"^CVE-\d{4}-\d{4,}$"), F.lit(False)))
    wrong_ip = bad_address(F.col("ip_addresses"))
    targetless = blank("asset_id") & blank("hostname") & blank("fqdn") & (F.coalesce(F.size("ip_addresses"), F.lit(0)) <= 0)
    return F.array_compact(F.array(
        F.when(blank("id") | blank("provider"), "finding identity is incomplete"), F.when(wrong_cve, "CVE list is invalid"), F.when(no_cve & no_native, "vulnerability identity is missing"),
        F.when(wrong_ip, "asset contains an invalid IP"), F.when(targetless, "target identity is missing"),
    ))


def require_valid(f: DataFrame) -> None:
    """Raise if any finding can't be replayed; says which error and how many."""
    found = f.select(F.explode(replay_errors(f)).alias("error")).groupBy("error").agg(F.count("*").alias("n")).orderBy("error").collect()
    if found:
        raise ValueError("replay export met invalid findings: " + ", ".join(f"{r.error} ({r.n})" for r in found))


def replay(f: DataFrame) -> DataFrame:
    """ordinal, line, sha256: canonical lines of the findings and their hashes, made where the rows are."""
    keep = [c for c in f.columns if c not in ("exact", "leaf", "original_record")]
    line = F.to_json(F.struct(*sorted(keep)))
    return f.select("ordinal", "id", line.alias("line")).withColumn("sha256", F.sha2("line", 256))


def fingerprint(lines: DataFrame) -> DataFrame:
    """rows, ids, digest: a digest that does not depend on the order or number of partitions."""
    return lines.agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.sum(F.xxhash64("sha256").cast("decimal(38,0)")).alias("digest"))


def export(lines: DataFrame, path: str) -> str:
    """One JSON Lines file with a footer of count and running SHA-256, streamed through the driver in order."""
    digest, n = hashlib.sha256(), 0
    with open(path, "w", encoding="utf-8") as out:
        for row in lines.orderBy("ordinal", "id").toLocalIterator():
            digest.update(row.line.encode() + b"\n")
            out.write(row.line + "\n")
            n += 1
        out.write(json.dumps({"rows": n, "sha256": digest.hexdigest()}) + "\n")
    return digest.hexdigest()


def validate(path: str) -> bool:
    """Whether a replay file's rows match its footer."""
    digest, n, last = hashlib.sha256(), 0, None
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if last is not None:
                digest.update(last.encode())
                n += 1
            last = line
    return last is not None and json.loads(last) == {"rows": n, "sha256": digest.hexdigest()}

