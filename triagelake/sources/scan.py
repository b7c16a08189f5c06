"""Scans of finding exports: JSON, JSON Lines, CSV, TSV and XML files to one table of raw records.

Spark reads the files (binaryFile), so any file system will do; a file is parsed by one task, in Python, because the
records must keep duplicate keys, key order and physical positions, which Spark's own readers drop. Every record keeps
its canonical JSON, a pointer to its place, the file's SHA-256, and two maps of its fields for alias lookup: `exact`
(top-level names) and `leaf` (names of scalars at any depth; the first one met wins).

Defined results: a bad line or row is a row with `malformed` set; a file that can't be parsed gives one such row; empty
files give none. ordinal orders records by file (sorted paths, without case) and place within it.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
SUFFIXES = (".json", ".jsonl", ".ndjson", ".csv", ".tsv", ".xml", ".nessus")
COLLECTIONS = {"findings", "vulnerabilities", "detections", "results", "issues", "records", "resources", "items", "value", "rows"}
ENVELOPES = {"response", "result", "results", "data", "payload", "body", "collection", "export", "page", "pages"}
MOST_BYTES, MOST_DOCUMENT, MOST_DEPTH = 1 << 30, 64 << 20, 64
HOST_NAMES = {"hostip": "ip", "hostfqdn": "fqdn", "operatingsystem": "operating_system", "netbiosname": "hostname"}

RAW = "ordinal long, provider string, source_format string, source_path string, report_sha256 string, record_pointer string, original_record string, exact map<string,string>, leaf map<string,string>, duplicate_keys boolean, malformed string"


def norm(name: str) -> str:
    return re.sub("[^a-z0-9]+", "", str(name).lower())


class Repeated(dict):
    """An object in which a key stood more than once; the last value won."""


def _pairs(pairs):
    out = dict(pairs)
    return out if len(out) == len(pairs) else Repeated(out)


def _decode(text: str):
    value = json.loads(text, object_pairs_hook=_pairs)
    _bounded(value)
    return value


def _bounded(value) -> None:
    stack = [(value, 1)]
    while stack:
        v, depth = stack.pop()
        if depth > MOST_DEPTH:
            raise ValueError("nested too deeply")
        inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
        stack += [(x, depth + 1) for x in inner]


def _repeats(value) -> bool:
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, Repeated):
            return True
        stack += v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    return False


def _step(name: str) -> str:
    return str(name).replace("~", "~0").replace("/", "~1")


def collections(payload, base: str = "", depth: int = 0) -> Iterator[tuple[str, list]]:
    """(pointer, list) of the record lists of a document: at its root or below known envelopes only."""
    if isinstance(payload, list):
        yield base or "/$", payload
    elif isinstance(payload, dict):
        for key in sorted(payload, key=str.casefold):
            value, name = payload[key], norm(key)
            if name in COLLECTIONS and isinstance(value, list) and value:
                yield f"{base}/{_step(key)}", value
            elif name in ENVELOPES and isinstance(value, dict) and depth < 8:
                yield from collections(value, f"{base}/{_step(key)}", depth + 1)


def json_records(text: str) -> Iterator[tuple[str, object, str | None]]:
    payload = _decode(text)
    found = list(collections(payload))
    if not found:
        yield "", payload, None if isinstance(payload, dict) else "not an object"
    for pointer, items in found:
        for i, item in enumerate(items):
            yield f"{pointer}/{i}", item, None if isinstance(item, dict) else "not an object"


def jsonl_records(text: str) -> Iterator[tuple[str, object, str | None]]:
    for i, line in enumerate(text.split("\n"), 1):
        if not line.strip():
            continue
        try:
            value = _decode(line)
            yield f"/lines/{i}", value, None if isinstance(value, dict) else "not an object"
        except ValueError as e:
            yield f"/lines/{i}", {"raw": line}, f"bad line: {type(e).__name__}"


def csv_records(text: str, delimiter: str) -> Iterator[tuple[str, object, str | None]]:
    rows = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), delimiter=delimiter)
    header = next(rows, None)
    if not header or not any(header):
        raise ValueError("no header")
    twice = len({norm(h) for h in header}) < len(header)
    for i, row in enumerate(rows, 2):
        if row:
            record = dict(zip(header, row, strict=False))
            if len(row) > len(header):
                record["extra_columns"] = row[len(header) :]
            yield f"/rows/{i}", Repeated(record) if twice else record, None


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def xml_value(e):
    """An element as a value: attributes under @name, text under #text, repeated children as lists, empty as null."""
    out: dict = {f"@{_local(k)}": v for k, v in e.attrib.items()}
    for child in e:
        value, name = xml_value(child), _local(child.tag)
        if name in out:
            out[name] = [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
        else:
            out[name] = value
    text = (e.text or "").strip()
    if not out:
        return text or None
    if text:
        out["#text"] = text
    return out


def xml_records(text: str) -> Iterator[tuple[str, object, str | None]]:
    if re.search(r"<!ENTITY", text, re.I):
        raise ValueError("entities are not allowed")
    root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "", text, flags=re.I))
    n = 0
    for host in root.iter():
        if _local(host.tag) == "ReportHost":
            context = {"host": host.get("name")}
            for tag in host.iter():
                if _local(tag.tag) == "tag" and tag.get("name"):
                    name = norm(tag.get("name"))
                    context.setdefault(HOST_NAMES.get(name, tag.get("name")), (tag.text or "").strip())
            for item in host:
                if _local(item.tag) == "ReportItem":
                    n += 1
                    value = xml_value(item)
                    own = {k.lstrip("@"): v for k, v in (value if isinstance(value, dict) else {}).items()}
                    yield f"/xml/ReportItem/{n}", {**{k: v for k, v in context.items() if norm(k) not in {norm(x) for x in own}}, **own}, None
        elif _local(host.tag) == "HOST":
            context = {f"HOST_{_local(c.tag)}" if _local(c.tag) == "ID" else _local(c.tag): (c.text or "").strip() for c in host if not len(c)}
            for item in host.iter():
                if _local(item.tag) == "DETECTION":
                    n += 1
                    yield f"/xml/DETECTION/{n}", {**context, **(xml_value(item) or {})}, None
    if not n:
        raise ValueError("no records")


def fields(record: dict) -> tuple[dict[str, str], dict[str, str]]:
    """exact: non-empty top-level fields. leaf: scalars at any depth by their own name. Lists are joined by '; '."""

    def text(v) -> str | None:
        if isinstance(v, list):
            return "; ".join(t for x in v if (t := text(x))) or None
        if isinstance(v, dict):
            return next((t for k in ("text", "#text", "@value", "value", "name", "id", "message", "title") if (t := text(v.get(k)))), None)
        return None if v is None or not str(v).strip() else str(v).strip()

    exact: dict[str, str] = {}
    leaf: dict[str, str] = {}
    for k, v in record.items():
        if (t := text(v)) is not None:
            exact.setdefault(norm(k), t)
    stack = [record]
    while stack:
        inner = []
        for k, v in stack.pop().items():
            if isinstance(v, dict):
                inner.append(v)
            elif (t := text(v)) is not None:
                leaf.setdefault(norm(k), t)
        stack += inner[::-1]
    return exact, leaf


def provider_of(suffix: str, records: list[dict]) -> str:
    """The family of a file by the shapes of its first records; generic if none or more than one fits."""
    found = set()
    for r in records[:25]:
        k = {norm(x) for x in r}
        nested = {norm(x) for x, v in r.items() if isinstance(v, dict)}
        if ("hostinfo" in nested and "cve" in nested and k & {"aid", "spotlightid"}) or ("aid" in k and k & {"cve", "cveid"} and len(k & {"exploitstatus", "riskscore", "falconrating", "hostinfo"}) >= 1):
            found.add("crowdstrike")
        elif k & {"machineid", "deviceid"} and k & {"cve", "cveid", "vulnerabilityid"}:
            found.add("defender")
        elif "qid" in k and k & {"severity", "qds"}:
            found.add("qualys")
        elif {"asset", "definition"} <= nested or ("pluginid" in k and k & {"pluginname", "severity"}):
            found.add("tenable")
        elif ("assetid" in k and "vulnid" in k) or ("vulnerabilityid" in k and "riskscore" in k):
            found.add("rapid7")
    if len(found) == 1:
        return found.pop()
    if len(found) > 1:
        raise ValueError(f"records of several families: {', '.join(sorted(found))}")
    return "generic_csv" if suffix in (".csv", ".tsv") else "generic_json"


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def parse(path: str, content: bytes, ordinal: int, provider: str = "auto") -> Iterator[tuple]:
    suffix = PurePosixPath(path).suffix.lower()
    sha, form = hashlib.sha256(content).hexdigest(), suffix.lstrip(".")
    try:
        if len(content) > MOST_BYTES or (suffix in (".json", ".xml", ".nessus") and len(content) > MOST_DOCUMENT):
            raise ValueError("too large")
        text = content.decode("utf-8-sig")
        read = {".json": json_records, ".jsonl": jsonl_records, ".ndjson": jsonl_records, ".xml": xml_records, ".nessus": xml_records}.get(suffix)
        records = list(read(text) if read else csv_records(text, "\t" if suffix == ".tsv" else ","))
        family = provider
        if provider == "auto":
            # an XML file's family is that of its items
            items = "nessus" if records and records[0][0].startswith("/xml/ReportItem/") else "qualys"
            family = items if read is xml_records else provider_of(suffix, [r for _, r, bad in records if bad is None])
    except (ValueError, ElementTree.ParseError, csv.Error) as e:
        yield ordinal << 32, "unknown", form, path, sha, "", "{}", {}, {}, False, f"{type(e).__name__}: {e}"
        return
    for i, (pointer, record, bad) in enumerate(records):
        exact, leaf = fields(record) if isinstance(record, dict) else ({}, {})
        yield (ordinal << 32) + i, family, form, path, sha, pointer, canonical(record), exact, leaf, _repeats(record), bad


def read_raw(spark: SparkSession, *paths: str, provider: str = "auto") -> DataFrame:
    """The raw records of files or folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")
    files = files.filter(F.lower("path").rlike(r"\.(json|jsonl|ndjson|csv|tsv|xml|nessus)$"))
    # one row per file comes to the driver, as for any listing
    order = {p: i for i, p in enumerate(sorted((r.path for r in files.select("path").collect()), key=lambda p: (p.casefold(), p)))}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in re.sub("<[^>]*>", "", RAW).split(", ")]
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                rows = []
                for row in parse(path, bytes(content), order[path], provider):
                    rows.append(row)
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.repartition(max(1, min(len(order), 10_000)), "path").mapInPandas(run, RAW)
