"""A declarative mapping guessed from a few records, and how well a mapping fits records. For the driver and small samples."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from triagelake.functions.aliases import FIELDS, OVERRIDES, TOP_LEVEL, key
from triagelake.functions.text import IDENTIFIER
from triagelake.sources.selectors import mapping_hash, select, steps

# Fixed values.
KNOWN = [
    "source_record_id", "title", "description", "severity", "cve", "cwe", "cvss_score", "cvss_vector", "exploit_available", "exploited_in_wild", "epss", "vendor_risk_score", "asset_id", "hostname", "ip",
    "package", "installed_version", "fixed_version", "status", "solution", "internet_exposed", "business_criticality", "tags",
]
REQUIRED = ["title", "severity", "cve", "asset_id"]
WEIGHTS = (0.45, 0.35, 0.2)
LONGEST_NAME = 256


def paths(record: dict, before: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], object]]:
    """Every key of nested objects with its path, outer ones first."""
    for name, value in record.items():
        yield (*before, name), value
        if isinstance(value, dict):
            yield from paths(value, (*before, name))


def found(record: dict, provider: str) -> dict[str, tuple[str, ...]]:
    """The path each canonical field is taken from: top-level names first, then names of scalars at any depth."""
    exact: dict[str, tuple[str, ...]] = {}
    leaf: dict[str, tuple[str, ...]] = {}
    for path, value in paths(record):
        if value in (None, "", [], {}):
            continue
        if len(path) == 1:
            exact.setdefault(key(path[0]), path)
        if not isinstance(value, dict):
            leaf.setdefault(key(path[-1]), path)
    out = {}
    for field, shared in FIELDS.items():
        names = [key(n) for n in OVERRIDES.get((provider, field), shared)]
        tried = [exact.get(n) for n in names] + ([] if field in TOP_LEVEL else [leaf.get(n) for n in names])
        hit = next((p for p in tried if p), None)
        if hit:
            out[field] = hit
    return out


def selector(path: tuple[str, ...]) -> str:
    return "$" + "".join(f".{p}" if re.fullmatch(r"[A-Za-z_]\w*", p, re.A) else f"[{json.dumps(p, ensure_ascii=False)}]" for p in path)


def validated(mapping: dict) -> dict:
    """The mapping, or ValueError: {"name": text, "records": selector, "fields": {known field: selector}}."""
    if not isinstance(mapping, dict) or set(mapping) - {"name", "records", "fields"}:
        raise ValueError("a mapping has name, records and fields")
    name, fields = mapping.get("name"), mapping.get("fields")
    if not isinstance(name, str) or not name.strip() or len(name) > LONGEST_NAME:
        raise ValueError("a mapping's name is a short text")
    if not isinstance(fields, dict) or not fields or set(fields) - set(KNOWN):
        raise ValueError("a mapping's fields are known ones, at least one")
    for s in (mapping.get("records"), *fields.values()):
        if not isinstance(s, str):
            raise ValueError("a selector is a text")
        steps(s)
    return mapping


def infer(records: list[dict], provider: str, name: str = "inferred") -> dict:
    """A mapping by where the first record has the known fields; the title alone if it has none."""
    at = found(records[0], provider) if records else {}
    fields = {f: selector(at[f]) for f in KNOWN if f in at}
    return {"name": name, "records": "$", "fields": fields or {"title": "$.title"}}


def fit(mapping: dict, records: list[dict]) -> dict:
    """Shares of records that have each field and any identifier, and a weighted confidence."""
    validated(mapping)
    objects, n = [r for r in records if isinstance(r, dict)], len(records)
    share = {f: (sum(bool(select(r, s)) for r in objects) / n if n else 0.0) for f, s in mapping["fields"].items()}
    named = sum(any(re.search(IDENTIFIER, str(v)) for v in r.values()) for r in objects) / n if n else 0.0
    mean = lambda values: sum(values) / len(values) if values else 0.0
    required = mean([share[f] for f in REQUIRED if f in share])
    total = sum(w * x for w, x in zip(WEIGHTS, (required, mean(list(share.values())), named), strict=True))
    return {"inspected": n, "coverage": share, "required_coverage": required, "identifier_rate": named, "confidence": min(1.0, max(0.0, total)), "errors": ["non-object record encountered"] * (n - len(objects))}


def summary(records: list[dict], provider: str) -> dict:
    """fields, unmapped (sorted paths of scalars), inferred mapping with its hash and fit, from a few records of one provider."""
    first = records[0] if records else {}
    at = found(first, provider)
    used = set(at.values())
    left = sorted(".".join(p) for p, v in paths(first) if not isinstance(v, dict | list) and p not in used)
    mapping = infer(records, provider, f"{provider}-inferred")
    return {"fields": {f: ".".join(p) for f, p in at.items()}, "unmapped": left, "inferred_mapping": mapping, "mapping_sha256": mapping_hash(mapping), "mapping_validation": fit(mapping, records)}
