"""Selectors over JSON values: `$.a.b[0][*]["k"]`, each match with its JSON pointer, and mappings made of them."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_CHARS, MOST_STEPS = 512, 64
_STEP = re.compile(r"""\.(?P<name>[A-Za-z_@#][\w@#-]*)|\[(?P<index>\d+)\]|\[(?P<all>\*)\]|\["(?P<quoted>(?:[^"\\]|\\.)*)"\]""")


def steps(selector: str) -> list:
    """Names, indexes and None (every element); a selector that isn't well formed is an error."""
    if not selector.startswith("$") or len(selector) > MOST_CHARS:
        raise ValueError("a selector begins with $ and has at most 512 characters")
    at, out = 1, []
    while at < len(selector):
        m = _STEP.match(selector, at)
        if not m:
            raise ValueError(f"bad step at {at}")
        out.append(m["name"] if m["name"] else int(m["index"]) if m["index"] else None if m["all"] else json.loads(f'"{m["quoted"]}"'))
        at = m.end()
    if len(out) > MOST_STEPS:
        raise ValueError("too many steps")
    return out


def select(payload, selector: str, base: str = "") -> list[tuple[object, str]]:
    found = [(payload, base)]
    for s in steps(selector):
        inner = []
        for value, pointer in found:
            if s is None:
                items = enumerate(value) if isinstance(value, list) else value.items() if isinstance(value, dict) else ()
                inner += [(v, f"{pointer}/{str(k).replace('~', '~0').replace('/', '~1')}") for k, v in items]
            elif isinstance(s, int):
                if isinstance(value, list) and s < len(value):
                    inner.append((value[s], f"{pointer}/{s}"))
            elif isinstance(value, dict) and s in value:
                inner.append((value[s], f"{pointer}/{s.replace('~', '~0').replace('/', '~1')}"))
        found = inner
    return found


def mapping_hash(mapping: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps(mapping, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def apply(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """df with one text column per field, from the JSON text in `column`. Selectors of one value stay native."""
    for s in mapping.values():
        if None in steps(s):
            raise ValueError("a mapped field is one value")
    parsed = F.try_parse_json(F.col(column))
    path = lambda s: "$" + "".join(f"[{x}]" if isinstance(x, int) else f"['{x}']" for x in steps(s))
    return df.withColumns({name: F.try_variant_get(parsed, path(s), "string") for name, s in mapping.items()}).withColumn("mapping_sha256", F.lit(mapping_hash(mapping)))


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, share of rows that have it."""
    shares = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in fields])
    return shares.select(F.explode(F.create_map(*[x for c in fields for x in (F.lit(c), F.col(c))])).alias("field", "share"))
