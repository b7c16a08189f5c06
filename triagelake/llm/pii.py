"""Personal data: patterned spans, and terms that reveal the entities behind them.

Spans of four kinds are found by pattern: email, ip, card (Luhn) and phone. Each distinct value is a protected entity.
The corpus tells how strongly a term reveals an entity: with n(t) and n(e) the rows that hold a term and an entity, and
n(e, t) those with both, wherever in the text, the disclosed share of the entity's information is
PMI(e, t) / IC(e) = 1 - log(n(e, t) / n(t)) / log(n(e) / N), which is 1 if the term stands nowhere else. A term whose
share is at least `threshold` is removed wherever it stands in a text with that entity, also if entity or term stand in
one text alone. Texts without an entity lose nothing. So in `sanitise`, patterned spans are generalised to their kind and
disclosing terms are removed.

Counts by term come from all texts and are summed in each batch before the shuffle. Entities that stand in the same texts
reveal alike and are judged as one; pairs are made of the distinct words of a text and those classes of its entities, once
for all copies of a text. The joins are of pairs already aggregated.

Null text: empty, no spans. Null doc_id: carried. Repeated rows: judged alike. Empty table: empty result. Very long
texts: whole, each pattern in linear time. An entity that all rows hold has no information to disclose. Further columns
are carried by `sanitise` alone. Texts are named by 128 bits, terms and entities by 64.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, free_name, small_batches, text_key, written

SALTS = 16
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TERM = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and (c := text[lo - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            yield lo, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def _value(kind: str, raw: str) -> int:
    return _hash(kind, raw.lower() if kind == "email" else "".join(_DIGITS.findall(raw)) if kind != "ip" else raw)


def _covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the joined spans."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def _terms(text: str) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the terms outside all spans."""
    starts, ends = _covered(find(text))
    for m in _TERM.finditer(text):
        s, e = m.span()
        i = bisect_left(starts, e) - 1  # the last joined span that begins before the term ends
        if i < 0 or ends[i] <= s:
            yield m[0].lower(), s, e


FOUND = "doc_id long, tk binary, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>"


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tk, the number of spans of each kind, the spans as kind:start:end, comma-joined, and the distinct entities."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b.column("text"))
            found = [find(t) for t in texts]
            counts = {f"n_{k}": pa.array([sum(x[0] == k for x in f) for f in found], pa.int64()) for k in KINDS}
            entities = [sorted({_value(k, t[s:e]) for k, s, e in f}) for t, f in zip(texts, found, strict=True)]
            yield batch(doc_id=b.column("doc_id"), tk=b.column("tk"), **counts, base=pa.array([",".join(f"{k}:{s}:{e}" for k, s, e in f) for f in found], pa.string()), entities=pa.array(entities, pa.list_(pa.int64())))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text").mapInArrow(run, FOUND)


def _pairs(held: DataFrame) -> DataFrame:
    """tk, n, entity, term: each distinct term of a text outside its spans with each class of its entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tk, n, text, entities in zip(b.column("tk").to_pylist(), b.column("n").to_pylist(), _texts(b.column("text")), b.column("entities").to_pylist(), strict=True):
                term = np.array([_hash(t) for t in {t for t, _, _ in _terms(text)}], np.int64)
                for entity in entities if len(term) else ():
                    yield batch(tk=pa.array([tk] * len(term), pa.binary()), n=np.full(len(term), n), entity=np.full(len(term), entity), term=term)

    return held.mapInArrow(run, "tk binary, n long, entity long, term long")


def _places(held: DataFrame) -> DataFrame:
    """tk, s, e: where the listed terms stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tk, text, terms in zip(b.column("tk").to_pylist(), _texts(b.column("text")), b.column("terms").to_pylist(), strict=True):
                bad = set(terms)
                at = np.array([(s, e) for t, s, e in _terms(text) if _hash(t) in bad], np.int32).reshape(-1, 2)
                yield batch(tk=pa.array([tk] * len(at), pa.binary()), s=at[:, 0], e=at[:, 1])

    return held.mapInArrow(run, "tk binary, s int, e int")


def holders(docs: DataFrame) -> DataFrame:
    """term, n: the rows that hold each term, from all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: Counter = Counter()
            for t in _texts(b.column("text")):
                held.update({w.lower() for w in _TERM.findall(t)})
            if held:
                yield batch(term=pa.array([_hash(w) for w in held], pa.int64()), n=pa.array(list(held.values()), pa.int64()))

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, found: DataFrame, threshold: float = 0.9) -> DataFrame | None:
    """tk, s, e: the places of disclosing terms, or None where there are no entities; found: what `base_spans` gives, written."""
    texts = found.select("tk", F.explode("entities").alias("entity")).groupBy("tk", "entity").agg(F.count("*").alias("n"))
    texts = written(texts, "entities")
    if not texts.head(1):
        return None
    # entities of the same texts are one class, named by two sums over these texts without order
    classes = texts.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts"), F.bit_xor(F.xxhash64("tk")).alias("x"), F.bit_xor(F.xxhash64("tk", F.lit(1))).alias("y"))
    classes = classes.groupBy("n_entity", "texts", "x", "y").agg(F.min("entity").alias("entity")).select("entity", "n_entity")
    classes = written(classes, "classes")
    listed = texts.join(classes, "entity").groupBy("tk").agg(F.first("n").alias("n"), F.collect_list("entity").alias("entities"))
    marked = docs.select(text_key().alias("tk"), "text").join(listed, "tk")
    held = written(marked.groupBy("tk").agg(F.first("text").alias("text"), F.first("n").alias("n"), F.first("entities").alias("entities")), "held")
    pairs = written(_pairs(held), "pairs")
    total = found.count()
    joint = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both")).join(classes, "entity").join(holders(docs), "term")
    share = 1 - F.log(F.col("n_both") / F.col("n")) / F.log(F.col("n_entity") / F.lit(float(total)))
    bad = joint.filter(F.col("n_entity") < total).withColumn("share", share).filter(F.col("share") >= threshold).select("entity", "term")
    hit = pairs.join(bad, ["entity", "term"]).groupBy("tk").agg(F.collect_set("term").alias("terms"))
    return written(_places(held.select("tk", "text").join(hit, "tk")), "terms")


def _by_text(places: DataFrame) -> DataFrame:
    """The places of a text in one row, once for each salt: copies of it may be many."""
    one = places.groupBy("tk").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("places"))
    return one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def spans(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts, base and all: both as kind:start:end; terms follow the patterned kinds. n_term and n_spans count them."""
    found = written(base_spans(docs), "found")
    places = disclosing(docs, found, **options)
    out = found.drop("entities")
    if places is None:
        out = out.withColumn("terms", F.lit(None).cast("string")).withColumn("n_term", F.lit(0).cast("long"))
    else:
        one = lambda x: F.concat(F.lit("term:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))
        terms = _by_text(places).select("tk", "salt", F.array_join(F.transform("places", one), ",").alias("terms"), F.size("places").cast("long").alias("n_term"))
        out = out.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(terms, ["tk", "salt"], "left").drop("salt")
        out = out.withColumn("n_term", F.coalesce("n_term", F.lit(0)))
    out = out.withColumn("n_spans", F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_term"))
    return out.withColumn("spans", F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "terms"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs with patterned spans generalised to [KIND] and disclosing terms removed; n_chars follows the text."""
    places = disclosing(docs, written(base_spans(docs), "found"), **options)
    schema = docs.schema
    tk, sk, pk = (free_name(docs, x) for x in ("tk", "salt", "places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for text, terms in zip(texts, b.column(pk).to_pylist(), strict=True):
                if text:
                    cuts = sorted([(s, e, f"[{k.upper()}]") for k, s, e in find(text)] + [(x["s"], x["e"], "") for x in terms or ()])
                    at, kept = 0, []
                    for s, e, name in cuts:
                        if s >= at:
                            kept += [text[at:s], name]
                        at = max(at, e)
                    text = "".join([*kept, text[at:]])
                out.append(text)
            columns = {n: pa.array(out, pa.string()) if n == "text" else b.column(n) for n in schema.names}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in out]).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    if places is None:
        marked = docs.withColumn(pk, F.lit(None).cast("array<struct<s:int,e:int>>"))
    else:
        mine = _by_text(places).select(F.col("tk").alias(tk), F.col("salt").alias(sk), F.col("places").alias(pk))
        marked = docs.withColumn(tk, text_key()).withColumn(sk, F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(mine, [tk, sk], "left")
    return marked.select(*schema.names, pk).mapInArrow(run, schema)
