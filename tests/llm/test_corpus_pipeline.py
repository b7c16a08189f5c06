"""The stages on a small corpus, each against a plain version of what it decides."""

import random

import pytest

import corpus_pipeline as p
from triagelake.llm.tokens import Encoder, tokenizer_path

from .test_jaccard import shingles
from .test_packing import check
from .test_pii import brute as pii_brute
from .test_quality import base


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdeilmnorst") for _ in range(r.randrange(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, text(r.randrange(60, 140)), "en", f"s{i % 3}") for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s0") for i in range(8)] + [(110 + i, rows[i][1] + " tail", "en", "s1") for i in range(8)]
    rows += [(120, text(20), "en", "s0"), (121, "same words here " * 40, "en", "s0"), (122, None, None, None), (123, text(80) + " mail bob@corp.example.com now", "en", "s2")]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, stages = docs.columns, dict(p.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    good = stages["quality rules"](spark, docs, corpus)
    bad = {d for d, t in texts.items() if (b := base(t))[0] < 50 or 100 * b[4] > 50 * b[0]}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == set(texts) - bad and {120, 121, 122} <= bad

    one = stages["n-gram Jaccard join"](spark, good, corpus)
    kept = sorted(r.doc_id for r in one.collect())
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want, sets = [], {}
    for d in sorted(set(texts) - bad):
        sets[d] = shingles(texts[d])
        if not any(near(sets[d], sets[w]) for w in want):
            want.append(d)
    assert one.columns == columns and kept == want and not {100, 110} & set(kept)

    clean = stages["PII"](spark, one, corpus)
    after = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns and sorted(after) == kept and "[EMAIL]" in after[123] and not any(pii_brute(t) for t in after.values())

    mixed = stages["mixing to target weights"](spark, clean, corpus)
    assert mixed.columns == columns and len({r.doc_id for r in mixed.collect()}) == mixed.count() >= 0.9 * len(kept)

    pieces = stages["packing"](spark, mixed, corpus).collect()
    enc = Encoder.get(tokenizer_path("word_bpe_49k.json")).tokenizer
    check(pieces, {r.doc_id: [*enc.encode(r.text, add_special_tokens=False).ids, 1] for r in mixed.collect()}, 2048, 256, 2048, {})


def test_run(spark, corpus):
    assert p.run(spark, corpus).count() > 0


def test_stages_on_empty_tables(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{corpus}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert p.run(spark, str(tmp_path)).count() == 0
