"""The operators of this folder applied to whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, jaccard, mixing, orcids, packing, pii, quality, suffix, toxicity, warc
from .common import scratch
from .tokens import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    index = ann.build(vectors, "vec_id", "embedding")
    queries = ann.valid(vectors.filter("CAST(vec_id AS long) % 50 = 0"), "vec_id", "embedding")
    return ann.search(index, queries, 5)


_DOT = "list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda x, y: x + y)"
OP1_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     n AS (SELECT vec_id, e, sqrt({_DOT.format(a="e", b="e")}) AS n FROM v),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT.format(a="q.e", b="c.e")} / (q.n * c.n) AS score FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.resolved(spark, path)


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM q
"""


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove(_table(spark, sf_dir, "documents"), width=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"), k=5, percent=75).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
     n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
     i AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL),
     e AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
     u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
     k(r, root) AS (SELECT a, a FROM u UNION SELECT u.b, k.root FROM k JOIN u ON u.a = k.r),
     o AS (SELECT r, min(root) AS root FROM k GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(min(doc_id) OVER (PARTITION BY coalesce(root, r)), doc_id) AS component_id FROM d LEFT JOIN n USING (r) LEFT JOIN o USING (r)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, tokens=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left"]
    return quality.judge(_table(spark, sf_dir, "documents")).select(cols)


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
     w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
     g AS (SELECT r, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM w),
     h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
     q AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY r),
     l AS (SELECT r, host, t, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM d),
     m AS (SELECT r, host, t, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[^\x20\x09-\x0D]+') AS words FROM l),
     f AS (SELECT host, words FROM m GROUP BY ALL HAVING count(DISTINCT t) > 10),
     b AS (SELECT host, words FROM (SELECT host, words, count(DISTINCT t) AS c FROM m SEMI JOIN f USING (host, words) GROUP BY ALL) JOIN (SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY host) USING (host) WHERE c > 0.1 * texts),
     x AS (SELECT r, sum(len(words)) AS lost FROM m SEMI JOIN b USING (host, words) GROUP BY r),
     y AS (SELECT r, count(*) - count(DISTINCT line) AS dup FROM l GROUP BY r),
     n AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda a: length(a))), 0) AS BIGINT) AS word_chars,
                  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words, CAST(len(w) - coalesce(lost, 0) AS BIGINT) AS words_left
           FROM d JOIN w USING (r) LEFT JOIN q USING (r) LEFT JOIN y USING (r) LEFT JOIN x USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= greatest(50, 0.5 * n_words) AS kept FROM n
"""


def op7_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "orc")
    orcids.write(_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return orcids.digests(spark, path)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_term", "n_spans")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), [0.05, 0.9, 0.05], whole=1)
    shares = [F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(mixing.DOMAINS)]
    return rated.select("doc_id", F.col("tokens").alias("n_tokens"), *shares, "rate", "target", "reached", "met")


QUERIES = {f.__name__: f for f in (op1_ann, op2_warc, op3_suffix, op4_jaccard, op5_packing, op6_quality, op7_orc, op8_pii, op9_toxicity, op10_mixing)}
ORACLE_SQL: dict[str, str] = {"op1_ann": OP1_SQL, "op2_warc": OP2_SQL, "op4_jaccard": OP4_SQL, "op6_quality": OP6_SQL}
