"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination, contamination_report
from .langid import language_id
from .licenses import license_report, license_scan
from .mixing import mix
from .quality import quality
from .secrets import secret_scan
from .simhash import near_duplicates
from .substrings import remove_repeated
from .topk import exact_top_k
from .toxicity import toxicity


def op1_secret_scan(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents"))


def op2_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_license_scan(spark, sf_dir):
    return license_report(license_scan(table(spark, sf_dir, "documents")))


def op5_quality_classifier(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark, sf_dir):
    return contamination_report(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    kept = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return remove_repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", kept)


def op10_exact_top_k(spark, sf_dir):
    return exact_top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_source_mixing,
        op3_toxicity,
        op4_license_scan,
        op5_quality_classifier,
        op6_benchmark_decontamination,
        op7_simhash_near_dedup,
        op8_language_id,
        op9_substring_dedup,
        op10_exact_top_k,
    )
}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = f"translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op6_benchmark_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
  iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS p FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS s FROM i WHERE len(ws) > 0) x),
  dw AS (SELECT doc_id, s, n, array_to_string(ws[s:s + n - 1], ' ') AS p FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) l) y),
  hit AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.p = iw.p AND dw.n = iw.n),
  h AS (SELECT doc_id, count(DISTINCT pos) AS c FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hit) z GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS c, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) u GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.c, 0) AS n_hit, coalesce(t.c, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.c, 0) > 0 AS contaminated
  FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op9_substring_dedup": f"""WITH d AS (SELECT doc_id, {_BLANK_WORDS} AS ws FROM documents),
  w AS (SELECT doc_id, s, array_to_string(ws[s:s + 34], ' ') AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM d WHERE len(ws) >= 35) x),
  gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS pos FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY p) AS c FROM w) y WHERE c > 1),
  words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
  kept AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.pos) AS t FROM words k LEFT JOIN gone g ON g.doc_id = k.doc_id AND g.pos = k.pos WHERE g.pos IS NULL GROUP BY k.doc_id),
  n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n.c, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op10_exact_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL),
  p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
  SELECT query_id, CAST(place AS INT) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p) r WHERE place <= 10""",
}
