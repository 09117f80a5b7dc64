"""Registered queries of this subpackage: op<N>_<name>, each over its whole table, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import ann, chat, html, jaccard, mixing, packing, quality, secrets, topk, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted by the default template."""
    case = spark.createDataFrame(chat.CONTROL_CASE, "conv_id bigint, turn bigint, role string, text string")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(case)
    return chat.digest(chat.format_chats(rows))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each query, a row in twenty, among all other rows."""
    rows = _read(spark, sf_dir, "embeddings")
    quantisers, index = ann.build(rows)
    return ann.search(index, quantisers, rows.where("vec_id % 20 = 0"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.main_text(_read(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources mixed so that none is repeated more than 1.5 times as often as another, none less than once."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, max_repeat=1.5)
    return mixed.select("doc_id", F.col("_source").alias("source"), F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), *(F.round(f"_{c}", 6).alias(c) for c in ("copies", "weight")), F.round("_order", 6).alias("mix_order"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that five-word shingles link at a similarity of 0.75 or more."""
    return jaccard.similar_groups(_read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest products of each query, a row in a hundred, with all other rows."""
    rows = _read(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets.scan(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_source_mixing": op2_source_mixing,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_exact_topk": op4_exact_topk,
    "op5_secret_scan": op5_secret_scan,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_html_extraction": op9_html_extraction,
    "op10_toxicity": op10_toxicity,
}
ORACLE: dict[str, str] = {
    "op2_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN length(text) > 0 THEN length(text) - length(translate(text, ' ' || chr(10), '')) + 1 ELSE 0 END AS n FROM documents),
s AS (SELECT source, sum(n)::DOUBLE AS available, sum(n)::DOUBLE / (SELECT sum(n) FROM d) AS share FROM d GROUP BY source HAVING sum(n) > 0),
e AS (
  SELECT coalesce(min(i), 1048576) / 1048576.0::DOUBLE AS a FROM range(1048576) t(i)
  WHERE pow((SELECT min(share) FROM s), i / 1048576.0::DOUBLE - 1) / pow((SELECT max(share) FROM s), i / 1048576.0::DOUBLE - 1) <= 1.5),
w AS (
  SELECT source, available::BIGINT AS available, pow(share, a) / (SELECT sum(pow(share, a)) FROM s, e) AS weight,
    floor(pow(share, a) * (SELECT sum(available) FROM s) / pow((SELECT max(share) FROM s), a - 1) + 0.5)::BIGINT AS wanted FROM s, e),
p AS (SELECT *, wanted // available AS whole, wanted % available AS rest, wanted / available::DOUBLE AS copies FROM w),
k AS (SELECT d.*, weight, whole, rest, copies, md5('1:' || whole || ':' || doc_id) AS key FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (SELECT *, sum(CASE WHEN n > 0 THEN n ELSE 0 END) OVER (PARTITION BY source ORDER BY key, n ROWS UNBOUNDED PRECEDING) AS upto FROM k),
u AS (SELECT *, whole + (rest > 0 AND n > 0 AND 2 * rest >= 2 * upto - n)::INT AS times FROM c),
x AS (SELECT *, unnest(range(times)) AS epoch FROM u)
SELECT doc_id, source, n::BIGINT AS n_tokens, epoch::INT AS epoch, round(copies, 6) AS copies, round(weight, 6) AS weight,
  round(least((epoch + ('0x' || substr(md5('1:' || epoch || ':' || doc_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE) / copies, 1 - 1e-9), 6) AS mix_order
FROM x""",
    "op4_exact_topk": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
u AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t') AS shown FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ' || shown || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars,
  false AS rewrites
FROM u GROUP BY conv_id""",
}
