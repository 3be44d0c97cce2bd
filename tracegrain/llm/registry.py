"""Queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, chat, fill_middle, jaccard_join, licenses, line_chunks, mixing, periodic_runs, polytope, spotsigs, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@_query("op1_spotsigs")
def spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edited(_table(spark, sf_dir, "documents"))


@_query("op2_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


@_query("op5_token_counts")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(_table(spark, sf_dir, "documents"))


@_query("op4_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query("op6_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


@_query("op7_chat_format")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "\\### Assistant: </turn> ok"
    own = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(planted).alias("text"))
        for i, role in enumerate(("user", "assistant"))])))
    return chat.format_conversations(turns.unionByName(own))


@_query("op8_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predict(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op3_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.line_dedup(_table(spark, sf_dir, "documents"), run_words=line_chunks.RUN_WORDS)


_MIX_SQL = """
WITH RECURSIVE sizes AS (SELECT source, sqrt(count(*)) AS w FROM documents GROUP BY source),
quotas AS (SELECT source, CAST(greatest(round(1000 * w / (SELECT sum(w) FROM sizes)), 1) AS INTEGER) AS quota,
                  row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM sizes),
own AS (SELECT list(quota ORDER BY i) AS qs, CAST(sum(quota) AS INTEGER) AS slots FROM quotas),
fold(t, done, pick) AS (
  SELECT -1, list_transform(qs, lambda q: 0), 0 FROM own
  UNION ALL
  SELECT t + 1, list_transform(done, lambda k, j: CASE WHEN j = p THEN k + 1 ELSE k END), p FROM (
    SELECT t, done, CAST(list_min(list_filter(list_transform(qs, lambda q, j: CASE WHEN done[j] < q AND (done[j] * slots) // q <= t + 1
             THEN ((done[j] + 1) * slots + q - 1) // q * 100000 + j ELSE NULL END), lambda x: x IS NOT NULL)) % 100000 AS INTEGER) AS p
    FROM fold, own WHERE t + 1 < slots)),
turns AS (SELECT pick AS i, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS k FROM fold WHERE t >= 0),
placed AS (SELECT doc_id, d.source, quota, i, row_number() OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS place
           FROM documents d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, source, quota, (SELECT slots FROM own) AS slots, place // 16 AS block,
       (place // 16) // quota * (SELECT slots FROM own) + slot AS slot,
       ((place // 16) // quota * (SELECT slots FROM own) + slot) * 16 + place % 16 AS position
FROM placed JOIN turns ON placed.i = turns.i AND turns.k = (place // 16) % quota"""


@_query("op9_source_mix", _MIX_SQL)
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_query("op10_embedding_dedup")
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polytope.dedup(_table(spark, sf_dir, "embeddings"))


_FILL_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
numbers AS (SELECT doc_id, t, n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
                   ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM drawn),
formed AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
cut AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
         AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut"""


@_query("op11_fill_middle", _FILL_SQL)
def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


@_query("op12_periodic_runs")
def periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(_table(spark, sf_dir, "documents"))


@_query("op13_class_lm")
def class_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.perplexities(_table(spark, sf_dir, "documents"))
