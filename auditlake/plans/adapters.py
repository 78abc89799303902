"""The engine's logical tables over the driver's parquet tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels where they have any."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted training rows: every document with anchors cut from its text, some of them made to fail."""
    word = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    second = F.when(F.col("doc_id") % 5 == 0, "no such anchor").when(F.col("doc_id") % 11 == 0, "missing bounds check").otherwise(word(2))
    first = F.when(F.col("doc_id") % 13 == 0, "unsafe").otherwise(word(1))
    level = F.when(F.col("toxic") == 1, "unsupported").when(F.col("quality") == 0, "inconclusive").when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise("supported")
    return labelled(spark, sf_dir).select(
        "doc_id", "lang", F.col("text").alias("input"), F.col("text").alias("predicate"), F.col("lang").alias("counterfactual"), F.col("source").alias("verifier_report"),
        level.alias("support_level"), F.when(F.col("doc_id") % 7 == 0, F.array(first)).otherwise(F.array(first, second)).alias("anchors"),
    )


_GENERIC = "|".join(fixed.GENERIC_ANCHOR)
CORPUS_SQL = f"""
corpus AS (
  SELECT d.doc_id, d.lang, d.text AS input, d.text AS predicate, d.source AS verifier_report,
         CASE WHEN toxic = 1 THEN 'unsupported' WHEN quality = 0 THEN 'inconclusive' WHEN d.doc_id % 17 = 0 THEN NULL ELSE 'supported' END AS support_level,
         CASE WHEN d.doc_id % 7 = 0 THEN [a1] ELSE [a1, a2] END AS anchors
  FROM (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'unsafe' ELSE split_part(text, ' ', 1) END AS a1,
               CASE WHEN doc_id % 5 = 0 THEN 'no such anchor' WHEN doc_id % 11 = 0 THEN 'missing bounds check' ELSE split_part(text, ' ', 2) END AS a2
        FROM documents) d LEFT JOIN labels l USING (doc_id)
), judged AS (
  SELECT *, support_level IS NOT NULL AND trim(predicate) <> '' AS accepted,
         list_filter(anchors, lambda a: trim(a) <> '' AND contains(lower(input), lower(a))) AS hits,
         list_filter(anchors, lambda a: trim(a) = '' OR regexp_matches(lower(a), '{_GENERIC}')) AS generic
  FROM corpus
), rowed AS (
  SELECT *, accepted AND len(anchors) >= 2 AND len(hits) > 0 AS matched,
         CASE WHEN NOT accepted THEN 'missing_required_fields' WHEN len(anchors) < 2 THEN 'anchors_too_few' WHEN len(hits) = 0 THEN 'no_anchor_matches_input' END AS failure
  FROM judged
)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attempts_of(table(spark, sf_dir, "events"))


def attempts_of(events: DataFrame) -> DataFrame:
    """Attempts with verifier and judge fields, one for each event."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    e = events.withColumn("k", k)
    called = kind.isin("purchase", "view")
    parsed = called & (F.col("k") % 9 != 0)
    reason = F.when(kind == "error", F.element_at(F.array(*map(F.lit, ["anchors_no_match", "anchors_too_few_after_normalization", "mechanism_evidence_failed", "verifier_failed"])), (F.col("k") % 4 + 1).cast("int")))
    return e.select(
        "event_id", "ts", F.concat(F.lit("run-"), F.col("user_id") % 10).alias("run_id"), F.col("user_id").alias("seed"), kind.alias("stage"), F.col("value").alias("duration_ms"), F.col("k").alias("total_tokens"),
        (F.col("value") / 1000).alias("cost"), F.when(kind == "purchase", "accepted").when(kind == "error", "rejected").otherwise("other").alias("decision"), reason.alias("reject_reason"),
        F.when(F.col("k") % 10 == 0, "unsupported").when(F.col("k") % 10 == 1, "inconclusive").otherwise("supported").alias("support_level"),
        called.alias("called"), parsed.alias("parse_ok"), F.when(parsed, F.col("k") % 2 == 0).alias("passes_audit"),
        F.when(F.col("k") % 3 == 0, "pro_debater").otherwise("con_debater").alias("winner"), (kind != "signup").alias("judged"),
        F.when(F.col("k") % 50 == 0, "contradiction").otherwise("").alias("logic_error"), F.concat(F.lit("model-"), F.col("k") % 3).alias("model"),
    )


ATTEMPTS_SQL = """
attempts AS (
  SELECT event_id, ts, 'run-' || (user_id % 10) AS run_id, user_id AS seed, event_type AS stage, value AS duration_ms, k AS total_tokens, value / 1000 AS cost,
         CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'other' END AS decision,
         CASE WHEN event_type = 'error' THEN ['anchors_no_match', 'anchors_too_few_after_normalization', 'mechanism_evidence_failed', 'verifier_failed'][(k % 4 + 1)::INT] END AS reject_reason,
         CASE WHEN k % 10 = 0 THEN 'unsupported' WHEN k % 10 = 1 THEN 'inconclusive' ELSE 'supported' END AS support_level,
         called, called AND k % 9 <> 0 AS parse_ok, CASE WHEN called AND k % 9 <> 0 THEN k % 2 = 0 END AS passes_audit,
         CASE WHEN k % 3 = 0 THEN 'pro_debater' ELSE 'con_debater' END AS winner, event_type <> 'signup' AS judged,
         CASE WHEN k % 50 = 0 THEN 'contradiction' ELSE '' END AS logic_error, 'model-' || (k % 3) AS model
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k, event_type IN ('purchase', 'view') AS called FROM events)
)"""


def suites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two suites of test scores, one test a part: line items shipped in even years, and in odd ones."""
    items = table(spark, sf_dir, "lineitem").withColumn("odd", F.year("l_shipdate") % 2 == 1)
    found = items.groupBy("l_partkey", "odd").agg(
        F.round(F.avg("l_quantity") / 5, 6).alias("score"), F.round(F.avg("l_discount") * 100, 6).alias("understandable"), F.round(F.avg("l_tax") * 100, 6).alias("maintainable")
    )
    side = lambda c: found.filter(c).drop("odd").withColumnRenamed("l_partkey", "id")
    return side(~F.col("odd")), side(F.col("odd"))


SUITES_SQL = """
scores AS (
  SELECT l_partkey AS id, year(l_shipdate) % 2 = 1 AS odd, round(avg(l_quantity) / 5, 6) AS score, round(avg(l_discount) * 100, 6) AS understandable, round(avg(l_tax) * 100, 6) AS maintainable
  FROM lineitem GROUP BY 1, 2
), base AS (SELECT * EXCLUDE (odd) FROM scores WHERE NOT odd), other AS (SELECT * EXCLUDE (odd) FROM scores WHERE odd)"""


def graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One graph an order: its line items are edges from suppliers to parts, in the order of line number and part."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    sinks = F.array(*map(F.lit, ["MEMORY_WRITE", "ARRAY_INDEX", "POINTER_DEREF", "SYSTEM_CALL"]))
    guards = F.array(*map(F.lit, ["BOUNDS_CHECK", "RANGE_VALIDATION", "NULL_CHECK", "COMMAND_SANITIZATION", "NONE"]))
    joined = li.join(part, li.l_partkey == part.p_partkey)
    guard = F.element_at(guards, (F.col("l_linenumber") % 5 + 1).cast("int"))
    target = F.concat(F.lit("v"), F.col("l_partkey") % 7)
    edges = joined.select(
        F.col("l_orderkey").alias("graph_id"), (F.col("l_linenumber") * F.lit(10**15) + F.col("l_partkey")).alias("edge_no"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("sink_id"),
        F.when(F.col("l_suppkey") % 4 == 0, "UNKNOWN_ORIGIN").otherwise("UNTRUSTED_INPUT").alias("source_type"), F.element_at(sinks, (F.col("p_size") % 4 + 1).cast("int")).alias("sink_type"),
        F.nullif(guard, F.lit("NONE")).alias("sanitizer_type"), F.when(F.col("l_quantity") < 40, target).otherwise("other").alias("guarded_target"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("double").alias("invalid_at"),
    )
    src = edges.select("graph_id", F.col("source_id").alias("node_id"), F.lit("source").alias("kind"), F.lit(None).cast("string").alias("target_var"))
    dst = joined.select(F.col("l_orderkey").alias("graph_id"), F.concat(F.lit("p"), F.col("l_partkey")).alias("node_id"), F.lit("sink").alias("kind"), target.alias("target_var"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("graph_id"), (F.col("o_orderkey") % 19 != 0).alias("is_complete"), F.lit(None).cast("string").alias("parse_error"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("created_at"),
        (F.col("o_orderkey") % 23 == 0).alias("logic_error"), (F.col("o_orderkey") % 29 == 0).alias("strict_fail"), (F.col("o_orderkey") % 31 != 0).alias("anchor_match"),
    )
    return orders, src.unionByName(dst).distinct(), edges


GRAPHS_SQL = """
e AS (
  SELECT l_orderkey AS graph_id, l_linenumber * 1000000000000000 + l_partkey AS edge_no, CASE WHEN l_suppkey % 4 = 0 THEN 'UNKNOWN_ORIGIN' ELSE 'UNTRUSTED_INPUT' END AS source_type,
         ['MEMORY_WRITE', 'ARRAY_INDEX', 'POINTER_DEREF', 'SYSTEM_CALL'][p_size % 4 + 1] AS sink_type,
         nullif(['BOUNDS_CHECK', 'RANGE_VALIDATION', 'NULL_CHECK', 'COMMAND_SANITIZATION', 'NONE'][l_linenumber % 5 + 1], 'NONE') AS sanitizer_type,
         CASE WHEN l_quantity < 40 THEN 'v' || (l_partkey % 7) ELSE 'other' END AS guarded_target, 'v' || (l_partkey % 7) AS target_var, epoch(l_shipdate)::DOUBLE AS invalid_at
  FROM lineitem JOIN part ON l_partkey = p_partkey
), f AS (
  SELECT *, coalesce((sink_type IN ('MEMORY_WRITE', 'ARRAY_INDEX') AND sanitizer_type IN ('BOUNDS_CHECK', 'RANGE_VALIDATION')) OR (sink_type = 'POINTER_DEREF' AND sanitizer_type = 'NULL_CHECK')
           OR (sink_type = 'SYSTEM_CALL' AND sanitizer_type IN ('COMMAND_SANITIZATION', 'ALLOWLIST_CHECK')), false) AS fits FROM e
), g AS (
  SELECT o_orderkey AS graph_id, o_orderkey % 19 <> 0 AS is_complete, epoch(o_orderdate)::DOUBLE AS created_at, o_orderkey % 23 = 0 AS logic_error, o_orderkey % 29 = 0 AS strict_fail, o_orderkey % 31 <> 0 AS anchor_match FROM orders
)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutation traces: events as outcomes of variants."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "VALID_ACCEPT").when(kind == "error", "LOGIC_ERROR").when((kind == "click") & (k % 5 == 0), "DEAD_END_CHAIN").otherwise("RETRYABLE_FAILURE")
    bucket = F.element_at(F.array(*map(F.lit, ["memory_safety", "integer_arithmetic", "concurrency", "input_validation"])), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", bucket.alias("bucket"), F.concat(F.lit("var_"), k % 7).alias("variant"), F.concat(F.lit("seed-"), F.col("user_id") % 30).alias("seed_id"), outcome.alias("outcome"), F.col("ts").alias("observed_at"),
        F.lit(None).cast("timestamp").alias("evaluated_at"), "ts",
    )


TRACES_SQL = """
traces AS (
  SELECT event_id, ts, ['memory_safety', 'integer_arithmetic', 'concurrency', 'input_validation'][(user_id % 4 + 1)::INT] AS bucket, 'var_' || (k % 7) AS variant, 'seed-' || (user_id % 30) AS seed_id,
         CASE WHEN event_type = 'purchase' THEN 'VALID_ACCEPT' WHEN event_type = 'error' THEN 'LOGIC_ERROR' WHEN event_type = 'click' AND k % 5 = 0 THEN 'DEAD_END_CHAIN' ELSE 'RETRYABLE_FAILURE' END AS outcome
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events)
)"""
