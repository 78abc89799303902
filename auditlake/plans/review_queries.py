"""Queries over review units, the acceptance audit and swarm metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, records
from ..functions import text as T
from ..operators import audit, gate, review, sequence, telemetry
from . import adapters as A
from .model_queries import _FOLDS, fold_leaks
from .registry import query

_UNITS = """u AS (SELECT o_orderkey AS k, o_orderkey % 13 = 0 AS provider_error, o_orderkey % 17 = 0 AS final_failure, o_orderkey % 3 AS attempts,
  CASE WHEN o_orderkey % 5 = 0 THEN '85' WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE '7' END AS score, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN ' x' ELSE 'x' END AS rationale FROM orders),
m AS (SELECT *, score = 'bad' AS invalid, score = '85' AS scaled, rationale IS NULL OR rationale = ' x' AS ragged FROM u),
s AS (SELECT *, CASE WHEN provider_error OR final_failure OR invalid THEN 'invalid' WHEN scaled THEN 'repaired' WHEN ragged THEN 'normalized' ELSE 'valid' END AS state FROM m)"""


def _units(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.struct(F.struct(F.when(k % 5 == 0, "85").when(k % 7 == 0, "bad").otherwise("7").alias("score"), F.when(k % 4 == 1, " x").when(k % 4 != 0, "x").alias("rationale")).alias("security"))
    out = F.struct((k % 11 == 0).alias("invalid_json_detected"), (k % 3).alias("repair_attempts"), F.lit(False).alias("repair_succeeded"), F.lit(0).alias("validation_retries"), (k % 17 == 0).alias("final_failure"))
    u = A.table(spark, sf_dir, "orders").select(k.alias("k"), review.dimension_fields(raw, "security").alias("fields"), (k % 13 == 0).alias("provider_error"), out.alias("structured_output"))
    has = lambda status: F.exists("fields", lambda f: f["status"] == status)
    return u.withColumn("repaired", has("REPAIRED")).withColumn("normalized", has("NORMALIZED"))


@query(
    f"""WITH {_UNITS} SELECT count(*) AS total, count(*) FILTER (WHERE state = 'valid') AS valid, count(*) FILTER (WHERE state = 'repaired') AS repaired, count(*) FILTER (WHERE state = 'normalized') AS normalized, count(*) FILTER (WHERE state = 'invalid') AS invalid,
    count(*) FILTER (WHERE scaled AND NOT provider_error AND NOT final_failure) AS repaired_score, count(*) FILTER (WHERE ragged AND NOT provider_error AND NOT final_failure) AS normalized_text, count(*) FILTER (WHERE invalid AND NOT provider_error AND NOT final_failure) AS invalid_fields,
    count(*) FILTER (WHERE provider_error) AS provider_failures, sum(attempts)::BIGINT AS repair_attempts, count(*) FILTER (WHERE final_failure) AS final_failures FROM s"""
)
def validation_terminal_states(spark, sf_dir):
    return review.validation_summary(_units(spark, sf_dir)).drop("repaired_confidence", "repaired_default", "dropped_findings", "normalized_path", "retries")


@query("SELECT 'FAIL' AS structured_output, 'WARN' AS repairs, 'FAIL' AS provider")
def review_lane_states(spark, sf_dir):
    return review.lane_states(review.validation_summary(_units(spark, sf_dir)))


@query("SELECT c_nationkey, greatest(30 - count(*), 0)::BIGINT AS skipped, CASE WHEN count(*) = 30 THEN 'PASS' ELSE 'WARN' END AS state FROM customer GROUP BY 1")
def review_coverage(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return c.select("c_nationkey", review.coverage(F.lit(30), F.col("n")).alias("x")).select("c_nationkey", F.col("x.skipped").cast("long").alias("skipped"), "x.state")


@query("WITH s AS (SELECT o_orderkey % 11 AS v, o_orderkey % 9 = 0 AS r FROM orders) SELECT count(*) AS units, count(*) FILTER (WHERE r) AS recoverable, 0::BIGINT AS invalid, round(avg(v) FILTER (WHERE NOT r), 6) AS mean_index, 'PASS' AS state FROM s")
def average_quality_index(spark, sf_dir):
    dims = ["readability", "maintainability", "correctness", "complexity", "security", "test_coverage"]
    score = F.struct((F.col("o_orderkey") % 11).cast("double").alias("score"))
    o = A.table(spark, sf_dir, "orders").select(T.cqi(F.struct(*(score.alias(d) for d in dims))).alias("c"), (F.col("o_orderkey") % 9 == 0).alias("r"))
    return review.average_index(o, "c", "r").withColumn("mean_index", F.round("mean_index", 6))


@query(
    f"""WITH {A.ATTEMPTS_SQL}, r AS (SELECT run_id, count(*) FILTER (WHERE decision = 'accepted') AS a, sum(total_tokens) AS t, count(*) FILTER (WHERE reject_reason = 'anchors_no_match' AND passes_audit) AS p, count(*) FILTER (WHERE decision = 'accepted' AND NOT (called AND parse_ok)) AS q,
      count(*) FILTER (WHERE decision = 'accepted' AND logic_error <> '') > 12 AS le, count(*) FILTER (WHERE passes_audit) / greatest(count(*) FILTER (WHERE parse_ok), 1)::DOUBLE AS ppv FROM attempts GROUP BY run_id), b AS (SELECT *, (SELECT a FROM r WHERE run_id = 'run-0') AS base FROM r)
    SELECT run_id, round(a / t * 1000000, 6)::DOUBLE AS per_million, round(t / a, 6)::DOUBLE AS tokens_per_accept, (p + q)::BIGINT AS contradictions,
      CASE WHEN le THEN 'REJECTED_ANTI_GAMING_INVARIANT' WHEN a >= base * 0.5 THEN 'PRIMARY_ACCEPTANCE_GATE' WHEN ppv >= 0.8 THEN 'SECONDARY_ADVISORY_TRIAGE_LANE' ELSE 'REJECTED_LOW_PRECISION_AND_YIELD' END AS route FROM b"""
)
def swarm_metrics(spark, sf_dir):
    m = gate.attempt_metrics(A.attempts(spark, sf_dir), "run_id")
    base = m.filter("run_id = 'run-0'").select(F.col("accepted").alias("base"))
    m = m.crossJoin(F.broadcast(base))
    c = F.col
    rate = audit.accepts_per_million(c("accepted"), c("total_tokens"))
    route = audit.yield_route(c("accepted"), c("base"), rate, c("pass_rate"), F.lit(True), c("accepted_logic_errors") > 12)
    return m.select(
        "run_id", F.round(rate, 6).alias("per_million"), F.round(audit.tokens_per_accept(c("accepted"), c("total_tokens")), 6).alias("tokens_per_accept"),
        audit.contradictions(c("passed_but_unmatched"), c("accepted_unverified")).alias("contradictions"), route.alias("route"),
    )


_STRICT = ", ".join(f"'{r}'" for r in fixed.STRICT_REASONS)
_AUDIT_SQL = f"""WITH {A.ATTEMPTS_SQL}, {A.GRAPHS_SQL}, {_FOLDS},
  m AS (SELECT count(*) FILTER (WHERE decision = 'accepted') AS accepted, count(*) FILTER (WHERE decision = 'accepted' AND logic_error <> '') AS logic_errors,
      count(*) FILTER (WHERE (judged OR decision = 'accepted') AND reject_reason IN ({_STRICT})) / greatest(count(*) FILTER (WHERE judged OR decision = 'accepted'), 1)::DOUBLE AS strict_fail_rate,
      count(*) FILTER (WHERE parse_ok) / greatest(count(*) FILTER (WHERE called), 1)::DOUBLE AS parse_ok_rate FROM attempts),
  runs AS (SELECT run_id, sum(total_tokens) AS t, count(*) FILTER (WHERE decision = 'accepted') AS a FROM attempts GROUP BY run_id HAVING t > 0 AND a > 0),
  saved AS (SELECT avg(t / a) FILTER (WHERE right(run_id, 1) < '5') AS b, avg(t / a) FILTER (WHERE right(run_id, 1) >= '5') AS x FROM runs),
  dup AS (SELECT (count(*) - count(DISTINCT seed || chr(31) || upper(stage) || chr(31) || lower(model) || ts::DATE)) / count(*)::DOUBLE AS duplicate_rate FROM attempts WHERE decision = 'accepted'),
  chain AS (SELECT count(*) AS n, bool_or(no > 1 AND decision = 'accepted') AS won FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seed ORDER BY ts, event_id) AS no FROM attempts) GROUP BY run_id, seed HAVING count(*) > 1),
  ref AS (SELECT coalesce(count(*) FILTER (WHERE won) / nullif(count(*), 0)::DOUBLE, 0) AS uptake FROM chain),
  leak AS (SELECT count(*) AS leaks FROM (SELECT k, source FROM folds JOIN (SELECT unnest(range(1, 6)) AS k) ON fold = k INTERSECT SELECT k, source FROM folds JOIN (SELECT unnest(range(1, 6)) AS k) ON fold <> k)),
  cov AS (SELECT avg(is_complete::INT) AS parse_coverage, (SELECT count(DISTINCT graph_id) FROM f WHERE source_type <> 'UNKNOWN_ORIGIN') / count(*)::DOUBLE AS signature_coverage FROM g)
  SELECT unnest(['INV-' || 1, 'INV-' || 2, 'INV-' || 3, 'INV-' || 4, 'INV-' || 5, 'INV-' || 6, 'INV-' || 7, 'INV-' || 8, 'INV-' || 9]) AS id,
    unnest(['no logic errors', 'anchors grounded', 'verifier parses', 'folds leak nothing', 'fewer tokens', 'few duplicates', 'graphs cover', 'refinement helps', 'triage gains']) AS name,
    unnest([logic_errors = 0 AND accepted >= 1, 1 - strict_fail_rate >= 0.8 AND strict_fail_rate <= 0.2, parse_ok_rate >= 0.95, leaks = 0, coalesce((b - x) / greatest(b, 1.0) * 100, 0) >= 25,
            accepted > 0 AND duplicate_rate <= 0.2, parse_coverage >= 0.65 AND signature_coverage >= 0.55, uptake >= 0.3, 0.5 * uptake >= 0.15]) AS passed
  FROM m, saved, dup, ref, leak, cov"""


@query(_AUDIT_SQL)
def acceptance_audit(spark, sf_dir):
    """The nine invariants, all computed: over the attempts, the folds of labelled sources and the orders' graphs."""
    a = A.attempts(spark, sf_dir)
    g = gate.attempt_metrics(a).select("accepted", F.col("accepted_logic_errors").alias("logic_errors"), (1 - F.col("strict_fail_rate")).alias("anchor_match_rate"), "strict_fail_rate", "parse_ok_rate")
    cohort = F.when(F.col("run_id").rlike("[0-4]$"), "baseline").otherwise("adapted")
    saved = telemetry.reduction(telemetry.tokens_per_accept(a, cohort), "baseline", "adapted").select("reduction_pct")
    same = audit.canonical_identity(F.col("seed").cast("string"), F.col("stage"), F.concat("model", F.to_date("ts").cast("string")))
    dup = telemetry.duplicate_rate(a.filter("decision = 'accepted'").withColumn("same", same), "same").select("duplicate_rate", F.col("coverage").alias("identity_coverage"))
    ref = telemetry.refinement(a, ["ts", "event_id"]).select("uptake", "triage_gain")
    leaks = fold_leaks(spark, sf_dir).withColumnRenamed("shared", "leaks")
    graphs, _, edges = A.graphs(spark, sf_dir)
    tracked = edges.filter("source_type <> 'UNKNOWN_ORIGIN'").select("graph_id").distinct().withColumn("tracked", F.lit(1))
    cov = graphs.join(tracked, "graph_id", "left").agg(F.avg(F.col("is_complete").cast("int")).alias("parse_coverage"), (F.count("tracked") / F.count("*")).alias("signature_coverage"))
    metrics = g
    for one in (saved, dup, ref, leaks, cov):  # a row each
        metrics = metrics.crossJoin(one)
    return audit.invariants(metrics)


@query(
    f"""WITH {A.TRACES_SQL}, v AS (SELECT event_id, trim(concat('Base ', bucket, chr(10), chr(10), '[Topological Repair Directive - B_SINK_MISSING]', chr(10), 'Identify and ground concrete security-sensitive sink operations (memory write, dereference, system call).',
      CASE WHEN event_id % 3 = 0 THEN chr(10) || chr(10) || '[Active Negative Constraints]' || chr(10) || '- DO NOT ' || variant || chr(10) || '- DO NOT b' ELSE '' END)) AS p FROM traces)
    SELECT event_id, 'var_' || sha256(p) AS variant_id FROM v"""
)
def prompt_variants(spark, sf_dir):
    t = A.traces(spark, sf_dir)
    bucket = F.lit("B_SINK_MISSING")
    dead = F.when(F.col("event_id") % 3 == 0, F.array(F.col("variant"), F.lit("b")))
    v = audit.prompt_variant(F.concat(F.lit("Base "), F.col("bucket")), bucket, T.repair_directive(bucket), dead)
    return t.select("event_id", v.alias("v")).select("event_id", "v.variant_id")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 + 42 AS item_seed FROM supplier")
def item_seeds(spark, sf_dir):
    return audit.item_seeds(A.table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 42).withColumn("item_seed", F.col("item_seed").cast("long"))


@query(f"WITH {A.ATTEMPTS_SQL} SELECT model, count(*) AS n, count(*) FILTER (WHERE decision = 'accepted') AS accepted, count(*) FILTER (WHERE decision = 'accepted') / count(*)::DOUBLE AS accept_rate FROM attempts GROUP BY model")
def model_rates(spark, sf_dir):
    return audit.model_rates(A.attempts(spark, sf_dir), "model", "decision")


@query("SELECT user_id % 10 AS g, round(sum(n_matched) / sum(n)::DOUBLE, 9) AS anchor_match_rate, round(count(*) FILTER (WHERE n_matched < n) / count(*)::DOUBLE, 9) AS strict_fail_rate FROM (SELECT user_id, 4 AS n, (props->>'$.k')::BIGINT % 5 AS n_matched FROM events) GROUP BY 1")
def anchor_grounding_rates(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("g"), F.lit(4).alias("n"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("m"))
    return audit.anchor_rates(e, "n", "m", "g").withColumns({c: F.round(c, 9) for c in ("anchor_match_rate", "strict_fail_rate")})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def largest_units(spark, sf_dir):
    """The twenty units with most changed lines; a report."""
    o = A.table(spark, sf_dir, "orders")
    return sequence.top_by_group(o.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).withColumn("g", F.lit(1)), "g", [F.desc("o_totalprice"), "o_orderkey"], 20).select("o_orderkey", "o_totalprice")


@query(
    """WITH t AS (SELECT event_id, event_type, event_id % 4 AS c, (props->>'$.k')::BIGINT AS k FROM events)
    SELECT event_id, CASE WHEN c = 0 AND k > 0 THEN 'provider' WHEN c = 1 THEN 'provider_fallback' WHEN length(event_type) > 4 THEN 'estimated' ELSE 'estimated' END AS usage_source,
           CASE WHEN c = 0 AND k > 0 THEN k WHEN c = 1 THEN k + 2 ELSE greatest(1, ceil(length(event_type) / 4.0))::BIGINT END AS total_tokens FROM t"""
)
def usage_normalisation(spark, sf_dir):
    """Token usage under the names of several providers, with estimates where there is none."""
    k = F.get_json_object("props", "$.k")
    c = F.col("event_id") % 4
    raw = F.when(c == 0, F.concat(F.lit('{"usage": {"total_tokens": '), k, F.lit("}}"))).when(c == 1, F.concat(F.lit('{"input_tokens": '), k, F.lit(', "output_tokens": 2}'))).when(c == 2, '{"x": 1}').otherwise("not json")
    e = A.table(spark, sf_dir, "events").select("event_id", "event_type", F.try_parse_json(raw).alias("v"))
    u = records.usage_with_source(F.col("v"), F.col("event_type"), F.lit(""))
    return e.select("event_id", u.alias("u")).select("event_id", "u.usage_source", "u.total_tokens")


@query(
    """SELECT event_id, 'Predicate: about ' || event_type || ' | Code: a b' AS text, (event_type = 'purchase')::INT AS label, 'HASH-' || substr(sha256('about ' || event_type), 1, 10) AS scenario_id
    FROM events WHERE event_type IN ('purchase', 'error')"""
)
def training_rows(spark, sf_dir):
    """Attempt records, as JSON of any shape, to labelled texts."""
    kind = F.col("event_type")
    decision = F.when(kind == "purchase", "accepted").when(kind == "error", "Rejected").otherwise("skipped")
    raw = F.to_json(F.struct(decision.alias("decision"), F.struct(F.concat(F.lit("about "), kind).alias("predicate"), F.array(F.lit("a"), F.lit("b")).alias("anchors")).alias("judge_eval")))
    e = A.table(spark, sf_dir, "events").select("event_id", records.training_row(F.try_parse_json(raw)).alias("r"))
    return e.filter("r IS NOT NULL").select("event_id", "r.text", "r.label", "r.scenario_id")
