"""Queries over attempts and events: telemetry, windows, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import budgets, gate, sequence, telemetry
from . import adapters as A
from .registry import query


@query(
    f"""WITH {A.ATTEMPTS_SQL}, m AS (SELECT run_id, count(*) AS attempts, count(*) FILTER (WHERE decision = 'accepted') AS accepted, count(*) FILTER (WHERE support_level = 'unsupported') AS unsupported,
      count(*) FILTER (WHERE support_level = 'inconclusive') AS inconclusive, count(*) FILTER (WHERE called) AS called, count(*) FILTER (WHERE parse_ok) AS parse_ok, count(*) FILTER (WHERE passes_audit) AS passed,
      count(*) FILTER (WHERE winner = 'pro_debater') AS pro_wins, count(*) FILTER (WHERE winner = 'pro_debater' AND called) AS called_on_pro_win, count(*) FILTER (WHERE decision = 'accepted' AND NOT (called AND parse_ok)) AS accepted_unverified,
      count(*) FILTER (WHERE decision = 'accepted' AND logic_error <> '') AS accepted_logic_errors, count(*) FILTER (WHERE reject_reason = 'anchors_no_match' AND passes_audit) AS passed_but_unmatched,
      count(*) FILTER (WHERE judged OR decision = 'accepted') AS strict_total,
      count(*) FILTER (WHERE (judged OR decision = 'accepted') AND reject_reason IN ('anchors_too_few_after_normalization', 'anchors_no_match', 'mechanism_evidence_failed')) AS strict_failures,
      sum(total_tokens)::BIGINT AS total_tokens, round(sum(cost), 6) AS total_cost FROM attempts GROUP BY run_id)
    SELECT *, unsupported / attempts::DOUBLE AS unsupported_attempt_rate, inconclusive / attempts::DOUBLE AS inconclusive_attempt_rate, called / attempts::DOUBLE AS called_rate, called_on_pro_win / greatest(pro_wins, 1)::DOUBLE AS called_on_pro_win_rate,
      parse_ok / greatest(called, 1)::DOUBLE AS parse_ok_rate, passed / greatest(parse_ok, 1)::DOUBLE AS pass_rate, accepted_logic_errors / greatest(accepted, 1)::DOUBLE AS logic_error_rate,
      strict_failures / greatest(strict_total, 1)::DOUBLE AS strict_fail_rate, total_tokens / greatest(accepted, 1)::DOUBLE AS tokens_per_accepted, total_tokens / attempts::DOUBLE AS tokens_per_attempt FROM m"""
)
def attempt_gate_by_run(spark, sf_dir):
    found = gate.attempt_metrics(A.attempts(spark, sf_dir), "run_id").drop("cost_per_accepted")
    return found.withColumn("total_cost", F.round("total_cost", 6))


@query(
    """SELECT event_type AS stage, count(*) AS calls, round(avg(value), 6) AS avg_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms,
       min(value) AS min_ms, max(value) AS max_ms, sum((props->>'$.k')::BIGINT)::BIGINT AS total_tokens FROM events WHERE value > 0 GROUP BY 1"""
)
def stage_breakdown(spark, sf_dir):
    found = telemetry.stage_breakdown(A.attempts(spark, sf_dir).filter("duration_ms > 0"), "stage", "duration_ms", "total_tokens")
    return found.select("stage", "calls", *(F.round(c, 6).alias(c) for c in ("avg_ms", "p50_ms", "p95_ms", "p99_ms")), "min_ms", "max_ms", "total_tokens")


@query("SELECT event_type AS stage, list_sort(list(value))[least(floor(0.95 * count(*))::INT, count(*)::INT - 1) + 1] AS value, count(*) AS n FROM events GROUP BY 1")
def nearest_rank_p95(spark, sf_dir):
    return telemetry.nearest_rank(A.attempts(spark, sf_dir), "duration_ms", 0.95, "stage")


@query(
    f"""WITH {A.ATTEMPTS_SQL} SELECT CASE WHEN grouping(stage) = 1 AND grouping(model) = 1 THEN 'total' WHEN grouping(stage) = 0 THEN 'stage' ELSE 'model' END AS level, stage, model, count(*) AS calls, sum(total_tokens)::BIGINT AS total_tokens
    FROM attempts GROUP BY GROUPING SETS ((), (stage), (model))"""
)
def usage_rollup(spark, sf_dir):
    return telemetry.usage_rollup(A.attempts(spark, sf_dir), "stage", "model", "total_tokens")


@query(f"WITH {A.ATTEMPTS_SQL} SELECT stage, count(*) FILTER (WHERE passes_audit) AS hits, count(*) FILTER (WHERE NOT passes_audit) AS misses, coalesce(100.0 * count(*) FILTER (WHERE passes_audit) / nullif(count(passes_audit), 0), 0)::DOUBLE AS hit_rate_pct FROM attempts GROUP BY stage")
def cache_hit_rate(spark, sf_dir):
    return telemetry.cache_rates(A.attempts(spark, sf_dir), "passes_audit", "stage")


@query(
    f"""WITH {A.ATTEMPTS_SQL}, r AS (SELECT run_id, sum(total_tokens) AS t, count(*) FILTER (WHERE decision = 'accepted') AS a FROM attempts GROUP BY run_id HAVING t > 0 AND a > 0)
    SELECT CASE WHEN right(run_id, 1) < '5' THEN 'baseline' ELSE 'adapted' END AS cohort, round(avg(t / a), 6) AS tokens_per_accept, count(*) AS runs FROM r GROUP BY 1"""
)
def tokens_per_accept_by_cohort(spark, sf_dir):
    cohort = F.when(F.col("run_id").rlike("[0-4]$"), "baseline").otherwise("adapted")
    found = telemetry.tokens_per_accept(A.attempts(spark, sf_dir), cohort)
    return found.select("cohort", F.round("tokens_per_accept", 6).alias("tokens_per_accept"), "runs")


@query(
    f"""WITH {A.ATTEMPTS_SQL}, r AS (SELECT run_id, sum(total_tokens) AS t, count(*) FILTER (WHERE decision = 'accepted') AS a FROM attempts GROUP BY run_id), c AS (
      SELECT avg(t / a) FILTER (WHERE right(run_id, 1) < '5') AS b, avg(t / a) FILTER (WHERE right(run_id, 1) >= '5') AS x FROM r)
    SELECT round(b, 6) AS baseline, round(x, 6) AS adapted, round((b - x) / greatest(b, 1.0) * 100, 6) AS reduction_pct FROM c"""
)
def token_reduction(spark, sf_dir):
    cohort = F.when(F.col("run_id").rlike("[0-4]$"), "baseline").otherwise("adapted")
    found = telemetry.reduction(telemetry.tokens_per_accept(A.attempts(spark, sf_dir), cohort), "baseline", "adapted")
    return found.select(*(F.round(c, 6).alias(c) for c in found.columns))


@query(
    f"""WITH {A.ATTEMPTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id, seed, day ORDER BY ts, event_id) AS no FROM (SELECT *, ts::DATE AS day FROM attempts)), c AS (
      SELECT run_id, seed, day, count(*) AS n, bool_or(no > 1 AND decision = 'accepted') AS won FROM n GROUP BY ALL HAVING count(*) > 1)
    SELECT count(*) AS candidates, count(*) FILTER (WHERE won) AS successes, count(*) FILTER (WHERE won) / count(*)::DOUBLE AS uptake, 0.5 * count(*) FILTER (WHERE won) / count(*)::DOUBLE AS triage_gain FROM c"""
)
def refinement_uptake(spark, sf_dir):
    a = A.attempts(spark, sf_dir).withColumn("seed", F.concat_ws("/", "seed", F.to_date("ts")))
    return telemetry.refinement(a, ["ts", "event_id"])


@query("SELECT lang, count(*) AS n, count(text) AS known, count(DISTINCT text) AS kinds, (count(text) - count(DISTINCT text)) / count(text)::DOUBLE AS duplicate_rate, count(text) / count(*)::DOUBLE AS coverage FROM documents GROUP BY lang")
def duplicate_accept_rate(spark, sf_dir):
    return telemetry.duplicate_rate(A.table(spark, sf_dir, "documents"), "text", "lang")


@query(
    f"""WITH {A.ATTEMPTS_SQL} SELECT run_id, count(*) AS attempts, count(*) FILTER (WHERE decision = 'accepted') AS accepted, sum(total_tokens)::BIGINT AS tokens, round(sum(duration_ms), 6) AS wall_ms,
    count(*) FILTER (WHERE decision = 'accepted') / count(*)::DOUBLE AS yield, coalesce(sum(total_tokens) / nullif(count(*) FILTER (WHERE decision = 'accepted'), 0)::DOUBLE, 0) AS tokens_per_accepted, sum(total_tokens) / count(*)::DOUBLE AS tokens_per_attempt FROM attempts GROUP BY run_id"""
)
def run_benchmark(spark, sf_dir):
    return telemetry.run_summary(A.attempts(spark, sf_dir)).withColumn("wall_ms", F.round("wall_ms", 6))


@query(
    """WITH b AS (SELECT * FROM (VALUES (0, 'LOW'), (1, 'MEDIUM'), (2, 'HIGH'), (3, 'UNKNOWN')) t(place, bin)), c AS (SELECT CASE WHEN l_discount * 10 >= 0.8 THEN 'HIGH' WHEN l_discount * 10 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS bin, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT place, bin, coalesce(n, 0)::BIGINT AS n FROM b LEFT JOIN c USING (bin)"""
)
def confidence_histogram(spark, sf_dir):
    d = F.col("l_discount") * 10
    level = F.when(d >= 0.8, "HIGH").when(d >= 0.4, "MEDIUM").otherwise("LOW")
    return telemetry.histogram(A.table(spark, sf_dir, "lineitem"), level, ["LOW", "MEDIUM", "HIGH", "UNKNOWN"])


@query(f"WITH {A.ATTEMPTS_SQL} SELECT stage, max(duration_ms) AS max_ms, round(sum(duration_ms), 6) AS total_ms, CASE WHEN max(duration_ms) > 340 OR sum(duration_ms) > 300000 THEN 'WARN' ELSE 'OK' END AS state FROM attempts GROUP BY stage")
def latency_slo(spark, sf_dir):
    return telemetry.latency_slo(A.attempts(spark, sf_dir), "duration_ms", 340, 300_000, "stage").withColumn("total_ms", F.round("total_ms", 6))


@query(f"WITH {A.ATTEMPTS_SQL}, s AS (SELECT stage, count(*) AS calls, sum(total_tokens) AS tokens, avg(duration_ms) AS a, max(duration_ms) AS m FROM attempts GROUP BY stage) SELECT sum(calls)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, max(m) AS max_ms, round(sum(a * calls) / sum(calls), 6) AS avg_ms FROM s")
def combined_spend(spark, sf_dir):
    lanes = A.attempts(spark, sf_dir).groupBy("stage").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("tokens"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"))
    return telemetry.combined_spend(lanes).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"WITH {A.ATTEMPTS_SQL}, f AS (SELECT run_id, model, min(event_id) AS o FROM attempts GROUP BY ALL) SELECT run_id, string_agg(model, ',' ORDER BY o) AS models FROM f GROUP BY run_id")
def config_values_in_order(spark, sf_dir):
    found = telemetry.distinct_in_order(A.attempts(spark, sf_dir), "run_id", "model", "event_id")
    return found.select("run_id", F.array_join("found", ",").alias("models"))


@query(f"WITH {A.ATTEMPTS_SQL} SELECT stage, count(*)::BIGINT AS calls, sum(total_tokens)::BIGINT AS total_tokens FROM attempts GROUP BY stage")
def merged_usage(spark, sf_dir):
    """Two halves of the log, summed apart and merged."""
    a = A.attempts(spark, sf_dir)
    half = lambda c: a.filter(c).groupBy("stage").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("total_tokens"))
    return telemetry.merge_totals(half("event_id % 2 = 0"), half("event_id % 2 = 1"), "stage")


@query(
    f"""WITH {A.ATTEMPTS_SQL} SELECT event_id, seed, round(CASE WHEN count(*) OVER w = 5 THEN avg((decision = 'accepted')::INT) OVER w END, 9) AS window_yield FROM attempts
    WINDOW w AS (PARTITION BY seed ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
)
def rolling_yield(spark, sf_dir):
    a = A.attempts(spark, sf_dir).withColumn("ok", F.col("decision") == "accepted")
    return sequence.rolling_yield(a, "ok", ["ts", "event_id"], 5, "seed").select("event_id", "seed", F.round("window_yield", 9).alias("window_yield"))


@query(
    f"""WITH {A.ATTEMPTS_SQL}, r AS (SELECT seed, row_number() OVER w AS calls, sum((decision = 'accepted')::INT) OVER w AS accepted, sum(total_tokens) OVER w AS tokens,
      CASE WHEN count(*) OVER l = 5 THEN avg((decision = 'accepted')::INT) OVER l END AS y FROM attempts
      WINDOW w AS (PARTITION BY seed ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), l AS (PARTITION BY seed ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    f AS (SELECT *, CASE WHEN accepted >= 6 THEN 'target_total_reached' WHEN calls >= 40 THEN 'max_calls_budget_reached' WHEN tokens >= 1500 THEN 'max_tokens_budget_reached' WHEN y < 0.15 THEN 'marginal_yield_decay_threshold_reached' END AS rule FROM r)
    SELECT seed, calls, rule, accepted::BIGINT AS accepted, tokens::BIGINT AS tokens FROM f WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seed ORDER BY calls) = 1"""
)
def stop_rule_first_fire(spark, sf_dir):
    a = A.attempts(spark, sf_dir).withColumn("ok", F.col("decision") == "accepted")
    return sequence.stop_rules(a, "ok", "total_tokens", ["ts", "event_id"], "seed", 6, 40, 1500, 5, 0.15)


_NOW = "TIMESTAMP '2024-01-31'"
_SIGN = "CASE outcome WHEN 'VALID_ACCEPT' THEN 1.0 WHEN 'LOGIC_ERROR' THEN -1.5 WHEN 'DEAD_END_CHAIN' THEN -1.5 ELSE -0.5 END"
_SCORES = f"SELECT bucket, variant, round(sum({_SIGN} * pow(0.5, greatest(0, (epoch_us({_NOW}) - epoch_us(ts)) / 86400000000.0) / 30.0)), 6) AS score, count(DISTINCT CASE WHEN outcome = 'VALID_ACCEPT' THEN seed_id END) AS seeds, count(*) AS traces FROM traces GROUP BY bucket, variant"


@query(f"WITH {A.TRACES_SQL} SELECT *, seeds >= 2 AS preferred FROM ({_SCORES})")
def time_decay_score(spark, sf_dir):
    return sequence.rule_scores(A.traces(spark, sf_dir), F.lit("2024-01-31").cast("timestamp"), "bucket", "variant")


@query(f"WITH {A.TRACES_SQL}, s AS ({_SCORES}), x AS (SELECT bucket, variant, score + 500 AS score FROM s) SELECT bucket, variant, score FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY score DESC, variant) = 1")
def pareto_frontier(spark, sf_dir):
    """Best variant a bucket; scores are lifted so that some are above 0."""
    s = sequence.rule_scores(A.traces(spark, sf_dir), F.lit("2024-01-31").cast("timestamp"), "bucket", "variant")
    return sequence.frontier(s.select("bucket", "variant", (F.col("score") + 500).alias("score")), "bucket", "variant")


@query(
    f"""WITH {A.TRACES_SQL}, l AS (SELECT * FROM traces QUALIFY row_number() OVER (PARTITION BY bucket, variant ORDER BY ts DESC, event_id DESC) <= 3)
    SELECT bucket, variant, count(*) = 3 AND bool_and(outcome <> 'VALID_ACCEPT') AND count(DISTINCT seed_id) >= 2 AS dead_end FROM l GROUP BY ALL"""
)
def dead_end_last3(spark, sf_dir):
    return sequence.dead_ends(A.traces(spark, sf_dir), ["ts", "event_id"], "bucket", "variant")


@query(
    f"""WITH {A.TRACES_SQL}, t AS (SELECT *, outcome = 'VALID_ACCEPT' AS v, outcome = 'LOGIC_ERROR' AS le FROM traces), w AS (SELECT *, lag(v, 1) OVER o AS v1, lag(v, 2) OVER o AS v2, lag(seed_id, 1) OVER o AS s1, lag(seed_id, 2) OVER o AS s2 FROM t WINDOW o AS (PARTITION BY bucket, variant ORDER BY ts, event_id))
    SELECT event_id, CASE WHEN v THEN 'VALID_ACCEPT' WHEN le THEN 'LOGIC_ERROR' WHEN coalesce(NOT v1 AND NOT v2, false) AND (seed_id <> s1 OR seed_id <> s2) THEN 'DEAD_END_CHAIN' ELSE 'RETRYABLE_FAILURE' END AS outcome FROM w"""
)
def outcome_classification(spark, sf_dir):
    t = A.traces(spark, sf_dir).withColumn("valid", F.col("outcome") == "VALID_ACCEPT").withColumn("logic_error", F.col("outcome") == "LOGIC_ERROR").drop("outcome")
    return sequence.classified_outcomes(t, ["ts", "event_id"], "bucket", "variant").select("event_id", "outcome")


@query("WITH b AS (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events) SELECT * FROM b WHERE best_before IS NULL OR value > best_before")
def monotone_upsert(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    return sequence.monotone_upserts(e, "user_id", "value", ["ts", "event_id"]).select("event_id", "user_id", "value", "best_before")


@query("SELECT * FROM (SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100)")
def recent_traces(spark, sf_dir):
    """The last hundred traces of one kind; a report of that size."""
    e = A.table(spark, sf_dir, "events").filter("event_type = 'error'")
    return sequence.tail(e, ["ts", "event_id"], 100).select("event_id", "user_id", "event_type")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def bucket_examples(spark, sf_dir):
    return sequence.top_by_group(A.table(spark, sf_dir, "documents"), "source", ["doc_id"], 5).select("source", "doc_id")


_UNITS_SQL = "u AS (SELECT source, doc_id, length(text)::BIGINT AS size, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS no FROM documents)"


@query(
    f"""WITH RECURSIVE {_UNITS_SQL}, r AS (SELECT source, doc_id, size, no, 0 AS batch, 1 AS units, size AS total FROM u WHERE no = 1 UNION ALL
      SELECT u.source, u.doc_id, u.size, u.no, CASE WHEN units >= 10 OR total + u.size > 20000 THEN batch + 1 ELSE batch END, CASE WHEN units >= 10 OR total + u.size > 20000 THEN 1 ELSE units + 1 END,
        CASE WHEN units >= 10 OR total + u.size > 20000 THEN u.size ELSE total + u.size END FROM r JOIN u ON u.source = r.source AND u.no = r.no + 1) SELECT source, doc_id, size, batch FROM r"""
)
def budget_batches(spark, sf_dir):
    units = A.table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").cast("long").alias("size"))
    return budgets.budget_batches(units, "size", ["size", "doc_id"], 20_000, 10, "source")


@query(
    f"""WITH RECURSIVE {_UNITS_SQL}, r AS (SELECT source, doc_id, size, no, true AS taken, 1 AS units, size AS total FROM u WHERE no = 1 UNION ALL
      SELECT u.source, u.doc_id, u.size, u.no, units < 10 AND total + u.size <= 20000, units + (units < 10 AND total + u.size <= 20000)::INT, CASE WHEN units < 10 AND total + u.size <= 20000 THEN total + u.size ELSE total END
      FROM r JOIN u ON u.source = r.source AND u.no = r.no + 1) SELECT source, doc_id, size FROM r WHERE taken"""
)
def budget_selection(spark, sf_dir):
    units = A.table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").cast("long").alias("size"))
    return budgets.budget_selection(units, "size", ["size", "doc_id"], 20_000, 10, "source")


@query(
    f"""WITH {A.TRACES_SQL} SELECT event_id, outcome FROM (SELECT * FROM traces WHERE bucket = 'concurrency' AND variant = 'var_3' ORDER BY ts DESC, event_id DESC LIMIT 10)"""
)
def mutation_traces(spark, sf_dir):
    """The last ten traces of one bucket and variant."""
    return sequence.keyed_tail(A.traces(spark, sf_dir), {"bucket": "concurrency", "variant": "var_3"}, ["ts", "event_id"], 10).select("event_id", "outcome")


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25")
def first_seeds(spark, sf_dir):
    """The first 25 seeds of a bounded run."""
    return sequence.first_n(A.table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], 25)


@query()
def reservoir_sample(spark, sf_dir):
    """A seeded sample of fifty documents."""
    return sequence.hashed_sample(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


@query(
    f"""WITH {A.TRACES_SQL}, s AS ({_SCORES}), x AS (SELECT bucket, variant, score + 500 AS score FROM s WHERE bucket <> 'concurrency'), b AS (SELECT bucket, variant FROM x WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY score DESC, variant) = 1)
    SELECT t.event_id, t.bucket, coalesce(b.variant, 'baseline_v0') AS variant FROM traces t LEFT JOIN b USING (bucket)"""
)
def frontier_with_default(spark, sf_dir):
    t = A.traces(spark, sf_dir)
    s = sequence.rule_scores(t, F.lit("2024-01-31").cast("timestamp"), "bucket", "variant").filter("bucket <> 'concurrency'")
    best = sequence.frontier(s.select("bucket", "variant", (F.col("score") + 500).alias("score")), "bucket", "variant").select("bucket", "variant")
    return sequence.frontier_lookup(t.select("event_id", "bucket"), best, "bucket", "variant")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def hourly_stage_windows(spark, sf_dir):
    """Tumbling event-time windows, as the streaming job computes them."""
    e = A.table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")
