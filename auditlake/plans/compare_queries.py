"""Queries over two sides: suites, stages, paired statistics, reviews, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare, stats
from . import adapters as A
from .registry import query


@query(f"WITH {A.SUITES_SQL} SELECT id, CASE WHEN o.id IS NOT NULL THEN o.score ELSE b.score END AS score, CASE WHEN o.id IS NOT NULL THEN o.understandable ELSE b.understandable END AS understandable, CASE WHEN o.id IS NOT NULL THEN o.maintainable ELSE b.maintainable END AS maintainable FROM base b FULL JOIN other o USING (id)")
def suite_overlay(spark, sf_dir):
    base, other = A.suites(spark, sf_dir)
    return compare.overlay(base, other, "id")


@query(f"WITH {A.SUITES_SQL} SELECT count(*) AS tests, round(avg(score), 6) AS mean_index, round(avg(understandable), 6) AS understandable, round(avg(maintainable), 6) AS maintainable FROM base")
def suite_summary(spark, sf_dir):
    found = compare.suite_summary(A.suites(spark, sf_dir)[0], "score", "understandable", "maintainable")
    return found.select("tests", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


@query(f"WITH {A.SUITES_SQL} SELECT id, round(o.score - b.score, 6) AS delta FROM base b JOIN other o USING (id) WHERE o.score < b.score ORDER BY o.score - b.score, id LIMIT 5")
def top_regressions(spark, sf_dir):
    """The five tests that lost most."""
    base, other = A.suites(spark, sf_dir)
    found = compare.top_regressions(compare.compared(base, other.select("id", "score"), "id", "score"), 5, "id")
    return found.select("id", F.round("delta", 6).alias("delta"))


@query(
    f"""WITH {A.SUITES_SQL}, d AS (SELECT count(*) FILTER (WHERE b.score - o.score >= 2) AS dropped FROM base b JOIN other o USING (id)), s AS (
      SELECT (SELECT avg(score) FROM other) - (SELECT avg(score) FROM base) AS delta, (SELECT avg(understandable) FROM other) - (SELECT avg(understandable) FROM base) AS u,
             (SELECT avg(maintainable) FROM other) - (SELECT avg(maintainable) FROM base) AS m, (SELECT count(*) FROM other) AS tests, dropped FROM d)
    SELECT dropped, tests, dropped / tests::DOUBLE AS share, round(delta, 6) AS delta, concat_ws(',', CASE WHEN delta <= -0.25 THEN 'index_decreased' END, CASE WHEN u <= -0.5 THEN 'understandable_dropped' END,
      CASE WHEN m <= -0.5 THEN 'maintainable_dropped' END, CASE WHEN dropped >= 2 AND dropped / tests::DOUBLE > 0.05 THEN 'tests_dropped' END) AS reasons FROM s"""
)
def suite_verdict(spark, sf_dir):
    base, other = A.suites(spark, sf_dir)
    summary = lambda df, tag: compare.suite_summary(df, "score", "understandable", "maintainable").drop("tests").toDF(f"i{tag}", f"u{tag}", f"m{tag}")
    one = compare.drops(compare.compared(base, other.select("id", "score"), "id", "score"), other).crossJoin(summary(base, "1")).crossJoin(summary(other, "2"))
    delta = F.col("i2") - F.col("i1")
    why = compare.suite_verdict(delta, F.col("u2") - F.col("u1"), F.col("m2") - F.col("m1"), F.col("share"), F.col("dropped"))
    return one.select("dropped", "tests", "share", F.round(delta, 6).alias("delta"), F.array_join(why, ",").alias("reasons"))


_SIDE = "SELECT event_type AS stage, avg(value) AS v FROM events WHERE user_id % 2 = {0} AND NOT (event_type = 'signup' AND user_id % 2 = 0) GROUP BY 1"


@query(
    f"""WITH b AS ({_SIDE.format(0)}), o AS ({_SIDE.format(1)}), j AS (SELECT stage, coalesce(b.v, 0) AS baseline, coalesce(o.v, 0) AS candidate FROM b FULL JOIN o USING (stage))
    SELECT stage, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, round(candidate - baseline, 6) AS diff, round(coalesce(-(candidate - baseline) * 100 / nullif(baseline, 0), 0), 6) AS speedup_pct FROM j"""
)
def stage_deltas(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").filter("NOT (event_type = 'signup' AND user_id % 2 = 0)")
    side = lambda k: e.filter(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("stage")).agg(F.avg("value").alias("v"))
    found = compare.stage_deltas(side(0), side(1), "stage", "v")
    return found.select("stage", *(F.round(c, 6).alias(c) for c in found.columns[1:]), ).withColumn("speedup_pct", F.col("speedup_pct") + 0.0)


def _pairs(spark, sf_dir):
    """Mean event value of each user, in the first and the second half of the month."""
    e = A.table(spark, sf_dir, "events")
    side = lambda c: e.filter(c).groupBy("user_id").agg(F.avg("value").alias("v"))
    return compare.finite_pairs(side("ts < timestamp'2024-01-16'"), side("ts >= timestamp'2024-01-16'"), "user_id", "v")


_PAIRS = """b AS (SELECT user_id, avg(value) AS b FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), c AS (SELECT user_id, avg(value) AS c FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1),
d AS (SELECT user_id, b, c, c - b AS delta FROM b JOIN c USING (user_id))"""


@query(f"WITH {_PAIRS} SELECT user_id, round(b, 6) AS b, round(c, 6) AS c, round(delta, 6) AS delta FROM d")
def paired_seed_deltas(spark, sf_dir):
    return _pairs(spark, sf_dir).select("user_id", *(F.round(c, 6).alias(c) for c in ("b", "c", "delta")))


@query(f"WITH {_PAIRS} SELECT user_id % 3 AS g, count(*) AS n, round(avg(delta), 6) AS mean, round(avg(delta) - 1.96 * stddev_samp(delta) / sqrt(count(*)), 6) AS low, round(avg(delta) + 1.96 * stddev_samp(delta) / sqrt(count(*)), 6) AS high FROM d GROUP BY 1")
def t_interval_fallback(spark, sf_dir):
    found = stats.normal_interval(_pairs(spark, sf_dir).withColumn("g", F.col("user_id") % 3), "delta", "g")
    return found.select("g", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@query(
    f"""WITH {_PAIRS}, p AS (SELECT user_id % 3 AS g, delta FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY delta) AS i FROM p), w AS (SELECT a.g, (a.delta + b.delta) / 2 AS m FROM n a JOIN n b ON a.g = b.g AND a.i <= b.i)
    SELECT g, (sqrt(8 * count(*) + 1)::BIGINT - 1) // 2 AS pairs, round(median(m), 6) AS centre FROM w GROUP BY g"""
)
def hodges_lehmann(spark, sf_dir):
    found = stats.hodges_lehmann_by(_pairs(spark, sf_dir).withColumn("g", F.col("user_id") % 3), "g", "delta")
    return found.select("g", "pairs", F.round("centre", 6).alias("centre"))


@query(
    f"""WITH {_PAIRS}, p AS (SELECT round(delta, 2) AS d FROM d WHERE round(delta, 2) <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM p)
    SELECT count(*)::BIGINT AS n, sum(r) FILTER (WHERE d > 0)::DOUBLE AS w_plus, sum(r) FILTER (WHERE d < 0)::DOUBLE AS w_minus, least(sum(r) FILTER (WHERE d > 0), sum(r) FILTER (WHERE d < 0))::DOUBLE AS statistic FROM r"""
)
def wilcoxon_statistic(spark, sf_dir):
    found = stats.signed_rank_statistic(_pairs(spark, sf_dir).select(F.round("delta", 2).alias("d")), "d")
    return found.select("n", *(F.col(c).cast("double").alias(c) for c in ("w_plus", "w_minus", "statistic")))


@query(
    """WITH p AS (SELECT user_id % 12 AS metric, pow(0.5, user_id % 12) * 0.2 AS p FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY p, metric) AS rank, count(*) OVER () AS m FROM p), k AS (SELECT *, m - rank + 1 AS k FROM r)
    SELECT metric, rank::INT AS rank, round(least(1.0, max(p * k) OVER (ORDER BY rank)), 9) AS adjusted_p, min((p < 0.05 / k)::INT) OVER (ORDER BY rank) = 1 AS is_significant FROM k"""
)
def holm_step_down(spark, sf_dir):
    p = A.table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("metric")).distinct().withColumn("p", F.pow(F.lit(0.5), F.col("metric")) * 0.2)
    found = stats.holm(p, "p", "metric")
    return found.select("metric", "rank", F.round("adjusted_p", 9).alias("adjusted_p"), "is_significant")


@query()
def paired_hypothesis_tests(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    side = lambda c, name: e.filter(c).groupBy(F.col("event_type").alias("metric"), F.col("user_id").alias("key")).agg(F.avg("value").alias(name))
    pairs = side("ts < timestamp'2024-01-16'", "b").join(side("ts >= timestamp'2024-01-16'", "c"), ["metric", "key"])
    return stats.paired_tests(pairs)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY 1")
def percentile_intervals(spark, sf_dir):
    found = stats.percentile_interval(A.table(spark, sf_dir, "events"), "value", "event_type")
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("median", "low", "high")))


@query(
    """WITH r AS (SELECT 'run-' || (user_id % 10) AS run, sum((props->>'$.k')::BIGINT)::DOUBLE AS tokens, sum(value) AS wall FROM events GROUP BY 1), m AS (SELECT 'tokens' AS metric, max(tokens) FILTER (WHERE run = 'run-0') AS baseline, max(tokens) FILTER (WHERE run = 'run-1') AS candidate FROM r
      UNION ALL SELECT 'wall', max(wall) FILTER (WHERE run = 'run-0'), max(wall) FILTER (WHERE run = 'run-1') FROM r)
    SELECT metric, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, round(candidate - baseline, 6) AS diff, round((candidate - baseline) * 100 / baseline, 6) AS diff_pct FROM m"""
)
def ab_deltas(spark, sf_dir):
    runs = A.attempts(spark, sf_dir).groupBy("run_id").agg(F.sum("total_tokens").alias("tokens"), F.sum("duration_ms").alias("wall"))
    found = compare.ab_deltas(runs, "run_id", "run-0", "run-1", "tokens", "wall")
    return found.select("metric", *(F.round(c, 6).alias(c) for c in ("baseline", "candidate", "diff", "diff_pct")))


_SCORE = "((o_orderkey + {0}) % 12)"


@query(
    f"""WITH s AS (SELECT o_orderkey, {', '.join(f'{_SCORE.format(k)}::DOUBLE AS s{k}' for k in range(6))} FROM orders)
    SELECT o_orderkey, {' AND '.join(f's{k} <= 10' for k in range(6))} AS valid, CASE WHEN {' AND '.join(f's{k} <= 10' for k in range(6))} THEN round((1.5 * s0 + 1.5 * s1 + 2 * s2 + s3 + 2 * s4 + s5) / 9.0, 6) END AS value FROM s"""
)
def cqi_index(spark, sf_dir):
    names = ["readability", "maintainability", "correctness", "complexity", "security", "test_coverage"]
    review = F.struct(*(F.struct(F.expr(_SCORE.format(k)).cast("double").alias("score")).alias(n) for k, n in enumerate(names)))
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", T.cqi(review).alias("c"))
    return o.select("o_orderkey", "c.valid", F.round("c.value", 6).alias("value"))


@query(
    """WITH s AS (SELECT CASE WHEN o_orderkey % 5 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 4 = 0) AND o_orderkey % 2 = 0 THEN 'BLOCK' WHEN o_orderkey % 5 = 0 THEN 'WARN' WHEN o_orderkey % 5 = 1 THEN 'WARN' ELSE 'OK' END AS severity, o_orderkey % 1001 = 0 AS invalid FROM orders), c AS (
      SELECT count(*) FILTER (WHERE severity = 'BLOCK') AS block, count(*) FILTER (WHERE severity = 'WARN') AS warn, count(*) FILTER (WHERE severity = 'OK') AS ok, count(*) FILTER (WHERE invalid) AS invalid FROM s)
    SELECT *, warn > 10 AS warned, CASE WHEN block > 0 OR invalid > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM c"""
)
def review_verdict(spark, sf_dir):
    k = F.col("o_orderkey")
    finding = F.struct(
        F.lit("BLOCK").alias("severity"), F.when(k % 3 == 0, "Security ").otherwise("style").alias("category"), F.when(k % 4 == 0, "may crash").otherwise("naming").alias("title"),
        *(F.lit(None).cast("string").alias(c) for c in ("engineering_rationale", "engineering_consequence", "reference_principle", "recommended_action")),
        F.struct(F.lit("line").alias("location_type"), F.when(k % 2 == 0, "a.py").alias("path"), F.lit(None).cast("string").alias("details")).alias("evidence"),
        F.struct(F.lit("LOW").alias("correctness"), F.lit("NONE").alias("compatibility"), F.lit("LOW").alias("security")).alias("impact"),
    )
    given = F.when(k % 5 == 0, "BLOCK").when(k % 5 == 1, "WARN").otherwise("OK")
    o = A.table(spark, sf_dir, "orders").select(T.effective_severity(given, F.array(finding)).alias("severity"), (k % 1001 == 0).alias("invalid"))
    return compare.review_verdict(o, "severity", "invalid", 10)


@query(
    """WITH t AS (SELECT o_orderkey, 10 + o_orderkey % 50 AS s, o_orderkey % 4 AS c FROM orders)
    SELECT o_orderkey, line FROM t, unnest(range(s::BIGINT, (s + greatest(c, 1))::BIGINT)) AS u(line)"""
)
def diff_hunk_ranges(spark, sf_dir):
    k = F.col("o_orderkey")
    head = F.concat(F.lit("@@ -1 +"), (10 + k % 50).cast("string"), F.lit(","), (k % 4).cast("string"), F.lit(" @@"))
    lines = A.table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(F.array(F.lit("+++ b/src/a.py"), head, F.lit("+x"))).alias("no", "line"))
    return compare.diff_lines(lines, "o_orderkey", "no", "line").select("o_orderkey", F.col("line").cast("long").alias("line"))


@query("SELECT o_orderkey, l_linenumber * 10 AS line FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber * 10 BETWEEN o_orderkey % 30 AND o_orderkey % 30 + 25")
def range_overlap_units(spark, sf_dir):
    start = F.col("o_orderkey") % 30
    units = A.table(spark, sf_dir, "orders").select("o_orderkey", start.alias("a"), (start + 25).alias("b"))
    lines = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") * 10).alias("line"))
    return compare.range_overlaps(units, lines, "o_orderkey", "a", "b", "line").select("o_orderkey", "line")


@query("SELECT c_nationkey, count(*) AS regressions, greatest(0, 10 - 2.0 * count(*))::DOUBLE AS score FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def compatibility_index(spark, sf_dir):
    return compare.compatibility_score(A.table(spark, sf_dir, "customer").filter("c_acctbal < 0"), "c_nationkey")


@query(
    """SELECT 'f' || (p_partkey % 10) AS file_path, p_partkey::VARCHAR AS key, unnest(CASE WHEN p_partkey % 7 = 0 THEN ['deleted_function'] WHEN p_partkey % 3 = 0 THEN ['reordered'] WHEN p_partkey % 3 = 1 THEN ['kind:a', 'removed:b'] ELSE [] END) AS regression FROM part"""
)
def signature_regressions(spark, sf_dir):
    k = F.col("p_partkey")
    param = lambda name, kind, default: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), default.alias("has_default"))
    p = A.table(spark, sf_dir, "part")
    side = lambda params: p.select(F.concat(F.lit("f"), k % 10).alias("file_path"), k.cast("string").alias("key"), F.lit("function").alias("type"), params.alias("params"))
    one = F.array(param("a", "positional_or_keyword", F.lit(False)), param("b", "positional_or_keyword", F.lit(True)))
    two = F.when(k % 3 == 0, F.array(param("b", "positional_or_keyword", F.lit(True)), param("a", "positional_or_keyword", F.lit(False)))).when(k % 3 == 1, F.array(param("a", "keyword_only", F.lit(False)))).otherwise(one)
    return compare.signature_regressions(side(one), side(two).filter("cast(key as int) % 7 <> 0"))
