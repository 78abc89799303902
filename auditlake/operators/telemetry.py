"""Usage telemetry: stage breakdowns, percentiles, rollups, cohorts, refinement chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranges import running


def stage_breakdown(events: DataFrame, stage: str = "stage", duration: str = "duration_ms", *sums: str) -> DataFrame:
    """For each stage with a positive duration: calls, mean, exact p50, p95 and p99, extremes, and sums of other columns."""
    d = F.when(F.col(duration) > 0, F.col(duration))
    p = F.percentile(d, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    found = events.groupBy(stage).agg(
        F.count(d).alias("calls"), F.avg(d).alias("avg_ms"), p.alias("p"), F.min(d).alias("min_ms"), F.max(d).alias("max_ms"), *(F.sum(s).alias(s) for s in sums)
    )
    cut = [F.col("p")[k].alias(name) for k, name in enumerate(("p50_ms", "p95_ms", "p99_ms"))]
    return found.filter("calls > 0").select(stage, "calls", "avg_ms", *cut, "min_ms", "max_ms", *sums)


def nearest_rank(events: DataFrame, value: str, share: float, *by: str) -> DataFrame:
    """The element at floor(share * n), the last at most, of each group's sorted values; by counts, not by collecting groups."""
    counted = events.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    place = F.least(F.floor(F.col("c_all") * share), F.col("c_all") - 1)
    ranked = running(counted, value, ["c"], by).withColumn("place", place)
    return ranked.filter("c_upto > place AND c_upto - c <= place").select(*by, F.col(value).alias("value"), F.col("c_all").alias("n"))


def usage_rollup(events: DataFrame, stage: str, model: str, *sums: str) -> DataFrame:
    """Totals, totals by stage and totals by model in one pass of grouping sets. level: total, stage or model."""
    spark = events.sparkSession
    added = ", ".join(f"sum({s}) AS {s}" for s in sums)
    level = f"CASE grouping_id() WHEN 3 THEN 'total' WHEN 1 THEN 'stage' ELSE 'model' END AS level"
    return spark.sql(
        f"SELECT {level}, {stage} AS stage, {model} AS model, count(*) AS calls, {added} FROM {{events}} GROUP BY GROUPING SETS ((), ({stage}), ({model}))",
        events=events,
    )


def map_totals(rows: DataFrame, column: str, *fields: str) -> DataFrame:
    """Keywise sums of a map of structs."""
    return rows.select(F.explode(column).alias("key", "v")).groupBy("key").agg(*(F.sum(F.col("v")[f]).alias(f) for f in fields))


def merge_totals(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keywise addition of two summaries."""
    sums = [c for c in left.columns if c not in keys]
    return left.unionByName(right, allowMissingColumns=True).groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums))


def distinct_in_order(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """For each key its distinct values in the order of their first appearance."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias("found"))


def cache_rates(spans: DataFrame, hit: str, *by: str) -> DataFrame:
    c = F.col(hit)
    found = spans.groupBy(*by).agg(F.count_if(c.eqNullSafe(True)).alias("hits"), F.count_if(c.eqNullSafe(False)).alias("misses"))
    return found.withColumn("hit_rate_pct", T.safe_div(F.col("hits") * 100.0, F.col("hits") + F.col("misses")))


def tokens_per_accept(attempts: DataFrame, cohort: Column) -> DataFrame:
    """Tokens of each run for an accepted attempt, averaged over the runs of a cohort; runs without either do not count."""
    runs = attempts.groupBy("run_id").agg(F.sum("total_tokens").alias("tokens"), F.count_if(F.col("decision") == "accepted").alias("accepted"))
    runs = runs.filter("tokens > 0 AND accepted > 0").withColumn("cohort", cohort)
    return runs.filter("cohort IS NOT NULL").groupBy("cohort").agg(F.avg(F.col("tokens") / F.col("accepted")).alias("tokens_per_accept"), F.count("*").alias("runs"))


def reduction(cohorts: DataFrame, baseline: str, adapted: str) -> DataFrame:
    """The reduction in percent between two rows of tokens_per_accept; zeros where one is missing."""
    pick = lambda name: F.max(F.when(F.col("cohort") == name, F.col("tokens_per_accept")))
    both = cohorts.agg(pick(baseline).alias("b"), pick(adapted).alias("a"))
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    zero = F.lit(0.0)
    return both.select(
        F.when(whole, F.col("b")).otherwise(zero).alias("baseline"), F.when(whole, F.col("a")).otherwise(zero).alias("adapted"),
        F.when(whole, (F.col("b") - F.col("a")) / F.greatest(F.col("b"), F.lit(1.0)) * 100.0).otherwise(zero).alias("reduction_pct"),
    )


def refinement(attempts: DataFrame, order: list[str]) -> DataFrame:
    """Chains of (run_id, seed) of more than one attempt, and those of which a later attempt was accepted."""
    number = F.row_number().over(Window.partitionBy("run_id", "seed").orderBy(*order))
    later = (F.col("no") > 1) & (F.col("decision") == "accepted")
    chains = attempts.withColumn("no", number).groupBy("run_id", "seed").agg(F.count("*").alias("n"), F.max(later).alias("won")).filter("n > 1")
    found = chains.agg(F.count("*").alias("candidates"), F.count_if("won").alias("successes"))
    share = T.safe_div(F.col("successes"), F.col("candidates"))
    return found.select("*", share.alias("uptake"), (share * 0.5).alias("triage_gain"))


def duplicate_rate(rows: DataFrame, identity: str, *by: str) -> DataFrame:
    """(n - distinct) / n, and the share of rows that have an identity."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(identity).alias("known"), F.countDistinct(identity).alias("kinds"))
    return found.select("*", T.safe_div(F.col("known") - F.col("kinds"), F.col("known")).alias("duplicate_rate"), T.safe_div(F.col("known"), F.col("n")).alias("coverage"))


def run_summary(attempts: DataFrame) -> DataFrame:
    """For each run its yield, tokens per accepted row and attempt, and wall clock."""
    found = attempts.groupBy("run_id").agg(
        F.count("*").alias("attempts"), F.count_if(F.col("decision") == "accepted").alias("accepted"), F.sum("total_tokens").alias("tokens"), F.sum("duration_ms").alias("wall_ms")
    )
    return found.select(
        "*", T.safe_div(F.col("accepted"), F.col("attempts")).alias("yield"), T.safe_div(F.col("tokens"), F.col("accepted")).alias("tokens_per_accepted"),
        T.safe_div(F.col("tokens"), F.col("attempts")).alias("tokens_per_attempt"),
    )


def histogram(rows: DataFrame, value: Column, bins: list[str], name: str = "bin") -> DataFrame:
    """Counts for all of a fixed list of bins, empty ones too."""
    spark = rows.sparkSession
    frame = spark.createDataFrame([(k, b) for k, b in enumerate(bins)], f"place int, {name} string")
    counts = rows.groupBy(value.alias(name)).agg(F.count("*").alias("n"))
    return frame.join(counts, name, "left").select("place", name, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def reason_counts(rows: DataFrame, reasons: str) -> DataFrame:
    return rows.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def combined_spend(lanes: DataFrame) -> DataFrame:
    """Lanes (calls, tokens, avg_ms, max_ms) as one: sums, the largest, and the mean weighted by calls."""
    return lanes.agg(
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.max("max_ms").alias("max_ms"),
        T.safe_div(F.sum(F.col("avg_ms") * F.col("calls")), F.sum("calls")).alias("avg_ms"),
    )


def latency_slo(calls: DataFrame, duration: str, max_call_ms: float = 30_000, max_total_ms: float = 300_000, *by: str) -> DataFrame:
    found = calls.groupBy(*by).agg(F.max(duration).alias("max_ms"), F.sum(duration).alias("total_ms"))
    slow = (F.col("max_ms") > max_call_ms) | (F.col("total_ms") > max_total_ms)
    return found.withColumn("state", F.when(F.col("max_ms").isNotNull(), F.when(slow, "WARN").otherwise("OK")))
