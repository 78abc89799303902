"""Windows, order, budgets and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .ranges import numbered


def rolling_yield(rows: DataFrame, ok: str, order: list[str], n: int, *by: str) -> DataFrame:
    """The mean of ok over the last n rows of a group, null until there are n."""
    last = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("window_yield", F.when(F.count("*").over(last) == n, F.avg(F.col(ok).cast("double")).over(last)))


def stop_rules(rows: DataFrame, ok: str, tokens: str, order: list[str], by: str, target: int, max_calls: int, max_tokens: int, n: int, least_yield: float) -> DataFrame:
    """For each group the first row at which a stop rule fires and which one; rules rank target, calls, tokens, yield."""
    upto = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rolling_yield(rows, ok, order, n, by).select(
        by, F.count("*").over(upto).alias("calls"), F.sum(F.col(ok).cast("int")).over(upto).alias("accepted"), F.sum(tokens).over(upto).alias("tokens"), "window_yield"
    )
    rule = (
        F.when(F.col("accepted") >= target, "target_total_reached").when(F.col("calls") >= max_calls, "max_calls_budget_reached")
        .when(F.col("tokens") >= max_tokens, "max_tokens_budget_reached").when(F.col("window_yield") < least_yield, "marginal_yield_decay_threshold_reached")
    )
    fired = run.withColumn("rule", rule).filter("rule IS NOT NULL")
    return fired.groupBy(by).agg(F.min(F.struct("calls", "rule", "accepted", "tokens")).alias("r")).select(by, "r.*")


def top_by_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def tail(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n rows, in order."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(n).orderBy(*order)


def first_n(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The first n rows in order: the seeds of a bounded run."""
    return rows.orderBy(*order).limit(n)


def keyed_tail(traces: DataFrame, key: dict[str, str], order: list[str], n: int) -> DataFrame:
    """The last n traces that have these values, in order."""
    for name, value in key.items():
        traces = traces.filter(F.col(name) == value)
    return tail(traces, order, n)


def fold_of(rows: DataFrame, group: str, label: str, k: int) -> DataFrame:
    """(group, rate, total, fold): groups by falling (rate, total, name), dealt round to k folds from 1."""
    found = rows.groupBy(group).agg(F.avg(F.col(label).cast("double")).alias("rate"), F.count("*").alias("total"))
    # the order is falling in all three, so places are counted from its end
    up = numbered(found, "__place", "rate", "total", group).crossJoin(F.broadcast(found.agg(F.count("*").alias("__n"))))
    return up.withColumn("fold", ((F.col("__n") - F.col("__place")) % k + 1).cast("int")).drop("__place", "__n")


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of their key: uniform, and the same on every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


# -- ledger ------------------------------------------------------------------


def rule_scores(traces: DataFrame, now: Column, *by: str) -> DataFrame:
    """Signed outcomes under time decay, and the distinct seeds that succeeded."""
    weight = T.outcome_sign("outcome") * T.time_decay(F.coalesce("evaluated_at", "observed_at"), now)
    won = F.when((F.col("outcome") == "VALID_ACCEPT") & F.col("seed_id").isNotNull(), F.col("seed_id"))
    found = traces.groupBy(*by).agg(F.round(F.sum(weight), 6).alias("score"), F.countDistinct(won).alias("seeds"), F.count("*").alias("traces"))
    return found.withColumn("preferred", F.col("seeds") >= fixed.CORROBORATION)


def frontier(scores: DataFrame, bucket: str, variant: str) -> DataFrame:
    """For each bucket its best variant, if its score is above 0; of equal scores the first by name."""
    best = scores.filter(F.col(bucket).isNotNull() & F.col(variant).isNotNull() & (F.col(variant) != "baseline_v0") & (F.col("score") > 0))
    return best.groupBy(bucket).agg(F.min_by(F.struct(variant, "score"), F.struct(-F.col("score"), F.col(variant))).alias("r")).select(bucket, "r.*")


def frontier_lookup(requests: DataFrame, best: DataFrame, bucket: str, variant: str, default: str = "baseline_v0") -> DataFrame:
    """requests with their bucket's variant or the default; best has one row a bucket, and Spark broadcasts it where it is small."""
    return requests.join(best, bucket, "left").withColumn(variant, F.coalesce(variant, F.lit(default)))


def dead_ends(traces: DataFrame, order: list, *by: str) -> DataFrame:
    """Groups whose last three traces all failed and come from two seeds at least."""
    down = [F.desc(c) for c in order]
    last = traces.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy(*down))).filter("no <= 3")
    found = last.groupBy(*by).agg(F.count("*").alias("n"), F.bool_and(F.col("outcome") != "VALID_ACCEPT").alias("failed"), F.countDistinct("seed_id").alias("seeds"))
    return found.select(*by, ((F.col("n") == 3) & F.col("failed") & (F.col("seeds") >= 2)).alias("dead_end"))


def classified_outcomes(attempts: DataFrame, order: list, *by: str) -> DataFrame:
    """attempts (valid, logic_error, seed_id) with the outcome that each has in the light of the two before it."""
    w = Window.partitionBy(*by).orderBy(*order)
    failed = ~F.col("valid")
    chain = failed & F.coalesce(F.lag(failed, 1).over(w) & F.lag(failed, 2).over(w), F.lit(False))
    seeds = F.size(F.array_distinct(F.array_compact(F.array("seed_id", F.lag("seed_id", 1).over(w), F.lag("seed_id", 2).over(w)))))
    kind = F.when(F.col("valid"), "VALID_ACCEPT").when(F.col("logic_error"), "LOGIC_ERROR").when(chain & (seeds >= 2), "DEAD_END_CHAIN").otherwise("RETRYABLE_FAILURE")
    return attempts.withColumn("outcome", kind)


def monotone_upserts(events: DataFrame, key: str, score: str, order: list) -> DataFrame:
    """The events that replace their key's entry: those strictly better than all before."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(score).over(before)
    return events.filter(F.lit(True)).withColumn("best_before", top).filter(F.col("best_before").isNull() | (F.col(score) > F.col("best_before")))
