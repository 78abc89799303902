"""The acceptance audit, swarm metrics, prompt variants and batch manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .ranges import numbered


def invariants(metrics: DataFrame) -> DataFrame:
    """(id, name, passed): nine rows from one of metrics.

    metrics: accepted, logic_errors, anchor_match_rate, strict_fail_rate, parse_ok_rate, leaks, reduction_pct, duplicate_rate, identity_coverage,
    parse_coverage, signature_coverage, uptake, triage_gain.
    """
    c = F.col
    tests = [
        ("no logic errors", (c("logic_errors") == 0) & (c("accepted") >= 1)),
        ("anchors grounded", (c("anchor_match_rate") >= fixed.ANCHOR_MATCH_MIN) & (c("strict_fail_rate") <= fixed.STRICT_FAIL_MAX)),
        ("verifier parses", c("parse_ok_rate") >= fixed.PARSE_OK_MIN),
        ("folds leak nothing", c("leaks") == 0),
        ("fewer tokens", c("reduction_pct") >= fixed.TOKEN_REDUCTION_MIN),
        ("few duplicates", (c("accepted") > 0) & (c("identity_coverage") >= 1.0) & (c("duplicate_rate") <= fixed.DUPLICATE_MAX)),
        ("graphs cover", (c("parse_coverage") >= fixed.PARSE_COVERAGE_MIN) & (c("signature_coverage") >= fixed.SIGNATURE_COVERAGE_MIN)),
        ("refinement helps", c("uptake") >= fixed.UPTAKE_MIN),
        ("triage gains", c("triage_gain") >= fixed.TRIAGE_GAIN_MIN),
    ]
    rows = F.array(*(F.struct(F.lit(f"INV-{k}").alias("id"), F.lit(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("passed")) for k, (name, ok) in enumerate(tests, 1)))
    return metrics.select(F.explode(rows).alias("r")).select("r.*")


def anchor_rates(attempts: DataFrame, total: str, matched: str, *by: str) -> DataFrame:
    """The share of matched anchors, and of attempts with any unmatched one."""
    found = attempts.groupBy(*by).agg(F.sum(total).alias("total"), F.sum(matched).alias("matched"), F.count("*").alias("n"), F.count_if(F.col(matched) < F.col(total)).alias("short"))
    return found.select(*by, T.safe_div(F.col("matched"), F.col("total")).alias("anchor_match_rate"), T.safe_div(F.col("short"), F.col("n")).alias("strict_fail_rate"))


# -- swarm metrics, as columns ---------------------------------------------------


def accepts_per_million(accepts: Column, tokens: Column) -> Column:
    return F.when((tokens > 0) & (accepts > 0), accepts / tokens * 1_000_000).otherwise(0.0)


def tokens_per_accept(accepts: Column, tokens: Column) -> Column:
    return F.when(accepts > 0, F.try_divide(tokens.cast("double"), accepts.cast("double"))).otherwise(float("inf"))


def relative_improvement(baseline: Column, candidate: Column) -> Column:
    """Null without a baseline to improve on; -1 where the candidate accepts nothing."""
    infinite = lambda x: x == float("inf")
    return F.when((baseline > 0) & ~infinite(baseline), F.when(infinite(candidate), -1.0).otherwise((baseline - candidate) / baseline))


def canonical_identity(scenario: Column, family: Column, signature: Column) -> Column:
    return F.concat_ws("\x1f", T.strip(scenario), F.upper(T.strip(family)), F.lower(T.strip(signature)))


def contradictions(passed_unmatched: Column, accepted_unverified: Column) -> Column:
    return F.greatest(passed_unmatched, F.lit(0)) + F.greatest(accepted_unverified, F.lit(0))


def triage_gain(doomed: Column, doomed_baseline: Column) -> Column:
    return F.when(doomed_baseline > 0, 1.0 - doomed / doomed_baseline)


def yield_route(accepts: Column, baseline_accepts: Column, per_million: Column, precision: Column, gaming_free: Column, logic_error: Column) -> Column:
    viable = F.when(baseline_accepts > 0, accepts >= baseline_accepts * fixed.VIABLE_SHARE).otherwise(per_million >= fixed.VIABLE_RATE)
    return (
        F.when(logic_error | ~gaming_free, "REJECTED_ANTI_GAMING_INVARIANT").when(viable, "PRIMARY_ACCEPTANCE_GATE")
        .when(precision >= fixed.ADVISORY_PRECISION, "SECONDARY_ADVISORY_TRIAGE_LANE").otherwise("REJECTED_LOW_PRECISION_AND_YIELD")
    )


# -- prompts and batches -----------------------------------------------------------


def prompt_variant(prompt: Column, bucket: Column, directive: Column, dead_ends: Column) -> Column:
    """struct(prompt, variant_id): the prompt with its repair directive and at most three dead ends."""
    some = F.slice(F.coalesce(dead_ends, F.array().cast("array<string>")), 1, 3)
    clause = F.when(F.size(some) > 0, F.concat(F.lit("\n\n[Active Negative Constraints]\n"), F.array_join(F.transform(some, lambda d: F.concat(F.lit("- DO NOT "), d)), "\n"))).otherwise("")
    full = T.strip(F.concat(prompt, F.lit("\n\n[Topological Repair Directive - "), bucket, F.lit("]\n"), directive, clause))
    return F.struct(full.alias("prompt"), F.concat(F.lit("var_"), F.sha2(full, 256)).alias("variant_id"))


def success_probability(score: Column) -> Column:
    return F.round(1.0 / (1.0 + F.exp(-score)), 4)


def with_constraint(known: Column, constraint: Column) -> Column:
    """A list of constraints with one more, unless it has it already."""
    return F.array_union(F.coalesce(known, F.array().cast("array<string>")), F.array(constraint))


def item_seeds(items: DataFrame, order: str, base: int) -> DataFrame:
    """items with item_seed, base and the place in order, numbered in parallel; no two items share their order."""
    return numbered(items, "__place", order).withColumn("item_seed", (F.col("__place") - 1 + base).cast("int")).drop("__place")


def batch_failures(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_if(F.col("status") == "error").alias("failed"), F.count("*").alias("items"))


def model_rates(rows: DataFrame, model: str, decision: str) -> DataFrame:
    """Each model's accepted and grounded share."""
    found = rows.groupBy(model).agg(F.count("*").alias("n"), F.count_if(F.col(decision) == "accepted").alias("accepted"))
    return found.withColumn("accept_rate", T.safe_div(F.col("accepted"), F.col("n")))
