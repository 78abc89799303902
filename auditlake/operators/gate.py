"""The offline quality gate: corpus and attempt counters, rates, threshold checks and invariants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


@dataclass(frozen=True)
class Thresholds:
    min_accepted_rows: int = 1
    max_unsupported: float = 0.05
    max_inconclusive: float = 0.20
    min_anchor_match: float = 0.80
    min_verifier_pass: float = 0.0
    min_parse_ok: float = 0.0
    max_logic_error: float = 0.0
    max_cost_per_accepted: float | None = None
    max_tokens_per_accepted: float | None = None

    def __post_init__(self) -> None:
        if self.min_accepted_rows < 1:
            raise ValueError("min_accepted_rows must be at least 1")


def judged_rows(corpus: DataFrame, min_anchors: int = 2, ignore_case: bool = True) -> DataFrame:
    """corpus (input, predicate, anchors, counterfactual, verifier_report, support_level) with missing, matched, generic, failure.

    Required fields come first; a row without them is not accepted and its anchors do not count.
    """
    missing = T.reasons(
        ("output.predicate", ~T.filled("predicate")),
        ("output.anchors", F.col("anchors").isNull()),
        ("output.counterfactual", ~T.filled("counterfactual")),
        ("output.verifier_report", ~T.filled("verifier_report")),
        ("output.support_level", ~T.filled("support_level")),
        ("output.support_level(valid)", ~F.coalesce(F.col("support_level").isin(fixed.SUPPORT_LEVELS), F.lit(False))),
    )
    anchors = F.coalesce("anchors", F.array().cast("array<string>"))
    enough = F.size(anchors) >= min_anchors
    hit = F.exists(anchors, lambda a: T.anchor_matches(a, F.col("input"), ignore_case))
    out = corpus.withColumn("missing", missing).withColumn("accepted", F.size("missing") == 0)
    return out.select(
        "*",
        (F.col("accepted") & enough & hit).alias("matched"),
        F.when(F.col("accepted"), F.size(F.filter(anchors, T.is_generic_anchor))).otherwise(0).alias("generic"),
        F.when(F.col("accepted"), F.size(anchors)).otherwise(0).alias("items"),
        F.when(~F.col("accepted"), "missing_required_fields").when(~enough, "anchors_too_few").when(~hit, "no_anchor_matches_input").alias("failure"),
    )


def _count(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def corpus_metrics(judged: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of the corpus side, for all rows or for each group."""
    level = F.col("support_level")
    found = judged.groupBy(*by).agg(
        F.count("*").alias("total_rows"),
        _count(F.col("accepted"), "accepted_rows"),
        _count(F.col("accepted") & (level == "unsupported"), "unsupported"),
        _count(F.col("accepted") & (level == "inconclusive"), "inconclusive"),
        _count(F.col("matched"), "anchors_with_match"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("anchor_items"),
        F.coalesce(F.sum("generic"), F.lit(0)).alias("generic_items"),
        _count(F.col("failure").isNotNull(), "failures"),
    )
    return found.select(
        "*",
        T.safe_div(F.col("accepted_rows"), F.col("total_rows")).alias("completeness_rate"),
        T.rate(F.col("unsupported"), F.col("accepted_rows")).alias("unsupported_rate"),
        T.rate(F.col("inconclusive"), F.col("accepted_rows")).alias("inconclusive_rate"),
        T.rate(F.col("anchors_with_match"), F.col("accepted_rows")).alias("anchor_match_rate"),
        T.rate(F.col("generic_items"), F.col("anchor_items")).alias("generic_fraction"),
    )


def attempt_metrics(attempts: DataFrame, *by: str) -> DataFrame:
    """Conditional counters over attempts and their rates.

    attempts: decision, reject_reason, support_level, called, parse_ok, passes_audit (three-valued), winner, judged, logic_error, total_tokens, cost.
    """
    c = F.col
    accepted, called, parsed = c("decision") == "accepted", c("called"), c("parse_ok")
    strict = c("judged") | accepted
    found = attempts.groupBy(*by).agg(
        F.count("*").alias("attempts"),
        _count(accepted, "accepted"),
        _count(c("support_level") == "unsupported", "unsupported"),
        _count(c("support_level") == "inconclusive", "inconclusive"),
        _count(called, "called"),
        _count(parsed, "parse_ok"),
        _count(c("passes_audit"), "passed"),
        _count(c("winner") == "pro_debater", "pro_wins"),
        _count((c("winner") == "pro_debater") & called, "called_on_pro_win"),
        _count(accepted & ~(F.coalesce(called, F.lit(False)) & F.coalesce(parsed, F.lit(False))), "accepted_unverified"),
        _count(accepted & T.filled("logic_error"), "accepted_logic_errors"),
        _count((c("reject_reason") == "anchors_no_match") & c("passes_audit"), "passed_but_unmatched"),
        _count(strict, "strict_total"),
        _count(strict & c("reject_reason").isin(fixed.STRICT_REASONS), "strict_failures"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost"),
    )
    return found.select(
        "*",
        T.rate(c("unsupported"), c("attempts")).alias("unsupported_attempt_rate"),
        T.rate(c("inconclusive"), c("attempts")).alias("inconclusive_attempt_rate"),
        T.rate(c("called"), c("attempts")).alias("called_rate"),
        T.rate(c("called_on_pro_win"), c("pro_wins")).alias("called_on_pro_win_rate"),
        T.rate(c("parse_ok"), c("called")).alias("parse_ok_rate"),
        T.rate(c("passed"), c("parse_ok")).alias("pass_rate"),
        T.rate(c("accepted_logic_errors"), c("accepted")).alias("logic_error_rate"),
        T.rate(c("strict_failures"), c("strict_total")).alias("strict_fail_rate"),
        T.rate(c("total_tokens"), c("accepted")).alias("tokens_per_accepted"),
        T.rate(c("total_tokens"), c("attempts")).alias("tokens_per_attempt"),
        T.rate(c("total_cost"), c("accepted")).alias("cost_per_accepted"),
    )


def verdict(metrics: DataFrame, limits: Thresholds = Thresholds(), with_attempts: bool = False) -> DataFrame:
    """metrics (of corpus_metrics, joined with attempt_metrics where with_attempts) with checks, violations and the final pass."""
    c = F.col
    if with_attempts:
        checks = {
            "max_unsupported": c("unsupported_attempt_rate") <= limits.max_unsupported,
            "max_inconclusive": c("inconclusive_attempt_rate") <= limits.max_inconclusive,
            "min_anchor_match": c("strict_fail_rate") <= 1.0 - limits.min_anchor_match,
            "min_verifier_pass": c("pass_rate") >= limits.min_verifier_pass,
            "min_parse_ok": c("parse_ok_rate") >= limits.min_parse_ok,
            "max_logic_error": c("logic_error_rate") <= limits.max_logic_error,
        }
        if limits.max_cost_per_accepted is not None:
            checks["max_cost_per_accepted"] = c("cost_per_accepted") <= limits.max_cost_per_accepted
        if limits.max_tokens_per_accepted is not None:
            checks["max_tokens_per_accepted"] = c("tokens_per_accepted") <= limits.max_tokens_per_accepted
    else:
        checks = {
            "max_unsupported": c("unsupported_rate") <= limits.max_unsupported,
            "max_inconclusive": c("inconclusive_rate") <= limits.max_inconclusive,
            "min_anchor_match": c("anchor_match_rate") >= limits.min_anchor_match,
        }
    pairs = [("zero_yield", c("accepted_rows") < limits.min_accepted_rows), ("anchor_match", c("anchor_match_rate") < limits.min_anchor_match)]
    if with_attempts:
        pairs += [("logic_error", c("logic_error_rate") > limits.max_logic_error), ("parse_ok", c("parse_ok_rate") < limits.min_parse_ok)]
    out = metrics.withColumn("checks", F.create_map(*(x for name, ok in checks.items() for x in (F.lit(name), ok)))).withColumn("violations", T.reasons(*pairs))
    return out.withColumn("pass", F.forall(F.map_values("checks"), lambda ok: ok) & (c("failures") == 0) & (F.size("violations") == 0))
