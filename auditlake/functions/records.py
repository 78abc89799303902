"""Normalisation of polymorphic records: variants in, typed columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from . import text as T

STATES = ["PASS", "FAIL", "NOT_EXECUTED", "CHECK_FAILED"]
#: The names under which providers report token counts, in order of preference.
PROMPT_KEYS, COMPLETION_KEYS, TOTAL_KEYS = ["prompt_tokens", "input_tokens", "prompt_eval_count"], ["completion_tokens", "output_tokens", "eval_count"], ["total_tokens", "tokens"]


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, "$." + path, kind)


def as_int(v: Column, default: int = 0) -> Column:
    return F.coalesce(v.try_cast("long"), F.lit(default))


def report_given(v: Column) -> Column:
    """Whether a verifier report is a non-empty object or a string with more than white space."""
    kind = F.schema_of_variant(v)
    object_, text = kind.startswith("OBJECT<"), F.try_variant_get(v, "$", "string")
    return F.coalesce(F.when(object_, kind != "OBJECT<>").when(kind == "STRING", T.filled(text)), F.lit(False))


def usage(v: Column) -> Column:
    """struct(prompt_tokens, completion_tokens, total_tokens) of a usage variant, from the first non-zero of each count's names."""
    first = lambda keys: T.first_nonzero(*(as_int(at(v, k)) for k in keys))
    prompt, completion = first(PROMPT_KEYS), first(COMPLETION_KEYS)
    total = T.first_nonzero(*(as_int(at(v, k)) for k in TOTAL_KEYS), prompt + completion)
    return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), total.alias("total_tokens"))


def usage_with_source(response: Column, prompt_text: Column, answer_text: Column) -> Column:
    """The usage of a response variant, where it is from, and estimates where the provider gives none."""
    inner, outer = usage(F.try_variant_get(response, "$.usage", "variant")), usage(response)
    est = lambda t: F.when(T.filled(t), T.token_estimate(t)).otherwise(F.lit(0).cast("long"))
    guess = F.struct(est(prompt_text).alias("prompt_tokens"), est(answer_text).alias("completion_tokens"), (est(prompt_text) + est(answer_text)).alias("total_tokens"))
    tag = lambda u, source, has=True: F.struct(u["prompt_tokens"].alias("prompt_tokens"), u["completion_tokens"].alias("completion_tokens"), u["total_tokens"].alias("total_tokens"), F.lit(has).alias("has_usage"), F.lit(source).alias("usage_source"))
    return (
        F.when(inner["total_tokens"] > 0, tag(inner, "provider")).when(outer["total_tokens"] > 0, tag(outer, "provider_fallback"))
        .when(guess["total_tokens"] > 0, tag(guess, "estimated")).otherwise(tag(guess, "missing", False))
    )


def cost(model: Column, prompt_tokens: Column, completion_tokens: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Dollars from a price table (dollars a million prompt and completion tokens by model); 0 for unknown models."""
    if not prices:
        return F.lit(0.0)
    table = F.create_map(*(x for m, (p, c) in prices.items() for x in (F.lit(m), F.struct(F.lit(p).alias("p"), F.lit(c).alias("c")))))
    return F.coalesce((prompt_tokens * table[model]["p"] + completion_tokens * table[model]["c"]) / 1_000_000, F.lit(0.0))


def compatibility(v: Column) -> Column:
    """struct(state, compatible, score, reason, n_regressions) of a compatibility result variant, with its defaults."""
    given, state = at(v, "pass", "boolean"), at(v, "state")
    known = F.coalesce(state.isin(STATES), F.lit(False))
    ok = F.coalesce(given, F.when(known, state.isin("PASS", "NOT_EXECUTED")), F.lit(True))
    score = F.coalesce(at(v, "compatibility_index").try_cast("double"), F.when(ok, 10.0).otherwise(0.0))
    items = F.try_variant_get(v, "$.regressions", "array<string>")
    return F.struct(
        F.when(known, state).when(ok, "PASS").otherwise("FAIL").alias("state"), ok.alias("compatible"), score.alias("score"), at(v, "reason").alias("reason"),
        F.coalesce(F.size(items), F.lit(0)).alias("n_regressions"),
    )


def training_row(v: Column) -> Column:
    """struct(text, label, scenario_id) of an attempt variant; null unless it was accepted or rejected and has a predicate."""
    decision = F.lower(at(v, "decision"))
    predicate = F.coalesce(F.nullif(at(v, "predicate"), F.lit("")), F.nullif(at(v, "judge_eval.predicate"), F.lit("")))
    items = lambda path: F.try_variant_get(v, "$." + path, "array<string>")
    some = lambda a: F.when(F.size(a) > 0, F.array_join(a, " "))
    code = F.coalesce(some(items("anchors_normalized")), some(items("judge_eval.anchors")), at(v, "input_block"), F.lit(""))
    full = F.concat(F.lit(fixed.PREDICATE_PREFIX), predicate, F.lit(fixed.CODE_DELIMITER), F.substring(code, 1, 1000))
    cve = F.coalesce(F.nullif(at(v, "cve_id"), F.lit("")), at(v, "seed.cve_id"))
    row = F.struct(full.alias("text"), (decision == "accepted").cast("int").alias("label"), T.scenario_id(cve, predicate).alias("scenario_id"))
    return F.when(decision.isin("accepted", "rejected") & predicate.isNotNull(), row)


def review_unit(v: Column) -> Column:
    """A review unit's review variant: under `review`, or the unit itself in the older layout."""
    return F.coalesce(F.try_variant_get(v, "$.review", "variant"), v)


def counted_as_accepted(decision: Column, status: Column, b2_pass: Column) -> Column:
    no = F.lit(False)
    return F.coalesce(decision.isin("accepted", "accept", "pass"), no) | F.coalesce(status.isin("accepted", "pass"), no) | F.coalesce(b2_pass, no)


def source_counts(events: Column, calls: Column, missing: Column) -> Column:
    """map<source, count> of usage events, or of calls with and without usage where there are no events."""
    names = F.transform(events, lambda e: F.coalesce(e["usage_source"], F.lit("unknown")))
    by_name = F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n, F.size(F.filter(names, lambda m: m == n)))))
    kept = F.greatest(calls - missing, F.lit(0)).cast("int")
    rest = F.map_filter(F.create_map(F.lit("estimated_or_provider"), kept, F.lit("missing"), missing.cast("int")), lambda _, n: n > 0)
    return F.when(events.isNotNull(), by_name).otherwise(rest)


def run_metadata(run_id: Column, seed: Column, mode: str, now: str, models: dict[str, str], sample: Column) -> Column:
    """The control record of a row."""
    known = F.create_map(*(F.lit(x) for pair in models.items() for x in pair)) if models else F.create_map().cast("map<string,string>")
    return F.struct(run_id.alias("run_id"), seed.alias("seed"), F.lit(mode).alias("mode"), F.lit(now).alias("clock_now"), known.alias("models"), F.sha2(sample, 256).alias("sample_sha256"))
