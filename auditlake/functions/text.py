"""Row predicates and text scalars as column expressions, all JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it inside its lambdas."""
    return F.transform(F.array(value), body)[0]


def words(alternation: str, ignore_case: bool = True) -> str:
    """A pattern that finds the alternation as whole ASCII words, alike in Java and RE2."""
    return ("(?i)" if ignore_case else "") + f"(^|[^A-Za-z0-9_])({alternation})([^A-Za-z0-9_]|$)"


def literal(text: str) -> str:
    return re.sub(r"([\\.+*?\[\](){}^$|/#&~-])", r"\\\1", text)


def any_of(values: list[str]) -> str:
    return "|".join(map(literal, values))


def strip(x: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def filled(x: Column | str) -> Column:
    """Whether a string has more than white space; null has not."""
    return F.coalesce(strip(x) != "", F.lit(False))


def safe_div(a: Column, b: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(fallback))


def rate(part: Column, whole: Column) -> Column:
    """A share whose empty whole counts as one."""
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def reasons(*pairs: tuple[str, Column]) -> Column:
    """The names whose condition holds, in the order given."""
    return F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in pairs)))


# -- predicates and anchors --------------------------------------------------


def fold_predicate(x: Column | str) -> Column:
    return F.regexp_replace(strip(F.translate(_c(x), fixed.HYPHENS, "-" * len(fixed.HYPHENS))), r"\s+", " ")


def predicate_symbols(x: Column | str) -> Column:
    """Back-ticked spans, then identifiers, without stop words, in first-seen order."""
    text = _c(x)
    spans = F.regexp_extract_all(text, F.lit("`([^`]{1,64})`"), F.lit(1))
    names = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{2,63})(?![A-Za-z0-9_])"), F.lit(1))
    stop = F.array(*map(F.lit, fixed.PREDICATE_STOPWORDS))
    kept = F.filter(F.transform(F.concat(spans, names), strip), lambda s: (s != "") & ~F.array_contains(stop, F.lower(s)))
    return F.coalesce(F.array_distinct(kept), F.array().cast("array<string>"))


def code_identifiers(code: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_c(code), F.lit("([A-Za-z0-9_]+)"), F.lit(1)))


def symbol_hits(predicate: Column | str, code: Column | str) -> Column:
    """The symbols of a predicate that the code has as whole words."""
    body = F.coalesce(_c(code), F.lit(""))
    plain = lambda s: s.rlike("^[A-Za-z0-9_]+$")
    edge = lambda s: F.concat(F.lit("(^|[^A-Za-z0-9_])"), F.regexp_replace(s, r"([\\.+*?\[\](){}^$|])", r"\\$1"), F.lit("([^A-Za-z0-9_]|$)"))
    hit = lambda tokens: lambda s: F.when(plain(s), F.array_contains(tokens, s)).otherwise(F.regexp_like(body, edge(s)))
    return let(code_identifiers(body), lambda tokens: F.filter(predicate_symbols(predicate), hit(tokens)))


def predicate_quality(predicate: Column | str, code: Column | str) -> Column:
    """The reasons against a predicate; none means it passes. Null: not a string."""
    text = fold_predicate(predicate)
    found = reasons(
        ("predicate_too_short", F.length(text) < 40),
        ("predicate_contains_hedging_or_placeholder", text.rlike(words(fixed.HEDGING))),
        ("missing_vulnerability_class", ~text.rlike(words(fixed.VULNERABILITY_CLASS))),
        ("missing_code_symbol_or_grounded_term", F.size(symbol_hits(text, code)) == 0),
    )
    return F.when(_c(predicate).isNull(), F.array(F.lit("predicate_not_string"))).otherwise(found)


def validate_predicate(predicate: Column | str, code: Column | str, anchors: Column) -> Column:
    few = F.size(F.coalesce(anchors, F.array().cast("array<string>"))) < 2
    return F.concat(predicate_quality(predicate, code), reasons(("anchors_too_few", few)))


def code_signals(x: Column | str) -> dict[str, Column]:
    """The counts that code-likeness rests on."""
    text = strip(x)
    low = F.lower(text)
    count = lambda pattern, of: F.regexp_count(of, F.lit(pattern))
    has = lambda part: F.contains(low, F.lit(part)).cast("int")
    return {
        "n_chars": F.length(text),
        "markers": sum((has(m) for m in fixed.CODE_MARKERS), F.lit(0)),
        "newlines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))),
        "punctuation": F.length(text) - F.length(F.translate(text, fixed.CODE_PUNCTUATION, "")),
        "keywords": count(rf"(?<![A-Za-z0-9_])(?:{fixed.CODE_KEYWORDS})(?![A-Za-z0-9_])", low),
        "operators": count(fixed.CODE_OPERATORS, text),
        "calls": count(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*\s*\(", text),
    }


def is_code_like(x: Column | str) -> Column:
    """At least three of five signals, in 40 characters or more."""
    s = code_signals(x)
    votes = [s["markers"] >= 2, (s["newlines"] >= 2) & (s["punctuation"] >= 4), s["keywords"] >= 3, s["operators"] >= 3, s["calls"] >= 2]
    return F.coalesce((s["n_chars"] >= 40) & (sum((v.cast("int") for v in votes), F.lit(0)) >= 3), F.lit(False))


def grounded_anchors(anchors: Column | str, text: Column | str) -> Column:
    """Trimmed anchors that the text has verbatim, once each, in order."""
    body = F.coalesce(_c(text), F.lit(""))
    return F.array_distinct(F.filter(F.transform(_c(anchors), strip), lambda a: (a != "") & F.contains(body, a)))


def anchor_stats(anchors: Column | str, text: Column | str) -> Column:
    items, body = F.coalesce(_c(anchors), F.array().cast("array<string>")), F.coalesce(_c(text), F.lit(""))
    hits = F.filter(items, lambda a: filled(a) & F.contains(body, a))
    return F.struct(F.size(items).alias("total"), F.size(hits).alias("matched"), ((F.size(items) > 0) & (F.size(items) == F.size(hits))).alias("all_match"), hits.alias("hits"))


def is_generic_anchor(x: Column | str) -> Column:
    """Whether an anchor names no code: blank, or one of the generic phrases."""
    return ~filled(x) | F.coalesce(F.lower(_c(x)).rlike("|".join(fixed.GENERIC_ANCHOR)), F.lit(False))


def anchor_matches(anchor: Column, text: Column, ignore_case: bool = True) -> Column:
    a, t = (F.lower(anchor), F.lower(text)) if ignore_case else (anchor, text)
    return filled(anchor) & filled(text) & F.coalesce(F.contains(t, a), F.lit(False))


def code_tokens(x: Column | str) -> Column:
    stop = F.array(*map(F.lit, fixed.CODE_STOPWORDS))
    found = F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda t: ~F.array_contains(stop, F.lower(t)))


def operation_anchors(anchors: Column | str) -> Column:
    return F.filter(F.coalesce(_c(anchors), F.array().cast("array<string>")), lambda a: filled(a) & a.rlike(r"[(.=]|->"))


def fallback_hits(anchors: Column | str, mechanism: Column | str) -> Column:
    """Anchors whose identifiers stand in the mechanism as a span, or two of them anywhere."""
    body = _c(mechanism)
    parts = lambda a: F.regexp_extract_all(a, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    given = F.coalesce(_c(anchors), F.array().cast("array<string>"))
    hit = lambda tokens: lambda a: (F.size(parts(a)) >= 2) & (F.contains(body, F.array_join(F.slice(parts(a), 1, 8), " ")) | (F.size(F.array_intersect(parts(a), tokens)) >= 2))
    return let(F.array_distinct(parts(body)), lambda tokens: F.filter(given, hit(tokens)))


def mechanism_evidence(mechanism: Column | str, text: Column | str, anchors: Column | str) -> Column:
    body = _c(mechanism)
    token = F.exists(code_tokens(text), lambda t: F.contains(body, t))
    operation = F.exists(operation_anchors(anchors), lambda a: F.contains(body, a)) | (F.size(fallback_hits(anchors, mechanism)) > 0)
    safe = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(safe(token).alias("has_code_token"), safe(operation).alias("has_operation_anchor"), (safe(token) & safe(operation)).alias("pass"))


def mechanism_template(mechanism: Column | str, anchors: Column | str) -> Column:
    body, low = _c(mechanism), F.lower(_c(mechanism))
    labels = [F.contains(low, F.lit(x)) for x in fixed.MECHANISM_LABELS]
    hit = F.exists(F.coalesce(_c(anchors), F.array().cast("array<string>")), lambda a: (a != "") & F.contains(body, a))
    return F.coalesce(filled(body) & labels[0] & labels[1] & labels[2] & hit, F.lit(False))


def con_win_evidence(winner: Column | str, reason: Column | str, mechanism: Column | str, anchors: Column | str) -> Column:
    both = F.concat(F.coalesce(_c(reason), F.lit("")), F.lit("\n"), F.coalesce(_c(mechanism), F.lit("")))
    guard = F.lower(both).rlike(any_of(fixed.GUARD_TERMS))
    named = F.exists(F.coalesce(_c(anchors), F.array().cast("array<string>")), lambda a: (a != "") & F.contains(both, a))
    return F.when(_c(winner).eqNullSafe("con_debater"), guard & named).otherwise(F.lit(True))


def mechanism_grounded(mechanism: Column | str, anchors: Column | str) -> Column:
    return F.exists(F.coalesce(_c(anchors), F.array().cast("array<string>")), lambda a: filled(a) & F.coalesce(F.contains(_c(mechanism), a), F.lit(False)))


def first_gate_failure(predicate, code, mechanism, anchors, winner, reason) -> Column:
    """The first gate that a judged sample fails, or null."""
    evidence = mechanism_evidence(mechanism, code, anchors)
    proof = evidence["has_code_token"] & (mechanism_grounded(mechanism, anchors) | evidence["has_operation_anchor"])
    return F.coalesce(
        F.when(F.size(predicate_quality(predicate, code)) > 0, "predicate_quality_failed"),
        F.when(F.size(F.coalesce(_c(anchors), F.array().cast("array<string>"))) < 2, "anchors_too_few_after_normalization"),
        F.when(~proof, "mechanism_evidence_failed"),
        F.when(~mechanism_template(mechanism, anchors), "mechanism_template_failed"),
        F.when(~con_win_evidence(winner, reason, mechanism, anchors), "con_win_without_counter_evidence"),
    )


def verifier_gate(winner: Column, passed: Column, logic_error: Column, has_report: Column) -> Column:
    """The verifier's reason against a sample that passed the gates, or null. A missing report passes."""
    failed = F.when(filled(logic_error), "verifier_logic_error").otherwise("verifier_failed")
    return F.when(winner.eqNullSafe("con_debater"), "con_win_not_applicable").when(has_report & ~F.coalesce(passed, F.lit(False)), failed)


# -- identities, cascade, taxonomy -------------------------------------------


def scenario_id(cve: Column | str, predicate: Column | str) -> Column:
    given = F.upper(strip(_c(cve).cast("string")))
    found = F.upper(F.regexp_extract(_c(predicate), fixed.CVE, 0))
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(found, F.lit("")), F.concat(F.lit("HASH-"), F.substring(F.sha2(_c(predicate), 256), 1, 10)))


def combined_text(predicate: Column | str, code: Column | str) -> Column:
    p, d = _c(predicate), fixed.CODE_DELIMITER
    at = F.instr(p, d)
    head, tail = F.substring(p, F.lit(1), at - 1), F.substring(p, at + len(d), F.lit(1000))
    given = p.startswith(fixed.PREDICATE_PREFIX) & (at > 0)
    plain = F.concat(F.lit(fixed.PREDICATE_PREFIX), p, F.lit(d), F.substring(F.coalesce(_c(code), F.lit("")), 1, 1000))
    return F.when(given, F.concat(head, F.lit(d), tail)).otherwise(plain)


def heuristic_score(predicate: Column | str, code: Column | str) -> Column:
    """0.01, 0.99 or null where the rules leave it open."""
    text, body = strip(F.coalesce(_c(predicate), F.lit(""))), strip(F.coalesce(_c(code), F.lit("")))
    short = ~text.rlike(r"\S") | (~F.contains(text, F.lit("\n")) & (F.length(text) < 15))
    return (
        F.when(short, 0.01)
        .when((body != "") & ~body.rlike(words(fixed.CODE_TOKEN)), 0.01)
        .when(text.rlike(words(fixed.HEURISTIC_POSITIVE)), 0.99)
    )


def cascade(predicate, code, attempt: Column, model_b: Column, model_c: Column) -> Column:
    """struct(accept, probability, stage) of the staged pre-filter; null model scores are models not there."""
    rule = heuristic_score(predicate, code)
    out = lambda accept, p, stage: F.struct(accept.alias("accept"), p.cast("double").alias("probability"), F.lit(stage).alias("stage"))
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(rule.isNotNull(), out(rule >= 0.9, rule, "heuristic"))
        .when(F.coalesce(attempt, F.lit(1)).isin(0, 1), out(yes, F.lit(1.0), "initial_seed_pass"))
        .when(model_b >= fixed.MODEL_B_HIGH, out(yes, model_b, "xgboost"))
        .when(model_b <= fixed.MODEL_B_LOW, out(no, model_b, "xgboost"))
        .when(model_c.isNotNull(), out(model_c >= fixed.MODEL_C_ACCEPT, model_c, "setfit"))
        .otherwise(out(yes, F.lit(1.0), "default_pass"))
    )


def taxonomy(predicate: Column | str) -> Column:
    low, out = F.lower(_c(predicate)), F
    for bucket, keywords in fixed.TAXONOMY.items():
        out = out.when(low.rlike(any_of(keywords)), bucket)
    return out.otherwise("input_validation")


def outcome_sign(outcome: Column | str) -> Column:
    out = F
    for name, sign in fixed.OUTCOME_SIGNS.items():
        out = out.when(_c(outcome) == name, sign)
    return out.otherwise(fixed.OTHER_OUTCOME_SIGN)


def time_decay(observed: Column, evaluated: Column, half_life_days: float = fixed.HALF_LIFE_DAYS) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_micros(evaluated.cast("timestamp")) - F.unix_micros(observed.cast("timestamp"))) / 86_400_000_000.0)
    return F.lit(1.0) if half_life_days <= 0 else F.pow(F.lit(0.5), age / half_life_days)


def timestamp_or(x: Column, clock: Column) -> Column:
    """An ISO time, or the clock where it is missing or illegible."""
    return F.coalesce(F.try_to_timestamp(F.nullif(strip(x), F.lit(""))), clock.cast("timestamp"))


# -- confidence, scores, review units ----------------------------------------


def _level(x: Column) -> Column:
    v = F.when(x > 5, x / 100).when(x > 1, x / 5).otherwise(x)
    return F.when(F.isnan(v), "MEDIUM").when(v >= 0.8, "HIGH").when(v >= 0.4, "MEDIUM").otherwise("LOW")


def confidence(x: Column | str, unknown: str = "MEDIUM") -> Column:
    """HIGH, MEDIUM or LOW of a word, number, percentage or fraction; `unknown` for anything else."""
    v = F.upper(strip(x))
    number = lambda s: F.expr("1").cast("double") * s.try_cast("double")
    finite = lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    percent = number(F.regexp_replace(v, "%$", ""))
    parts = F.split(v, "/")
    top, bottom = number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))
    ratio = F.when((F.size(parts) == 2) & finite(top) & finite(bottom) & (F.abs(bottom) > 1e-9), top / bottom)
    return (
        F.when(v.isin(fixed.HIGH_WORDS), "HIGH").when(v.isin(fixed.MEDIUM_WORDS), "MEDIUM").when(v.isin(fixed.LOW_WORDS), "LOW")
        .when(v.endswith("%"), F.when(finite(percent), _level(F.least(F.greatest(percent / 100, F.lit(0.0)), F.lit(1.0)))).otherwise(unknown))
        .when(F.contains(v, F.lit("/")), F.when(ratio.isNotNull(), _level(ratio)).otherwise(unknown))
        .when(finite(number(v)), _level(number(v)))
        .otherwise(unknown)
    )


def rescaled_score(x: Column) -> Column:
    """0 to 10 as it is, up to 100 divided by ten, else null."""
    return F.when((x >= 0) & (x <= 10), x).when((x > 10) & (x <= 100), x / 10)


def evidence_path(x: Column | str) -> Column:
    return F.regexp_replace(strip(x), "^/+", "")


def prune_lines(x: Column | str, most: int = 100) -> Column:
    """Head and tail of a text of more than `most` lines, with a marker between."""
    text = F.coalesce(_c(x), F.lit(""))
    lines = F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")
    keep = most // 2
    cut = F.concat(
        F.array_join(F.slice(lines, 1, keep), "\n"), F.lit("\n... ["), (F.size(lines) - 2 * keep).cast("string"),
        F.lit(" lines truncated for context efficiency] ...\n"), F.array_join(F.slice(lines, -keep, keep), "\n"),
    )
    return F.when((text != "") & (F.size(lines) > most), cut).otherwise(text)


def token_estimate(x: Column | str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(_c(x), F.lit(""))) / 4.0)).cast("long")


def unit_token_estimate(x: Column | str, overhead: int = 100) -> Column:
    return (F.floor(F.length(prune_lines(x)) / 4.0) + overhead).cast("long")


def cqi(review: Column) -> Column:
    """struct(valid, value, error_code) of the weighted quality index of a struct with one scored struct a dimension."""
    scores = {name: review[name]["score"].cast("double") for name in fixed.CQI_WEIGHTS}
    total = sum((s * w for (name, s), w in zip(scores.items(), fixed.CQI_WEIGHTS.values())), F.lit(0.0)) / sum(fixed.CQI_WEIGHTS.values())
    code = F.when(review.isNull(), "MISSING_REVIEW")
    for name, s in scores.items():
        code = code.when(review[name].isNull(), "MISSING_DIMENSION").when(review[name]["score"].isNull(), "MISSING_SCORE")
        code = code.when(s.isNull() | ~s.between(0, 10), "INVALID_SCORE")
    return F.struct(code.isNull().alias("valid"), F.when(code.isNull(), total).alias("value"), code.alias("error_code"))


def gateable_block(finding: Column) -> Column:
    """Whether a BLOCK finding has evidence and a blocking category, impact or keyword."""
    evidence, impact = finding["evidence"], finding["impact"]
    proof = filled(evidence["location_type"]) & (filled(evidence["path"]) | filled(evidence["details"]))
    hurt = [impact[d].isin("MEDIUM", "HIGH") for d in ("correctness", "compatibility", "security")]
    said = F.lower(F.concat_ws(" ", *(finding[f] for f in ("title", "category", "engineering_rationale", "engineering_consequence", "reference_principle", "recommended_action"))))
    grave = F.lower(strip(finding["category"])).isin(fixed.BLOCKING_CATEGORIES)
    safe = lambda c: F.coalesce(c, F.lit(False))
    return safe(finding["severity"] == "BLOCK") & safe(proof) & (safe(grave) | safe(hurt[0]) | safe(hurt[1]) | safe(hurt[2]) | safe(said.rlike(any_of(fixed.BLOCKING_KEYWORDS))))


def effective_severity(severity: Column, findings: Column) -> Column:
    backed = F.coalesce(F.exists(findings, gateable_block), F.lit(False))
    return F.when((severity == "BLOCK") & ~backed, "WARN").when(severity.isin("OK", "WARN", "BLOCK"), severity).otherwise("OK")


# -- seeds, code, misc -------------------------------------------------------


def matches_language(language: Column | str, wanted: str) -> Column:
    return F.coalesce(F.array_contains(F.split(F.lower(strip(language)), "[,/ \t]+"), F.lit(wanted.lower())), F.lit(False))


def snippet_rejection(code: Column | str, duplicate: Column) -> Column:
    body, n = _c(code), F.length(_c(code))
    return F.when(~filled(body), "empty_code").when(n < 50, "too_short").when(n > 12000, "too_long").when(duplicate, "duplicate")


def normalized_code(x: Column | str) -> Column:
    plain = F.regexp_replace(F.regexp_replace(_c(x), "//[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    return F.lower(F.regexp_replace(plain, r"\s+", ""))


def spans(x: Column | str) -> Column:
    """Back-ticked spans, or else the parts between colons."""
    ticked = F.regexp_extract_all(_c(x), F.lit("`([^`]+)`"), F.lit(1))
    return F.when(F.size(ticked) > 0, ticked).otherwise(F.filter(F.transform(F.split(_c(x), ":"), strip), lambda s: s != ""))


def valid_anchor(anchor: Column, code: Column | str) -> Column:
    clean = F.btrim(anchor, F.lit(" `\"'.,;:"))
    return F.coalesce((clean != "") & F.contains(_c(code), clean) & ~is_generic_anchor(clean), F.lit(False))


def harvested_anchors(texts: Column, code: Column | str, existing: Column | None = None) -> Column:
    """Anchors given, then spans, then identifiers of evidence texts, as far as the code has them."""
    none = F.array().cast("array<string>")
    given = F.filter(F.coalesce(existing, none) if existing is not None else none, lambda a: valid_anchor(a, code))
    cut = F.flatten(F.transform(texts, lambda t: F.transform(spans(t), lambda s: F.btrim(s, F.lit(" `\"'.,;:")))))
    names = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit("(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1))))
    stop = F.array(*map(F.lit, fixed.PREDICATE_STOPWORDS))
    fit = lambda tokens: lambda s: ~F.array_contains(stop, F.lower(s)) & ~is_generic_anchor(s) & F.array_contains(tokens, s)
    known = let(code_identifiers(code), lambda tokens: F.filter(names, fit(tokens)))
    return F.array_distinct(F.concat(given, F.filter(cut, lambda s: valid_anchor(s, code)), known))


def truthy(x: Column | str) -> Column:
    return F.coalesce(F.lower(strip(x)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def phase_at_least(phase: Column | str, required: str) -> Column:
    ranks = F.create_map(*(F.lit(x) for pair in fixed.PHASE_ORDER.items() for x in pair))
    return F.coalesce(ranks[_c(phase)] >= fixed.PHASE_ORDER[required], F.lit(False))


def drifted_keys(found: Column | str, expected: Column | str) -> Column:
    """The keys of the expected control map whose value is another in the found one."""
    return F.array_sort(F.map_keys(F.map_filter(_c(expected), lambda k, v: ~_c(found)[k].eqNullSafe(v))))


def anchor_in_code(anchor: Column, code: Column) -> Column:
    edge = F.concat(F.lit("(?i)(^|[^A-Za-z0-9_])"), F.regexp_replace(anchor, r"([\\.+*?\[\](){}^$|])", r"\\$1"), F.lit("([^A-Za-z0-9_]|$)"))
    return F.coalesce(F.regexp_like(code, edge), F.lit(False))


def html_cell(x: Column | str) -> Column:
    out = _c(x)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|"), ("\n", " ")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def format_conversions(x: Column | str) -> Column:
    """printf conversions, %% aside."""
    return F.size(F.filter(F.regexp_extract_all(_c(x), F.lit(fixed.FORMAT_CONVERSION), F.lit(1)), lambda m: m != "%%"))


def request_hash(request: Column) -> Column:
    """A digest of a map of request fields without credentials and transport settings, keys in order."""
    kept = F.map_filter(request, lambda k, _: ~k.isin("api_key", "base_url", "timeout", "api_base"))
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), 256)


def effective_config(base: Column, overrides: Column, model: Column) -> Column:
    """The base map overlaid by every override whose key is part of the model's name, in key order."""
    fitting = F.filter(F.array_sort(F.map_keys(overrides)), lambda k: F.contains(F.lower(model), F.lower(k)))
    over = lambda acc, more: F.map_concat(F.map_filter(acc, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more)
    return F.aggregate(fitting, base, lambda acc, k: over(acc, overrides[k]))


def first_nonzero(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in columns), F.lit(0))


def is_test_path(x: Column | str) -> Column:
    return F.coalesce(_c(x).rlike(r"(^|/)test_[^/]*\.py$|_test\.py$"), F.lit(False))


def is_source_path(x: Column | str) -> Column:
    return F.coalesce(_c(x).endswith(".py") & ~is_test_path(x), F.lit(False))


def repair_directive(bucket: Column, **fields: Column) -> Column:
    """The directive for a failure bucket with its placeholders filled."""
    out = F
    for name, template in fixed.REPAIR_TEMPLATES.items():
        out = out.when(bucket == name, template)
    out = out.otherwise(fixed.REPAIR_DEFAULT)
    for name, default in fixed.REPAIR_FILLERS.items():
        value = F.coalesce(F.nullif(fields[name], F.lit("")), F.lit(default)) if name in fields else F.lit(default)
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def word_shingles(x: Column | str, k: int = 5) -> Column:
    """Distinct k-token shingles; with fewer tokens the whole sequence."""
    def of(tokens: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))
        few = F.when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(tokens) >= k, F.array_distinct(many)).otherwise(few)

    return let(F.regexp_extract_all(F.lower(_c(x)), F.lit("([A-Za-z0-9_]+)"), F.lit(1)), of)
