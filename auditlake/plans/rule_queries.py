"""Queries over the single rules of the judge's gates, review fields, records and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, records
from ..functions import text as T
from ..operators import audit, compare, dedup, review, telemetry
from . import adapters as A
from .registry import query

_NO_STOPWORD = f"NOT list_contains({fixed.CODE_STOPWORDS}, lower(t))"
_CODE_TOKENS = f"list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}')), lambda t: {_NO_STOPWORD})"


@query(f"WITH c AS (SELECT doc_id, list_sort({_CODE_TOKENS}) AS t FROM documents) SELECT doc_id, len(t)::INT AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha FROM c")
def code_token_sets(spark, sf_dir):
    t = F.array_sort(T.code_tokens("text"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("tokens_sha"))


# a judged sample a document: anchors, a mechanism of four kinds, a winner and a reason
_W1, _W2 = "split_part(text, ' ', 1)", "split_part(text, ' ', 2)"
_MECHANISM = f"""CASE WHEN doc_id % 4 = 0 THEN concat('source anchor: ', {_W1}, '( sink anchor: b missing guard anchor: c') WHEN doc_id % 4 = 1 THEN concat({_W2}, ' only')
  WHEN doc_id % 4 = 2 THEN '' ELSE concat('Source Anchor: no such thing; SINK ANCHOR: y; missing guard anchor: ', {_W1}, ' ', {_W2}) END"""
_PREDICATE = f"concat('Buffer overflow reached   through the symbol ', {_W1}, CASE WHEN doc_id % 5 = 0 THEN ' may be suspected' ELSE ' in this code path' END)"
_WINNER = "CASE WHEN doc_id % 3 = 0 THEN 'con_debater' ELSE 'pro_debater' END"
_REASON = f"CASE WHEN doc_id % 2 = 0 THEN concat('a Null Check of ', {_W2}) ELSE 'plain' END"
_GUARDS, _HEDGE, _VULN = T.any_of(fixed.GUARD_TERMS), T.words(fixed.HEDGING), T.words(fixed.VULNERABILITY_CLASS)
_LABELS = " AND ".join(f"contains(lower(mechanism), '{x}')" for x in fixed.MECHANISM_LABELS)
_PARTS = "regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]*')"
_SAMPLES_SQL = f"""
samples AS (
  SELECT doc_id, text, {_MECHANISM} AS mechanism, {_WINNER} AS winner, {_REASON} AS reason, trim(regexp_replace({_PREDICATE}, '\\s+', ' ', 'g')) AS p,
         CASE WHEN doc_id % 7 = 0 THEN [{_W1} || '('] ELSE [{_W1} || '(', 'no such = thing', {_W2}] END AS anchors
  FROM documents
), facts AS (
  SELECT *, list_filter(anchors, lambda a: trim(a) <> '' AND regexp_matches(a, '[(.=]|->')) AS operations,
         list_filter(anchors, lambda a: len({_PARTS.format('a')}) >= 2 AND (contains(mechanism, array_to_string({_PARTS.format('a')}[1:8], ' '))
           OR len(list_distinct(list_intersect({_PARTS.format('a')}, {_PARTS.format('mechanism')}))) >= 2)) AS fallback,
         len(list_filter({_CODE_TOKENS}, lambda t: contains(mechanism, t))) > 0 AS has_token,
         len(list_filter(anchors, lambda a: a <> '' AND contains(mechanism, a))) > 0 AS named,
         len(list_filter(anchors, lambda a: trim(a) <> '' AND contains(mechanism, a))) > 0 AS grounded,
         len(list_filter(anchors, lambda a: a <> '' AND contains(reason || chr(10) || mechanism, a))) > 0 AS named_anywhere,
         list_filter(list_distinct(regexp_extract_all(p, '[A-Za-z0-9_]+')), lambda w: regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]{{2,63}}$') AND NOT list_contains({fixed.PREDICATE_STOPWORDS}, lower(w))) AS symbols
  FROM samples
), gates AS (
  SELECT *, len(list_filter(operations, lambda a: contains(mechanism, a))) > 0 OR len(fallback) > 0 AS has_operation,
         trim(mechanism) <> '' AND {_LABELS} AND named AS template,
         CASE WHEN winner = 'con_debater' THEN regexp_matches(lower(reason || chr(10) || mechanism), '{_GUARDS}') AND named_anywhere ELSE true END AS con_win,
         length(p) >= 40 AND NOT regexp_matches(p, '{_HEDGE}') AND regexp_matches(p, '{_VULN}') AND list_has_any(symbols, list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS quality
  FROM facts
)"""


def _samples(spark, sf_dir):
    first, second = F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))
    call = F.concat(first, F.lit("("))
    anchors = F.when(F.col("doc_id") % 7 == 0, F.array(call)).otherwise(F.array(call, F.lit("no such = thing"), second))
    named = {"mechanism": _MECHANISM, "winner": _WINNER, "reason": _REASON, "predicate": _PREDICATE}
    return A.table(spark, sf_dir, "documents").select("doc_id", "text", anchors.alias("anchors"), *(F.expr(e).alias(c) for c, e in named.items()))


@query(f"WITH {_SAMPLES_SQL} SELECT doc_id, len(operations)::INT AS n_operations, len(fallback)::INT AS n_fallback, has_token, has_operation, template, con_win, grounded FROM gates")
def mechanism_gates(spark, sf_dir):
    """The evidence, template, counter-evidence and grounding checks, each for itself."""
    found = _samples(spark, sf_dir).withColumn("e", T.mechanism_evidence("mechanism", "text", "anchors"))
    return found.select(
        "doc_id", F.size(T.operation_anchors("anchors")).alias("n_operations"), F.size(T.fallback_hits("anchors", "mechanism")).alias("n_fallback"),
        F.col("e.has_code_token").alias("has_token"), F.col("e.has_operation_anchor").alias("has_operation"), T.mechanism_template("mechanism", "anchors").alias("template"),
        T.con_win_evidence("winner", "reason", "mechanism", "anchors").alias("con_win"), T.mechanism_grounded("mechanism", "anchors").alias("grounded"),
    )


@query(
    f"""WITH {_SAMPLES_SQL} SELECT doc_id, CASE WHEN NOT quality THEN 'predicate_quality_failed' WHEN len(anchors) < 2 THEN 'anchors_too_few_after_normalization'
      WHEN NOT (has_token AND (grounded OR has_operation)) THEN 'mechanism_evidence_failed' WHEN NOT template THEN 'mechanism_template_failed' WHEN NOT con_win THEN 'con_win_without_counter_evidence' END AS failure,
      CASE WHEN winner = 'con_debater' THEN 'con_win_not_applicable' WHEN doc_id % 4 <> 1 AND NOT coalesce(quality_label = 1, false) THEN CASE WHEN doc_id % 8 = 2 THEN 'verifier_logic_error' ELSE 'verifier_failed' END END AS verifier
    FROM (SELECT g.*, l.quality AS quality_label FROM gates g LEFT JOIN labels l USING (doc_id))"""
)
def first_gate_failures(spark, sf_dir):
    """The first gate that each judged sample fails, and the verifier's reason."""
    s = _samples(spark, sf_dir).join(A.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    error = F.when(F.col("doc_id") % 8 == 2, "contradiction").otherwise(" ")
    return s.select(
        "doc_id", T.first_gate_failure("predicate", "text", "mechanism", "anchors", "winner", "reason").alias("failure"),
        T.verifier_gate(F.col("winner"), F.col("quality") == 1, error, F.col("doc_id") % 4 != 1).alias("verifier"),
    )


@query(
    f"""WITH {_SAMPLES_SQL} SELECT doc_id, array_to_string(list_filter([CASE WHEN length(p) < 40 THEN 'predicate_too_short' END, CASE WHEN regexp_matches(p, '{_HEDGE}') THEN 'predicate_contains_hedging_or_placeholder' END,
      CASE WHEN NOT regexp_matches(p, '{_VULN}') THEN 'missing_vulnerability_class' END, CASE WHEN NOT list_has_any(symbols, list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+'))) THEN 'missing_code_symbol_or_grounded_term' END,
      CASE WHEN len(anchors) < 2 THEN 'anchors_too_few' END], lambda r: r IS NOT NULL), ',') AS reasons FROM gates"""
)
def predicate_validation(spark, sf_dir):
    return _samples(spark, sf_dir).select("doc_id", F.array_join(T.validate_predicate("predicate", "text", F.col("anchors")), ",").alias("reasons"))


# values of many shapes, one an order
_SHAPES = {
    "flag": "CASE WHEN o_orderkey % 5 = 0 THEN ' YES ' WHEN o_orderkey % 5 = 1 THEN '0' WHEN o_orderkey % 5 = 2 THEN 'on' WHEN o_orderkey % 5 = 3 THEN NULL ELSE 'no' END",
    "path": "CASE WHEN o_orderkey % 4 = 0 THEN 'src/test_a.py' WHEN o_orderkey % 4 = 1 THEN 'pkg/a_test.py' WHEN o_orderkey % 4 = 2 THEN ' //test_dir/a.py' ELSE 'a.txt' END",
    "cell": "concat('<b>&|', o_orderpriority, '>')",
    "clock": "CASE WHEN o_orderkey % 3 = 0 THEN '2024-01-02T03:04:05' WHEN o_orderkey % 3 = 1 THEN ' ' ELSE 'not a time' END",
    "anchor": "CASE WHEN o_orderkey % 4 = 0 THEN concat('`', o_orderpriority, '`,') WHEN o_orderkey % 4 = 1 THEN 'missing' WHEN o_orderkey % 4 = 2 THEN ' .' ELSE 'absent' END",
    "evidence": "CASE WHEN o_orderkey % 2 = 0 THEN concat('see `', o_orderpriority, '` and `c d`') ELSE ' x: y ::z' END",
    "owner": "CASE WHEN o_orderkey % 2 = 0 THEN 'Tests' END",
}
_SHAPES_SQL = "shapes AS (SELECT o_orderkey AS k, o_orderdate, o_orderpriority AS priority, " + ", ".join(f"{e} AS {c}" for c, e in _SHAPES.items()) + " FROM orders)"


def _shapes(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate", F.col("o_orderpriority").alias("priority"), *(F.expr(e).alias(c) for c, e in _SHAPES.items()))


@query(
    rf"""WITH {_SHAPES_SQL} SELECT k, coalesce(lower(trim(flag)) IN ('1', 'true', 'yes', 'y', 'on'), false) AS truthy, regexp_replace(trim(path), '^/+', '') AS evidence_path,
      regexp_matches(path, '(^|/)test_[^/]*\.py$|_test\.py$') AS test_path, path LIKE '%.py' AND NOT regexp_matches(path, '(^|/)test_[^/]*\.py$|_test\.py$') AS source_path,
      replace(replace(replace(replace(cell, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\|') AS cell, epoch(coalesce(try_cast(nullif(trim(clock), '') AS TIMESTAMP), o_orderdate::TIMESTAMP))::BIGINT AS at,
      concat_ws('::', path, owner, 'm') AS unit_name FROM shapes"""
)
def field_rules(spark, sf_dir):
    """Flags, paths, table cells, clocks and unit names."""
    return _shapes(spark, sf_dir).select(
        "k", T.truthy("flag").alias("truthy"), T.evidence_path("path").alias("evidence_path"), T.is_test_path("path").alias("test_path"), T.is_source_path("path").alias("source_path"),
        T.html_cell("cell").alias("cell"), F.unix_seconds(T.timestamp_or(F.col("clock"), F.col("o_orderdate"))).alias("at"), review.unit_name(F.col("path"), F.col("owner"), F.lit("m")).alias("unit_name"),
    )


_CLEAN = "trim(anchor, ' `\"''.,;:')"


@query(
    f"""WITH {_SHAPES_SQL} SELECT k, {_CLEAN} <> '' AND contains('x ' || priority, {_CLEAN}) AND k % 4 <> 1 AS valid, regexp_matches('x ' || priority, '(^|[^A-Za-z0-9_])' || split_part(priority, '-', 2) || '([^A-Za-z0-9_]|$)') AS whole_word,
      CASE WHEN k % 2 = 0 THEN priority || '|c d' ELSE 'x|y|z' END AS spans FROM shapes"""
)
def anchor_rules(spark, sf_dir):
    """Valid anchors, whole words in code and the spans of evidence."""
    code = F.concat(F.lit("x "), F.col("priority"))
    return _shapes(spark, sf_dir).select(
        "k", T.valid_anchor(F.col("anchor"), code).alias("valid"), T.anchor_in_code(F.lower(F.split_part("priority", F.lit("-"), F.lit(2))), code).alias("whole_word"),
        F.array_join(T.spans("evidence"), "|").alias("spans"),
    )


@query("""SELECT o_orderkey, sha256('{"model":"m' || (o_orderkey % 3) || '","temperature":"' || o_orderstatus || '"}') AS request_hash FROM orders""")
def request_hashes(spark, sf_dir):
    """Digests of requests, credentials and transport settings aside."""
    fields = F.create_map(
        F.lit("temperature"), F.col("o_orderstatus"), F.lit("api_key"), F.col("o_orderpriority"), F.lit("model"), F.concat(F.lit("m"), F.col("o_orderkey") % 3), F.lit("timeout"), F.col("o_orderkey").cast("string")
    )
    return A.table(spark, sf_dir, "orders").select("o_orderkey", T.request_hash(fields).alias("request_hash"))


_BLOCKING = ", ".join(f"'{c}'" for c in fixed.BLOCKING_CATEGORIES)
_FINDING = {
    "severity": "CASE WHEN o_orderkey % 6 = 5 THEN 'WARN' WHEN o_orderkey % 11 = 0 THEN 'ODD' ELSE 'BLOCK' END",
    "category": "CASE WHEN o_orderkey % 5 = 0 THEN ' Security ' ELSE 'style' END",
    "title": "CASE WHEN o_orderkey % 7 = 0 THEN 'A possible Crash here' ELSE 'naming' END",
    "hurt": "CASE WHEN o_orderkey % 9 = 0 THEN 'HIGH' ELSE 'LOW' END",
    "kind": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'file' END",
    "details": "CASE WHEN o_orderkey % 8 = 1 THEN ' ' ELSE 'line 3' END",
}


@query(
    f"""WITH f AS (SELECT o_orderkey AS k, {', '.join(f'{e} AS {c}' for c, e in _FINDING.items())} FROM orders), g AS (SELECT *, severity = 'BLOCK' AND kind <> '' AND trim(details) <> ''
      AND (lower(trim(category)) IN ({_BLOCKING}) OR hurt IN ('MEDIUM', 'HIGH') OR regexp_matches(lower(title || ' ' || category), '{T.any_of(fixed.BLOCKING_KEYWORDS)}')) AS gateable FROM f)
    SELECT k, gateable, CASE WHEN severity = 'BLOCK' AND NOT gateable THEN 'WARN' WHEN severity IN ('OK', 'WARN', 'BLOCK') THEN severity ELSE 'OK' END AS effective FROM g"""
)
def gateable_findings(spark, sf_dir):
    """Whether a blocking finding may block, and the severity that is left of it."""
    f = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), *(F.expr(e).alias(c) for c, e in _FINDING.items()))
    none = F.lit(None).cast("string")
    finding = F.struct(
        "severity", "category", "title", F.struct(F.col("kind").alias("location_type"), none.alias("path"), "details").alias("evidence"),
        F.struct(F.lit("LOW").alias("correctness"), F.col("hurt").alias("compatibility"), none.alias("security")).alias("impact"),
        *(none.alias(c) for c in ("engineering_rationale", "engineering_consequence", "reference_principle", "recommended_action")),
    )
    return f.select("k", T.gateable_block(finding).alias("gateable"), T.effective_severity(F.col("severity"), F.array(finding)).alias("effective"))


@query(
    """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey ELSE 0 END AS n, o_orderkey % 4 IN (0, 1) AS reported, CASE WHEN o_orderkey % 4 = 0 THEN '3' WHEN o_orderkey % 4 = 1 THEN '4' END AS score,
      o_orderstatus = 'F' OR o_orderkey % 5 = 0 OR coalesce(o_orderkey % 7 = 0, false) AS accepted FROM orders"""
)
def record_rules(spark, sf_dir):
    """Numbers, reports and reviews of records of several layouts."""
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit('{"n": "'), k, F.lit('", "report": {"a": 1}, "review": {"score": "3"}}'))).when(k % 4 == 1, F.concat(F.lit('{"n": '), k, F.lit(', "report": "said", "score": "4"}')))
        .when(k % 4 == 2, '{"n": "x", "report": {}}').otherwise('{"n": null, "report": "  "}')
    )
    v = F.try_parse_json(raw)
    decision, status = F.when(F.col("o_orderstatus") == "F", "accept").otherwise("no"), F.when(k % 5 == 0, "pass")
    return A.table(spark, sf_dir, "orders").select(
        k.alias("k"), records.as_int(records.at(v, "n")).alias("n"), records.report_given(F.try_variant_get(v, "$.report", "variant")).alias("reported"),
        records.at(records.review_unit(v), "score").alias("score"), records.counted_as_accepted(decision, status, k % 7 == 0).alias("accepted"),
    )


@query("SELECT event_type AS key, count(*) AS calls, sum((props->>'$.k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY 1")
def stage_map_totals(spark, sf_dir):
    """Sums by key of maps of counters."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = A.table(spark, sf_dir, "events").select(F.create_map("event_type", F.struct(F.lit(1).alias("calls"), k.alias("tokens"))).alias("m"))
    return telemetry.map_totals(e, "m", "calls", "tokens")


@query("SELECT count(*) FILTER (WHERE o_orderkey % 7 = 0) AS failed, count(*) AS items, count(*) FILTER (WHERE o_orderkey % 3 <> 0) AS empty, CASE WHEN bool_or(o_orderkey % 7 = 0) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM orders")
def batch_report(spark, sf_dir):
    """A batch's failures, its empty summaries and the verdict over its lanes."""
    k = F.col("o_orderkey")
    o = A.table(spark, sf_dir, "orders").select(
        F.when(k % 7 == 0, "error").otherwise("done").alias("status"), F.when(k % 3 == 0, "said").when(k % 3 == 1, " ").alias("summary"), (k % 7 == 0).alias("failed")
    )
    lanes = compare.unified_verdict(o, "failed")
    return audit.batch_failures(o).crossJoin(review.empty_summaries(o, "summary")).crossJoin(lanes)


@query("SELECT p_partkey, (8 * (p_size % 11) + 28)::DOUBLE / 8 AS test_index FROM part")
def test_indices(spark, sf_dir):
    """The mean of a test's eight property scores."""
    scores = F.struct(*(F.struct((F.col("p_size") % 11 + k).alias("score")).alias(p) for k, p in enumerate(fixed.SCORE_PROPERTIES)))
    return A.table(spark, sf_dir, "part").select("p_partkey", review.test_index(scores).alias("test_index"))


test_indices.__test__ = False


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unseen_rows(spark, sf_dir):
    """Documents that no label names: what a resumed run has still to do."""
    return dedup.unseen(A.table(spark, sf_dir, "documents").select("doc_id", "lang"), A.table(spark, sf_dir, "labels"), "doc_id")


@query(
    """WITH t AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'Predicate: p' || doc_id || ' | Code: ' || text WHEN doc_id % 3 = 1 THEN 'Predicate: none' ELSE source END AS p FROM documents)
    SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN 'Predicate: p' || doc_id || ' | Code: ' || substr(text, 1, 1000) ELSE 'Predicate: ' || p || ' | Code: ' || substr(text, 1, 1000) END) AS combined_sha FROM t"""
)
def combined_texts(spark, sf_dir):
    """Classifier inputs; their code parts are cut at 1000 characters by definition."""
    k = F.col("doc_id")
    p = F.when(k % 3 == 0, F.concat(F.lit("Predicate: p"), k, F.lit(" | Code: "), F.col("text"))).when(k % 3 == 1, "Predicate: none").otherwise(F.col("source"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.combined_text(p, "text"), 256).alias("combined_sha"))


_KEYED = "lower(regexp_replace(regexp_replace(regexp_replace(text, '//[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '\\s+', '', 'g'))"


@query(
    f"""WITH d AS (SELECT doc_id, text, {_KEYED} AS k FROM documents UNION ALL SELECT doc_id + 1000000, text || ' one more word', {_KEYED} || 'onemoreword' FROM documents WHERE doc_id % 7 = 0
        UNION ALL SELECT doc_id + 2000000, replace(text, ' ', '  '), {_KEYED} FROM documents WHERE doc_id % 10 = 0),
    known AS (SELECT * FROM d WHERE doc_id % 2 = 0 AND doc_id < 1000000), r AS (SELECT * FROM d WHERE NOT (doc_id % 2 = 0 AND doc_id < 1000000)),
    t AS (SELECT DISTINCT k, NOT in_known AS is_new FROM (SELECT k, false AS in_known FROM r UNION ALL SELECT k, true FROM known)),
    w AS (SELECT k, is_new, regexp_extract_all(k, '[A-Za-z0-9_]+') AS w FROM t),
    s AS (SELECT DISTINCT k, is_new, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
    n AS (SELECT k, is_new, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT a.k AS new_k, b.k AS old_k, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.is_new AND NOT b.is_new GROUP BY ALL),
    near AS (SELECT DISTINCT new_k FROM p JOIN n x ON x.k = new_k AND x.is_new JOIN n y ON y.k = old_k AND NOT y.is_new WHERE c / (x.n + y.n - c)::DOUBLE > 0.85)
    SELECT doc_id, CASE WHEN text IN (SELECT text FROM known) THEN 'exact' WHEN k IN (SELECT k FROM known) THEN 'normalized' WHEN k IN (SELECT new_k FROM near) THEN 'near' END AS tier FROM r"""
)
def duplicate_tiers(spark, sf_dir):
    """Snippets that repeat known ones, and by which tier; some are known texts with words more, or with wider spaces."""
    d = A.table(spark, sf_dir, "documents")
    more = d.filter("doc_id % 7 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.concat("text", F.lit(" one more word")).alias("text"))
    wide = d.filter("doc_id % 10 = 0").select((F.col("doc_id") + 2000000).alias("doc_id"), F.replace("text", F.lit(" "), F.lit("  ")).alias("text"))
    rows = d.select("doc_id", "text").filter("doc_id % 2 <> 0").unionByName(more).unionByName(wide)
    return dedup.duplicate_tiers(rows, "doc_id", "text", d.filter("doc_id % 2 = 0"), "text").select("doc_id", "tier")


@query(
    """WITH a AS (SELECT user_id, event_id, (props->>'$.k')::BIGINT AS k FROM events) SELECT user_id, bool_or(k % 50 = 0) AS invalid_json_detected, sum(k % 3)::BIGINT AS repair_attempts, bool_or(k % 40 = 1) AS repair_succeeded,
      arg_max(k % 4, event_id) AS validation_retries, arg_max(k % 9 = 0, event_id) AS final_failure, arg_max('r' || k, event_id) FILTER (WHERE k % 5 = 0) AS failure_reason FROM a GROUP BY user_id"""
)
def merged_diagnostics(spark, sf_dir):
    """Structured-output diagnostics of each user's attempts put together."""
    k = F.get_json_object("props", "$.k").cast("long")
    a = A.table(spark, sf_dir, "events").select(
        "user_id", "event_id", (k % 50 == 0).alias("invalid_json_detected"), (k % 3).alias("repair_attempts"), (k % 40 == 1).alias("repair_succeeded"), (k % 4).alias("validation_retries"),
        (k % 9 == 0).alias("final_failure"), F.when(k % 5 == 0, F.concat(F.lit("r"), k)).when(k % 5 == 1, "").alias("failure_reason"),
    )
    return review.merged_diagnostics(a, "user_id", "event_id")


@query("SELECT 'f' || (p_partkey % 10) AS file_path, p_partkey::VARCHAR AS key, 'deleted_function' AS regression FROM part WHERE p_partkey % 10 IN (3, 8)")
def deleted_files(spark, sf_dir):
    """The symbols of files that are gone."""
    k = F.col("p_partkey")
    base = A.table(spark, sf_dir, "part").select(F.concat(F.lit("f"), k % 10).alias("file_path"), k.cast("string").alias("key"), F.lit("function").alias("type"))
    return compare.deleted_file_regressions(base, base.filter("file_path NOT IN ('f3', 'f8')"))


@query(
    """WITH u AS (SELECT o_orderkey AS id, o_orderkey % 5 AS f, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 100 END AS a, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 100 + 9 END AS b FROM orders)
    SELECT id FROM u WHERE a IS NULL OR b IS NULL OR EXISTS (SELECT 1 FROM (SELECT unnest([0, 2]) AS f, unnest([10, 50]) AS low, unnest([20, 55]) AS high) c WHERE c.f = u.f AND a <= high AND b >= low)"""
)
def touched_units(spark, sf_dir):
    """Units that changed lines meet, and those without line numbers."""
    k = F.col("o_orderkey")
    units = A.table(spark, sf_dir, "orders").select(
        k.alias("id"), F.concat(F.lit("f"), k % 5).alias("file_path"), F.when(k % 4 != 0, k % 100).alias("start"), F.when(k % 6 != 0, k % 100 + 9).alias("end")
    )
    changed = spark.createDataFrame([("f0", 10, 20), ("f2", 50, 55)], "file_path string, low long, high long")
    return compare.touched_units(units, changed).select("id")
