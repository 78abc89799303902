"""Queries over row predicates, text scalars and the quality gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, parsing
from ..functions import text as T
from ..operators import dedup, gate
from . import adapters as A
from .registry import query

_METRICS = """
  count(*) AS total_rows, count(*) FILTER (WHERE accepted) AS accepted_rows,
  count(*) FILTER (WHERE accepted AND support_level = 'unsupported') AS unsupported, count(*) FILTER (WHERE accepted AND support_level = 'inconclusive') AS inconclusive,
  count(*) FILTER (WHERE matched) AS anchors_with_match, coalesce(sum(CASE WHEN accepted THEN len(anchors) ELSE 0 END), 0)::BIGINT AS anchor_items,
  coalesce(sum(CASE WHEN accepted THEN len(generic) ELSE 0 END), 0)::BIGINT AS generic_items, count(*) FILTER (WHERE failure IS NOT NULL) AS failures"""
_RATES = """
  accepted_rows / greatest(total_rows, 1)::DOUBLE AS completeness_rate, unsupported / greatest(accepted_rows, 1)::DOUBLE AS unsupported_rate, inconclusive / greatest(accepted_rows, 1)::DOUBLE AS inconclusive_rate,
  anchors_with_match / greatest(accepted_rows, 1)::DOUBLE AS anchor_match_rate, generic_items / greatest(anchor_items, 1)::DOUBLE AS generic_fraction"""


@query(
    f"""WITH {A.CORPUS_SQL}, m AS (SELECT {_METRICS} FROM rowed), r AS (SELECT *, {_RATES} FROM m)
    SELECT *, unsupported_rate <= 0.05 AS check_unsupported, inconclusive_rate <= 0.2 AS check_inconclusive, anchor_match_rate >= 0.8 AS check_anchor_match,
           CASE WHEN accepted_rows < 1 THEN 1 ELSE 0 END + CASE WHEN anchor_match_rate < 0.8 THEN 1 ELSE 0 END AS n_violations,
           unsupported_rate <= 0.05 AND inconclusive_rate <= 0.2 AND anchor_match_rate >= 0.8 AND failures = 0 AND accepted_rows >= 1 AS passed FROM r"""
)
def gate_summary(spark, sf_dir):
    """The offline gate over the whole corpus: one row."""
    out = gate.verdict(gate.corpus_metrics(gate.judged_rows(A.corpus(spark, sf_dir))))
    checks = [F.col("checks")[name].alias(f"check_{name[4:]}") for name in ("max_unsupported", "max_inconclusive", "min_anchor_match")]
    return out.select("*", *checks, F.size("violations").alias("n_violations"), F.col("pass").alias("passed")).drop("checks", "violations", "pass")


@query(f"WITH {A.CORPUS_SQL}, m AS (SELECT lang, {_METRICS} FROM rowed GROUP BY lang) SELECT *, {_RATES} FROM m")
def gate_by_language(spark, sf_dir):
    return gate.corpus_metrics(gate.judged_rows(A.corpus(spark, sf_dir)), "lang")


@query(f"WITH {A.CORPUS_SQL} SELECT doc_id, failure, array_to_string(CASE WHEN support_level IS NULL THEN ['output.support_level', 'output.support_level(valid)'] ELSE [] END, ',') AS missing FROM rowed WHERE failure IS NOT NULL")
def gate_failures(spark, sf_dir):
    return gate.judged_rows(A.corpus(spark, sf_dir)).filter("failure IS NOT NULL").select("doc_id", "failure", F.array_join("missing", ",").alias("missing"))


_HEDGE, _VULN = T.words(fixed.HEDGING), T.words(fixed.VULNERABILITY_CLASS)
_PRED = "concat('Buffer ', CASE WHEN doc_id % 3 = 0 THEN 'overflow' WHEN doc_id % 3 = 1 THEN 'may be suspected' ELSE 'issue' END, ' in ', split_part(text, ' ', 1), ' of ', CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE source END, ' reached from ', lang)"


@query(
    rf"""WITH p AS (SELECT doc_id, text, trim(regexp_replace({_PRED}, '\s+', ' ', 'g')) AS p FROM documents), s AS (
      SELECT *, list_filter(list_distinct(regexp_extract_all(p, '[A-Za-z0-9_]+')), lambda w: regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]{{2,63}}$') AND NOT list_contains({fixed.PREDICATE_STOPWORDS}, lower(w))) AS symbols,
             list_distinct(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS tokens FROM p), h AS (SELECT *, list_has_any(symbols, tokens) AS hit FROM s)
    SELECT doc_id, length(p) < 40 AS short, regexp_matches(p, '{_HEDGE}') AS hedged, NOT regexp_matches(p, '{_VULN}') AS no_class, NOT hit AS no_symbol,
           length(p) >= 40 AND NOT regexp_matches(p, '{_HEDGE}') AND regexp_matches(p, '{_VULN}') AND hit AS passed FROM h"""
)
def predicate_quality(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").withColumn("p", F.expr(_PRED))
    found = docs.select("doc_id", T.predicate_quality("p", "text").alias("r"))
    has = lambda name: F.array_contains("r", name)
    return found.select(
        "doc_id", has("predicate_too_short").alias("short"), has("predicate_contains_hedging_or_placeholder").alias("hedged"), has("missing_vulnerability_class").alias("no_class"),
        has("missing_code_symbol_or_grounded_term").alias("no_symbol"), (F.size("r") == 0).alias("passed"),
    )


_MARKS = " + ".join(f"contains(lower(t), '{m}')::INT" for m in fixed.CODE_MARKERS)


_SIGNALS_SQL = rf"""p AS (SELECT page_id, regexp_replace(html, '^\s+|\s+$', '', 'g') AS t FROM pages), c AS (SELECT page_id, length(t) AS n_chars, {_MARKS} AS markers,
        length(t) - length(replace(t, chr(10), '')) AS newlines, len(regexp_extract_all(t, '[{{}}();\[\]<>]')) AS punctuation, len(regexp_extract_all(lower(t), '\b(?:{fixed.CODE_KEYWORDS})\b')) AS keywords,
        len(regexp_extract_all(t, '==|!=|<=|>=|->|=>|=|\+|-|\*|/')) AS operators, len(regexp_extract_all(t, '\b[A-Za-z_][A-Za-z0-9_]*\s*\(')) AS calls FROM p)"""


@query(f"WITH {_SIGNALS_SQL} SELECT * FROM c")
def code_like_signals(spark, sf_dir):
    s = T.code_signals("html")
    return A.table(spark, sf_dir, "pages").select("page_id", *(c.alias(k) for k, c in s.items()))


@query(
    f"""WITH {_SIGNALS_SQL} SELECT page_id, n_chars >= 40 AND (markers >= 2)::INT + (newlines >= 2 AND punctuation >= 4)::INT + (keywords >= 3)::INT + (operators >= 3)::INT + (calls >= 2)::INT >= 3 AS code_like FROM c
    UNION ALL SELECT page_id + 1000000, n_chars >= 40 AND (markers >= 2)::INT + (newlines >= 2 AND punctuation >= 4)::INT + (keywords >= 3)::INT + (operators >= 3)::INT + (calls >= 2)::INT >= 3
    FROM (WITH pages AS (SELECT page_id, regexp_replace(html, '[^A-Za-z0-9 ]', '', 'g') AS html FROM pages), {_SIGNALS_SQL} SELECT * FROM c)"""
)
def code_like_pages(spark, sf_dir):
    """Pages as they are, and stripped of all signs."""
    p = A.table(spark, sf_dir, "pages").select("page_id", "html")
    plain = p.select((F.col("page_id") + 1000000).alias("page_id"), F.regexp_replace("html", "[^A-Za-z0-9 ]", "").alias("html"))
    return p.unionByName(plain).select("page_id", T.is_code_like("html").alias("code_like"))


@query(f"WITH {A.CORPUS_SQL} SELECT lang, sum(len(generic)) / sum(len(anchors))::DOUBLE AS generic_fraction, count(*) AS docs FROM judged GROUP BY lang")
def generic_anchor_fraction(spark, sf_dir):
    c = A.corpus(spark, sf_dir)
    n = F.size(F.filter("anchors", T.is_generic_anchor))
    return c.groupBy("lang").agg((F.sum(n) / F.sum(F.size("anchors")).cast("double")).alias("generic_fraction"), F.count("*").alias("docs"))


@query(f"WITH {A.CORPUS_SQL} SELECT doc_id, len(anchors)::INT AS total, len(list_filter(anchors, lambda a: trim(a) <> '' AND contains(input, a)))::INT AS matched, len(list_filter(anchors, lambda a: trim(a) <> '' AND contains(input, a))) = len(anchors) AS all_match FROM corpus")
def anchor_match_stats(spark, sf_dir):
    return A.corpus(spark, sf_dir).select("doc_id", T.anchor_stats("anchors", "input").alias("s")).select("doc_id", "s.total", "s.matched", "s.all_match")


@query(
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' cve-2021-' || (1000 + doc_id) || ' ' WHEN doc_id % 9 = 1 THEN ' ' END AS cve, CASE WHEN doc_id % 4 = 0 THEN 'seen as Cve-2020-' || (12345 + doc_id) || ' in ' ELSE '' END || text AS p FROM documents)
    SELECT doc_id, coalesce(nullif(upper(trim(cve)), ''), nullif(upper(regexp_extract(p, '[Cc][Vv][Ee]-[0-9]{4}-[0-9]{4,7}', 0)), ''), 'HASH-' || substr(sha256(p), 1, 10)) AS scenario_id FROM t"""
)
def scenario_id_resolution(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    cve = F.when(d.doc_id % 9 == 0, F.concat(F.lit(" cve-2021-"), 1000 + d.doc_id, F.lit(" "))).when(d.doc_id % 9 == 1, " ")
    p = F.concat(F.when(d.doc_id % 4 == 0, F.concat(F.lit("seen as Cve-2020-"), 12345 + d.doc_id, F.lit(" in "))).otherwise(""), F.col("text"))
    return d.select("doc_id", T.scenario_id(cve, p).alias("scenario_id"))


_TOKEN, _POS = T.words(fixed.CODE_TOKEN), T.words(fixed.HEURISTIC_POSITIVE)
_SEED = "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'too short' WHEN doc_id % 5 = 2 THEN 'a buffer overflow here' ELSE text END"
_BODY = "CASE WHEN doc_id % 2 = 0 THEN 'int ' || text ELSE text END"
_RULE = rf"""CASE WHEN NOT regexp_matches(p, '\S') OR (NOT contains(p, chr(10)) AND length(p) < 15) THEN 0.01 WHEN c <> '' AND NOT regexp_matches(c, '{_TOKEN}') THEN 0.01 WHEN regexp_matches(p, '{_POS}') THEN 0.99 END"""
_RULED = rf"WITH t AS (SELECT doc_id, regexp_replace({_SEED}, '^\s+|\s+$', '', 'g') AS p, regexp_replace({_BODY}, '^\s+|\s+$', '', 'g') AS c FROM documents), r AS (SELECT doc_id, ({_RULE})::DOUBLE AS rule FROM t)"


@query(f"{_RULED} SELECT doc_id, rule FROM r")
def stage_a_heuristic(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.heuristic_score(F.expr(_SEED), F.expr(_BODY)).cast("double").alias("rule"))


@query(
    f"""{_RULED}, m AS (SELECT *, 1 + doc_id % 3 AS attempt, (doc_id % 101) / 100.0::DOUBLE AS b, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 83) / 82.0::DOUBLE END AS c FROM r)
    SELECT doc_id, CASE WHEN rule IS NOT NULL THEN 'heuristic' WHEN attempt = 1 THEN 'initial_seed_pass' WHEN b >= 0.995 OR b <= 0.05 THEN 'xgboost' WHEN c IS NOT NULL THEN 'setfit' ELSE 'default_pass' END AS stage,
           CASE WHEN rule IS NOT NULL THEN rule >= 0.9 WHEN attempt = 1 OR b >= 0.995 THEN true WHEN b <= 0.05 THEN false WHEN c IS NOT NULL THEN c >= 0.65 ELSE true END AS accept,
           CASE WHEN rule IS NOT NULL THEN rule WHEN attempt = 1 THEN 1.0 WHEN b >= 0.995 OR b <= 0.05 THEN b WHEN c IS NOT NULL THEN c ELSE 1.0 END::DOUBLE AS probability FROM m"""
)
def cascade_decision(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    c = F.when(d.doc_id % 7 != 0, (d.doc_id % 83) / 82.0)
    return d.select("doc_id", T.cascade(F.expr(_SEED), F.expr(_BODY), 1 + d.doc_id % 3, (d.doc_id % 101) / 100.0, c).alias("x")).select("doc_id", "x.stage", "x.accept", "x.probability")


_TAX = " ".join(f"WHEN regexp_matches(lower(p), '{T.any_of(words)}') THEN '{bucket}'" for bucket, words in fixed.TAXONOMY.items())
_TOPIC = "concat(CASE WHEN doc_id % 6 = 0 THEN 'Heap overflow' WHEN doc_id % 6 = 1 THEN 'unsigned wrap' WHEN doc_id % 6 = 2 THEN 'TOCTOU race' WHEN doc_id % 6 = 3 THEN 'SQL injection' ELSE '' END, ' ', text)"


@query(f"WITH t AS (SELECT *, {_TOPIC} AS p FROM documents) SELECT doc_id, CASE {_TAX} ELSE 'input_validation' END AS bucket FROM t")
def taxonomy_routing(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.taxonomy(F.expr(_TOPIC)).alias("bucket"))


_CONF = "CASE WHEN o_orderkey % 8 = 0 THEN 'high' WHEN o_orderkey % 8 = 1 THEN (o_orderkey % 150) || '%' WHEN o_orderkey % 8 = 2 THEN (o_orderkey % 5) || '/4' WHEN o_orderkey % 8 = 3 THEN '0.' || (o_orderkey % 10) WHEN o_orderkey % 8 = 4 THEN cast(o_orderkey % 90 AS VARCHAR(20)) WHEN o_orderkey % 8 = 5 THEN 'nan' WHEN o_orderkey % 8 = 6 THEN substr(o_orderpriority, 1, 1) ELSE o_orderpriority END"
_LEVEL = "CASE WHEN x IS NULL OR isnan(x) THEN 'MEDIUM' WHEN (CASE WHEN x > 5 THEN x / 100 WHEN x > 1 THEN x / 5 ELSE x END) >= 0.8 THEN 'HIGH' WHEN (CASE WHEN x > 5 THEN x / 100 WHEN x > 1 THEN x / 5 ELSE x END) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


@query(
    f"""WITH t AS (SELECT o_orderkey, upper(trim({_CONF})) AS v FROM orders), u AS (SELECT *, CASE WHEN v LIKE '%\\%' ESCAPE '\\' THEN least(greatest(try_cast(rtrim(v, '%') AS DOUBLE) / 100, 0), 1)
        WHEN contains(v, '/') THEN try_cast(split_part(v, '/', 1) AS DOUBLE) / nullif(try_cast(split_part(v, '/', 2) AS DOUBLE), 0) ELSE try_cast(v AS DOUBLE) END AS x FROM t)
    SELECT o_orderkey, CASE WHEN v IN ('HIGH', 'CERTAIN', 'CRITICAL', '5', '4') THEN 'HIGH' WHEN v IN ('MEDIUM', 'MODERATE', 'NORMAL', '3') THEN 'MEDIUM' WHEN v IN ('LOW', 'WEAK', 'POOR', '2', '1') THEN 'LOW' ELSE {_LEVEL} END AS confidence FROM u"""
)
def confidence_canonical(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", T.confidence(F.expr(_CONF)).alias("confidence"))


@query(
    """WITH t AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN substr(text, 1, length(text) - 1) ELSE text END AS s, text FROM documents), l AS (SELECT *, string_split(s, chr(10)) AS lines FROM t), p AS (
      SELECT doc_id, CASE WHEN len(lines) > 6 THEN array_to_string(lines[1:3], chr(10)) || chr(10) || '... [' || (len(lines) - 6) || ' lines truncated for context efficiency] ...' || chr(10) || array_to_string(lines[len(lines) - 2:], chr(10)) ELSE text END AS pruned FROM l)
    SELECT doc_id, sha256(pruned) AS pruned_sha, greatest(1, ceil(length(pruned) / 4.0))::BIGINT AS tokens FROM p"""
)
def line_prune(spark, sf_dir):
    p = T.prune_lines("text", 6)
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2(p, 256).alias("pruned_sha"), T.token_estimate(p).alias("tokens"))


def _pruned_sql(most: int) -> str:
    """p: documents with `pruned`, the text cut to a head and a tail of most // 2 lines where it has more than `most`."""
    keep = most // 2
    return f"""t AS (SELECT doc_id, regexp_replace(text, '\\r?\\n$', '') AS s, text FROM documents), l AS (SELECT *, regexp_split_to_array(s, '\\r?\\n') AS lines FROM t), p AS (
      SELECT doc_id, text, CASE WHEN len(lines) > {most} THEN array_to_string(lines[1:{keep}], chr(10)) || chr(10) || '... [' || (len(lines) - {2 * keep}) || ' lines truncated for context efficiency] ...' || chr(10) || array_to_string(lines[len(lines) - {keep - 1}:], chr(10)) ELSE text END AS pruned FROM l)"""


@query(f"WITH {_pruned_sql(100)} SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens, floor(length(pruned) / 4.0)::BIGINT + 100 AS unit_tokens FROM p")
def token_estimate(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.token_estimate("text").alias("tokens"), T.unit_token_estimate("text").alias("unit_tokens"))


@query(
    """WITH t AS (SELECT o_orderkey, {'mode': o_orderstatus, 'model': 'm' || (o_orderkey % 3), 'seed': (o_orderkey % 2)::VARCHAR} AS f FROM orders)
    SELECT o_orderkey, concat_ws(',', CASE WHEN f.mode <> 'F' THEN 'mode' END, CASE WHEN f.model <> 'm0' THEN 'model' END, CASE WHEN f.seed <> '0' THEN 'seed' END) AS drift FROM t"""
)
def checkpoint_drift(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    found = F.create_map(F.lit("mode"), "o_orderstatus", F.lit("model"), F.concat(F.lit("m"), F.col("o_orderkey") % 3), F.lit("seed"), (F.col("o_orderkey") % 2).cast("string"))
    want = F.create_map(F.lit("mode"), F.lit("F"), F.lit("model"), F.lit("m0"), F.lit("seed"), F.lit("0"))
    return o.select("o_orderkey", F.array_join(T.drifted_keys(found, want), ",").alias("drift"))


@query(
    r"""WITH n AS (SELECT doc_id, text, lower(regexp_replace(regexp_replace(regexp_replace(text, '//[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '\s+', '', 'g')) AS k FROM documents)
    SELECT min(doc_id) AS doc_id, count(*) AS copies FROM n GROUP BY k"""
)
def norm_dedup(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2(T.normalized_code("text"), 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) = 1")
def exact_dedup_first(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return dedup.first_by(d, F.sha2(F.concat_ws("\x1f", "text", "lang"), 256), "doc_id").select("doc_id", "lang", "source")


@query("WITH b AS (SELECT DISTINCT text FROM benchmark UNION SELECT text FROM documents WHERE doc_id % 40 = 0) SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM b) AND lower(regexp_replace(text, '\\s+', '', 'g')) NOT IN (SELECT lower(regexp_replace(text, '\\s+', '', 'g')) FROM b)")
def eval_exclusion_anti_join(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    banned = A.table(spark, sf_dir, "benchmark").select("text").unionByName(d.filter("doc_id % 40 = 0").select("text"))
    return dedup.excluded(d, "text", banned, "text").select("doc_id")


@query(
    """WITH d AS (SELECT text AS t, min(doc_id) AS id FROM documents GROUP BY text), w AS (SELECT id, regexp_extract_all(lower(t), '[A-Za-z0-9_]+') AS k FROM d), s AS (
      SELECT DISTINCT id, CASE WHEN len(k) >= 5 THEN array_to_string(k[i:i + 4], ' ') ELSE array_to_string(k, ' ') END AS g FROM w, unnest(range(1, greatest(len(k) - 4, 1) + 1)) AS u(i) WHERE len(k) > 0),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
    SELECT a, b, c / (x.n + y.n - c)::DOUBLE AS jaccard FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c)::DOUBLE > 0.85"""
)
def shingle_jaccard_pairs(spark, sf_dir):
    return dedup.shingle_pairs(A.table(spark, sf_dir, "documents"), "doc_id", "text", 0.85, 5)


_REASONS = "CASE WHEN length(text) < 50 THEN 'too_short' WHEN length(text) > 12000 THEN 'too_long' WHEN doc_id > first_id THEN 'duplicate' END"


@query(f"WITH f AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents), r AS (SELECT {_REASONS} AS reason FROM f) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason")
def rejection_breakdown(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    first = d.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.min("doc_id").alias("first_id")).drop("h")
    r = d.join(first, "text").select(T.snippet_rejection("text", F.col("doc_id") > F.col("first_id")).alias("reason"))
    return r.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def transcript_last_turn(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    last = c.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", F.length("text").alias("n")), "turn").alias("r"))
    return last.select("conv_id", "r.*")




@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k FROM events")
def json_first_object(spark, sf_dir):
    """The first whole object of answers in fences, after stray braces, inside prose, and of answers without any."""
    c, props = F.col("event_id") % 4, F.col("props")
    raw = (
        F.when(c == 0, F.concat(F.lit("answer: ```json\n"), props, F.lit("\n``` thanks {"))).when(c == 1, F.concat(F.lit("so "), props, F.lit(' and {"k": 0}')))
        .when(c == 2, F.concat(F.lit('{"s": "a } b", '), F.expr("substring(props, 2, length(props) - 1)"))).otherwise(F.concat(F.lit("none { "), F.col("event_type")))
    )
    e = A.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", F.get_json_object(parsing.first_json_object_col("raw"), "$.k").cast("long").alias("k"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_repair(spark, sf_dir):
    """Answers with a trailing comma, without their closing braces, cut within a list, and with both."""
    c, inner = F.col("event_id") % 4, F.expr("substring(props, 2, length(props) - 2)")
    raw = (
        F.when(c == 0, F.concat(F.lit('{"a": [1, 2,], '), inner)).when(c == 1, F.concat(F.lit("{"), inner, F.lit(",}"))).when(c == 2, F.concat(F.lit("{"), inner, F.lit(', "b": [1, 2')))
        .otherwise(F.concat(F.lit('{"o": {"x": 1,}, '), inner, F.lit(', "p": {"y": [')))
    )
    e = A.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    return e.select("event_id", F.get_json_object(parsing.repaired_json_col("raw"), "$.k").cast("long").alias("k"))


@query(
    """SELECT doc_id, unnest(CASE doc_id % 3 WHEN 0 THEN ['class:C', 'C.m', 'f_' || doc_id] WHEN 1 THEN ['g_' || doc_id] ELSE [] END) AS key,
      unnest(CASE doc_id % 3 WHEN 0 THEN ['class', 'function', 'function'] WHEN 1 THEN ['function'] ELSE [] END) AS type, unnest(CASE doc_id % 3 WHEN 0 THEN [0, 4, 2] WHEN 1 THEN [5] ELSE [] END) AS n_params FROM documents"""
)
def ast_symbols(spark, sf_dir):
    """The symbols of a class and a function, of an asynchronous function with parameters of every kind, and of code that does not parse."""
    k = F.col("doc_id")
    code = (
        F.when(k % 3 == 0, F.concat(F.lit("class C:\n    def m(self, a, b=1, *, c):\n        return a\n\ndef f_"), k, F.lit("(x, *rest):\n    return x\n")))
        .when(k % 3 == 1, F.concat(F.lit("async def g_"), k, F.lit("(a, /, b, *args, c=1, **kw):\n    pass\n"))).otherwise("def broken(:\n")
    )
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.explode(parsing.api_signatures_col(code)).alias("s"))
    return d.select("doc_id", "s.key", "s.type", F.size("s.params").alias("n_params"))


@query(
    """SELECT doc_id, true AS is_complete, [2, 2, 0, 1][doc_id % 4 + 1] AS n_edges, [1, 0, 0, 0][doc_id % 4 + 1] AS n_guarded, ['MEMORY_WRITE', 'MEMORY_WRITE', '', 'SYSTEM_CALL'][doc_id % 4 + 1] AS sinks FROM documents"""
)
def flow_extraction(spark, sf_dir):
    """Flows of a guarded and an unguarded copy, of a function without sinks and of a system call."""
    k = F.col("doc_id")
    code = (
        F.when(k % 4 == 0, "void f(char *src, int n) { char buf[16]; if (n < 16) memcpy(buf, src, n); }").when(k % 4 == 1, "void f(char *src, int n) { char buf[16]; memcpy(buf, src, n); }")
        .when(k % 4 == 2, "int g(int n) { return n; }").otherwise("import os\ndef h(cmd):\n    os.system(cmd)\n")
    )
    d = A.table(spark, sf_dir, "documents").select("doc_id", parsing.flow_graph_col(code).alias("g"))
    sinks = F.array_join(F.array_distinct(F.transform("g.edges", lambda e: e["sink_type"])), ",")
    guarded = F.size(F.filter("g.edges", lambda e: e["sanitizer_type"].isNotNull()))
    return d.select("doc_id", "g.is_complete", F.size("g.edges").alias("n_edges"), guarded.alias("n_guarded"), sinks.alias("sinks"))
