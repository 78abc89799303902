"""Operators on small cases worked out by hand or by brute force."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditlake.functions import parsing
from auditlake.functions import text as T
from auditlake.operators import budgets, compare, dedup, gate, graph, ml, sequence, stats, telemetry


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


# -- text ----------------------------------------------------------------------


def test_predicate_quality(spark):
    code = "int copy_packet(char *src) { memcpy(buf, src, len); }"
    good = "Integer overflow in copy_packet lets a caller write past buf"
    assert one(spark, T.predicate_quality(F.lit(good), F.lit(code))) == []
    found = one(spark, T.predicate_quality(F.lit("maybe   bad"), F.lit(code)))
    assert found == ["predicate_too_short", "predicate_contains_hedging_or_placeholder", "missing_vulnerability_class", "missing_code_symbol_or_grounded_term"]
    assert one(spark, T.predicate_quality(F.lit(None).cast("string"), F.lit(code))) == ["predicate_not_string"]
    assert one(spark, T.fold_predicate(F.lit(" use‑after—free  here "))) == "use-after-free here"


def test_symbols(spark):
    assert one(spark, T.predicate_symbols(F.lit("`a->b` then the Foo_bar in Foo_bar"))) == ["a->b", "then", "Foo_bar"]
    assert one(spark, T.symbol_hits(F.lit("call `a->b` of foo and fo"), F.lit("x = a->b; foo2(fo)"))) == ["a->b"]


def test_anchors(spark):
    text = F.lit("int foo(){ return bar(x); }")
    s = one(spark, T.anchor_stats(F.array(F.lit("bar(x)"), F.lit("nope"), F.lit(" ")), text))
    assert (s["total"], s["matched"], s["all_match"], s["hits"]) == (3, 1, False, ["bar(x)"])
    assert one(spark, T.grounded_anchors(F.array(F.lit(" bar(x) "), F.lit("bar(x)"), F.lit("")), text)) == ["bar(x)"]
    for anchor, generic in (("missing check", True), ("no input validation", True), ("submission", False), ("", True), ("bar(x)", False), ("attackers", False)):
        assert one(spark, T.is_generic_anchor(F.lit(anchor))) is generic, anchor


def test_gate_cascade(spark):
    code = "int copy_packet(char *src) { memcpy(buf, src, len); } // guard"
    anchors = F.array(F.lit("memcpy(buf, src, len)"), F.lit("copy_packet"))
    good = "Integer overflow in copy_packet lets a caller write past buf"
    mechanism = "Source anchor: copy_packet. Sink anchor: memcpy(buf, src, len). Missing guard anchor: none"
    args = dict(predicate=F.lit(good), code=F.lit(code), mechanism=F.lit(mechanism), anchors=anchors, winner=F.lit("pro_debater"), reason=F.lit(""))
    assert one(spark, T.first_gate_failure(**args)) is None
    assert one(spark, T.first_gate_failure(**args | {"predicate": F.lit("x")})) == "predicate_quality_failed"
    assert one(spark, T.first_gate_failure(**args | {"anchors": F.array(F.lit("copy_packet"))})) == "anchors_too_few_after_normalization"
    assert one(spark, T.first_gate_failure(**args | {"mechanism": F.lit("nothing here")})) == "mechanism_evidence_failed"
    assert one(spark, T.first_gate_failure(**args | {"mechanism": F.lit("copy_packet calls memcpy(buf, src, len)")})) == "mechanism_template_failed"
    assert one(spark, T.first_gate_failure(**args | {"winner": F.lit("con_debater"), "mechanism": F.lit(mechanism.replace("guard", "GUARD"))})) is None
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    empty = F.lit(None).cast("string")
    assert one(spark, T.verifier_gate(F.lit("con_debater"), yes, empty, yes)) == "con_win_not_applicable"
    assert one(spark, T.verifier_gate(F.lit("pro"), no, F.lit("x"), yes)) == "verifier_logic_error"
    assert one(spark, T.verifier_gate(F.lit("pro"), none, empty, yes)) == "verifier_failed"
    assert one(spark, T.verifier_gate(F.lit("pro"), none, empty, no)) is None


def test_code_like(spark):
    code = "int main() {\n  for (int i = 0; i < n; i++) {\n    foo(i);\n  }\n  return bar(1);\n}"
    assert one(spark, T.is_code_like(F.lit(code))) is True
    assert one(spark, T.is_code_like(F.lit("A long sentence of plain prose, with nothing of a program in it at all."))) is False
    assert one(spark, T.is_code_like(F.lit(None).cast("string"))) is False


@pytest.mark.parametrize(("x", "want"), [("high", "HIGH"), ("85%", "HIGH"), ("3/4", "MEDIUM"), ("0.2", "LOW"), ("4", "HIGH"), ("60", "MEDIUM"), ("1/0", "MEDIUM"), ("x", "MEDIUM"), ("900%", "HIGH"), ("2.5", "MEDIUM")])
def test_confidence(spark, x, want):
    assert one(spark, T.confidence(F.lit(x))) == want
    assert one(spark, T.confidence(F.lit("what"), "UNKNOWN")) == "UNKNOWN"


def test_small_scalars(spark):
    assert one(spark, T.prune_lines(F.lit("\n".join("abcdef")), 4)) == "a\nb\n... [2 lines truncated for context efficiency] ...\ne\nf"
    assert one(spark, T.prune_lines(F.lit("a\nb"), 4)) == "a\nb"
    assert [one(spark, T.token_estimate(F.lit(s))) for s in ("", "abcd", "abcde")] == [1, 1, 2]
    assert one(spark, T.normalized_code(F.lit("Int A; // x\n/* y\n */ B"))) == "inta;b"
    assert one(spark, T.format_conversions(F.lit("%d %% %5.2lf %s"))) == 3
    assert one(spark, T.taxonomy(F.lit("A TOCTOU issue"))) == "concurrency" and one(spark, T.taxonomy(F.lit("?"))) == "input_validation"
    assert one(spark, T.repair_directive(F.lit("B_SANITIZER_MISMATCH"), found_sanitizer=F.lit("NULL_CHECK"))) == "Apply valid sink-specific guard validation (strict bounds checking) rather than NULL_CHECK."
    assert one(spark, T.matches_language(F.lit("C, cpp"), "cpp")) is True
    assert one(spark, T.word_shingles(F.lit("a b c d e f"), 5)) == ["a b c d e", "b c d e f"] and one(spark, T.word_shingles(F.lit("a b"), 5)) == ["a b"]
    assert one(spark, T.rescaled_score(F.lit(85.0))) == 8.5 and one(spark, T.rescaled_score(F.lit(101.0))) is None
    assert one(spark, T.harvested_anchors(F.array(F.lit("uses `len + 1` and buf_size"), F.lit("missing")), F.lit("x[len + 1] = buf_size"))) == ["len + 1", "len", "buf_size"]
    assert one(spark, T.effective_config(F.create_map(F.lit("t"), F.lit("0")), F.create_map(F.lit("big"), F.create_map(F.lit("t"), F.lit("1"))), F.lit("the-big-one"))) == {"t": "1"}
    assert one(spark, T.phase_at_least(F.lit("verifier_complete"), "judge_complete")) is True
    assert one(spark, T.time_decay(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"))) == 0.5


# -- parsing -------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": [1, 2,], "b": "x', {"a": [1, 2], "b": "x"}), ('{"a": {"b": 1', {"a": {"b": 1}}), ('{"a": "q\\', {"a": "q\\"}), ('{"a": ",}"}', {"a": ",}"}), ('{"a": 1,}', {"a": 1})],
)
def test_repaired_json(text, want):
    assert json.loads(parsing.repaired_json(text)) == want


def test_json_readings():
    assert parsing.first_json_object('x {"a": "}"} {') == '{"a": "}"}' and parsing.first_json_object("{") is None
    assert json.loads(parsing.parsed_json('```json\n{"a": "\\d"}\n```')) == {"a": "\\d"}
    assert parsing.parsed_json("no") is None and parsing.prefix_logic_error('{"logic_error": "e"} tail') == "e"


def test_signatures():
    code = "class A:\n  def m(self, a, /, b=1, *, c, **k): pass\n  def _p(self): pass\n  @validator('x')\n  def v(cls): pass\nclass _B:\n  def n(self): pass\ndef f(): pass\n"
    got = {k: (t, p) for k, t, p in parsing.api_signatures(code)}
    assert set(got) == {"class:A", "A.m", "f"}
    assert got["A.m"][1] == [("self", "positional_only", False), ("a", "positional_only", False), ("b", "positional_or_keyword", True), ("c", "keyword_only", False), ("k", "var_keyword", True)]
    assert parsing.definitions("def g():\n  pass\n") == [("function", None, "g", 1, 2)] and parsing.definitions("def (") == []


def test_flow_graphs():
    guarded = parsing.flow_graph("def f(i, a):\n  if i < 10:\n    return a[i]\n")
    assert [e["sanitizer_type"] for e in guarded["edges"] if e["sink_type"] == "ARRAY_INDEX"] == ["BOUNDS_CHECK"]
    bare = parsing.flow_graph("def f(i, a):\n  return a[i]\n")
    assert [e["sanitizer_type"] for e in bare["edges"]] == [None]
    rebound = parsing.flow_graph("def f(i, a):\n  assert i < 3\n  i = i + 1\n  return a[i]\n")
    assert [e["sanitizer_type"] for e in rebound["edges"]] == [None]
    c = parsing.flow_graph("void f(char *src, int n) { char buf[8]; if (n < 8) memcpy(buf, src, n); }")
    assert c["is_complete"] and {e["sink_type"] for e in c["edges"]} == {"MEMORY_WRITE"}
    assert parsing.flow_graph("void f( {")["parse_error"] == "unbalanced" and not parsing.flow_graph("")["is_complete"]


# -- statistics ----------------------------------------------------------------


def test_distributions():
    assert stats.normal_quantile(0.975) == pytest.approx(stats.Z975, abs=1e-9)
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.wilcoxon(np.array([1.0, 2, 3, 4, 5])) == (0.0, 0.0625)
    w, p = stats.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.007, abs=0.002)


def test_exact_wilcoxon_by_enumeration():
    rng = np.random.default_rng(1)
    for n in (4, 7, 9):
        d = rng.standard_normal(n)
        ranks = pd.Series(np.abs(d)).rank().to_numpy()
        sums = [sum(r for r, up in zip(ranks, f"{k:0{n}b}") if up == "1") for k in range(2**n)]
        w, p = stats.wilcoxon(d)
        assert p == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 2**n))


def test_paired_router():
    assert stats.paired_test([1, 2], [2, 3])["test"] == "insufficient_sample_size"
    assert stats.paired_test([1, 2, 3], [1, 2, 3])["test"] == "zero_delta_identical"
    rng = np.random.default_rng(3)
    b = rng.standard_normal(20)
    t = stats.paired_test(b, b + 1 + 0.1 * rng.standard_normal(20))
    assert t["test"] == "paired_t_test" and t["significant"] and t["low"] < t["mean_delta"] < t["high"]
    skew = stats.paired_test(np.zeros(30), np.exp(3 * rng.standard_normal(30)))
    assert skew["test"] == "wilcoxon_signed_rank" and skew["p_value"] < 1e-6


def test_holm_stops(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "m string, p double")
    got = {r["m"]: (r["rank"], round(r["adjusted_p"], 4), r["is_significant"]) for r in stats.holm(rows, "p", "m").collect()}
    assert got == {"d": (1, 0.02, True), "a": (2, 0.03, True), "c": (3, 0.06, False), "b": (4, 0.06, False)}


# -- dedup ---------------------------------------------------------------------


def test_leaders_are_the_greedy_ones(spark):
    rng = random.Random(2)
    edges = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(60)) if a != b}
    kept = []
    for i in range(40):
        if not any((j, i) in edges for j in kept):
            kept.append(i)
    rows = spark.range(40)
    got = dedup.leaders(rows, "id", spark.createDataFrame(sorted(edges), "a long, b long"))
    assert sorted(r["id"] for r in got.collect()) == kept


def test_cosine_pairs_are_exact(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((80, 5))
    v[40:] = v[:40] + 0.2 * rng.standard_normal((40, 5))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for t in (0.5, 0.9, 0.99):
        want = {(i, j) for i in range(80) for j in range(i + 1, 80) if u[i] @ u[j] >= t}
        assert {(r["a"], r["b"]) for r in dedup.cosine_pairs(rows, "id", "v", t, 5).collect()} == want


def test_exclusion(spark):
    rows = spark.createDataFrame([(1, "int A;"), (2, "int b; // x"), (3, "c")], "id int, code string")
    banned = spark.createDataFrame([("INT  a;",), ("int b;",)], "t string")
    assert [r["id"] for r in dedup.excluded(rows, "code", banned, "t").collect()] == [3]


# -- comparison ----------------------------------------------------------------


def test_overlay_replaces_whole_rows(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "id int, x string, y int")
    other = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "id int, x string, y int")
    assert sorted(tuple(r) for r in compare.overlay(base, other, "id").collect()) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]


def test_signature_regressions(spark):
    schema = "file_path string, key string, type string, params array<struct<name:string,kind:string,has_default:boolean>>"
    p = lambda *names: [(n.strip("=!"), "keyword_only" if n.endswith("!") else "positional_or_keyword", n.endswith("=")) for n in names]
    base = [("f", "gone", "function", []), ("f", "kind", "function", p("a")), ("f", "dflt", "function", p("a=")), ("f", "more", "function", p("a")), ("f", "order", "function", p("a", "b")), ("f", "ins", "function", p("a", "b")), ("f", "same", "function", p("a", "b=")), ("f", "class:K", "class", [])]
    other = [("f", "kind", "function", p("a!")), ("f", "dflt", "function", p("a")), ("f", "more", "function", p("a", "n")), ("f", "order", "function", p("b", "a")), ("f", "ins", "function", p("n=", "a", "b")), ("f", "same", "function", p("a", "b=", "c="))]
    got = sorted((r["key"], r["regression"]) for r in compare.signature_regressions(spark.createDataFrame(base, schema), spark.createDataFrame(other, schema)).collect())
    assert got == [("class:K", "deleted_class"), ("dflt", "default_removed:a"), ("gone", "deleted_function"), ("ins", "inserted"), ("kind", "kind:a"), ("more", "added:n"), ("order", "reordered")]


def test_diff_lines(spark):
    text = ["--- a/x", "+++ b/x", "@@ -1,2 +3,2 @@ def", "+q", "@@ -9 +9,0 @@", "+++ b/y", "@@ -1 +1 @@"]
    diff = spark.createDataFrame([(1, i, s) for i, s in enumerate(text)], "d int, no int, line string")
    assert sorted((r["file"], r["line"]) for r in compare.diff_lines(diff, "d", "no", "line").collect()) == [("x", 3), ("x", 4), ("x", 9), ("y", 1)]


def test_range_overlaps(spark):
    rng = random.Random(1)
    ranges = [(k % 3, a, a + rng.randrange(200)) for k in range(40) for a in [rng.randrange(500)]]
    points = [(k % 3, rng.randrange(800)) for k in range(100)]
    want = sorted((g, a, b, x) for g, a, b in ranges for h, x in points if g == h and a <= x <= b)
    got = compare.range_overlaps(spark.createDataFrame(ranges, "g int, a int, b int"), spark.createDataFrame(points, "g int, x int"), "g", "a", "b", "x")
    assert sorted(tuple(r) for r in got.select("g", "a", "b", "x").collect()) == want


# -- telemetry, sequence, gate, graph, metrics ---------------------------------


def test_nearest_rank(spark):
    for n in (1, 2, 19, 20, 21, 40):
        values = [float(x % 7) for x in range(n)]
        got = telemetry.nearest_rank(spark.createDataFrame([(1, v) for v in values], "g int, v double"), "v", 0.95, "g").first()["value"]
        assert got == sorted(values)[min(int(0.95 * n), n - 1)]


def test_budgets(spark):
    sizes = [5, 30, 4, 4, 4, 50, 1]
    units = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "g int, i int, s int")
    got = {r["i"]: r["batch"] for r in budgets.budget_batches(units, "s", ["i"], 12, 3, "g").collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 2, 4: 2, 5: 3, 6: 4}
    assert sorted(r["i"] for r in budgets.budget_selection(units, "s", ["i"], 12, 3, "g").collect()) == [0, 2, 6]
    assert sorted(r["i"] for r in budgets.budget_selection(units.filter("i in (1, 2)"), "s", ["i"], 12, 3, "g").collect()) == [1]


def test_gate_with_attempts(spark):
    attempts = spark.createDataFrame(
        [("accepted", None, "supported", True, True, True, "pro_debater", True, "", 10, 0.1), ("rejected", "anchors_no_match", "unsupported", True, False, None, "con_debater", True, "", 30, 0.3)],
        "decision string, reject_reason string, support_level string, called boolean, parse_ok boolean, passes_audit boolean, winner string, judged boolean, logic_error string, total_tokens long, cost double",
    )
    m = gate.attempt_metrics(attempts).first()
    assert (m["attempts"], m["strict_fail_rate"], m["parse_ok_rate"], m["tokens_per_accepted"]) == (2, 0.5, 0.5, 40.0)
    corpus = spark.createDataFrame([("int foo(){ return bar(x); }", "p", ["bar(x)", "foo()"], "c", "v", "supported")], "input string, predicate string, anchors array<string>, counterfactual string, verifier_report string, support_level string")
    both = gate.corpus_metrics(gate.judged_rows(corpus)).crossJoin(gate.attempt_metrics(attempts).drop("unsupported", "inconclusive", "accepted"))
    assert gate.verdict(gate.corpus_metrics(gate.judged_rows(corpus))).first()["pass"] is True
    assert gate.verdict(both, with_attempts=True).first()["pass"] is False
    with pytest.raises(ValueError):
        gate.Thresholds(min_accepted_rows=0)


def _graph(spark, created=1.0, complete=True, **edge):
    e = {"graph_id": 1, "edge_no": 1, "source_id": "s", "sink_id": "t", "source_type": "UNTRUSTED_INPUT", "sink_type": "MEMORY_WRITE", "sanitizer_type": "BOUNDS_CHECK", "guarded_target": "v", "invalid_at": None} | edge
    g = spark.createDataFrame([(1, complete, None, created)], "graph_id int, is_complete boolean, parse_error string, created_at double")
    n = spark.createDataFrame([(1, "s", "source", None), (1, "t", "sink", "v")], "graph_id int, node_id string, kind string, target_var string")
    return g, n, spark.createDataFrame([tuple(e.values())], "graph_id int, edge_no int, source_id string, sink_id string, source_type string, sink_type string, sanitizer_type string, guarded_target string, invalid_at double")


@pytest.mark.parametrize(
    ("change", "risk"),
    [({}, 0.05), ({"sanitizer_type": "NULL_CHECK"}, 1.0), ({"guarded_target": "w"}, 1.0), ({"source_id": "?"}, 1.0), ({"sink_type": "OTHER"}, 1.0), ({"invalid_at": 0.5}, 1.0), ({"invalid_at": math.nan}, 1.0), ({"invalid_at": 2.0}, 0.05), ({"created": math.inf}, 1.0), ({"complete": False}, 1.0), ({"source_type": "TRUSTED", "sanitizer_type": None}, 0.05)],
)
def test_reachability(spark, change, risk):
    assert graph.reachability(*_graph(spark, **change)).first()["risk"] == risk


def test_auc_by_pairs(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(2), rng.randrange(8) / 8) for _ in range(60)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "y int, s double")
    assert ml.roc_auc(df, "y", "s").first()["auc"] == pytest.approx(want)
    assert ml.average_precision(df, "y", "s").first()["average_precision"] <= 1


def test_stop_rules_and_dead_ends(spark):
    rows = spark.createDataFrame([(1, i, i in (0, 1), 10) for i in range(8)], "g int, i int, ok boolean, t int")
    r = sequence.stop_rules(rows, "ok", "t", ["i"], "g", 5, 100, 1000, 4, 0.3).first()
    assert (r["calls"], r["rule"]) == (5, "marginal_yield_decay_threshold_reached")
    traces = spark.createDataFrame([("a", i, o, s) for i, (o, s) in enumerate([("VALID_ACCEPT", "1"), ("X", "1"), ("X", "2"), ("X", "1")])], "v string, i int, outcome string, seed_id string")
    assert sequence.dead_ends(traces, ["i"], "v").first()["dead_end"] is True


def test_pairwise_means_are_selected_exactly():
    rng = np.random.default_rng(3)
    for trial in range(80):
        n = int(rng.integers(1, 90))
        d = [rng.standard_normal(n), rng.integers(-3, 4, n).astype(float), np.full(n, 1 / 3)][trial % 3]
        i, j = np.triu_indices(n)
        means = np.sort((np.sort(d)[i] + np.sort(d)[j]) / 2)
        for k in {1, len(means), len(means) // 2 + 1}:
            assert stats.pair_mean(np.sort(d), k) == pytest.approx(means[k - 1], abs=1e-12)
    assert stats.hodges_lehmann(np.arange(100_001.0))[0] == 50_000.0  # 5 * 10^9 pairs, never made


def test_bands_miss_next_to_nothing(spark):
    rng = np.random.default_rng(5)
    for n, threshold in ((100, 0.95), (10**6, 0.95), (10**9, 0.85)):
        bits, bands = dedup.bands_for(n, threshold)
        agree = 1 - math.acos(threshold) / math.pi
        assert (1 - agree**bits) ** bands <= 1.01e-9 and n / 2**bits <= 2 * dedup.CELL
    base = rng.standard_normal((40, 12))
    rows = [(i, (base[i % 40] + 0.05 * rng.standard_normal(12)).tolist()) for i in range(2500)]  # cells beyond one chunk
    rows += [(9000, rows[0][1]), (9001, None), (9002, [0.0] * 12), (9003, [float("nan")] * 12), (9004, [1.0] * 3)]
    got = {(r["a"], r["b"]) for r in dedup.cosine_pairs(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", 0.95).collect()}
    v = np.array([v for _, v in rows[:2500]])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    assert got == set(zip(a.tolist(), b.tolist()))


def test_null_model_and_folds(spark):
    rows = spark.createDataFrame([(i, i % 17, i % 2, [float(i % 2), 1.0]) for i in range(170)], "id long, g long, y int, v array<double>")
    judge = lambda train, test: ml.centroid_scores(train, test, "y", "v").withColumn("score", F.col("p"))
    judged = ml.cross_validated(rows, "g", "y", 5, judge)
    assert judged.count() == 170 and judged.groupBy("g").agg(F.countDistinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    assert {r["accuracy"] for r in ml.fold_metrics(judged, "y").collect()} == {1.0}
    found = ml.null_model(rows, "id", "g", "y", 5, judge).first()
    assert 0.2 < found["balanced_accuracy"] < 0.8 and found["warned"] == (found["balanced_accuracy"] > 0.55)
