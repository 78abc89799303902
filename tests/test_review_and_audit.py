import math

from pyspark.sql import functions as F

from auditlake.operators import audit, review


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_finding_fields(spark):
    f = lambda **k: F.struct(*(F.lit(k.get(c)).cast("string").alias(c) for c in ("engineering_rationale", "engineering_consequence", "recommended_action", "reference_principle", "confidence")), F.struct(F.lit(k.get("path")).cast("string").alias("path")).alias("evidence"))
    full = dict(engineering_rationale="a", engineering_consequence="b", recommended_action="c", reference_principle="d", confidence="HIGH", path="x.py")
    marks = lambda **k: [(m["field_name"], m["status"], m["repair_type"]) for m in one(spark, review.finding_fields(F.array(f(**full | k))))]
    assert marks() == []
    assert marks(confidence="90%") == [("findings[0].confidence", "REPAIRED", "type_coercion")]
    assert marks(confidence=" high") == [("findings[0].confidence", "NORMALIZED", None)]
    assert marks(confidence=None, path="/x.py") == [("findings[0].confidence", "REPAIRED", "missing_default"), ("findings[0].evidence.path", "NORMALIZED", None)]
    assert marks(engineering_rationale=" a", reference_principle=None) == [("findings[0].engineering_rationale", "NORMALIZED", None), ("findings[0].reference_principle", "REPAIRED", "missing_default")]


def test_invariants(spark):
    names = "accepted logic_errors anchor_match_rate strict_fail_rate parse_ok_rate leaks reduction_pct duplicate_rate identity_coverage parse_coverage signature_coverage uptake triage_gain".split()
    good = spark.createDataFrame([(3, 0, 0.9, 0.1, 0.99, 0, 30.0, 0.1, 1.0, 0.7, 0.6, 0.4, 0.2)], names)
    assert all(r["passed"] for r in audit.invariants(good).collect())
    bad = good.withColumn("leaks", F.lit(1)).withColumn("uptake", F.lit(None).cast("double"))
    assert [r["id"] for r in audit.invariants(bad).collect() if not r["passed"]] == ["INV-4", "INV-8"]


def test_swarm_columns(spark):
    n = lambda x: F.lit(x).cast("double")
    assert one(spark, audit.accepts_per_million(n(10), n(1_000_000))) == 10.0 and one(spark, audit.accepts_per_million(n(0), n(0))) == 0.0
    assert math.isinf(one(spark, audit.tokens_per_accept(n(0), n(5)))) and one(spark, audit.tokens_per_accept(n(2), n(5))) == 2.5
    assert one(spark, audit.relative_improvement(n(0), n(5))) is None and one(spark, audit.relative_improvement(n(4), n(math.inf))) == -1.0
    assert one(spark, audit.triage_gain(n(1), n(4))) == 0.75 and one(spark, audit.triage_gain(n(1), n(0))) is None
    route = lambda a, b, r, p, ok=True, bad=False: one(spark, audit.yield_route(n(a), n(b), n(r), n(p), F.lit(ok), F.lit(bad)))
    assert route(5, 10, 0, 0) == "PRIMARY_ACCEPTANCE_GATE" and route(4, 10, 99, 0.8) == "SECONDARY_ADVISORY_TRIAGE_LANE"
    assert route(4, 0, 9, 0.1) == "REJECTED_LOW_PRECISION_AND_YIELD" and route(9, 1, 99, 1, ok=False) == "REJECTED_ANTI_GAMING_INVARIANT"
    assert one(spark, audit.canonical_identity(F.lit(" s "), F.lit("f"), F.lit("K "))) == "s\x1fF\x1fk"
    assert one(spark, audit.success_probability(n(0))) == 0.5
    assert one(spark, audit.with_constraint(F.array(F.lit("a")), F.lit("a"))) == ["a"]


def test_findings_with_marks(spark):
    units = spark.createDataFrame([(1, ["f0", "f1"], [("findings[1].confidence", "REPAIRED", "x"), ("summary", "NORMALIZED", None)])], "k int, findings array<string>, fields array<struct<field_name:string,status:string,repair_type:string>>")
    assert sorted((r["place"], r["status"]) for r in review.findings_with_marks(units, "k").collect()) == [(0, None), (1, "REPAIRED")]
