import json

import pytest
from pyspark.sql import functions as F

from auditlake.functions import records as R


def one(spark, column, value=None):
    v = F.try_parse_json(F.lit(None if value is None else json.dumps(value)))
    return spark.range(1).select(v.alias("v")).select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(("v", "want"), [({"a": 1}, True), ({}, False), ("x", True), ("  ", False), ([1], False), (3, False), (None, False)])
def test_report_given(spark, v, want):
    assert one(spark, R.report_given, v) is want


def test_usage(spark):
    assert tuple(one(spark, R.usage, {"input_tokens": 3, "prompt_tokens": 0, "eval_count": "4"})) == (3, 4, 7)
    full = lambda v, p, a: tuple(one(spark, lambda x: R.usage_with_source(x, F.lit(p), F.lit(a)), v))
    assert full({"usage": {"total_tokens": 5}}, "", "") == (0, 0, 5, True, "provider")
    assert full({"tokens": 6}, "", "") == (0, 0, 6, True, "provider_fallback")
    assert full({}, "abcd", "abcdefgh") == (1, 2, 3, True, "estimated")
    assert full({}, "", "") == (0, 0, 0, False, "missing")
    assert spark.range(1).select(R.cost(F.lit("m"), F.lit(1_000_000), F.lit(500_000), {"m": (2.0, 4.0)})).first()[0] == 4.0


def test_compatibility(spark):
    found = lambda v: tuple(one(spark, R.compatibility, v))
    assert found({}) == ("PASS", True, 10.0, None, 0)
    assert found({"state": "CHECK_FAILED", "reason": "r"}) == ("CHECK_FAILED", False, 0.0, "r", 0)
    assert found({"pass": False, "compatibility_index": "7.5", "regressions": ["a", "b"]}) == ("FAIL", False, 7.5, None, 2)


def test_training_row(spark):
    row = one(spark, R.training_row, {"decision": "Accepted", "predicate": "p", "anchors_normalized": ["a", "b"], "seed": {"cve_id": " cve-1 "}})
    assert tuple(row) == ("Predicate: p | Code: a b", 1, "CVE-1")
    assert one(spark, R.training_row, {"decision": "rejected", "judge_eval": {"predicate": "see CVE-2020-12345"}, "input_block": "z"})["scenario_id"] == "CVE-2020-12345"
    assert one(spark, R.training_row, {"decision": "other", "predicate": "p"}) is None and one(spark, R.training_row, {"decision": "accepted"}) is None


def test_counts(spark):
    events = F.array(F.struct(F.lit("a").alias("usage_source")), F.struct(F.lit("a").alias("usage_source")), F.struct(F.lit(None).cast("string").alias("usage_source")))
    pick = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert pick(R.source_counts(events, F.lit(9), F.lit(1))) == {"a": 2, "unknown": 1}
    assert pick(R.source_counts(F.lit(None).cast("array<struct<usage_source:string>>"), F.lit(5), F.lit(2))) == {"estimated_or_provider": 3, "missing": 2}
    none = F.lit(None)
    assert pick(R.counted_as_accepted(none.cast("string"), F.lit("pass"), none.cast("boolean"))) is True
    assert pick(R.counted_as_accepted(F.lit("x"), none.cast("string"), F.lit(False))) is False
    assert pick(R.run_metadata(F.lit("r"), F.lit(1), "replay", "2024", {"j": "m"}, F.lit("s")))["models"] == {"j": "m"}
