"""Comparisons of two sides: overlays, deltas, regressions, verdicts, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """For each key its row with the largest order; rows without key go."""
    columns = [c for c in rows.columns if c != key]
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("r"))
    return best.select(key, "r.*")


def compared(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Every row of other with its base row's value and the delta; an inner join, base keys should be unique."""
    left = base.select(key, F.col(value).alias("base_value"))
    return other.join(left, key).withColumn("delta", F.col(value) - F.col("base_value"))


def overlay(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The union by key in which other's row replaces base's as a whole, nulls and all; null keys go."""
    columns = [c for c in base.columns if c != key]
    pack = lambda df, name: df.filter(F.col(key).isNotNull()).select(key, F.struct(*columns).alias(name))
    return pack(base, "b").join(pack(other, "o"), key, "full").select(key, F.coalesce("o", "b").alias("r")).select(key, "r.*")


def stage_deltas(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """All keys of either side, absent values as 0, with difference and speed-up in percent."""
    b, o = base.select(key, F.col(value).alias("b")), other.select(key, F.col(value).alias("o"))
    both = b.join(o, key, "full").select(key, F.coalesce("b", F.lit(0.0)).alias("baseline"), F.coalesce("o", F.lit(0.0)).alias("candidate"))
    diff = F.col("candidate") - F.col("baseline")
    return both.select("*", diff.alias("diff"), (-T.safe_div(diff * 100.0, F.col("baseline"))).alias("speedup_pct"))


def finite_pairs(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Pairs by key of which both values are finite, with their delta."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    both = base.select(key, F.col(value).cast("double").alias("b")).join(other.select(key, F.col(value).cast("double").alias("c")), key)
    return both.filter(fine("b") & fine("c")).withColumn("delta", F.col("c") - F.col("b"))


def ab_deltas(runs: DataFrame, run: str, baseline: str, candidate: str, *metrics: str) -> DataFrame:
    """One row a metric: both runs' values, the difference and its percentage."""
    pick = lambda who, m: F.max(F.when(F.col(run) == who, F.col(m).cast("double"))).alias(f"{m}__{who == candidate:d}")
    wide = runs.agg(*(pick(who, m) for m in metrics for who in (baseline, candidate)))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}__0").alias("baseline"), F.col(f"{m}__1").alias("candidate")) for m in metrics))
    long = wide.select(F.explode(rows).alias("x")).select("x.*")
    diff = F.col("candidate") - F.col("baseline")
    return long.select("*", diff.alias("diff"), T.safe_div(diff * 100.0, F.col("baseline")).alias("diff_pct"))


def suite_summary(tests: DataFrame, index: str, *properties: str) -> DataFrame:
    """Mean index, count, and means of the properties over the tests that have them."""
    return tests.agg(F.count("*").alias("tests"), F.coalesce(F.avg(index), F.lit(0.0)).alias("mean_index"), *(F.avg(p).alias(p) for p in properties))


def top_regressions(deltas: DataFrame, n: int, *ties: str) -> DataFrame:
    return deltas.filter("delta < 0").orderBy("delta", *ties).limit(n)


def drops(deltas: DataFrame, all_tests: DataFrame) -> DataFrame:
    """How many tests lost two points or more, and their share of all tests of the candidate."""
    lost = deltas.agg(F.count_if(F.col("delta") <= -fixed.DROP_POINTS).alias("dropped"))
    return lost.crossJoin(all_tests.agg(F.count("*").alias("tests"))).withColumn("share", T.safe_div(F.col("dropped"), F.col("tests")))


def suite_verdict(delta: Column, understandable: Column, maintainable: Column, share: Column, dropped: Column) -> Column:
    """The reasons against a suite; none means PASS."""
    return T.reasons(
        ("index_decreased", delta <= -fixed.FAIL_DELTA),
        ("understandable_dropped", understandable <= -fixed.FAIL_PROPERTY),
        ("maintainable_dropped", maintainable <= -fixed.FAIL_PROPERTY),
        ("tests_dropped", (dropped >= fixed.FAIL_DROPPED) & (share > fixed.FAIL_SHARE)),
    )


def review_verdict(units: DataFrame, severity: str, invalid_index: str, warn_limit: int) -> DataFrame:
    """FAIL for any BLOCK or invalid index; many warnings are a note only."""
    found = units.agg(
        F.count_if(F.col(severity) == "BLOCK").alias("block"), F.count_if(F.col(severity) == "WARN").alias("warn"),
        F.count_if(F.col(severity) == "OK").alias("ok"), F.count_if(F.col(invalid_index)).alias("invalid"),
    )
    bad = (F.col("block") > 0) | (F.col("invalid") > 0)
    return found.select("*", (F.col("warn") > warn_limit).alias("warned"), F.when(bad, "FAIL").otherwise("PASS").alias("verdict"))


def unified_verdict(lanes: DataFrame, failed: str) -> DataFrame:
    return lanes.agg(F.coalesce(F.bool_or(failed), F.lit(False)).alias("failed")).select(F.when(F.col("failed"), "FAIL").otherwise("PASS").alias("verdict"))


def signature_regressions(base: DataFrame, other: DataFrame) -> DataFrame:
    """(file_path, key, regression) between two sides of (file_path, key, type, params array<struct<name, kind, has_default>>).

    A symbol that is gone or of another type is one regression; functions on both
    sides are compared parameter by parameter. A deleted file loses all its symbols.
    """
    o = other.select("file_path", "key", F.col("type").alias("type2"), F.col("params").alias("params2"))
    both = base.join(o, ["file_path", "key"], "left")
    empty = F.array().cast(base.schema["params"].dataType)
    p, q = F.coalesce("params", empty), F.coalesce("params2", empty)
    names = lambda a: F.transform(a, lambda x: x["name"])
    placed = lambda a: names(F.filter(a, lambda x: x["kind"].isin("positional_only", "positional_or_keyword")))
    twin = lambda x: F.get(F.filter(q, lambda y: y["name"] == x["name"]), F.lit(0))
    own = F.transform(
        p,
        lambda x: F.when(~F.array_contains(names(q), x["name"]), F.concat(F.lit("removed:"), x["name"]))
        .when(twin(x)["kind"] != x["kind"], F.concat(F.lit("kind:"), x["name"]))
        .when(x["has_default"] & ~twin(x)["has_default"], F.concat(F.lit("default_removed:"), x["name"])),
    )
    added = F.transform(F.filter(q, lambda y: ~F.array_contains(names(p), y["name"]) & ~y["has_default"]), lambda y: F.concat(F.lit("added:"), y["name"]))
    kept_now = F.filter(placed(q), lambda n: F.array_contains(placed(p), n))
    kept_before = F.filter(placed(p), lambda n: F.array_contains(placed(q), n))
    upto = F.slice(placed(q), F.lit(1), F.greatest(F.array_position(placed(q), F.element_at(kept_now, -1)).cast("int") - 1, F.lit(0)))
    inserted = (F.size(kept_now) > 0) & F.exists(F.when(F.size(kept_now) > 0, upto).otherwise(F.array().cast("array<string>")), lambda n: ~F.array_contains(placed(p), n))
    order = F.when(kept_now != kept_before, F.array(F.lit("reordered"))).when(inserted, F.array(F.lit("inserted"))).otherwise(F.array().cast("array<string>"))
    found = (
        F.when(F.col("type2").isNull(), F.array(F.concat(F.lit("deleted_"), F.col("type"))))
        .when(F.col("type") != F.col("type2"), F.array(F.lit("type_changed")))
        .when(F.col("type") == "function", F.concat(F.array_compact(own), added, order))
    )
    return both.select("file_path", "key", F.explode(found).alias("regression"))


def compatibility_score(regressions: DataFrame, *by: str) -> DataFrame:
    return regressions.groupBy(*by).agg(F.count("*").alias("regressions")).withColumn("score", F.greatest(F.lit(0.0), 10.0 - 2.0 * F.col("regressions")))


def range_overlaps(ranges: DataFrame, points: DataFrame, key: str, start: str, stop: str, point: str, width: int = 64) -> DataFrame:
    """Ranges [start, stop] with the points of their key within; by buckets of `width`, so that each pair meets in one equi-join."""
    cells = F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(stop) / width)))
    left = ranges.withColumn("cell", cells)
    right = points.withColumn("cell", F.floor(F.col(point) / width))
    return left.join(right, [key, "cell"]).filter(F.col(point).between(F.col(start), F.col(stop))).drop("cell")


def diff_lines(diff: DataFrame, doc: str, line_no: str, line: str) -> DataFrame:
    """(doc, file, line) of the changed lines of unified diffs without context; a count of 0 stands for its start."""
    text = F.col(line)
    order = Window.partitionBy(doc).orderBy(line_no)
    with_file = diff.withColumn("file", F.last(F.when(text.startswith("+++ b/"), F.substring(text, 7, 1 << 20)), ignorenulls=True).over(order))
    hunk = F.regexp_extract(text, r"^@@ \S+ \+(\d+)(?:,(\d+))?", 1).try_cast("int")
    count = F.coalesce(F.regexp_extract(text, r"^@@ \S+ \+(\d+),(\d+)", 2).try_cast("int"), F.lit(1))
    return with_file.filter(hunk.isNotNull() & F.col("file").isNotNull()).select(doc, "file", F.explode(F.sequence(hunk, hunk + F.greatest(count, F.lit(1)) - 1)).alias("line"))


def deleted_file_regressions(base: DataFrame, other: DataFrame) -> DataFrame:
    """(file_path, key, regression): every symbol of base whose whole file is gone from other."""
    gone = base.join(other.select("file_path").distinct(), "file_path", "left_anti")
    return gone.select("file_path", "key", F.concat(F.lit("deleted_"), F.col("type")).alias("regression"))


def touched_units(units: DataFrame, changed: DataFrame) -> DataFrame:
    """units (file_path, start, end, ...) that a changed range (file_path, low, high) meets; units without line numbers are kept."""
    c = changed.select(F.col("file_path").alias("__path"), "low", "high")
    met = (F.col("file_path") == F.col("__path")) & (F.col("start") <= F.col("high")) & (F.col("end") >= F.col("low"))
    return units.filter("start IS NULL OR end IS NULL").unionByName(units.filter("start IS NOT NULL AND end IS NOT NULL").join(c, met, "left_semi"))
