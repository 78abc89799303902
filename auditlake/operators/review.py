"""Review units: what validation did to their fields, their terminal states, lanes and averages.

A unit: file_path, review (struct), raw (struct as it came), fields (array of
struct<field_name, status, repair_type>), repaired, normalized (boolean),
provider_error (boolean), structured_output (struct<invalid_json_detected,
repair_attempts, repair_succeeded, validation_retries, final_failure>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T

_NONE = "array<struct<field_name:string,status:string,repair_type:string>>"


def _mark(name: Column | str, status: Column | str, repair: Column | str | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(lit(name).alias("field_name"), lit(status).alias("status"), lit(repair).alias("repair_type"))


def dimension_fields(raw: Column, *dimensions: str) -> Column:
    """What became of raw scores (strings) and rationales of a struct of dimensions."""
    marks = []
    for d in dimensions:
        score, number = raw[d]["score"], raw[d]["score"].try_cast("double")
        said = raw[d]["rationale"]
        marks += [
            F.when(raw[d].isNotNull() & score.isNotNull(), F.when(number.isNull(), _mark(f"{d}.score", "INVALID")).when((number > 10) & (number <= 100), _mark(f"{d}.score", "REPAIRED", "scaled_percentage"))),
            F.when(raw[d].isNotNull() & (said.isNull() | (T.strip(said) != said)), _mark(f"{d}.rationale", "NORMALIZED")),
        ]
    return F.array_compact(F.array(*marks)).cast(_NONE)


def finding_fields(findings: Column) -> Column:
    """What became of the texts, confidence and path of raw findings (all strings), with their index in the name."""

    def of(f: Column, i: Column) -> Column:
        name = lambda field: F.concat(F.lit("findings["), i.cast("string"), F.lit(f"].{field}"))
        ragged = lambda c: c.isNotNull() & (T.strip(c) != c)
        marks = [F.when(f[c].isNull() | ragged(f[c]), _mark(name(c), "NORMALIZED")) for c in ("engineering_rationale", "engineering_consequence", "recommended_action")]
        principle, confidence, path = f["reference_principle"], f["confidence"], f["evidence"]["path"]
        marks.append(F.when(principle.isNull(), _mark(name("reference_principle"), "REPAIRED", "missing_default")).when(ragged(principle), _mark(name("reference_principle"), "NORMALIZED")))
        word = F.upper(T.strip(confidence)).isin("LOW", "MEDIUM", "HIGH")
        marks.append(
            F.when(confidence.isNull(), _mark(name("confidence"), "REPAIRED", "missing_default"))
            .when(word & (confidence != T.confidence(confidence)), _mark(name("confidence"), "NORMALIZED"))
            .when(~word, _mark(name("confidence"), "REPAIRED", "type_coercion"))
        )
        marks.append(F.when(path.isNotNull() & (T.evidence_path(path) != path), _mark(name("evidence.path"), "NORMALIZED")))
        return F.array_compact(F.array(*marks)).cast(_NONE)

    return F.coalesce(F.flatten(F.transform(findings, of)), F.array().cast(_NONE))


def terminal_state(unit: Column) -> Column:
    """The one state a unit ends in: invalid, repaired, normalized or valid."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    bad = F.exists(F.coalesce(unit["fields"], F.array().cast(_NONE)), lambda f: f["status"] == "INVALID")
    return (
        F.when(yes(unit["provider_error"]) | yes(unit["structured_output"]["final_failure"]) | yes(bad), "invalid")
        .when(yes(unit["repaired"]), "repaired").when(yes(unit["normalized"]), "normalized").otherwise("valid")
    )


def validation_summary(units: DataFrame, *by: str) -> DataFrame:
    """States of units and kinds of touched fields, counted; fields of failed units do not count."""
    unit = F.struct("fields", "repaired", "normalized", "provider_error", "structured_output")
    state = terminal_state(unit)
    failed = F.coalesce(F.col("provider_error"), F.lit(False)) | F.coalesce(F.col("structured_output.final_failure"), F.lit(False))
    kept = F.when(~failed, F.coalesce("fields", F.array().cast(_NONE))).otherwise(F.array().cast(_NONE))
    name = lambda f, part: F.contains(f["field_name"], F.lit(part))
    repaired = lambda f: f["status"] == "REPAIRED"
    count = lambda test: F.sum(F.size(F.filter("kept", test)))
    rows = units.withColumn("state", state).withColumn("kept", kept)
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"),
        *(F.count_if(F.col("state") == s).alias(s) for s in ("valid", "repaired", "normalized", "invalid")),
        count(lambda f: repaired(f) & name(f, "confidence")).alias("repaired_confidence"),
        count(lambda f: repaired(f) & ~name(f, "confidence") & name(f, "score")).alias("repaired_score"),
        count(lambda f: repaired(f) & ~name(f, "confidence") & ~name(f, "score") & (f["repair_type"] == "missing_default")).alias("repaired_default"),
        count(lambda f: repaired(f) & ~name(f, "confidence") & ~name(f, "score") & (f["repair_type"] == "dropped_invalid_finding")).alias("dropped_findings"),
        count(lambda f: (f["status"] == "NORMALIZED") & name(f, "path")).alias("normalized_path"),
        count(lambda f: (f["status"] == "NORMALIZED") & ~name(f, "path")).alias("normalized_text"),
        count(lambda f: f["status"] == "INVALID").alias("invalid_fields"),
        F.count_if(F.coalesce("provider_error", F.lit(False))).alias("provider_failures"),
        F.sum(F.coalesce("structured_output.repair_attempts", F.lit(0))).alias("repair_attempts"),
        F.sum(F.coalesce("structured_output.validation_retries", F.lit(0))).alias("retries"),
        F.count_if(F.coalesce("structured_output.final_failure", F.lit(False))).alias("final_failures"),
    )


def lane_states(summary: DataFrame) -> DataFrame:
    """PASS, WARN or FAIL of the structured-output, repair and provider lanes of a validation_summary."""
    c = F.col
    touched = sum((c(x) for x in ("repaired_confidence", "repaired_score", "repaired_default", "dropped_findings", "invalid_fields")), F.lit(0)) > 0
    return summary.select(
        F.when((c("final_failures") > 0) | (c("invalid") > 0), "FAIL").otherwise("PASS").alias("structured_output"),
        F.when(touched, "WARN").otherwise("PASS").alias("repairs"), F.when(c("provider_failures") > 0, "FAIL").otherwise("PASS").alias("provider"),
    )


def coverage(extracted: Column, reviewed: Column) -> Column:
    skipped = F.greatest(extracted - reviewed, F.lit(0))
    return F.struct(skipped.alias("skipped"), F.when((skipped == 0) & (reviewed <= extracted), "PASS").otherwise("WARN").alias("state"))


def average_index(units: DataFrame, index: str, recoverable: str) -> DataFrame:
    """The mean index of the units (index: struct of text.cqi) that did not fail recoverably; any invalid one fails all."""
    kept = ~F.coalesce(F.col(recoverable), F.lit(False))
    found = units.agg(
        F.count("*").alias("units"), F.count_if(~kept).alias("recoverable"), F.count_if(kept & ~F.col(f"{index}.valid")).alias("invalid"), F.avg(F.when(kept, F.col(f"{index}.value"))).alias("mean")
    )
    state = F.when(F.col("units") == F.col("recoverable"), "PASS").when(F.col("invalid") > 0, "FAIL").otherwise("PASS")
    return found.select("units", "recoverable", "invalid", F.when(F.col("invalid") == 0, F.col("mean")).alias("mean_index"), state.alias("state"))


def findings_with_marks(units: DataFrame, key: str) -> DataFrame:
    """Every finding of a unit with what validation did to its confidence: a join by the index in the field's name."""
    found = units.select(key, F.posexplode("findings").alias("place", "finding"))
    marks = units.select(key, F.explode("fields").alias("f")).select(key, F.regexp_extract("f.field_name", r"^findings\[(\d+)\]\.confidence$", 1).try_cast("int").alias("place"), "f.status", "f.repair_type")
    return found.join(marks.filter("place IS NOT NULL"), [key, "place"], "left")


def empty_summaries(units: DataFrame, summary: str) -> DataFrame:
    return units.agg(F.count_if(~T.filled(summary)).alias("empty"))


def test_index(breakdown: Column) -> Column:
    """The unweighted mean of the eight property scores."""
    return sum((breakdown[p]["score"].cast("double") for p in fixed.SCORE_PROPERTIES), F.lit(0.0)) / len(fixed.SCORE_PROPERTIES)


def unit_name(path: Column, class_name: Column, name: Column) -> Column:
    return F.concat_ws("::", path, class_name, name)


def merged_diagnostics(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """A unit's structured-output diagnostics over its attempts: flags hold once set, repairs add up, retries and the final failure are the last attempt's."""
    c = F.col
    last = F.max_by(F.struct("validation_retries", "final_failure"), c(order))
    reason = F.max_by(c("failure_reason"), F.when(T.filled("failure_reason"), c(order)))
    found = attempts.groupBy(key).agg(
        F.coalesce(F.bool_or("invalid_json_detected"), F.lit(False)).alias("invalid_json_detected"), F.coalesce(F.sum("repair_attempts"), F.lit(0)).alias("repair_attempts"),
        F.coalesce(F.bool_or("repair_succeeded"), F.lit(False)).alias("repair_succeeded"), last.alias("last"), reason.alias("failure_reason"),
    )
    return found.select(
        key, "invalid_json_detected", "repair_attempts", "repair_succeeded", F.coalesce("last.validation_retries", F.lit(0)).alias("validation_retries"),
        F.coalesce("last.final_failure", F.lit(False)).alias("final_failure"), "failure_reason",
    )
