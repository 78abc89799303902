"""Sources and sinks: JSON lines, JSON, CSV, manifests, ledgers, reports."""

from __future__ import annotations

import logging
import tomllib
import uuid
from pathlib import Path, PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

CORRUPT = "_corrupt"
_LOG = logging.getLogger(__name__)


class PathError(ValueError):
    """A path outside its root, or of a kind not allowed."""


def checked_path(path: str, root: str, suffixes: frozenset[str] | None = None) -> str:
    """The resolved path, if it lies within root and its suffix is allowed."""
    base, full = Path(root).resolve(), (Path(root) / path).resolve()
    if base != full and base not in full.parents:
        raise PathError(f"{path} is outside {root}")
    if suffixes is not None and full.suffix not in suffixes:
        raise PathError(f"{path} has none of the suffixes {sorted(suffixes)}")
    return str(full)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file system that Spark knows has the path."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


# -- JSON lines ----------------------------------------------------------------


def jsonl_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Every line has to be JSON of the schema; the first that is not fails the query. Blank lines are skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 1; blocks are numbered apart and put together by their line counts."""
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin")]
    lines = spark.read.text(path).select("value", *block, F.monotonically_increasing_id().alias("place"))
    within = Window.partitionBy("file", "begin").orderBy("place")
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file", "begin").agg(F.count("*").alias("n")).select("file", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.withColumn("k", F.row_number().over(within)).join(sizes, ["file", "begin"]).select("file", (F.col("before") + F.col("k")).alias("line"), "value")


def jsonl_strict_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, v): every line as a variant; one that is not JSON fails the query with its number. Blank lines are skipped."""
    lines = numbered_lines(spark, path).filter(T.filled("value"))
    wrong = F.raise_error(F.concat(F.lit("Invalid JSON on line "), F.col("line")))
    v = F.try_parse_json("value")
    return lines.select("file", "line", F.when(v.isNotNull(), v).otherwise(wrong.cast("variant")).alias("v"))


def jsonl_lenient(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines that are not JSON are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED", pathGlobFilter="*.jsonl" if not PurePosixPath(path).suffix else None)


def jsonl_counted(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All lines; _corrupt has those that are not a JSON object, to be counted."""
    full = StructType([*schema.fields]).add(CORRUPT, "string")
    return spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)


def malformed(rows: DataFrame) -> DataFrame:
    """rows (written or cached first, for the parser prunes columns) and malformed lines, counted."""
    return rows.agg(F.count_if(F.col(CORRUPT).isNull()).alias("rows"), F.count_if(F.col(CORRUPT).isNotNull()).alias("malformed"))


def jsonl_directory(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All .jsonl files of a folder as one table, with the file that each row is from."""
    return spark.read.schema(schema).json(path, pathGlobFilter="*.jsonl").withColumn("file", F.col("_metadata.file_name"))


def variant_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of any shape as variants; v is null where a line is not JSON."""
    return spark.read.text(path).filter(T.filled("value")).select(F.col("value").alias("line"), F.try_parse_json("value").alias("v"))


def at_path(v: Column | str, path: str, kind: str = "string") -> Column:
    """The value at a dotted path of a variant, null on any mismatch."""
    return F.try_variant_get(v, "$." + path, kind)


def spans_of_run(spans: DataFrame, run_id: str) -> DataFrame:
    return spans.filter(F.col("attributes.run_id") == run_id)


def json_document(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """A whole-file JSON document. A file that is missing gives no rows, unless strict."""
    if not strict and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST" if strict else "DROPMALFORMED")


# -- CSV and other files -------------------------------------------------------


def csv_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and quoted line breaks; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE")


def snippets(rows: DataFrame, language: str) -> DataFrame:
    """Non-empty snippets of one language."""
    return rows.filter(T.matches_language("language", language) & T.filled("code")).select("code", "language", "safety")


def digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, size) of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def verified_manifest(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Each declared artifact (name, sha256) with its state: ok, missing, changed or outside. Anything but ok fails it."""
    found = actual.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("actual"))
    state = F.when(F.contains("name", F.lit("..")) | F.col("name").startswith("/"), "outside").when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "ok").otherwise("changed")
    return declared.join(found, "name", "left").select("name", state.alias("state"))


def toml(path: str) -> dict:
    """A scenario file, on the driver."""
    with open(path, "rb") as f:
        return tomllib.load(f)


def baseline_state(spark: SparkSession, path: str | None, required: bool) -> str:
    """AVAILABLE, FIRST_RUN, BASELINE_MISSING or BASELINE_CORRUPTED."""
    if not path or not exists(spark, path):
        return "BASELINE_MISSING" if required else "FIRST_RUN"
    bad = spark.read.text(path, wholetext=True).filter(F.try_parse_json("value").isNull()).limit(1).count()
    return "BASELINE_CORRUPTED" if bad else "AVAILABLE"


# -- contracts -----------------------------------------------------------------

LANGUAGES, LEAST_CODE, MOST_CODE = ["c", "cpp", "c++"], 200, 12_000


def seed_error() -> Column:
    """The first thing wrong with a published seed (topic, predicate, language, anchors, gepa_info), or null."""
    info = F.col("gepa_info")
    return F.coalesce(
        F.when(~T.filled("topic"), "missing topic"),
        F.when(~T.filled("predicate"), "missing predicate"),
        F.when(F.col("anchors").isNull(), "missing anchors"),
        F.when(info.isNull(), "missing gepa_info"),
        F.when(~F.coalesce(F.lower("language").isin(LANGUAGES), F.lit(False)), "unsupported language"),
        F.when(~F.length("topic").between(LEAST_CODE, MOST_CODE), "topic length"),
        F.when(F.size(F.filter("anchors", T.filled)) < 1, "empty anchors"),
        F.when(~T.filled(info["predicate"]) | ~T.filled(info["uncertainty"]) | ~T.filled(info["proof_requirements"]), "incomplete gepa_info"),
        F.when(F.coalesce(F.size(info["evidence_hooks"]), F.lit(0)) < 1, "empty evidence_hooks"),
    )


def corpus_check(seeds: DataFrame, line: str, expected: int) -> DataFrame:
    """One row: rows, first error in line order, and whether the corpus is as it should be."""
    found = seeds.withColumn("e", seed_error()).agg(F.count("*").alias("rows"), F.min_by("e", F.when(F.col("e").isNotNull(), F.col(line))).alias("error"))
    return found.withColumn("valid", F.col("error").isNull() & (F.col("rows") == expected))


def purged(seeds: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """Seeds without reasons against them, and how many had some."""
    judged = seeds.withColumn("__r", reasons)
    return judged.filter(F.size("__r") == 0).drop("__r"), judged.agg(F.count_if(F.size("__r") > 0).alias("purged"))


# -- sinks ---------------------------------------------------------------------


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines; committed whole or not at all."""
    rows.write.mode("append").json(path)


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def recover(spark: SparkSession, path: str) -> None:
    """Puts back the table that a replacement had put aside when it was broken off."""
    fs, target = _hadoop(spark, path)
    _, aside = _hadoop(spark, path.rstrip("/") + ".old")
    if not fs.exists(target) and fs.exists(aside):
        fs.rename(aside, target)


def _replaced(spark: SparkSession, path: str, write) -> None:
    """What write(new path) makes, in place of the table at path: written whole beside it, then swapped by renames; the old one goes last."""
    path = path.rstrip("/")
    recover(spark, path)
    new = f"{path}.new-{uuid.uuid4().hex}"
    write(new)
    fs, target = _hadoop(spark, path)
    aside, fresh = _hadoop(spark, path + ".old")[1], _hadoop(spark, new)[1]
    fs.delete(aside, True)
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"cannot put aside {path}")
    if not fs.rename(fresh, target):
        raise OSError(f"cannot put {new} in place")
    fs.delete(aside, True)


def replace_json(rows: DataFrame, path: str) -> None:
    """A document or small table in one file, in place of the one before, which stays until the new one is whole."""
    _replaced(rows.sparkSession, path, lambda to: rows.coalesce(1).write.json(to))


def checkpoint(payload: DataFrame, path: str, version: int, now: str) -> None:
    """A versioned checkpoint table; a crash leaves the one before, which load_checkpoint finds."""
    full = payload.withColumn("schema_version", F.lit(version)).withColumn("updated_at", F.lit(now).cast("timestamp"))
    _replaced(payload.sparkSession, path, full.write.parquet)


def export_spans(spans: DataFrame, path: str) -> bool:
    """Adds spans to a folder of JSON lines. A sink that fails never fails its caller, which is told by False."""
    try:
        append_jsonl(spans, path)
    except Exception as error:  # whatever it is: tracing must not stop the work
        _LOG.warning("spans were not exported: %s", error)
        return False
    return True


def write_manifest(spark: SparkSession, folder: str, to: str, facts: dict[str, str | int]) -> None:
    """A manifest of a folder's files (name, sha256, size) with the run's facts, as one JSON row."""
    files = digests(spark, folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256", "size")
    listed = files.agg(F.array_sort(F.collect_list(F.struct("name", "sha256", "size"))).alias("artifacts"))
    replace_json(listed.select(*(F.lit(v).alias(k) for k, v in facts.items()), "artifacts"), to)


def start_expansion(baseline: DataFrame, path: str) -> None:
    """A seed file that begins with the baseline seeds; append_jsonl adds to it."""
    baseline.write.mode("overwrite").json(path)


def union_logs(*logs: DataFrame) -> DataFrame:
    """All rows of logs whose columns differ; what a log lacks is null."""
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def load_checkpoint(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The checkpoint, or an error where it is of another version."""
    recover(spark, path)
    found = spark.read.parquet(path)
    wrong = F.raise_error(F.concat(F.lit("checkpoint of version "), F.col("schema_version")))
    return found.withColumn("schema_version", F.when(F.col("schema_version") == version, F.col("schema_version")).otherwise(wrong.cast("int")))


def cached_answers(requests: DataFrame, store: DataFrame, replay: bool = False) -> DataFrame:
    """requests (hash, ...) with the stored response; in replay mode a miss fails."""
    joined = requests.join(store.select("hash", "response"), "hash", "left")
    if not replay:
        return joined
    miss = F.raise_error(F.concat(F.lit("no recorded response for "), F.col("hash")))
    return joined.withColumn("response", F.coalesce("response", miss.cast("string")))


def record_answers(answers: DataFrame, store: DataFrame) -> DataFrame:
    """The answers that the store does not have yet, once each; append them."""
    return answers.groupBy("hash").agg(F.min("response").alias("response")).join(store.select("hash"), "hash", "left_anti")


def synthetic_floor(rows: DataFrame, spare: DataFrame, least: int = 4) -> DataFrame:
    """rows, and the spare rows too where there are fewer than `least`."""
    few = rows.limit(least).agg((F.count("*") < least).alias("few"))
    return rows.unionByName(spare.crossJoin(F.broadcast(few)).filter("few").drop("few"))


def markdown(title: str, rows: DataFrame, most: int | None = None) -> str:
    """A report table, on the driver; its rows are a summary's, so few. With `most` it ends there and says how many rows more there are."""
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    cells = rows.select(*(F.coalesce(T.html_cell(F.col(c).cast("string")), F.lit("")).alias(c) for c in rows.columns))
    shown = cells if most is None else cells.limit(most)
    lines += ["| " + " | ".join(r) + " |" for r in shown.toLocalIterator()]
    if most is not None and (more := cells.count() - most) > 0:
        lines += ["", f"{more} rows more"]
    return "\n".join(lines) + "\n"
