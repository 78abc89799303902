"""The corpus pipeline: classifier, line dedup, near-duplicate removal, repeat removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import line_dedup, ngram_join, packing, quality, suffix_dedup
from auditlake.llm.common import small_batches, written
from auditlake.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, handed to Python in small batches."""
    small_batches(docs.sparkSession)
    return docs.select(*COLUMNS)


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(_columns(docs), labels).filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document with a smaller id holds go."""
    return _with_text(line_dedup.line_dedup(_columns(docs)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that links of similarity 0.8 or more join, the one with the smallest id stays; rows without id come last.

    Where some rows repeat an id or have none, rows are labelled by a number of their own, so that each counts by its text.
    """
    docs = _columns(docs)
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        rows = docs.withColumn("row", F.col("doc_id"))
    else:
        rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "near-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text", "lang", "source"), "row")
    labels = ngram_join.jaccard_components(rows, words=5, percent=80, id_col="row").select("row", "component_id")
    first = rows.select("row", order.alias("place")).join(labels.hint("merge"), "row").groupBy("component_id").agg(F.min("place").alias("place"))
    stay = first.select(F.col("place.row").alias("row"))
    return rows.join(stay.hint("merge"), "row", "left_semi").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a string of 400 bytes or of 51 words that starts elsewhere too go; a character cut in two goes whole."""
    found = suffix_dedup.suffix_dedup(_columns(docs), least=400, words=51)
    return _with_text(found.withColumn("text", F.col("kept_text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    return packing.pack(_columns(docs), tokenizer(), capacity=4096)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("best-fit packing", pack),
]

#: Scores and bins are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}") if k < len(STAGES) - 1 else stage(spark, docs, sf_dir)
    return docs
