"""Exact deduplication against a persistent digest index.

The index is a table partitioned by batch, bucketed and sorted by the SHA-256 of the
text. A batch is reduced to its digests and deduplicated by a sort-merge anti-join
with the index, which needs no exchange on the index's side; what is new is appended
as the batch's partition, with a count for each text that came again. A batch that
runs again under its name replaces its own partition and nothing else, so a retry is
safe. DataFrame operations only.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_keyed, make_path, new_path, text_or_empty, written

#: Digests for which one bucket of a new index is planned.
DIGESTS_A_BUCKET = 4_000_000


class DigestIndex:
    """The persistent index. Its log has digest binary, keep_id long (null: the text was known), seen long, batch string."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        """Opens the index at path, or begins one there. An index that is there keeps the number of buckets that it was begun with."""
        self.spark, self.path = spark, path
        self.table = f"digest_index_{uuid.uuid4().hex}"
        try:
            self.buckets = spark.read.schema("buckets int").parquet(f"{path}.meta").first()["buckets"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            self.buckets = buckets
            spark.range(1).select(F.lit(buckets).alias("buckets")).coalesce(1).write.parquet(f"{path}.meta")
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, seen BIGINT, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        make_path(spark, path)
        spark.catalog.recoverPartitions(self.table)

    def log(self) -> DataFrame:
        return self.spark.table(self.table)

    def rows(self, but: str | None = None) -> DataFrame:
        """(digest, keep_id, seen): one row for each text ever kept, without what the batch `but` added."""
        log = self.log() if but is None else self.log().filter(F.col("batch") != but)
        return log.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("seen").alias("seen"))

    def put(self, batch: str, rows: DataFrame) -> None:
        """Sets what a batch has added: rows (digest, keep_id, seen), one file a bucket."""
        setting = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "dynamic")
        try:
            rows.select("digest", "keep_id", "seen", F.lit(batch).alias("batch")).repartition(self.buckets, "digest").write.insertInto(self.table, overwrite=True)
        finally:
            self.spark.conf.set(setting, before)

    def close(self) -> None:
        """Takes the table out of the session's catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _judged(docs: DataFrame, index: DigestIndex | None, batch: str | None, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int, DigestIndex]:
    """The batch's rows, its texts with what becomes of them, how many rows there are, and the index."""
    spark = docs.sparkSession
    thin = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "exact-thin",
    )
    n_rows = thin.count()
    if index is None:
        index = DigestIndex(spark, new_path(spark, "digest-index"), max(16, -(-n_rows // DIGESTS_A_BUCKET)))
    batch = batch or uuid.uuid4().hex
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "row_no"))
    texts = written(
        thin.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))
        .select("digest", F.col("best.doc_id").alias("batch_keep"), F.col("best.row_no").alias("keep_row"), "n"),
        "exact-batch",
    )
    known = index.rows(but=batch)
    fresh = texts.join(known.hint("merge"), "digest", "left_anti").select(
        "digest", F.col("batch_keep").alias("keep_id"), F.lit(True).alias("is_new"), "keep_row", "n", F.col("n").alias("group_size")
    )
    again = texts.join(known.hint("merge"), "digest").select(
        "digest", "keep_id", F.lit(False).alias("is_new"), F.lit(None).cast("long").alias("keep_row"), "n", (F.col("n") + F.col("seen")).alias("group_size")
    )
    verdict = written(fresh.unionByName(again), "exact-verdict")
    index.put(batch, verdict.select("digest", F.when(F.col("is_new"), F.col("keep_id")).alias("keep_id"), F.col("n").alias("seen")))
    return thin, verdict, n_rows, index


def _rows(thin: DataFrame, verdict: DataFrame, n_rows: int, id_col: str) -> DataFrame:
    return join_keyed(thin, verdict, "digest", "n", n_rows).select(
        F.col("doc_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of the equal texts of a
    batch the row with the largest id stays, unless the index knows the text: then
    none stays and keep_id is the one kept earlier. group_size counts this batch and
    what the index saw before. A null id is smaller than every other; of rows that
    repeat an id with the same text exactly one stays. Other columns are ignored. An
    empty table gives no rows. The batch is added to the index under its name; a
    batch that runs again under the same name gives the same rows.
    """
    thin, verdict, n_rows, used = _judged(docs, index, batch, id_col, text_col)
    if index is None:
        used.close()
    return _rows(thin, verdict, n_rows, id_col)


def dedup_batches(batches: dict[str, DataFrame], index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of exact_dedup for named batches that go through one index in turn, with group_size over all that the index has seen in the end."""
    done = [_judged(docs, index, name, id_col, text_col)[:3] for name, docs in batches.items()]
    totals = written(index.rows().select("digest", F.col("seen").alias("group_size")), "exact-totals")
    found = None
    for thin, verdict, n_rows in done:
        own = verdict.drop("group_size").join(totals.hint("merge"), "digest")
        rows = _rows(thin, own, n_rows, id_col)
        found = rows if found is None else found.unionByName(rows)
    return found


def falling_batches(docs: DataFrame, parts: int = 2, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """docs cut by id into batches of about equal size, the largest ids first and rows without id last.

    Sent through an index in this order, the row with the largest id of all stays.
    """
    cuts = sorted(set(docs.approxQuantile(id_col, [k / parts for k in range(1, parts)], 0.01)), reverse=True)
    key, out, above = F.col(id_col), {}, None
    for low in [*cuts, None]:
        own = F.lit(True) if low is None else key >= low
        if above is not None:
            own = own & (key < above)
        out[f"batch-{len(out)}"] = docs.filter(own if low is not None else F.coalesce(own, F.lit(True)))
        above = low
    return out
