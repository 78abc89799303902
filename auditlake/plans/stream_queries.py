"""Stream operators run over the tables as streams; their results are those of the batch queries, and so is their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup
from ..sources.shared import fresh_path
from ..streaming import stateful
from ..streaming.versions import KeysOnce, LatestStatus
from . import adapters as A
from .registry import ORACLE_SQL, query


def streamed(spark, sf_dir, name):
    """A table, be it one file or a folder, as a stream of its files; only a pattern may be a file."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[t]")


def _result(spark, stream, tag, each=lambda batch: batch):
    out = fresh_path(spark, tag)
    stateful.drained(stream, out, fresh_path(spark, f"{tag}-checkpoint"), each)
    return spark.read.parquet(out).drop("epoch")


@query(ORACLE_SQL["stop_rule_first_fire"])
def stream_stop_rules(spark, sf_dir):
    """The first stop rule that fires for each seed, from the events as a stream."""
    a = A.attempts_of(streamed(spark, sf_dir, "events")).withColumn("ok", F.col("decision") == "accepted")
    fired = stateful.stop_rules_in_order(a, "ok", "total_tokens", "ts", "event_id", "seed", 6, 40, 1500, 5, 0.15, late="0 seconds")
    return _result(spark, fired, "stop-rules").select("seed", "calls", "rule", "accepted", "tokens")


@query(ORACLE_SQL["duplicate_tiers"])
def stream_duplicate_tiers(spark, sf_dir):
    """The tier by which each snippet of a stream repeats one that the stream has made known."""
    d = streamed(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = F.array(
        F.struct("doc_id", "text", (F.col("doc_id") % 2 == 0).alias("known")),
        F.when(F.col("doc_id") % 7 == 0, F.struct((F.col("doc_id") + 1000000).alias("doc_id"), F.concat("text", F.lit(" one more word")).alias("text"), F.lit(False).alias("known"))),
        F.when(F.col("doc_id") % 10 == 0, F.struct((F.col("doc_id") + 2000000).alias("doc_id"), F.replace("text", F.lit(" "), F.lit("  ")).alias("text"), F.lit(False).alias("known"))),
    )
    rows = d.select(F.explode(F.array_compact(kinds)).alias("r")).select("r.*")
    path = fresh_path(spark, "fingerprints")
    texts = stateful.filed(stateful.fingerprints(rows, "doc_id", "text", "known"), path, fresh_path(spark, "fingerprints-checkpoint"))
    counts = dedup.shingle_counts(spark.read.schema(texts.schema).parquet(path).select(F.col("shingles").alias("s")))
    found = stateful.evidence(texts, 0.85, counts=counts)
    return _result(spark, found, "tiers", stateful.settled).select(F.col("row_id").cast("long").alias("doc_id"), "tier")


def _epochs(spark, sf_dir):
    """The events in four batches, the third of which runs twice."""
    e = A.table(spark, sf_dir, "events")
    return [(k, e.filter(F.col("event_id") % 4 == k)) for k in (0, 1, 2, 2, 3)]


@query("SELECT user_id, min(event_id % 4)::INT AS epoch FROM events GROUP BY user_id")
def keys_once_sink(spark, sf_dir):
    """The users of the events, each written once, by the first batch that has it."""
    out = fresh_path(spark, "keys-once")
    sink = KeysOnce(spark, out, "user_id", rows_a_bucket=100_000, every=2)
    for epoch, batch in _epochs(spark, sf_dir):
        sink(batch.select("user_id"), epoch)
    return spark.read.parquet(out).select("user_id", F.col("epoch").cast("int").alias("epoch"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_status_sink(spark, sf_dir):
    """Each user's latest event, upserted batch after batch."""
    sink = LatestStatus(spark, fresh_path(spark, "latest-status"), "user_id", "event_id", rows_a_bucket=100_000, every=2)
    for epoch, batch in _epochs(spark, sf_dir):
        sink(batch.select("user_id", "event_id", "event_type"), epoch)
    return sink.statuses().select("user_id", "event_id", "event_type")
