"""Idempotent sinks and status upserts over many versions."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from auditlake.streaming.versions import KeysOnce, LatestStatus, Versions

SCHEMA = "k string, at int, s string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_keys_once_over_many_epochs(spark, tmp_path):
    rng = random.Random(9)
    sink = KeysOnce(spark, str(tmp_path / "out"), "k", rows_a_bucket=20, every=3)
    first = {}
    for epoch in range(9):
        rows = [(f"k{rng.randrange(120)}", epoch, "x") for _ in range(25)] + [(None, epoch, "n")]
        sink(batch(spark, rows), epoch)
        if epoch in (2, 5):  # runs again, with rows dealt otherwise
            sink(batch(spark, rows[::-1]), epoch)
        for k, *_ in rows:
            first.setdefault(k, epoch)
    got = spark.read.parquet(str(tmp_path / "out")).select("k", "epoch").collect()
    assert sorted(((r["k"], r["epoch"]) for r in got), key=repr) == sorted(first.items(), key=repr)
    assert sink.index.snapshot().buckets > 1


def test_what_a_batch_reads_does_not_grow_with_the_output(spark, tmp_path):
    sink = KeysOnce(spark, str(tmp_path / "out"), "k", rows_a_bucket=50, every=1)
    read = []
    for epoch, n in enumerate([500, 500, 2000, 2000, 1]):
        rows = spark.range(10_000 * epoch, 10_000 * epoch + n).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("at"), F.lit("s").alias("s"))
        sink(rows, epoch)
        small = batch(spark, [("3", 1, "s"), ("20007", 1, "s")])
        known = sink.known(small, epoch + 1)
        recent = sum(spark.read.parquet(p).count() for _, p in sink.index.snapshot(epoch + 1).epochs)
        read.append(known.count() - recent)
    assert read[-1] <= 4 * 50 and max(read) <= 4 * 50  # two buckets of the base, though it has grown tenfold


def test_a_version_that_was_not_committed_does_not_count(spark, tmp_path):
    sink = KeysOnce(spark, str(tmp_path / "out"), "k")
    sink(batch(spark, [("a", 1, "x")]), 0)
    sink(batch(spark, [("b", 1, "x")]), 1)
    os.remove(tmp_path / "out" / "_keys" / "epoch-1" / "_SUCCESS")  # broken off
    assert [e for e, _ in sink.index.snapshot().epochs] == [0]
    sink(batch(spark, [("b", 1, "x"), ("a", 1, "x")]), 1)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_latest_status_with_compaction_and_snapshots(spark, tmp_path):
    rng = random.Random(10)
    sink = LatestStatus(spark, str(tmp_path / "status"), "k", "at", rows_a_bucket=10, every=2)
    want, kept = {}, None
    for epoch in range(8):
        rows = [(f"k{rng.randrange(30)}", rng.randrange(50), f"{epoch}-{i}") for i in range(12)]
        rows = list({(k, at): (k, at, s) for k, at, s in rows}.values())
        sink(batch(spark, rows), epoch)
        sink(batch(spark, rows), epoch)
        for k, at, s in rows:
            if k not in want or (at, epoch) >= want[k][:2]:
                want[k] = (at, epoch, s)
        assert {r["k"]: (r["at"], r["s"]) for r in sink.statuses().collect()} == {k: (at, s) for k, (at, _, s) in want.items()}
        if epoch == 5:
            kept = (sink.versions.snapshot(), dict(want))
    assert {r["k"]: r["s"] for r in sink.statuses(kept[0]).collect()} == {k: s for k, (_, _, s) in kept[1].items()}  # as it was then
    assert len(os.listdir(tmp_path / "status")) < 9 and sink.versions.snapshot().buckets > 1


def test_compaction_that_breaks_off(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"), 2)
    for epoch in range(3):
        versions.write(batch(spark, [(f"k{epoch}", epoch, "s")]), epoch)
    assert versions.compact("k", before=2).upto == 1
    shutil.rmtree(tmp_path / "v" / "epoch-0")  # gone with the vacuum of a base
    assert versions.read(versions.snapshot()).count() == 3
    os.remove(next((tmp_path / "v").glob("base-1-*")) / "_SUCCESS")
    with pytest.raises(AssertionError):  # without a committed base the lost epoch shows
        assert versions.read(versions.snapshot()).count() == 3
