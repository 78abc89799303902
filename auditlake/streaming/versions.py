"""Tables that stream batches write in versions: a base and the epochs since, with compaction, fixed snapshots and idempotent batches.

A version is a folder that counts once its writer has committed it (`_SUCCESS`). An
epoch that runs again replaces its own folder. Compaction writes a new base of all
epochs up to one that is over; what a reader has resolved before stays readable until
`vacuum`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Snapshot:
    """The folders that made up a table when they were listed: a base (or none), its number of buckets, and the epochs after it."""

    base: str | None
    upto: int
    buckets: int
    epochs: tuple[tuple[int, str], ...]

    @property
    def paths(self) -> list[str]:
        return ([self.base] if self.base else []) + [p for _, p in self.epochs]


class Versions:
    """The versions under a path. rows_a_bucket: about how many rows of the base a bucket of key hashes holds."""

    def __init__(self, spark: SparkSession, path: str, rows_a_bucket: int = 1_000_000):
        self.spark, self.path, self.rows_a_bucket = spark, path.rstrip("/"), rows_a_bucket

    def _files(self):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _committed(self) -> list[str]:
        files, target = self._files()
        if not files.exists(target):
            return []
        names = [str(s.getPath().getName()) for s in files.listStatus(target)]
        done = lambda n: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return [n for n in names if re.fullmatch(r"epoch-\d+|base-\d+-\d+", n) and done(n)]

    def snapshot(self, before: int | None = None) -> Snapshot:
        """What is there now, of epochs before one if given."""
        names = self._committed()
        ok = lambda e: before is None or e < before
        bases = [(int(m[1]), int(m[2]), n) for n in names if (m := re.fullmatch(r"base-(\d+)-(\d+)", n)) and ok(int(m[1]))]
        upto, buckets, base = max(bases, default=(-1, 1, None))
        epochs = sorted((int(n[6:]), f"{self.path}/{n}") for n in names if n.startswith("epoch-") and upto < int(n[6:]) and ok(int(n[6:])))
        return Snapshot(f"{self.path}/{base}" if base else None, upto, buckets, tuple(epochs))

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/epoch-{epoch}")

    def read(self, at: Snapshot, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a snapshot, with the epoch that wrote them (-1 in the base); of the base only some buckets if given. None: no versions."""
        found = None
        for epoch, path in [(-1, at.base)] * bool(at.base) + list(at.epochs):
            rows = self.spark.read.parquet(path)
            if epoch == -1:
                rows = rows if buckets is None else rows.filter(F.col("__bucket").isin(buckets))
                rows = rows.drop("__bucket")
            rows = rows.withColumn("__epoch", F.lit(epoch))
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
        return found

    def compact(self, key: str, before: int, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Snapshot:
        """A new base of merge(all rows of epochs before one), in buckets of key hashes, a folder each; an epoch that may still run again is not among them."""
        at = self.snapshot(before)
        if not at.epochs:
            return at
        rows = merge(self.read(at).drop("__epoch"))
        n = rows.count()
        buckets = 1
        while buckets * self.rows_a_bucket < n:
            buckets *= 2
        placed = rows.withColumn("__bucket", bucket_of(F.col(key), buckets))
        to = f"{self.path}/base-{at.epochs[-1][0]}-{buckets}"
        placed.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(to)
        return self.snapshot(before)

    def vacuum(self, keep: int = 2) -> None:
        """Removes what only bases older than the last `keep` of them refer to."""
        files, _ = self._files()
        names = self._committed()
        bases = sorted(int(m[1]) for n in names if (m := re.fullmatch(r"base-(\d+)-\d+", n)))
        if len(bases) < keep:
            return
        oldest = bases[-keep]
        for n in names:
            upto = int(re.findall(r"\d+", n)[0])
            if upto < oldest or n.startswith("epoch-") and upto <= oldest:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)


def bucket_of(key: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


#: Epochs after which a base is written anew; a batch reads at most so many earlier batches' keys beside its buckets.
EVERY = 16
#: Buckets that are named to the reader one by one; a batch that meets more of them reads all.
NAMED = 10_000


class KeysOnce:
    """A foreachBatch sink that leaves out keys written by earlier batches.

    Rows go to out/epoch=<n>; their keys to an index in versions. A batch looks up the
    keys of the last EVERY epochs and, of the base, those buckets that its own keys
    fall into. The buckets grow in number with the index and not in size, so what a
    batch reads depends on its own size. An epoch that runs again replaces its rows and
    its keys, and does not see the latter. Null keys are one key.
    """

    def __init__(self, spark: SparkSession, out: str, key: str, rows_a_bucket: int = 1_000_000, every: int = EVERY):
        self.out, self.key, self.every = out.rstrip("/"), key, every
        self.index = Versions(spark, f"{self.out}/_keys", rows_a_bucket)

    def known(self, batch: DataFrame, epoch: int) -> DataFrame | None:
        """The keys written before this epoch that batch may repeat."""
        at = self.index.snapshot(before=epoch)
        buckets = None
        if at.base:
            hit = batch.select(bucket_of(F.col(self.key), at.buckets).alias("b")).distinct().limit(NAMED + 1).collect()
            buckets = [r["b"] for r in hit if r["b"] is not None] if len(hit) <= NAMED else None
        return self.index.read(at, buckets)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([self.key])
        known = self.known(fresh, epoch)
        if known is not None:
            fresh = fresh.join(known.select(F.col(self.key).alias("__known")).distinct(), F.col(self.key).eqNullSafe(F.col("__known")), "left_anti")
        # the rows first: keys that came first without their rows would lose these on a second run of the batch, were it another epoch
        fresh.write.mode("overwrite").parquet(f"{self.out}/epoch={epoch}")
        self.index.write(spark.read.schema(batch.schema).parquet(f"{self.out}/epoch={epoch}").select(self.key), epoch)
        if len(self.index.snapshot(before=epoch).epochs) >= self.every:
            self.index.compact(self.key, before=epoch)
            self.index.vacuum()


class LatestStatus:
    """A foreachBatch sink of status upserts: the latest row of each key, by `order`, then by the epoch.

    An epoch writes the latest row of each of its own keys; every `every` epochs those
    before the current one become a new base. `statuses` merges a snapshot.
    """

    def __init__(self, spark: SparkSession, out: str, key: str, order: str, rows_a_bucket: int = 1_000_000, every: int = EVERY):
        self.key, self.order, self.every = key, order, every
        self.versions = Versions(spark, out, rows_a_bucket)

    def latest(self, rows: DataFrame, *more: str) -> DataFrame:
        names = [c for c in rows.columns if c not in (self.key, "__epoch")]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*names), F.struct(self.order, *more)).alias("r")).select(self.key, "r.*")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        self.versions.write(self.latest(batch), epoch)
        if len(self.versions.snapshot(before=epoch).epochs) >= self.every:
            at = self.versions.snapshot(before=epoch)
            self.versions.compact(self.key, epoch, lambda _: self.latest(self.versions.read(at), "__epoch"))
            self.versions.vacuum()

    def statuses(self, at: Snapshot | None = None) -> DataFrame | None:
        """One row a key, of a snapshot or of what is there now."""
        rows = self.versions.read(at or self.versions.snapshot())
        return None if rows is None else self.latest(rows, "__epoch")
