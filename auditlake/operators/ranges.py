"""Running sums over a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def running(rows: DataFrame, order: str, sums: list[str], by: tuple[str, ...] = (), down: bool = False) -> DataFrame:
    """rows with, for each s of sums, s_upto (the sum up to and with the row, in order within its group) and s_all (the group's).

    Rows that are equal in order must be one row (aggregate them before). They are
    dealt by range of (group, order), summed within each range, and the ranges' own
    sums, one row a range and group, are carried over.
    """
    spark = rows.sparkSession
    key = F.desc(order) if down else F.asc(order)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *by, key).withColumn("__part", F.spark_partition_id()), "running")
    own = dealt.groupBy(*by, "__part").agg(*(F.sum(s).alias(s) for s in sums))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carried = own.select(
        *(F.col(b).alias(f"__{b}") for b in by), F.col("__part").alias("__p"),
        *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__{s}_before") for s in sums), *(F.sum(s).over(whole).alias(f"{s}_all") for s in sums),
    )
    same = F.col("__part") == F.col("__p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__{b}"))
    within = Window.partitionBy(*by, "__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    inner = dealt.select("*", *(F.sum(s).over(within).alias(f"__{s}_in") for s in sums))
    joined = inner.join(carried, same)
    return joined.select(*rows.columns, *((F.col(f"__{s}_in") + F.col(f"__{s}_before")).alias(f"{s}_upto") for s in sums), *(f"{s}_all" for s in sums))


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """rows with their place, from 1, in an order of columns that no two rows share; numbered in parallel."""
    keyed = rows.withColumn("__order", F.struct(*(o if not isinstance(o, str) else F.col(o) for o in order))).withColumn("__one", F.lit(1))
    return running(keyed, "__order", ["__one"]).withColumn(name, F.col("__one_upto")).select(*rows.columns, name)
