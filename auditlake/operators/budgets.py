"""Budgets over ordered units without one task a group: next-fit batches and greedy selections, composed from ranges.

Units are dealt by range of (group, order) and cut into ranges of bounded length. A
range tells in a few rows what it does to any state that it may be entered with; one
small task a group goes over these rows, and then every range is replayed from its
true state, all at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..sources.shared import written

#: Units of a range at most.
RANGE = 1 << 20


def _dealt(units: DataFrame, by: str, order: list[str]) -> DataFrame:
    """units with the part they lie in, in order of (by, order) from part to part; written, so that every pass meets the same parts."""
    parts = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(units.repartitionByRange(parts, by, *order).withColumn("__part", F.spark_partition_id()), "budget-parts")


def _pieces(batches, key: int, part: int, most: int):
    """Rows of each (part, group) in turn, in pieces of `most` rows at most: (part, group, number of the piece, record batch)."""
    held, rows, at, number = [], 0, None, 0
    for batch in batches:
        groups, parts = batch.column(key).to_pylist(), batch.column(part).to_pylist()
        start = 0
        for k in range(len(batch)):
            new = at is not None and at != (parts[k], groups[k])
            if new or rows + (k - start) == most:
                if k > start:
                    held.append(batch.slice(start, k - start))
                yield (*at, number, pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, rows, start, number = [], 0, k, 0 if new else number + 1
            at = (parts[k], groups[k])
        if len(batch) > start:
            held.append(batch.slice(start))
            rows += len(batch) - start
    if held:
        yield (*at, number, pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _next(sums: np.ndarray, max_size: int, max_units: int) -> np.ndarray:
    """For each unit the first that a batch beginning there does not take; a unit beyond the budget stands alone."""
    n = len(sums) - 1
    first = np.arange(n)
    fits = np.searchsorted(sums, sums[:-1] + max_size, side="right") - 1
    return np.minimum(np.maximum(fits, first + 1), np.minimum(first + max_units, n))


def heads(sizes: np.ndarray, max_size: int, max_units: int) -> list[tuple]:
    """What a range does with a batch that it is entered with, by the place at which that batch ends: one row for each place where it can.

    (place, size before it, batches begun after it, units and size of the last batch). The
    last row, of the range's length, stands for a batch that does not end in it.
    """
    sums = np.concatenate([[0], np.cumsum(sizes)])
    n = len(sizes)
    follow = _next(sums, max_size, max_units)
    known: dict[int, tuple] = {}
    # a batch of one unit and no size ends last
    last = min(n, max(0, max_units - 1), int(np.searchsorted(sums[1:], max_size, side="right")))
    out = []
    for place in range(last + 1 if last < n else n):
        path, at = [], place
        while at not in known:
            path.append(at)
            if follow[at] >= n:
                known[at] = (0, n - at, int(sums[n] - sums[at]))
                break
            at = int(follow[at])
        for p in reversed(path):
            if p not in known:
                begun, count, size = known[int(follow[p])]
                known[p] = (begun + 1, count, size)
        out.append((place, int(sums[place]), *known[place]))
    return [*out, (n, int(sums[n]), 0, 0, 0)]


def enter(rows: pd.DataFrame, count: int, size: int, max_size: int, max_units: int) -> tuple[int, int, int]:
    """The batches begun in a range entered with (count, size), and the state it is left with; rows are the range's heads. count 0: no batch is open."""
    table = rows.to_numpy(np.int64)
    n = int(table[-1][0])
    if not count:
        place = 0
    else:
        # the batch ends at the first unit that does not fit
        inner = np.flatnonzero(size + np.append(table[1:, 1], table[-1, 1])[: len(table)] > max_size)
        place = min(int(table[inner[0], 0]) if len(inner) else n, max_units - count if count < max_units else 0)
    if place >= n:
        return 0, count + n, size + int(table[-1][1])
    _, _, begun, last_count, last_size = table[place]
    return int(begun) + 1, int(last_count), int(last_size)


def budget_batches(units: DataFrame, size: str, order: list[str], max_size: int, max_units: int, by: str, most: int = RANGE) -> DataFrame:
    """units with batch: next-fit in order under both budgets; a unit above the size budget stands alone.

    Three passes: every range's heads (as many rows as a batch may have units, at
    most), a walk over them for each group, and the numbering of each range from its
    true state. Orders without ties; a null size is 0; a null group is a group. No task
    holds more than `most` units, or the heads of one group.
    """
    dealt = _dealt(units.withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))), by, order)
    sort = ["__part", by, *order]
    kind = dealt.schema[by].dataType

    def told(batches):
        for part, group, number, piece in _pieces(batches, 0, 1, most):
            found = heads(piece.column(2).to_numpy(zero_copy_only=False), max_size, max_units)
            columns = [pa.array([group] * len(found), piece.schema.field(0).type), pa.array([part] * len(found), pa.int32()), pa.array([number] * len(found), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in zip(*found))], names=[by, "__part", "__piece", "place", "before", "begun", "count", "size"])

    kinds = StructType().add(by, kind).add("__part", IntegerType()).add("__piece", IntegerType())
    for c in ("place", "before", "begun", "count", "size"):
        kinds = kinds.add(c, LongType())
    keyed = list(dict.fromkeys([by, "__part", "__size", *order]))
    summary = dealt.select(*keyed).repartition("__part").sortWithinPartitions(*sort).select(by, "__part", "__size").mapInArrow(told, kinds)

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["__part", "__piece", "place"])
        count, total, batch, out = 0, 0, -1, []
        for (part, piece), rows in frame.groupby(["__part", "__piece"], sort=False):
            out.append((rows[by].iloc[0], part, piece, batch, count, total))
            begun, count, total = enter(rows[["place", "before", "begun", "count", "size"]], count, total, max_size, max_units)
            batch += begun
        return pd.DataFrame(out, columns=[by, "__part", "__piece", "__batch", "__count", "__total"])

    states = StructType().add(by, kind).add("__part", IntegerType()).add("__piece", IntegerType()).add("__batch", LongType()).add("__count", LongType()).add("__total", LongType())
    entered = written(summary.groupBy(by).applyInPandas(walk, states), "budget-states")
    # one state for each piece of a group in a part, so next to none a unit
    begin = entered.groupBy(F.col("__part").alias("__p"), F.col(by).alias("__g")).agg(F.collect_list(F.struct("__piece", "__batch", "__count", "__total")).alias("__states"))
    names = list(units.columns)
    joined = dealt.join(begin, (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__g")))
    joined = joined.repartition("__part").sortWithinPartitions(*sort).select(*names, "__part", "__size", "__states")
    key = names.index(by)

    def number_all(batches):
        for _, _, number, piece in _pieces(batches, key, len(names), most):
            state = next(s for s in piece.column(len(names) + 2)[0].as_py() if s["__piece"] == number)
            sizes = piece.column(len(names) + 1).to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty(len(sizes), np.int64)
            at, batch = 0, state["__batch"]
            if state["__count"]:
                room = int(np.searchsorted(sums[1:], max_size - state["__total"], side="right")) if state["__total"] <= max_size else 0
                at = min(room, max(0, max_units - state["__count"]), len(sizes))
                out[:at] = batch
            follow = _next(sums, max_size, max_units)
            while at < len(sizes):
                batch += 1
                out[at : follow[at]] = batch
                at = int(follow[at])
            yield pa.RecordBatch.from_arrays([*piece.columns[: len(names)], pa.array(out.astype(np.int32))], names=[*names, "batch"])

    return joined.mapInArrow(number_all, StructType([*units.schema.fields]).add("batch", IntegerType()))


def may_be_taken(sizes: np.ndarray, max_units: int) -> np.ndarray:
    """The places of units before which fewer than max_units stand that are no larger: a greedy pass can take no others, whatever is left of the budget.

    Where a unit is taken, every smaller one before it has been: the budget was larger then.
    """
    from bisect import bisect_right, insort

    small: list[int] = []  # the max_units smallest so far
    out = []
    for k, n in enumerate(sizes.tolist()):
        if len(small) < max_units or n < small[-1]:
            if bisect_right(small, n) < max_units:
                out.append(k)
            insort(small, n)
            del small[max_units:]
    return np.array(out, np.int64)


def budget_selection(units: DataFrame, size: str, order: list[str], max_size: int, max_units: int, by: str, most: int = RANGE) -> DataFrame:
    """The units that a greedy pass in order takes: those that do not fit are passed over, but for the first of all.

    Each range keeps the units that a pass may take from whatever state (`may_be_taken`:
    for a range in random order about max_units times the logarithm of its length), and
    a group's pass goes over those. Orders without ties; a null size is 0.
    """
    wide = units.withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")))
    dealt = _dealt(wide, by, order)
    names = list(units.columns)
    key = names.index(by)
    kinds = StructType([*units.schema.fields]).add("__size", LongType()).add("__part", IntegerType())
    sort = ["__part", by, *order]

    def kept(batches):
        for _, _, number, piece in _pieces(batches, key, len(names) + 1, most):
            sizes = piece.column(len(names)).to_numpy(zero_copy_only=False)
            # the first unit of a group is taken whatever its size: a range cannot tell whether its first is it
            fits = np.flatnonzero(sizes <= max_size)
            some = fits[may_be_taken(sizes[fits], max_units)]
            if number == 0 and len(sizes):
                some = np.union1d(some, [0])
            yield piece.take(pa.array(some))

    few = dealt.select(*names, "__size", "__part").repartition("__part").sortWithinPartitions(*sort).mapInArrow(kept, kinds)

    def take(batches):
        last, count, total = None, 0, 0
        for batch in batches:
            groups, sizes = batch.column(key).to_pylist(), batch.column(len(names)).to_pylist()
            chosen = []
            for k, (group, n) in enumerate(zip(groups, sizes)):
                if last is None or last[0] != group:
                    last, count, total = (group,), 0, 0
                if count < max_units and (total + n <= max_size or not count):
                    count, total = count + 1, total + n
                    chosen.append(k)
            yield batch.take(pa.array(chosen, pa.int64())).select(names)

    return few.repartition(by).sortWithinPartitions(by, *order).mapInArrow(take, StructType([*units.schema.fields]))
