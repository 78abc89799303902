"""Sharding by a minimax contiguous partition of ordered atomic group sizes.

Groups (here: equal texts) are ordered by the SHA-256 of their text and never cut
apart. A capacity is checked greedily: each of `shards` contiguous runs takes groups
as long as they fit; a group that is larger than the capacity is a run by itself.
The smallest capacity with which the runs hold everything is found by binary search,
and the runs are cut there. No contiguous partition has a smaller largest run: with
the least largest run of any partition as the capacity, that partition's runs are
feasible, so the capacity found is no larger, and a run beyond it is a single group,
which every partition has to hold. Letting such groups stand alone keeps the other
runs even where one group is as large as many shards.

The order is never collected. The driver knows sums over digest ranges: 65,536, and
256 for each that is split, a few for each shard. Ranges too large to lie within a run are split until they are small or single
groups. Then the least capacity with divisible ranges and the least with whole ranges
bound the true one, and greedy fills with these two bound the place of every cut from
both sides; only the ranges in which a cut can lie are split further, until none of
them holds more than one group. So the result is that of the whole order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Digest prefixes, in hex digits, of the first ranges and of each finer split.
FIRST_DIGITS, MORE_DIGITS = 4, 2
#: A range of several groups with more than this part of an even share is split before any capacity is tried.
HEAVY = 64
DIGEST_DIGITS = 64
#: Slots are numbered in parallel within so many parts of a shard.
SLOT_PARTS = 512


@dataclass(frozen=True)
class Plan:
    """capacity: the largest run that is no single group beyond it; cuts: the first digests of the later runs."""

    capacity: int
    cuts: tuple[str, ...]


def _sums(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The least largest run over all ways to cut sizes into at most `shards` contiguous runs."""
    sums = _sums(sizes)
    return max(_least(sums[-1], len(sums) - 1, lambda c: _fill(sums, shards, c)), int(np.max(sizes, initial=0)))


def _fill(sums: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Where a greedy fill ends its runs (indices into sums); what is larger than the capacity is a run by itself."""
    at, out = 0, []
    while len(out) < shards and at < len(sums) - 1:
        at = max(at + 1, int(np.searchsorted(sums, sums[at] + capacity, side="right")) - 1)
        out.append(at)
    return out


def _pour(sums: np.ndarray, atoms: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Where a greedy fill ends its runs (as totals) if all but the atoms larger than the capacity can be divided."""
    large = np.flatnonzero(atoms & (np.diff(sums) > capacity))
    starts, stops = sums[large], sums[large + 1]
    at, out = 0, []
    while len(out) < shards and at < sums[-1]:
        k = int(np.searchsorted(starts, at, side="left"))
        if k < len(starts) and starts[k] == at:
            at = int(stops[k])
        else:
            at = min(at + capacity, int(sums[-1]), int(starts[k]) if k < len(starts) else int(sums[-1]))
        out.append(at)
    return out


def _least(total: int, end: int, fill) -> int:
    """The least capacity up to `total` with which fill's last run ends at `end`."""
    low, high = 0, int(total)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if (fill(mid) or [0])[-1] == end else (mid + 1, high)
    return low


def cut(sizes: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Where runs 1, 2, ... begin in a greedy fill with the smallest capacity that is feasible, at most the one given."""
    sums = _sums(sizes)
    ends = _fill(sums, shards, min(capacity, _least(sums[-1], len(sums) - 1, lambda c: _fill(sums, shards, c))))
    return (ends + [len(sums) - 1] * shards)[: shards - 1]


def plan_shards(groups: DataFrame, shards: int) -> Plan:
    """The plan for groups (digest string, size long), which should be a written table. It is read a few times."""

    def sums_of(frame: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        prefix = F.substring("digest", 1, digits)
        found = frame.groupBy(prefix.alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        return [(r["prefix"], int(r["size"]), int(r["n"])) for r in found.collect()]

    def split_into(items: list[tuple[str, int, int]], split: list[str]) -> list[tuple[str, int, int]]:
        """items with the ranges in split divided by MORE_DIGITS more digits."""
        wanted = F.broadcast(groups.sparkSession.createDataFrame([(p,) for p in split], "range string"))
        finer: list[tuple[str, int, int]] = []
        for length in sorted({len(p) for p in split}):
            some = groups.join(wanted.filter(F.length("range") == length), F.substring("digest", 1, length) == F.col("range"), "left_semi")
            finer += sums_of(some, min(DIGEST_DIGITS, length + MORE_DIGITS))
        gone = set(split)
        return sorted([x for x in items if x[0] not in gone] + finer)

    # a range of one group is an atom already, whatever the length of its prefix
    items = sorted(sums_of(groups, FIRST_DIGITS))
    total = sum(s for _, s, _ in items)
    while heavy := [p for p, s, n in items if n > 1 and s * shards * HEAVY > total and len(p) < DIGEST_DIGITS]:
        items = split_into(items, heavy)
    while items:
        sums = _sums(np.array([s for _, s, _ in items], np.int64))
        atoms = np.array([n == 1 for _, _, n in items])
        low = _least(sums[-1], sums[-1], lambda c: _pour(sums, atoms, shards, c))
        high = _least(sums[-1], len(sums) - 1, lambda c: _fill(sums, shards, c))
        # the k-th cut lies between the two fills' k-th ends
        early = [int(sums[e]) for e in _fill(sums, shards, low)]
        late = _pour(sums, atoms, shards, high)
        late += [int(sums[-1])] * (len(early) - len(late))
        open_ranges = np.zeros(len(items), bool)
        for a, b in zip(early, late):
            open_ranges |= (sums[:-1] < b) & (sums[1:] > a)
        split = [p for (p, _, n), hit in zip(items, open_ranges) if hit and n > 1 and len(p) < DIGEST_DIGITS]
        if not split:
            ends = _fill(sums, shards, high)
            starts = [items[e][0] if e < len(items) else "g" for e in ends[: shards - 1]]
            return Plan(high, tuple(starts + ["g"] * (shards - 1 - len(starts))))
        items = split_into(items, split)
    return Plan(0, ("g",) * (shards - 1))


def shard_of(digest: F.Column, plan: Plan) -> F.Column:
    """The run of a digest, found among the cuts without a join."""
    run = F.lit(0)
    for start in plan.cuts:
        run = run + (digest >= F.lit(start)).cast("int")
    return run.cast("int")


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, size, text_crc32, text_sha256, shard, slot.

    size is the text's UTF-8 bytes (null: none) and 8. Equal texts share a shard,
    null and empty ones are equal. Slots count from 0 without gaps in each shard;
    rows that repeat an id have slots of their own, null ids come first. Other
    columns are ignored. An empty table gives no rows.
    """
    thin = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text_or_empty(text_col)).cast("long") + 8).alias("size"),
            F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"),
            F.sha2(text_or_empty(text_col), 256).alias("digest"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "shard-thin",
    )
    groups = written(thin.groupBy("digest").agg(F.sum("size").alias("size")), "shard-groups")
    plan = plan_shards(groups, shards)
    # numbered in parts: counts of parts give each part's first slot
    placed = thin.withColumn("shard", shard_of(F.col("digest"), plan)).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "row_no"), F.lit(SLOT_PARTS)).cast("int")
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    first = counts.selectExpr(
        "shard AS of_shard", "part AS of_part",
        "sum(n) OVER (PARTITION BY shard ORDER BY part ROWS UNBOUNDED PRECEDING) - n AS first",
    )
    numbered = placed.selectExpr(
        "*", "row_number() OVER (PARTITION BY shard, part ORDER BY doc_id, row_no) - 1 AS place"
    )
    return numbered.join(
        F.broadcast(first), (F.col("shard") == F.col("of_shard")) & (F.col("part") == F.col("of_part"))
    ).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.col("digest").alias("text_sha256"), "shard",
        (F.col("first") + F.col("place")).cast("long").alias("slot"),
    )
