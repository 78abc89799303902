import hashlib
import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from auditlake.llm import exact_dedup, sharding

SCHEMA = "doc_id long, text string, digest string, shard int, size int"
ROWS = [
    (1, "a", "x", 0, 0), (2, "a", None, 1, 1), (3, None, "x", 2, 2), (4, "", "x", 3, 3), (None, "a", "x", 0, 0),
    (5, "b" * 300_000, "x", 0, 0), (6, "a", "x", 0, 0), (6, "a", "x", 0, 0), (None, None, None, None, None),
]


def test_exact_dedup_edges(spark):
    got = exact_dedup.exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS)
    of = {}
    for r in got:
        of.setdefault(r["text_sha256"], []).append(r)
    a = of[hashlib.sha256(b"a").hexdigest()]
    assert {r["keep_id"] for r in a} == {6} and {r["group_size"] for r in a} == {5}
    assert [r["doc_id"] for r in a if r["kept"]] == [6]
    assert {r["keep_id"] for r in of[hashlib.sha256(b"").hexdigest()]} == {4}
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_remembers(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    first = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), index)
    assert all(r["kept"] for r in first.collect())
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    second = {r["doc_id"]: r for r in exact_dedup.exact_dedup(spark.createDataFrame([(3, "b"), (4, "c")], "doc_id long, text string"), again).collect()}
    assert not second[3]["kept"] and second[3]["keep_id"] == 2 and second[3]["group_size"] == 2
    assert second[4]["kept"] and again.rows().count() == 3


def test_batches_of_one_text_and_a_retry(spark, tmp_path):
    """Three batches of one text count 1, 2 and 3; a batch that runs again under its name changes nothing; the index keeps its buckets."""
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    one = lambda i, text="a": spark.createDataFrame([(i, text)], "doc_id long, text string")
    got = lambda df: [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()]
    assert got(exact_dedup.exact_dedup(one(5), index, "x")) == [(5, 5, 1, True)]
    assert got(exact_dedup.exact_dedup(one(6), index, "y")) == [(6, 5, 2, False)]
    for _ in range(2):
        assert got(exact_dedup.exact_dedup(one(7), index, "z")) == [(7, 5, 3, False)]
    index.close()
    again = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 9)
    assert again.buckets == 4 and [(r["keep_id"], r["seen"]) for r in again.rows().collect()] == [(5, 3)]
    assert got(exact_dedup.exact_dedup(one(8, "b"), again)) == [(8, 8, 1, True)]


def test_batches_equal_one_pass(spark, tmp_path):
    rows = [(i, f"t{i % 23}") for i in range(400)] + [(None, "t3"), (None, "own"), (None, None), (7, "t7"), (7, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 3)
    parts = exact_dedup.falling_batches(docs, 3)
    assert len(parts) == 3 and sum(p.count() for p in parts.values()) == len(rows)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(exact_dedup.dedup_batches(parts, index)) == key(exact_dedup.exact_dedup(docs))
    plan = index.rows()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(digest" not in plan
    empty = docs.limit(0)
    assert exact_dedup.dedup_batches(exact_dedup.falling_batches(empty), exact_dedup.DigestIndex(spark, str(tmp_path / "none"), 2)).count() == 0


def test_hot_keys_are_joined_whole(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_dedup(docs)
    assert got.count() == 6000 and got.filter("kept").count() == 3001


def _brute(sizes, k):
    best = sum(sizes)
    for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), k - 1):
        at = [0, *cuts, len(sizes)]
        best = min(best, max(sum(sizes[a:b]) for a, b in zip(at, at[1:])))
    return best


def test_smallest_capacity_is_minimax():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 30, rng.integers(1, 9))
        k = int(rng.integers(1, 5))
        best = sharding.smallest_capacity(sizes, k)
        assert best == _brute(list(sizes), k)
        at = [0, *sharding.cut(sizes, k, best), len(sizes)]
        assert at == sorted(at) and max(sizes[a:b].sum() for a, b in zip(at, at[1:])) <= best


def test_shards(spark):
    rows = [(i, f"text {i % 400} " * (1 + i % 37)) for i in range(3000)] + [(9000 + i, "big" * 3000) for i in range(40)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    got = sharding.shard(docs, 6).collect()
    assert len(got) == len(rows) + 1
    by_text, slots, totals = {}, {}, {}
    for r in got:
        by_text.setdefault(r["text_sha256"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        totals[r["shard"]] = totals.get(r["shard"], 0) + r["size"]
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    groups = {}
    for r in got:
        groups[r["text_sha256"]] = groups.get(r["text_sha256"], 0) + r["size"]
    order = [groups[d] for d in sorted(groups)]
    sizes = np.array(order)
    big = sizes.max()
    assert big * 6 >= sizes.sum()  # the large group has a shard of its own
    rest = np.delete(sizes, sizes.argmax())
    assert max(totals.values()) == max(big, sharding.smallest_capacity(rest, 5))
    want = {(i, zlib.crc32(t.encode())) for i, t in rows}
    assert want <= {(r["doc_id"], r["text_crc32"]) for r in got}


def test_runs_are_contiguous_and_even_beside_a_large_group():
    rng = np.random.default_rng(4)
    for trial in range(200):
        sizes = rng.integers(1, 30, int(rng.integers(1, 60)))
        if trial % 2:
            sizes[rng.integers(0, len(sizes))] = int(rng.integers(200, 900))
        k = int(rng.integers(1, 8))
        best = sharding.smallest_capacity(sizes, k)
        at = [0, *sharding.cut(sizes, k, best), len(sizes)]
        runs = [sizes[a:b] for a, b in zip(at, at[1:])]
        assert at == sorted(at) and max(r.sum() for r in runs) <= best
        # no capacity lets the runs that are no single group be smaller
        most = max((int(r.sum()) for r in runs if len(r) > 1), default=0)
        assert not most or len(sharding._fill(sharding._sums(sizes), k, most - 1)) == 0 or sharding._fill(sharding._sums(sizes), k, most - 1)[-1] < len(sizes)
    assert sharding.cut(np.array([1] * 16 + [8]), 24, 8)[:17] == list(range(1, 18))


def test_plan_of_ranges_is_that_of_the_whole_order(spark):
    """Refined ranges give the cuts that all single groups give."""
    rng = np.random.default_rng(6)
    for large in (0, 1, 3):
        sizes = rng.integers(8, 500, 3000)
        sizes[rng.integers(0, 3000, large)] = 200_000
        groups = sorted((hashlib.sha256(str(i).encode()).hexdigest(), int(s)) for i, s in enumerate(sizes))
        plan = sharding.plan_shards(spark.createDataFrame(groups, "digest string, size long"), 11)
        ordered = np.array([s for _, s in groups])
        at = sharding.cut(ordered, 11, sharding.smallest_capacity(ordered, 11))
        starts = [groups[a][0] if a < len(groups) else "g" for a in at]
        assert [sum(d >= c for c in plan.cuts) for d, _ in groups] == [sum(d >= c for c in starts) for d, _ in groups]


def test_shards_refine_to_single_groups(spark):
    rows = [(i, str(i)) for i in range(5000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    groups = sorted((r["text_sha256"], r["size"]) for r in got)
    best = sharding.smallest_capacity(np.array([s for _, s in groups]), 7)
    totals = {}
    for r in got:
        totals[r["shard"]] = totals.get(r["shard"], 0) + r["size"]
    assert max(totals.values()) <= best


def test_shards_of_nothing(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0
