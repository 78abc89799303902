import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditlake.llm import ngram_join

SCHEMA = "doc_id long, text string, node long, n int, root long"


def shingles(text, k=5):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))]
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * len(sets[i] | sets[j]):
                at[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else low[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed=1, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5 and rows:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 1 + len(words) // 25)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [word()] * rng.randrange(2)
            words = words or [word()]
        elif kind < 0.75:
            words = [word() for _ in range(rng.randrange(1, 40))] + passage + [word() for _ in range(rng.randrange(1, 40))]
        else:
            words = [word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 14, 30, 90, 400]))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_brute_force(spark, seed):
    rows = corpus(seed) + [(9001, None), (9002, ""), (None, "a b c d e f"), (9003, "A b\tC d"), (9004, "a B c\nD"), (9005, " \n ")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], SCHEMA).repartition(4)
    got = ngram_join.jaccard_components(docs, task_signatures=3000).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


@pytest.mark.parametrize("tasks", [300, 100_000])
def test_more_tasks_than_partitions(spark, tasks):
    """Tasks without a cap share a few partitions and are worked off one after another; components are the same."""
    rows = corpus(3)
    docs = spark.createDataFrame([(d, t, 0, 0, 0) for d, t in rows], SCHEMA)
    most = sum(len(shingles(t)) for _, t in rows)
    got = ngram_join.jaccard_components(docs, task_signatures=max(1, int(most * 0.6 / tasks)), most_partitions=3).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_task_numbers_of_any_size():
    """Two rows with one signature meet in a task beyond 2**15 too, and others do not."""
    low = np.array([5, 9], "<u4").tobytes() + np.array([1, 1], "<u2").tobytes()
    both = np.array([(0 << 2) | 1, (0 << 2) | 3], "<u2").tobytes()
    held = [np.array([n], "<i8").tobytes() + np.array([7], "<u4").tobytes() for n in (11, 12)]
    for t in (3, 40_000, 5_000_000):
        rows = [(0, t, low, np.array([3, 3], "<u2").tobytes(), h) for h in held] + [(0, t + 1, low, both, held[0])]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["key", "task", "sigs", "sets", "nodes"])
        for by_task in (False, True):
            found = pa.Table.from_batches(list(ngram_join._runs([batch], by_task))).to_pydict()
            assert len(set(found["sig"])) == 2 and sorted(found["node"]) == [11, 11, 12, 12]


def test_pigeonhole_never_misses():
    """Sets that reach the similarity share a signature that one indexes and the other probes, whatever the costs."""
    rng = np.random.default_rng(7)
    for trial in range(400):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 200)), dtype=np.uint64)
        size = len(base)
        drop = int(rng.integers(0, size // 9 + 2))
        other = np.concatenate([base[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, size // 9 + 2)), dtype=np.uint64)])
        both = size - min(drop, size)
        if not len(other) or 100 * both < 80 * (size + len(other) - both):
            continue
        costs = rng.integers(0, 1000, ngram_join.SKETCH)
        sets, begin = np.concatenate([np.sort(base), np.sort(other)]), np.array([0, size, size + len(other)])
        sig, of, flag = ngram_join.signatures(ngram_join.Bands(80, int(max(size, len(other)))), sets, begin, lambda s: costs[ngram_join._slot(s)])
        index = [set(sig[(of == k) & (flag & 1 > 0)].tolist()) for k in (0, 1)]
        probe = [set(sig[(of == k) & (flag & 2 > 0)].tolist()) for k in (0, 1)]
        assert probe[0] & index[1] or probe[1] & index[0], trial


def test_large_groups(spark):
    many = spark.range(2000).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit(" ".join(f"w{k}" for k in range(80))), F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit(" own"), F.col("id").cast("string")))).alias("text"),
    )
    got = ngram_join.jaccard_components(many)
    assert got.count() == 2000 and got.agg(F.max("component_id")).first()[0] == 0


def test_empty(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_random_graphs(spark):
    from auditlake.llm.components import components

    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    at = {}

    def find(x):
        while at.setdefault(x, x) != x:
            x = at[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    want = {x: find(x) for x in at if find(x) != x}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keys_are_even(spark):
    from auditlake.llm.common import even_keys

    keys = even_keys(spark, 37)
    parts = spark.createDataFrame([(k,) for k in keys], "k int").repartition(37, "k").select(F.spark_partition_id().alias("p"))
    assert parts.distinct().count() == 37


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_a_slice_of_one_short_row(spark, n):
    text = " ".join("abcde"[:n])
    hashes, begin = ngram_join.shingle_sets(pa.array([text]))
    assert len(hashes) == 1 and begin.tolist() == [0, 1]
    rows = ngram_join.jaccard_components(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(7, 1, 7)]


def test_an_id_with_two_texts(spark):
    """Each text of a repeated id links by itself, whichever of the texts is met first."""
    b = [f"b{k}" for k in range(30)]
    a = [f"a{k}" for k in range(30)]
    rows = [(5, " ".join(b)), (5, " ".join(a)), (6, " ".join(a[:29])), (7, " ".join(b[:29]))]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string")
        got = ngram_join.jaccard_components(docs).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(5, 5), (5, 5), (6, 5), (7, 5)]
        assert sorted((tuple(r) for r in got), key=repr) == brute(order)
