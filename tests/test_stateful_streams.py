"""Stateful streams against the batch operators: the same rows in any order of arrival."""

import random
import time

from pyspark.sql import functions as F

from auditlake.operators import dedup, sequence
from auditlake.streaming import stateful


def feed(spark, folder, batches, schema):
    """One file a batch, in order."""
    import os
    import time

    os.makedirs(folder, exist_ok=True)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        stamp = time.time() - 1000 + k
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if os.path.getmtime(path) > time.time() - 500:
                os.utime(path, (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


STOP = dict(target=4, max_calls=12, max_tokens=150, n=3, least_yield=0.2)


def test_stop_rules_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    schema = "event_id long, key string, at timestamp, ok boolean, tokens long"
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(k, f"k{rng.randrange(6)}", start + timedelta(seconds=rng.randrange(200), microseconds=rng.randrange(3)), rng.random() < 0.4, rng.randrange(30)) for k in range(120)]
    rows += [(200 + k, "quiet", start + timedelta(seconds=50 * k), True, 1) for k in range(3)]  # never stops
    want = sequence.stop_rules(spark.createDataFrame(rows, schema), "ok", "tokens", ["at", "event_id"], "key", **STOP)
    want = sorted(tuple(r) for r in want.select("key", "calls", "rule", "accepted", "tokens").collect())
    assert len({r[2] for r in want}) >= 2
    for seed in (1, 2):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        batches = [shuffled[k::4] for k in range(4)] + [[(999, "end", start + timedelta(hours=3), False, 0)], [(1000, "end", start + timedelta(hours=5), False, 0)]]
        stream = feed(spark, str(tmp_path / f"in{seed}"), batches, schema)
        found = stateful.stop_rules_in_order(stream, "ok", "tokens", "at", "event_id", "key", 4, 12, 150, 3, 0.2, late="1 hour")
        stateful.drained(found, str(tmp_path / f"out{seed}"), str(tmp_path / f"c{seed}"))
        got = spark.read.parquet(str(tmp_path / f"out{seed}")).filter("key <> 'end'").select("key", "calls", "rule", "accepted", "tokens").collect()
        assert sorted(tuple(r) for r in got) == want


def test_a_row_behind_the_watermark_does_not_count(spark, tmp_path):
    from datetime import datetime, timedelta

    start, schema = datetime(2024, 1, 1), "event_id long, key string, at timestamp, ok boolean, tokens long"
    at = lambda m: start + timedelta(minutes=m)
    batches = [[(1, "a", at(0), True, 0), (2, "a", at(100), False, 0)], [(3, "a", at(200), None, None)], [(4, "a", at(1), True, 0), (5, "a", at(300), True, 0)], [(6, "b", at(900), True, 0)], [(7, "b", at(1800), True, 0)]]
    stream = feed(spark, str(tmp_path / "in"), batches, schema)
    found = stateful.stop_rules_in_order(stream, "ok", "tokens", "at", "event_id", "key", 2, 99, 99, 9, 0.0, late="10 minutes")
    stateful.drained(found, str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out")).filter("key = 'a'").collect()
    assert [(r["calls"], r["accepted"]) for r in got] == [(4, 2)]  # 1, 2, 3 and 5; row 4 came too late


def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    known = [(f"k{k}", True, ", ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(60))) for k in range(12)]
    known += [("kn", True, None), ("k12", True, "short")]
    asking = [("exact", False, known[0][2]), ("wide", False, known[1][2].replace(", ", " ,  ").upper()), ("new", False, "nothing, of, the, kind, at, all, here"), ("none", False, None), ("comment", False, known[2][2] + " // end")]
    for k in range(20):
        parts = known[k % 12][2].split(", ")
        for _ in range(k // 4):
            parts[rng.randrange(len(parts))] = "other"
        asking.append((f"near{k}", False, ", ".join([*parts, "more"])))
    return known, asking


SCHEMA = "id string, known boolean, text string"


def run_tiers(spark, tmp_path, name, batches, **more):
    stream = feed(spark, str(tmp_path / f"{name}-in"), batches, SCHEMA)
    found = stateful.tier_evidence(stream, "id", "text", "known", 0.85, **more)
    stateful.drained(found, str(tmp_path / name), str(tmp_path / f"{name}-c"), stateful.settled)
    return {r["row_id"]: r["tier"] for r in spark.read.parquet(str(tmp_path / name)).collect()}


def test_tiers_as_in_batch(spark, tmp_path):
    known, asking = texts()
    rows, base = spark.createDataFrame(asking, SCHEMA), spark.createDataFrame(known, SCHEMA)
    fill = lambda df: df.withColumn("text", F.coalesce("text", F.lit("")))
    want = {r["id"]: r["tier"] for r in dedup.duplicate_tiers(fill(rows), "id", "text", fill(base), "text").collect()}
    assert set(want.values()) == {"exact", "normalized", "near", None}
    assert run_tiers(spark, tmp_path, "later", [known[:7], known[7:], asking[:9], asking[9:]]) == want
    both = known + asking
    random.Random(6).shuffle(both)
    assert run_tiers(spark, tmp_path, "together", [both]) == want  # a batch's known texts hold for all of its rows
    early = run_tiers(spark, tmp_path, "early", [asking[:1], known, asking[1:2]])
    assert early == {"exact": None, "wide": "normalized"}  # what comes to be known later does not count


def test_known_texts_are_forgotten(spark, tmp_path):
    known, asking = texts()
    stream = feed(spark, str(tmp_path / "in"), [known, asking[:2]], SCHEMA)
    found = stateful.tier_evidence(stream, "id", "text", "known", 0.85, ttl_ms=1)
    query = stateful.started(found, str(tmp_path / "out"), str(tmp_path / "c"), stateful.settled, once=False)
    try:
        deadline = time.time() + 60
        while time.time() < deadline and len(query.recentProgress) < 3 and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    assert query.exception() is None
    assert {r["row_id"]: r["tier"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"exact": None, "wide": None}


def test_tiers_take_as_many_keys_as_there_are_buckets(spark, tmp_path):
    known, asking = texts()
    rows, base = spark.createDataFrame(asking, SCHEMA), spark.createDataFrame(known, SCHEMA)
    fill = lambda df: df.withColumn("text", F.coalesce("text", F.lit("")))
    want = {r["id"]: r["tier"] for r in dedup.duplicate_tiers(fill(rows), "id", "text", fill(base), "text").collect()}
    stream = feed(spark, str(tmp_path / "in"), [known[:7], known[:9] + asking[:9], known[7:] + asking[9:]], SCHEMA)
    found = stateful.tier_evidence(stream, "id", "text", "known", 0.85, buckets=2)
    query = stateful.started(found, str(tmp_path / "out"), str(tmp_path / "c"), stateful.settled)
    query.awaitTermination()
    got = {r["row_id"]: r["tier"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert all(got[k] == want[k] for k, _, _ in asking[9:])
    kept = sorted(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])
    assert kept[-1] <= 13 and kept[0] == 0  # known texts' shingles at most; the index has lists, not entries


def test_frequent_shingles_bring_few_pairs_together(spark, tmp_path):
    """In an order by counts texts do not meet by a shingle that most of them have, and find the same tiers."""
    rng = random.Random(8)
    stock = [f"call{k}" for k in range(6)]
    rows = []
    for k in range(120):
        own = [f"w{rng.randrange(10**6)}" for _ in range(30)]
        rows.append((f"k{k}", True, ", ".join([*stock, *own])))
        if k % 10 == 0:
            rows.append((f"a{k}", False, ", ".join([*stock, *own, "more"])))
        rows.append((f"b{k}", False, ", ".join([*stock, *(f"v{rng.randrange(10**6)}" for _ in range(30))])))
    stream = lambda name: feed(spark, str(tmp_path / name), [rows[:150], rows[150:]], SCHEMA)
    texts = stateful.filed(stateful.fingerprints(stream("in"), "id", "text", "known"), str(tmp_path / "f"), str(tmp_path / "fc"))
    counts = dedup.shingle_counts(spark.read.schema(texts.schema).parquet(str(tmp_path / "f")).select(F.col("shingles").alias("s")))
    got = {}
    for name, found in (("counts", stateful.evidence(texts, counts=counts)), ("hashes", stateful.tier_evidence(stream("again"), "id", "text", "known"))):
        query = stateful.started(found, str(tmp_path / name), str(tmp_path / f"{name}-c"), stateful.settled)
        query.awaitTermination()
        got[name] = {r["row_id"]: r["tier"] for r in spark.read.parquet(str(tmp_path / name)).collect()}
    assert got["counts"] == got["hashes"] == {i: "near" if i.startswith("a") else None for i, known, _ in rows if not known}
    sets = spark.read.schema(texts.schema).parquet(str(tmp_path / "f")).filter("known OR row_id LIKE 'b%'")
    taken = sets.select("known", "text_key", F.size("shingles").alias("n"), F.expr("cast(size(shingles) - ceil(size(shingles) * 0.85) + 1 as int)").alias("p"), F.col("shingles").alias("s"))
    first = taken.mapInArrow(dedup.first_shingles(counts, ["known", "text_key"]), "known boolean, text_key string, n int, g long")
    assert first.filter("known").join(first.filter("NOT known"), "g").count() == 0


def test_each_stage_of_the_tiers_runs_once(spark, tmp_path):
    known, asking = texts()
    found = stateful.tier_evidence(feed(spark, str(tmp_path / "in"), [known + asking], SCHEMA), "id", "text", "known", 0.85, buckets=2)
    query = stateful.started(found, str(tmp_path / "out"), str(tmp_path / "c"), stateful.settled)
    query.awaitTermination()
    assert len(query.lastProgress["stateOperators"]) == 3
