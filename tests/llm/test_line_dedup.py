import random

import pytest
from pyspark.sql import functions as F

from auditlake.llm import line_dedup

SCHEMA = "doc_id long, text string, n_lines int, digest string"


def brute(rows):
    strip = " \t\n\x0b\x0c\r"
    low = {c: c + 32 for c in range(65, 91)}
    key = lambda x: x.strip(strip).translate(low)
    first, holders = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
                first[key(line)] = min(first.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(holders[key(x)]) < 2 or first[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(1)
    pool = [f"  Line number {k} of many\t" for k in range(30)] + ["short", "", "ÄÖÜäöüÄÖÜß", "ÄÖÜäöüÄÖÜ", "\x1cseparator kept\x1c", "SAME in Other Case", "same IN other case "]
    out = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line {i} {rng.random()}" for _ in range(rng.randrange(0, 12)))) for i in range(300)]
    out += [(None, pool[0]), (None, None), (1000, None), (1001, "a" * 500_000 + "\n" + pool[1]), (5, "own again and again\nown again and again"), (1002, "\n\n")]
    return out


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_as_brute_force(spark, most):
    docs = spark.createDataFrame([(i, t, 3, "d") for i, t in rows()], SCHEMA).repartition(5)
    got = line_dedup.line_dedup(docs, broadcast_bytes=most, block_bytes=64).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows())


def test_hot_line(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a very common line\n"), F.col("id").cast("string"), F.lit(" own words here")).alias("text"))
    got = line_dedup.line_dedup(docs)
    assert got.agg(F.sum("n_dropped")).first()[0] == 4999 and got.filter("n_dropped = 0").first()["doc_id"] == 0


def test_empty(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [1 << 24, 4096])
def test_only_suspects_are_shuffled(spark, most):
    """However many passes the filter takes, nearly only lines that repeat become suspects, and every repeat does."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("line of block "), (F.col("id") % 50).cast("string"), F.lit("\n"), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    found = line_dedup.suspects(docs, broadcast_bytes=most, block_bytes=1024)
    assert 4000 <= found.count() < 4000 + 0.1 * 4000
    assert found.select("digest").distinct().count() >= 50
