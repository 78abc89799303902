"""Vector code compression: each vector's parts become the numbers of their nearest codebook entries, all in whole numbers.

The codebooks, of a fixed size, are broadcast. Arrow batches compute the squared
distances of all their parts to all entries by expanding the norm into exact int64
matrix products, and take the first nearest entry. Each task sends one sum for each
entry that it met, merged by a grouped shuffle, so that what reaches the driver in
each round is at most one row for each entry.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, written

#: Rows whose distances are held at once.
PIECE = 4096
#: Sums beyond int64 are sent in limbs of so many bits.
LIMB = 30


def part_bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """Where each of the parts begins and ends: all of one length, the last ones shorter where that length does not divide width."""
    step = -(-width // parts)
    return [(min(k * step, width), min((k + 1) * step, width)) for k in range(parts)]


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64 where all distances then fit in int64, else Python integers."""
    most = math.isqrt((1 << 60) // max(values.shape[-1], 1))
    if not values.size or np.abs(values).max() < most / scale:
        return np.floor(values * scale).astype(np.int64)
    flat = [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(flat, object).reshape(values.shape)


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first nearest entry and its squared distance: |x|^2 - 2 x.c + |c|^2, exactly."""
    if object in (x.dtype, entries.dtype):
        x, entries = x.astype(object), entries.astype(object)
    found, least = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    norms = (entries * entries).sum(axis=1)
    for a in range(0, len(x), PIECE):
        own = x[a : a + PIECE]
        apart = norms - 2 * (own @ entries.T)
        first = apart.argmin(axis=1)
        found[a : a + PIECE] = first
        least[a : a + PIECE] = apart[np.arange(len(own)), first] + (own * own).sum(axis=1)
    return found, least


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def _limbs(sums: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """sums as int64 arrays, by the power of 2**LIMB that each counts."""
    if sums.dtype != object:
        return [(0, sums)]
    out, k = [], 0
    while any(sums.ravel()):
        out.append((k, (sums % (1 << LIMB)).astype(np.int64)))
        sums, k = sums // (1 << LIMB), k + 1
        if all(v in (0, -1) for v in sums.ravel()):
            out.append((k, sums.astype(np.int64)))
            break
    return out or [(0, sums.astype(np.int64))]


def _valid(vector: F.Column) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def learn(kept: DataFrame, width: int, parts: int, entries: int, scale: int, rounds: int) -> list[np.ndarray]:
    """The codebook of each part after so many rounds over kept (id, vector)."""
    spark, bounds = kept.sparkSession, part_bounds(width, parts)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = whole(np.array([r["vector"] for r in first]).reshape(len(first), width), scale)
    books = [start[:, a:b] for a, b in bounds]
    names = [f"s{k}" for k in range(max(b - a for a, b in bounds))]
    schema = "part int, entry int, limb int, n long" + "".join(f", {s} long" for s in names)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def sums(batches):
            total: dict[tuple[int, int], list] = {}
            for batch in batches:
                x = whole(_matrix(batch.column(0), width), scale)
                for part, (a, b) in enumerate(bounds):
                    own = x[:, a:b]
                    entry, _ = nearest_entries(own, sent.value[part])
                    order = np.argsort(entry, kind="stable")
                    ranked = entry[order]
                    edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else []
                    for k, (n, s) in enumerate(zip(np.diff(np.append(edge, len(ranked))), np.add.reduceat(own[order], edge, axis=0) if len(ranked) else [])):
                        held = total.setdefault((part, int(ranked[edge[k]])), [0, 0])
                        held[0] += int(n)
                        held[1] = held[1] + s
            rows: list[list] = []
            for (part, entry), (n, s) in total.items():
                for limb, values in _limbs(s):
                    rows.append([part, entry, limb, n if limb == 0 else 0, *values.tolist(), *[0] * (len(names) - len(values))])
            if rows:
                kinds = [pa.int32()] * 3 + [pa.int64()] * (1 + len(names))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "entry", "limb", "n", *names])

        merged = kept.select("vector").mapInArrow(sums, schema).groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
        met: dict[tuple[int, int], list] = {}
        for r in merged.collect():  # one row an entry (and limb) at most
            held = met.setdefault((r["part"], r["entry"]), [0, [0] * len(names)])
            held[0] += r["n"]
            held[1] = [old + (r[s] << (LIMB * r["limb"])) for old, s in zip(held[1], names)]
        fresh = []
        for part, (a, b) in enumerate(bounds):
            rows = [[s // met[part, e][0] for s in met[part, e][1][: b - a]] if (part, e) in met else old.tolist() for e, old in enumerate(books[part])]
            fresh.append(_integers(rows, len(first), b - a))
        sent.unpersist()
        books = fresh
    return books


def _integers(rows: list[list[int]], n: int, width: int) -> np.ndarray:
    most = math.isqrt((1 << 60) // max(width, 1))
    fits = all(abs(v) < most for row in rows for v in row)
    return np.array(rows, np.int64 if fits else object).reshape(n, width)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256, in hex, of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 4, entries: int = 256, scale: int = 1024, rounds: int = 4,
) -> DataFrame:
    """id, label, code, error, label_error and codebooks_sha256 for each row that takes part; other columns of vectors are not read.

    Rows whose vector is null or holds a null or non-finite component take no part, nor
    do those whose vector has another length than that of the smallest id (equal ids:
    the smallest vector; null ids come last). Rows that repeat an id or a vector count
    each. A length that `parts` does not divide leaves the last part shorter. With fewer
    rows than `entries` a codebook has as many entries as rows. Without rows the result
    is empty. Components of any finite size are worked out exactly; an error or a
    label_error beyond a long is null. Codes have two hex digits a part, so `entries` may be 256 at most.
    """
    spark = vectors.sparkSession
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    taken = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = written(taken.filter(_valid(F.col("vector"))), "vector-codes")
    shape = kept.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).limit(1).collect()
    width = shape[0]["n"] if shape else 0
    kept = kept.filter(F.size("vector") == width)
    bounds = part_bounds(width, parts)
    books = learn(kept, width, parts, entries, scale, rounds) if shape else [np.zeros((0, 0), np.int64)] * parts
    sent = spark.sparkContext.broadcast(books)

    def assign(batches):
        for batch in batches:
            x = whole(_matrix(batch.column(2), width), scale)
            codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), x.dtype)
            for part, (a, b) in enumerate(bounds):
                entry, apart = nearest_entries(x[:, a:b], sent.value[part])
                codes[:, part] = entry
                error = error + apart
            text = codes.tobytes().hex()
            codes = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
            error = [e if e < 1 << 63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = kept.select("id", "label").schema
    found = written(kept.mapInArrow(assign, kinds.add("code", "string").add("error", "long")), "vector-codes-found")
    found = found.withColumn("same", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    per_label = found.groupBy("same").agg(F.count("*").alias("size"), F.when(F.count("error") == F.count("*"), total).try_cast("long").alias("label_error"))
    joined = join_keyed(found, per_label, "same", "size", found.count())
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
