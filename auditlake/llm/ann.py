"""Approximate nearest neighbours by collision counting over single projections.

Vectors are cut into blocks. A block keeps, for each of PROJECTIONS random
directions, its projections as one sorted array. A query's window is centred at
its own projection and grows by virtual rehashing: with the radius R it spans R
times the first half-width to either side. A vector that lies in the windows of
at least COLLISIONS of the projections is verified by its exact cosine. Windows grow
in each block until a few vectors collide; the k-th best of all blocks then bounds how
far they have to reach for whatever is nearer, and in a second pass they are set to
that. So on vectors with near neighbours few are verified; where the nearest are
hardly nearer than the others, as among random directions, a good part is.

Directions are normalised vectors' cosines in Euclidean terms: for unit vectors,
distance^2 = 2 - 2 cos. A block holds any number of equal vectors. Blocks stream: a
task builds a block from its vectors, then takes its queries batch by batch. Collisions
are counted along the windows of the sorted arrays while these hold little of a block;
where they hold much of it, every vector's places in the arrays are compared with the
windows' ends instead, which gives the same counts. No vector is copied; a query goes to each block in either pass, which is the cost that grows
with queries times rows: larger blocks make it smaller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import even_keys, written

PROJECTIONS = 64
#: Share of the projections in which a vector has to collide to be verified.
COLLISIONS = 0.58
#: First half-width of the windows (unit vectors' projections have deviation 1) and their growth.
WIDTH, GROWTH = 0.2, 1.25
#: |z| that a standard normal stays within for well over half of the projections, whatever the draw: a vector at
#: distance d then collides in enough windows of half-width REACH * d.
REACH = 0.95
#: Vectors of a block, and the fewest for which a small table is cut further so that all cores have a block.
BLOCK_ROWS, LEAST_ROWS = 32768, 2048
#: Windows that hold one in so many of a block's places, or more, are counted by places.
SCANNED = 16
SEED = 20_11


def scaled(rows: np.ndarray) -> np.ndarray:
    """rows, each by a power of two where its squares could overflow or vanish, which changes no cosine."""
    most = np.abs(rows).max(axis=1, initial=0)
    odd = (most > 1e150) | ((most < 1e-140) & (most > 0))
    if odd.any():
        rows = rows.copy()
        rows[odd] = np.ldexp(rows[odd], -np.frexp(most[odd])[1][:, None])
    return rows


def cosine(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision; the same for equal vectors wherever they stand."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors take part, and these as a matrix: of length dim, not zero, without null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    fit = np.flatnonzero(lengths == dim)
    taken = column.take(pa.array(fit)).flatten()
    rows = taken.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # null components become NaN
    good = np.isfinite(rows).all(axis=1) & rows.any(axis=1)
    return fit[good], scaled(rows[good])


class Block:
    """The sorted projection arrays of a block of vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, directions: np.ndarray):
        order = np.argsort(ids, kind="stable")
        if len(np.unique(ids)) < len(ids):  # the same places on every run
            order = np.lexsort((*rows.T[::-1], ids))
        self.ids, self.rows = ids[order], rows[order]
        unit = self.rows / np.sqrt((self.rows * self.rows).sum(axis=1))[:, None]
        self.directions = directions
        values = unit @ directions.T
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(values.T, self.order, axis=1)
        # each vector's place in each sorted array
        self.place = np.empty(self.order.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.place, self.order, np.arange(len(ids), dtype=self.place.dtype)[None], axis=1)
        self.need = max(1, int(np.ceil(COLLISIONS * len(directions))))
        self.rough = unit.astype(np.float32)
        #: By how much a rough cosine may be off.
        self.off = 4 * (rows.shape[1] + 8) * float(np.finfo(np.float32).eps)
        self.step, self.verified = 0, 0

    def _verify(self, query: np.ndarray, new: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(place in the block, id, score) of the k best: by score, then id. Many are first scored in single precision, which leaves those that may be among the best."""
        self.verified += len(new)
        if len(new) > 32 * k:
            rough = self.rough.take(new, axis=0) @ (query / np.sqrt((query * query).sum())).astype(np.float32)
            new = new[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 2 * self.off]
        score = cosine(query, self.rows[new])
        if len(new) > k:
            good = score >= np.partition(score, len(score) - k)[len(score) - k]
            new, score = new[good], score[good]
        best = np.lexsort((new, self.ids[new], -score))[:k]
        return list(zip(new[best].tolist(), self.ids[new[best]].tolist(), score[best].tolist()))

    def _met(self, at: np.ndarray, width: float) -> tuple[np.ndarray, bool]:
        """Which vectors collide often enough in windows of this half-width around at, and whether the windows hold all."""
        m, n = self.order.shape
        low = np.array([np.searchsorted(s, x) for s, x in zip(self.sorted, at - width)])
        high = np.array([np.searchsorted(s, x, side="right") for s, x in zip(self.sorted, at + width)])
        held = int((high - low).sum())
        if held == m * n:
            return np.ones(n, bool), True
        if held * SCANNED < m * n:
            counts = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, low, high)]), minlength=n)
        else:  # places before the window wrap around to numbers beyond it; a window that holds all counts for all
            whole = high - low == n
            kind = self.place.dtype
            inside = self.place[~whole] - low[~whole].astype(kind)[:, None] < (high - low)[~whole].astype(kind)[:, None]
            counts = inside.sum(axis=0, dtype=np.uint8 if m < 256 else np.int32) + int(whole.sum())
        return counts >= self.need, False

    def first(self, query_id: int, query: np.ndarray, least: int, k: int) -> list[tuple[int, int, float]]:
        """The best of the vectors that collide first while the windows grow, `least` or more; of all of a smaller block.

        The search for that width begins at the last query's, for those of a block are alike.
        """
        at = self.directions @ (query / np.sqrt((query * query).sum()))
        others = self.ids != query_id

        def tried(step: int) -> tuple[np.ndarray, bool]:
            met, all_held = self._met(at, WIDTH * GROWTH**step)
            met = np.flatnonzero(met & others)
            return met, len(met) >= least or all_held

        met, enough = tried(self.step)
        while not enough:
            self.step += 1
            met, enough = tried(self.step)
            if enough:
                return self._verify(query, met, k)
        while self.step:
            fewer, enough = tried(self.step - 1)
            if not enough:
                break
            self.step, met = self.step - 1, fewer
        return self._verify(query, met, k)

    def within(self, query_id: int, query: np.ndarray, width: float, k: int) -> list[tuple[int, int, float]]:
        """The best of the vectors that collide often enough in windows of this half-width."""
        met, _ = self._met(self.directions @ (query / np.sqrt((query * query).sum())), width)
        return self._verify(query, np.flatnonzero(met & (self.ids != query_id)), k)


def reach(kth: float) -> float:
    """The half-width in which a vector collides enough that is as near as a score says."""
    return REACH * float(np.sqrt(max(0.0, 2 - 2 * kth))) + 1e-9


def _answers(batches, k: int, least: int, projections: int, dim: int):
    """Rows (block, asks, id, v, kth) sorted by block, vectors before queries -> (query_id, block, place, vec_id, score): a block's nearest to each query.

    With kth, the windows reach as far as something nearer could be; without, until `least` vectors collide.
    """
    directions = np.random.default_rng(SEED).standard_normal((projections, dim))
    number, ids, rows, block = None, [], [], None
    for batch in batches:
        at = 0
        blocks, asks = np.asarray(batch.column(0)), np.asarray(batch.column(1).cast(pa.int8()))
        while at < len(blocks):
            end = at + int(np.argmax(np.append((blocks[at:] != blocks[at]) | (asks[at:] != asks[at]), True)))
            part = batch.slice(at, end - at)
            if blocks[at] != number:
                number, ids, rows, block = blocks[at], [], [], None
            fit, found = usable(part.column(3), dim)
            own = np.asarray(part.column(2))[fit]
            if not asks[at]:
                ids.append(own)
                rows.append(found)
            elif sum(map(len, ids)):
                if block is None:
                    block, rows = Block(np.concatenate(ids), np.concatenate(rows), directions), []
                out = []
                for q, v, kth in zip(own.tolist(), found, part.column(4).take(pa.array(fit)).to_pylist()):
                    best = block.first(q, v, least, k) if kth is None else block.within(q, v, reach(kth), k)
                    out += [(q, int(number), *b) for b in best]
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "block", "place", "vec_id", "score"])
            at = end


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, projections: int = PROJECTIONS, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found to each row of queries among all vectors but itself.

    Ties go to the smaller id. With fewer candidates all are returned. Vectors that
    are null, empty, zero or hold null or non-finite components, rows without id,
    and vectors whose length is not that of most take no part. Vectors so large that
    their squares overflow count like any other. Rows that repeat an id are
    candidates each; of queries that repeat an id the least vector is asked. Other
    columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ready = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    data, asked = written(ready(vectors), "ann-vectors"), written(ready(queries).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    dims = data.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = dims["d"] if dims else 1, data.count()
    blocks = max(1, -(-n // block_rows), min(spark.sparkContext.defaultParallelism, n // LEAST_ROWS))
    own = spark.createDataFrame(list(enumerate(even_keys(spark, blocks))), "block int, dealt int")  # a partition a block
    dealt = data.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v", F.lit(None).cast("double").alias("kth"))

    def answers(some: DataFrame) -> DataFrame:
        """The nearest of each block to queries (id, v, kth)."""
        sent = some.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "v", "kth")
        rows = dealt.unionByName(sent).join(F.broadcast(own), "block").repartition(blocks, "dealt").sortWithinPartitions("block", "asks").drop("dealt")
        return rows.mapInArrow(lambda b: _answers(b, k, k + 1, projections, dim), "query_id long, block int, place long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "block", "place")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    near = written(ranked(answers(asked.withColumn("kth", F.lit(None).cast("double")))), "ann-first")
    kth = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    # queries with fewer than k candidates have them all by now
    again = answers(asked.join(kth.hint("merge"), "id"))
    found = near.drop("rank").unionByName(again).dropDuplicates(["query_id", "block", "place"])
    return ranked(found).select("query_id", "rank", "vec_id", "score")
