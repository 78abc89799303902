"""Best-fit packing of token sequences, certified by dual-feasible-function bounds.

Pieces are dealt to buckets of about BUCKET_PIECES, each packed by best-fit
decreasing in one task. Lower bounds from three families of dual feasible
functions certify a bucket whose number of bins they reach. A bucket with a gap
gives up all its bins that are not nearly full, a certified one only its emptiest;
what is given up is exchanged between buckets and packed again, until all bins
together are within one in GAP_SHARE of the bound, one bucket holds all that was
given up, or an exchange gives nearly all of it back.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import written

BUCKET_PIECES = 20_000
#: A bin of a bucket with a gap is given up if more than this share of it is empty.
LOOSE = 0.01
#: Exchanges end once the bins exceed the sum bound by no more than one in so many.
GAP_SHARE = 10_000
END_ID = 1


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the bounds on the number of bins; exact integer arithmetic throughout.

    Families: U(e), which rounds items over 1 - e up to a bin and drops those under
    e (e = 0: the sum); u(k), which rounds down to multiples of 1/k; phi(e), which
    counts how many items of e fit beside one. All are dual feasible, so each
    rounded total bounds the bins from below.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(object)
    sizes = np.flatnonzero(count.astype(bool))
    n = np.array([int(count[s]) for s in sizes], object)
    total = n * sizes.astype(object)
    up = lambda a, b: -(-a // b)
    best = up(int(total.sum()), capacity)
    upper = np.concatenate([np.cumsum(n[::-1])[::-1], [0]])  # items of this size and more
    mass = np.concatenate([[0], np.cumsum(total)])
    for e in sizes[sizes <= capacity // 2]:
        lo, hi = np.searchsorted(sizes, e), np.searchsorted(sizes, capacity - e, side="right")
        best = max(best, int(upper[hi]) + up(int(mass[hi] - mass[lo]), capacity))
    for k in range(1, 65):
        whole = (k + 1) * sizes % capacity == 0
        floors = (k + 1) * sizes // capacity
        exact, rounded = int(total[whole].sum()), int((n * floors)[~whole].sum())
        best = max(best, up(rounded * capacity + exact * k, k * capacity))
        e = max(1, capacity // (k + 1))
        fits = capacity // e
        big, half, small = sizes * 2 > capacity, sizes * 2 == capacity, (sizes * 2 < capacity) & (sizes >= e)
        doubled = int((n * (2 * fits - 2 * ((capacity - sizes) // e)))[big].sum()) + int((n * fits)[half].sum()) + int(n[small].sum()) * 2
        best = max(best, up(doubled, 2 * fits))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each item its bin and its offset there; for each bin its fill. Every length is from 1 to capacity."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms, fill = 0, []  # the bits of rooms: where free has a bin
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            if not free[room]:
                rooms |= 1 << room
            free[room].append(b)
    return bins, offsets, np.array(fill, np.int64)


def pack_pieces(pieces: DataFrame, capacity: int = 4096, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """pieces (row_no, piece, length from 1 to capacity, more columns) with sequence_id, offset, bucket_bins, bucket_bound, certified.

    pieces has to be a written table. Each piece is placed once, whole; sequences
    have no gaps from 0. An empty table gives no rows.
    """
    out_type = pieces.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    columns = pieces.columns

    def pack(stage: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["row_no", "piece"], kind="stable").reset_index(drop=True)
            lengths = frame["length"].to_numpy(np.int64)
            bins, offsets, fill = best_fit_decreasing(lengths, capacity)
            bound = lower_bound(lengths, capacity)
            loose = fill < capacity * (1 - LOOSE) if len(fill) > bound else np.zeros(len(fill), bool)
            loose[fill.argmin()] = True
            bucket = int(frame["bucket"].iloc[0])
            return frame[columns].assign(
                sequence_id=(np.int64(stage) << 52) + (np.int64(bucket) << 24) + bins, offset=offsets, again=loose[bins],
                bucket_bins=np.int64(len(fill)), bucket_bound=np.int64(bound), certified=len(fill) == bound,
            )

        return run

    schema = f"{out_type}, sequence_id long, offset long, again boolean, bucket_bins long, bucket_bound long, certified boolean"
    pool, done, stage, closed = pieces, None, 0, 0
    n, tokens = pieces.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    bound = -(-tokens // capacity)
    while True:
        buckets = max(1, -(-n // bucket_pieces))
        dealt = pool.withColumn("bucket", F.pmod(F.xxhash64("row_no", "piece", F.lit(stage)), F.lit(buckets)))
        packed = written(dealt.groupBy("bucket").applyInPandas(pack(stage), schema), f"pack-{stage}")
        bins = {r["again"]: r["count"] for r in packed.select("sequence_id", "again").distinct().groupBy("again").count().collect()}
        closed += bins.get(False, 0)
        gap, before = closed + bins.get(True, 0) - bound, n
        pool = packed.filter("again").select(*columns)
        n = pool.count()
        # ends when hardly a bin is left to win, when all met in one bucket, or when the same pieces come back
        if gap <= max(1, bound // GAP_SHARE) or buckets == 1 or n > 0.98 * before:
            return (packed if done is None else done.unionByName(packed)).drop("again")
        kept = packed.filter(~F.col("again"))
        done, stage = kept if done is None else done.unionByName(kept), stage + 1


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_no, piece, start, length, ids_crc32: every text's ids and END_ID, cut only where longer than capacity."""
    end = END_ID.to_bytes(4, "little")

    def each(i, ids, _):
        key, row_no = i["doc_id"], i["row_no"]
        ids += end
        step = 4 * capacity
        return [
            (key, row_no, k, a // 4, min(step, len(ids) - a) // 4, zlib.crc32(ids[a : a + step]))
            for k, a in enumerate(range(0, len(ids), step))
        ]

    keyed = docs.select(
        F.struct(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_no")).alias("doc_id"),
        F.col(text_col).alias("text"),
    )
    schema = "doc_id long, row_no long, piece int, start long, length long, ids_crc32 long"
    return bpe.map_encoded(keyed, path, each, schema)


def pack(docs: DataFrame, path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each row of docs, with its sequence_id and offset.

    A null or empty text is one piece of END_ID alone. Rows that repeat an id, and
    null ids, are packed each for itself. Other columns are ignored. An empty table
    gives no rows.
    """
    pieces = written(token_pieces(docs, path, capacity, id_col, text_col), "pack-pieces")
    return pack_pieces(pieces, capacity).drop("row_no").withColumnRenamed("doc_id", id_col)
