"""Line deduplication with two Bloom filters.

Every document's distinct line keys set bits in a filter for keys seen once; a bit
that is set again by another document goes to the filter for keys seen twice. The
filters are kept in blocks that the high bits of a key's hash name, so that the
parts made by map tasks are merged block by block. Only lines whose bits are all
in the second filter, the suspected repeats, are shuffled, for an exact count of
the documents that hold them and the choice of the smallest id.

A filter has BITS_A_LINE bits for each line, so it grows with the input. The second
filter goes to all tasks in ranges of blocks of BROADCAST_BYTES at most, one range a
pass over the lines (a single pass up to about 67 million lines); so a larger limit,
where executors have the memory, means fewer passes. A filter never misses a repeat,
and what it wrongly suspects the exact count clears.

Building the filters shuffles two 4-byte bit numbers for each distinct line of a map
task; the suspects' digests are 16 bytes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_keyed, parted, slices, written

BITS_A_LINE = 8
BLOCK_BYTES = 1 << 17
BROADCAST_BYTES = 64 << 20
#: Keys of fewer code points stay wherever they are.
LEAST_CHARS = 10

_SPACE = b" \t\n\x0b\x0c\r"


def keys_of(text: str | None, least: int = LEAST_CHARS) -> list[bytes | None]:
    """For each line its key, or None where it is too short to be deduplicated. Null: one empty line."""
    out: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(_SPACE).lower()  # of bytes: A-Z only
        out.append(key if len(key) >= 4 * least or len(key.decode()) >= least else None)
    return out


def digests(keys: list[bytes | None]) -> list[bytes | None]:
    """128-bit digests that stand for keys from here on."""
    return [None if k is None else xxhash.xxh3_128_digest(k) for k in keys]


def _bits(digest: np.ndarray, blocks: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block and two bits in it of 128-bit digests (two 64-bit columns)."""
    block = (digest[:, 0] >> np.uint64(32)) % np.uint64(blocks)
    return block.astype(np.int64), (digest[:, 0] % np.uint64(span)).astype(np.int64), (digest[:, 1] % np.uint64(span)).astype(np.int64)


class Filters:
    """The part of both filters that one task makes, as the sorted bit numbers it has set in each block."""

    def __init__(self, blocks: int, span: int):
        self.blocks, self.span, self.held = blocks, span, []

    def add(self, digest: np.ndarray) -> None:
        """Distinct digests of one document each."""
        block, one, two = _bits(digest, self.blocks, self.span)
        span = self.span
        low, high = np.minimum(one, two), np.maximum(one, two)
        self.held.append(np.concatenate([block * span + low, (block * span + high)[low != high]]))
        if sum(map(len, self.held)) > 1 << 20:
            self.held = [np.concatenate(self.held)]

    def parts(self):
        """(block, bits seen once, bits seen again): packed 32-bit numbers."""
        if not self.held:
            return
        bits = np.sort(np.concatenate(self.held))
        fresh = np.ones(len(bits), bool)
        fresh[1:] = bits[1:] != bits[:-1]
        once, again = bits[fresh], np.unique(bits[~fresh])
        span = self.span
        for b in np.unique(once // span).tolist():
            pick = lambda x: (x[np.searchsorted(x, b * span) : np.searchsorted(x, (b + 1) * span)] - b * span).astype("<u4").tobytes()
            yield b, pick(once), pick(again)


def _merge(batches, span: int):
    """Both filters, block after block as they come sorted; yields the second as a bitmap, for each block that has any bit. Memory is that of one block."""
    block, once, twice = None, np.zeros(span, bool), np.zeros(span, bool)

    def packed():
        if block is not None and twice.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    for batch in batches:
        for b, first, second in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if b != block:
                yield from packed()
                block = b
                once[:] = twice[:] = False
            bits = np.frombuffer(first, "<u4")
            twice[bits[once[bits]]] = True
            once[bits] = True
            twice[np.frombuffer(second, "<u4")] = True
    yield from packed()


def _column(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)


def _suspects(digest: np.ndarray, blocks: int, span: int, filters: dict[int, np.ndarray]) -> np.ndarray:
    out = np.zeros(len(digest), bool)
    block, one, two = _bits(digest, blocks, span)
    for b in np.unique(block).tolist():
        if (bitmap := filters.get(b)) is not None:
            mine = np.flatnonzero(block == b)
            has = lambda bit: (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            out[mine] = (has(one[mine]) & has(two[mine])).astype(bool)
    return out


def suspects(source: DataFrame, least: int = LEAST_CHARS, broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of source (doc_id, text): (doc_id, digest) of the lines that the second filter has, once a document; every repeat is among them."""
    spark = source.sparkSession
    breaks = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))), F.lit(0))
    n_lines = source.agg(F.sum(breaks + 1)).first()[0] or 0
    span = 8 * block_bytes
    blocks = max(1, -(-int(n_lines) * BITS_A_LINE // span))

    def batches_of(batches):
        """(ids, the distinct digests of each document) in slices."""
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids = part.column(0).to_pylist()
                yield ids, [list(dict.fromkeys(d for d in digests(keys_of(t, least)) if d is not None)) for t in part.column(1).to_pylist()]

    def set_bits(batches):
        own = Filters(blocks, span)
        for _, found in batches_of(batches):
            if flat := [d for one in found for d in one]:
                own.add(_column(flat))
        for b, once, again in own.parts():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int64()), "once": pa.array([once], pa.binary()), "again": pa.array([again], pa.binary())})

    parts = source.mapInArrow(set_bits, "block long, once binary, again binary")
    twice = written(parts.repartition("block").sortWithinPartitions("block").mapInArrow(lambda batches: _merge(batches, span), "block long, bits binary"), "lines-twice")

    def probe(shared):
        def run(batches):
            filters = {b: np.frombuffer(bits, np.uint8) for b, bits in shared.value.items()}
            for ids, found in batches_of(batches):
                rows = [(i, d) for i, one in zip(ids, found) for d in one]
                if rows:
                    hit = np.flatnonzero(_suspects(_column([d for _, d in rows]), blocks, span, filters))
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([rows[k][0] for k in hit], pa.int64()), "digest": pa.array([rows[k][1] for k in hit], pa.binary())})

        return run

    found = None
    step = max(1, broadcast_bytes // block_bytes)
    for first in range(0, blocks, step):
        # a range of the filter, at most broadcast_bytes
        held = {r["block"]: bytes(r["bits"]) for r in twice.filter(F.col("block").between(first, first + step - 1)).collect()}
        shared = spark.sparkContext.broadcast(held)
        some = written(source.mapInArrow(probe(shared), "doc_id long, digest binary"), "lines-suspects")
        found = some if found is None else found.unionByName(some)
        shared.unpersist()
    return found


def line_dedup(
    docs: DataFrame, least: int = LEAST_CHARS, broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """docs with its text freed of repeated lines, and n_lines, n_dropped.

    A line's key is the line stripped of ASCII white space, A-Z lowered. Keys of at
    least `least` code points found in two documents or more lose all their lines
    except in the document with the smallest id. Null and empty texts are one empty
    line and come back as the empty text. Rows that share an id count as one
    document. Rows without id neither lose lines nor make others lose theirs. All
    columns of docs are kept, but for such as are named like the new ones. An empty
    table gives no rows.
    """
    docs = docs.drop("n_lines", "n_dropped", "__id", "__drop")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id IS NOT NULL")
    found = suspects(source, least, broadcast_bytes, block_bytes)
    n_suspects = found.count()
    repeated = written(
        found.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("keep_id < last"),
        "lines-repeated",
    )
    drops = join_keyed(found, repeated, "digest", "n", n_suspects).filter("doc_id <> keep_id")
    drops = written(drops.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("digest").alias("__drop")), "lines-drops")
    hit, rest = parted(docs.withColumn("__id", F.col(id_col).cast("long")), "__id", drops.select("__id"))
    joined = hit.join(drops.hint("merge"), "__id", "left").select(*docs.columns, "__drop")
    if rest is not None:
        joined = joined.unionByName(rest.select(*docs.columns, F.lit(None).cast("array<binary>").alias("__drop")))
    names, at = docs.columns, docs.columns.index(text_col)

    def strip(batches):
        for batch in batches:
            for part in slices(batch, text_col, 4 << 20):
                texts, n, dropped = [], [], []
                for text, drop in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist()):
                    lines = (text or "").split("\n")
                    if drop:
                        gone = set(drop)
                        kept = [x for x, d in zip(lines, digests(keys_of(text, least))) if d is None or d not in gone]
                    else:
                        kept = lines
                    texts.append("\n".join(kept))
                    n.append(len(lines))
                    dropped.append(len(lines) - len(kept))
                columns = [pa.array(texts, pa.string()) if k == at else part.column(k) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = docs.select(*(F.col(c) for c in docs.columns)).schema.add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(strip, schema)
