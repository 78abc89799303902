"""What the operators of this subpackage share: written tables, hot-key joins and vectorised hashing."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that hold more than one row in this many count as hot; so there are at most as many hot keys.
HOT_SHARE = 2000

#: Rows of a narrow table that a file may have.
ROWS_A_FILE = 250_000

#: Keys up to which a set of 64-bit keys goes to all tasks: about 32 MB there.
KEYS_SENT = 1_000_000

_LIBC = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None

_MULT = 0x9E3779B97F4A7C15


#: Rows that a Python worker gets at once: a text can be long.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS at most, which bounds memory beside the executor's heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (spark.checkpoint.dir).

    Where the setting is empty, as in tests, the session's own checkpoint folder
    or a folder in the warehouse is used.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there, and it outlives lost executors.

    rows: an upper bound of its rows where one is known, so that few rows make few files.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    if rows is not None:
        df = df.coalesce(max(4, -(-rows // ROWS_A_FILE)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables that an operator writes on its way; clear() removes them once what they led to is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str) -> DataFrame:
        path = new_path(self.spark, tag)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            remove_path(self.spark, path)
        self.paths = []


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove_path(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.delete(target, True)


def make_path(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.mkdirs(target)


def join_keyed(rows: DataFrame, per_key: DataFrame, key: str | list[str], size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """rows joined with per_key (one row for each key) where some keys may hold a third of all rows.

    per_key has in `size` how many of the n_rows rows each key has. Keys with more
    than n_rows / HOT_SHARE rows are at most HOT_SHARE, whatever the input; these
    few are broadcast, the others meet in a sort-merge join. `size` is kept.
    """
    limit = max(n_rows // HOT_SHARE, 1000)
    hot = per_key.filter(F.col(size) > limit)
    cold = per_key.filter(F.col(size) <= limit)
    near = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(cold.hint("merge"), key, how)
    return near.unionByName(rest)


def parted(rows: DataFrame, key: str, keys: DataFrame, most: int = KEYS_SENT) -> tuple[DataFrame, DataFrame | None]:
    """The rows that have one of keys (64-bit numbers), and the others, so that only the former need be shuffled.

    Up to `most` keys are sent to all tasks. With more, all rows are returned as the
    former, and None.
    """
    distinct = written(keys.distinct(), "parted-keys")
    if distinct.count() > most:
        return rows, None
    return rows.join(F.broadcast(distinct), key, "left_semi"), rows.join(F.broadcast(distinct), key, "left_anti")


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that a hash repartition into n parts deals to a part each."""
    tried = spark.range(32 * n).select(F.col("id").cast("int").alias("k"))
    rows = tried.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
    found = {r["p"]: r["k"] for r in rows}
    return [found.get(p, p) for p in range(n)]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and, for each row, where it begins in them (one more at the end). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def give_back() -> None:
    """Returns freed memory to the system, for a worker goes on to other batches and tasks beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


#: What a worker keeps between tasks, by operator: functions that let it go.
KEPT: dict[str, Callable[[], None]] = {}


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20, keeps: str = ""):
    """batch in parts whose `column` has about `most` bytes; a longer single text is a part of its own.

    Workers serve one operator after another, so what others than `keeps` have kept is let go.
    """
    for owner, let_go in KEPT.items():
        if owner != keeps:
            let_go()
    values = batch.column(batch.schema.get_field_index(column))
    if isinstance(values.type, pa.DataType) and pa.types.is_large_string(values.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(values):
        return
    offsets = np.frombuffer(values.buffers()[1], kind)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    at = 0
    while at < len(values):
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), len(values))
        yield batch.slice(at, end - at)
        at = end
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Bases of the two rolling hashes.
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BYTES = [mix(np.arange(256, dtype=np.uint64) * np.uint64(_MULT) + np.uint64(77 + k)) for k in range(2)]
_CACHE: dict[tuple[bool, bool], np.ndarray] = {}


def powers(n: int, inverse: bool = False, second: bool = False) -> np.ndarray:
    """The first n powers of a rolling hash's base, or of its inverse, modulo 2**64."""
    if len(_CACHE.get((inverse, second), ())) < n:
        base = _BASES[second]
        _CACHE[inverse, second] = _powers(max(n, 1 << 16), pow(base, -1, 1 << 64) if inverse else base)
    return _CACHE[inverse, second][:n]


def prefix_hash(data: np.ndarray, second: bool = False) -> np.ndarray:
    """H with H[e] - H[s] = base**s times the hash of data[s:e], modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[second][data] * powers(len(data), False, second), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end], the same for equal bytes anywhere."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), True, second)[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts lying one after another: A-Z lowered, split at the six ASCII white-space bytes.

    Returns starts and ends in data, the text of each word, and the word's hash (none unless `hashed`).
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    space = _SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = space[:-1]
    inner = offsets[:-1]
    first[inner[inner < len(data)]] = True
    starts = np.flatnonzero(first & ~space)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = space[1:]
    ends = offsets[1:]
    last[ends[ends > 0] - 1] = True
    ends = np.flatnonzero(last & ~space) + 1
    of = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, of, span_hash(prefix_hash(_LOWER[data]), starts, ends) if hashed else np.zeros(0, np.uint64)
