"""Quality classifier: random-indexing word vectors, pooled, and a two-layer numpy network with calibrated probabilities.

Every word, lower-cased, has a sparse ternary index vector of its own, drawn from its
64-bit hash. A word's vector is its index vector and the mean, over all places where
it stands in any document, of the sum of the index vectors of the words up to SPAN
places away. Sums are kept for CONTENT rows, in which words with the same low hash
bits share a mean; so a map task sends one matrix of fixed size, and what the driver
gets does not grow with the vocabulary. Besides, a word has one of SHAPES forms (its
case, its last byte's class, its length, whether it repeats a word just before),
which have index vectors only. Documents are pooled by the mean of their words'
vectors, of their forms' and of the square roots of form shares, and scored by a
network with one hidden layer. A temperature fitted on labelled rows that training
did not see calibrates the probabilities.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, text_buffers, words_of, written

CONTENT, SHAPES, DIM, NONZERO, SPAN = 1 << 15, 256, 64, 8, 2
#: The network is fitted on at most so many labelled rows, those with the smallest hash of their id.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 256, 3e-3, 1e-4, 5
PARTS = 16
#: Words of which vectors are summed at once.
PIECE = 1 << 15
THRESHOLD = 0.3


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """The sparse ternary index vectors of 64-bit hashes: NONZERO places, each with a sign, from 7 bits apiece."""
    out = np.zeros((len(hashes), DIM), np.int8)
    bits, rows = mix(hashes + np.uint64(1)), np.arange(len(hashes))
    for _ in range(NONZERO):
        out[rows, (bits & np.uint64(DIM - 1)).astype(np.int64)] += np.where(bits & np.uint64(DIM), 1, -1).astype(np.int8)
        bits >>= np.uint64(7)
    return out


def _last_class() -> np.ndarray:
    out = np.full(256, 10, np.int64)
    for k, chars in enumerate([b".", b",", b"!", b"?;:", b"|", b"#&*%$@", b"\"'()[]{}<>", b"0123456789", b"-_/\\+=~^`"], 1):
        out[list(chars)] = k
    out[65:91] = out[97:123] = 0
    out[128:] = 0
    return out


_LAST = _last_class()


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the texts: its text, its hash and its form."""
    data, offsets = text_buffers(column)
    starts, ends, of, hashes = words_of(data, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none
    upper = (data >= 65) & (data <= 90)
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    upper |= after_c3 & (data >= 0x80) & (data <= 0x9E)  # A grave to Thorn in UTF-8
    seen = np.concatenate([[0], np.cumsum(upper)])
    capitals = seen[ends] - seen[starts]
    first_two = np.minimum(starts + 2, ends)
    title = seen[first_two] - seen[starts]
    case = np.where(capitals == 0, 0, np.where(capitals == title, 1, 2))
    long = np.minimum((ends - starts) // 4, 2)
    again = np.zeros(len(starts), np.int64)
    for back in (1, 2):
        again[back:] |= (hashes[back:] == hashes[:-back]) & (of[back:] == of[:-back])
    return of, hashes, ((_LAST[data[ends - 1]] * 3 + case) * 3 + long) * 2 + again


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the texts: its text, its row among CONTENT and its form."""
    of, hashes, form = words(column)
    return of, (hashes % np.uint64(CONTENT)).astype(np.int64), form


def with_context(of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each word its index vector and those of the words up to SPAN places away in its text, summed."""
    distinct, place = np.unique(hashes, return_inverse=True)
    own = index_vectors(distinct)[place]
    total = own.astype(np.int16)
    for step in range(1, SPAN + 1):
        apart = np.flatnonzero(of[step:] != of[:-step])
        total[:-step] += own[step:]
        total[step:] += own[:-step]
        total[apart] -= own[apart + step]
        total[apart + step] -= own[apart]
    return total


def _context_sums(batches):
    """The task's counts and sums of with_context for each row of CONTENT, in parts."""
    table = np.zeros((CONTENT, DIM + 1), np.int64)
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            of, hashes, _ = words(part.column(0))
            row = (hashes % np.uint64(CONTENT)).astype(np.int64)
            for a in range(0, len(row), PIECE):  # a bounded piece of the matrix at a time, with its neighbours
                first, b = max(0, a - SPAN), min(len(row), a + PIECE)
                sums = with_context(of[first : b + SPAN], hashes[first : b + SPAN])[a - first : b - first]
                order = np.argsort(row[a:b], kind="stable")
                ranked = row[a:b][order]
                edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
                table[ranked[edge], 0] += np.diff(np.append(edge, len(ranked)))
                table[ranked[edge], 1:] += np.add.reduceat(sums[order].astype(np.int32), edge, axis=0)
    yield from _parts(table)


def _parts(table: np.ndarray):
    for k, rows in enumerate(np.array_split(table, PARTS)):
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(rows.astype("<i8").tobytes(), 1)], pa.binary())], ["part", "sums"])


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(packed), "<i8")
    for k, rows in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(rows.astype("<i8").tobytes(), 1)], pa.binary())], ["part", "sums"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The vectors of all words, by row, and of all forms: one matrix of fixed size, from counts over all of docs."""
    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(_context_sums, "part int, sums binary")
    found = sums.repartition(PARTS, "part").mapInArrow(_add_up, "part int, sums binary").collect()
    rows = {r["part"]: np.frombuffer(zlib.decompress(bytes(r["sums"])), "<i8").reshape(-1, DIM + 1) for r in found}
    table = np.concatenate([rows[k] for k in sorted(rows)]) if rows else np.zeros((CONTENT, DIM + 1), np.int64)
    context = table[:, 1:] / np.maximum(table[:, :1], 1)
    known = table[:, 0] > 0
    if known.any():
        context[known] -= context[known].mean(axis=0)
    return np.concatenate([context, index_vectors(mix(np.arange(SHAPES, dtype=np.uint64)))]).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """For each text the mean vectors of its content tokens and of its forms, those of the square roots of form shares, and its length."""
    of, content, form = tokens(column)
    n = len(column)
    words = np.bincount(of, minlength=n)
    out = np.zeros((n, 3 * DIM + 1), np.float32)
    has = np.flatnonzero(words)
    starts = np.concatenate([[0], np.cumsum(words[has])])
    for k in range(0, len(has), 256):  # a bounded piece of the word matrix at a time
        some = has[k : k + 256]
        a, b = starts[k], starts[min(k + 256, len(has))]
        shares = np.bincount((np.repeat(np.arange(len(some)), words[some]) * SHAPES + form[a:b]), minlength=len(some) * SHAPES)
        shares = shares.reshape(len(some), SHAPES) / words[some][:, None]
        sums = np.zeros((len(some), DIM))
        for c in range(a, b, 1 << 13):  # short sums in single precision, their totals in double
            d = min(b, c + (1 << 13))
            own = of[c:d]
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sums[np.searchsorted(some, own[edge])] += np.add.reduceat(vectors[content[c:d]], edge, axis=0)
        out[some, :DIM] = sums / words[some][:, None]
        out[some, DIM : 2 * DIM] = shares @ vectors[CONTENT:]
        out[some, 2 * DIM : 3 * DIM] = np.sqrt(shares) @ vectors[CONTENT:]
    out[:, -1] = np.log1p(words)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """A network for features x and labels y, trained by Adam on four fifths of the rows and calibrated on the others."""
    rng = np.random.default_rng(SEED)
    x, y = x.astype(np.float64), y.astype(np.float64)
    if len(y) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        width = x.shape[1] if len(y) else 3 * DIM + 1
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    order = rng.permutation(len(y))
    aside, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    z, t = (x[own] - mean) / scale, y[own]
    p = [rng.standard_normal((x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(rng.permutation(len(t)), max(1, len(t) // BATCH)):
            a, target = z[at], t[at]
            pre = a @ p[0] + p[1]
            hidden = np.maximum(pre, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -35, 35))) - target) / len(at)
            back = np.outer(error, p[2]) * (pre > 0)
            step += 1
            for k, g in enumerate([a.T @ back + DECAY * p[0], back.sum(axis=0), hidden.T @ error + DECAY * p[2], np.array([error.sum()])]):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    raw, t = net.logits(x[aside]), y[aside]
    loss = lambda log_t: np.logaddexp(0, np.where(t > 0, -raw, raw) / np.exp(log_t)).mean()
    low, high = -3.0, 3.0
    for _ in range(60):
        a, b = low + 0.382 * (high - low), low + 0.618 * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    net.temperature = float(np.exp((low + high) / 2))
    return net


def held_out(id_column: F.Column, folds: int = 5) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is never held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs with score, the calibrated probability of label 1.

    Learns from at most train_rows labelled rows whose id is not held out; labels,
    and all columns but the text, are no input of a score. Null labels and labels of
    unknown ids are ignored; of several labels of an id the mean counts, from a half
    up as 1. With fewer than ten usable labels, or labels of one class only, every
    score is their smoothed share of ones. Null texts are empty. All rows and columns of docs are kept, but for one
    named score. Without usable labels the score is one half for all.
    """
    spark = docs.sparkSession
    docs = docs.drop("score")
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text_col))
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("__label"))
        .orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    )
    texts = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("__key") == F.col("__id")).select("__id", "__label", "text")

    def features(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                values = pooled(part.column(2), vectors.value)
                flat = pa.array([row.tobytes() for row in values], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat], ["id", "label", "features"])

    found = written(rows.mapInArrow(features, "id long, label int, features binary"), "quality-train")
    # rows that repeat an id would pass the bound
    found = found.orderBy("id", "features").limit(train_rows).collect()
    x = np.array([np.frombuffer(bytes(r["features"]), np.float32) for r in found]).reshape(len(found), 3 * DIM + 1)
    net = spark.sparkContext.broadcast(fit(x, np.array([r["label"] for r in found])))
    names, at = docs.columns, docs.columns.index(text_col)

    def judge(batches):
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                scores = net.value.scores(pooled(part.column(at), vectors.value))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*names, "score"])

    return docs.mapInArrow(judge, docs.select(*names).schema.add("score", "double"))
