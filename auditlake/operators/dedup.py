"""Set operations, exact and near-duplicate removal, contamination exclusion."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written


#: Rows of a shingle that one part of a join takes.
POSTINGS = 1000
#: Hash buckets whose counts put shingles in order.
COUNTERS = 1 << 20
#: Vectors of a cell that one task compares with as many others.
CELL = 1024


def first_by(rows: DataFrame, identity: Column, order: str) -> DataFrame:
    """Of rows with one identity the first in order. A min-by with map-side combining, so no group is gathered."""
    best = rows.groupBy(identity.alias("__identity")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("r"))
    return best.select("r.*")


def excluded(rows: DataFrame, text: str, banned: DataFrame, banned_text: str) -> DataFrame:
    """rows whose text is not banned, neither as it is nor with comments, white space and case put aside."""
    keys = lambda t: F.array(F.sha2(t, 256), F.sha2(T.normalized_code(t), 256))
    bad = banned.select(F.explode(keys(F.col(banned_text))).alias("__key")).distinct()
    exact, norm = F.sha2(F.col(text), 256), F.sha2(T.normalized_code(text), 256)
    return rows.withColumn("__e", exact).withColumn("__n", norm).join(bad, F.col("__e") == F.col("__key"), "left_anti").join(bad, F.col("__n") == F.col("__key"), "left_anti").drop("__e", "__n")


def duplicate_tiers(rows: DataFrame, id_col: str, text: str, known: DataFrame, known_text: str, threshold: float = 0.85) -> DataFrame:
    """rows with tier: exact, normalized or near, the first by which a row repeats a known text, or null.

    near: the shingle sets of the normalised texts are more alike than threshold.
    """
    exact_key = lambda t: F.unhex(F.sha2(t, 256))
    same_key = lambda t: F.unhex(F.sha2(T.normalized_code(t), 256))
    exact = known.select(exact_key(F.col(known_text)).alias("__e")).distinct().withColumn("__exact", F.lit(True))
    same = known.select(same_key(F.col(known_text)).alias("__n")).distinct().withColumn("__same", F.lit(True))
    # one row a text, without the text
    keys = rows.select(exact_key(F.col(text)).alias("__e"), same_key(F.col(text)).alias("__n")).distinct()
    marked = written(keys.join(exact, "__e", "left").join(same, "__n", "left"), "tiers")
    # one row a normalised text, known ones and such as no tier has taken yet
    left = marked.filter("__exact IS NULL AND __same IS NULL").select("__n").distinct()
    open_texts = rows.select(same_key(F.col(text)).alias("__n"), F.col(text).alias("t")).join(left, "__n", "left_semi").select(F.col("__n").alias("id"), T.normalized_code("t").alias("t"))
    known_texts = known.select(same_key(F.col(known_text)).alias("id"), T.normalized_code(known_text).alias("t"))
    near = shingle_matches(open_texts, known_texts, "id", "t", threshold).select(F.col("a").alias("__n")).distinct().withColumn("__near", F.lit(True))
    tier = F.when(F.col("__exact"), "exact").when(F.col("__same"), "normalized").when(F.col("__near"), "near")
    tiers = marked.join(near, "__n", "left").select("__e", tier.alias("tier"))
    return rows.withColumn("__e", exact_key(F.col(text))).join(tiers, "__e", "left").select(*rows.columns, "tier")


def unseen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def _shingle_texts(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(u, id, t): each distinct text with a number of its own, under the smallest of its ids."""
    texts = rows.groupBy(F.col(text).alias("t")).agg(F.min(id_col).alias("id"))
    return written(texts.withColumn("u", F.monotonically_increasing_id()), "shingle-texts")


def _shingle_sets(texts: DataFrame, k: int) -> DataFrame:
    """texts with, for t, its hashed shingles s and their number n."""
    hashed = F.array_distinct(F.transform(T.word_shingles("t", k), lambda g: F.xxhash64(g)))
    return texts.withColumn("s", hashed).drop("t").withColumn("n", F.size("s")).filter("n > 0")


def _shingle_prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(u, known, n, g): of each set the n - ceil(threshold * n) + 1 shingles that come first in one order of all shingles.

    Every pair of sets that are alike enough shares one. The order is that of counts
    in COUNTERS hash buckets, then of the hashes: any order finds all pairs, and this
    one has the frequent shingles last without a shuffle of all of them.
    """
    cut = F.expr(f"cast(n - ceil(n * {threshold}) + 1 as int)")
    taken = sets.select("u", "known", "n", cut.alias("p"), "s").mapInArrow(first_shingles(shingle_counts(sets), ["u", "known"]), "u long, known boolean, n int, g long")
    return written(taken, "shingle-prefixes")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many of the sets s have a shingle of each of COUNTERS hash buckets."""
    found = sets.select(F.explode("s").alias("g")).groupBy(F.pmod("g", F.lit(COUNTERS)).alias("k")).agg(F.count("*").alias("c")).toArrow()
    counts = np.zeros(COUNTERS, np.uint32)
    counts[found.column("k").to_numpy()] = np.minimum(found.column("c").to_numpy(), np.iinfo(np.uint32).max)
    return counts


def first_shingles(counts: np.ndarray, names: list[str]):
    """The function of batches (*names, n, p, s) that gives (*names, n, g) for the p shingles g of each set s of n that come first in the order of counts."""
    at_n = len(names)

    def run(batches):
        for batch in batches:
            upto = np.cumsum(batch.column(at_n).to_numpy().astype(np.int64))
            at = 0
            while at < len(batch):  # some rows at a time, about a million shingles
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 20), "right")))
                part = batch.slice(at, end - at)
                at = end
                n, take = part.column(at_n).to_numpy().astype(np.int64), part.column(at_n + 1).to_numpy()
                g = part.column(at_n + 2).flatten().to_numpy()
                row = np.repeat(np.arange(len(part)), n)
                order = np.lexsort((g, counts[g % len(counts)], row))
                keep = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n) < take[row]
                own = pa.array(row[keep])
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(own) for k in range(at_n + 1)), pa.array(g[order][keep])], [*names, "n", "g"])

    return run


def _alike(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, b, jaccard) of candidate pairs (u, u2) of texts whose sets are more alike than threshold; only these texts' sets are made again."""
    pairs = written(pairs, "shingle-candidates")
    if left is right:
        used = pairs.select("u").unionByName(pairs.select(F.col("u2").alias("u"))).distinct()
        one = two = written(_shingle_sets(left.join(used, "u", "left_semi"), k), "shingle-sets")
    else:
        one = written(_shingle_sets(left.join(pairs.select("u").distinct(), "u", "left_semi"), k), "shingle-sets")
        two = written(_shingle_sets(right.join(pairs.select(F.col("u2").alias("u")).distinct(), "u", "left_semi"), k), "shingle-sets")
    other = two.select(F.col("u").alias("u2"), F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    full = pairs.join(one.select("u", "id", "s", "n"), "u").join(other, "u2")
    both = F.size(F.array_intersect("s", "s2"))
    return full.select(F.col("id").alias("a"), F.col("id2").alias("b"), (both / (F.col("n") + F.col("n2") - both)).alias("jaccard")).filter(f"jaccard > {threshold}")


def shingle_pairs(rows: DataFrame, id_col: str, text: str, threshold: float = 0.85, k: int = 5) -> DataFrame:
    """(a, b, jaccard) of rows whose shingle sets are more alike than threshold; equal texts are one, named by the smallest id.

    An exact join on prefixes. Shingles are 64-bit hashes; one that more than POSTINGS
    prefixes have is spread over as many parts as it needs.
    """
    texts = _shingle_texts(rows, id_col, text)
    prefix = _shingle_prefixes(_shingle_sets(texts, k).withColumn("known", F.lit(False)), threshold).drop("known")
    frequency = prefix.groupBy("g").agg(F.count("*").alias("df")).filter("df > 1")
    held = prefix.join(frequency, "g")
    parts = F.ceil(F.col("df") / F.lit(POSTINGS)).cast("int")
    left = held.select("u", "n", "g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = held.select(F.col("u").alias("u2"), F.col("n").alias("n2"), "g", F.pmod(F.xxhash64("u"), parts).cast("int").alias("part"))
    pairs = left.join(right, ["g", "part"]).filter(f"u < u2 AND least(n, n2) >= {threshold} * greatest(n, n2)").select("u", "u2").distinct()
    return _alike(pairs, texts, texts, threshold, k).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")


def shingle_matches(rows: DataFrame, known: DataFrame, id_col: str, text: str, threshold: float = 0.85, k: int = 5) -> DataFrame:
    """(a, b, jaccard) of a row and a known text whose shingle sets are more alike than threshold; equal texts of a side are one.

    As `shingle_pairs`, but candidates are of one row and one known text only: a shingle
    that one side alone has leads nowhere, however often it stands there, and no pair
    within a side is made.
    """
    sides = [_shingle_texts(x, id_col, text) for x in (rows, known)]
    sets = [_shingle_sets(x, k).withColumn("known", F.lit(is_known)) for x, is_known in zip(sides, (False, True))]
    prefix = _shingle_prefixes(sets[0].unionByName(sets[1]), threshold)
    frequency = prefix.groupBy("g").agg(F.count_if(F.col("known")).alias("dk"), F.count_if(~F.col("known")).alias("dr")).filter("dk > 0 AND dr > 0")
    held = prefix.join(frequency, "g")
    # the rows of a shingle meet its known texts in as many parts as these need
    parts = F.ceil(F.col("dk") / F.lit(POSTINGS)).cast("int")
    left = held.filter("NOT known").select("u", "n", "g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = held.filter("known").select(F.col("u").alias("u2"), F.col("n").alias("n2"), "g", F.pmod(F.xxhash64("u"), parts).cast("int").alias("part"))
    pairs = left.join(right, ["g", "part"]).filter(f"least(n, n2) >= {threshold} * greatest(n, n2)").select("u", "u2").distinct()
    return _alike(pairs, *sides, threshold, k)


def bands_for(n: int, threshold: float) -> tuple[int, int]:
    """How many bits a band has for n vectors, and how many bands it takes to miss a pair at threshold once in 10^9."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / CELL)) if n > CELL else 4)
    agree = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return bits, max(1, math.ceil(math.log(1e-9) / math.log1p(-min(agree**bits, 1 - 1e-12))))


def cosine_pairs(rows: DataFrame, id_col: str, vector: str, threshold: float, seed: int = 42) -> DataFrame:
    """(a, b, cosine) of vectors at threshold or above; equal vectors are one, named by the smallest id.

    Vectors meet where a band of their signs against random hyperplanes agrees. The
    bands are as many as it takes to miss a pair at the threshold with a probability
    of 10^-9, and nearer pairs with less. A cell with more than CELL vectors is dealt
    as pairs of chunks, so that no task holds more than two chunks. Null, zero and
    non-finite vectors, and those of another length than most, take no part.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    units = written(rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v")).groupBy("v").agg(F.min("id").alias("id")), "cosine-units")
    width = units.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (width["d"], units.count()) if width else (1, 0)
    bits, bands = bands_for(n, threshold)
    kind = rows.schema[id_col].dataType.simpleString()
    names = ["band", "cell", "id", "v"]

    def placed(batches):
        planes = np.random.default_rng(seed).standard_normal((max(dim, 1), bits * bands))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                values = part.column(0).to_pylist()
                fit = [k for k, x in enumerate(values) if x is not None and len(x) == dim and None not in x]
                found = np.array([values[k] for k in fit], float).reshape(-1, dim)
                good = np.isfinite(found).all(axis=1) & found.any(axis=1)
                found, ids = found[good], part.column(1).take(pa.array(np.array(fit, np.int64)[good]))
                found = found / np.abs(found).max(axis=1, initial=0, keepdims=True)
                found /= np.sqrt((found * found).sum(axis=1, keepdims=True))
                cells = ((found @ planes > 0).reshape(-1, bands, bits) * weights).sum(axis=2)
                many = pa.array(np.repeat(np.arange(len(found)), bands))
                own = pa.array([x.tobytes() for x in found], pa.binary())
                columns = [pa.array(np.tile(np.arange(bands, dtype=np.int32), len(found))), pa.array(cells.reshape(-1)), ids.take(many), own.take(many)]
                yield pa.RecordBatch.from_arrays(columns, names)

    cells = written(units.select("v", "id").mapInArrow(placed, f"band int, cell long, id {kind}, v binary"), "cosine-cells")
    sizes = cells.groupBy("band", "cell").agg(F.count("*").alias("size")).filter("size > 1")
    dealt = cells.join(sizes, ["band", "cell"]).withColumn("chunks", F.ceil(F.col("size") / F.lit(CELL)).cast("int"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("band", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "v")

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.frombuffer(b"".join(frame["v"]), float).reshape(len(frame), -1)
        ids, mine = frame["id"].to_numpy(), frame["mine"].to_numpy()
        out = []
        for at in range(0, len(frame), 512):
            cosine = vectors[at : at + 512] @ vectors.T
            x, y = np.nonzero(cosine >= threshold - 1e-9)
            keep = ids[x + at] < ids[y]
            if frame["i"].iloc[0] != frame["j"].iloc[0]:
                keep &= mine[x + at] != mine[y]
            out.append(pd.DataFrame({"a": ids[x + at][keep], "b": ids[y][keep]}))
        return pd.concat(out)

    pairs = dealt.groupBy("band", "cell", "i", "j").applyInPandas(met, f"a {kind}, b {kind}").distinct()
    # the exact measure, once a pair
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    side = lambda c: units.select(F.col("id").alias(c), F.col("v").alias(f"v_{c}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    cosine = dot(F.col("v_a"), F.col("v_b")) / (F.sqrt(dot(F.col("v_a"), F.col("v_a"))) * F.sqrt(dot(F.col("v_b"), F.col("v_b"))))
    return full.select("a", "b", cosine.alias("cosine")).filter(F.col("cosine") >= threshold)


def leaders(rows: DataFrame, id_col: str, pairs: DataFrame) -> DataFrame:
    """rows kept by greedy leader selection in id order: a row goes if a kept row with a smaller id is its pair.

    pairs (a, b), a < b. Each round keeps the rows without an undecided smaller
    partner, drops partners of kept rows, and goes on with the pairs of rows that are
    still undecided, until there are none. There are as many rounds as the longest
    chain of rows of which each waits for the one before; each round's pairs and
    decisions are written.
    """
    edges = written(pairs.select("a", "b").distinct(), "leader-edges")
    gone = None
    while not edges.isEmpty():
        waits = edges.select(F.col("b").alias("id")).distinct()
        kept = edges.select(F.col("a").alias("id")).distinct().join(waits, "id", "left_anti")
        dropped = written(edges.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "leader-dropped")
        gone = dropped if gone is None else gone.unionByName(dropped)
        # what is left: pairs of which neither row is decided
        left = edges.join(kept.withColumnRenamed("id", "a"), "a", "left_anti")
        for side in ("a", "b"):
            left = left.join(dropped.withColumnRenamed("id", side), side, "left_anti")
        edges = written(left, "leader-edges")
    return rows if gone is None else rows.join(gone.select(F.col("id").alias(id_col)), id_col, "left_anti")


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))
