"""Paired statistics: intervals, Hodges-Lehmann, Holm, and the routed hypothesis test.

Distribution functions are plain numpy. A metric's test is put together from sums over
a global order, so that no metric need fit in one task.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .ranges import running

Z975 = 1.959963984540054


# -- distribution functions --------------------------------------------------


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By bisection of the distribution function."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if normal_cdf(mid) < p else (low, mid)
    return (low + high) / 2


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: int) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: int) -> float:
    """For p above one half."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def shapiro(x: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation (AS R94), for 3 to 5000 values."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        u, mm = 1 / math.sqrt(n), float(m @ m)
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
        a = m.copy()
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
            scale = math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2))
            a /= scale
            a[-2], a[1] = second, -second
        else:
            a /= math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    return w, shapiro_p(w, n)


def shapiro_p(w: float, n: int) -> float:
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = math.log(1 - w) if w < 1 else -50.0
        if y >= g:
            return 0.0
        y, mu, sd = -math.log(g - y), np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        ln = math.log(n)
        y, mu, sd = math.log(max(1 - w, 1e-300)), np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return 1 - normal_cdf((y - mu) / sd)


def signed_ranks(deltas: np.ndarray) -> tuple[float, float, int, bool]:
    """Sums of the ranks of positive and negative deltas, how many are not zero, and whether absolute values tie."""
    d = np.asarray(deltas, float)
    d = d[d != 0]
    ranks = pd.Series(np.abs(d)).rank().to_numpy()
    return float(ranks[d > 0].sum()), float(ranks[d < 0].sum()), len(d), len(set(np.abs(d))) < len(d)


def wilcoxon(deltas: np.ndarray) -> tuple[float, float]:
    """min(W+, W-) and the two-sided p: exact up to 50 untied non-zero deltas, else by the normal with tie correction."""
    plus, minus, n, _ = signed_ranks(deltas)
    counts = pd.Series(np.abs(np.asarray(deltas, float)[np.asarray(deltas) != 0])).value_counts().to_numpy()
    return wilcoxon_from_sums(min(plus, minus), n, int((counts**3 - counts).sum()), len(deltas))


def wilcoxon_from_sums(w: float, n: int, ties: int, pairs: int) -> tuple[float, float]:
    """w with its p; ties: the sum of c^3 - c over the counts c of equal absolute deltas, of n that are not zero."""
    if not n:
        return 0.0, 1.0
    if n <= 50 and not ties and n == pairs:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        return w, min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - float(ties) / 48
    return w, 2 * normal_cdf((w - n * (n + 1) / 4) / math.sqrt(var)) if var > 0 else 1.0


def t_interval(d: np.ndarray, alpha: float = 0.05) -> tuple[float, float, float]:
    d = np.asarray(d, float)
    if len(d) < 2:
        centre = float(d.mean()) if len(d) else 0.0
        return centre, centre, centre
    margin = t_quantile(1 - alpha / 2, len(d) - 1) * float(d.std(ddof=1)) / math.sqrt(len(d))
    return float(d.mean()), float(d.mean() - margin), float(d.mean() + margin)


def pair_mean(d: np.ndarray, k: int) -> float:
    """The k-th smallest (from 1) of the n(n + 1)/2 means of pairs of sorted values, each with itself too; needs O(n) memory."""
    n = len(d)
    first = np.arange(n)

    def ends(x: float) -> np.ndarray:
        """For each i where the values end that give a mean up to x with it, i or more."""
        return np.maximum(np.searchsorted(d, 2 * x - d, side="right"), first)

    low, high = float(d[0]) - 1e-9 * (1 + abs(float(d[0]))), float(d[-1])
    # few enough pairs are left between low and high, or all that are left are equal
    while int((ends(high) - ends(low)).sum()) > 4 * n + 64 and high - low > 4 * np.finfo(float).eps * max(abs(low), abs(high)):
        middle = low + (high - low) / 2
        if int((ends(middle) - first).sum()) >= k:
            high = middle
        else:
            low = middle
    slack = 8 * np.finfo(float).eps * max(abs(low), abs(high), 1e-300)
    a, b = ends(low - slack), ends(high + slack)
    below = int((a - first).sum())
    if int((b - a).sum()) > 8 * n + 1024:  # all equal but for rounding
        some = int(np.argmax(b - a > 0))
        return float((d[some] + d[a[some]]) / 2)
    i = np.repeat(first, b - a)
    j = np.arange(len(i)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    return float(np.sort((d[i] + d[j]) / 2)[k - 1 - below])


def hodges_lehmann(d: np.ndarray, alpha: float = 0.05) -> tuple[float, float, float]:
    """The median of all pairwise means and its rank interval, without making the means."""
    d = np.sort(np.asarray(d, float))
    n = len(d)
    if not n:
        return 0.0, 0.0, 0.0
    m = n * (n + 1) // 2
    spread = normal_quantile(1 - alpha / 2) * math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    k = max(1, round(m / 2 - spread))
    centre = (pair_mean(d, (m + 1) // 2) + pair_mean(d, m // 2 + 1)) / 2
    return centre, pair_mean(d, k), pair_mean(d, m - k + 1)


def paired_test(base: np.ndarray, other: np.ndarray, alpha: float = 0.05, metrics: int = 1) -> dict:
    """The routed test: too few pairs, all equal, normal deltas (t) or not (Wilcoxon)."""
    n = min(len(base), len(other))
    b, c = np.asarray(base[:n], float), np.asarray(other[:n], float)
    d = c - b
    mean = lambda x: float(x.mean()) if n else 0.0
    limit = alpha / max(metrics, 1)
    out = {"pairs": n, "mean_baseline": mean(b), "mean_candidate": mean(c), "mean_delta": mean(c) - mean(b), "shapiro_p": None, "statistic": 0.0, "p_value": 1.0}
    if n < 3:
        return out | {"test": "insufficient_sample_size", "low": out["mean_delta"], "high": out["mean_delta"], "significant": False}
    if (np.abs(d) <= 1e-9).all():
        return out | {"test": "zero_delta_identical", "shapiro_p": 1.0, "mean_delta": 0.0, "low": 0.0, "high": 0.0, "significant": False}
    out["shapiro_p"] = shapiro(d)[1] if d.max() > d.min() else 1.0
    if out["shapiro_p"] > 0.05:
        sd = float(d.std(ddof=1))
        t = out["mean_delta"] / (sd / math.sqrt(n)) if sd else math.inf
        _, low, high = t_interval(d, alpha)
        out |= {"test": "paired_t_test", "statistic": t, "p_value": t_two_sided(t, n - 1) if math.isfinite(t) else 0.0, "low": low, "high": high}
    else:
        w, p = wilcoxon(d)
        _, low, high = hodges_lehmann(d, alpha)
        out |= {"test": "wilcoxon_signed_rank", "statistic": w, "p_value": p, "low": low, "high": high}
    return out | {"significant": out["p_value"] < limit}


PAIRED = "metric string, pairs int, mean_baseline double, mean_candidate double, mean_delta double, shapiro_p double, test string, statistic double, p_value double, low double, high double, significant boolean"


#: Deltas that one task takes whole, and distinct values that a chunk of a larger group has.
CHUNK = 1 << 16


def paired_tests(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row a metric of pairs (metric, key, b, c), keys distinct within a metric, with Holm's correction over the metrics.

    As `paired_test`, from sums: ranks come from a global order, so no metric is
    gathered, whatever its size. What is put together in the end is one row a metric.
    """
    d = pairs.select("metric", "key", "b", "c", (F.col("c") - F.col("b")).alias("d"))
    means = d.groupBy("metric").agg(F.avg("b").alias("mean_b"), F.avg("c").alias("mean_c"), F.stddev_samp("d").alias("sd"), F.max(F.abs("d")).alias("most"), F.avg("d").alias("mean_d"))
    quantile = F.pandas_udf(lambda p: p.map(NormalDist().inv_cdf), "double")
    ordered = d.select("metric", F.struct("d", "key").alias("o"), F.lit(1).alias("one"))
    ranked = running(ordered, "o", ["one"], ("metric",)).select("metric", F.col("o.d").alias("x"), F.col("one_upto").alias("i"), F.col("one_all").alias("n"))
    ranked = ranked.withColumn("m", quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    at = lambda k: F.max(F.when(F.col("i") == k, F.col("x")))
    sums = ranked.groupBy("metric").agg(
        F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("x")).alias("mx"), at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(F.col("n") - 1).alias("xp"), at(F.col("n")).alias("xn")
    )
    signed = signed_rank_statistic(d, "d", "metric").select("metric", F.col("n").alias("nonzero"), "statistic", "ties")
    joined = means.join(sums, "metric").join(signed, "metric", "left")
    names = [c.split()[0] for c in PAIRED.split(", ")]

    def route(frames):
        for frame in frames:
            yield pd.DataFrame([_routed(r, alpha) for r in frame.to_dict("records")], columns=names)

    routed = written(joined.mapInPandas(route, PAIRED), "paired-tests")
    skewed = routed.filter("test = 'wilcoxon_signed_rank'").select("metric")
    rank_based = hodges_lehmann_by(d.join(F.broadcast(skewed), "metric", "left_semi"), "metric", "d", alpha).select("metric", F.col("low").alias("hl_low"), F.col("high").alias("hl_high"))
    full = routed.join(rank_based, "metric", "left").withColumn("low", F.coalesce("hl_low", "low")).withColumn("high", F.coalesce("hl_high", "high")).select(*names)
    return holm(full, "p_value", "metric", alpha)


def shapiro_from_sums(n: int, mm: float, mx: float, x1: float, x2: float, xp: float, xn: float, squares: float) -> tuple[float, float]:
    """W and p as `shapiro` gives them: mm and mx are the sums of the normal scores' squares and of their products with the values in order, the x the outermost values."""
    quantile = lambda i: NormalDist().inv_cdf((i - 0.375) / (n + 0.25))
    if n == 3:
        inner, last, second = 0.0, math.sqrt(0.5), 0.0
    else:
        m1, m2, u = quantile(n), quantile(n - 1), 1 / math.sqrt(n)
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m1 / math.sqrt(mm)], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m2 / math.sqrt(mm)], u)
            scale = math.sqrt((mm - 2 * m1**2 - 2 * m2**2) / (1 - 2 * last**2 - 2 * second**2))
            inner = (mx - m1 * (xn - x1) - m2 * (xp - x2)) / scale
        else:
            second, inner = 0.0, (mx - m1 * (xn - x1)) / math.sqrt((mm - 2 * m1**2) / (1 - 2 * last**2))
    w = min(1.0, float((inner + second * (xp - x2) + last * (xn - x1)) ** 2 / squares))
    return w, shapiro_p(w, n)


def _routed(r: dict, alpha: float) -> tuple:
    """The row of PAIRED for one metric's sums; a rank test's interval is left to be filled."""
    n, b, c = int(r["n"]), r["mean_b"], r["mean_c"]
    delta = c - b
    head = (r["metric"], n, b, c)
    if n < 3:
        return (*head, delta, None, "insufficient_sample_size", 0.0, 1.0, delta, delta, False)
    if r["most"] <= 1e-9:
        return (*head, 0.0, 1.0, "zero_delta_identical", 0.0, 1.0, 0.0, 0.0, False)
    p = shapiro_from_sums(n, r["mm"], r["mx"], r["x1"], r["x2"], r["xp"], r["xn"], r["sd"] ** 2 * (n - 1))[1] if r["xn"] > r["x1"] else 1.0
    if p > 0.05:
        t = delta / (r["sd"] / math.sqrt(n)) if r["sd"] else math.inf
        margin = t_quantile(1 - alpha / 2, n - 1) * r["sd"] / math.sqrt(n)
        value = t_two_sided(t, n - 1) if math.isfinite(t) else 0.0
        return (*head, delta, p, "paired_t_test", t, value, r["mean_d"] - margin, r["mean_d"] + margin, value < alpha)
    w, value = wilcoxon_from_sums(r["statistic"], int(r["nonzero"]), int(r["ties"]), n)
    return (*head, delta, p, "wilcoxon_signed_rank", w, value, None, None, value < alpha)


def hodges_lehmann_by(deltas: DataFrame, key: str, value: str, alpha: float = 0.05) -> DataFrame:
    """(key, pairs, centre, low, high): the median of all pairwise means of each group and its rank interval.

    A group of up to CHUNK values is one task's. Larger ones, of which there are few
    for their size, are cut into chunks of sorted values, and their four order
    statistics are found by bisection, each step one job over pairs of chunks whose
    means may lie on both sides of a probe.
    """
    kind = deltas.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, pairs long, centre double, low double, high double"
    large = deltas.groupBy(F.col(key).alias("__k")).agg(F.count(value).alias("__n")).filter(F.col("__n") > CHUNK)
    sizes = {r["__k"]: r["__n"] for r in large.collect()}  # at most one for each CHUNK rows
    same = F.col(key).eqNullSafe(F.col("__k"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        centre, low, high = hodges_lehmann(frame[value].to_numpy(), alpha)
        return pd.DataFrame({key: [frame[key].iloc[0]], "pairs": [len(frame)], "centre": [centre], "low": [low], "high": [high]})

    rows = deltas.select(key, value)
    small = rows.join(F.broadcast(large), same, "left_anti") if sizes else rows
    found = small.groupBy(key).applyInPandas(run, schema)
    if not sizes:
        return found
    big = _by_bisection(rows.join(F.broadcast(large), same, "left_semi"), key, value, sizes, alpha)
    return found.unionByName(deltas.sparkSession.createDataFrame(big, schema))


def _ordinal(x: float) -> int:
    """Doubles in order as whole numbers."""
    bits = int(np.float64(x).view(np.int64))
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def _double(k: int) -> float:
    return float(np.int64(k).view(np.float64)) if k >= 0 else -float(np.int64(-k).view(np.float64))


#: Probes of an order statistic in one step.
PROBES = 15


def _by_bisection(rows: DataFrame, key: str, value: str, sizes: dict, alpha: float) -> list[tuple]:
    """The rows of hodges_lehmann_by for large groups."""
    spark = rows.sparkSession
    counted = rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = running(counted.withColumn("one", F.lit(1)), "v", ["one"], (key,)).withColumn("chunk", F.floor((F.col("one_upto") - 1) / CHUNK).cast("int"))
    entries = F.array_sort(F.collect_list(F.struct("v", "c")))
    chunks = written(placed.groupBy(key, "chunk").agg(entries.alias("e"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum("c").alias("n")), "walsh-chunks")
    bounds: dict = {}
    for r in chunks.select(key, "chunk", "low", "high", "n").orderBy("chunk").collect():
        bounds.setdefault(r[key], []).append((r["low"], r["high"], r["n"]))
    bounds = {k: np.array(b, float) for k, b in bounds.items()}
    targets = {}  # (group, order statistic): the ordinals between which it lies, and its rank
    for k, n in sizes.items():
        m = n * (n + 1) // 2
        rank = max(1, round(m / 2 - normal_quantile(1 - alpha / 2) * math.sqrt(n * (n + 1) * (2 * n + 1) / 24)))
        ends = (_ordinal(bounds[k][0, 0]) - 1, _ordinal(bounds[k][-1, 1]))
        targets |= {(k, name): (*ends, place) for name, place in (("a", (m + 1) // 2), ("b", m // 2 + 1), ("low", rank), ("high", m - rank + 1))}
    while any(high - low > 1 for low, high, _ in targets.values()):
        probes = sorted({(k, low + (high - low) * j // (PROBES + 1)) for (k, _), (low, high, _) in targets.items() if high - low > 1 for j in range(1, PROBES + 1)} - {(k, low) for (k, _), (low, _, _) in targets.items()}, key=repr)
        counts = _means_upto(spark, chunks, key, bounds, [(k, _double(o)) for k, o in probes])
        for name, (low, high, rank) in targets.items():
            for (k, o), n in zip(probes, counts):
                if k == name[0] and low < o < high:
                    low, high = (low, o) if n >= rank else (o, high)
            targets[name] = (low, high, rank)
    at = lambda k, name: _double(targets[k, name][1])
    return [(k, n, (at(k, "a") + at(k, "b")) / 2, at(k, "low"), at(k, "high")) for k, n in sizes.items()]


def _means_upto(spark, chunks: DataFrame, key: str, bounds: dict, probes: list[tuple]) -> list[int]:
    """For each (group, x) how many means of two values, or of one with itself, are x or less."""
    ordered, own, open_pairs = [0] * len(probes), [0] * len(probes), []
    for i, (k, x) in enumerate(probes):
        low, high, n = bounds[k].T
        whole = np.searchsorted(high, 2 * x - high, side="right")  # chunks that lie below with all of p's values
        some = np.searchsorted(low, 2 * x - low, side="right")  # and those that do with some
        upto = np.concatenate([[0], np.cumsum(n)])
        ordered[i] = int((n * upto[whole]).sum())
        open_pairs += [(k, p, q, i, float(x)) for p in range(len(n)) for q in range(int(whole[p]), int(some[p]))]
        own[i] = int(upto[np.searchsorted(high, x, side="right")])
        open_pairs += [(k, p, -1, i, float(x)) for p in np.flatnonzero((low <= x) & (high > x)).tolist()]
    kind = chunks.schema[key].dataType.simpleString()
    wanted = spark.createDataFrame(open_pairs, f"{key} {kind}, chunk int, other int, i int, x double")
    left = chunks.select(F.col(key).alias("__k"), F.col("chunk").alias("__p"), F.col("e").alias("mine"))
    right = chunks.select(F.col(key).alias("__k2"), F.col("chunk").alias("__q"), F.col("e").alias("theirs"))
    met = wanted.join(left, F.col(key).eqNullSafe(F.col("__k")) & (F.col("chunk") == F.col("__p")))
    met = met.join(right, F.col(key).eqNullSafe(F.col("__k2")) & (F.col("other") == F.col("__q")), "left").select("i", "x", "mine", "theirs")

    def count(batches):
        for batch in batches:
            found = []
            for k in range(len(batch)):
                x = batch.column(1)[k].as_py()
                v, c = (np.asarray(f) for f in batch.column(2)[k].values.flatten())
                if not batch.column(3)[k].is_valid:
                    found.append(-int(c[v <= x].sum()) - 1)  # of single values, told from the others by its sign
                    continue
                w, d = (np.asarray(f) for f in batch.column(3)[k].values.flatten())
                upto = np.concatenate([[0], np.cumsum(d)])
                found.append(int((c * upto[np.searchsorted(w, 2 * x - v, side="right")]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["i", "n"])

    summed = met.mapInArrow(count, "i int, n long").groupBy("i").agg(F.sum(F.when(F.col("n") >= 0, F.col("n"))).alias("pairs"), F.sum(F.when(F.col("n") < 0, -F.col("n") - 1)).alias("own"))
    for r in summed.collect():
        ordered[r["i"]] += r["pairs"] or 0
        own[r["i"]] += r["own"] or 0
    return [(a + b) // 2 for a, b in zip(ordered, own)]


# -- in columns --------------------------------------------------------------


def holm(rows: DataFrame, p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """rows with rank, alpha_k, adjusted_p and is_significant of Holm's step-down; one row a metric, so few."""
    order = Window.orderBy(p, tie)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    left = F.count("*").over(Window.partitionBy()) - F.col("rank") + 1
    out = rows.withColumn("rank", F.row_number().over(order)).withColumn("left", left)
    out = out.withColumn("alpha_k", F.lit(alpha) / F.col("left"))
    return out.select(
        "*", F.least(F.lit(1.0), F.max(F.col(p) * F.col("left")).over(upto)).alias("adjusted_p"), F.min((F.col(p) < F.col("alpha_k")).cast("int")).over(upto).cast("boolean").alias("is_significant")
    ).drop("left")


def normal_interval(deltas: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean delta with 1.96 standard errors to either side; a single delta is its own interval."""
    found = deltas.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    margin = F.when(F.col("n") > 1, 1.96 * F.col("sd") / F.sqrt(F.col("n"))).otherwise(0.0)
    return found.select(*by, "n", "mean", (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"))


def signed_rank_statistic(deltas: DataFrame, value: str, *by: str) -> DataFrame:
    """min(W+, W-) of each group's non-zero deltas, average ranks for ties; ranks come from counts of distinct values."""
    d = F.col(value)
    counted = deltas.filter(d != 0).groupBy(*by, F.abs(d).alias("a")).agg(F.count_if(d > 0).alias("up"), F.count_if(d < 0).alias("down"))
    c = F.col("c")
    ranked = running(counted.withColumn("c", F.col("up") + F.col("down")), "a", ["c"], by).withColumn("r", F.col("c_upto") - (c - 1) / 2.0)
    found = ranked.groupBy(*by).agg(F.sum(c).alias("n"), F.sum(F.col("r") * F.col("up")).alias("w_plus"), F.sum(F.col("r") * F.col("down")).alias("w_minus"), F.sum(c * c * c - c).alias("ties"))
    return found.withColumn("statistic", F.least("w_plus", "w_minus"))


def percentile_interval(rows: DataFrame, value: str, *by: str, alpha: float = 0.05) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return rows.groupBy(*by).agg(p.alias("p")).select(*by, F.col("p")[0].alias("median"), F.col("p")[1].alias("low"), F.col("p")[2].alias("high"))
