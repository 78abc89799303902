"""Stateful stream operators: duplicate tiers against an index in state, and stop rules in event order.

They need a state store that keeps entries apart (`rocksdb`): of a known text's shingles
only those that are asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text as T
from ..operators import dedup

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """The session with the state store that these operators need, while queries are started; the old one after that."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


# -- duplicate tiers ---------------------------------------------------------

TIERS = ("exact", "normalized", "near")
#: Keys of each stage of the tiers: a call serves all that a batch has of a bucket.
BUCKETS = 1024
#: Lists of a bucket after which they become one.
LISTS = 16
#: Pairs of one comparison of sizes, and shingles of one answer.
CELLS = 1 << 20
ANSWER = 10_000
# a processor's frames come with columns in this order, under names of their own
_ASKED = ["bucket", "row_id", "known", "text_key", "n", "g", "whole"]
_MET = ["bucket", "row_id", "tier", "own_key", "text_key", "shingles"]
_NEAR = ["bucket", "row_ids", "tier", "text_key", "shingles"]


def _taken(rows: Iterator[pd.DataFrame], names: list[str]) -> pd.DataFrame:
    return pd.concat([frame.set_axis(names, axis=1) for frame in rows], ignore_index=True)


class _Index(StatefulProcessor):
    """What is known under the signatures of a bucket, one list a batch: of whole texts the signatures, of shingles the keys and sizes of known texts. What asks gets an answer for each known text under its signature."""

    def __init__(self, threshold: float, ttl_ms: int | None):
        self.threshold, self.ttl_ms = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "whole array<string>, g binary, text binary, n binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _taken(rows, _ASKED)  # what a batch makes known holds for all of its rows
        told = frame["known"].to_numpy(bool)
        lists = list(self.known.get()) if self.known.exists() else []
        old = pd.concat([self._read(*part) for part in lists], ignore_index=True) if lists else pd.DataFrame()
        same = ["whole", "g", "text_key"]
        new = frame.loc[told, ["whole", "g", "text_key", "n"]].drop_duplicates(same)
        known = pd.concat([old, new], ignore_index=True) if len(old) else new
        again = known.duplicated(same).to_numpy()
        if self.ttl_ms is None:  # else what is told again lives anew
            new = known[len(old) :][~again[len(old) :]]
        known = known[~again]
        if self.ttl_ms is None and len(new) and len(lists) >= LISTS:
            self.known.put([self._listed(known)])
        elif len(new):
            self.known.appendValue(self._listed(new))
        asking = frame[~told]
        whole = asking.loc[(asking["whole"] != "").to_numpy() & asking["whole"].isin(known["whole"]).to_numpy(), ["row_id", "whole"]].drop_duplicates()
        if len(whole):
            tier = np.where(whole["whole"].str.startswith("e"), "exact", "normalized")
            yield pd.DataFrame({"row_id": whole["row_id"], "tier": tier, "own_key": None, "text_key": None})
        some = asking[(asking["whole"] == "").to_numpy()].drop_duplicates(["g", "text_key"])
        if len(some):
            yield from self._near(some, known[(known["whole"] == "").to_numpy()])

    def _listed(self, known: pd.DataFrame) -> tuple:
        """The list of a frame whose rows of shingles are packed, without fields of their own; whole texts come first."""
        whole = known["whole"].to_numpy(object) != ""
        some = known[~whole]
        return known["whole"][whole].tolist(), some["g"].to_numpy(np.int64).tobytes(), some["text_key"].to_numpy("S24").tobytes(), some["n"].to_numpy(np.int32).tobytes()

    def _read(self, whole: list, g: bytes, text: bytes, n: bytes) -> pd.DataFrame:
        more = np.zeros(len(whole), np.int64)
        keys = np.frombuffer(bytes(text), "S24").astype(str).astype(object)
        shingles, sizes = np.frombuffer(bytes(g), np.int64), np.frombuffer(bytes(n), np.int32)
        return pd.DataFrame({"whole": [*whole, *[""] * len(keys)], "g": np.concatenate([more, shingles]), "text_key": [*[""] * len(whole), *keys], "n": np.concatenate([more, sizes])})

    def _near(self, asking: pd.DataFrame, known: pd.DataFrame) -> Iterator[pd.DataFrame]:
        known = known.sort_values("g", kind="stable")
        shingles, texts, sizes = known["g"].to_numpy(), known["text_key"].to_numpy(object), known["n"].to_numpy()
        own, n, keys = asking["g"].to_numpy(), asking["n"].to_numpy(), asking["text_key"].to_numpy(object)
        low = np.searchsorted(shingles, own)
        met = np.searchsorted(shingles, own, side="right") - low
        upto, at = np.cumsum(met), 0
        while at < len(met):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, side="right")))
            count = met[at:end]
            x = np.repeat(np.arange(at, end), count)
            y = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count) + low[x]
            near = np.minimum(n[x], sizes[y]) > self.threshold * np.maximum(n[x], sizes[y])
            if near.any():
                yield pd.DataFrame({"row_id": None, "tier": "near", "own_key": keys[x[near]], "text_key": texts[y[near]]}).drop_duplicates(["own_key", "text_key"])
            at = end

    def close(self) -> None:
        pass


class _Carrier(StatefulProcessor):
    """Keeps nothing: a batch's texts that ask take their shingles, once, to each known text that may be near. Other tiers pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _taken(rows, _MET)
        tier = frame["tier"]
        for name in TIERS[:2]:
            ids = frame.loc[(tier == name).to_numpy(), "row_id"].tolist()
            if ids:
                yield pd.DataFrame({"row_ids": [ids], "tier": [name], "text_key": [None], "shingles": [None]})
        pairs = frame.loc[(tier == TIERS[2]).to_numpy(), ["own_key", "text_key"]].drop_duplicates()
        if not len(pairs):
            return
        asking = frame[tier.isna().to_numpy() & frame["own_key"].isin(pairs["own_key"]).to_numpy()]
        near = pairs.groupby("own_key")["text_key"].agg(list).to_dict()
        out, held = [], 0
        for own, some in asking.groupby("own_key"):
            ids, shingles = some["row_id"].drop_duplicates().tolist(), some["shingles"].iloc[0]
            for k in range(0, len(ids), ANSWER):
                for text in near[own]:
                    out.append((ids[k : k + ANSWER], None, text, shingles))
                    held += len(shingles) + len(ids[k : k + ANSWER])
                    if held >= CELLS:
                        yield pd.DataFrame(out, columns=_NEAR[1:])
                        out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=_NEAR[1:])

    def close(self) -> None:
        pass


class _Verifier(StatefulProcessor):
    """The shingles of a bucket's known texts, each under its key; texts that may be near one bring theirs. Other tiers pass."""

    def __init__(self, threshold: float, ttl_ms: int | None):
        self.threshold, self.ttl_ms = threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own = handle.getMapState("shingles", "text string", "shingles binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _taken(rows, _NEAR)
        passes = frame["tier"].notna().to_numpy()
        for ids, tier in frame.loc[passes, ["row_ids", "tier"]].itertuples(index=False):
            yield pd.DataFrame({"row_id": np.asarray(ids, object), "tier": tier})
        told = frame["row_ids"].isna().to_numpy()
        fresh = {}
        for text, shingles in frame.loc[told, ["text_key", "shingles"]].drop_duplicates("text_key").itertuples(index=False):
            fresh[text] = np.asarray(shingles, np.int64)
            self.own.updateValue((text,), (fresh[text].tobytes(),))
        out = []
        for text, asking in frame[~told & ~passes].groupby("text_key"):
            own = fresh.get(text)
            if own is None:
                if not self.own.containsKey((text,)):
                    continue
                own = np.frombuffer(bytes(self.own.getValue((text,))[0]), np.int64)
            for ids, shingles in zip(asking["row_ids"], asking["shingles"]):
                both = len(np.intersect1d(own, shingles, assume_unique=True))
                if both > self.threshold * (len(shingles) + len(own) - both):
                    out.extend(ids)
        if out:
            yield pd.DataFrame({"row_id": out, "tier": TIERS[2]})

    def close(self) -> None:
        pass


def fingerprints(rows: DataFrame, id_col: str, text: str, known: str, k: int = 5) -> DataFrame:
    """(row_id, known, e, text_key, shingles): keys of the text and of its normalised form, and the sorted hashes of its distinct shingles. Null texts are empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    once = rows.select(F.col(id_col).cast("string").alias("row_id"), F.col(known).alias("known"), F.sha2(body, 256).alias("e"), T.normalized_code(body).alias("t"))
    hashed = F.array_sort(F.array_distinct(F.transform(T.word_shingles("t", k), lambda g: F.xxhash64(g))))
    return once.select("row_id", "known", "e", F.sha2("t", 256).alias("text_key"), hashed.alias("shingles"))


def tier_evidence(rows: DataFrame, id_col: str, text: str, known: str, threshold: float = 0.85, k: int = 5, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The evidence of `fingerprints` of rows, made anew for each stage that takes them."""
    return evidence(fingerprints(rows, id_col, text, known, k), threshold, ttl_ms, buckets)


def evidence(base: DataFrame, threshold: float = 0.85, ttl_ms: int | None = None, buckets: int = BUCKETS, counts: np.ndarray | None = None) -> DataFrame:
    """(row_id, tier) for every tier by which a row of a stream of fingerprints repeats a text that was made known before it, or in its own batch.

    The stream is a log of two kinds: rows with `known` make their text known, the
    others ask. `settled` makes one row an asking row of a batch's evidence. The first
    stage has the signatures of texts: of the text, of its normalised form, and the
    first of its shingles in one order of all shingles. Of n shingles
    n - ceil(threshold * n) + 1 are enough for every pair that is more alike than
    threshold to meet. Any order finds all pairs, as long as it stays the same while
    the state is kept: that of hashes, or with counts (`shingle_counts` of what is
    there at the start) that of counts in hash buckets, which has frequent shingles
    last, so that few pairs meet that are not alike. The stage keeps, by signature, the
    keys and sizes of known texts. The second gives pairs that met the asking text's
    shingles, which so travel once a pair and not with each signature. The third keeps
    the shingles of each known text once, under 128 bits of its key, and verifies exactly. Whole
    texts' tiers pass through both, so that each stage runs once. Each stage's keys are
    dealt to `buckets`, so that a batch makes as many calls at most; the first reads
    what it keeps of the buckets that a batch meets, so an index of very many texts
    wants more. With ttl_ms a text is forgotten so long after it was last made known.
    Empty texts are near to none.
    """
    n, own = F.size("shingles"), F.base64(F.unhex(F.left("text_key", F.lit(32)))).alias("text_key")  # 128 bits, 24 characters
    cut = F.when(n > 0, n - F.ceil(n * F.lit(threshold)) + 1).otherwise(0).cast("int")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("bucket")
    mode = "None" if ttl_ms is None else "ProcessingTime"  # a time to live needs a clock; such a stream has no last batch
    if counts is None:
        prefix = base.select("known", own, n.alias("n"), F.explode(F.slice("shingles", F.lit(1), cut)).alias("g"))
    else:
        prefix = base.filter(n > 0).select("known", own, n.alias("n"), cut.alias("p"), F.col("shingles").alias("s")).mapInArrow(dedup.first_shingles(counts, ["known", "text_key"]), "known boolean, text_key string, n int, g long")
    none, empty = F.lit(None).cast("string"), F.lit("")
    whole = base.select("row_id", "known", F.explode(F.array(F.concat(F.lit("e"), "e"), F.concat(F.lit("n"), "text_key"))).alias("whole"))
    asked = prefix.select(bucket("g"), empty.alias("row_id"), "known", "text_key", "n", "g", empty.alias("whole"))
    asked = asked.unionByName(whole.select(bucket("whole"), "row_id", "known", empty.alias("text_key"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("g"), "whole"))
    met = asked.groupBy("bucket").transformWithStateInPandas(_Index(threshold, ttl_ms), "row_id string, tier string, own_key string, text_key string", "Append", mode)
    asking = base.filter(~F.col("known") & (n > 0)).select("row_id", none.alias("tier"), own.alias("own_key"), none.alias("text_key"), "shingles")
    answers = met.select("row_id", "tier", "own_key", "text_key", F.lit(None).cast("array<long>").alias("shingles"))
    carried = asking.unionByName(answers).select(bucket(F.coalesce("own_key", "row_id")), *_MET[1:]).groupBy("bucket").transformWithStateInPandas(_Carrier(), "row_ids array<string>, tier string, text_key string, shingles array<long>", "Append", mode)
    told = base.filter(F.col("known") & (n > 0)).select(F.lit(None).cast("array<string>").alias("row_ids"), none.alias("tier"), own, "shingles")
    verified = told.unionByName(carried).select(bucket(F.coalesce("text_key", F.element_at("row_ids", 1))), *_NEAR[1:]).groupBy("bucket").transformWithStateInPandas(_Verifier(threshold, ttl_ms), "row_id string, tier string", "Append", mode)
    return base.filter(~F.col("known")).select("row_id", none.alias("tier")).unionByName(verified)


def settled(evidence: DataFrame) -> DataFrame:
    """One row an asking row of a batch: the first tier that holds, or null."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    found = evidence.groupBy("row_id").agg(F.min(rank).alias("r"))
    return found.select("row_id", F.try_element_at(F.array(*map(F.lit, TIERS)), F.col("r").cast("int")).alias("tier"))


# -- stop rules --------------------------------------------------------------


def _due(at: int) -> int:
    """The millisecond at which a row of that microsecond is past; watermarks count milliseconds."""
    return -(-at // 1000)


class _StopRules(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them, then count in order of time and id."""

    def __init__(self, key: str, kind: str, target: int, max_calls: int, max_tokens: int, window: int, least_yield: float):
        self.key, self.kind = key, kind
        self.target, self.max_calls, self.max_tokens, self.window, self.least_yield = target, max_calls, max_tokens, window, least_yield

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, id {self.kind}, ok boolean, tokens long")
        self.run = handle.getValueState("run", "calls long, accepted long, tokens long, last array<int>, rule string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.run.exists() and self.run.get()[4]:
            return  # it has stopped
        fresh = []
        for frame in rows:
            _, _, at, ident, ok, tokens = (frame.iloc[:, k] for k in range(6))
            fresh += list(zip(at.tolist(), ident.tolist(), ok.astype(bool).tolist(), tokens.astype(int).tolist()))
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(_due(min(r[0] for r in fresh)))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        calls, accepted, tokens, last, rule = self.run.get() if self.run.exists() else (0, 0, 0, [], None)
        if rule or not rows:  # another timer was first
            return
        last, left = list(last), []
        for at, ident, ok, n in rows:
            if rule:
                break
            if _due(at) > passed:
                left.append((at, ident, ok, n))
                continue
            calls, accepted, tokens = calls + 1, accepted + int(ok), tokens + n
            last = [*last, int(ok)][-self.window :]
            low = len(last) == self.window and sum(last) / self.window < self.least_yield
            checks = (
                (accepted >= self.target, "target_total_reached"), (calls >= self.max_calls, "max_calls_budget_reached"),
                (tokens >= self.max_tokens, "max_tokens_budget_reached"), (low, "marginal_yield_decay_threshold_reached"),
            )
            rule = next((name for hit, name in checks if hit), None)
        self.run.update((calls, accepted, tokens, last, rule))
        if rule or not left:
            self.waiting.clear()
        elif len(left) < len(rows):
            self.waiting.put(left)
        if left and not rule:
            self.handle.registerTimer(_due(left[0][0]))
        if rule:
            yield pd.DataFrame({self.key: [key[0]], "calls": [calls], "rule": [rule], "accepted": [accepted], "tokens": [tokens]})

    def close(self) -> None:
        pass


def stop_rules_in_order(
    rows: DataFrame, ok: str, tokens: str, time: str, id_col: str, by: str, target: int, max_calls: int, max_tokens: int, window: int, least_yield: float, late: str = "10 minutes"
) -> DataFrame:
    """(by, calls, rule, accepted, tokens) once for each key, when a stop rule fires; rows count in the order of time and id, whatever order they arrive in.

    A row waits until the watermark, `late` behind the latest time seen, has passed
    it; rows that come later than that are let go. Rules and their rank are those of
    the batch operator. A key that has stopped keeps its totals only. Null ok counts
    as not ok, null tokens as 0; rows without a time are let go.
    """
    kind = rows.schema[by].dataType.simpleString()
    at = F.unix_micros(F.col(time).cast("timestamp"))
    due = F.timestamp_millis(F.ceil(at / 1000).cast("long"))
    taken = rows.filter(F.col(time).isNotNull()).withColumn("__time", due).withWatermark("__time", late).select(
        F.col(by).alias("__key"), "__time", at.alias("__at"), F.col(id_col).alias("__id"),
        F.coalesce(F.col(ok), F.lit(False)).alias("__ok"), F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long")).alias("__tokens"),
    )
    rule = _StopRules(by, rows.schema[id_col].dataType.simpleString(), target, max_calls, max_tokens, window, least_yield)
    return taken.groupBy("__key").transformWithStateInPandas(rule, f"{by} {kind}, calls long, rule string, accepted long, tokens long", "Append", "EventTime")


# -- running -----------------------------------------------------------------


def started(stream: DataFrame, out: str, checkpoint: str, each=lambda batch: batch, once: bool = True) -> StreamingQuery:
    """The stream, over what is there now if `once`; each(batch) of every batch becomes a folder of its own in out, which a batch that runs again replaces."""
    spark = stream.sparkSession

    def write(batch: DataFrame, epoch: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    to = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    with rocksdb(spark):
        return (to.trigger(availableNow=True) if once else to).start()


def filed(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """What the stream has now as a stream of files, each row once: work that several stages share is done once so."""
    to = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    to.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.readStream.schema(stream.schema).parquet(out)


def drained(stream: DataFrame, out: str, checkpoint: str, each=lambda batch: batch) -> None:
    """Runs the stream over what is there now, to its end."""
    started(stream, out, checkpoint, each).awaitTermination()
