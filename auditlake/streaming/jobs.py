"""Structured Streaming forms of the log-driven operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def tailed(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 50) -> DataFrame:
    """An append-only folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def stage_windows(events: DataFrame, time: str, stage: str, value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling windows of a stage's count, sum and largest value; rows later than the watermark are let go."""
    found = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), stage)
    return found.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest")).select("w.start", "w.end", stage, "n", "total", "largest")


def run_sessions(events: DataFrame, time: str, run: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a run's events, closed by a gap."""
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), run)
    return found.agg(F.count("*").alias("n")).select(run, "w.start", "w.end", "n")


def first_seen(rows: DataFrame, identity: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows whose identity was not seen within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([identity])


def accepted_once(rows: DataFrame, key: str, identity: str, accepted: str) -> DataFrame:
    """For each row whether it repeats an *accepted* identity of its key; the state is one flag for each key and identity."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, identity)}

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState):
        seen = state.get[0] if state.exists else False
        for frame in frames:
            repeats = []
            for ok in frame[accepted]:
                repeats.append(seen)
                seen = seen or bool(ok)
            yield pd.DataFrame({key: [k[0]] * len(frame), identity: [k[1]] * len(frame), "duplicate": repeats})
        state.update((seen,))

    return rows.groupBy(key, identity).applyInPandasWithState(
        run, f"{key} {kinds[key]}, {identity} {kinds[identity]}, duplicate boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout
    )


def stop_rule_state(rows: DataFrame, key: str, target: int, max_calls: int, max_tokens: int, window: int, least_yield: float, order: list[str] | None = None) -> DataFrame:
    """rows (ok boolean, tokens long) counted for each key until a stop rule fires; emits the running state a batch.

    With `order`, a key's rows of a batch are taken in that order.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState):
        calls, accepted, tokens, last, rule = state.get if state.exists else (0, 0, 0, [], None)
        last = list(last)
        for frame in [pd.concat(list(frames)).sort_values(order, kind="stable")] if order else frames:
            for ok, n in zip(frame["ok"], frame["tokens"]):
                if rule:
                    break
                calls, accepted, tokens = calls + 1, accepted + int(ok), tokens + int(n)
                last = [*last, int(ok)][-window:]
                low = len(last) == window and sum(last) / window < least_yield
                checks = (
                    (accepted >= target, "target_total_reached"), (calls >= max_calls, "max_calls_budget_reached"),
                    (tokens >= max_tokens, "max_tokens_budget_reached"), (low, "marginal_yield_decay_threshold_reached"),
                )
                rule = next((name for hit, name in checks if hit), None)
        state.update((calls, accepted, tokens, last, rule))
        yield pd.DataFrame({key: [k[0]], "calls": [calls], "accepted": [accepted], "tokens": [tokens], "rule": [rule]})

    return rows.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, calls long, accepted long, tokens long, rule string", "calls long, accepted long, tokens long, last array<int>, rule string", "update", GroupStateTimeout.NoTimeout
    )


def started(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """The stream into a memory table, over what is there now."""
    return stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
