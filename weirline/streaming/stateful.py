"""Streaming: watermarked windows, and state where the order of single rows counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_event_time(df: DataFrame, delay: str) -> DataFrame:
    """df with event_time, watermarked: rows later than the delay are dropped, as a buffer of that length would."""
    return df.withColumn("event_time", F.timestamp_micros(F.expr("timestamp div 1000"))).withWatermark("event_time", delay)


def window_counts(df: DataFrame, *, seconds: int, keys: list[str], delay: str, value=None) -> DataFrame:
    """keys, bucket_start, n and, if a value column is given, total: each window once, when the watermark passes it."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value is not None else [])
    made = with_event_time(df, delay).groupBy(F.window("event_time", f"{seconds} seconds"), *keys).agg(*aggs)
    return made.select(*keys, F.unix_seconds("window.start").alias("bucket_start"), *[c for c in made.columns if c in ("n", "total")])


def heartbeat_alerts(df: DataFrame, *, timeout: int = 30, throttle: int = 300) -> DataFrame:
    """hostname, status, at (ms), alert: each host's state at each batch it is in, and an alert when
    it has been silent for the timeout, repeated after the throttle at the earliest."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (host,) = key
        last, alerted = state.get if state.exists else (0, 0)
        now = state.getCurrentProcessingTimeMs()
        if state.hasTimedOut:
            due = now - alerted > throttle * 1000
            alert = f"Missing Heartbeat - {host}\n" if due else None
            state.update((last, now if due else alerted))
            state.setTimeoutDuration(throttle * 1000)
            yield pd.DataFrame({"hostname": [host], "status": ["down"], "at": [now], "alert": [alert]})
            return
        newest = max((int(f["timestamp"].max()) // 1_000_000 for f in frames if len(f)), default=last)
        state.update((max(last, newest), alerted))
        state.setTimeoutDuration(timeout * 1000)
        yield pd.DataFrame({"hostname": [host], "status": ["up"], "at": [max(last, newest)], "alert": [None]})

    rows = df.select("hostname", "timestamp")
    return rows.groupBy("hostname").applyInPandasWithState(run, "hostname string, status string, at bigint, alert string", "last bigint, alerted bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


def frequent_items(df: DataFrame, item: str, *, keys: list[str], max_items: int = 1000, reset_days: int = 1) -> DataFrame:
    """keys, item, weight after each batch: at most max_items counters a key.

    The items of a batch are counted first and added to the counters; if there
    are more than max_items then, the largest that has no room is taken from
    all, and counters at zero go, so that a weight is too low by the share of
    1 / (max_items + 1) of all rows at most.  Weights start afresh every
    reset_days (UTC), and rows of an earlier day are left out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, weights, day = state.get if state.exists else ([], [], 0)
        counts = pd.Series(weights, index=pd.Index(names, dtype=object), dtype="int64")
        rows = pd.concat(list(frames))
        days = rows["timestamp"] // 86_400_000_000_000 if reset_days else 0 * rows["timestamp"]
        for today, items in rows["_item"].groupby(days):
            if reset_days and today < day:
                continue
            if reset_days and today - day >= reset_days:
                counts, day = counts[:0], int(today)
            counts = counts.add(items.value_counts(), fill_value=0).astype("int64")
            if len(counts) > max_items:
                counts = counts - counts.nlargest(max_items + 1).iloc[-1]
                counts = counts[counts > 0]
        counts = counts.to_dict()
        state.update((list(counts), list(counts.values()), day))
        yield pd.DataFrame({**{k: [v] * len(counts) for k, v in zip(keys, key, strict=True)}, "item": list(counts), "weight": list(counts.values())})

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    rows = df.select(*keys, "timestamp", F.col(item).alias("_item")).where(F.col("_item").isNotNull())
    return rows.groupBy(*keys).applyInPandasWithState(run, f"{types}, item string, weight bigint", "names array<string>, weights array<bigint>, day bigint", "update", GroupStateTimeout.NoTimeout)


def throttle(df: DataFrame, *, key: str = "logger", seconds: int = 3600) -> DataFrame:
    """key, timestamp, payload of the alerts that pass: none within `seconds` of the last that did."""
    limit = seconds * 1_000_000_000

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("timestamp", kind="stable")
        passed = []
        for i, ts in enumerate(rows["timestamp"]):
            if last is None or ts - last >= limit:
                last = int(ts)
                passed.append(i)
        state.update((last,))
        yield rows.iloc[passed][[key, "timestamp", "payload"]]

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, "timestamp", "payload").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, timestamp bigint, payload string", "last bigint", "append", GroupStateTimeout.NoTimeout)
