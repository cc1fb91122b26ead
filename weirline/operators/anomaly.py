"""Anomalies of bucketed series: rate of change, Mann-Whitney tests, throttled alerts, annotations."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Test:
    algorithm: str
    name: str
    col: int
    win: int
    hwin: int = 0
    sd: float = 0.0
    loss_of_data: bool = False
    start_of_data: bool = False
    nwin: int = 0
    pvalue: float = 0.0
    trend: str = "any"
    pstat: float = 0.5


_NAME = r'"((?:[^"]|"")*)"'
_NUM = r"\s*([0-9.]+)\s*"
_FORMS = {
    "roc": re.compile(rf"roc\(\s*{_NAME}\s*,{_NUM},{_NUM},{_NUM},{_NUM},\s*(true|false)\s*,\s*(true|false)\s*\)"),
    "mww_nonparametric": re.compile(rf"mww_nonparametric\(\s*{_NAME}\s*,{_NUM},{_NUM},{_NUM},{_NUM}\)"),
    "mww": re.compile(rf"mww\(\s*{_NAME}\s*,{_NUM},{_NUM},{_NUM},{_NUM},\s*(decreasing|increasing|any)\s*\)"),
}


def parse_config(text: str) -> list[Test]:
    """Tests written one after another; "" inside a name is a quote."""
    out, rest = [], text.strip()
    while rest:
        for algorithm, form in _FORMS.items():
            if m := form.match(rest):
                name, col, win, *more = m.groups()
                name = name.replace('""', '"')
                if algorithm == "roc":
                    out.append(Test(algorithm, name, int(col), int(win), hwin=int(more[0]), sd=float(more[1]), loss_of_data=more[2] == "true", start_of_data=more[3] == "true"))
                elif algorithm == "mww":
                    out.append(Test(algorithm, name, int(col), int(win), nwin=int(more[0]), pvalue=float(more[1]), trend=more[2]))
                else:
                    out.append(Test(algorithm, name, int(col), int(win), nwin=int(more[0]), pstat=float(more[1])))
                rest = rest[m.end() :].lstrip()
                break
        else:
            raise ValueError(f"no anomaly test: {rest}")
    return out


def _check(test: Test, rows: int) -> None:
    bad = 3 * test.win >= rows or 0 < test.hwin < test.win if test.algorithm == "roc" else test.win * test.nwin >= rows
    if bad:
        raise ValueError(f"{test.name} - algorithm: {test.algorithm} col: {test.col} msg: arguments out of range")


def with_gaps(series: DataFrame, *, seconds: int, reach: int, keys: Sequence[str] = (), value: str = "value", now: int | None = None) -> DataFrame:
    """series and, after each bucket that is followed by none, up to `reach` empty ones (value null), up to now (s) after the last."""
    order = Window.partitionBy(*keys).orderBy("bucket_start")
    end = F.lit(now) if now is not None else F.col("bucket_start")
    until = F.least(F.coalesce(F.lead("bucket_start").over(order) - seconds, end), F.col("bucket_start") + reach * seconds).cast("bigint")
    gaps = series.select(*keys, "bucket_start", until.alias("_to")).where(F.col("_to") >= F.col("bucket_start") + seconds)
    empty = gaps.select(*keys, F.explode(F.sequence(F.col("bucket_start") + seconds, "_to", F.lit(seconds).cast("bigint"))).alias("bucket_start"), F.lit(None).cast("double").alias(value))
    return series.select(*keys, F.col("bucket_start").cast("bigint").alias("bucket_start"), value).unionByName(empty)


def roc(series: DataFrame, test: Test, *, seconds: int, rows: int, keys: Sequence[str] = (), value: str = "value", now: int | None = None) -> DataFrame:
    """keys, bucket_start, current_avg, previous_avg, history_sd, msg: at each bucket, what the test says when it begins.

    The bucket itself is incomplete and takes no part.  Buckets without a row
    are judged too, for as long as the windows before them reach data: between
    rows, and after a series' last row up to now (s), so that a loss of data
    shows while it lasts.
    """
    _check(test, rows)
    series = with_gaps(series, seconds=seconds, reach=2 * test.win, keys=keys, value=value, now=now)
    order = Window.partitionBy(*keys).orderBy("bucket_start")
    step, win = seconds, test.win
    current = order.rangeBetween(-win * step, -step)
    previous = order.rangeBetween(-2 * win * step, -(win + 1) * step)
    reach = test.hwin + 2 * win if test.hwin else rows - 1
    history = order.rangeBetween(-reach * step, -(2 * win + 1) * step)
    v = F.when(~F.isnan(value), F.col(value))
    seen = series.withColumns({"current_avg": F.avg(v).over(current), "previous_avg": F.avg(v).over(previous), "history_sd": F.stddev_pop(v).over(history), "_n": F.count(v).over(current), "_m": F.count(v).over(previous)})
    name = lambda msg: F.lit(f"{test.name} - algorithm: roc col: {test.col} msg: {msg}")
    none = F.lit(None).cast("string")
    msg = F.when((F.col("_m") > 0) & (F.col("_n") == 0), name("no new data")) if test.loss_of_data else F.when(F.lit(False), none)
    if test.start_of_data:
        msg = msg.when((F.col("_m") == 0) & (F.col("_n") > 0), name("unexpected data"))
    msg = msg.when(F.abs(F.col("current_avg") - F.col("previous_avg")) > F.col("history_sd") * test.sd, name(f"detected anomaly, standard deviation exceeds {test.sd:g}"))
    return seen.select(*keys, "bucket_start", "current_avg", "previous_avg", "history_sd", msg.alias("msg"))


def mann_whitney(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    """U of x, and the one-sided p of its normal approximation with ties and continuity corrected; None if nothing differs."""
    x, y = x[~np.isnan(x)], y[~np.isnan(y)]
    n, m = len(x), len(y)
    if not n or not m:
        return None
    both = np.concatenate([x, y])
    values, which, counts = np.unique(both, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[which]
    u = ranks[:n].sum() - n * (n + 1) / 2
    ties = (counts.astype(float) ** 3 - counts).sum() / ((n + m) * (n + m - 1))
    spread = math.sqrt(n * m / 12 * (n + m + 1 - ties))
    if spread == 0:
        return None
    z = (abs(u - n * m / 2) - 0.5) / spread
    return u, 0.5 * math.erfc(z / math.sqrt(2))


def _mann_whitney_message(values: np.ndarray, test: Test) -> str | None:
    """values: the buffer's rows, oldest first, the last one the incomplete current interval."""
    end = len(values) - 1
    newest = values[end - test.win : end]
    avg = lambda a: np.nanmean(a) if (~np.isnan(a)).any() else math.nan
    hits, total = 0, 0.0
    for k in range(2, test.nwin):
        before = values[end - k * test.win : end - (k - 1) * test.win]
        found = mann_whitney(newest, before)
        if test.algorithm == "mww_nonparametric":
            total += found[0] / test.win**2 - 0.5 if found else 0.0
            continue
        lower = avg(before) - avg(newest)
        right = test.trend == "any" or (lower > 0 if test.trend == "decreasing" else lower < 0)
        hits += bool(right and found and found[1] < test.pvalue)
    if test.algorithm == "mww_nonparametric":
        pstat = total / (test.nwin - 1) + 0.5
        if (test.pstat < 0.5 and pstat < test.pstat) or (test.pstat > 0.5 and pstat > test.pstat):
            return f"detected anomaly, pstat: {pstat:g}"
        return None
    if hits > test.nwin / 4:
        return "detected anomaly" + ("" if test.trend == "any" else f", {test.trend} values")
    return None


def mann_whitney_alerts(series: DataFrame, test: Test, *, seconds: int, rows: int, now: int, keys: Sequence[str], value: str = "value") -> DataFrame:
    """keys, msg of the series whose newest window differs from those before, at `now` (s).

    Only the buffer's `rows` buckets of a series meet in a task.
    """
    _check(test, rows)
    first = now - (rows - 1) * seconds

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        values = np.full(rows, np.nan)
        at = ((frame["bucket_start"] - first) // seconds).to_numpy()
        values[at] = frame["value"]
        msg = _mann_whitney_message(values, test)
        row = [*key, f"{test.name} - algorithm: {test.algorithm} col: {test.col} msg: {msg}"]
        return pd.DataFrame([row] if msg else [], columns=[*keys, "msg"])

    kept = series.where(F.col("bucket_start").between(first, now)).select(*keys, "bucket_start", F.col(value).alias("value"))
    types = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys)
    return kept.groupBy(*keys).applyInPandas(run, f"{types}, msg string")


def throttled(alerts: DataFrame, *, seconds: int = 3600, keys: Sequence[str] = ("logger",), time: str = "timestamp") -> DataFrame:
    """Alerts (time in ns) that pass when none may follow another of its keys within `seconds`.

    An alert's chain of passes depends on the passes before it, but a silence of
    `seconds` ends a chain, so that keys are cut there into episodes.  The first
    alert of each passes; only in episodes that last `seconds` or longer are
    the times followed, from pass to pass, one episode in one task.
    """
    limit = seconds * 1_000_000_000
    times = alerts.select(*keys, time).distinct()
    order = Window.partitionBy(*keys).orderBy(time)
    begins = (F.col(time) - F.lag(time).over(order) >= limit).cast("int")
    episodes = times.withColumn("_begins", begins).withColumn("_episode", F.sum(F.coalesce("_begins", F.lit(0))).over(order)).drop("_begins")

    def follow(frame: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(frame[time].to_numpy())
        passed, k = [], 0
        while k < len(at):
            passed.append(at[k])
            k = int(np.searchsorted(at, at[k] + limit))
        return frame[frame[time].isin(passed)][[*keys, time]]

    types = ", ".join(f"`{k}` {alerts.schema[k].dataType.simpleString()}" for k in [*keys, time])
    own = Window.partitionBy(*keys, "_episode")
    whole = episodes.withColumns({"_first": F.min(time).over(own), "_last": F.max(time).over(own)})
    long = F.col("_last") - F.col("_first") >= limit
    passed = whole.where(~long & (F.col(time) == F.col("_first"))).select(*keys, time)
    passed = passed.unionByName(whole.where(long).groupBy(*keys, "_episode").applyInPandas(follow, types))
    return alerts.join(passed, [*keys, time], "left_semi")


def annotations(alerts: DataFrame, *, now: int, keep_seconds: int, keys: Sequence[str] = ("series",)) -> DataFrame:
    """keys, annotations: JSON of the alerts not older than keep_seconds at now (s); alerts have bucket_start, col and text."""
    kept = alerts.where(F.col("bucket_start") >= now - keep_seconds)
    note = F.struct((F.col("bucket_start") * 1000).alias("x"), F.col("col").cast("int").alias("col"), F.lit("A").alias("shortText"), F.col("text").alias("text"))
    return kept.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(note))).alias("annotations"))
