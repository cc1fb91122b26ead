"""Series of system statistics: load, memory, disks, processors, heaps, slow queries, and failures of plugins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import message as M
from . import anomaly, series
from .decoders import DISK_COLUMNS

LOAD = ["1MinAvg", "5MinAvg", "15MinAvg", "NumProcesses"]
MEMORY = ["MemFree", "Cached", "Active", "Inactive", "VmallocUsed", "Shmem", "SwapCached", "SwapFree"]
HEAP = ["HeapSys", "HeapAlloc", "HeapIdle", "HeapInuse", "HeapReleased", "HeapObjects"]
DISK_TOTALS = {"ReadsCompleted", "ReadsMerged", "SectorsRead", "WritesCompleted", "WritesMerged", "SectorsWritten"}
DISK_TIMES = ["TimeReading", "TimeWriting", "TimeDoingIO", "WeightedTimeDoingIO"]


def load_average(df: DataFrame, *, seconds: int, keys: Sequence[str] = ("hostname",)) -> DataFrame:
    """The last load of each bucket."""
    return series.last_values(df, {n: M.number(n) for n in LOAD}, seconds=seconds, keys=keys)


def memory(df: DataFrame, *, seconds: int, keys: Sequence[str] = ("hostname",), names: Sequence[str] = MEMORY) -> DataFrame:
    """The last memory figures of each bucket, and the swap in use."""
    columns = {n: M.number(n) for n in names} | {"SwapUsed": M.number("SwapTotal") - M.number("SwapFree")}
    return series.last_values(df, columns, seconds=seconds, keys=keys)


def heap(df: DataFrame, *, seconds: int, keys: Sequence[str] = ("hostname",)) -> DataFrame:
    return series.last_values(df, {n: M.number(n) for n in HEAP}, seconds=seconds, keys=keys)


def disks(df: DataFrame, *, seconds: int, keys: Sequence[str] = ("hostname",)) -> DataFrame:
    """Totals as deltas to the message before, times as they are; a disk's first message is only a base."""
    plain = df.withColumns({n: M.number(n) for n in DISK_COLUMNS})
    steps = series.deltas(plain, {n: F.col(n) for n in sorted(DISK_TOTALS)}, keys=keys).where(F.col("ReadsCompleted").isNotNull())
    return series.last_values(steps, {n: F.col(n) for n in [*sorted(DISK_TOTALS), *DISK_TIMES]}, seconds=seconds, keys=keys)


def processors(df: DataFrame, *, seconds: int, keys: Sequence[str] = ("hostname",), names: Sequence[str] = ("cpu",), extras: Sequence[str] = ("ctxt", "processes")) -> DataFrame:
    """Busy percent of each processor since the message before, as whole numbers, and the deltas of single counters."""
    before = Window.partitionBy(*keys).orderBy("timestamp")
    columns: dict[str, Column] = {}
    rows = df
    for n in names:
        rows = rows.withColumn(f"_{n}", M.find(n)["value_double"])
        rows = rows.withColumns({f"_t_{n}": F.aggregate(F.col(f"_{n}"), F.lit(0.0), lambda a, x: a + x), f"_i_{n}": F.get(F.col(f"_{n}"), F.lit(3))})
        rows = rows.withColumns({f"_t_{n}": F.col(f"_t_{n}") - F.lag(f"_t_{n}").over(before), f"_i_{n}": F.col(f"_i_{n}") - F.lag(f"_i_{n}").over(before)})
        columns[n] = F.when(F.col(f"_t_{n}") > 0, series.cpu_percent(F.col(f"_t_{n}"), F.col(f"_i_{n}"))).cast("double")
    for n in extras:
        rows = rows.withColumn(f"_x_{n}", M.number(n) - F.lag(M.number(n)).over(before))
        columns[n] = F.col(f"_x_{n}")
    return series.last_values(rows, columns, seconds=seconds, keys=keys)


def slow_queries(df: DataFrame, *, seconds: int, keys: Sequence[str] = ("hostname",)) -> DataFrame:
    """n and the mean times and row counts of slow queries by bucket; rows are floored."""
    columns = {"query_time": M.number("Query_time"), "lock_time": M.number("Lock_time"), "response_time": M.number("Query_time") + M.number("Lock_time"), "rows_sent": M.number("Rows_sent"), "rows_examined": M.number("Rows_examined")}
    return series.averages(df, columns, seconds=seconds, keys=keys, whole=["rows_sent", "rows_examined"])


def plugin_failures(df: DataFrame, *, seconds: int = 60, path: str = "$") -> DataFrame:
    """plugin, bucket_start, col, value: the last failure count of each plugin in JSON reports {name: {ProcessMessageFailures: n}}."""
    report = F.from_json(F.get_json_object("payload", path), "map<string,struct<ProcessMessageFailures:double>>")
    rows = df.select("timestamp", F.explode(report).alias("plugin", "_r")).where(F.col("_r.ProcessMessageFailures").isNotNull())
    return series.last_values(rows, {"failures": F.col("_r.ProcessMessageFailures")}, seconds=seconds, keys=["plugin"])


def failing_plugins(df: DataFrame, test: str, *, seconds: int = 60, rows: int = 1440) -> DataFrame:
    """The failures of plugins that a rate-of-change test finds strange."""
    made = plugin_failures(df, seconds=seconds).select("plugin", "bucket_start", "value")
    return anomaly.roc(made, anomaly.parse_config(test)[0], seconds=seconds, rows=rows, keys=["plugin"]).where(F.col("msg").isNotNull())
