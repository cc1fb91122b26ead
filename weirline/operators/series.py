"""Bucketed time series: tumbling windows over event time, in long form.

A series is rows of (series keys, bucket_start, col, value); a bucket without a
value has no row.  The dense text form is made only when it is shown.
Aggregations combine on the map side first, so a hot host or type costs one
row a task.  The functions read messages, batch or streaming, except those that
look at the previous row, which need batch windows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import message as M

#: How a series' columns merge.
MERGE = {"sum": F.sum, "min": F.min, "max": F.max}
NAME_CHARS, UNIT_CHARS = 15, 7


def _long(wide: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns to rows, less nulls."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return wide.withColumn("_cell", F.explode(cells)).select(*keys, "_cell.col", "_cell.value").where(F.col("value").isNotNull())


def status_classes(df: DataFrame, *, status: Column, seconds: int = 60, keys: Sequence[str] = ()) -> DataFrame:
    """keys, bucket_start, col, value: how many messages of each hundred of the status; others are unknown, non-numbers left out."""
    hundred = F.floor(status / 100)
    name = F.when((status >= 100) & (status < 600), F.concat(F.lit("HTTP_"), (hundred * 100).cast("string"))).otherwise(F.lit("HTTP_UNKNOWN"))
    rows = df.where(status.isNotNull() & ~F.isnan(status.cast("double"))).select(*keys, M.bucket(seconds).alias("bucket_start"), name.alias("col"))
    return rows.groupBy(*keys, "bucket_start", "col").agg(F.count(F.lit(1)).cast("double").alias("value"))


def aggregate(df: DataFrame, columns: Mapping[str, Column], *, seconds: int, how: str = "sum", keys: Sequence[str] = (), time: Column | str = "timestamp") -> DataFrame:
    """keys, bucket_start, col, value: each column's sum, min or max by bucket."""
    rows = df.select(*keys, M.bucket(seconds, time).alias("bucket_start"), *[c.alias(n) for n, c in columns.items()])
    made = rows.groupBy(*keys, "bucket_start").agg(*[MERGE[how](F.col(f"`{n}`")).alias(n) for n in columns])
    return _long(made, [*keys, "bucket_start"], list(columns))


def last_values(df: DataFrame, columns: Mapping[str, Column], *, seconds: int, keys: Sequence[str] = (), order: Sequence[Column] | None = None) -> DataFrame:
    """keys, bucket_start, col, value: the last value by bucket; order decides (the timestamp by default)."""
    rank = F.struct(*(order or [F.col("timestamp")]))
    rows = df.select(*keys, M.bucket(seconds).alias("bucket_start"), rank.alias("_at"), *[c.alias(n) for n, c in columns.items()])
    made = rows.groupBy(*keys, "bucket_start").agg(*[F.max_by(F.col(f"`{n}`"), F.when(F.col(f"`{n}`").isNotNull(), F.col("_at"))).alias(n) for n in columns])
    return _long(made, [*keys, "bucket_start"], list(columns))


def averages(df: DataFrame, columns: Mapping[str, Column], *, seconds: int, keys: Sequence[str] = (), whole: Sequence[str] = ()) -> DataFrame:
    """keys, bucket_start, n and each column's mean by bucket; the means of columns in `whole` are floored."""
    rows = df.select(*keys, M.bucket(seconds).alias("bucket_start"), *[c.alias(n) for n, c in columns.items()])
    mean = lambda n: F.floor(F.avg(f"`{n}`")) if n in whole else F.avg(f"`{n}`")
    return rows.groupBy(*keys, "bucket_start").agg(F.count(F.lit(1)).alias("n"), *[mean(n).alias(n) for n in columns])


def retained(series: DataFrame, rows: int, seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """The newest `rows` buckets of each series: what a buffer of that length still holds."""
    newest = series.groupBy(*keys).agg(F.max("bucket_start").alias("_newest"))
    joined = series.join(newest, list(keys)) if keys else series.crossJoin(F.broadcast(newest))  # one row
    return joined.where(F.col("bucket_start") > F.col("_newest") - rows * seconds).drop("_newest")


def counter(df: DataFrame, *, seconds: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """keys, bucket_start, n, total, rate and payload: what a counter says at each tick with new messages."""
    ticks = df.select(*keys, M.bucket(seconds).alias("bucket_start")).groupBy(*keys, "bucket_start").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy(*keys).orderBy("bucket_start")  # a row a tick
    told = ticks.withColumns({"total": F.sum("n").over(running), "rate": F.col("n") / F.lit(float(seconds))})
    return told.withColumn("payload", F.format_string("Got %d messages. %.2f msg/sec", "total", "rate"))


def counter_summary(ticks: DataFrame, *, samples: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """keys, block, min, max, mean and payload of every `samples` ticks."""
    order = Window.partitionBy(*keys).orderBy("bucket_start")
    blocks = ticks.withColumn("block", F.floor((F.row_number().over(order) - 1) / samples))
    made = blocks.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_n"), F.min("rate").alias("min"), F.max("rate").alias("max"), F.avg("rate").alias("mean")).where(F.col("_n") == samples).drop("_n")
    return made.withColumn("payload", F.format_string("AGG Sum. Min: %.2f    Max: %.2f    Mean: %.2f", "min", "max", "mean"))


def deltas(df: DataFrame, columns: Mapping[str, Column], *, keys: Sequence[str], order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """df with each column less its value in the message before, of the same keys; the first has null."""
    before = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({n: c - F.lag(c).over(before) for n, c in columns.items()})


def cpu_percent(ticks: Column, idle: Column) -> Column:
    """The busy share of a step in whole percent, from the deltas of all ticks and of idle ones."""
    return F.ceil((F.lit(1.0) - idle / ticks) * 100 - 0.5)


def merge(series: DataFrame, methods: Mapping[str, str], *, keys: Sequence[str] = ("bucket_start",), order: str | None = None) -> DataFrame:
    """Deltas of many hosts as one series.  sum adds; min and max are set, so the last in order holds
    (without an order: the least or the greatest); none and NaN are left out."""
    real = series.where(~F.isnan("value"))
    out = None
    for how in ("sum", "min", "max"):
        names = [c for c, m in methods.items() if m == how]
        if not names:
            continue
        rows = real.where(F.col("col").isin(names)).groupBy(*keys, "col")
        made = rows.agg((F.max_by("value", order) if order and how != "sum" else MERGE[how]("value")).alias("value"))
        out = made if out is None else out.unionByName(made)
    return out if out is not None else real.select(*keys, "col", "value").limit(0)


def host_columns(series: DataFrame, *, host: str = "hostname", how: str = "sum", expiration: int | None = None) -> DataFrame:
    """bucket_start, host and value: the cells of a table with a column a host, in long form for any number of them.

    With an expiration (s), hosts that fell silent that long before the newest
    bucket of all have no column any more.
    """
    cells = series.where(~F.isnan("value")).groupBy("bucket_start", host).agg(MERGE[how]("value").alias("value"))
    if expiration is None:
        return cells
    newest = F.broadcast(cells.agg(F.max("bucket_start").alias("_newest")))  # one row
    seen = cells.groupBy(host).agg(F.max("bucket_start").alias("_seen")).crossJoin(newest)
    return cells.join(seen.where(F.col("_seen") >= F.col("_newest") - expiration).select(host), host).select("bucket_start", host, "value")


def by_host(series: DataFrame, hosts: Sequence[str] | None = None, *, host: str = "hostname", how: str = "sum", max_hosts: int = 100, expiration: int | None = None) -> DataFrame:
    """bucket_start and a column a host; without a list, of the hosts found, at most max_hosts (ValueError if more)."""
    cells = host_columns(series, host=host, how=how, expiration=expiration)
    if hosts is None:
        hosts = sorted(r[0] for r in cells.select(host).distinct().limit(max_hosts + 1).collect())
        if len(hosts) > max_hosts:
            raise ValueError(f"more than {max_hosts} hosts")
    return cells.groupBy("bucket_start").pivot(host, list(hosts)).agg(F.max("value"))


def render(series: DataFrame, columns: Mapping[str, tuple[str, str]], *, rows: int, seconds: int, keys: Sequence[str] = ()) -> DataFrame:
    """keys and payload: the dense text of each series, a JSON header and a tab-separated line a bucket, oldest first.

    columns: name to (unit, aggregation).  The window ends with the newest
    bucket, and never begins before 0; empty cells are nan.
    """
    import json

    info = [{"name": n[:NAME_CHARS], "unit": _unit(u), "aggregation": a} for n, (u, a) in columns.items()]
    cells = series.groupBy(*keys, "bucket_start").agg(*[F.max(F.when(F.col("col") == n, F.col("value"))).alias(f"_{k}") for k, n in enumerate(columns)])
    shown = lambda k: F.coalesce(M.shortest(F.col(f"_{k}")), F.lit("nan"))
    lines = cells.select(*keys, "bucket_start", F.concat_ws("\t", *[shown(k) for k in range(len(columns))]).alias("_line"))
    gathered = lines.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket_start", "_line"))).alias("_lines"), F.max("bucket_start").alias("_last"))
    first = F.greatest(F.col("_last") - (rows - 1) * seconds, F.lit(0))
    empty = "\t".join(["nan"] * len(columns))
    head = F.concat(F.lit('{"time":'), first.cast("string"), F.lit(f',"rows":{rows},"columns":{len(columns)},"seconds_per_row":{seconds},"column_info":{json.dumps(info, separators=(",", ":"))}}}\n'))
    body = F.transform(F.sequence(first, first + (rows - 1) * seconds, F.lit(seconds).cast("bigint")), lambda t: F.coalesce(F.try_element_at("_lines", t), F.lit(empty)))
    return gathered.select(*keys, F.concat(head, F.array_join(body, "\n"), F.lit("\n")).alias("payload"))


def _unit(unit: str) -> str:
    return "".join(c if c.isalnum() or c in "/*" else "_" for c in unit)[:UNIT_CHARS]


def parse(df: DataFrame, payload: str = "payload", keys: Sequence[str] = ()) -> DataFrame:
    """keys, bucket_start, col, value: the dense text back in long form."""
    lines = F.split(F.col(payload), "\n")
    head = F.from_json(F.get(lines, F.lit(0)), "time bigint, rows int, columns int, seconds_per_row int, column_info array<struct<name:string,unit:string,aggregation:string>>")
    rows = df.select(*keys, head.alias("_head"), F.posexplode(F.slice(lines, F.lit(2), F.size(lines))).alias("_row", "_line"))
    cells = rows.where(F.col("_line") != "").select(*keys, (F.col("_head.time") + F.col("_row").cast("long") * F.col("_head.seconds_per_row")).alias("bucket_start"), "_head", F.posexplode(F.split("_line", "\t")).alias("_k", "_text"))
    return cells.where(F.col("_text") != "nan").select(*keys, "bucket_start", F.get(F.col("_head.column_info"), F.col("_k"))["name"].alias("col"), F.col("_text").cast("double").alias("value"))
