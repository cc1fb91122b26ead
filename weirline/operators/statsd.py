"""Counters, gauges and timers from stat lines, by tick."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import message as M

LINE = r"^\s*([^:|\s]+):([^|]*)\|(ms|g|h|c|m)(?:\|@([0-9.eE+-]+))?\s*$"
STAT = "struct<bucket:string,value:string,modifier:string,sampling:float>"


def parse(line: Column) -> Column:
    """A stat line as a struct, null if it is no stat line: bucket:value|modifier, and |@rate if sampled."""
    part = lambda k: F.regexp_extract(line, LINE, k)
    rate = F.coalesce(F.nullif(part(4), F.lit("")).try_cast("float"), F.lit(1.0).cast("float"))
    return F.when(line.rlike(LINE) & (part(2) != ""), F.struct(part(1).alias("bucket"), part(2).alias("value"), part(3).alias("modifier"), rate.alias("sampling")))


def stats(df: DataFrame, text: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    """bucket, value, modifier, sampling of each good line of the packets, and the columns to keep."""
    lines = df.select(*keep, F.explode(F.split(F.col(text), "\n")).alias("_line")).where(F.trim("_line") != "")
    return lines.withColumn("_stat", parse(F.col("_line"))).where(F.col("_stat").isNotNull()).select(*keep, "_stat.*")


def from_messages(df: DataFrame, metrics: dict[str, tuple[str, Column, Column]], *, replace_dot: bool = False) -> DataFrame:
    """A stat for each metric of each message: {name: (kind, bucket, value)}; kind is Counter, Gauge or Timer.

    A field that a message lacks leaves its name in the bucket empty and
    reads as no value; values of other messages are never used.
    """
    kinds = {"Counter": "c", "Gauge": "g", "Timer": "ms"}
    clean = lambda c: F.replace(c, F.lit("."), F.lit("_")) if replace_dot else c
    made = F.array(*[F.struct(clean(b).alias("bucket"), v.cast("string").alias("value"), F.lit(kinds[k]).alias("modifier"), F.lit(1.0).cast("float").alias("sampling")) for k, b, v in metrics.values()])
    return df.select("timestamp", F.explode(made).alias("_s")).select("timestamp", "_s.*").where(F.col("value").isNotNull())


def _tick(seconds: int) -> Column:
    return M.bucket(seconds).alias("tick")


def counters(df: DataFrame, *, seconds: int = 10) -> DataFrame:
    """tick, bucket, count, rate.  A sample counts as its whole part after scaling, in single precision;
    an unreadable value counts 0.  Every modifier but ms and g counts."""
    value = F.coalesce(F.expr("try_cast(value as float)"), F.lit(0.0).cast("float"))
    sample = (value * (F.lit(1.0).cast("float") / F.col("sampling"))).cast("float").cast("bigint")
    rows = df.where(~F.col("modifier").isin("ms", "g")).select(_tick(seconds), "bucket", sample.alias("_n"))
    return rows.groupBy("tick", "bucket").agg(F.sum("_n").alias("count")).withColumn("rate", F.col("count") / F.lit(float(seconds)))


def gauges(df: DataFrame, *, seconds: int = 10, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """tick, bucket, value: the last of each tick."""
    rows = df.where(F.col("modifier") == "g").select(_tick(seconds), "bucket", F.struct(*order).alias("_at"), F.coalesce(F.expr("try_cast(value as double)"), F.lit(0.0)).alias("_v"))
    return rows.groupBy("tick", "bucket").agg(F.max_by("_v", "_at").alias("value"))


def carried(gauged: DataFrame, *, seconds: int = 10) -> DataFrame:
    """Gauges at every tick up to the last of all: an idle gauge holds its value."""
    nexts = Window.partitionBy("bucket").orderBy("tick")
    end = F.broadcast(gauged.agg(F.max("tick").alias("_end")))  # one row
    spans = gauged.crossJoin(end).withColumn("_to", F.coalesce(F.lead("tick").over(nexts) - seconds, F.col("_end")))
    return spans.select(F.explode(F.sequence("tick", "_to", F.lit(seconds).cast("bigint"))).alias("tick"), "bucket", "value")


def with_idle(made: DataFrame, *, seconds: int = 10) -> DataFrame:
    """Counters or timers, and a row of zeros for each of a bucket's ticks without a sample, from its first one up to the last of all."""
    nexts = Window.partitionBy("bucket").orderBy("tick")
    end = F.broadcast(made.agg(F.max("tick").alias("_end")))  # one row
    gaps = made.crossJoin(end).withColumn("_to", F.coalesce(F.lead("tick").over(nexts) - seconds, F.col("_end"))).where(F.col("_to") > F.col("tick"))
    zeros = [F.lit(0).cast(f.dataType).alias(f.name) for f in made.schema if f.name not in ("tick", "bucket")]
    ticks = gaps.select(F.explode(F.sequence(F.col("tick") + seconds, F.col("_to"), F.lit(seconds).cast("bigint"))).alias("tick"), "bucket", *zeros)
    return made.unionByName(ticks)


def timers(df: DataFrame, *, seconds: int = 10, thresholds: Sequence[int] = (90,)) -> DataFrame:
    """tick, bucket, count, count_ps, lower, upper, sum, mean, and mean_N and upper_N of each threshold.

    N takes the k smallest values, k = n - floor((100 - N) / 100 * n + 0.5);
    with none, the mean is the least and the upper the greatest value.  Equal
    values are counted before the shuffle, and ranks run over them.
    """
    value = F.coalesce(F.expr("try_cast(value as double)"), F.lit(0.0))
    rows = df.where(F.col("modifier") == "ms").select(_tick(seconds), "bucket", value.alias("_v"))
    own = Window.partitionBy("tick", "bucket")
    ranked = rows.groupBy("tick", "bucket", "_v").agg(F.count(F.lit(1)).alias("_m")).withColumns({"_n": F.sum("_m").over(own), "_to": F.sum("_m").over(own.orderBy("_v"))})
    aggs = [F.sum("_m").alias("count"), F.min("_v").alias("lower"), F.max("_v").alias("upper"), F.sum(F.col("_v") * F.col("_m")).alias("sum")]
    for n in thresholds:
        k = F.col("_n") - F.floor(F.lit((100.0 - n) / 100.0) * F.col("_n") + 0.5)
        taken = F.least(F.greatest(k - (F.col("_to") - F.col("_m")), F.lit(0)), F.col("_m"))
        aggs += [F.sum(F.col("_v") * taken).alias(f"_sum_{n}"), F.max(F.when(taken > 0, F.col("_v"))).alias(f"_upper_{n}"), F.max(k).alias(f"_k_{n}")]
    made = ranked.groupBy("tick", "bucket").agg(*aggs)
    made = made.withColumns({"count_ps": F.col("count") / F.lit(float(seconds)), "mean": F.col("sum") / F.col("count")})
    for n in thresholds:
        some = F.col(f"_k_{n}") > 0
        made = made.withColumns({f"mean_{n}": F.when(some, F.col(f"_sum_{n}") / F.col(f"_k_{n}")).otherwise(F.col("lower")), f"upper_{n}": F.when(some, F.col(f"_upper_{n}")).otherwise(F.col("upper"))})
    return made.select("tick", "bucket", "count", "count_ps", "lower", "upper", "sum", "mean", *[f"{w}_{n}" for n in thresholds for w in ("mean", "upper")])


def numbers_of_stats(df: DataFrame, *, seconds: int = 10) -> DataFrame:
    """tick, num_stats: distinct counters, gauges and timers of each tick."""
    kind = F.when(F.col("modifier").isin("ms", "g"), F.col("modifier")).otherwise(F.lit("c"))
    return df.select(_tick(seconds), kind.alias("_kind"), "bucket").distinct().groupBy("tick").agg(F.count(F.lit(1)).alias("num_stats"))


def metrics(df: DataFrame, *, seconds: int = 10, thresholds: Sequence[int] = (90,), prefix: str = "stats", counter_prefix: str = "counters", timer_prefix: str = "timers", gauge_prefix: str = "gauges", statsd_prefix: str = "statsd", legacy: bool = False, order: Sequence[str] = ("timestamp",), idle: bool = False) -> DataFrame:
    """tick, name, value, is_whole, field_is_whole: all of a tick's metrics under their full names.

    With idle, statistics without a sample stay: counters and timers as zero,
    gauges with their last value.  The old names have whole rates in fields.
    """
    dotted = lambda *parts: F.concat_ws(".", *[p if isinstance(p, Column) else F.lit(p) for p in parts if not isinstance(p, str) or p])
    cell = lambda name, v, whole=False, field=False: F.struct(name.alias("name"), v.cast("double").alias("value"), F.lit(whole).alias("is_whole"), F.lit(whole or field).alias("field_is_whole"))
    held = (lambda made: with_idle(made, seconds=seconds)) if idle else (lambda made: made)
    b = F.col("bucket")
    counted = held(counters(df, seconds=seconds))
    if legacy:
        cells = F.array(cell(dotted(prefix, b), F.col("rate"), field=True), cell(dotted("stats_counts", b), F.col("count"), True))
    else:
        cells = F.array(cell(dotted(prefix, counter_prefix, b, "rate"), F.col("rate")), cell(dotted(prefix, counter_prefix, b, "count"), F.col("count"), True))
    out = counted.select("tick", F.explode(cells).alias("_c"))
    gauged = gauges(df, seconds=seconds, order=order)
    gauged = carried(gauged, seconds=seconds) if idle else gauged
    out = out.union(gauged.select("tick", cell(dotted(prefix, gauge_prefix, b), F.col("value"))))
    timed = held(timers(df, seconds=seconds, thresholds=thresholds))
    cells = F.array(*[cell(dotted(prefix, timer_prefix, b, c), F.col(c), c == "count") for c in timed.columns[2:]])
    out = out.union(timed.select("tick", F.explode(cells)))
    numbers = counted.select("tick").unionAll(gauged.select("tick")).unionAll(timed.select("tick")).groupBy("tick").agg(F.count(F.lit(1)).alias("num_stats")) if idle else numbers_of_stats(df, seconds=seconds)
    out = out.union(numbers.select("tick", cell(F.lit(f"{statsd_prefix}.numStats" if legacy else f"{prefix}.{statsd_prefix}.numStats"), F.col("num_stats"), True)))
    return out.select("tick", "_c.*")


def in_fields(named: DataFrame, *, type_: str = "statmetric") -> DataFrame:
    """A message a tick: the field timestamp (s), then a field for each metric in order of name."""
    whole, value = F.col("field_is_whole"), F.col("value")
    one = F.when(whole, M.field(F.col("name"), value.cast("bigint"), "integer")).otherwise(M.field(F.col("name"), value, "double"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("name", one.alias("_f")))), lambda x: x["_f"])
    rows = named.groupBy("tick").agg(ordered.alias("_f"))
    return M.messages(rows, type=F.lit(type_), timestamp=F.col("tick") * 1_000_000_000, fields=F.concat(F.array(M.field("timestamp", F.col("tick"), "integer")), F.col("_f")))


def payload(named: DataFrame) -> DataFrame:
    """tick, payload: the metrics of each tick as lines of name, value and time, in order of name."""
    shown = F.when(F.col("is_whole"), F.col("value").cast("bigint").cast("string")).otherwise(F.format_string("%f", "value"))
    lines = named.select("tick", F.struct("name", F.concat_ws(" ", "name", shown, "tick").alias("line")).alias("_l"))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda l: l["line"]), "\n"), F.lit("\n"))
    return lines.groupBy("tick").agg(text.alias("payload"))
