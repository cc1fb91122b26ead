"""Frequent and distinct items, heartbeats, and the schema that messages show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import message as M

DAY = 86_400


def frequent_items(df: DataFrame, item: Column, *, days: int = 1, min_weight: int = 100) -> DataFrame:
    """period, item, weight: exact counts over min_weight, afresh every `days` days (0: never)."""
    period = M.bucket(days * DAY) if days else F.lit(0).cast("bigint")
    rows = df.where(item.isNotNull()).select(period.alias("period"), item.alias("item"))
    return rows.groupBy("period", "item").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") > min_weight)


def top_items(df: DataFrame, item: str, *, k: int = 10, max_items: int = 1000, keys: Sequence[str] = ()) -> DataFrame:
    """keys, items: the k most frequent by a sketch of at most max_items counters."""
    return df.groupBy(*keys).agg(F.expr(f"approx_top_k({item}, {k}, {max_items})").alias("items"))


def unique_items(df: DataFrame, item: Column, *, seconds: int = DAY, exact: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """keys, bucket_start, n: distinct items of each period, by a HyperLogLog sketch or exactly."""
    rows = df.where(item.isNotNull()).select(*keys, M.bucket(seconds).alias("bucket_start"), item.alias("_item"))
    if exact:
        return rows.distinct().groupBy(*keys, "bucket_start").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(*keys, "bucket_start").agg(F.hll_sketch_estimate(F.hll_sketch_agg("_item", F.lit(12))).alias("n"))


def heartbeats(df: DataFrame, now: Column, *, timeout: int = 30) -> DataFrame:
    """hostname, last_heartbeat (ms), status: down if silent for over timeout seconds at now (ns)."""
    seen = df.groupBy("hostname").agg(F.expr("max(timestamp div 1000000)").alias("last_heartbeat"))
    late = (now / F.lit(1_000_000)).cast("bigint") - F.col("last_heartbeat") > timeout * 1000
    return seen.withColumn("status", F.when(late, F.lit("down")).otherwise(F.lit("up")))


def message_schema(df: DataFrame) -> DataFrame:
    """logger, type, env_version, field, n, kind, optional: which fields messages of a kind hold.

    kind is mismatch if a field's types differ, with text and bytes apart as
    well; a field is optional if it occurs less often than its messages.
    """
    names = {M.STRING: "string", M.BYTES: "string", M.INTEGER: "number", M.DOUBLE: "number", M.BOOL: "bool"}
    told = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("_low").cast("int"))
    by = ["logger", "type", "env_version"]
    # A message adds a row for itself (no field) and one for each field: a single pass and shuffle for both counts.
    none = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("tinyint").alias("value_type"))
    cells = F.concat(F.array(none), F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["value_type"].alias("value_type"))))
    rows = df.select(*by, F.explode(cells).alias("_f")).groupBy(*by, F.col("_f.name").alias("field")).agg(F.count(F.lit(1)).alias("n"), F.min("_f.value_type").alias("_low"), F.max("_f.value_type").alias("_high"))
    totals = rows.where(F.col("field").isNull()).select(*by, F.col("n").alias("_all"))
    fields = rows.where(F.col("field").isNotNull()).join(totals, by)
    return fields.select(*by, "field", "n", F.when(F.col("_low") != F.col("_high"), F.lit("mismatch")).otherwise(told).alias("kind"), (F.col("n") != F.col("_all")).alias("optional"))


def schema_counts(df: DataFrame) -> DataFrame:
    """logger, type, env_version, n: the counts of every level, null for all."""
    return df.rollup("logger", "type", "env_version").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def users_by_device(df: DataFrame, device: Column, *, seconds: int = 60) -> DataFrame:
    """bucket_start, device, n, and the tick's total beside it."""
    rows = df.select(M.bucket(seconds).alias("bucket_start"), device.alias("device")).groupBy("bucket_start", "device").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("bucket_start").agg(F.sum("n").alias("total"))
    return rows.join(totals, "bucket_start")


def influx_batches(df: DataFrame, line: Column, order: Sequence[str], *, flush_count: int, keys: Sequence[str]) -> DataFrame:
    """keys, batch, payload: lines joined, flush_count messages to a batch."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    rows = df.select(*keys, F.floor(place / flush_count).alias("batch"), place.alias("_p"), line.alias("_line"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("_p", "_line"))), lambda x: x["_line"])
    return rows.groupBy(*keys, "batch").agg(F.array_join(text, "").alias("payload"))
