"""Stat lines, statistics of messages, sketches within their bounds, and fields set anew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.operators import items, statsd
from weirline.plans import tables
from weirline.streaming import stateful

SF = "/root/testdata/sf0.001"


def test_stat_lines(spark):
    """Name, value, kind and rate of good lines; others are left out."""
    packet = "carts:3|c\nload.one:0.25|g\n\nwait:12.5|ms|@0.5\nempty:|c\nno value\nodd:1|q\nrate:2|c|@x\nlast:7|h"
    rows = statsd.stats(spark.createDataFrame([(1, packet)], "id int, payload string"), keep=["id"]).collect()
    got = {(r.bucket, r.value, r.modifier, r.sampling) for r in rows}
    assert {("carts", "3", "c", 1.0), ("load.one", "0.25", "g", 1.0), ("wait", "12.5", "ms", 0.5), ("last", "7", "h", 1.0)} <= got
    assert {b for b, *_ in got} <= {"carts", "load.one", "wait", "last", "rate"} and {r.id for r in rows} == {1}


def test_statistics_of_messages(spark):
    """A statistic for each metric of each message; a message without the value has none."""
    bag = M.fields(M.field("ms", F.when(F.col("id") < 2, F.col("id") * 10), "integer"))
    df = M.messages(spark.range(3).coalesce(1), timestamp=F.col("id"), hostname=F.concat(F.lit("web."), F.col("id").cast("string")), fields=bag)
    metrics = {"seen": ("Counter", F.col("hostname"), F.lit("1")), "slow": ("Timer", F.lit("ms"), M.value("ms", "integer"))}
    got = sorted((r.timestamp, r.bucket, r.value, r.modifier) for r in statsd.from_messages(df, metrics, replace_dot=True).collect())
    assert got == [(0, "ms", "0", "ms"), (0, "web_0", "1", "c"), (1, "ms", "10", "ms"), (1, "web_1", "1", "c"), (2, "web_2", "1", "c")]


def test_statistics_in_fields(spark):
    """The time first, then whole counts and real rates in order of name; idle ones as zero and gauges as they were."""
    rows = [(0, "a", "4", "c"), (25, "a", "1", "c"), (3, "g", "1.5", "g"), (21, "t", "7", "ms")]
    df = spark.createDataFrame([(t * 10**9, b, v, m) for t, b, v, m in rows], "timestamp bigint, bucket string, value string, modifier string").withColumn("sampling", F.lit(1.0).cast("float"))
    made = statsd.in_fields(statsd.metrics(df, seconds=10, idle=True)).orderBy("timestamp").collect()
    told = [{f.name: (f.value_integer or f.value_double)[0] for f in r.fields} for r in made]
    assert [r.fields[0].name for r in made] == ["timestamp"] * 3 and [t["timestamp"] for t in told] == [0, 10, 20]
    assert [t["stats.counters.a.count"] for t in told] == [4, 0, 1] and [t["stats.counters.a.rate"] for t in told] == [0.4, 0.0, 0.1]
    assert "stats.gauges.g" in told[0] and [t["stats.statsd.numStats"] for t in told[:2]] == [2, 1]
    assert told[2]["stats.timers.t.count"] == 1 and told[2]["stats.timers.t.upper"] == 7.0


def test_fields_set_anew(spark):
    bag = F.array(M.field("n", F.array(F.lit(1), F.lit(2)), "integer", is_array=True), M.field("n", F.lit(9), "integer"), M.field("s", F.lit("x"), "string"))
    df = M.messages(spark.range(1), fields=bag)
    of = lambda column: [(f.name, f.value_integer or f.value_string) for f in df.select(column.alias("f")).first().f]
    new = F.lit(5).cast("bigint")
    assert of(M.with_value("n", "integer", new, element=1)) == [("n", [1, 5]), ("n", [9]), ("s", ["x"])]
    assert of(M.with_value("n", "integer", new, element=2)) == [("n", [1, 2, 5]), ("n", [9]), ("s", ["x"])]
    assert of(M.with_value("n", "integer", new, element=4)) == of(M.with_value("none", "integer", new)) == [("n", [1, 2]), ("n", [9]), ("s", ["x"])]
    assert of(M.with_value("n", "integer", new, index=1)) == [("n", [1, 2]), ("n", [5]), ("s", ["x"])]


def test_sketches_within_their_bounds(spark):
    """Distinct hosts within 5%; the most frequent ones with room for all are exact."""
    df = tables.events(spark, SF)
    sketch = {r.bucket_start: r.n for r in items.unique_items(df, F.col("hostname"), seconds=3600 * 24 * 7).collect()}
    exact = {r.bucket_start: r.n for r in items.unique_items(df, F.col("hostname"), seconds=3600 * 24 * 7, exact=True).collect()}
    assert sketch.keys() == exact.keys() and all(n == pytest.approx(exact[b], rel=0.05) for b, n in sketch.items())
    top = {r.item: r["count"] for r in items.top_items(df, "type", k=5).select(F.inline("items")).collect()}
    assert top == {r.type: r["count"] for r in df.groupBy("type").count().collect()}


def test_counters_of_a_stream_keep_their_bound(spark, tmp_path):
    """With room for 10 of 200 items, no weight is too high, or too low by over a share of 1/11 of the rows."""
    rows = spark.range(20_000).select(F.lit("k").alias("key"), F.col("id").alias("timestamp"), F.expr("concat('i', cast(floor(200 * pow(rand(1), 4)) as string))").alias("item"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, timestamp bigint, item string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.frequent_items(stream, "item", keys=["key"], max_items=10, reset_days=0).writeStream.format("memory").queryName("bounded").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    exact = {r.item: r["count"] for r in spark.read.parquet(str(tmp_path / "in")).groupBy("item").count().collect()}
    last = spark.table("bounded").groupBy("item").agg(F.max("weight").alias("w")).collect()
    assert last and all(r.w <= exact[r.item] for r in last)
    heavy = {i for i, n in exact.items() if n > 20_000 / 11}
    assert heavy <= {r.item for r in last}
