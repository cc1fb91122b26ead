"""Nothing is left out after a fixed number of lines or orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.operators import series
from weirline.streaming import manager


def test_parse_reads_all_lines(spark):
    n = 1_000_005
    head = f'{{"time":0,"rows":{n},"columns":1,"seconds_per_row":86400,"column_info":[{{"name":"k","unit":"count","aggregation":"sum"}}]}}\n'
    df = spark.range(1).select(F.concat(F.lit(head), F.repeat(F.lit("1\n"), n)).alias("payload"))
    got = series.parse(df).agg(F.count("value").alias("n"), F.max("bucket_start").alias("last")).first()
    assert (got.n, got.last) == (n, (n - 1) * 86400)


def test_manager_obeys_all_orders(spark):
    class Query:
        stopped = False

        def stop(self):
            self.stopped = True

    now = 1_700_000_000_000_000_000
    m = manager.QueryManager(spark, {}, signer="me", clock=lambda: now)
    m.running["x"] = query = Query()
    df = spark.range(1501).select((F.lit(now) + F.col("id")).alias("t"), F.when(F.col("id") == 1500, "x").otherwise("y").alias("name"), F.lit("me").alias("signer"))
    m.obey(M.messages(df, extra=["signer"], timestamp=F.col("t"), type=F.lit("control"), fields=M.fields(M.field("action", F.lit("unload"), "string"), M.field("name", F.col("name"), "string"))))
    assert query.stopped and not m.running
