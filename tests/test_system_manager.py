"""System series against known values; the query manager and reports."""

from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.operators import decoders, system
from weirline.streaming import manager


def grid(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.bucket_start, {})[r.col] = r.value
    return out


def stats(spark, rows, names):
    """Messages at the given seconds with double fields."""
    df = spark.createDataFrame([(float(t), *map(float, v)) for t, v in rows], "t double, " + ", ".join(f"`{n}` double" for n in names))
    return M.messages(df, timestamp=(F.col("t") * 1e9).cast("bigint"), hostname=F.lit("h"), fields=M.fields(*[M.field(n, F.col(f"`{n}`"), "double") for n in names]))


def test_load_and_memory(spark):
    load = stats(spark, [(t, (0.08, 0.04, 0.02, 5)) for t in (1, 2, 3)], system.LOAD)
    assert grid(system.load_average(load, seconds=1)) == {t: dict(zip(system.LOAD, (0.08, 0.04, 0.02, 5.0), strict=True)) for t in (1, 2, 3)}
    names = [*system.MEMORY, "SwapTotal"]
    got = grid(system.memory(stats(spark, [(1, [100] * len(names))], names), seconds=1))[1]
    assert got == {n: 100.0 for n in system.MEMORY} | {"SwapUsed": 0.0}


def test_disks(spark):
    rows = [(1, [100] * 11), (2, [200] * 11), (3, [400] * 11), (4, [700] * 11)]
    got = grid(system.disks(stats(spark, rows, decoders.DISK_COLUMNS), seconds=1))
    assert sorted(got) == [2, 3, 4]
    for t, delta, total in ((2, 100, 200), (3, 200, 400), (4, 300, 700)):
        assert got[t] == {n: float(delta) for n in system.DISK_TOTALS} | {n: float(total) for n in system.DISK_TIMES}


def test_processors(spark):
    df = spark.createDataFrame([(1, [10.0, 0.0, 10.0, 80.0], 5.0), (2, [20.0, 0.0, 30.0, 150.0], 9.0)], "t bigint, cpu array<double>, ctxt double")
    rows = M.messages(df, timestamp=F.col("t") * 1_000_000_000, hostname=F.lit("h"), fields=F.array(M.field("cpu", F.col("cpu"), "double", is_array=True), M.field("ctxt", F.col("ctxt"), "double")))
    assert grid(system.processors(rows, seconds=1, extras=["ctxt"])) == {2: {"cpu": 30.0, "ctxt": 4.0}}


def test_slow_queries_and_failures(spark):
    names = ["Query_time", "Lock_time", "Rows_sent", "Rows_examined"]
    row = system.slow_queries(stats(spark, [(1, (2, 1, 5, 7)), (1, (4, 0, 6, 8))], names), seconds=10).first()
    assert (row.n, row.query_time, row.lock_time, row.response_time, row.rows_sent, row.rows_examined) == (2, 3.0, 0.5, 3.5, 5, 7)
    reports = M.messages(spark.createDataFrame([(60 * k, f'{{"a":{{"ProcessMessageFailures":{k % 2 if k < 30 else 500}}}}}') for k in range(32)], "t bigint, p string"), timestamp=F.col("t") * 1_000_000_000, payload=F.col("p"))
    strange = system.failing_plugins(reports, 'roc("f", 1, 1, 0, 3, false, false)', rows=1440).where("bucket_start > 600").collect()
    assert [(r.plugin, r.bucket_start) for r in strange] == [("a", 31 * 60)]


class Query:
    stopped = False

    def stop(self):
        self.stopped = True


def test_manager(spark):
    now, made = 10**18, []
    m = manager.QueryManager(spark, {"x": lambda s: made.append(Query()) or made[-1]}, signer="me", clock=lambda: now)
    rows = [(now, "load", "x", "me"), (now + 1, "load", "y", "me"), (now + 2, "unload", "x", "you"), (now + 6 * 10**9, "unload", "x", "me")]
    df = spark.createDataFrame(rows, "t bigint, action string, name string, signer string")
    orders = M.messages(df, extra=["signer"], timestamp=F.col("t"), type=F.lit("control"), fields=M.fields(M.field("action", F.col("action"), "string"), M.field("name", F.col("name"), "string")))
    m.obey(orders)
    assert list(m.running) == ["x"] and not made[0].stopped
    m.unload("x")
    assert made[0].stopped and not m.running


def test_report(spark):
    report = manager.Report()
    spark.streams.addListener(report)
    try:
        q = spark.readStream.format("rate").option("rowsPerSecond", 10).load().writeStream.format("noop").queryName("rated").start()
        import time

        for _ in range(100):
            if "rated" in report.latest:
                break
            time.sleep(0.1)
        q.stop()
        assert report.messages(spark).first().logger == "rated"
    finally:
        spark.streams.removeListener(report)
