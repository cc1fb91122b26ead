"""Streaming queries that start and stop by signed control messages, and reports on those that run.

A control message has type control, fields action (load or unload) and name,
and a timestamp within five seconds of the clock; its frame's verified signer
must be the manager's.  What it may load is what the manager was given by
name: no code travels in messages.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import message as M

MAX_SKEW_NS = 5_000_000_000


class QueryManager:
    def __init__(self, spark: SparkSession, loadable: dict[str, Callable[[SparkSession], StreamingQuery]], *, signer: str, max_queries: int = 10, clock: Callable[[], int] = time.time_ns) -> None:
        self.spark, self.loadable, self.signer, self.most, self.clock = spark, loadable, signer, max_queries, clock
        self.running: dict[str, StreamingQuery] = {}

    def load(self, name: str) -> None:
        if name in self.running:
            self.unload(name)
        if len(self.running) >= self.most:
            raise RuntimeError(f"{self.most} queries are running already")
        self.running[name] = self.loadable[name](self.spark)

    def unload(self, name: str) -> None:
        if query := self.running.pop(name, None):
            query.stop()

    def obey(self, messages: DataFrame, epoch: int = 0) -> None:
        """Acts on the control messages of a batch, in order; for foreachBatch."""
        now = self.clock()
        fresh = (F.col("type") == "control") & (F.col("signer") == self.signer) & (F.abs(F.col("timestamp") - F.lit(now)) < MAX_SKEW_NS)
        orders = messages.where(fresh).select("timestamp", M.text("action").alias("action"), M.text("name").alias("name")).orderBy("timestamp")
        for order in orders.toLocalIterator():  # all, and a part of them here at a time
            if order.action == "load" and order.name in self.loadable:
                self.load(order.name)
            elif order.action == "unload":
                self.unload(order.name)


class Report(StreamingQueryListener):
    """Rows in, rates and durations of each query's latest batch, as messages for who wants them."""

    def __init__(self) -> None:
        self.latest: dict[str, dict] = {}
        self.failures: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.latest[p.name or str(p.id)] = {"rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "batch": p.batchId, "duration_ms": p.durationMs.get("triggerExecution", 0)}

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures[str(event.id)] = event.exception

    def messages(self, spark: SparkSession) -> DataFrame:
        rows = [(n, int(r["rows"]), float(r["rows_per_second"] or 0), int(r["batch"]), int(r["duration_ms"])) for n, r in self.latest.items()]
        df = spark.createDataFrame(rows, "name string, rows bigint, rate double, batch bigint, ms bigint")
        bag = M.fields(M.field("ProcessMessageCount", F.col("rows"), "integer", "count"), M.field("RowsPerSecond", F.col("rate"), "double"), M.field("Batch", F.col("batch"), "integer"), M.field("ProcessMessageAvgDuration", F.col("ms") * 1_000_000, "integer", "ns"))
        return M.messages(df, type=F.lit("report"), logger=F.col("name"), timestamp=F.lit(time.time_ns()), fields=bag)
