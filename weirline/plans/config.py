"""A flow from a TOML text: inputs, splitters, decoders, filters and outputs, each with the matcher of what it takes.

    [clicks]                      # the section's name
    kind = "input"                # input, splitter, decoder, filter, encoder or output
    type = "parquet_events"       # a name in the registry (the section's own by default)
    splitter = "lines"            # of an input: a registered splitter, or a section of kind splitter
    decoder = "json"              # of an input: a registered decoder, or a section of kind decoder
    path = "%ENV[DATA]/events.parquet"

    [per_hour]
    kind = "filter"
    type = "stat_graph"
    message_matcher = "Type == 'click'"

%ENV[NAME] is replaced by the environment's value.  Every filter reads the
inputs' messages, and what filters of an earlier level emit, up to max_loops
levels; it never reads its own output.  Spark plans all of it: a section is a
DataFrame, evaluated when an output writes it.  If an input is a stream, so is
the flow: each output is a streaming query with a checkpoint of its own, which
goes on where it ended, and filters are their streaming forms.
"""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import message as M
from ..functions import text as X
from ..operators import anomaly, decoders, encoders, items, matcher, series, splitters, statsd, system
from ..sources import python_sources, readers, sinks
from ..streaming import stateful
from . import registry
from .registry import plugin

MAX_LOOPS = 4
_COMMON = {"kind", "type", "message_matcher", "message_signer", "splitter", "decoder", "encoder", "guarded", "trigger"}


def substituted(text: str, environment: Mapping[str, str] | None = None) -> str:
    env = os.environ if environment is None else environment

    def value(m: re.Match) -> str:
        if m[1] not in env:
            raise KeyError(f"environment has no {m[1]}")
        return env[m[1]]

    return re.sub(r"%ENV\[(\w+)\]", value, text)


def load(text: str, environment: Mapping[str, str] | None = None) -> dict[str, dict]:
    """Sections by name, checked: kinds, types, and a matcher for each filter and output."""
    sections = tomllib.loads(substituted(text, environment))
    for name, s in sections.items():
        if s.get("kind") not in registry.KINDS:
            raise ValueError(f"[{name}]: kind is one of {', '.join(registry.KINDS)}")
        registry.get(s["kind"], s.get("type", name))
        if s["kind"] in ("filter", "output"):
            if "message_matcher" not in s:
                raise ValueError(f"[{name}]: message_matcher is missing")
            matcher.compile(s["message_matcher"])
    return sections


class Flow:
    """The DataFrames of a configuration."""

    def __init__(self, spark: SparkSession, text: str, environment: Mapping[str, str] | None = None) -> None:
        self.spark, self.sections = spark, load(text, environment)
        self.inputs = {n: self._input(n) for n in self._of("input")}
        if not self.inputs:
            raise ValueError("no input")
        self.levels: list[DataFrame] = [self._union(self.inputs.values()).withColumn("loop_count", F.lit(0))]
        self.filters: dict[str, DataFrame] = {}
        self._unroll()

    def _of(self, kind: str) -> list[str]:
        return [n for n, s in self.sections.items() if s["kind"] == kind]

    def _options(self, name: str) -> dict:
        return {k: v for k, v in self.sections[name].items() if k not in _COMMON}

    def _make(self, kind: str, name: str) -> Column:
        """A codec's column, by its section or by its registered name."""
        if name in self.sections and self.sections[name]["kind"] == kind:
            return registry.get(kind, self.sections[name].get("type", name))(**self._options(name))
        return registry.get(kind, name)()

    def _input(self, name: str) -> DataFrame:
        s = self.sections[name]
        rows = registry.get("input", s.get("type", name))(self.spark, **self._options(name))
        rows = rows.select(*M.ENVELOPE, "fields", *(["signer"] if "signer" in rows.columns else []))
        if "signer" not in rows.columns:
            rows = rows.withColumn("signer", F.lit(""))
        if splitter := s.get("splitter"):
            rows = self._split(rows, splitter)
        if decoder := s.get("decoder"):
            rows = decoders.decode(rows, self._make("decoder", decoder), keep=["signer"]).where("decode_error IS NULL").drop("decode_error")
        return rows

    def _split(self, rows: DataFrame, name: str) -> DataFrame:
        """A message for each record of a payload, like the message it was in."""
        own = name in self.sections and self.sections[name]["kind"] == "splitter"
        f = registry.get("splitter", self.sections[name].get("type", name) if own else name)
        made = f(rows, **(self._options(name) if own else {}))
        return made.withColumn("payload", F.col("record")).select(*rows.columns)

    @staticmethod
    def _union(frames) -> DataFrame:
        out = None
        for f in frames:
            out = f if out is None else out.unionByName(f)
        return out

    def _unroll(self) -> None:
        """Filters over level 0, then over what they emitted, until nothing can match or MAX_LOOPS is reached."""
        emitted = [(n, self._run(n, self.levels[0])) for n in self._of("filter")]
        self.filters = dict(emitted)
        for _ in range(MAX_LOOPS - 1):
            messages = [(n, f) for n, f in emitted if set(M.ENVELOPE) <= set(f.columns)]
            if not messages:
                break
            level = self._union([matcher.reinjected(f.withColumn("loop_count", F.lit(len(self.levels) - 1)), self.sections[n]["message_matcher"]).select(*self.levels[0].columns) for n, f in messages])
            self.levels.append(level)
            emitted = [(n, self._run(n, level)) for n, _ in messages]

    def _run(self, name: str, level: DataFrame) -> DataFrame:
        s = self.sections[name]
        chosen = matcher.match(level, s["message_matcher"], signer=s.get("message_signer"))
        kind = s.get("type", name)
        if chosen.isStreaming and kind not in registry.PLUGINS["stream_filter"]:
            raise ValueError(f"[{name}]: {kind} needs whole tables; in a stream there are {', '.join(sorted(registry.PLUGINS['stream_filter']))}")
        made = registry.get("stream_filter" if chosen.isStreaming else "filter", kind)(chosen, **self._options(name))
        if s.get("guarded"):
            made = matcher.injected(made, name)
        if set(M.ENVELOPE) <= set(made.columns):
            made = made.withColumn("signer", F.lit("")) if "signer" not in made.columns else made
        return made

    def messages(self) -> DataFrame:
        return self._union(self.levels)

    def routed(self, output: str) -> DataFrame:
        """The messages that an output takes."""
        s = self.sections[output]
        return matcher.match(self.messages(), s["message_matcher"], signer=s.get("message_signer"))

    def run(self, checkpoint: str | None = None) -> dict[str, StreamingQuery]:
        """Writes every output; in a stream, starts a query for each, by name, with its checkpoint in that folder.

        A section's trigger is Spark's interval ("10 seconds"); a batch that
        fails is repeated, so an output may see it twice.
        """
        started = {}
        for name in self._of("output"):
            s = self.sections[name]
            line = self._make("encoder", s.get("encoder", "payload"))
            write, rows = registry.get("output", s.get("type", name)), self.routed(name)
            if not rows.isStreaming:
                write(rows, line, **self._options(name))
                continue
            if not checkpoint:
                raise ValueError("a streaming flow needs a checkpoint folder")
            to = rows.writeStream.foreachBatch(self._writer(write, line, self._options(name))).queryName(name).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}")
            started[name] = (to.trigger(processingTime=s["trigger"]) if "trigger" in s else to).start()
        return started

    @staticmethod
    def _writer(write, line: Column, options: dict):
        return lambda batch, epoch: write(batch, line, **options)


# What a configuration can name


@plugin("input", "framed")
def _framed(spark: SparkSession, path: str, signers: dict | None = None) -> DataFrame:
    return readers.framed(spark, path, {k: v.encode() for k, v in (signers or {}).items()})


@plugin("input", "log_streams")
def _log_streams(spark: SparkSession, path: str, file_match: str, differentiator: list | None = None, priority: list | None = None, translation: dict | None = None, hostname: str = "") -> DataFrame:
    return readers.log_streams(spark, path, file_match, differentiator=differentiator or ["logfile"], priority=priority or [], translation=translation, hostname=hostname)


@plugin("input", "container_logs")
def _container_logs(spark: SparkSession, path: str, labels: list | None = None) -> DataFrame:
    return readers.container_logs(spark, path, labels=labels or [])


@plugin("input", "http_requests")
def _http_requests(spark: SparkSession, path: str, request_headers: list | None = None) -> DataFrame:
    return readers.http_requests(spark, path, headers=request_headers or [])


@plugin("input", "messages")
def _messages(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of messages."""
    return spark.read.schema(M.schema()).parquet(path)


@plugin("input", "files")
def _files(spark: SparkSession, path: str, message_type: str = "file") -> DataFrame:
    """Whole files, for a splitter."""
    rows = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return M.messages(rows, type=F.lit(message_type), logger=F.col("file"), payload=F.col("value"))


@plugin("input", "kafka")
def _kafka_input(spark: SparkSession, servers: str, topic: str, partition: int | None = None, offsets: str = "earliest", protobuf: bool = True) -> DataFrame:
    return readers.kafka(spark, servers, topic, partition=partition, offsets=offsets, protobuf=protobuf)


@plugin("splitter", "lines")
def _lines(df: DataFrame, delimiter: str = "\n", count: int = 1, deliver_incomplete_final: bool = True, **limits) -> DataFrame:
    return splitters.token(df, "payload", delimiter=delimiter, count=count, deliver_incomplete_final=deliver_incomplete_final, **limits)


plugin("splitter", "token")(_lines)


@plugin("splitter", "regex")
def _regex_splitter(df: DataFrame, delimiter: str, delimiter_eol: bool = True, deliver_incomplete_final: bool = True, **limits) -> DataFrame:
    return splitters.regex(df, "payload", delimiter, delimiter_eol=delimiter_eol, deliver_incomplete_final=deliver_incomplete_final, **limits)


@plugin("splitter", "null")
def _whole(df: DataFrame, **limits) -> DataFrame:
    return splitters.whole(df, "payload", **limits)


for _kind in python_sources.SOURCES:

    @plugin("input", _kind)
    def _stream(spark: SparkSession, kind: str = _kind, message_type: str = "logfile", **options) -> DataFrame:
        python_sources.register(spark)
        return python_sources.as_messages(spark.readStream.format(kind).options(**options).load(), type_=message_type)


for _name, _decoder in {"json": decoders.json, "graylog_extended": decoders.graylog, "nginx_access": decoders.nginx_access, "apache_access": decoders.apache_access, "nginx_error": decoders.nginx_error, "nginx_stub_status": decoders.nginx_stub_status, "rsyslog": decoders.rsyslog, "mysql_slow_query": decoders.slow_query, "bind_query_log": decoders.bind_query, "linux_loadavg": decoders.load_average, "linux_diskstats": decoders.disk_stats, "linux_memstats": decoders.memory_stats, "linux_netstat": decoders.net_stats, "linux_procstat": decoders.proc_stats}.items():
    plugin("decoder", _name)(_decoder)


@plugin("decoder", "mariadb_slow_query")
def _mariadb(**options) -> Column:
    return decoders.slow_query(mariadb=True, **options)


@plugin("decoder", "payload_regex")
def _payload_regex(match_regex: str, message_fields: dict, timestamp_layout: str | None = None, timestamp_location: str | None = None, severity_map: dict | None = None) -> Column:
    return decoders.payload_regex(match_regex, message_fields, layout=timestamp_layout, tz=timestamp_location, severities=severity_map)


@plugin("decoder", "payload_xml")
def _payload_xml(xpath_map: dict, message_fields: dict, timestamp_layout: str | None = None, timestamp_location: str | None = None, severity_map: dict | None = None) -> Column:
    return decoders.payload_xml(xpath_map, message_fields, layout=timestamp_layout, tz=timestamp_location, severities=severity_map)


@plugin("decoder", "scribble")
def _scribble(message_fields: dict) -> Column:
    return decoders.scribble(message_fields)


@plugin("decoder", "first_wins")
def _first_wins(subs: list) -> Column:
    return decoders.first_wins(*[registry.get("decoder", n)() for n in subs])


def _payloads(made: DataFrame, type_: str, name: str) -> DataFrame:
    """Rows of payload, and a time if there is one, as messages of a filter."""
    bag = M.fields(M.field("payload_type", F.lit("txt"), "string", "file-extension"), M.field("payload_name", F.lit(name), "string"))
    time = (F.col("bucket_start") * 1_000_000_000) if "bucket_start" in made.columns else F.lit(0)
    return M.messages(made, type=F.lit(type_), logger=F.lit(name), payload=F.col("payload"), timestamp=time, fields=bag)


@plugin("filter", "counter")
def _counter(df: DataFrame, ticker_interval: int = 5) -> DataFrame:
    return _payloads(series.counter(df, seconds=ticker_interval), "counter-output", "counter")


@plugin("filter", "http_status")
def _http_status(df: DataFrame, sec_per_row: int = 60, rows: int = 1440, status_field: str = "status", title: str = "HTTP Status") -> DataFrame:
    made = series.retained(series.status_classes(df, status=M.number(status_field), seconds=sec_per_row), rows, sec_per_row)
    columns = {**{f"HTTP_{k}00": ("count", "sum") for k in range(1, 6)}, "HTTP_UNKNOWN": ("count", "sum")}
    return _payloads(series.render(made, columns, rows=rows, seconds=sec_per_row), "sandbox-output", title)


@plugin("filter", "stat_graph")
def _stat_graph(df: DataFrame, stats: list, sec_per_row: int = 1, rows: int = 300, stat_aggregation: str = "sum", stat_unit: str = "count", title: str = "Stats") -> DataFrame:
    made = series.retained(series.aggregate(df, {n: M.number(n) for n in stats}, seconds=sec_per_row, how=stat_aggregation), rows, sec_per_row)
    return _payloads(series.render(made, {n: (stat_unit, stat_aggregation) for n in stats}, rows=rows, seconds=sec_per_row), "sandbox-output", title)


@plugin("filter", "stat_accumulator")
def _stat_accumulator(df: DataFrame, ticker_interval: int = 10, percent_threshold: list | None = None) -> DataFrame:
    named = statsd.metrics(statsd.stats(df, keep=["timestamp"]), seconds=ticker_interval, thresholds=percent_threshold or [90])
    return M.messages(statsd.payload(named), type=F.lit("statmetric"), timestamp=F.col("tick") * 1_000_000_000, payload=F.col("payload"))


@plugin("filter", "frequent_items")
def _frequent_items(df: DataFrame, message_variable: str = "Hostname", min_output_weight: int = 100, reset_days: int = 1) -> DataFrame:
    return items.frequent_items(df, X.interpolate("%{" + message_variable + "}"), days=reset_days, min_weight=min_output_weight)


@plugin("filter", "unique_items")
def _unique_items(df: DataFrame, message_variable: str = "Hostname", seconds_per_row: int = items.DAY) -> DataFrame:
    return items.unique_items(df, X.interpolate("%{" + message_variable + "}"), seconds=seconds_per_row)


@plugin("filter", "message_schema")
def _message_schema(df: DataFrame) -> DataFrame:
    return items.message_schema(df)


@plugin("filter", "alert_throttle")
def _alert_throttle(df: DataFrame, alert_throttle: int = 3600) -> DataFrame:
    return anomaly.throttled(df, seconds=alert_throttle)


def _shown(made: DataFrame, columns: dict, title: str, rows: int, seconds: int) -> DataFrame:
    """A series of each host as a message with its text."""
    kept = series.retained(made, rows, seconds, ["hostname"])
    drawn = series.render(kept, columns, rows=rows, seconds=seconds, keys=["hostname"])
    bag = M.fields(M.field("payload_type", F.lit("cbuf"), "string", "file-extension"), M.field("payload_name", F.lit(title), "string"))
    return M.messages(drawn, type=F.lit("sandbox-output"), logger=F.lit(title), hostname=F.col("hostname"), payload=F.col("payload"), fields=bag)


def _system(name: str, make, columns: list[str], title: str) -> None:
    def run(df: DataFrame, sec_per_row: int = 60, rows: int = 1440, title: str = title) -> DataFrame:
        return _shown(make(df, seconds=sec_per_row), {c: ("count", "max") for c in columns}, title, rows, sec_per_row)

    plugin("filter", name)(run)


_system("load_average", system.load_average, system.LOAD, "Load Average")
_system("memory", system.memory, [*system.MEMORY, "SwapUsed"], "Memory")
_system("heap", system.heap, system.HEAP, "Heap")
_system("disks", system.disks, [*sorted(system.DISK_TOTALS), *system.DISK_TIMES], "Disks")
_system("processors", system.processors, ["cpu", "ctxt", "processes"], "Processors")


@plugin("filter", "heartbeat")
def _heartbeat(df: DataFrame, now_ns: int, heartbeat_timeout: int = 30) -> DataFrame:
    seen = items.heartbeats(df, F.lit(now_ns), timeout=heartbeat_timeout)
    return M.messages(seen, type=F.lit("heartbeat"), logger=F.lit("heartbeat"), hostname=F.col("hostname"), timestamp=F.col("last_heartbeat") * 1_000_000, payload=F.col("status"))


@plugin("filter", "cbuf_merge")
def _cbuf_merge(df: DataFrame, methods: dict) -> DataFrame:
    """Series in payloads, of many hosts, as one."""
    return series.merge(series.parse(df, keys=["hostname"]), methods)


@plugin("filter", "anomaly")
def _anomaly(df: DataFrame, anomaly_config: str, column: str, sec_per_row: int, rows: int, now: int) -> DataFrame:
    """Alerts of a series in payloads: rate of change at now (s), or Mann-Whitney tests."""
    made = series.parse(df, keys=["logger"]).where(F.col("col") == column).select("logger", "bucket_start", "value")
    out = None
    for test in anomaly.parse_config(anomaly_config):
        if test.algorithm == "roc":
            told = anomaly.roc(made, test, seconds=sec_per_row, rows=rows, keys=["logger"], now=now).where((F.col("bucket_start") == now) & F.col("msg").isNotNull()).select("logger", "msg")
        else:
            told = anomaly.mann_whitney_alerts(made, test, seconds=sec_per_row, rows=rows, now=now, keys=["logger"])
        out = told if out is None else out.unionByName(told)
    return M.messages(out, type=F.lit("alert"), logger=F.col("logger"), timestamp=F.lit(now * 1_000_000_000), payload=F.col("msg"))


@plugin("stream_filter", "counter")
def _count_stream(df: DataFrame, ticker_interval: int = 5, delay: str = "1 minute") -> DataFrame:
    made = stateful.window_counts(df, seconds=ticker_interval, keys=[], delay=delay)
    rate = F.col("n") / F.lit(float(ticker_interval))
    return _payloads(made.withColumn("payload", F.format_string("Got %d messages. %.2f msg/sec", F.col("n"), rate)), "counter-output", "counter")


@plugin("stream_filter", "heartbeat")
def _heartbeat_stream(df: DataFrame, heartbeat_timeout: int = 30, alert_throttle: int = 300) -> DataFrame:
    made = stateful.heartbeat_alerts(df, timeout=heartbeat_timeout, throttle=alert_throttle)
    return M.messages(made, type=F.lit("heartbeat"), logger=F.lit("heartbeat"), hostname=F.col("hostname"), timestamp=F.col("at") * 1_000_000, payload=F.coalesce("alert", "status"))


@plugin("stream_filter", "alert_throttle")
def _throttle_stream(df: DataFrame, alert_throttle: int = 3600) -> DataFrame:
    return M.messages(stateful.throttle(df, seconds=alert_throttle), type=F.lit("alert"), logger=F.col("logger"), timestamp=F.col("timestamp"), payload=F.col("payload"))


for _name, _encoder in {"payload": encoders.payload, "rst": encoders.rst, "es_json": encoders.es_json, "es_logstash_v0": encoders.es_logstash_v0, "es_payload": encoders.es_payload, "alert": encoders.alert, "schema_influx": encoders.influx_json, "statmetric_influx": encoders.statmetric_influx}.items():
    plugin("encoder", _name)(_encoder)


@plugin("output", "file")
def _file(df: DataFrame, line: Column, path: str, rotation_interval: int = 0) -> None:
    sinks.write_files(df, path, line, rotation_hours=rotation_interval)


@plugin("output", "messages")
def _write_messages(df: DataFrame, line: Column, path: str) -> None:
    df.select(*M.ENVELOPE, "fields").write.mode("append").parquet(path)


@plugin("output", "http")
def _http(df: DataFrame, line: Column, address: str, method: str = "POST", headers: dict | None = None) -> None:
    sinks.deliver(df, line, sinks.http(address, method=method, headers=headers), max_count=1)


@plugin("output", "elasticsearch")
def _elasticsearch(df: DataFrame, line: Column, server: str, flush_count: int = 10) -> None:
    sinks.elasticsearch(server, line, flush_count=flush_count)(df, 0)


@plugin("output", "tcp")
def _tcp(df: DataFrame, line: Column, host: str, port: int) -> None:
    sinks.deliver(df, line, sinks.tcp(host, port))


@plugin("output", "udp")
def _udp(df: DataFrame, line: Column, host: str, port: int) -> None:
    sinks.deliver(df, line, sinks.udp(host, port), max_count=1)


@plugin("output", "carbon")
def _carbon(df: DataFrame, line: Column, host: str, port: int, protocol: str = "tcp") -> None:
    sinks.carbon(host, port, protocol=protocol)(df, 0)


@plugin("output", "kafka")
def _kafka(df: DataFrame, line: Column, servers: str, **options) -> None:
    sinks.kafka(servers, line, **options)(df, 0)


@plugin("output", "smtp")
def _smtp(df: DataFrame, line: Column, host: str, send_from: str, send_to: list, subject: str = "", port: int = 25, batched: bool = False) -> None:
    """A mail a message; batched, one for all that a partition of the batch holds, and the section's trigger is the least time between them."""
    sinks.deliver(df, line, sinks.smtp(host, send_from, send_to, subject, port=port), max_count=1 << 30 if batched else 1)


@plugin("output", "nagios")
def _nagios(df: DataFrame, line: Column, url: str, service_description: str = "", username: str = "", password: str = "") -> None:
    sinks.nagios(url, service=service_description, user=username, password=password)(df, 0)


@plugin("output", "archives")
def _archives(df: DataFrame, line: Column, path: str) -> None:
    """Carbon lines of payloads as averages in a table, by metric and archive."""
    parts = F.split("line", r"\s+")
    points = sinks.valid_carbon(df).select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(2)).cast("bigint").alias("time"), F.get(parts, F.lit(1)).cast("double").alias("value"))
    sinks.archives(points).write.mode("append").parquet(path)


@plugin("output", "dashboard")
def _dashboard(df: DataFrame, line: Column, path: str) -> None:
    sinks.latest_payloads(df).write.mode("overwrite").parquet(path)


@plugin("output", "log")
def _log(df: DataFrame, line: Column) -> None:
    """To the driver's standard output, all lines, a partition of them here at a time."""
    for r in df.select(line.cast("string")).toLocalIterator():
        print(r[0] or "", end="")
