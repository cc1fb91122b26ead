"""Sources that Spark reads itself: framed logs, rotated log files, container logs, brokers, landing folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import message as M
from ..functions import text as X
from ..functions import wire
from ..operators import matcher


def framed(spark: SparkSession, path: str, signers: Mapping[str, bytes] | None = None, *, spec: str = "TRUE", authenticate: bool = True) -> DataFrame:
    """key (file), offset, signer and messages of framed logs that the matcher chooses."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return matcher.match(wire.split_frames(files, "content", "path", signers, authenticate=authenticate), spec)


def log_streams(spark: SparkSession, path: str, pattern: str, *, differentiator: Sequence[str] = ("logfile",), priority: Sequence[str] = (), translation: Mapping[str, Mapping[str, int]] | None = None, hostname: str = "", line_separator: str = "\n", streaming: bool = False) -> DataFrame:
    """Lines of rotated logs (gzip too) as messages, with the file and its sort keys.

    The logger is the stream that the differentiator names; priority names the
    groups that order a stream's files, ^ before one that goes down.  A
    streaming read follows new files; lines added to a file that was read
    belong to the tail source.
    """
    reader = (spark.readStream if streaming else spark.read).option("lineSep", line_separator)
    if streaming:
        reader = reader.schema("value string")
    lines = reader.format("text").load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    named = lines.where(F.col("file").rlike(pattern.replace("(?P<", "(?<")))
    keys = X.file_keys(F.col("file"), pattern, [p.lstrip("^") for p in priority], translation)
    for p in priority:
        name = p.lstrip("^")
        named = named.withColumn(f"key_{name}", -keys[name] if p.startswith("^") else keys[name])
    stream = X.stream_name(F.col("file"), pattern, differentiator)
    when = F.unix_micros("modified") * 1000
    return M.messages(named, extra=["file", *[f"key_{p.lstrip('^')}" for p in priority]], type=F.lit("logfile"), logger=stream, hostname=F.lit(hostname), payload=F.col("value"), timestamp=when)


def files_in_order(spark: SparkSession, path: str, pattern: str, **options) -> DataFrame:
    """logger, place, file: which streams a pattern finds and in which order their files come."""
    from pyspark.sql import Window

    found = log_streams(spark, path, pattern, **options)
    keys = [c for c in found.columns if c.startswith("key_")]
    files = found.select("logger", "file", *keys).distinct()
    return files.select("logger", (F.row_number().over(Window.partitionBy("logger").orderBy(*keys, "file")) - 1).alias("place"), "file")


def container_logs(spark: SparkSession, path: str, *, labels: Sequence[str] = (), streaming: bool = False) -> DataFrame:
    """JSON logs of containers as messages: the logger is the stream, the container's id a field."""
    schema = "log string, stream string, time string, attrs map<string,string>"
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(schema).json(path).withColumn("_file", F.col("_metadata.file_path"))
    bag = M.fields(M.field("ContainerID", F.regexp_extract("_file", r"([0-9a-f]{12,64})", 1), "string"), *[M.field(n, F.try_element_at("attrs", F.lit(n)), "string") for n in labels])
    return M.messages(rows, type=F.lit("DockerLog"), logger=F.col("stream"), payload=F.regexp_replace("log", r"\n$", ""), timestamp=X.timestamp(F.col("time"), "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", fallback=False), fields=bag)


def kafka(spark: SparkSession, servers: str, topic: str, *, partition: int | None = None, offsets: str = "earliest", protobuf: bool = True, streaming: bool = True) -> DataFrame:
    """A topic, or one partition of it, as messages with fields Key, Topic, Partition and Offset; needs Spark's Kafka package."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("startingOffsets", offsets)
    reader = reader.option("subscribe", topic) if partition is None else reader.option("assign", f'{{"{topic}":[{partition}]}}')
    return from_kafka(reader.load(), protobuf=protobuf)


def from_kafka(rows: DataFrame, *, protobuf: bool = True) -> DataFrame:
    added = F.array(M.field("Key", F.col("key"), "bytes"), M.field("Topic", F.col("topic"), "string"), M.field("Partition", F.col("partition"), "integer"), M.field("Offset", F.col("offset"), "integer"))
    if not protobuf:
        return M.messages(rows, payload=F.col("value").cast("string"), timestamp=F.unix_micros("timestamp") * 1000, fields=added)
    read = rows.withColumn("_m", wire.decoded(F.col("value"))).where(F.col("_m").isNotNull())
    return read.select(*[F.col(f"_m.{n}").alias(n) for n in M.ENVELOPE], F.concat("_m.fields", added).alias("fields"))


def http_requests(spark: SparkSession, path: str, *, headers: Sequence[str] = (), streaming: bool = False) -> DataFrame:
    """Requests that a web server laid down as JSON lines, as messages: a table cannot listen, a folder can be filled."""
    schema = "protocol string, user_agent string, content_type string, path string, host string, remote_addr string, headers map<string,string>, query map<string,array<string>>, body string, received bigint"
    reader = spark.readStream if streaming else spark.read
    rows = reader.schema(schema).json(path)
    plain = {"Protocol": "protocol", "UserAgent": "user_agent", "ContentType": "content_type", "Path": "path", "Host": "host", "RemoteAddr": "remote_addr"}
    bag = M.fields(*[M.field(n, F.col(c), "string") for n, c in plain.items()], *[M.field(h, F.try_element_at("headers", F.lit(h)), "string") for h in headers])
    params = F.transform(F.map_entries(F.coalesce("query", F.create_map().cast("map<string,array<string>>"))), lambda e: M.field(e["key"], e["value"], "string", is_array=True))
    return M.messages(rows, type=F.lit("http.request"), severity=F.lit(6), env_version=F.lit("1"), hostname=F.col("remote_addr"), payload=F.col("body"), timestamp=F.col("received"), fields=F.concat(bag, params))


def tcp_lines(spark: SparkSession, host: str, port: int, *, type_: str = "tcp") -> DataFrame:
    """Lines of a socket as a stream of messages; Spark's socket source, which keeps no offsets, so for trials only."""
    rows = spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()
    return M.messages(rows, type=F.lit(type_), hostname=F.lit(host), payload=F.col("value"), timestamp=F.unix_micros("timestamp") * 1000)


def amqp(spark: SparkSession, url: str, queue: str) -> DataFrame:
    """Deliveries of a queue as a stream; needs the `pika` client on every machine."""
    try:
        import pika  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading AMQP needs the pika package") from e
    from . import python_sources

    python_sources.register_amqp(spark)
    return python_sources.as_messages(spark.readStream.format("amqp").options(url=url, queue=queue).load(), type_="amqp")


def cat(df: DataFrame, form: str = "txt") -> DataFrame:
    """Stored messages for reading: form is txt (blocks), json, raw (framed protobuf) or count."""
    from ..operators import encoders

    if form == "count":
        return df.agg(F.count(F.lit(1)).alias("n"))
    line = {"txt": encoders.rst, "json": lambda: F.to_json(F.struct(M.uuid_text().alias("uuid"), *[c for c in M.ENVELOPE if c != "uuid"], "fields")), "raw": lambda: wire.encoded(framed=True)}[form]()
    return df.select(line.alias("value"))
