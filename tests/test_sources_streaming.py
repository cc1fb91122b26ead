"""Wire form, sources, sinks and streams; each stream is held against the batch result."""

import json
import socket
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.functions import wire
from weirline.operators import encoders, items
from weirline.plans import tables
from weirline.sources import python_sources, readers, sinks
from weirline.streaming import stateful

SF = "/root/testdata/sf0.001"


def test_wire_round_trip(spark):
    df = tables.events(spark, SF).drop("event_id").limit(50)
    back = df.select(wire.decoded(wire.encoded()).alias("m")).select("m.*")
    assert Counter(map(str, back.collect())) == Counter(map(str, df.collect()))
    assert wire.decode_one(b"\x0a\xff") is None


def test_frames(spark, tmp_path):
    one, two = (wire.encode_one({"uuid": b"u" * 16, "timestamp": -5, "type": t, "logger": "", "severity": 3, "payload": "x", "env_version": "", "pid": -1, "hostname": "h", "fields": []}) for t in ("a", "b"))
    good = ("key", 1, b"secret", 1)
    data = b"noise\x1e" + wire.frame(one) + b"\x1e\x03zz" + wire.frame(two, good) + wire.frame(two, ("key", 1, b"wrong", 0)) + wire.frame(two, ("who", 1, b"secret", 0)) + wire.frame(one)[:-1]
    assert [(s, wire.decode_one(b)["type"]) for _, s, b in wire.frames(data, {"key_1": b"secret"})] == [("", "a"), ("key", "b")]
    (tmp_path / "log").write_bytes(data)
    rows = readers.framed(spark, str(tmp_path / "log"), {"key_1": b"secret"}, spec="Type == 'b'").collect()
    assert [(r.signer, r.type, r.timestamp, r.pid, r.severity) for r in rows] == [("key", "b", -5, -1, 3)]
    with pytest.raises(ValueError):
        wire.frame(b"x" * 70_000)


def test_log_streams(spark, tmp_path):
    import gzip

    for name, text in {"a-error.log": "new\n", "a-error.log.2": "old\n", "a-error.log.1": "mid\n"}.items():
        (tmp_path / name).write_text(text)
    with gzip.open(tmp_path / "b-error.log.gz", "wt") as f:
        f.write("zipped\n")
    pattern = r"(?P<Site>\w+)-error\.log(?:\.(?P<Seq>\d+))?(?:\.gz)?$"
    found = readers.files_in_order(spark, str(tmp_path), pattern, differentiator=["Site", "-errors"], priority=["^Seq"], translation={"Seq": {"missing": 0}})
    got = [(r.logger, r.place, r.file.rsplit("/", 1)[1]) for r in found.orderBy("logger", "place").collect()]
    assert got == [("a-errors", 0, "a-error.log.2"), ("a-errors", 1, "a-error.log.1"), ("a-errors", 2, "a-error.log"), ("b-errors", 0, "b-error.log.gz")]
    lines = readers.log_streams(spark, str(tmp_path), pattern, differentiator=["Site"])
    assert {(r.logger, r.payload) for r in lines.collect()} == {("a", "new"), ("a", "old"), ("a", "mid"), ("b", "zipped")}


def test_container_logs_and_requests(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "0123456789ab-json.log").write_text('{"log":"hi\\n","stream":"stdout","time":"2024-01-01T00:00:00.5Z","attrs":{"app":"x"}}\n')
    row = readers.container_logs(spark, str(tmp_path / "c"), labels=["app"]).first()
    assert (row.logger, row.payload, row.type, [f.name for f in row.fields]) == ("stdout", "hi", "DockerLog", ["ContainerID", "app"])
    (tmp_path / "r.json").write_text(json.dumps({"protocol": "HTTP/1.1", "path": "/", "remote_addr": "1.2.3.4", "headers": {"X": "1"}, "query": {"q": ["a", "b"]}, "body": "b", "received": 7}) + "\n")
    row = readers.http_requests(spark, str(tmp_path / "r.json"), headers=["X"]).first()
    assert (row.hostname, row.payload, row.severity) == ("1.2.3.4", "b", 6) and {f.name: list(f.value_string) for f in row.fields}["q"] == ["a", "b"]


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert not q.isActive and q.exception() is None
    return df.sparkSession.table(name)


def test_tail_source(spark, tmp_path):
    python_sources.register(spark)
    log = tmp_path / "x.log"
    log.write_text("one\ntwo\nhalf")
    stream = spark.readStream.format("tail").option("path", str(tmp_path / "*.log")).load()
    q = python_sources.as_messages(stream, type_="logfile").select("payload").writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        assert [r.payload for r in spark.table("tailed").collect()] == ["one", "two"]
        with log.open("a") as f:
            f.write(" line\nfour\n")
        q.processAllAvailable()
        assert [r.payload for r in spark.table("tailed").collect()] == ["one", "two", "half line", "four"]
    finally:
        q.stop()


@pytest.mark.parametrize("kind", ["poll", "process"])
def test_polled_sources(spark, tmp_path, kind):
    python_sources.register(spark)
    (tmp_path / "f").write_text("content")
    options = {"path": str(tmp_path / "f")} if kind == "poll" else {"command": json.dumps(["cat", str(tmp_path / "f")])}
    stream = spark.readStream.format(kind).options(**options).load()
    q = stream.writeStream.format("memory").queryName(f"polled_{kind}").start()
    try:
        import time

        for _ in range(100):
            if spark.table(f"polled_{kind}").count():
                break
            time.sleep(0.1)
        assert spark.table(f"polled_{kind}").first().payload == "content"
    finally:
        q.stop()


@pytest.fixture(scope="module")
def event_stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{SF}/events.parque[t]")
    ts = tables.nanos(F.col("ts"))
    return M.messages(rows, extra=["event_id", "value"], timestamp=ts, type=F.col("event_type"), hostname=F.concat(F.lit("host-"), F.col("user_id").cast("string")), payload=F.col("props"))


def test_window_counts(spark, event_stream):
    got = run(stateful.window_counts(event_stream, seconds=3600, keys=["type"], delay="1 hour"), "counted")
    batch = tables.events(spark, SF).groupBy("type", M.bucket(3600).alias("bucket_start")).agg(F.count(F.lit(1)).alias("n"))
    closed = {tuple(r) for r in got.collect()}
    everything = {(r.type, r.bucket_start, r.n) for r in batch.collect()}
    last = max(b for _, b, _ in everything)
    assert closed <= everything and {x for x in everything if x[1] < last - 7200} <= closed


def test_frequent_items_stream(spark, event_stream):
    got = run(stateful.frequent_items(event_stream, "hostname", keys=["type"], reset_days=0), "frequent", "update")
    exact = items.frequent_items(tables.events(spark, SF).withColumn("i", F.concat_ws("/", "type", "hostname")), F.col("i"), days=0, min_weight=0)
    assert {(f"{r.type}/{r.item}", r.weight) for r in got.collect()} == {(r.item, r.weight) for r in exact.collect()}


def test_heartbeats_and_throttle_streams(spark, event_stream):
    # Timers by the clock keep a query running, so it is stopped when the rows are through.
    q = stateful.heartbeat_alerts(event_stream, timeout=3600).writeStream.format("memory").queryName("beats").outputMode("update").trigger(processingTime="1 second").start()
    try:
        import time

        for _ in range(60):
            if spark.table("beats").count():
                break
            time.sleep(1)
        up = spark.createDataFrame(spark.table("beats").collect(), spark.table("beats").schema)
    finally:
        q.stop()
    exact = items.heartbeats(tables.events(spark, SF), F.lit(0))
    assert {(r.hostname, r.at) for r in up.collect()} == {(r.hostname, r.last_heartbeat) for r in exact.collect()}
    from weirline.operators import anomaly

    passed = run(stateful.throttle(event_stream, key="type", seconds=86400), "throttled")
    batch = anomaly.throttled(tables.events(spark, SF), seconds=86400, keys=["type"])
    assert {(r.type, r.timestamp) for r in passed.collect()} == {(r.type, r.timestamp) for r in batch.collect()}


def test_sinks(spark, tmp_path):
    server = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    server.bind(("127.0.0.1", 0))
    server.settimeout(5)
    df = M.messages(spark.createDataFrame([("a 1 10\nbad\nb 2 20\n",)], "p string"), payload=F.col("p"))
    sinks.carbon("127.0.0.1", server.getsockname()[1], protocol="udp")(df, 0)
    assert server.recv(1000) == b"a 1 10\nb 2 20\n"
    server.close()
    assert list(sinks.packed([b"a\n", b"bb\n", b"c\n"], max_count=2, max_bytes=100)) == [b"a\nbb\n", b"c\n"]
    tries, waits = [], []

    def fail():
        tries.append(1)
        if len(tries) < 4:
            raise OSError

    sinks.retry(fail, sleep=waits.append, jitter=0)
    assert waits == [0.25, 0.5, 1.0]
    state, text = sinks.nagios_state(F.col("payload"))
    rows = M.messages(spark.createDataFrame([("OK:fine",), ("CRITICAL:bad",), ("x",)], "p string"), payload=F.col("p")).select(state, text).collect()
    assert [tuple(r) for r in rows] == [(0, "fine"), (2, "bad"), (3, "x")]
    points = spark.createDataFrame([("m", t, float(t)) for t in range(0, 7200, 60)], "name string, time bigint, value double")
    got = {(r.step, r.bucket_start): r.value for r in sinks.archives(points).collect()}
    assert got[(3600, 0)] == sum(range(0, 3600, 60)) / 60 and (900, 6300) in got and (900, 0) in got and len([k for k in got if k[0] == 60]) == 120
    shown = M.messages(spark.createDataFrame([(1, "old"), (2, "new")], "t bigint, p string"), timestamp=F.col("t"), payload=F.col("p"), logger=F.lit("f"), fields=M.fields(M.field("payload_name", F.lit("n"), "string")))
    assert sinks.latest_payloads(shown).first().payload == "new"
    sinks.write_files(tables.events(spark, SF), str(tmp_path / "out"), encoders.payload(), rotation_hours=24)
    assert spark.read.text(str(tmp_path / "out")).count() == 1000 and len(list((tmp_path / "out").glob("interval=*"))) == 30
