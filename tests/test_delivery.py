"""Sinks against small servers, message variables, and acknowledgements."""

from __future__ import annotations

import json
import socket
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import SimpleNamespace
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.plans import config
from weirline.sources import python_sources, readers, sinks


@pytest.fixture
def server():
    """An HTTP server that keeps what it gets and answers with the next of `answers`, or {}."""
    got, answers = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(self.rfile.read(int(self.headers.get("Content-Length", 0))))
            body = json.dumps(answers.pop(0) if answers else {}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_POST

        def log_message(self, *_):
            pass

    made = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield SimpleNamespace(url=f"http://127.0.0.1:{made.server_port}", got=got, answers=answers)
    made.shutdown()


def messages(spark, *payloads, **columns):
    return M.messages(spark.createDataFrame([(p,) for p in payloads], "p string").coalesce(1), payload=F.col("p"), **columns)


def test_datagrams_over_the_limit_are_refused_whole(spark):
    inbox = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    inbox.bind(("127.0.0.1", 0))
    inbox.settimeout(5)
    df = messages(spark, "fits", "x" * 100, "fits too")
    connect = sinks.udp("127.0.0.1", inbox.getsockname()[1], max_message_size=20)
    assert sinks.deliver(df, F.col("payload"), connect, max_count=1) == 1
    assert [inbox.recv(1000) for _ in range(2)] == [b"fits", b"fits too"]
    inbox.close()


def test_bulk_answers(spark, server):
    """A document put off is sent again alone; one refused for good is counted; the third is taken."""
    server.answers.append({"errors": True, "items": [{"index": {"status": 429}}, {"index": {"status": 400, "error": "bad"}}, {"index": {"status": 201}}]})
    df = messages(spark, "1", "2", "3")
    line = F.concat(F.lit('{"index":{}}\n{"v":'), F.col("payload"), F.lit("}\n"))
    assert sinks.deliver(df, line, sinks.bulk(f"{server.url}/_bulk"), max_count=10) == 1
    assert server.got[0].count(b"index") == 3 and server.got[1:] == [b'{"index":{}}\n{"v":1}\n']


def test_passive_checks(spark, server):
    df = messages(spark, "WARNING:disk & more", hostname=F.lit("h"), logger=F.lit("disks"))
    sinks.nagios(f"{server.url}/cmd")(df, 0)
    form = {k: v[0] for k, v in parse_qs(server.got[0].decode()).items()}
    assert form == {"cmd_typ": "30", "cmd_mod": "2", "host": "h", "service": "disks", "plugin_state": "1", "plugin_output": "disk & more"}


def test_kafka_rows(spark):
    df = messages(spark, "body", type=F.lit("t"), hostname=F.lit("h"), fields=M.fields(M.field("n", F.lit(7), "integer"), M.field("d", F.lit(2.5e6), "double")))
    row = sinks.kafka_rows(df, F.col("payload"), topic_variable="Fields[n]", partitioner="Hash", hash_variable="Hostname").first()
    assert (row.topic, bytes(row.key), bytes(row.value)) == ("7", b"h", b"body")
    row = sinks.kafka_rows(df, F.col("payload"), topic="all").first()
    assert (row.topic, row.key) == ("all", None)
    for bad in ({}, {"topic": "a", "topic_variable": "Type"}, {"topic": "a", "partitioner": "Hash"}, {"topic": "a", "hash_variable": "Type"}, {"topic": "a", "partitioner": "Other"}, {"topic_variable": "Pid"}):
        with pytest.raises(ValueError):
            sinks.kafka_rows(df, F.col("payload"), **bad)


def test_variables(spark):
    doubles = {0.0: "0", 1.0: "1", -2.5: "-2.5", 100000.0: "100000", 999999.5: "999999.5", 1000000.0: "1e+06", 1234567.5: "1.2345675e+06", 1e21: "1e+21", 2.5e-5: "2.5e-05", 0.0001: "0.0001", 0.00025: "0.00025", 0.001: "0.001", 1e-300: "1e-300", -12345678.0: "-1.2345678e+07", float("inf"): "+Inf", float("nan"): "NaN"}
    df = spark.createDataFrame([(d,) for d in doubles], "d double")
    assert [r[0] for r in df.select(M.general(F.col("d"))).collect()] == list(doubles.values())
    bag = F.array(M.field("a", F.lit("x"), "string"), M.field("a", F.array(F.lit(True), F.lit(False)), "bool", is_array=True))
    one = messages(spark, "p", logger=F.lit("l"), fields=bag)
    assert tuple(one.select(*[M.variable(v) for v in ("Logger", "Payload", "Fields[a]", "Fields[a][1]", "Fields[a][1][1]", "Fields[a][2]", "Fields[b]")]).first()) == ("l", "p", "x", "true", "false", "", "")


def test_from_kafka(spark):
    rows = spark.createDataFrame([(b"k", b"text", "t", 3, 9)], "key binary, value binary, topic string, partition int, offset bigint").withColumn("timestamp", F.timestamp_seconds(F.lit(5)))
    row = readers.from_kafka(rows, protobuf=False).first()
    assert (row.payload, row.timestamp, [f.name for f in row.fields]) == ("text", 5_000_000_000, ["Key", "Topic", "Partition", "Offset"])


def test_acknowledged_up_to_the_commit(monkeypatch):
    """A batch that was read and not committed is not acknowledged."""
    deliveries = [SimpleNamespace(delivery_tag=k + 1, routing_key="") for k in range(5)]
    acked = []

    class Channel:
        def basic_get(self, queue):
            return (deliveries.pop(0), SimpleNamespace(content_type=""), b"x") if deliveries else (None, None, None)

        def basic_ack(self, tag, multiple):
            acked.append((tag, multiple))

    monkeypatch.setitem(__import__("sys").modules, "pika", SimpleNamespace())
    reader = python_sources._Amqp({"queue": "q", "maxMessages": 2})
    reader.channel = Channel()
    rows, one = reader.read({"n": 0})
    _, two = reader.read(one)
    assert len(list(rows)) == 2 and two == {"n": 2}
    reader.commit(one)
    assert acked == [(2, True)]
    reader.commit(two)
    assert acked == [(2, True), (4, True)]


def test_http_source_severities(spark, server):
    reader = python_sources._Http({"urls": json.dumps([server.url, "http://127.0.0.1:1/"]), "error_severity": "2", "user": "u", "password": "p"})
    df = spark.createDataFrame(reader.snapshot(), python_sources.SCHEMA)
    rows = python_sources.as_messages(df, type_="http").collect()
    assert [(r.type, r.severity) for r in rows] == [("http.data", 6), ("http.error", 2)]
    assert not {"severity", "kind"} & {f.name for r in rows for f in r.fields}


def test_log_prints_every_line(spark, capsys):
    from weirline.operators import encoders

    config._log(M.messages(spark.range(1500), payload=F.lit("x")), encoders.payload())
    assert capsys.readouterr().out.count("x\n") == 1500


def test_mails(spark, monkeypatch):
    """One mail a message, its body in base64."""
    sent = []

    class Server:
        def __init__(self, host, port):
            sent.append((host, port))

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def send_message(self, mail):
            sent.append((mail["To"], mail["Content-Transfer-Encoding"], mail.get_content()))

    monkeypatch.setattr("smtplib.SMTP", Server)
    sinks.smtp("mail", "a@x", ["b@x", "c@x"], "s", port=26)()(b"text\n")
    assert sent == [("mail", 26), ("b@x, c@x", "base64", "text\n")]
