"""Sinks: tables and files by Spark's own writers, services by batches of encoded lines.

A service's sink is a function of (batch, epoch) for foreachBatch.  Lines go
out from the partitions that hold them, in requests of bounded size, with
retries; a batch that fails is repeated by Spark from the checkpoint, so
delivery is at least once.
"""

from __future__ import annotations

import json
import logging
import random
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Send = Callable[[bytes], None]
_LOG = logging.getLogger(__name__)


class Refused(ValueError):
    """A request that can never be delivered: it is counted and reported, and the next one goes on."""


def retry(act: Callable[[], None], *, most: int = 10, delay: float = 0.25, max_delay: float = 30.0, jitter: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> None:
    """Tries again after delays that double; most=-1 tries for ever."""
    tries = 0
    while True:
        try:
            return act()
        except OSError:
            tries += 1
            if 0 <= most < tries:
                raise
            sleep(min(max_delay, delay * 2 ** (tries - 1)) + random.random() * jitter)


def packed(lines: Iterable[bytes], *, max_count: int = 1000, max_bytes: int = 1 << 20) -> Iterator[bytes]:
    """Lines joined to requests of at most that many lines and bytes; a longer line goes alone."""
    held, size = [], 0
    for line in lines:
        if held and (len(held) >= max_count or size + len(line) > max_bytes):
            yield b"".join(held)
            held, size = [], 0
        held.append(line)
        size += len(line)
    if held:
        yield b"".join(held)


def deliver(df: DataFrame, line: Column, connect: Callable[[], Send], *, max_count: int = 1000, max_bytes: int = 1 << 20, retries: int = 10) -> int:
    """Sends each row's line (text or bytes) from its partition; connect() is called once a partition.

    Returns how many requests the sink refused for good; each is reported
    where it happens, and their number here.
    """
    refused = df.sparkSession.sparkContext.accumulator(0)

    def send(rows) -> None:
        out = None
        for request in packed((bytes(r[0]) for r in rows if r[0] is not None), max_count=max_count, max_bytes=max_bytes):
            out = out or connect()
            try:
                retry(lambda: out(request), most=retries)  # noqa: B023
            except Refused as e:
                _LOG.error("refused: %s", e)
                refused.add(1)

    df.select(line.cast("binary")).foreachPartition(send)
    if refused.value:
        _LOG.error("%d requests were refused", refused.value)
    return refused.value


def http(url: str, *, method: str = "POST", headers: dict[str, str] | None = None, timeout: float = 30) -> Callable[[], Send]:
    """Requests of that address; an answer of 400 and more counts as failed."""

    def connect() -> Send:
        import urllib.request

        def send(body: bytes) -> None:
            urllib.request.urlopen(urllib.request.Request(url, data=body, headers=headers or {}, method=method), timeout=timeout).close()

        return send

    return connect


def tcp(host: str, port: int, *, timeout: float = 30, keep_alive: bool = False) -> Callable[[], Send]:
    def connect() -> Send:
        import socket

        state: dict = {}

        def send(body: bytes) -> None:
            if "s" not in state:
                state["s"] = socket.create_connection((host, port), timeout)
                if keep_alive:
                    state["s"].setsockopt(socket.SOL_SOCKET, socket.SO_KEEPALIVE, 1)
            try:
                state["s"].sendall(body)
            except OSError:
                state.pop("s").close()
                raise

        return send

    return connect


def udp(host: str, port: int, *, max_message_size: int = 65_507) -> Callable[[], Send]:
    def connect() -> Send:
        import socket

        s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)

        def send(body: bytes) -> None:
            if len(body) > max_message_size:
                raise Refused(f"{len(body)} bytes are more than the {max_message_size} of a datagram")
            s.sendto(body, (host, port))

        return send

    return connect


def smtp(host: str, sender: str, recipients: list[str], subject: str, *, port: int = 25) -> Callable[[], Send]:
    def connect() -> Send:
        import smtplib
        from email.message import EmailMessage

        def send(body: bytes) -> None:
            mail = EmailMessage()
            mail["From"], mail["To"], mail["Subject"] = sender, ", ".join(recipients), subject
            mail.set_content(body.decode(errors="replace"), cte="base64")
            with smtplib.SMTP(host, port) as server:
                server.send_message(mail)

        return send

    return connect


def to_service(line: Column, connect: Callable[[], Send], **limits) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch."""
    return lambda batch, epoch: deliver(batch, line, connect, **limits)


def elasticsearch(url: str, line: Column, *, flush_count: int = 10, **limits) -> Callable[[DataFrame, int], None]:
    """Bulk requests of encoded documents.  Of an answer's items those that were refused for load (429, 5xx)
    are sent again, alone; those that the index refuses for good are counted and reported."""
    return to_service(line, bulk(f"{url.rstrip('/')}/_bulk"), max_count=flush_count, **limits)


def bulk(url: str, *, timeout: float = 30, retries: int = 10) -> Callable[[], Send]:
    def connect() -> Send:
        import urllib.request

        def post(body: bytes) -> list[dict]:
            request = urllib.request.Request(url, data=body, headers={"Content-Type": "application/x-ndjson"}, method="POST")
            with urllib.request.urlopen(request, timeout=timeout) as got:
                told = json.loads(got.read() or b"{}")
            return [next(iter(item.values())) for item in told.get("items", [])] if told.get("errors") else []

        def send(body: bytes) -> None:
            lines = body.rstrip(b"\n").split(b"\n")
            waiting, lost = [b"\n".join(pair) + b"\n" for pair in zip(lines[::2], lines[1::2], strict=True)], []

            def attempt() -> None:
                items = post(b"".join(waiting))
                bad = [(d, i) for d, i in zip(waiting, items, strict=False) if i.get("status", 200) >= 300]
                lost.extend(i for _, i in bad if i["status"] != 429 and i["status"] < 500)
                waiting[:] = [d for d, i in bad if i["status"] == 429 or i["status"] >= 500]
                if waiting:
                    raise OSError(f"{len(waiting)} documents were put off")

            retry(attempt, most=retries)
            if lost:
                raise Refused(f"{len(lost)} documents, first for {lost[0].get('error')}")

        return send

    return connect


#: The producer's classes by the name of the way to deal.
PARTITIONERS = {"Random": "", "Hash": "", "RoundRobin": "org.apache.kafka.clients.producer.RoundRobinPartitioner"}


def kafka_rows(df: DataFrame, line: Column, *, topic: str = "", topic_variable: str = "", partitioner: str = "Random", hash_variable: str = "") -> DataFrame:
    """topic, key and value of each message; the key is set by the Hash partitioner, and Kafka deals by it."""
    from ..functions import message as M

    if partitioner not in PARTITIONERS:
        raise ValueError(f"partitioner is one of {', '.join(PARTITIONERS)}")
    if bool(topic) == bool(topic_variable):
        raise ValueError("name a topic or a topic_variable")
    if (partitioner == "Hash") != bool(hash_variable):
        raise ValueError("hash_variable goes with the Hash partitioner")
    named = M.variable(topic_variable) if topic_variable else F.lit(topic)
    key = M.variable(hash_variable).cast("binary") if hash_variable else F.lit(None).cast("binary")
    return df.select(named.alias("topic"), key.alias("key"), line.cast("binary").alias("value"))


def kafka(servers: str, line: Column, *, partitioner: str = "Random", acks: str = "1", compression: str = "none", options: dict[str, str] | None = None, **naming) -> Callable[[DataFrame, int], None]:
    """Encoded messages to a topic, or to the topic that a message variable names; needs Spark's Kafka package."""
    settings = {"kafka.bootstrap.servers": servers, "kafka.acks": acks, "kafka.compression.type": compression, **(options or {})}
    if PARTITIONERS.get(partitioner):
        settings["kafka.partitioner.class"] = PARTITIONERS[partitioner]

    def write(batch: DataFrame, epoch: int = 0) -> None:
        kafka_rows(batch, line, partitioner=partitioner, **naming).write.format("kafka").options(**settings).save()

    return write


#: Fixed value: bytes that a UDP packet of stat lines holds at most.
CARBON_PACKET = 62 * 1024


def valid_carbon(df: DataFrame, text: str = "payload") -> DataFrame:
    """line: those of the payload's lines that are name, value and time."""
    lines = df.select(F.explode(F.split(F.col(text), "\n")).alias("line"))
    part = F.split(F.trim("line"), r"\s+")
    good = (F.size(part) == 3) & F.get(part, F.lit(1)).try_cast("double").isNotNull() & F.get(part, F.lit(2)).try_cast("bigint").between(0, (1 << 32) - 1)
    return lines.where(good).select(F.concat(F.trim("line"), F.lit("\n")).alias("line"))


def carbon(host: str, port: int, *, protocol: str = "tcp") -> Callable[[DataFrame, int], None]:
    connect = tcp(host, port) if protocol == "tcp" else udp(host, port)
    return lambda batch, epoch: deliver(valid_carbon(batch), F.col("line"), connect, max_bytes=CARBON_PACKET)


#: States by the word a payload begins with.
NAGIOS = {"OK": 0, "WARNING": 1, "CRITICAL": 2}


def nagios_state(text: Column) -> tuple[Column, Column]:
    """(state, message) of a payload WORD:message; another word is state 3."""
    word = F.regexp_extract(text, r"^(OK|WARNING|CRITICAL|UNKNOWN):", 1)
    state = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NAGIOS.items() for x in kv]), word), F.lit(3))
    return state, F.regexp_replace(text, r"^(OK|WARNING|CRITICAL|UNKNOWN):", "")


def nagios(url: str, *, service: str = "", user: str = "", password: str = "", timeout: float = 30) -> Callable[[DataFrame, int], None]:
    """Passive check results, one a message, to the web form of a monitoring server: the host is the message's, the
    service its logger unless one is named."""
    state, text = nagios_state(F.col("payload"))
    form = {"cmd_typ": F.lit("30"), "cmd_mod": F.lit("2"), "host": F.col("hostname"), "service": F.lit(service) if service else F.col("logger"), "plugin_state": state.cast("string"), "plugin_output": text, "performance_data": F.lit("")}
    body = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in form.items()])
    headers = {"Content-Type": "application/x-www-form-urlencoded"}
    if user:
        import base64

        headers["Authorization"] = "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()
    return to_service(body, http(url, headers=headers, timeout=timeout), max_count=1)


#: Seconds a point and points of the default archives.
ARCHIVES = ((60, 1440), (900, 8), (3600, 168), (43200, 1456))


def archives(points: DataFrame, archives: Iterable[tuple[int, int]] = ARCHIVES) -> DataFrame:
    """name, step, bucket_start, value: averages of (name, time in s, value) for each archive, as far back as it reaches."""
    steps = F.array(*[F.struct(F.lit(s).cast("bigint").alias("step"), F.lit(s * n).cast("bigint").alias("reach")) for s, n in archives])
    newest = points.groupBy("name").agg(F.max("time").alias("_newest"))
    rows = points.join(newest, "name").withColumn("_a", F.explode(steps)).where(F.col("time") > F.col("_newest") - F.col("_a.reach"))
    return rows.groupBy("name", F.col("_a.step").alias("step"), (F.col("time") - F.pmod("time", F.col("_a.step"))).alias("bucket_start")).agg(F.avg("value").alias("value"))


def latest_payloads(df: DataFrame) -> DataFrame:
    """logger, payload_name, payload_type, payload, timestamp: the newest payload of each name, as a dashboard shows it."""
    from ..functions import message as M

    rows = df.select("logger", M.text("payload_name").alias("payload_name"), M.text("payload_type").alias("payload_type"), "payload", "timestamp")
    return rows.groupBy("logger", "payload_name").agg(*[F.max_by(c, F.struct("timestamp", "payload")).alias(c) for c in ("payload_type", "payload")], F.max("timestamp").alias("timestamp"))


def write_files(df: DataFrame, path: str, line: Column, *, rotation_hours: int = 1) -> None:
    """Text files of encoded lines in a folder for each rotation interval of event time."""
    if rotation_hours not in (0, 1, 4, 12, 24):
        raise ValueError("rotation is 0, 1, 4, 12 or 24 hours")
    clean = F.regexp_replace(line, r"\n$", "").alias("value")
    if not rotation_hours:
        return df.select(clean).write.mode("append").text(path)
    hours = F.expr(f"timestamp div {rotation_hours * 3_600_000_000_000} * {rotation_hours * 3600}")
    rows = df.select(clean, F.date_format(F.timestamp_seconds(hours), "yyyyMMdd-HH").alias("interval"))
    return rows.write.mode("append").partitionBy("interval").text(path)
