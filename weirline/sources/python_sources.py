"""Streams that Spark has no reader for, as Python data sources.

register(spark) makes them known by name:

    tail      lines appended to local files, by byte position (path, lineSep)
    poll      a file read again at each trigger (path)
    process   output of a command at each trigger (command, a JSON list)
    http      the answer of addresses at each trigger (urls, a JSON list)
    udp       datagrams at an address (host, port); lost if not read in time

Rows are messages' raw parts: source, payload, at (ns) and a JSON of details.
The offset of tail is each file's position, so a restart goes on where the
checkpoint ends, and re-reads a range if a batch is repeated.
"""

from __future__ import annotations

import base64
import glob
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from ..functions import message as M

SCHEMA = "source string, payload string, at bigint, details string"


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, sep: str) -> None:
        self.path, self.start, self.end, self.sep = path, start, end, sep


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.sep = options["path"], options.get("lineSep", "\n")
        self.from_end = options.get("initialTail", "false") == "true"

    def _ends(self) -> dict[str, int]:
        """The byte after each file's last whole line."""
        out = {}
        for path in sorted(glob.glob(self.path)):
            size = os.path.getsize(path)
            with open(path, "rb") as f:
                step, at, end = 1 << 16, size, 0
                while at > 0 and not end:
                    at = max(0, at - step)
                    f.seek(at)
                    found = f.read(min(step, size - at)).rfind(self.sep.encode())
                    end = at + found + len(self.sep.encode()) if found >= 0 else 0
            out[path] = end
        return out

    def initialOffset(self) -> dict:
        return self._ends() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list:
        # A file that shrank was truncated or replaced: it is read from its start.
        return [_Range(p, s if s <= e else 0, e, self.sep) for p, e in end.items() if (s := start.get(p, 0)) != e]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            text = f.read(partition.end - partition.start).decode(errors="replace")
        for line in text.split(partition.sep)[:-1]:
            yield partition.path, line, time.time_ns(), "{}"

    def commit(self, end: dict) -> None:
        pass


class _PollReader(SimpleDataSourceStreamReader):
    """One snapshot a trigger; the offset counts snapshots, and the last ones are kept to be repeated."""

    def __init__(self, options: dict) -> None:
        self.options, self.kept = options, {}

    def initialOffset(self) -> dict:
        return {"n": 0}

    def snapshot(self) -> list[tuple]:
        raise NotImplementedError

    def read(self, start: dict):
        rows = self.snapshot()
        self.kept[start["n"]] = rows
        return iter(rows), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([r for n in range(start["n"], end["n"]) for r in self.kept.get(n, [])])

    def commit(self, end: dict) -> None:
        self.kept = {n: r for n, r in self.kept.items() if n >= end["n"]}


class _FilePoll(_PollReader):
    def snapshot(self) -> list[tuple]:
        with open(self.options["path"], encoding="utf-8", errors="replace") as f:
            return [(self.options["path"], f.read(), time.time_ns(), json.dumps({"FilePath": self.options["path"]}))]


class _Process(_PollReader):
    def snapshot(self) -> list[tuple]:
        import subprocess

        command = json.loads(self.options["command"])
        done = subprocess.run(command, capture_output=True, text=True, errors="replace", timeout=float(self.options.get("timeout", 60)), check=False)
        told = json.dumps({"ProcessInputName": self.options.get("name", command[0]), "ExitStatus": done.returncode, "SubcmdErrors": done.stderr})
        return [(command[0], done.stdout, time.time_ns(), told)]


class _Http(_PollReader):
    def snapshot(self) -> list[tuple]:
        import urllib.error
        import urllib.request

        out = []
        for url in json.loads(self.options["urls"]):
            began = time.time()
            headers = json.loads(self.options.get("headers", "{}"))
            if "user" in self.options:
                given = f"{self.options['user']}:{self.options.get('password', '')}".encode()
                headers["Authorization"] = "Basic " + base64.b64encode(given).decode()
            body = self.options["body"].encode() if "body" in self.options else None
            request = urllib.request.Request(url, data=body, headers=headers, method=self.options.get("method", "GET"))
            try:
                with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", 30))) as got:
                    body, told = got.read().decode(errors="replace"), {"StatusCode": got.status, "Status": f"{got.status} {got.reason}", "Protocol": f"HTTP/{got.version / 10}"}
            except urllib.error.HTTPError as e:
                body, told = e.read().decode(errors="replace"), {"StatusCode": e.code, "Status": f"{e.code} {e.reason}", "Protocol": "HTTP/1.1"}
            except OSError as e:
                body, told = str(e), {"StatusCode": 0, "Status": "error"}
            good = 200 <= told["StatusCode"] < 300
            told["severity"] = self.options.get("success_severity", "6") if good else self.options.get("error_severity", "1")
            told["kind"] = "data" if told["StatusCode"] else "error"
            out.append((url, body, time.time_ns(), json.dumps(told | {"ResponseSize": len(body), "ResponseTime": time.time() - began})))
        return out


class _Udp(_PollReader):
    def snapshot(self) -> list[tuple]:
        import socket

        if not hasattr(self, "socket"):
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind((self.options.get("host", "127.0.0.1"), int(self.options["port"])))
            self.socket.setblocking(False)
        out = []
        while len(out) < int(self.options.get("maxPackets", 10_000)):
            try:
                data, peer = self.socket.recvfrom(64 * 1024)
            except BlockingIOError:
                break
            out.append((peer[0], data.decode(errors="replace"), time.time_ns(), json.dumps({"port": peer[1]})))
        return out


def _source(kind: str, reader: type) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            return SCHEMA

        if issubclass(reader, SimpleDataSourceStreamReader):

            def simpleStreamReader(self, schema):
                return reader(dict(self.options))

        else:

            def streamReader(self, schema):
                return reader(dict(self.options))

    Source.__name__ = f"{kind.title()}Source"
    return Source


SOURCES = {"tail": _TailReader, "poll": _FilePoll, "process": _Process, "http": _Http, "udp": _Udp}


def register(spark: SparkSession) -> None:
    for kind, reader in SOURCES.items():
        spark.dataSource.register(_source(kind, reader))


def as_messages(rows: DataFrame, *, type_: str, hostname: str = "") -> DataFrame:
    """Their rows as messages; each detail is a field, but severity and kind: they set the severity, and end the type (type_.kind)."""
    told = F.from_json("details", "map<string,string>")
    details = F.map_entries(F.map_filter(told, lambda k, _: ~k.isin("severity", "kind")))
    kind = F.concat_ws(".", F.lit(type_), F.try_element_at(told, F.lit("kind")))
    severity = F.try_element_at(told, F.lit("severity")).try_cast("int")
    bag = F.transform(F.coalesce(details, F.array().cast("array<struct<key:string,value:string>>")), lambda e: M.field(e["key"], e["value"], "string"))
    return M.messages(rows, type=kind, severity=severity, logger=F.col("source"), payload=F.col("payload"), hostname=F.lit(hostname), timestamp=F.col("at"), fields=bag)


class _Amqp(_PollReader):
    """Deliveries are acknowledged when their batch is committed, and none that came after it."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.tags: dict[int, int] = {}

    def snapshot(self) -> list[tuple]:
        import pika

        if not hasattr(self, "channel"):
            self.channel = pika.BlockingConnection(pika.URLParameters(self.options["url"])).channel()
        out, newest = [], None
        while len(out) < int(self.options.get("maxMessages", 10_000)):
            method, properties, body = self.channel.basic_get(self.options["queue"])
            if method is None:
                break
            newest = method.delivery_tag
            out.append((self.options["queue"], body.decode(errors="replace"), time.time_ns(), json.dumps({"routing_key": method.routing_key, "content_type": properties.content_type or ""})))
        self.newest = newest
        return out

    def read(self, start: dict):
        rows, end = super().read(start)
        if self.newest is not None:
            self.tags[end["n"]] = self.newest  # what a commit up to there acknowledges
        return rows, end

    def commit(self, end: dict) -> None:
        super().commit(end)
        done = [n for n in self.tags if n <= end["n"]]
        if done:
            self.channel.basic_ack(self.tags[max(done)], multiple=True)
            self.tags = {n: t for n, t in self.tags.items() if n > end["n"]}


def register_amqp(spark: SparkSession) -> None:
    spark.dataSource.register(_source("amqp", _Amqp))


def process_directory(folder: str) -> dict[str, dict[str, str]]:
    """Options of a process source, by name, for each <folder>/<seconds>/<name>.toml with a command list in it.

    Reading it again shows what came, went or changed; whoever runs the
    queries starts and stops them by that.
    """
    import tomllib

    out = {}
    for path in sorted(glob.glob(os.path.join(folder, "*", "*.toml"))):
        interval, name = path.split(os.sep)[-2], os.path.basename(path)[: -len(".toml")]
        if not interval.isdigit():
            continue
        with open(path, "rb") as f:
            made = tomllib.load(f)
        out[f"{interval}/{name}"] = {"name": name, "interval": interval, "command": json.dumps(made["command"]), **{k: str(v) for k, v in made.items() if k != "command"}}
    return out
