"""Fan-out, stored streams for reading, process folders, and container events."""

import json

import pytest
from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.operators import decoders, matcher
from weirline.plans import tables
from weirline.sources import python_sources, readers

SF = "/root/testdata/sf0.001"


def test_fan_out(spark):
    got = {}
    routes = {"errors": ("Type == 'error'", lambda df: got.update(errors=df.count())), "all": ("TRUE", lambda df: got.update(all=df.count(), columns=df.columns))}
    df = tables.events(spark, SF)
    matcher.fan_out(routes)(df)
    assert got == {"errors": df.where("type = 'error'").count(), "all": 1000, "columns": df.columns}


def test_cat(spark, tmp_path):
    df = tables.events(spark, SF).limit(3)
    assert readers.cat(df, "count").first().n == 3
    assert all(json.loads(r.value)["logger"] == "events" for r in readers.cat(df, "json").collect())
    assert all(":Logger: events" in r.value for r in readers.cat(df).collect())
    frames = b"".join(bytes(r.value) for r in readers.cat(df, "raw").collect())
    (tmp_path / "log").write_bytes(frames)
    assert readers.framed(spark, str(tmp_path / "log"), spec="Logger == 'events'").count() == 3


def test_process_directory(tmp_path):
    for folder, name in (("10", "a"), ("60", "b"), ("x", "c")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"{name}.toml").write_text('command = ["echo", "hi"]\ntimeout = 5\n')
    found = python_sources.process_directory(str(tmp_path))
    assert sorted(found) == ["10/a", "60/b"] and json.loads(found["10/a"]["command"]) == ["echo", "hi"] and found["60/b"]["timeout"] == "5"


def test_container_messages(spark):
    def read(payload, column):
        return decoders.decode(M.messages(spark.createDataFrame([(payload,)], "p string"), payload=F.col("p")), column).first()

    row = read('{"id":"c1","status":"start","from":"img","time":7}', decoders.container_event())
    assert (row.type, row.timestamp, row.payload) == ("DockerEvent", 7 * 10**9, "id:c1 status:start from:img time:7")
    row = read('{"read":"2024-01-01T00:00:00.5Z","name":"/web"}', decoders.container_stats())
    assert (row.type, row.timestamp, row.fields[0].value_string[0]) == ("DockerStats", 1704067200500000000, "web")
    assert read("{}", decoders.container_event()).decode_error


def test_amqp_needs_a_client(spark):
    with pytest.raises(RuntimeError):
        readers.amqp(spark, "amqp://localhost", "q")
