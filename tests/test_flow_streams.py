"""Configured flows over streams, splitters by name, and what filters may inject."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.operators import matcher
from weirline.plans import config

TAIL = """
[logs]
kind = "input"
type = "tail"
path = "%ENV[LOG]"

[out]
kind = "output"
type = "file"
path = "%ENV[OUT]"
message_matcher = "Type == 'logfile' && Payload !~ /^#/"
"""


def test_tail_to_file_goes_on_after_a_restart(spark, tmp_path):
    log, env = tmp_path / "a.log", {"LOG": str(tmp_path / "*.log"), "OUT": str(tmp_path / "out")}
    log.write_text("one\n#two\nthree\n")
    for more in ("", "four\n#five\nsix\n"):
        with log.open("a") as f:
            f.write(more)
        flow = config.Flow(spark, TAIL, env)
        queries = flow.run(str(tmp_path / "checkpoint"))
        try:
            queries["out"].processAllAvailable()
        finally:
            for q in queries.values():
                q.stop()
    assert sorted(r.value for r in spark.read.text(env["OUT"]).collect()) == sorted(["one", "three", "four", "six"])
    with pytest.raises(ValueError):
        config.Flow(spark, TAIL, env).run()


def test_filters_in_streams(spark, tmp_path):
    filtered = TAIL + '\n[top]\nkind = "filter"\ntype = "{}"\nmessage_matcher = "TRUE"\n'
    env = {"LOG": str(tmp_path / "*.log"), "OUT": str(tmp_path / "out")}
    assert config.Flow(spark, filtered.format("counter"), env).filters["top"].isStreaming
    with pytest.raises(ValueError, match="needs whole tables"):
        config.Flow(spark, filtered.format("frequent_items"), env)


def test_splitters_by_name(spark, tmp_path):
    (tmp_path / "f").write_text("a=1;b=2;rest")
    text = """
[in]
kind = "input"
type = "files"
splitter = "semicolons"
path = "%ENV[IN]"

[semicolons]
kind = "splitter"
type = "regex"
delimiter = "(;)"
"""
    flow = config.Flow(spark, text, {"IN": str(tmp_path / "f")})
    assert sorted(r.payload for r in flow.messages().collect()) == ["a=1;", "b=2;", "rest"]


def test_regex_splitter_takes_any_text(spark):
    from weirline.operators import splitters

    df = spark.createDataFrame([("one1two22three",), ("",), ("no delimiter",), ("9",)], "t string")
    read = lambda **k: [r.record for r in splitters.regex(df, "t", r"([0-9]+)", deliver_incomplete_final=True, **k).collect()]
    assert read() == ["one1", "two22", "three", "no delimiter", "9"]
    assert read(delimiter_eol=False) == ["one", "1two", "22three", "no delimiter", "9"]


def test_filters_cannot_take_names(spark):
    made = M.messages(spark.range(1), type=F.lit("t"), logger=F.lit("somebody"), hostname=F.lit("elsewhere"))
    row = matcher.injected(made, "mine", hostname="here").first()
    assert (row.type, row.logger, row.hostname) == ("sandbox.t", "mine", "here")
    many = spark.range(12).withColumn("tick", F.col("id") % 2)
    assert matcher.limited(many, ["tick"], most=6).count() == 12
    with pytest.raises(PySparkException, match="more than 5"):
        matcher.limited(many, ["tick"], most=5).count()
