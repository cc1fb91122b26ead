"""A flow from a TOML text."""

import pytest
from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.plans import config, registry, tables

SF = "/root/testdata/sf0.001"
TEXT = """
[stored]
kind = "input"
type = "messages"
path = "%ENV[MESSAGES]"

[per_day]
kind = "filter"
type = "counter"
ticker_interval = 86400
message_matcher = "Type == 'error'"

[again]
kind = "filter"
type = "counter"
ticker_interval = 86400
message_matcher = "Type == 'counter-output' && Logger != 'nobody'"

[out]
kind = "output"
type = "file"
path = "%ENV[OUT]"
message_matcher = "Type == 'counter-output'"
"""


def test_flow(spark, tmp_path):
    tables.events(spark, SF).drop("event_id").write.parquet(str(tmp_path / "in"))
    flow = config.Flow(spark, TEXT, {"MESSAGES": str(tmp_path / "in"), "OUT": str(tmp_path / "out")})
    flow.run()
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    errors = tables.events(spark, SF).where("type = 'error'")
    days = errors.select(M.bucket(86400)).distinct().count()
    assert sum(x.startswith("Got ") for x in lines) == len(lines) == days  # `again` would match what it emits, so that is refused
    assert f"Got {errors.count()} messages." in " ".join(lines)
    assert flow.messages().where("loop_count > 4").count() == 0


def test_errors(spark):
    with pytest.raises(KeyError):
        config.load(TEXT, {})
    for bad in ('[a]\nkind = "nothing"', '[a]\nkind = "filter"\ntype = "counter"', '[a]\nkind = "output"\ntype = "log"\nmessage_matcher = "Type ="', '[a]\nkind = "input"\ntype = "unknown"'):
        with pytest.raises((ValueError, KeyError)):
            config.load(bad)


def test_user_plugin(spark):
    @registry.plugin("decoder", "shout")
    def shout():
        from weirline.operators import decoders

        return decoders.decoded(F.lit(True), payload=F.upper("payload"))

    df = M.messages(spark.createDataFrame([("abc",)], "p string"), payload=F.col("p"))
    from weirline.operators import decoders

    assert decoders.decode(df, registry.get("decoder", "shout")()).first().payload == "ABC"
