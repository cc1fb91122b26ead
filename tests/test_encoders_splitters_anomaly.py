"""Encoders, splitters and anomaly tests on inputs whose results are known."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.functions import text as X
from weirline.operators import anomaly as A
from weirline.operators import encoders as E
from weirline.operators import items
from weirline.operators import series as S
from weirline.operators import splitters as P


@pytest.fixture(scope="module")
def message(spark):
    """A reading of an invented weather station."""
    f = M.field
    many = lambda *v: F.array(*[F.lit(x) for x in v])
    binary = F.array(F.lit("raw").cast("binary"), F.lit("rain").cast("binary"))
    bag = F.array(f("gusts", many(31, 44), "integer", is_array=True), f("note", many("calm", "windy"), "string", is_array=True), f("note", many("dry", "wet"), "string", is_array=True), f("blob", binary, "bytes", is_array=True))
    uuid = F.unhex(F.lit("0f1e2d3c4b5a69788796a5b4c3d2e1f0"))
    return M.messages(spark.range(1), extra=["id"], uuid=uuid, type=F.lit("reading"), pid=F.lit(77), severity=F.lit(5), hostname=F.lit("mast-3"), timestamp=F.lit(86_399 * 10**9), logger=F.lit("weather"), payload=F.lit("north by north-west"), fields=bag)


def test_influx_lines(message):
    """Names carry the place of a repeated field and of a value; numbers are floats, bytes and text quoted."""
    tags = "Logger=weather,Type=reading,Severity=5,Hostname=mast-3"
    expected = {"gusts": "31.000000", "gusts_vidx_1": "44.000000", "note": '"calm"', "note_vidx_1": '"windy"', "note_fidx_1": '"dry"', "note_fidx_1_vidx_1": '"wet"', "blob": '"raw"', "blob_vidx_1": '"rain"'}
    lines = lambda **k: {r.line for r in E.influx_lines(message, ["id"], **k).collect()}
    assert lines() == {f"{n},{tags} value={v} 86399000" for n, v in expected.items()}
    assert lines(skip=["note"]) == {f"{n},{tags} value={v} 86399000" for n, v in expected.items() if not n.startswith("note")}
    assert lines(precision="s", decimals=1, tags=["Type"], skip=["note", "blob"]) == {"gusts,Type=reading value=31.0 86399", "gusts_vidx_1,Type=reading value=44.0 86399"}


def test_influx_json(message):
    made = json.loads(message.select(E.influx_json(series="%{Type}.%{Pid}.%{note}.%{gusts}")).first()[0])
    assert made == [{"points": [[86399000, "reading", "north by north-west", "mast-3", 77, "weather", 5, "", [31, 44], ["calm", "windy"], ["dry", "wet"]]], "name": "reading.77.calm.31", "columns": ["time", "Type", "Payload", "Hostname", "Pid", "Logger", "Severity", "EnvVersion", "gusts", "note", "note2"]}]
    few = json.loads(message.select(E.influx_json(skip=["Payload", "Logger", "note"])).first()[0])
    assert few == [{"points": [[86399000, "reading", "mast-3", 77, 5, "", [31, 44]]], "name": "series", "columns": ["time", "Type", "Hostname", "Pid", "Severity", "EnvVersion", "gusts"]}]


def test_carbon(spark, message):
    assert {r.line for r in E.carbon_lines(message, []).collect()} == {"gusts 31 86399", "gusts_vidx_1 44 86399"}
    df = M.messages(spark.range(1), fields=F.array(M.field("below.zero", F.lit(-4.5), "double"), M.field("above zero", F.lit(6.25), "double")))
    assert [r.line for r in E.carbon_lines(df, []).collect()] == ["above_zero 6.25 0"]


def test_documents(message):
    head, body = message.select(E.es_json(index="W-%{%Y.%m.%d}", id_="%{Pid}")).first()[0].rstrip("\n").split("\n")
    assert json.loads(head) == {"index": {"_index": "w-1970.01.01", "_type": "message", "_id": "77"}}
    body = json.loads(body)
    assert (body["Uuid"], body["Timestamp"], body["Pid"], body["gusts"]) == ("0f1e2d3c-4b5a-6978-8796-a5b4c3d2e1f0", "1970-01-01T23:59:59", 77, [31, 44])
    assert json.loads(message.select(E.es_json(fields=["DynamicFields", "Type"], dynamic_fields=["gusts"])).first()[0].split("\n")[1]) == {"gusts": [31, 44], "Type": "reading"}
    stash = json.loads(message.select(E.es_logstash_v0()).first()[0].split("\n")[1])
    assert (stash["@type"], stash["@message"], stash["@fields"]["blob"]) == ("message", "north by north-west", [base64.b64encode(x).decode() for x in (b"raw", b"rain")])
    own = message.withColumn("payload", F.lit('{"wind":7}\n\n'))
    assert own.select(E.es_payload(index="days-%{%d}", type_name="%{Type}")).first()[0] == '{"index":{"_index":"days-01","_type":"reading"}}\n{"wind":7}\n'


def test_text_encoders(spark, message):
    assert spark.range(1).select(X.json_escaped(F.lit('say "no"')), X.json_escaped(F.lit("two\nlines\\"))).first()[:] == ("say \\u0022no\\u0022", "two\\u000alines\\u005c")
    assert message.select(E.payload(prefix_ts=True)).first()[0] == "[1970/Jan/01:23:59:59 +0000] north by north-west\n"
    block = message.select(E.rst()).first()[0]
    assert block.startswith("\n:Timestamp: 1970-01-01 23:59:59 +0000 UTC\n:Type: reading\n") and '    | name:"note" type:string value:["dry","wet"]\n' in block and "type:bytes value:[cmF3,cmFpbg==]" in block
    assert message.select(E.alert()).first()[0] == "Timestamp: 1970-01-01T23:59:59Z\nHostname: mast-3\nPlugin: weather\nAlert: north by north-west\n"
    assert message.select(X.template("%wind% of %force%", {"wind": F.lit("S")})).first()[0] == "S of <force>"
    assert message.select(X.interpolate("%{Type}/%{nothing}/%{%Y}/%{gusts}")).first()[0] == "reading/%{nothing}/1970/31"


def test_statistics_as_series(spark):
    """Each numeric field but the time is a series of one point, its time in milliseconds."""
    bag = F.array(M.field("timestamp", F.lit(12), "integer"), M.field("a.count", F.lit(3), "integer"), M.field("a.rate", F.lit(0.5), "double"), M.field("word", F.lit("x"), "string"))
    made = json.loads(M.messages(spark.range(1), fields=bag).select(E.statmetric_influx()).first()[0])
    assert made == [{"points": [[12000, 3]], "name": "a.count", "columns": ["time", "value"]}, {"points": [[12000, 0.5]], "name": "a.rate", "columns": ["time", "value"]}]


def test_batches_of_lines(spark):
    df = spark.createDataFrame([("a" if k % 2 else "b", k) for k in range(7)], "key string, k int")
    got = {(r.key, r.batch): r.payload for r in items.influx_batches(df, F.concat(F.col("k").cast("string"), F.lit("\n")), ["k"], flush_count=2, keys=["key"]).collect()}
    assert got == {("a", 0): "1\n3\n", ("a", 1): "5\n", ("b", 0): "0\n2\n", ("b", 1): "4\n6\n"}


def test_librato(spark):
    rows = [("h", 10 + 5 * k, c, float(k + j)) for k in range(3) for j, c in enumerate("ab")]
    series = spark.createDataFrame(rows, "hostname string, bucket_start bigint, col string, value double")
    got = json.loads(E.librato(series, keys=["hostname"]).first().payload)["gauges"]
    assert got == [{"value": v, "measure_time": t, "name": n, "source": "hostname" and "h"} for t, n, v in ((10, "a", 0), (10, "b", 1), (15, "a", 1), (15, "b", 2))]
    assert json.loads(E.librato(series, keys=["hostname"], sent_until={"h": 10}).first().payload)["gauges"][0]["measure_time"] == 15


def records(df):
    return [r.record for r in df.orderBy("seq").collect()]


def test_splitters(spark):
    df = spark.createDataFrame([("a\nbb\nccc\nrest",)], "t string")
    assert records(P.token(df, "t")) == ["a\n", "bb\n", "ccc\n"]
    assert records(P.token(df, "t", count=2, deliver_incomplete_final=True)) == ["a\nbb\n", "ccc\nrest"]
    assert records(P.token(df, "t", max_record=3)) == ["a\n", "bb\n"]
    assert records(P.token(df, "t", max_record=2, keep_truncated=True)) == ["a\n", "bb", "cc"]
    with pytest.raises(ValueError):
        P.token(df, "t", delimiter="é")
    assert records(P.whole(df, "t")) == ["a\nbb\nccc\nrest"]
    numbered = spark.createDataFrame([("one1two22three",)], "t string")
    assert records(P.regex(numbered, "t", r"\d+")) == ["one", "two"]
    assert records(P.regex(numbered, "t", r"(\d+)", deliver_incomplete_final=True)) == ["one1", "two22", "three"]
    assert records(P.regex(numbered, "t", r"(\d+)", delimiter_eol=False, deliver_incomplete_final=True)) == ["one", "1two", "22three"]
    with pytest.raises(ValueError):
        P.regex(numbered, "t", r"(\d)(\d)")
    trace = spark.createDataFrame([(1, "start\n  at a\n  at b\n  at c\nend\nlast")], "k int, t string")
    assert records(P.pattern_groups(trace, ["k"], "t", r"^\s+at")) == ["start\n", "  at a\n  at b\n  at c\n", "end\n"]
    assert records(P.pattern_groups(trace, ["k"], "t", r"^\s+at", max_lines=2)) == ["start\n", "  at a\n  at b\n", "  at c\n", "end\n"]


def buffer(spark, values):
    return spark.createDataFrame([("s", int(t), float(v)) for t, v in values], "series string, bucket_start bigint, value double")


def test_anomaly_config():
    a, b = A.parse_config('roc("the ""main"" tank", 3, 7, 21, 2.5, false, true) mww("queue", 2, 11, 5, 0.02, increasing)')
    assert (a.name, a.col, a.win, a.hwin, a.sd, a.loss_of_data, a.start_of_data) == ('the "main" tank', 3, 7, 21, 2.5, False, True)
    assert (b.algorithm, b.win, b.nwin, b.trend, b.pvalue) == ("mww", 11, 5, "increasing", 0.02)
    with pytest.raises(ValueError):
        A.parse_config("no such test")


def by_hand(test, values, at):
    """What a rate-of-change test says at a bucket, from its definition."""
    mean = lambda v: sum(v) / len(v) if v else None
    within = lambda a, b: [values[t] for t in range(at - a, at - b + 1) if t in values]
    now, before = within(test.win, 1), within(2 * test.win, test.win + 1)
    history = within(2 * test.win + test.hwin if test.hwin else 10**4, 2 * test.win + 1)
    if test.loss_of_data and before and not now:
        return "no new data"
    if test.start_of_data and now and not before:
        return "unexpected data"
    if not (now and before and history):
        return None
    spread = (sum((v - mean(history)) ** 2 for v in history) / len(history)) ** 0.5
    return f"detected anomaly, standard deviation exceeds {test.sd:g}" if abs(mean(now) - mean(before)) > spread * test.sd else None


@pytest.mark.parametrize("spec", ['roc("tide", 1, 6, 0, 2, false, false)', 'roc("tide", 1, 6, 12, 1.25, true, true)', 'roc("tide", 1, 4, 4, 0.5, true, false)'])
def test_roc(spark, spec):
    """A tide with a step, a silence and an end, at every bucket up to 40 after the last row."""
    (test,) = A.parse_config(spec)
    values = {t: 10 + (t * 7 % 5) / 2 + (8 if 90 <= t < 97 else 0) for t in range(20, 160) if not 110 <= t < 130}
    got = {r.bucket_start: r.msg for r in A.roc(buffer(spark, values.items()), test, seconds=1, rows=300, keys=["series"], now=200).collect()}
    told = {t: m.removeprefix("tide - algorithm: roc col: 1 msg: ") for t, m in got.items() if m}
    expected = {t: m for t in range(20, 201) if (m := by_hand(test, values, t))}
    assert told == {t: m for t, m in expected.items() if t in got} and set(expected) <= set(got)
    assert ("no new data" in told.values()) == test.loss_of_data and any(m.startswith("detected") for m in told.values())


def test_roc_limits(spark):
    with pytest.raises(ValueError):
        A.roc(buffer(spark, [(1, 1)]), A.parse_config('roc("tide", 1, 9, 3, 1, true, false)')[0], seconds=1, rows=100)
    with pytest.raises(ValueError):
        A.roc(buffer(spark, [(1, 1)]), A.parse_config('roc("tide", 1, 34, 0, 1, true, false)')[0], seconds=1, rows=100)


def test_mann_whitney_by_counting():
    """U is the number of pairs of which the first is larger, half for ties."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        x, y = rng.integers(0, 6, 9).astype(float), rng.integers(1, 8, 7).astype(float)
        u, p = A.mann_whitney(x, y)
        assert u == sum((a > b) + (a == b) / 2 for a in x for b in y) and 0 <= p <= 1
    assert A.mann_whitney(np.ones(3), np.ones(4)) is None and A.mann_whitney(np.array([np.nan]), np.ones(4)) is None


def test_mann_whitney(spark):
    """A queue that grows by one a bucket with a wobble: its newest window lies above all before."""
    grows = [(t, 3 * (t // 2) + t % 2) for t in range(1000, 1200)]
    run = lambda spec, rows, now: [r.msg for r in A.mann_whitney_alerts(buffer(spark, rows), A.parse_config(spec)[0], seconds=1, rows=200, now=now, keys=["series"]).collect()]
    say = lambda kind, msg: [f"queue - algorithm: {kind} col: 2 msg: detected anomaly{msg}"]
    assert run('mww("queue", 2, 15, 8, 0.001, increasing)', grows, 1199) == say("mww", ", increasing values")
    assert run('mww("queue", 2, 15, 8, 0.001, decreasing)', grows, 1199) == []
    assert run('mww("queue", 2, 15, 8, 0.001, decreasing)', [(t, -v) for t, v in grows], 1199) == say("mww", ", decreasing values")
    assert run('mww("queue", 2, 15, 8, 0.001, any)', grows, 1199) == say("mww", "")
    # All pairs favour the newest window in six comparisons, and seven divide them: 0.5 + 6 * 0.5 / 7.
    assert run('mww_nonparametric("queue", 2, 15, 8, 0.9)', grows, 1199) == say("mww_nonparametric", ", pstat: 0.928571")
    assert run('mww_nonparametric("queue", 2, 15, 8, 0.95)', grows, 1199) == []
    assert run('mww("queue", 2, 15, 8, 0.001, any)', [(1100, float("nan"))], 1199) == []


def test_alerts(spark):
    df = spark.createDataFrame([("a", int(t * 1e9), str(t)) for t in (0, 100, 3599, 3600, 7000, 7200)] + [("b", 5 * 10**9, "5")], "logger string, timestamp bigint, payload string")
    assert sorted(r.payload for r in A.throttled(df).collect()) == ["0", "3600", "5", "7200"]
    notes = spark.createDataFrame([("s", 100, 1, "old"), ("s", 200, 1, "new")], "series string, bucket_start bigint, col int, text string")
    assert json.loads(A.annotations(notes, now=250, keep_seconds=100).first().annotations) == [{"x": 200000, "col": 1, "shortText": "A", "text": "new"}]


def test_series_text(spark):
    df = M.messages(spark.createDataFrame([(float(c),) for c in (204, 204, 301, 418, 599, 600, 99)], "c double"), extra=["c"])
    made = S.status_classes(df, status=F.col("c"), seconds=1)
    names = [f"HTTP_{k}00" for k in range(1, 6)] + ["HTTP_UNKNOWN"]
    text = S.render(made, {n: ("count", "sum") for n in names}, rows=3, seconds=1).first().payload.split("\n")
    none = "\t".join(["nan"] * 6)
    assert json.loads(text[0])["time"] == 0 and text[1:] == ["nan\t2\t1\t1\t1\t2", none, none, ""]


def test_columns_of_hosts(spark):
    rows = [("a", 0, 1.0), ("a", 60, 2.0), ("b", 60, 3.0), ("b", 120, 4.0), ("c", 180, 5.0), ("a", 60, 1.0)]
    cells = spark.createDataFrame(rows, "hostname string, bucket_start bigint, value double")
    table = {r.bucket_start: (r.a, r.b, r.c) for r in S.by_host(cells).collect()}
    assert table == {0: (1.0, None, None), 60: (3.0, 3.0, None), 120: (None, 4.0, None), 180: (None, None, 5.0)}
    assert S.by_host(cells, expiration=60).columns == ["bucket_start", "b", "c"]
    with pytest.raises(ValueError):
        S.by_host(cells, max_hosts=2)
