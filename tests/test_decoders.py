"""Decoders over lines whose values are known."""

import pytest
from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.functions import text as X
from weirline.operators import decoders as D


def read(spark, payload, column, fields=None):
    df = M.messages(spark.createDataFrame([(payload,)], "p string"), payload=F.col("p"), fields=fields)
    return D.decode(df, column).first()


def values(row):
    """name: first value, or all of them."""
    out = {}
    for f in row.fields:
        v = next(x for x in (f.value_string, f.value_bytes, f.value_integer, f.value_double, f.value_bool) if x is not None)
        out.setdefault(f.name, v[0] if len(v) == 1 else list(v))
    return out


ACCESS = '198.51.100.7 - ann [05/Mar/2021:21:15:09 +0100] "PUT /cart/7 HTTP/1.1" 207 512 "-" "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:88.0) Gecko/20100101 Firefox/88.0"'


@pytest.mark.parametrize(
    "column",
    [
        lambda: D.nginx_access('$remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent "$http_referer" "$http_user_agent"', user_agent_transform=True),
        lambda: D.apache_access('%h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-Agent}i"', user_agent_transform=True),
    ],
)
def test_access(spark, column):
    row = read(spark, ACCESS, column())
    v = values(row)
    assert row.decode_error is None and row.timestamp == 1614975309000000000 and row.severity == 7
    assert (v["remote_addr"], v["user_agent_browser"], v["user_agent_version"], v["user_agent_os"], v["body_bytes_sent"], v["status"]) == ("198.51.100.7", "Firefox", 88.0, "Windows", 512.0, 207.0)
    assert "http_user_agent" not in v
    assert read(spark, "no access line", column()).decode_error == "Failed parsing: payload: no access line"


def test_nginx_others(spark):
    v = values(read(spark, "Active connections: 12 \nserver accepts handled requests\n 700 690 2100 \nReading: 1 Writing: 4 Waiting: 7 \n", D.nginx_stub_status()))
    assert v == {"connections": 12.0, "accepts": 700.0, "handled": 690.0, "requests": 2100.0, "reading": 1.0, "writing": 4.0, "waiting": 7.0}
    row = read(spark, "2021/03/05 21:15:09 [crit] 51#3: *404 no space left", D.nginx_error(tz="Europe/Berlin"))
    assert (row.timestamp, row.severity, row.pid, row.payload, values(row)) == (1614975309000000000, 2, 51, "no space left", {"tid": 3.0, "connection": 404.0})


def test_rsyslog(spark):
    template = "%pri% %TIMESTAMP% %TIMEGENERATED:::date-rfc3339% %HOSTNAME% %syslogtag%%msg:::sp-if-no-1st-sp%%msg:::drop-last-lf%\n"
    row = read(spark, "85 Mar  5 21:15:09 2021-03-05T21:15:10+01:00 mast-3 anemo[91]: gust of 44\n", D.rsyslog(template, type_="weather", tz="Europe/Berlin", year=F.lit(2021)))
    assert (row.timestamp, row.severity, row.hostname, row.pid, row.payload, row.type) == (1614975309000000000, 5, "mast-3", 91, "gust of 44", "weather")
    assert values(row) == {"programname": "anemo", "syslogfacility": 10.0, "timegenerated": 1614975310000000000.0}
    assert read(spark, "no syslog line", D.rsyslog(template)).decode_error


def test_json(spark):
    payload = '{"station":"mast-3","when":"03/05/2021 20:15:09","msg":"gust","level":5,"wind":{"from":{"degrees":"310"}}}'
    row = read(spark, payload, D.json(mapping={"Severity": "level", "Hostname": "station", "Timestamp": "when"}, layout="%m/%d/%Y %H:%M:%S", max_depth=2, separator="-"))
    assert (row.severity, row.hostname, row.timestamp) == (5, "mast-3", 1614975309000000000)
    assert values(row) == {"msg": "gust", "wind-from": '{"degrees":"310"}'}
    assert read(spark, "{bad", D.json()).decode_error and read(spark, "[1]", D.json()).decode_error
    gelf = read(spark, '{"timestamp": 1.5, "version": "1.1", "level": 5, "host": "h", "x": 1, "y": "z"}', D.graylog())
    assert (gelf.timestamp, gelf.env_version, gelf.severity, gelf.hostname, values(gelf)) == (1500000000, "1.1", 5, "h", {"x": 1.0, "y": "z"})
    assert read(spark, '{"timestamp": "1.5"}', D.graylog()).decode_error


def test_slow_query(spark):
    payload = "# User@Host: ann[ann] @  [198.51.100.7]\n# Query_time: 7.25  Lock_time: 0.5 Rows_sent: 12  Rows_examined: 3400\nuse shop;\nSET last_insert_id=5,insert_id=6,timestamp=1614975309;\n# administrator command: Prepare\nSELECT sum(price)\nFROM carts\nGROUP BY day;"
    row = read(spark, payload, D.slow_query(truncate_sql=5))
    assert (row.timestamp, row.payload, row.type) == (1614975309000000000, "SELEC...", "mysql.slow-query")
    assert values(row) == {"Query_time": 7.25, "Lock_time": 0.5, "Rows_sent": 12.0, "Rows_examined": 3400.0}


def test_bind(spark):
    row = read(spark, "05-Mar-2021 20:15:09.500 queries: info: client 198.51.100.7#5353 (mast.weather.example): query: mast.weather.example IN AAAA +E (203.0.113.9)", D.bind_query())
    v = values(row)
    assert row.timestamp == 1614975309000000000
    assert (v["ClientIP"], v["FullQuery"], v["QueryName"], v["QueryDomain"], v["RecordClass"], v["RecordType"], v["QueryFlags"], v["ServerRespondingIP"]) == ("198.51.100.7", "mast.weather.example", "mast", "weather.example", "IN", "AAAA", ["recursion requested", "EDNS used"], "203.0.113.9")


def test_proc(spark):
    path = F.array(M.field("FilePath", F.lit("/proc/x"), "string"), M.field("TickerInterval", F.lit(2.0), "double"))
    assert values(read(spark, "1.25 0.50 0.75 4/97 811\n", D.load_average(), path)) == {"1MinAvg": 1.25, "5MinAvg": 0.5, "15MinAvg": 0.75, "NumProcesses": 4.0, "FilePath": "/proc/x"}
    disk = values(read(spark, "   101    102   103    104    105    106  107     108        109     110    111\n", D.disk_stats(), path))
    assert disk["ReadsCompleted"] == 101.0 and disk["WeightedTimeDoingIO"] == 111.0 and disk["TickerInterval"] == 2.0
    memory = read(spark, "MemTotal:        8000 kB\nMemFree:         1500 kB\nHugePages_Free:        2\n", D.memory_stats(), path)
    assert values(memory) == {"MemTotal": 8000.0, "MemFree": 1500.0, "HugePages_Free": 2.0, "FilePath": "/proc/x"} and memory.fields[0].representation == "kB"
    assert values(read(spark, "cpu  1 2 3\nintr 9 8\nctxt 5\n", D.proc_stats())) == {"cpu": [1.0, 2.0, 3.0], "intr": [9.0, 8.0], "ctxt": 5.0}
    assert values(read(spark, "Tcp: A B\nTcp: 1 2\nUdp: C\nUdp: 3\n", D.net_stats())) == {"Tcp_A": 1, "Tcp_B": 2, "Udp_C": 3}
    for column in (D.load_average(), D.disk_stats(), D.memory_stats(), D.proc_stats(), D.net_stats()):
        assert read(spark, "no figures", column).decode_error == "Failed parsing: payload: no figures"


def test_net_devices(spark):
    text = "Inter-|   Receive                |  Transmit\n face |bytes packets|bytes packets\n  eth0: 1 2 3 4\n    lo: 5 6 7 8\n"
    df = M.messages(spark.createDataFrame([(text,)], "p string"), payload=F.col("p"))
    rows = [values(r) for r in D.net_devices(df).collect()]
    assert rows == [{"receive_bytes": 1, "receive_packets": 2, "transmit_bytes": 3, "transmit_packets": 4, "netdevice": "eth0"}, {"receive_bytes": 5, "receive_packets": 6, "transmit_bytes": 7, "transmit_packets": 8, "netdevice": "lo"}]


def test_stats_to_fields(spark):
    rows = [(1, "a 1 10\nb 2.5 10\n\nc 3 20\n"), (2, "a 1 10\nbad line here now\n"), (3, "a x 10\n")]
    got = {(r.id, r.timestamp): (r.is_main, list(r.names), list(r["values"])) for r in D.stats_to_fields(spark.createDataFrame(rows, "id int, payload string"), "id").collect()}
    assert got == {(1, 10): (True, ["a", "b", "c"], [1.0, 2.5, 3.0]), (1, 20): (False, ["c"], [3.0])}


def test_regex_xml_and_combination(spark):
    by_regex = D.payload_regex(r"^(?P<Timestamp>\d+) (?P<Severity>\w+) (?P<who>\w+)$", {"Type": "t", "Payload": "%who% did %what%", "Who|text": "%who%"}, layout="Epoch", severities={"BAD": 3})
    row = read(spark, "12 BAD bob", by_regex)
    assert (row.timestamp, row.severity, row.type, row.payload, values(row), row.fields[0].representation) == (12000000000, 3, "t", "bob did <what>", {"Who": "bob"}, "text")
    by_xml = D.payload_xml({"v": "/a/b", "none": "/a/c"}, {"Payload": "%v%-%none%"})
    assert read(spark, "<a><b>1</b></a>", by_xml).payload == "1-<none>"
    either = D.first_wins(by_regex, D.scribble({"Type": "other"}))
    assert read(spark, "12 BAD bob", either).type == "t" and read(spark, "zzz", either).type == "other"
    with pytest.raises(ValueError):
        D.payload_regex("no group", {})
    df = M.messages(spark.createDataFrame([("12 BAD bob",), ("zzz",)], "p string"), payload=F.col("p"))
    both = D.all_of(df, [lambda: by_regex, lambda: D.payload_regex(r"^(bob) did", {"Logger": "%1%"})]).orderBy("payload").collect()
    assert [(r.type, r.logger, r.decode_error is None) for r in both] == [("t", "bob", True), ("", "", False)]
    dead = D.dead_letters(D.decode(df, by_regex)).collect()
    assert len(dead) == 1 and values(dead[0])["decode_failure"] is True


def test_times(spark):
    cases = [("1136239445", "Epoch", 1136239445000000000), ("1136239445.123456789123", "Epoch", 1136239445123456789), ("1136239445123.5", "EpochMilli", 1136239445123500000), ("1136239445123456.7", "EpochMicro", 1136239445123456700), ("7", "EpochNano", 7), ("-7", "EpochNano", None), ("x", "Epoch", None), ("2006-01-02T15:04:05Z", "RFC3339", 1136214245000000000), ("Mon Jan 02 15:04:05 -0700 2006", "ANSIC", 1136239445000000000)]
    for text, layout, expected in cases:
        assert spark.range(1).select(X.timestamp(F.lit(text), layout)).first()[0] == expected, (text, layout)
    for text, layout in [("Mar  5 20:15:09", "Stamp"), ("Mar 5 20:15:09", "Stamp"), ("Fri Mar  5 20:15:09 2021", "ANSIC")]:
        assert spark.range(1).select(X.timestamp(F.lit(text), layout, fallback=False, year=F.lit(2021))).first()[0] == 1614975309000000000, (text, layout)


def test_geo_ip(spark):
    ranges = spark.createDataFrame([(167772160, 167772415, "AA"), (167772416, 184549375, "BB")], "low bigint, high bigint, country string")
    df = M.messages(spark.createDataFrame([("10.0.0.9",), ("10.9.0.1",), ("11.0.0.1",), (None,)], "ip string"), extra=["ip"], fields=M.fields(M.field("remote_addr", F.col("ip"), "string")))
    got = {r.ip: M_bytes(r) for r in D.geo_ip(df, ranges).collect()}
    assert got == {"10.0.0.9": '{"country":"AA"}', "10.9.0.1": '{"country":"BB"}', "11.0.0.1": None, None: None}


def M_bytes(row):
    return next((bytes(f.value_bytes[0]).decode() for f in row.fields if f.name == "geoip"), None)
