"""Queries of decoders, splitters, encoders and anomaly tests, with their DuckDB SQL.

Decoders read lines that are written from the events' columns, so the SQL is
the columns themselves; encoders are the other way about.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import message as M
from ..functions import text as X
from ..operators import anomaly, decoders, encoders, series, splitters
from . import tables
from .queries import _K, _TICK, query


def _lines(spark, sf_dir, line, keep=("event_id",)):
    """Events as messages whose payload is a line made of their columns; ts, s (seconds), k, uid and v are at hand."""
    df = tables.table(spark, sf_dir, "events").withColumns({"k": F.get_json_object("props", "$.k").cast("bigint"), "uid": F.col("user_id").cast("string"), "s": F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"), "v": F.format_string("%.2f", "value")})
    return M.messages(df, extra=list(keep), payload=line)


def _at(pattern):
    return F.date_format("ts", pattern)


def _number(name):
    return M.number(name).alias(name)


@query(f"SELECT event_id, {_K}::DOUBLE AS k FROM events")
def decode_json_props(spark, sf_dir):
    df = tables.events(spark, sf_dir)
    return decoders.decode(df, decoders.json(), keep=["event_id"]).select("event_id", _number("k"))


@query("""SELECT event_id, event_type AS type, 'host-' || user_id AS hostname, printf('%.2f', value) AS v, CASE event_type WHEN 'error' THEN 3 ELSE 6 END AS severity, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS timestamp FROM events""")
def decode_regex(spark, sf_dir):
    line = F.concat_ws(" ", _at("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.when(F.col("event_type") == "error", F.lit("BAD")).otherwise(F.lit("GOOD")), F.concat(F.lit("host-"), F.col("uid")), "event_type", "v")
    column = decoders.payload_regex(r"^(?P<Timestamp>\S+) (?P<Severity>\w+) (?P<host>\S+) (?P<kind>\w+) (?P<v>[0-9.]+)$", {"Type": "%kind%", "Hostname": "%host%", "v": "%v%"}, layout="RFC3339", severities={"BAD": 3, "GOOD": 6})
    return decoders.decode(_lines(spark, sf_dir, line), column, keep=["event_id"]).select("event_id", "type", "hostname", M.text("v").alias("v"), "severity", "timestamp")


@query(f"SELECT event_id, CASE WHEN {_K} >= 50 THEN 'large' WHEN {_K} >= 20 THEN 'middle' ELSE 'unread' END AS type FROM events")
def decode_first_wins(spark, sf_dir):
    tries = [decoders.payload_regex(r'"k": ([5-9]\d)', {"Type": "large"}), decoders.payload_regex(r'"k": (100)', {"Type": "large"}), decoders.payload_regex(r'"k": ([2-4]\d)', {"Type": "middle"})]
    read = decoders.decode(tables.events(spark, sf_dir), decoders.first_wins(*tries), keep=["event_id"])
    return read.select("event_id", F.when(F.col("decode_error").isNull(), F.col("type")).otherwise(F.lit("unread")).alias("type"))


@query(f"SELECT event_id, CASE WHEN {_K} >= 10 THEN 'two' ELSE event_type END AS type, CASE WHEN {_K} % 10 = 5 THEN 'five' ELSE 'events' END AS logger, NOT ({_K} >= 10 OR {_K} % 10 = 5) AS failed FROM events")
def decode_all(spark, sf_dir):
    steps = [lambda: decoders.payload_regex(r'"k": (\d\d)', {"Type": "two", "Payload": "%1%}"}), lambda: decoders.payload_regex(r"([0-9]*5)\}", {"Logger": "five"})]
    return decoders.all_of(tables.events(spark, sf_dir), steps, keep=["event_id"]).select("event_id", "type", "logger", F.col("decode_error").isNotNull().alias("failed"))


@query("SELECT event_id, event_type || ' by host-' || user_id || ' <nobody>' AS made FROM events")
def template_interpolate(spark, sf_dir):
    return tables.events(spark, sf_dir).select("event_id", X.template("%type% by %host% %nobody%", {"type": F.col("type"), "host": F.col("hostname")}).alias("made"))


@query(f"SELECT event_id, 'events-' || event_type || '-' || strftime(ts, '%Y.%m.%d') || '-' || {_K} || '-%{{none}}' AS made FROM events")
def message_interpolate(spark, sf_dir):
    return tables.events(spark, sf_dir).select("event_id", X.interpolate("%{Logger}-%{Type}-%{%Y.%m.%d}-%{k}-%{none}").alias("made"))


@query(
    f"""WITH l AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, {_K} AS k, value FROM events)
SELECT event_id, t AS timestamp, true AS is_main, ['a', 'b', 'c'] AS names, [k::DOUBLE, round(value, 2), 7.0::DOUBLE] AS values FROM l
UNION ALL SELECT event_id, t + 60, false, ['c'], [7.0::DOUBLE] FROM l"""
)
def decode_stats_to_fields(spark, sf_dir):
    line = F.concat(F.lit("a "), F.col("k").cast("string"), F.lit(" "), F.col("s").cast("string"), F.lit("\nb "), "v", F.lit(" "), F.col("s").cast("string"), F.lit("\nc 7 "), (F.col("s") + 60).cast("string"), F.lit("\n"))
    return decoders.stats_to_fields(_lines(spark, sf_dir, line), "event_id")


_ACCESS_SQL = f"""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS timestamp, '10.0.' || (user_id % 250) || '.' || {_K} AS remote_addr, 'GET /' || event_type || ' HTTP/1.1' AS request,
(200 + {_K})::DOUBLE AS status, user_id::DOUBLE AS body_bytes_sent, CASE WHEN {_K} % 2 = 0 THEN 'Firefox' ELSE 'Chrome' END AS user_agent_browser, 26::DOUBLE AS user_agent_version, 'Linux' AS user_agent_os FROM events"""


def _access(spark, sf_dir, column):
    agent = F.concat(F.lit("Agent/5.0 (X11; Linux x86_64) "), F.when(F.col("k") % 2 == 0, F.lit("Gecko/20100101 Firefox/26.0")).otherwise(F.lit("AppleWebKit/537 Chrome/26.0 Safari/537")))
    line = F.concat(F.lit("10.0."), (F.col("user_id") % 250).cast("string"), F.lit("."), F.col("k").cast("string"), F.lit(" - - ["), _at("dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), "event_type", F.lit(' HTTP/1.1" '), (F.col("k") + 200).cast("string"), F.lit(" "), "uid", F.lit(' "-" "'), agent, F.lit('"'))
    read = decoders.decode(_lines(spark, sf_dir, line), column, keep=["event_id"])
    return read.select("event_id", "timestamp", M.text("remote_addr").alias("remote_addr"), M.text("request").alias("request"), _number("status"), _number("body_bytes_sent"), M.text("user_agent_browser").alias("user_agent_browser"), _number("user_agent_version"), M.text("user_agent_os").alias("user_agent_os"))


@query(_ACCESS_SQL)
def decode_nginx_access(spark, sf_dir):
    return _access(spark, sf_dir, decoders.nginx_access('$remote_addr - $remote_user [$time_local] "$request" $status $body_bytes_sent "$http_referer" "$http_user_agent"', user_agent_transform=True))


@query(_ACCESS_SQL)
def decode_apache_access(spark, sf_dir):
    return _access(spark, sf_dir, decoders.apache_access('%h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-Agent}i"', user_agent_transform=True))


@query(f"SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS timestamp, 3 AS severity, CAST(user_id AS INTEGER) AS pid, {_K}::DOUBLE AS connection, event_type || ' failed' AS payload FROM events")
def decode_nginx_error(spark, sf_dir):
    line = F.concat(_at("yyyy/MM/dd HH:mm:ss"), F.lit(" [error] "), "uid", F.lit("#0: *"), F.col("k").cast("string"), F.lit(" "), "event_type", F.lit(" failed"))
    return decoders.decode(_lines(spark, sf_dir, line), decoders.nginx_error(), keep=["event_id"]).select("event_id", "timestamp", "severity", "pid", _number("connection"), "payload")


@query(f"SELECT event_id, {_K}::DOUBLE AS connections, user_id::DOUBLE AS requests, {_K}::DOUBLE + 1 AS waiting FROM events")
def decode_nginx_stub_status(spark, sf_dir):
    k = F.col("k").cast("string")
    line = F.concat(F.lit("Active connections: "), k, F.lit(" \nserver accepts handled requests\n 5 6 "), "uid", F.lit(" \nReading: 1 Writing: 2 Waiting: "), (F.col("k") + 1).cast("string"), F.lit(" \n"))
    return decoders.decode(_lines(spark, sf_dir, line), decoders.nginx_stub_status(), keep=["event_id"]).select("event_id", *[_number(n) for n in ("connections", "requests", "waiting")])


@query(f"SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS timestamp, CAST({_K} % 8 AS INTEGER) AS severity, ({_K} // 8)::DOUBLE AS syslogfacility, 'host-' || user_id AS hostname, CAST(user_id AS INTEGER) AS pid, event_type AS programname, props AS payload FROM events")
def decode_rsyslog(spark, sf_dir):
    line = F.concat(F.col("k").cast("string"), F.lit(" "), _at("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z host-"), "uid", F.lit(" "), "event_type", F.lit("["), "uid", F.lit("]: "), "props", F.lit("\n"))
    column = decoders.rsyslog("%pri% %TIMESTAMP:::date-rfc3339% %HOSTNAME% %syslogtag%%msg:::sp-if-no-1st-sp%%msg:::drop-last-lf%\n")
    return decoders.decode(_lines(spark, sf_dir, line), column, keep=["event_id"]).select("event_id", "timestamp", "severity", _number("syslogfacility"), "hostname", "pid", M.text("programname").alias("programname"), "payload")


@query(f"SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS timestamp, CAST({_K} % 8 AS INTEGER) AS severity, event_type AS hostname, '1.1' AS env_version, user_id::DOUBLE AS uid FROM events")
def decode_graylog(spark, sf_dir):
    line = F.to_json(F.struct(F.col("s").alias("timestamp"), F.lit("1.1").alias("version"), (F.col("k") % 8).alias("level"), F.col("event_type").alias("host"), F.col("user_id").alias("uid")))
    return decoders.decode(_lines(spark, sf_dir, line), decoders.graylog(), keep=["event_id"]).select("event_id", "timestamp", "severity", "hostname", "env_version", _number("uid"))


_SLOW_SQL = f"""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS timestamp, round(value, 2) AS query_time, {_K}::DOUBLE AS rows_sent,
'SELECT ' || left(event_type || ';', 5) || CASE WHEN length(event_type) + 1 > 5 THEN '...' ELSE '' END AS payload FROM events"""


def _slow(spark, sf_dir, mariadb):
    thread = F.lit("# Thread_id: 9  Schema: test  QC_hit: No\n" if mariadb else "")
    line = F.concat(F.lit("# User@Host: u[u] @  [127.0.0.1]\n"), thread, F.lit("# Query_time: "), "v", F.lit("  Lock_time: 0.000050 Rows_sent: "), F.col("k").cast("string"), F.lit("  Rows_examined: 9\nuse w;\nSET timestamp="), F.col("s").cast("string"), F.lit(";\nSELECT "), "event_type", F.lit(";"))
    read = decoders.decode(_lines(spark, sf_dir, line), decoders.slow_query(truncate_sql=12, mariadb=mariadb), keep=["event_id"])
    return read.select("event_id", "timestamp", M.number("Query_time").alias("query_time"), M.number("Rows_sent").alias("rows_sent"), "payload")


@query(_SLOW_SQL)
def decode_mysql_slow_query(spark, sf_dir):
    return _slow(spark, sf_dir, False)


@query(_SLOW_SQL)
def decode_mariadb_slow_query(spark, sf_dir):
    return _slow(spark, sf_dir, True)


@query(f"SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 AS timestamp, event_type AS query_name, 'example.com' AS query_domain, CASE WHEN {_K} % 2 = 0 THEN 'A' ELSE 'MX' END AS record_type, '10.0.0.' || {_K} AS client FROM events")
def decode_bind_query_log(spark, sf_dir):
    name = F.concat("event_type", F.lit(".example.com"))
    line = F.concat(_at("dd-MMM-yyyy HH:mm:ss"), F.lit(".246 client 10.0.0."), F.col("k").cast("string"), F.lit("#41242 ("), name, F.lit("): query: "), name, F.lit(" IN "), F.when(F.col("k") % 2 == 0, F.lit("A")).otherwise(F.lit("MX")), F.lit(" +E (10.0.1.71)"))
    got = {"QueryName": "query_name", "QueryDomain": "query_domain", "RecordType": "record_type", "ClientIP": "client"}
    return decoders.decode(_lines(spark, sf_dir, line), decoders.bind_query(), keep=["event_id"]).select("event_id", "timestamp", *[M.text(n).alias(a) for n, a in got.items()])


@query(f"SELECT event_id, round(value, 2) AS one, {_K}::DOUBLE AS processes FROM events")
def decode_loadavg(spark, sf_dir):
    line = F.concat("v", F.lit(" 0.01 0.05 "), F.col("k").cast("string"), F.lit("/153 660\n"))
    return decoders.decode(_lines(spark, sf_dir, line), decoders.load_average(), keep=["event_id"]).select("event_id", M.number("1MinAvg").alias("one"), M.number("NumProcesses").alias("processes"))


@query(f"SELECT event_id, user_id::DOUBLE AS reads, {_K}::DOUBLE AS writes, 11::DOUBLE AS weighted FROM events")
def decode_diskstats(spark, sf_dir):
    line = F.concat(F.lit("  "), F.lpad("uid", 8, " "), F.lit(" 2 3 4 "), F.col("k").cast("string"), F.lit("  6 7 8 9 10 11\n"))
    return decoders.decode(_lines(spark, sf_dir, line), decoders.disk_stats(), keep=["event_id"]).select("event_id", M.number("ReadsCompleted").alias("reads"), M.number("WritesCompleted").alias("writes"), M.number("WeightedTimeDoingIO").alias("weighted"))


@query(f"SELECT event_id, user_id::DOUBLE AS total, {_K}::DOUBLE AS pages FROM events")
def decode_memstats(spark, sf_dir):
    line = F.concat(F.lit("MemTotal:    "), "uid", F.lit(" kB\nHugePages_Free:   "), F.col("k").cast("string"), F.lit("\n"))
    return decoders.decode(_lines(spark, sf_dir, line), decoders.memory_stats(), keep=["event_id"]).select("event_id", M.number("MemTotal").alias("total"), M.number("HugePages_Free").alias("pages"))


@query(f"SELECT event_id, user_id AS a, {_K} AS b FROM events")
def decode_netstat(spark, sf_dir):
    line = F.concat(F.lit("Tcp: A Other\nTcp: "), "uid", F.lit(" 5\nUdp: B\nUdp: "), F.col("k").cast("string"), F.lit("\n"))
    return decoders.decode(_lines(spark, sf_dir, line), decoders.net_stats(), keep=["event_id"]).select("event_id", M.value("Tcp_A", "integer").alias("a"), M.value("Udp_B", "integer").alias("b"))


@query(f"SELECT event_id, 'eth0' AS device, user_id AS received, {_K} AS sent FROM events UNION ALL SELECT event_id, 'lo', {_K}, 7 FROM events")
def decode_netdev(spark, sf_dir):
    k = F.col("k").cast("string")
    line = F.concat(F.lit("Inter-|   Receive  |  Transmit\n face |bytes packets|bytes packets\n  eth0: "), "uid", F.lit(" 2 "), k, F.lit(" 4\n    lo: "), k, F.lit(" 2 7 4\n"))
    return decoders.net_devices(_lines(spark, sf_dir, line), keep=["event_id"]).select("event_id", M.text("netdevice").alias("device"), M.value("receive_bytes", "integer").alias("received"), M.value("transmit_bytes", "integer").alias("sent"))


@query(f"SELECT event_id, {_K}::DOUBLE AS idle, user_id::DOUBLE AS ctxt FROM events")
def decode_procstat(spark, sf_dir):
    line = F.concat(F.lit("cpu  1 2 3 "), F.col("k").cast("string"), F.lit("\nctxt "), "uid", F.lit("\n"))
    return decoders.decode(_lines(spark, sf_dir, line), decoders.proc_stats(), keep=["event_id"]).select("event_id", M.value("cpu", "double", 0, 3).alias("idle"), M.number("ctxt").alias("ctxt"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def page_hosts(spark, sf_dir):
    return tables.pages(spark, sf_dir).select("page_id", F.col("logger").alias("host"))


@query(f"SELECT event_id, CASE WHEN {_K} < 50 THEN 'low' WHEN {_K} < 90 THEN 'high' END AS place FROM events")
def geo_ip_lookup(spark, sf_dir):
    base = 10 * 16777216
    ranges = spark.createDataFrame([(base, base + 49, "low"), (base + 50, base + 89, "high")], "low bigint, high bigint, place string")
    df = tables.events(spark, sf_dir).withColumn("fields", F.array_append("fields", M.field("remote_addr", F.concat(F.lit("10.0.0."), M.text("k")), "string")))
    found = decoders.geo_ip(df, ranges)
    return found.select("event_id", F.get_json_object(M.value("geoip", "bytes").cast("string"), "$.place").alias("place"))


# Splitters


@query("SELECT doc_id, i - 1 AS seq, md5(parts[i] || chr(10)) AS record FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))")
def split_token(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return splitters.token(docs, "text").select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.md5("record").alias("record"))


@query("SELECT doc_id, i - 1 AS seq, md5(parts[i]) AS record FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[.!?]+ ') AS parts FROM documents WHERE text IS NOT NULL))")
def split_regex(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return splitters.regex(docs, "text", r"[.!?]+ ", deliver_incomplete_final=True).select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.md5("record").alias("record"))


@query(
    """WITH l AS (SELECT doc_id, i, parts[i] AS line FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts) - 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
m AS (SELECT *, regexp_matches(line, '^[A-M]') AS grp FROM l), s AS (SELECT *, CASE WHEN NOT grp OR NOT coalesce(lag(grp) OVER (PARTITION BY doc_id ORDER BY i), false) THEN 1 ELSE 0 END AS st FROM m),
g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s), k AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, g ORDER BY i) - 1) // 99 AS k FROM g),
r AS (SELECT doc_id, min(i) AS pos, md5(string_agg(line, chr(10) ORDER BY i) || chr(10)) AS record FROM k GROUP BY doc_id, g, k)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq, record FROM r"""
)
def group_lines(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return splitters.pattern_groups(docs, ["doc_id"], "text", "^[A-M]").select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.md5("record").alias("record"))


# Encoders


@query("SELECT event_id, strftime(ts, '[%Y/%b/%d:%H:%M:%S +0000] ') || props || chr(10) AS line FROM events")
def encode_payload(spark, sf_dir):
    return tables.events(spark, sf_dir).select("event_id", encoders.payload(prefix_ts=True).alias("line"))


#: DuckDB: a double in its shortest form.
_SHORT = "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"


@query(f"SELECT event_id, name || ' ' || v || ' ' || CAST(floor(epoch(ts)) AS BIGINT) AS line FROM (SELECT event_id, ts, 'm.user_id' AS name, CAST(user_id AS VARCHAR) AS v FROM events UNION ALL SELECT event_id, ts, 'm.k', CAST({_K} AS VARCHAR) FROM events UNION ALL SELECT event_id, ts, 'm.value', {_SHORT} FROM events) WHERE regexp_full_match(v, '[0-9.]+')")
def encode_carbon_line(spark, sf_dir):
    return encoders.carbon_lines(tables.events(spark, sf_dir), ["event_id"], prefix="m.")


@query(f"SELECT event_id, name || ',Logger=events,Type=' || event_type || ',Hostname=host-' || user_id || ' value=' || printf('%.6f', v::DOUBLE) || ' ' || CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS line FROM (SELECT *, 'user_id' AS name, user_id::DOUBLE AS v FROM events UNION ALL SELECT *, 'k', {_K} FROM events UNION ALL SELECT *, 'value', value FROM events) WHERE v IS NOT NULL")
def encode_influx_line(spark, sf_dir):
    return encoders.influx_lines(tables.events(spark, sf_dir), ["event_id"], tags=["Logger", "Type", "Hostname"])


@query(f"""SELECT event_id, '{{"index":{{"_index":"messages-' || strftime(ts, '%Y.%m.%d') || '","_type":"message"}}}}' || chr(10) || '{{"Type":"' || event_type || '","Payload":"' || replace(props, '"', '\\u0022') || '","Hostname":"host-' || user_id || '","user_id":' || user_id || ',"value":' || {_SHORT} || ',"k":' || {_K} || '}}' || chr(10) AS line FROM events""")
def encode_es_json(spark, sf_dir):
    return tables.events(spark, sf_dir).select("event_id", encoders.es_json(fields=["Type", "Payload", "Hostname", "DynamicFields"]).alias("line"))


@query(f"""SELECT event_id, '[{{"points":[[' || CAST(floor(epoch_us(ts) / 1000) AS BIGINT) || ',"' || event_type || '",' || user_id || ',' || {_SHORT} || ',' || {_K} || ']],"name":"s-' || event_type || '","columns":["time","Type","user_id","value","k"]}}]' AS line FROM events""")
def encode_influx_json(spark, sf_dir):
    return tables.events(spark, sf_dir).select("event_id", encoders.influx_json(series="s-%{Type}", skip=["Payload", "Hostname", "Pid", "Logger", "Severity", "EnvVersion"]).alias("line"))


@query(f"""SELECT event_id, chr(10) || ':Timestamp: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || regexp_replace(strftime(ts, '.%f'), '\\.?0+$', '') || ' +0000 UTC' || chr(10) || ':Type: ' || event_type || chr(10) || ':Hostname: host-' || user_id || chr(10) || ':Pid: 0' || chr(10) || ':Uuid: '
|| regexp_replace(md5('events' || chr(31) || event_id), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || chr(10) || ':Logger: events' || chr(10) || ':Payload: ' || props || chr(10) || ':EnvVersion: ' || chr(10) || ':Severity: ' || CASE event_type WHEN 'error' THEN 3 ELSE 6 END || chr(10)
|| ':Fields:' || chr(10) || '    | name:"user_id" type:integer value:' || user_id || chr(10) || '    | name:"value" type:double value:' || {_SHORT} || chr(10) || '    | name:"k" type:integer value:' || CAST(json_extract_string(props, '$.k') AS BIGINT) || chr(10) || chr(10) AS block FROM events""")
def encode_rst(spark, sf_dir):
    return tables.events(spark, sf_dir).select("event_id", encoders.rst().alias("block"))


@query("SELECT event_id, 'Timestamp: ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'Hostname: host-' || user_id || chr(10) || 'Plugin: events' || chr(10) || 'Alert: ' || props || chr(10) AS block FROM events WHERE event_type = 'error'")
def encode_alert(spark, sf_dir):
    return tables.events(spark, sf_dir).where("type = 'error'").select("event_id", encoders.alert().alias("block"))


# Anomalies


def _hourly(spark, sf_dir):
    made = series.aggregate(tables.events(spark, sf_dir), {"k": M.number("k")}, seconds=3600, keys=["type"])
    return made.select("type", "bucket_start", "value")


def _with_gaps(table: str, seconds: int, reach: int, now: int) -> str:
    """Common tables that end in `filled`: the series and the empty buckets after each that is followed by none."""
    return f"""src AS (SELECT * FROM {table}),
nxt AS (SELECT *, least(coalesce(lead(bucket_start) OVER (PARTITION BY type ORDER BY bucket_start) - {seconds}, {now}), bucket_start + {reach} * {seconds}) AS upto FROM src),
filled AS (SELECT type, bucket_start, value FROM src UNION ALL SELECT type, unnest(generate_series(bucket_start + {seconds}, upto, {seconds})), NULL FROM nxt)"""


_HOURLY = f"(SELECT event_type AS type, {_TICK.format(3600)} AS bucket_start, sum({_K})::DOUBLE AS value FROM events GROUP BY 1, 2)"


@query(
    f"""WITH {_with_gaps(_HOURLY, 3600, 24, 1706745600)},
w AS (SELECT type, bucket_start, avg(value) OVER c AS cur, avg(value) OVER p AS prev, stddev_pop(value) OVER h AS sd, count(value) OVER c AS n, count(value) OVER p AS m FROM filled
WINDOW c AS (PARTITION BY type ORDER BY bucket_start RANGE BETWEEN 43200 PRECEDING AND 3600 PRECEDING), p AS (PARTITION BY type ORDER BY bucket_start RANGE BETWEEN 86400 PRECEDING AND 46800 PRECEDING),
h AS (PARTITION BY type ORDER BY bucket_start RANGE BETWEEN 259200 PRECEDING AND 90000 PRECEDING))
SELECT type, bucket_start, CASE WHEN m > 0 AND n = 0 THEN 'k - algorithm: roc col: 1 msg: no new data' WHEN abs(cur - prev) > sd * 0.5 THEN 'k - algorithm: roc col: 1 msg: detected anomaly, standard deviation exceeds 0.5' END AS msg FROM w"""
)
def roc_alerts(spark, sf_dir):
    test = anomaly.parse_config('roc("k", 1, 12, 48, 0.5, true, false)')[0]
    return anomaly.roc(_hourly(spark, sf_dir), test, seconds=3600, rows=1440, keys=["type"], now=1706745600).select("type", "bucket_start", "msg")


_DAILY = f"(SELECT 'host-' || user_id AS type, {_TICK.format(86400)} AS bucket_start, sum({_K})::DOUBLE AS value FROM events GROUP BY 1, 2)"


@query(
    f"""WITH {_with_gaps(_DAILY, 86400, 4, 1707264000)},
w AS (SELECT type, bucket_start, avg(value) OVER c AS cur, avg(value) OVER p AS prev, stddev_pop(value) OVER h AS sd, count(value) OVER c AS n, count(value) OVER p AS m FROM filled
WINDOW c AS (PARTITION BY type ORDER BY bucket_start RANGE BETWEEN 172800 PRECEDING AND 86400 PRECEDING), p AS (PARTITION BY type ORDER BY bucket_start RANGE BETWEEN 345600 PRECEDING AND 259200 PRECEDING),
h AS (PARTITION BY type ORDER BY bucket_start RANGE BETWEEN 1036800 PRECEDING AND 432000 PRECEDING))
SELECT type AS hostname, bucket_start, CASE WHEN m > 0 AND n = 0 THEN 'h - algorithm: roc col: 1 msg: no new data' WHEN m = 0 AND n > 0 THEN 'h - algorithm: roc col: 1 msg: unexpected data'
WHEN abs(cur - prev) > sd * 2 THEN 'h - algorithm: roc col: 1 msg: detected anomaly, standard deviation exceeds 2' END AS msg FROM w"""
)
def roc_data_loss(spark, sf_dir):
    """Hosts that fall silent, or begin to speak, on days that have no rows for them."""
    made = series.aggregate(tables.events(spark, sf_dir), {"k": M.number("k")}, seconds=86400, keys=["hostname"])
    test = anomaly.parse_config('roc("h", 1, 2, 8, 2, true, true)')[0]
    return anomaly.roc(made, test, seconds=86400, rows=60, keys=["hostname"], now=1707264000).select("hostname", "bucket_start", "msg")


@query()
def mann_whitney_alerts(spark, sf_dir):
    test = anomaly.parse_config('mww_nonparametric("k", 1, 24, 20, 0.51)')[0]
    return anomaly.mann_whitney_alerts(_hourly(spark, sf_dir), test, seconds=3600, rows=600, now=1706572800, keys=["type"])


@query(
    """WITH RECURSIVE e AS (SELECT 'host-' || user_id AS hostname, epoch_us(ts) * 1000 AS timestamp, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events WHERE event_type = 'error'),
r AS (SELECT *, timestamp AS last FROM e WHERE rn = 1 UNION ALL SELECT e.hostname, e.timestamp, e.rn, CASE WHEN e.timestamp - r.last >= 86400000000000 THEN e.timestamp ELSE r.last END FROM r JOIN e ON e.hostname = r.hostname AND e.rn = r.rn + 1)
SELECT hostname, timestamp FROM r WHERE timestamp = last"""
)
def alerts_throttled(spark, sf_dir):
    errors = tables.events(spark, sf_dir).where("type = 'error'")
    return anomaly.throttled(errors, seconds=86400, keys=["hostname"]).select("hostname", "timestamp")
