"""Queries of typed fields, system series, stat lines, further encoders and delivery forms, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import message as M
from ..functions import text as X
from ..functions import wire
from ..operators import decoders, encoders, items, matcher, series, splitters, statsd, system
from ..sources import sinks
from . import tables
from .queries import _K, _TICK, query

_S = "CAST(floor(epoch(ts)) AS BIGINT)"


def _with(spark, sf_dir, *made):
    """Events whose fields are those made of k, user_id and value alone."""
    return tables.events(spark, sf_dir).withColumn("fields", F.array(*made))


def _k(kind="integer"):
    return M.value("k", kind)


# Typed fields in matchers


@query(f"SELECT event_id FROM events WHERE 'b' || {_K} >= 'b5' AND {_K} % 10 <> 7")
def match_bytes(spark, sf_dir):
    """Bytes compare as text, by order and by pattern."""
    raw = F.concat(F.lit("b"), _k().cast("string")).cast("binary")
    return matcher.match(_with(spark, sf_dir, M.field("raw", raw, "bytes")), "Fields[raw] >= 'b5' && Fields[raw] !~ /7$/").select("event_id")


@query(f"SELECT event_id, t AS is_true, t AS unequal, NOT t AS other, word = 'TRUE' AS as_text, false AS as_number FROM (SELECT event_id, {_K} % 3 = 0 AS t, CASE WHEN {_K} % 2 = 0 THEN 'TRUE' ELSE 'true' END AS word FROM events)")
def match_bool(spark, sf_dir):
    """Truth values match TRUE whatever the operator, and against anything else the test is for FALSE; to text TRUE is a word."""
    word = F.when(_k() % 2 == 0, F.lit("TRUE")).otherwise(F.lit("true"))
    df = _with(spark, sf_dir, M.field("third", _k() % 3 == 0, "bool"), M.field("word", word, "string"), M.field("n", _k(), "integer"))
    tests = {"is_true": "Fields[third] == TRUE", "unequal": "Fields[third] != TRUE", "other": "Fields[third] == 'x'", "as_text": "Fields[word] == TRUE", "as_number": "Fields[n] == TRUE"}
    return df.select("event_id", *[matcher.compile(spec).alias(n) for n, spec in tests.items()])


@query(f"SELECT event_id, {_K} % 5 = 0 OR value > 50 AS at_most, {_K} % 5 = 0 OR value <> 7 AS unlike FROM events")
def match_nan(spark, sf_dir):
    """Of the comparisons with NaN only != holds."""
    df = _with(spark, sf_dir, M.field("v", F.when(_k() % 5 == 0, F.lit(float("nan"))).otherwise(M.number("value")), "double"))
    return df.select("event_id", (~matcher.compile("Fields[v] <= 50")).alias("at_most"), matcher.compile("Fields[v] != 7").alias("unlike"))


@query(f"SELECT event_id FROM events WHERE {_K} > 40 AND user_id > 3")
def match_elements(spark, sf_dir):
    """The second field of a name, and the second value of a field."""
    twice = [M.field("n", F.lit(0).cast("bigint"), "integer"), M.field("n", F.array(F.lit(0).cast("bigint"), _k()), "integer", is_array=True), M.field("u", M.value("user_id", "integer"), "integer")]
    return matcher.match(_with(spark, sf_dir, *twice), "Fields[n][1][1] > 40 && Fields[u] > 3 && Fields[n][1][2] == NIL && Fields[n][2] == NIL").select("event_id")


@query(f"SELECT event_id, CASE WHEN {_K} = 0 THEN '0' ELSE {_K} || '' END AS k, 'new' AS type_, [user_id, {_K}] AS users, 1 AS n_left FROM events")
def edit_fields(spark, sf_dir):
    """Elements overwritten and appended, fields added and deleted."""
    df = tables.events(spark, sf_dir)
    df = df.withColumn("fields", M.with_value("user_id", "integer", _k(), element=1))
    df = df.withColumn("fields", M.with_field(M.field("kind", F.lit("old"), "string")))
    df = df.withColumn("fields", M.with_value("kind", "string", F.lit("new"))).withColumn("fields", M.without_field("value"))
    return df.select("event_id", M.text("k").alias("k"), M.text("kind").alias("type_"), M.find("user_id")["value_integer"].alias("users"), (F.size("fields") - 2).alias("n_left"))


@query(f"SELECT event_id, 'events' AS logger, 'host-' || user_id AS hostname, {_K} || '' AS k, '' AS none FROM events")
def message_variables(spark, sf_dir):
    variables = {"logger": "Logger", "hostname": "Hostname", "k": "Fields[k][0][0]", "none": "Fields[k][1]"}
    return tables.events(spark, sf_dir).select("event_id", *[M.variable(v).alias(a) for a, v in variables.items()])


@query(f"SELECT event_id, event_type AS type, epoch_us(ts) * 1000 AS timestamp, props AS payload, user_id, value, {_K} AS k FROM events")
def wire_round_trip(spark, sf_dir):
    """Messages as protobuf and back."""
    packed = tables.events(spark, sf_dir).select("event_id", wire.encoded().alias("data"))
    back = packed.select("event_id", wire.decoded(F.col("data")).alias("m")).select("event_id", "m.*")
    return back.select("event_id", "type", "timestamp", "payload", M.value("user_id", "integer").alias("user_id"), M.value("value", "double").alias("value"), _k().alias("k"))


@query(f"SELECT CAST(event_id AS VARCHAR) AS key, 'ops' AS signer, event_type AS type, {_K} AS k FROM events")
def signed_frames(spark, sf_dir):
    """Frames with a keyed digest, split and verified."""
    framed = tables.events(spark, sf_dir).select("event_id", wire.encoded(framed=True, signer=("ops", 1, b"secret", 1)).alias("data"))
    return wire.split_frames(framed, "data", "event_id", {"ops_1": b"secret"}).select("key", F.regexp_replace("signer", r"_1$", "").alias("signer"), "type", _k().alias("k"))


# Stat lines


@query(f"SELECT event_id, 'host.' || user_id AS bucket, {_K} || '' AS value, CASE {_K} % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'g' ELSE 'ms' END AS modifier, CASE WHEN {_K} % 3 = 0 THEN 0.5 ELSE 1.0 END::FLOAT AS sampling FROM events WHERE {_K} % 7 <> 0")
def statsd_lines(spark, sf_dir):
    """Packets of two lines, of which the unreadable ones are left out."""
    k = _k()
    kind = F.when(k % 3 == 0, "c|@0.5").when(k % 3 == 1, "g").otherwise("ms")
    good = F.concat(F.lit("host."), M.text("user_id"), F.when(k % 7 == 0, F.lit("=")).otherwise(F.lit(":")), k.cast("string"), F.lit("|"), kind)
    df = tables.events(spark, sf_dir).withColumn("payload", F.concat(good, F.lit("\nno stat line\n")))
    return statsd.stats(df, keep=["event_id"])


@query(f"SELECT bucket, count(*) AS n, sum(v)::DOUBLE AS total, modifier FROM (SELECT 'seen_' || event_type AS bucket, 1 AS v, 'c' AS modifier FROM events UNION ALL SELECT 'k_host-' || user_id, {_K}, 'g' FROM events) GROUP BY bucket, modifier")
def statsd_from_messages(spark, sf_dir):
    metrics = {"seen": ("Counter", F.concat(F.lit("seen."), "type"), F.lit(1)), "k": ("Gauge", F.concat(F.lit("k."), "hostname"), _k())}
    made = statsd.from_messages(tables.events(spark, sf_dir), metrics, replace_dot=True)
    return made.groupBy("bucket", "modifier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("double")).alias("total")).select("bucket", "n", "total", "modifier")


# System series


def _last(columns: dict[str, str], keys: str = "'host-' || user_id AS hostname") -> str:
    """SQL: the last of each expression by key and day, in long form."""
    rows = " UNION ALL ".join(f"SELECT {keys}, {_TICK.format(86400)} AS bucket_start, '{n}' AS col, arg_max(({e})::DOUBLE, ts) AS value FROM events GROUP BY 1, 2" for n, e in columns.items())
    return f"SELECT * FROM ({rows}) WHERE value IS NOT NULL"


@query(_last({"MemFree": "user_id", "Cached": _K, "SwapFree": "3", "SwapUsed": f"{_K} - 3"}))
def memory_series(spark, sf_dir):
    made = [M.field(n, c.cast("double"), "double") for n, c in {"MemFree": M.number("user_id"), "Cached": _k(), "SwapFree": F.lit(3), "SwapTotal": _k()}.items()]
    return system.memory(_with(spark, sf_dir, *made), seconds=86400)


@query(_last({"HeapSys": "user_id", "HeapObjects": _K}))
def heap_series(spark, sf_dir):
    return system.heap(_with(spark, sf_dir, M.field("HeapSys", M.number("user_id"), "double"), M.field("HeapObjects", _k().cast("double"), "double")), seconds=86400)


@query(
    f"""WITH d AS (SELECT *, {_K} AS k, {_K} - lag({_K}) OVER (PARTITION BY user_id ORDER BY ts) AS step FROM events),
l AS (SELECT 'host-' || user_id AS hostname, {_TICK.format(86400)} AS bucket_start, arg_max(step, ts) AS step, arg_max(k, ts) FILTER (step IS NOT NULL) AS k FROM d GROUP BY 1, 2)
SELECT hostname, bucket_start, 'ReadsCompleted' AS col, step::DOUBLE AS value FROM l WHERE step IS NOT NULL UNION ALL SELECT hostname, bucket_start, 'TimeReading', k::DOUBLE FROM l WHERE k IS NOT NULL"""
)
def disk_series(spark, sf_dir):
    """Totals as steps, times as they stand, and a host's first message for a base only."""
    df = _with(spark, sf_dir, M.field("ReadsCompleted", _k().cast("double"), "double"), M.field("TimeReading", _k().cast("double"), "double"))
    return system.disks(df, seconds=86400)


@query(_last({"failures": _K}, keys="event_type AS plugin"))
def failure_series(spark, sf_dir):
    report = F.concat(F.lit('{"'), "type", F.lit('":{"ProcessMessageFailures":'), _k().cast("string"), F.lit("}}"))
    return system.plugin_failures(tables.events(spark, sf_dir).withColumn("payload", report), seconds=86400)


# Decoders and times


@query(f"SELECT event_id, event_type AS type, 'host-' || user_id AS hostname, {_K} || '' AS k, '<none>' AS none FROM events")
def decode_xml(spark, sf_dir):
    line = F.concat(F.lit('<r host="'), "hostname", F.lit('"><kind>'), "type", F.lit("</kind><n><k>"), _k().cast("string"), F.lit("</k></n></r>"))
    paths = {"host": "/r/@host", "kind": "/r/kind", "k": "/r/n/k", "none": "/r/other"}
    column = decoders.payload_xml(paths, {"Hostname": "%host%", "Type": "%kind%", "k": "%k%", "none": "%none%"})
    read = decoders.decode(tables.events(spark, sf_dir).withColumn("payload", line), column, keep=["event_id"])
    return read.select("event_id", "type", "hostname", M.text("k").alias("k"), M.text("none").alias("none"))


@query(f"SELECT event_id, 'plain' AS type, 5 AS severity, 'eu' AS zone, {_K} || '' AS k FROM events")
def decode_scribble(spark, sf_dir):
    read = decoders.decode(tables.events(spark, sf_dir), decoders.scribble({"Type": "plain", "Severity": "5", "zone": "eu"}), keep=["event_id"])
    return read.select("event_id", "type", "severity", M.text("zone").alias("zone"), M.text("k").alias("k"))


@query(f"SELECT event_id, 'DockerEvent' AS type, {_S} * 1000000000 AS timestamp, 'id:c' || user_id || ' status:' || event_type || ' from:img time:' || {_S} AS payload, event_type AS status FROM events")
def decode_container_event(spark, sf_dir):
    seconds = F.expr("timestamp div 1000000000")
    line = F.to_json(F.struct(F.concat(F.lit("c"), M.text("user_id")).alias("id"), F.col("type").alias("status"), F.lit("img").alias("from"), seconds.alias("time")))
    read = decoders.decode(tables.events(spark, sf_dir).withColumn("payload", line), decoders.container_event(), keep=["event_id"])
    return read.select("event_id", "type", "timestamp", "payload", M.text("Status").alias("status"))


@query(f"SELECT event_id, 'DockerStats' AS type, {_S} * 1000000000 AS timestamp, 'web-' || user_id AS container FROM events")
def decode_container_stats(spark, sf_dir):
    read_at = F.date_format(F.timestamp_seconds(F.expr("timestamp div 1000000000")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.to_json(F.struct(read_at.alias("read"), F.concat(F.lit("/web-"), M.text("user_id")).alias("name"), _k().alias("cpu")))
    read = decoders.decode(tables.events(spark, sf_dir).withColumn("payload", line), decoders.container_stats(), keep=["event_id"])
    return read.select("event_id", "type", "timestamp", M.text("ContainerName").alias("container"))


@query(f"SELECT event_id, {_S} * 1000000000 + 250000000 AS seconds, ({_S} * 1000 + {_K}) * 1000000 AS millis, epoch_us(ts) * 1000 AS micros, epoch_us(ts) * 1000 + {_K} AS nanos, CAST(NULL AS BIGINT) AS unread FROM events")
def epoch_times(spark, sf_dir):
    whole, micros = F.expr("timestamp div 1000000000"), F.expr("timestamp div 1000")
    texts = {
        "seconds": ("Epoch", F.concat(whole.cast("string"), F.lit(".25"))),
        "millis": ("EpochMilli", (whole * 1000 + _k()).cast("string")),
        "micros": ("EpochMicro", micros.cast("string")),
        "nanos": ("EpochNano", (F.col("timestamp") + _k()).cast("string")),
        "unread": ("Epoch", F.lit("-1")),
    }
    return tables.events(spark, sf_dir).select("event_id", *[X.epoch(text, layout).alias(n) for n, (layout, text) in texts.items()])


@query(f"SELECT event_id, 2024 AS year, month(ts)::INTEGER AS month, (CASE WHEN {_K} % 2 = 0 THEN {_K} ELSE 0 END)::INTEGER AS seq, 'web-' || event_type AS stream FROM events")
def rotated_log_names(spark, sf_dir):
    """Sort keys and streams of paths such as /logs/click/2024-Jan.log.3; the newest has no number."""
    month, number = F.date_format(F.timestamp_seconds(F.expr("timestamp div 1000000000")), "MMM"), F.when(_k() % 2 == 0, F.concat(F.lit("."), _k().cast("string"))).otherwise(F.lit(""))
    path = F.concat(F.lit("/logs/"), "type", F.lit("/2024-"), month, F.lit(".log"), number)
    pattern = r"/logs/(?P<site>[a-z]+)/(?P<Year>\d+)-(?P<Month>\w+)\.log(?:\.(?P<Seq>\d+))?$"
    keys = X.file_keys(path, pattern, ["Year", "Month", "Seq"], {"Seq": {"missing": 0}})
    return tables.events(spark, sf_dir).select("event_id", *[keys[n].alias(n.lower()) for n in ("Year", "Month", "Seq")], X.stream_name(path, pattern, ["web-", "site"]).alias("stream"))


# Splitters


@query("SELECT doc_id, 0::BIGINT AS seq, hex(array_slice(encode(text), 1, 200)) AS record FROM documents WHERE text IS NOT NULL")
def split_truncated(spark, sf_dir):
    """Whole texts, cut at the limit in bytes."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL")
    cut = splitters.whole(docs, "text", max_record=200, keep_truncated=True)
    return cut.select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.hex(F.col("record").cast("binary")).alias("record"))


@query("SELECT doc_id, md5(text) AS record FROM documents WHERE strlen(text) <= 500")
def split_dropped(spark, sf_dir):
    """Records over the limit are dropped."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return splitters.whole(docs, "text", max_record=500).select("doc_id", F.md5("record").alias("record"))


@query(
    """WITH l AS (SELECT doc_id, i - 1 AS i, parts[i] AS word, len(parts) AS n FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS parts FROM documents WHERE text IS NOT NULL)))
SELECT doc_id, i // 100 AS seq, md5(string_agg(word, ' ' ORDER BY i) || ' ') AS record FROM l WHERE i < (n - 1) // 100 * 100 GROUP BY doc_id, i // 100"""
)
def split_token_count(spark, sf_dir):
    """Records of a hundred delimiters each."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return splitters.token(docs, "text", delimiter=" ", count=100).select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.md5("record").alias("record"))


# Encoders and delivery


_BULK = """'{"index":{"_index":"' || lower(event_type) || strftime(ts, '-%Y.%m.%d') || '","_type":"message"}}' || chr(10)"""


@query(f"SELECT event_id, {_BULK} || props || chr(10) AS line FROM events")
def encode_es_payload(spark, sf_dir):
    df = tables.events(spark, sf_dir).withColumn("payload", F.concat("payload", F.lit("\n\n")))
    return df.select("event_id", encoders.es_payload(index="%{Type}-%{%Y.%m.%d}").alias("line"))


@query(
    f"""SELECT event_id, {_BULK} || '{{"@uuid":"","@timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","@type":"' || event_type || '","@logger":"events","@severity":' || CASE event_type WHEN 'error' THEN 3 ELSE 6 END
|| ',"@message":"","@envversion":"","@pid":0,"@source_host":"host-' || user_id || '","@fields":{{"k":' || {_K} || '}}}}' || chr(10) AS line FROM events"""
)
def encode_es_logstash(spark, sf_dir):
    df = tables.events(spark, sf_dir).withColumns({"payload": F.lit(""), "uuid": F.lit(None).cast("binary")})
    return df.select("event_id", encoders.es_logstash_v0(index="%{Type}-%{%Y.%m.%d}", use_message_type=True, dynamic_fields=["k"]).alias("line"))


@query(f"""SELECT event_id, '[{{"points":[[' || {_S} * 1000 || ',' || {_K} || ']],"name":"k","columns":["time","value"]}}]' AS line FROM events""")
def encode_statmetric_influx(spark, sf_dir):
    df = _with(spark, sf_dir, M.field("timestamp", F.expr("timestamp div 1000000000"), "integer"), M.field("k", _k(), "integer"))
    return df.select("event_id", encoders.statmetric_influx().alias("line"))


@query(
    f"""WITH p AS (SELECT event_type AS type, {_K} AS k, ts, (row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1) // 50 AS batch FROM events)
SELECT type, batch, string_agg(k || chr(10), '' ORDER BY ts) AS payload FROM p GROUP BY type, batch"""
)
def influx_batches(spark, sf_dir):
    return items.influx_batches(tables.events(spark, sf_dir), F.concat(_k().cast("string"), F.lit("\n")), ["timestamp"], flush_count=50, keys=["type"])


@query(
    f"""WITH s AS (SELECT 'host-' || user_id AS hostname, {_TICK.format(86400)} AS b, sum({_K}) AS v FROM events GROUP BY 1, 2), n AS (SELECT *, max(b) OVER (PARTITION BY hostname) AS newest FROM s)
SELECT hostname, '{{"gauges":[' || string_agg('{{"value":' || v || ',"measure_time":' || b || ',"name":"k","source":"' || hostname || '"}}', ',' ORDER BY b) || ']}}' AS payload FROM n WHERE b < newest GROUP BY hostname"""
)
def encode_librato(spark, sf_dir):
    """Gauges of all rows but the newest, which may still grow."""
    made = series.aggregate(tables.events(spark, sf_dir), {"k": M.number("k")}, seconds=86400, keys=["hostname"])
    return encoders.librato(made, keys=["hostname"])


@query(f"SELECT 'stats.k ' || {_K} || ' ' || {_S} || chr(10) AS line FROM events WHERE {_K} % 4 <> 0")
def carbon_valid_lines(spark, sf_dir):
    """Lines of name, value and time pass; others are left out."""
    value = F.when(_k() % 4 == 0, F.lit("none")).otherwise(_k().cast("string"))
    line = F.concat(F.lit(" stats.k "), value, F.lit(" "), F.expr("timestamp div 1000000000").cast("string"), F.lit("\nbroken line\n"))
    return sinks.valid_carbon(tables.events(spark, sf_dir).withColumn("payload", line))


@query(f"SELECT event_id, CASE {_K} % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS state, event_type AS message FROM events")
def passive_check_states(spark, sf_dir):
    word = F.element_at(F.array(*map(F.lit, ("OK", "WARNING", "CRITICAL", "UNKNOWN"))), (_k() % 4 + 1).cast("int"))
    state, message = sinks.nagios_state(F.concat(word, F.lit(":"), "type"))
    return tables.events(spark, sf_dir).select("event_id", state.alias("state"), message.alias("message"))


@query(
    f"""WITH p AS (SELECT 'host-' || user_id AS name, {_S} AS t, {_K} AS k, max({_S}) OVER (PARTITION BY user_id) AS newest FROM events)
SELECT name, step::BIGINT AS step, t // step * step AS bucket_start, avg(k) AS value FROM p, (VALUES (3600, 168), (86400, 20)) a(step, n) WHERE t > newest - step * n GROUP BY 1, 2, 3"""
)
def archive_averages(spark, sf_dir):
    """Averages at each resolution, as far back as it reaches."""
    points = tables.events(spark, sf_dir).select(F.col("hostname").alias("name"), F.expr("timestamp div 1000000000").alias("time"), M.number("k").alias("value"))
    return sinks.archives(points, ((3600, 168), (86400, 20)))


@query("SELECT 'events' AS logger, event_type AS payload_name, 'json' AS payload_type, arg_max(props, ts) AS payload, max(epoch_us(ts)) * 1000 AS timestamp FROM events GROUP BY event_type")
def latest_payloads(spark, sf_dir):
    df = _with(spark, sf_dir, M.field("payload_name", F.col("type"), "string"), M.field("payload_type", F.lit("json"), "string"))
    return sinks.latest_payloads(df)


@query("SELECT 'log-' || event_type AS topic, 'host-' || user_id AS key, props AS value FROM events")
def kafka_records(spark, sf_dir):
    """Topic and key by message variables."""
    df = tables.events(spark, sf_dir).withColumn("fields", F.array(M.field("topic", F.concat(F.lit("log-"), "type"), "string")))
    rows = sinks.kafka_rows(df, F.col("payload"), topic_variable="Fields[topic]", partitioner="Hash", hash_variable="Hostname")
    return rows.select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
