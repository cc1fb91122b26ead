"""The queries over the driver's tables, with the DuckDB SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import message as M
from ..operators import items, matcher, series, statsd
from . import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _matched(spec: str) -> Query:
    return lambda spark, sf_dir: tables.events(spark, sf_dir, spec).select("event_id", "type")


def _matches(name: str, spec: str, where: str) -> None:
    QUERIES[name] = _matched(spec)
    SQL[name] = f"SELECT event_id, event_type AS type FROM events WHERE {where}"


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_matches("match_string_eq", "Type == 'error'", "event_type = 'error'")
_matches("match_string_order", "Type >= 'error' && Type < 'signup'", "event_type >= 'error' AND event_type < 'signup'")
_matches("match_and_or", "Type == 'error' && Fields[value] > 50 || Type == 'view' && Fields[k] < 10", f"event_type = 'error' AND value > 50 OR event_type = 'view' AND {_K} < 10")
_matches("match_brackets", "(Type == 'error' || Type == 'view') && Fields[k] >= 90", f"(event_type = 'error' OR event_type = 'view') AND {_K} >= 90")
_matches("match_prefix", "Type =~ /^pur/", "starts_with(event_type, 'pur')")
_matches("match_suffix", "Type !~ /ck$/", "NOT ends_with(event_type, 'ck')")
_matches("match_regex", r"Payload =~ /\"k\": [0-9]5\}/ && Type !~ /^(view|c[a-z]+)$/", "regexp_matches(props, '\"k\": [0-9]5}') AND NOT regexp_matches(event_type, '^(view|c[a-z]+)$')")
_matches("match_field_numeric", "Fields[value] > 50 && Fields[user_id] != 3", "value > 50 AND user_id <> 3")
_matches("match_field_nil", "Fields[k] != NIL && Fields[missing] == NIL && Fields[value][0][1] == NIL", f"{_K} IS NOT NULL")
_matches("match_not_equal_missing", "Fields[missing] != 'x' || Fields[missing] !~ /x/ || Fields[value] > 95", "value > 95")
_matches("match_type_mismatch", "Fields[value] != 'x' || Fields[k] == 5 || Severity == 3 && Hostname == 'host-3'", f"{_K} = 5 OR (event_type = 'error' AND user_id = 3)")
_matches("match_time", "Timestamp >= 1704672000000000000 && Timestamp < 1705276800000000000 && Fields[value] >= 20", "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' AND value >= 20")
_matches("match_constants", "TRUE && (FALSE || Fields[k] <= 3)", f"{_K} <= 3")


@query("""SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, count(*) AS n FROM events WHERE event_type = 'error' AND value > 50 GROUP BY 1""")
def events_per_hour(spark, sf_dir):
    """How many errors of value over 50 there are each hour."""
    errors = tables.events(spark, sf_dir, "Type == 'error' && Fields[value] > 50")
    return errors.groupBy(M.bucket(3600).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT 'errors' AS route, event_id FROM events WHERE event_type = 'error'
UNION ALL SELECT 'large', event_id FROM events WHERE value > 60
UNION ALL SELECT 'even', event_id FROM events WHERE {_K} = 42 OR {_K} = 44"""
)
def route_fanout(spark, sf_dir):
    """One scan, a row for each route that wants the message."""
    routes = {"errors": "Type == 'error'", "large": "Fields[value] > 60", "even": "Fields[k] == 42 || Fields[k] == 44"}
    return matcher.route(tables.events(spark, sf_dir), routes).select("route", "event_id")


@query("SELECT event_id, 'alerts' AS output FROM events WHERE user_id IN (1, 2, 3)")
def host_set(spark, sf_dir):
    return matcher.in_set(tables.events(spark, sf_dir), ["host-1", "host-2", "host-3"], "alerts").select("event_id", "output")


_TICK = "CAST(floor(epoch(ts) / {0}) * {0} AS BIGINT)"


@query(
    f"""SELECT {_TICK.format(3600)} AS bucket_start, CASE WHEN s >= 100 AND s < 600 THEN 'HTTP_' || CAST(CAST(floor(s / 100) * 100 AS BIGINT) AS VARCHAR) ELSE 'HTTP_UNKNOWN' END AS col, count(*)::DOUBLE AS value
FROM (SELECT ts, {_K} * 7 AS s FROM events) GROUP BY 1, 2"""
)
def status_class_counts(spark, sf_dir):
    return series.status_classes(tables.events(spark, sf_dir), status=M.number("k") * 7, seconds=3600)


@query(
    f"""SELECT type, bucket_start, col, value FROM (
SELECT event_type AS type, {_TICK.format(3600)} AS bucket_start, 'k' AS col, sum({_K})::DOUBLE AS value FROM events GROUP BY 1, 2
UNION ALL SELECT event_type, {_TICK.format(3600)}, 'user_id', sum(user_id)::DOUBLE FROM events GROUP BY 1, 2)"""
)
def stat_graph_sum(spark, sf_dir):
    df = tables.events(spark, sf_dir)
    return series.aggregate(df, {"k": M.number("k"), "user_id": M.number("user_id")}, seconds=3600, keys=["type"])


@query(
    f"""SELECT hostname, bucket_start, 'value' AS col, arg_max(value, (ts, event_id)) AS value FROM (SELECT 'host-' || user_id AS hostname, {_TICK.format(86400)} AS bucket_start, * FROM events) GROUP BY 1, 2"""
)
def last_value_per_bucket(spark, sf_dir):
    df = tables.events(spark, sf_dir)
    return series.last_values(df, {"value": M.number("value")}, seconds=86400, keys=["hostname"], order=[F.col("timestamp"), F.col("event_id")])


@query(f"""SELECT event_type AS type, {_TICK.format(3600)} AS bucket_start, count(*) AS n, CAST(floor(avg({_K})) AS BIGINT) AS k, round(avg(value), 6) AS value FROM events GROUP BY 1, 2""")
def bucket_averages(spark, sf_dir):
    df = tables.events(spark, sf_dir)
    return series.averages(df, {"k": M.number("k"), "value": M.number("value")}, seconds=3600, keys=["type"], whole=["k"]).withColumn("value", F.round("value", 6))


@query(
    f"""WITH t AS (SELECT event_type AS type, {_TICK.format(86400)} AS bucket_start, count(*) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY type ORDER BY bucket_start) AS BIGINT) AS total, n / 86400.0::DOUBLE AS rate FROM t)
SELECT *, printf('Got %d messages. %.2f msg/sec', total, rate) AS payload FROM r"""
)
def counter_per_tick(spark, sf_dir):
    return series.counter(tables.events(spark, sf_dir), seconds=86400, keys=["type"])


@query(
    f"""WITH t AS (SELECT {_TICK.format(86400)} AS bucket_start, count(*) / 86400.0::DOUBLE AS rate FROM events GROUP BY 1),
b AS (SELECT rate, (row_number() OVER (ORDER BY bucket_start) - 1) // 10 AS block FROM t)
SELECT block, round(min(rate), 6) AS min, round(max(rate), 6) AS max, round(avg(rate), 6) AS mean FROM b GROUP BY block HAVING count(*) = 10"""
)
def counter_summaries(spark, sf_dir):
    ticks = series.counter(tables.events(spark, sf_dir), seconds=86400)
    return series.counter_summary(ticks).select("block", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean")])


def _event_stats(spark, sf_dir):
    """Each event as a stat line's parts: its type is the bucket, its value the sample."""
    df = tables.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click"), F.lit("c")).when(F.col("event_type") == "error", F.lit("g")).otherwise(F.lit("ms"))
    rate = F.when(F.col("event_type") == "view", F.lit(0.5)).otherwise(F.lit(1.0)).cast("float")
    return df.select("event_id", tables.nanos(F.col("ts")).alias("timestamp"), F.concat(F.col("event_type"), F.lit("."), F.col("user_id").cast("string")).alias("bucket"), F.col("value").cast("string").alias("value"), kind.alias("modifier"), rate.alias("sampling"))


_DUCK_STATS = f"""(SELECT {_TICK.format(86400)} AS tick, event_type || '.' || user_id AS bucket, ts, event_id, value,
CASE WHEN event_type IN ('view', 'click') THEN 'c' WHEN event_type = 'error' THEN 'g' ELSE 'ms' END AS modifier, CASE WHEN event_type = 'view' THEN 0.5::FLOAT ELSE 1::FLOAT END AS sampling FROM events)"""


@query(
    f"""SELECT tick, bucket, CAST(sum(CAST(trunc(CAST(value AS FLOAT) * (1::FLOAT / sampling)) AS BIGINT)) AS BIGINT) AS count,
sum(CAST(trunc(CAST(value AS FLOAT) * (1::FLOAT / sampling)) AS BIGINT)) / 86400.0::DOUBLE AS rate FROM {_DUCK_STATS} WHERE modifier = 'c' GROUP BY 1, 2"""
)
def statsd_counters(spark, sf_dir):
    return statsd.counters(_event_stats(spark, sf_dir), seconds=86400)


@query(f"SELECT tick, bucket, arg_max(value, (ts, event_id)) AS value FROM {_DUCK_STATS} WHERE modifier = 'g' GROUP BY 1, 2")
def statsd_gauges(spark, sf_dir):
    return statsd.gauges(_event_stats(spark, sf_dir), seconds=86400, order=["timestamp", "event_id"])


@query(
    f"""WITH g AS (SELECT tick, bucket, arg_max(value, (ts, event_id)) AS value FROM {_DUCK_STATS} WHERE modifier = 'g' GROUP BY 1, 2),
n AS (SELECT *, coalesce(lead(tick) OVER (PARTITION BY bucket ORDER BY tick) - 86400, (SELECT max(tick) FROM g)) AS upto FROM g)
SELECT unnest(generate_series(tick, upto, 86400)) AS tick, bucket, value FROM n"""
)
def statsd_gauges_carried(spark, sf_dir):
    return statsd.carried(statsd.gauges(_event_stats(spark, sf_dir), seconds=86400, order=["timestamp", "event_id"]), seconds=86400)


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY tick, bucket ORDER BY value) AS rn, count(*) OVER (PARTITION BY tick, bucket) AS n FROM {_DUCK_STATS} WHERE modifier = 'ms'),
k AS (SELECT *, n - CAST(floor(0.1 * n + 0.5) AS BIGINT) AS k FROM r)
SELECT tick, bucket, count(*) AS count, count(*) / 86400.0::DOUBLE AS count_ps, min(value) AS lower, max(value) AS upper, round(sum(value), 6) AS sum, round(avg(value), 6) AS mean,
round(CASE WHEN max(k) > 0 THEN sum(value) FILTER (rn <= k) / max(k) ELSE min(value) END, 6) AS mean_90, CASE WHEN max(k) > 0 THEN max(value) FILTER (rn <= k) ELSE max(value) END AS upper_90 FROM k GROUP BY 1, 2"""
)
def statsd_timers_p90(spark, sf_dir):
    made = statsd.timers(_event_stats(spark, sf_dir), seconds=86400)
    return made.withColumns({c: F.round(c, 6) for c in ("sum", "mean", "mean_90")})


@query(f"SELECT tick, count(DISTINCT modifier || bucket) AS num_stats FROM {_DUCK_STATS} GROUP BY 1")
def statsd_numstats(spark, sf_dir):
    return statsd.numbers_of_stats(_event_stats(spark, sf_dir), seconds=86400)


@query(
    f"""WITH s AS (SELECT * REPLACE (floor(value) AS value) FROM {_DUCK_STATS.replace('86400', '100000')}),
c AS (SELECT tick, bucket, CAST(sum(CAST(trunc(CAST(value AS FLOAT) * (1::FLOAT / sampling)) AS BIGINT)) AS BIGINT) AS n FROM s WHERE modifier = 'c' GROUP BY 1, 2),
g AS (SELECT tick, bucket, arg_max(value, (ts, event_id)) AS v FROM s WHERE modifier = 'g' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY tick, bucket ORDER BY value) AS rn, count(*) OVER (PARTITION BY tick, bucket) AS n FROM s WHERE modifier = 'ms'),
t AS (SELECT tick, 'stats.timers.' || bucket || '.' AS name, count(*) AS n, min(value) AS lo, max(value) AS hi, sum(value) AS s, CAST(max(n - CAST(floor(0.1 * n + 0.5) AS BIGINT)) AS BIGINT) AS k,
  sum(value) FILTER (rn <= n - CAST(floor(0.1 * n + 0.5) AS BIGINT)) AS sk, max(value) FILTER (rn <= n - CAST(floor(0.1 * n + 0.5) AS BIGINT)) AS hk FROM r GROUP BY tick, bucket),
l AS (SELECT tick, 'stats.counters.' || bucket || '.count' AS name, CAST(n AS VARCHAR) AS v FROM c
UNION ALL SELECT tick, 'stats.counters.' || bucket || '.rate', printf('%.6f', n / 100000.0::DOUBLE) FROM c
UNION ALL SELECT tick, 'stats.gauges.' || bucket, printf('%.6f', v) FROM g
UNION ALL SELECT tick, name || 'count', CAST(n AS VARCHAR) FROM t UNION ALL SELECT tick, name || 'count_ps', printf('%.6f', n / 100000.0::DOUBLE) FROM t
UNION ALL SELECT tick, name || 'lower', printf('%.6f', lo) FROM t UNION ALL SELECT tick, name || 'upper', printf('%.6f', hi) FROM t
UNION ALL SELECT tick, name || 'sum', printf('%.6f', s) FROM t UNION ALL SELECT tick, name || 'mean', printf('%.6f', s / n) FROM t
UNION ALL SELECT tick, name || 'mean_90', printf('%.6f', CASE WHEN k > 0 THEN sk / k ELSE lo END) FROM t UNION ALL SELECT tick, name || 'upper_90', printf('%.6f', CASE WHEN k > 0 THEN hk ELSE hi END) FROM t
UNION ALL SELECT tick, 'stats.statsd.numStats', CAST(count(DISTINCT modifier || bucket) AS VARCHAR) FROM s GROUP BY tick)
SELECT tick, string_agg(name || ' ' || v || ' ' || tick, chr(10) ORDER BY name) || chr(10) AS payload FROM l GROUP BY tick"""
)
def statsd_payload(spark, sf_dir):
    """All of a tick's counters, gauges and timers; samples are whole, so that every engine sums and rounds alike."""
    named = statsd.metrics(_whole_stats(spark, sf_dir), seconds=100000, order=["timestamp", "event_id"])
    return statsd.payload(named)


def _whole_stats(spark, sf_dir):
    df = _event_stats(spark, sf_dir)
    return df.withColumn("value", F.floor(F.col("value").cast("double")).cast("string"))


@query(
    f"""WITH c AS (SELECT tick, bucket, CAST(sum(CAST(trunc(CAST(value AS FLOAT) * (1::FLOAT / sampling)) AS BIGINT)) AS BIGINT) AS n FROM {_DUCK_STATS} WHERE modifier = 'c' GROUP BY 1, 2),
b AS (SELECT bucket, min(tick) AS first FROM c GROUP BY 1), t AS (SELECT bucket, unnest(generate_series(first, (SELECT max(tick) FROM c), 86400)) AS tick FROM b)
SELECT tick, bucket, coalesce(n, 0) AS count, coalesce(n, 0) / 86400.0::DOUBLE AS rate FROM t LEFT JOIN c USING (tick, bucket)"""
)
def statsd_counters_idle(spark, sf_dir):
    """Counters go on as zero in ticks without a sample."""
    return statsd.with_idle(statsd.counters(_event_stats(spark, sf_dir), seconds=86400), seconds=86400)


@query(
    f"""WITH s AS (SELECT * REPLACE (floor(value) AS value) FROM {_DUCK_STATS.replace('86400', '100000')}),
c AS (SELECT tick, bucket, CAST(sum(CAST(trunc(CAST(value AS FLOAT) * (1::FLOAT / sampling)) AS BIGINT)) AS BIGINT) AS n FROM s WHERE modifier = 'c' GROUP BY 1, 2),
l AS (SELECT tick, 'stats_counts.' || bucket AS name, n AS v FROM c UNION ALL SELECT tick, 'stats.' || bucket, CAST(trunc(n / 100000.0::DOUBLE) AS BIGINT) FROM c
UNION ALL SELECT tick, 'statsd.numStats', count(*) FROM c GROUP BY tick UNION ALL SELECT DISTINCT tick, '', tick FROM c)
SELECT tick, string_agg(CASE name WHEN '' THEN 'timestamp' ELSE name END || '=' || v, ',' ORDER BY name) AS fields FROM l GROUP BY tick"""
)
def statsd_fields_legacy(spark, sf_dir):
    """A message a tick with the statistics as fields, under the old names."""
    counted = _whole_stats(spark, sf_dir).where("modifier = 'c'")
    made = statsd.in_fields(statsd.metrics(counted, seconds=100000, legacy=True))
    shown = F.transform("fields", lambda f: F.concat_ws("=", f["name"], F.get(f["value_integer"], F.lit(0)).cast("string")))
    return made.select((F.col("timestamp") / 1_000_000_000).cast("bigint").alias("tick"), F.array_join(shown, ",").alias("fields"))


@query(
    f"""SELECT event_id, value - lag(value) OVER w AS value, {_K} - lag({_K}) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def counter_delta(spark, sf_dir):
    df = tables.events(spark, sf_dir)
    columns = {"value": M.number("value"), "k": M.value("k", "integer")}
    return series.deltas(df, columns, keys=["hostname"], order=["timestamp", "event_id"]).select("event_id", "value", "k")


@query(
    f"""WITH d AS (SELECT event_id, ts, user_id, sum({_K} + 100) OVER w AS ticks, sum({_K}) OVER w AS idle FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT event_id, ticks - lag(ticks) OVER w AS ticks, idle - lag(idle) OVER w AS idle FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(ceil((1.0 - idle::DOUBLE / ticks::DOUBLE) * 100 - 0.5) AS BIGINT) AS busy FROM e WHERE ticks IS NOT NULL"""
)
def cpu_percent(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("hostname").orderBy("timestamp", "event_id")
    k = M.value("k", "integer")
    totals = tables.events(spark, sf_dir).withColumns({"ticks": F.sum(k + 100).over(w), "idle": F.sum(k).over(w)})
    steps = series.deltas(totals, {"ticks": F.col("ticks"), "idle": F.col("idle")}, keys=["hostname"], order=["timestamp", "event_id"])
    return steps.where(F.col("ticks").isNotNull()).select("event_id", series.cpu_percent(F.col("ticks"), F.col("idle")).alias("busy"))


@query(f"SELECT {_TICK.format(86400)} AS period, 'host-' || user_id AS item, count(*) AS weight FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def frequent_items_exact(spark, sf_dir):
    return items.frequent_items(tables.events(spark, sf_dir), F.col("hostname"), min_weight=1)


@query()
def frequent_items_sketch(spark, sf_dir):
    return items.top_items(tables.events(spark, sf_dir), "hostname", k=5, keys=["type"])


@query(f"SELECT {_TICK.format(86400)} AS bucket_start, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def unique_items_exact(spark, sf_dir):
    return items.unique_items(tables.events(spark, sf_dir), F.col("hostname"), exact=True)


@query()
def unique_items_sketch(spark, sf_dir):
    return items.unique_items(tables.events(spark, sf_dir), F.col("hostname"))


@query(
    """SELECT 'host-' || user_id AS hostname, CAST(floor(max(epoch_us(ts)) / 1000) AS BIGINT) AS last_heartbeat,
CASE WHEN 1706572800000 - CAST(floor(max(epoch_us(ts)) / 1000) AS BIGINT) > 86400000 THEN 'down' ELSE 'up' END AS status FROM events GROUP BY 1"""
)
def heartbeat_status(spark, sf_dir):
    return items.heartbeats(tables.events(spark, sf_dir), F.lit(1706572800000000000), timeout=86400)


@query(
    f"""WITH m AS (SELECT event_type, count(*) AS n, count({_K}) AS nk, count(value) AS nv, count(user_id) AS nu FROM events GROUP BY 1)
SELECT 'events' AS logger, event_type AS type, '' AS env_version, f AS field, c AS n, 'number' AS kind, c <> n AS optional FROM
(SELECT *, 'k' AS f, nk AS c FROM m UNION ALL SELECT *, 'value', nv FROM m UNION ALL SELECT *, 'user_id', nu FROM m) WHERE c > 0"""
)
def message_schema(spark, sf_dir):
    return items.message_schema(tables.events(spark, sf_dir))


@query("""SELECT source AS logger, lang AS type, CASE WHEN grouping(source) + grouping(lang) = 0 THEN '' END AS env_version, count(*) AS n,
(CASE WHEN grouping(source) = 1 THEN 7 WHEN grouping(lang) = 1 THEN 3 ELSE 0 END)::BIGINT AS level FROM documents GROUP BY ROLLUP (source, lang)
UNION ALL SELECT source, lang, NULL, count(*), 1 FROM documents GROUP BY 1, 2""")
def message_schema_rollup(spark, sf_dir):
    return items.schema_counts(tables.documents(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT {_TICK.format(86400)} AS bucket_start, event_type AS device, count(*) AS n FROM events GROUP BY 1, 2)
SELECT *, CAST(sum(n) OVER (PARTITION BY bucket_start) AS BIGINT) AS total FROM r"""
)
def users_by_device(spark, sf_dir):
    return items.users_by_device(tables.events(spark, sf_dir), F.col("type"), seconds=86400)


def _host_series(spark, sf_dir):
    df = tables.events(spark, sf_dir)
    return series.aggregate(df, {"k": M.number("k"), "value": M.number("value")}, seconds=86400, how="max", keys=["hostname"])


_DUCK_HOSTS = f"(SELECT 'host-' || user_id AS hostname, {_TICK.format(86400)} AS bucket_start, max({_K})::DOUBLE AS k, max(value) AS v FROM events GROUP BY 1, 2)"


@query(f"SELECT bucket_start, 'k' AS col, sum(k) AS value FROM {_DUCK_HOSTS} GROUP BY 1 UNION ALL SELECT bucket_start, 'value', max(v) FROM {_DUCK_HOSTS} GROUP BY 1")
def cbuf_merge_sum(spark, sf_dir):
    return series.merge(_host_series(spark, sf_dir), {"k": "sum", "value": "max"})


@query(f"SELECT bucket_start, hostname, k AS value FROM {_DUCK_HOSTS} WHERE k IS NOT NULL")
def cbuf_by_host(spark, sf_dir):
    """Every host's column, in long form: hosts are too many for columns of a table."""
    return series.host_columns(_host_series(spark, sf_dir).where("col = 'k'"))


@query(
    f"""SELECT bucket_start, {", ".join(f"sum(v) FILTER (type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view"))} FROM
(SELECT event_type AS type, {_TICK.format(86400)} AS bucket_start, sum({_K})::DOUBLE AS v FROM events GROUP BY 1, 2) GROUP BY 1"""
)
def cbuf_pivot(spark, sf_dir):
    """A column for each type: the columns are found in the series."""
    made = series.aggregate(tables.events(spark, sf_dir), {"k": M.number("k")}, seconds=86400, keys=["type"])
    return series.by_host(made, host="type", max_hosts=10)


@query(
    f"""WITH s AS (SELECT event_type AS type, {_TICK.format(86400)} AS bucket_start, sum({_K})::DOUBLE AS value FROM events GROUP BY 1, 2)
SELECT type, bucket_start, 'k' AS col, value FROM (SELECT *, max(bucket_start) OVER (PARTITION BY type) AS newest FROM s) WHERE bucket_start > newest - 7 * 86400"""
)
def series_retained(spark, sf_dir):
    made = series.aggregate(tables.events(spark, sf_dir), {"k": M.number("k")}, seconds=86400, keys=["type"])
    return series.retained(made, 7, 86400, ["type"]).select("type", "bucket_start", "col", "value")


@query(
    f"""WITH s AS (SELECT event_type AS type, {_TICK.format(86400)} AS b, sum({_K}) AS k FROM events GROUP BY 1, 2),
n AS (SELECT type, max(b) AS newest FROM s GROUP BY 1), t AS (SELECT type, newest, unnest(generate_series(newest - 4 * 86400, newest, 86400)) AS b FROM n)
SELECT type, '{{"time":' || (newest - 4 * 86400) || ',"rows":5,"columns":1,"seconds_per_row":86400,"column_info":[{{"name":"k","unit":"count","aggregation":"sum"}}]}}' || chr(10)
|| string_agg(coalesce(CAST(CAST(k AS BIGINT) AS VARCHAR), 'nan'), chr(10) ORDER BY b) || chr(10) AS payload FROM t LEFT JOIN s USING (type, b) GROUP BY type, newest"""
)
def series_rendered(spark, sf_dir):
    made = series.aggregate(tables.events(spark, sf_dir), {"k": M.number("k")}, seconds=86400, keys=["type"])
    return series.render(series.retained(made, 5, 86400, ["type"]), {"k": ("count", "sum")}, rows=5, seconds=86400, keys=["type"])


@query(
    f"""WITH s AS (SELECT event_type AS type, {_TICK.format(86400)} AS bucket_start, sum({_K})::DOUBLE AS value FROM events GROUP BY 1, 2)
SELECT type, bucket_start, 'k' AS col, value FROM (SELECT *, max(bucket_start) OVER (PARTITION BY type) AS newest FROM s) WHERE bucket_start > newest - 5 * 86400"""
)
def series_parsed_back(spark, sf_dir):
    return series.parse(series_rendered(spark, sf_dir), keys=["type"])
