"""Encoders: a message as text for some store, built from column functions only."""

from __future__ import annotations

import json as _json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import message as M
from ..functions import text as X

#: Names of the value types.
KINDS = {M.STRING: "string", M.BYTES: "bytes", M.INTEGER: "integer", M.DOUBLE: "double", M.BOOL: "bool"}


def _stamp(pattern: str, ns: str = "timestamp") -> Column:
    return F.date_format(F.timestamp_micros(F.expr(f"{ns} div 1000")), pattern)


def payload(*, append_newlines: bool = True, prefix_ts: bool = False, ts_format: str = "[%Y/%b/%d:%H:%M:%S %z] ") -> Column:
    """The payload, with a time before it and a line break after it if asked for."""
    parts = [_stamp(X.strftime(ts_format))] if prefix_ts else []
    parts.append(F.col("payload"))
    return F.concat(*parts, F.lit("\n")) if append_newlines else F.concat(*parts)


def _values(f: Column, bytes_as, text_as=lambda v: v) -> Column:
    """A field's values as an array of text."""
    return F.coalesce(
        F.transform(f["value_string"], text_as),
        F.transform(f["value_bytes"], bytes_as),
        F.transform(f["value_integer"], lambda v: v.cast("string")),
        F.transform(f["value_double"], M.shortest),
        F.transform(f["value_bool"], lambda v: v.cast("string")),
        F.array().cast("array<string>"),
    )


def rst() -> Column:
    """A block for people to read: a line an attribute, then a line a field."""
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])

    def line(f: Column) -> Column:
        values = _values(f, F.base64, quoted)
        shown = F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")))
        unit = F.when(f["representation"] != "", F.concat(F.lit(' representation:"'), f["representation"], F.lit('"'))).otherwise(F.lit(""))
        return F.concat(F.lit('    | name:"'), f["name"], F.lit('" type:'), F.element_at(kind, f["value_type"].cast("int")), F.lit(" value:"), shown, unit, F.lit("\n"))

    nanos = F.pmod("timestamp", F.lit(1_000_000_000))
    fraction = F.regexp_replace(F.concat(F.lit("."), F.lpad(nanos.cast("string"), 9, "0")), r"\.?0+$", "")
    attributes = {"Timestamp": F.concat(_stamp("yyyy-MM-dd HH:mm:ss"), fraction, F.lit(" +0000 UTC")), "Type": F.col("type"), "Hostname": F.col("hostname"), "Pid": F.col("pid").cast("string"), "Uuid": M.uuid_text(), "Logger": F.col("logger"), "Payload": F.col("payload"), "EnvVersion": F.col("env_version"), "Severity": F.col("severity").cast("string")}
    head = [F.concat(F.lit(f":{n}: "), c, F.lit("\n")) for n, c in attributes.items()]
    bag = F.when(F.size("fields") > 0, F.concat(F.lit(":Fields:\n"), F.array_join(F.transform("fields", line), ""))).otherwise(F.lit(""))
    return F.concat(F.lit("\n"), *head, bag, F.lit("\n"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), X.json_escaped(c), F.lit('"'))


def _json_field(raw: Sequence[str], replace_dots: str | None):
    """'"name":value' of a field; several values are an array, and raw fields go in as they are."""

    def one(f: Column) -> Column:
        is_raw = f["name"].isin(list(raw)) if raw else F.lit(False)
        many = F.coalesce(F.size(f["value_bytes"]), F.lit(0)) > 1
        as_bytes = lambda v: F.when(is_raw, v.cast("string")).otherwise(_quoted(F.when(many, F.base64(v)).otherwise(v.cast("string"))))
        values = _values(f, as_bytes, lambda v: F.when(is_raw, v).otherwise(_quoted(v)))
        shown = F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")))
        name = F.replace(f["name"], F.lit("."), F.lit(replace_dots)) if replace_dots is not None else f["name"]
        return F.concat(_quoted(name), F.lit(":"), shown)

    return one


def bulk_header(index: str, type_: str, id_: str | None = None) -> Column:
    """The line before a document in a bulk request."""
    parts = [F.lit('{"index":{"_index":'), _quoted(F.lower(X.interpolate(index))), F.lit(',"_type":'), _quoted(X.interpolate(type_))]
    if id_:
        parts += [F.lit(',"_id":'), _quoted(X.interpolate(id_))]
    return F.concat(*parts, F.lit("}}\n"))


_ENVELOPE = {"Uuid": lambda: _quoted(M.uuid_text()), "Timestamp": None, "Type": lambda: _quoted(F.col("type")), "Logger": lambda: _quoted(F.col("logger")), "Severity": lambda: F.col("severity").cast("string"), "Payload": lambda: _quoted(F.col("payload")), "EnvVersion": lambda: _quoted(F.col("env_version")), "Pid": lambda: F.col("pid").cast("string"), "Hostname": lambda: _quoted(F.col("hostname"))}


def es_json(*, index: str = "messages-%{%Y.%m.%d}", type_name: str = "message", id_: str | None = None, fields: Sequence[str] = (*_ENVELOPE, "DynamicFields"), mapping: Mapping[str, str] | None = None, timestamp: str = "%Y-%m-%dT%H:%M:%S", dynamic_fields: Sequence[str] = (), raw_bytes_fields: Sequence[str] = (), replace_dots_with: str | None = None) -> Column:
    """A bulk header and the message as a flat JSON document."""
    chosen = F.filter("fields", lambda f: f["name"].isin(list(dynamic_fields))) if dynamic_fields else F.col("fields")
    parts = []
    for name in fields:
        if name == "DynamicFields":
            parts.append(F.transform(chosen, _json_field(raw_bytes_fields, replace_dots_with)))
        else:
            value = _quoted(_stamp(X.strftime(timestamp))) if name == "Timestamp" else _ENVELOPE[name]()
            parts.append(F.array(F.concat(F.lit(_json.dumps((mapping or {}).get(name, name)) + ":"), value)))
    return F.concat(bulk_header(index, type_name, id_), F.lit("{"), F.array_join(F.flatten(F.array(*parts)), ","), F.lit("}\n"))


def es_logstash_v0(*, index: str = "logstash-%{%Y.%m.%d}", type_name: str = "message", id_: str | None = None, use_message_type: bool = False, dynamic_fields: Sequence[str] = (), raw_bytes_fields: Sequence[str] = (), timestamp: str = "%Y-%m-%dT%H:%M:%S") -> Column:
    """A bulk header and the message as a Logstash v0 document, its fields under @fields."""
    chosen = F.filter("fields", lambda f: f["name"].isin(list(dynamic_fields))) if dynamic_fields else F.col("fields")
    names = {"@uuid": _ENVELOPE["Uuid"](), "@timestamp": _quoted(_stamp(X.strftime(timestamp))), "@type": _quoted(F.col("type")) if use_message_type else F.lit('"message"'), "@logger": _ENVELOPE["Logger"](), "@severity": _ENVELOPE["Severity"](), "@message": _ENVELOPE["Payload"](), "@envversion": _ENVELOPE["EnvVersion"](), "@pid": _ENVELOPE["Pid"](), "@source_host": _ENVELOPE["Hostname"]()}
    parts = [F.concat(F.lit(f'"{n}":'), c) for n, c in names.items()]
    bag = F.concat(F.lit('"@fields":{'), F.array_join(F.transform(chosen, _json_field(raw_bytes_fields, None)), ","), F.lit("}"))
    return F.concat(bulk_header(index, type_name, id_), F.lit("{"), F.concat_ws(",", *parts, bag), F.lit("}\n"))


def es_payload(*, index: str = "messages-%{%Y.%m.%d}", type_name: str = "message", id_: str | None = None) -> Column:
    """A bulk header before a payload that is a document already."""
    return F.concat(bulk_header(index, type_name, id_), F.regexp_replace("payload", r"\n*$", ""), F.lit("\n"))


def alert() -> Column:
    """The lines of an alert."""
    return F.concat(F.lit("Timestamp: "), _stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\nHostname: "), F.col("hostname"), F.lit("\nPlugin: "), F.col("logger"), F.lit("\nAlert: "), F.col("payload"), F.lit("\n"))


# Line protocols


def _points(df: DataFrame, keep: Sequence[str], *, skip: Sequence[str], word_names: bool, prefix: str, source_value_field: str | None) -> DataFrame:
    """keep, _i, name, value (text), is_number, is_bytes: a row for each value of each field.

    The second field of a name is name_fidx_1 and so on; from the second
    value on the suffixes add up, name_vidx_1, name_vidx_1_vidx_2.
    """
    named = (lambda c: F.regexp_replace(c, r"[^0-9A-Za-z]", "_")) if word_names else (lambda c: c)
    rows = df.select(*keep, F.col("fields").alias("_all"), F.posexplode("fields").alias("_i", "_f"))
    before = F.size(F.filter(F.slice("_all", 1, F.col("_i")), lambda f: named(f["name"]) == named(F.col("_f.name"))))
    base = F.concat(named(F.col("_f.name")), F.when(before > 0, F.concat(F.lit("_fidx_"), before.cast("string"))).otherwise(F.lit("")))
    values = _values(F.col("_f"), lambda v: v.cast("string"))
    rows = rows.select(*keep, "_i", F.col("_f.name").alias("_field"), base.alias("_base"), F.col("_f.value_type").alias("_kind"), F.posexplode(values).alias("_v", "value"))
    suffix = F.when(F.col("_v") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.col("_v"), F.lit(1))), lambda k: F.concat(F.lit("_vidx_"), k.cast("string"))), "")).otherwise(F.lit(""))
    name = F.concat(F.lit(prefix), F.col("_base"), suffix)
    if source_value_field:
        rows, name = rows.where(F.col("_field") == source_value_field), F.lit(prefix)
    elif skip:
        rows = rows.where(~F.col("_field").isin(list(skip)))
    return rows.select(*keep, "_i", "_v", name.alias("name"), "value", F.col("_kind").isin(M.INTEGER, M.DOUBLE).alias("is_number"), "_field")


#: What a precision divides nanoseconds by.
PRECISION = {"ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def carbon_lines(df: DataFrame, keep: Sequence[str], *, skip: Sequence[str] = (), prefix: str = "", precision: str = "s", source_value_field: str | None = None) -> DataFrame:
    """keep, line: name value time; only values of digits and points, so negative numbers and exponents are left out."""
    rows = _points(df, [*keep, "timestamp"], skip=skip, word_names=True, prefix=prefix, source_value_field=source_value_field)
    time = F.expr(f"timestamp div {PRECISION[precision]}").cast("string")
    return rows.where(F.col("value").rlike(r"^[0-9.]+$")).select(*keep, F.concat_ws(" ", "name", "value", time).alias("line"))


def influx_lines(df: DataFrame, keep: Sequence[str], *, tags: Sequence[str] = ("Logger", "Type", "Severity", "Hostname"), tag_fields: Sequence[str] = (), skip: Sequence[str] = (), prefix: str = "", precision: str = "ms", decimals: int = 6, value_key: str = "value", source_value_field: str | None = None) -> DataFrame:
    """keep, line: name,tags value=… time; numbers as floats, text in quotes, spaces and commas of names escaped."""
    escaped = lambda c: F.regexp_replace(c, r"([ ,])", r"\\$1")
    columns = {"Logger": "logger", "Type": "type", "Severity": "severity", "Hostname": "hostname", "Payload": "payload", "EnvVersion": "env_version", "Pid": "pid"}
    tagged = [F.concat(F.lit(f"{t}="), escaped(F.col(columns[t]).cast("string"))) for t in tags] + [F.concat(F.lit(f"{t}="), escaped(M.text(t))) for t in tag_fields]
    marked = df.withColumn("_tags", F.concat_ws(",", *tagged) if tagged else F.lit(""))
    rows = _points(marked, [*keep, "timestamp", "_tags"], skip=skip, word_names=False, prefix=prefix, source_value_field=source_value_field)
    number = F.format_string(f"%.{decimals}f", F.col("value").try_cast("double"))
    value = F.when(F.col("is_number") | F.col("value").rlike(r"^[0-9.]+$") & F.col("value").try_cast("double").isNotNull(), number).otherwise(F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('\\"')), F.lit('"')))
    time = F.expr(f"timestamp div {PRECISION[precision]}").cast("string")
    head = F.when(F.col("_tags") != "", F.concat(escaped(F.col("name")), F.lit(","), F.col("_tags"))).otherwise(escaped(F.col("name")))
    return rows.select(*keep, F.concat(head, F.lit(f" {value_key}="), value, F.lit(" "), time).alias("line"))


def influx_json(*, series: str = "series", skip: Sequence[str] = (), precision: str = "ms") -> Column:
    """The 0.8 JSON form: one series of one point; bytes are left out, and repeated names numbered from 2."""
    base = {"Type": _ENVELOPE["Type"], "Payload": _ENVELOPE["Payload"], "Hostname": _ENVELOPE["Hostname"], "Pid": _ENVELOPE["Pid"], "Logger": _ENVELOPE["Logger"], "Severity": _ENVELOPE["Severity"], "EnvVersion": _ENVELOPE["EnvVersion"]}
    base = {n: c for n, c in base.items() if n not in skip}
    chosen = F.filter("fields", lambda f: (f["value_type"] != M.BYTES) & ~f["name"].isin([*skip, ""]))

    def name(f: Column, i: Column) -> Column:
        n = F.size(F.filter(F.slice(chosen, 1, i), lambda g: g["name"] == f["name"])) + 1
        return _quoted(F.concat(f["name"], F.when(n > 1, n.cast("string")).otherwise(F.lit(""))))

    def value(f: Column) -> Column:
        values = _values(f, F.base64, _quoted)
        return F.when(F.size(values) == 1, F.get(values, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")))

    time = F.expr(f"timestamp div {PRECISION[precision]}").cast("string")
    points = F.array_join(F.concat(F.array(time, *[c() for c in base.values()]), F.transform(chosen, value)), ",")
    columns = F.array_join(F.concat(F.array(F.lit('"time"'), *[F.lit(f'"{n}"') for n in base]), F.transform(chosen, name)), ",")
    return F.concat(F.lit('[{"points":[['), points, F.lit(']],"name":'), _quoted(X.interpolate(series)), F.lit(',"columns":['), columns, F.lit("]}]"))


def statmetric_influx() -> Column:
    """Statistics in fields as a JSON series each: name and one point of time (ms) and value."""
    when = M.value("timestamp", "integer") * 1000
    each = F.filter("fields", lambda f: (f["name"] != "timestamp") & f["value_type"].isin(M.INTEGER, M.DOUBLE))
    one = lambda f: F.concat(F.lit('{"points":[['), when.cast("string"), F.lit(","), F.get(_values(f, F.base64), F.lit(0)), F.lit(']],"name":'), _quoted(f["name"]), F.lit(',"columns":["time","value"]}'))
    return F.concat(F.lit("["), F.array_join(F.transform(each, one), ","), F.lit("]"))


def librato(series: DataFrame, *, keys: Sequence[str], source: str = "hostname", sent_until: Mapping[str, int] | None = None) -> DataFrame:
    """keys and payload: gauges of a series' rows newer than what was sent, less the newest row, which may still grow."""
    newest = series.groupBy(*keys).agg(F.max("bucket_start").alias("_newest"))
    rows = series.join(newest, list(keys)).where((F.col("bucket_start") < F.col("_newest")) & ~F.isnan("value"))
    if sent_until:
        known = F.create_map(*[F.lit(x) for kv in sent_until.items() for x in kv])
        rows = rows.where(F.col("bucket_start") > F.coalesce(F.try_element_at(known, F.col(keys[0])), F.lit(-1)))
    gauge = F.concat(F.lit('{"value":'), M.shortest(F.col("value")), F.lit(',"measure_time":'), F.col("bucket_start").cast("string"), F.lit(',"name":'), _quoted(F.col("col")), F.lit(',"source":'), _quoted(F.col(source)), F.lit("}"))
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket_start", "col", gauge.alias("g")))).alias("_g"))
    return gathered.select(*keys, F.concat(F.lit('{"gauges":['), F.array_join(F.transform("_g", lambda x: x["g"]), ","), F.lit("]}")).alias("payload"))
