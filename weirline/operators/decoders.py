"""Decoders: columns that read a message's payload as a struct of envelope parts and fields.

A decoder's column is null where it fails, so decoders combine as columns do:
first_wins is coalesce.  decode() lays a struct over the message; rows that no
decoder reads keep their message and say why, so that they can be sent to a
dead letter table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import message as M
from ..functions import text as X
from ..functions.regex import to_java

PAYLOAD = "payload"
MAX_ERROR = 500


_CUT = "\ue001"  # stands between captures; no log holds it


def captured(text: str, pattern: str, groups: int, build: Callable[[Column, list[Column]], Column]) -> Column:
    """build(whether the whole text matches, its captures), where the pattern runs once a row: the
    captures are bound by a lambda, since Spark does not share what stands in branches."""
    parts = F.split(F.regexp_replace(F.col(text), pattern, "".join(f"{_CUT}${k}" for k in range(1, groups + 1))), _CUT)
    return F.get(F.transform(F.array(parts), lambda c: build(F.size(c) == groups + 1, [F.get(c, F.lit(k)) for k in range(1, groups + 1)])), F.lit(0))


def decoded(ok: Column, fields: Column | None = None, **parts: Column) -> Column:
    """A decoder's struct where ok, null elsewhere; parts that are not given leave the message's own."""
    columns = [(parts[n].cast(t) if n in parts else F.lit(None).cast(t)).alias(n) for n, t in M.ENVELOPE.items()]
    bag = (F.array().cast(f"array<{M.FIELD_DDL}>") if fields is None else fields).alias("fields")
    return F.when(ok, F.struct(*columns, bag))


def decode(df: DataFrame, decoder: Column, *, error: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Messages as the decoder reads them, with `decode_error` (null if read) and the columns to keep."""
    rows = df.withColumn("_d", decoder)
    failed = F.col("_d").isNull()
    why = error if error is not None else F.concat(F.lit("Failed parsing: payload: "), F.col(PAYLOAD))
    envelope = [F.coalesce(F.col(f"_d.{n}"), F.col(n)).alias(n) for n in M.ENVELOPE]
    bag = F.when(failed, F.col("fields")).otherwise(F.col("_d.fields")).alias("fields")
    return rows.select(*envelope, bag, F.when(failed, F.substring(why, 1, MAX_ERROR)).alias("decode_error"), *keep)


def dead_letters(df: DataFrame) -> DataFrame:
    """The messages that failed, with fields decode_failure and decode_error."""
    added = F.array(M.field("decode_failure", F.lit(True), "bool"), M.field("decode_error", F.col("decode_error"), "string"))
    return df.where(F.col("decode_error").isNotNull()).withColumn("fields", F.concat("fields", added))


def first_wins(*decoders: Column) -> Column:
    return F.coalesce(*decoders)


def all_of(df: DataFrame, decoders: Sequence[Callable[[], Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Decoders one after another on each other's output; a failing one passes its input through, and only if all fail does the message."""
    out = df.withColumn("_read", F.lit(0))
    for make in decoders:
        out = decode(out, make(), keep=["_read", *keep]).withColumn("_read", F.col("_read") + F.col("decode_error").isNull().cast("int")).drop("decode_error")
    failed = F.when(F.col("_read") == 0, F.substring(F.concat(F.lit("Failed parsing: payload: "), F.col(PAYLOAD)), 1, MAX_ERROR))
    return out.withColumn("decode_error", failed).drop("_read")


def _template_parts(template: Mapping[str, str], names: Mapping[str, Column]) -> dict:
    """Envelope parts and fields of a message template; any key but the envelope's is a text field, name|representation."""
    envelope = {"Logger": "logger", "Type": "type", "Payload": "payload", "Hostname": "hostname", "EnvVersion": "env_version"}
    parts: dict = {}
    made = []
    for key, value in template.items():
        column = X.template(value, names)
        if key in envelope:
            parts[envelope[key]] = column
        elif key == "Pid":
            parts["pid"] = F.regexp_extract(column, r"^\s*(-?\d+)", 1).try_cast("int")
        elif key == "Severity":
            parts["severity"] = column.try_cast("int")
        elif key == "Uuid":
            parts["uuid"] = F.try_to_binary(F.replace(column, F.lit("-")), F.lit("hex"))
        else:
            name, _, representation = key.partition("|")
            made.append(M.field(name, column, "string", representation))
    return parts | {"fields": F.array(*made) if made else None}


def _timed(captures: Mapping[str, Column], layout: str | None, tz: str | None, words: Mapping[str, int] | None, year: Column | None) -> dict:
    parts = {}
    if "Timestamp" in captures and layout:
        parts["timestamp"] = X.timestamp(captures["Timestamp"], layout, tz, year=year)
    if "Severity" in captures:
        parts["severity"] = X.severity(captures["Severity"], words)
    return parts


def payload_regex(pattern: str, template: Mapping[str, str], *, layout: str | None = None, tz: str | None = None, severities: Mapping[str, int] | None = None, year: Column | None = None, text: str = PAYLOAD) -> Column:
    """Captures, by name else by number, into a message template."""
    java = to_java(pattern)
    groups = re.compile(pattern).groups
    if not groups:
        raise ValueError(f"no capture group: {pattern}")
    by_number = {v: k for k, v in re.compile(pattern).groupindex.items()}
    captures = {by_number.get(k, str(k)): F.regexp_extract(F.col(text), java, k) for k in range(1, groups + 1)}
    parts = _template_parts(template, captures)
    fields = parts.pop("fields")
    return decoded(F.col(text).rlike(java), fields, **parts, **_timed(captures, layout, tz, severities, year))


_XML_CUT = "\uffff"  # no XML text may hold it
#: Java refuses an XPath expression of more than 10 groups or 100 operators.
_XML_GROUPS, _XML_OPERATORS = 10, 100


def _xml_batches(paths: Sequence[str]) -> list[list[str]]:
    """Neighbouring paths that fit into one expression, each of them twice."""
    out: list[list[str]] = []
    groups = operators = 0
    for p in paths:
        n_groups = 1 + 2 * len(re.findall(r"[(\[]", p))
        n_operators = 4 + 2 * len(re.findall(r"[^\w\s.]|\b(?:and|or|div|mod)\b", p))
        if not out or not p or not out[-1][-1] or groups + n_groups > _XML_GROUPS or operators + n_operators > _XML_OPERATORS:
            out.append([])
            groups = operators = 1
        out[-1].append(p)
        groups, operators = groups + n_groups, operators + n_operators
    return out


def _xml_found(text: Column, batch: list[str]) -> Column:
    """For each path whether it finds something and, after that, its text; from one parse of the document if there are several."""
    if not batch[0]:
        return F.array(F.lit("false"))
    if len(batch) == 1:
        return F.array(F.concat(F.xpath_boolean(text, F.lit(batch[0])).cast("string"), F.xpath_string(text, F.lit(batch[0]))))
    return F.split(F.xpath_string(text, F.lit("concat(" + f",'{_XML_CUT}',".join(f"boolean({p}),{p}" for p in batch) + ")")), _XML_CUT)


def payload_xml(paths: Mapping[str, str], template: Mapping[str, str], *, layout: str | None = None, tz: str | None = None, severities: Mapping[str, int] | None = None, text: str = PAYLOAD) -> Column:
    """XPath captures into a message template; a path that finds nothing gives no capture, and never a failure.

    Spark's xpath functions parse the document at each call, so paths are read by one expression as far as Java takes it.
    """

    def build(found: Column) -> Column:
        items = [F.get(found, F.lit(k)) for k in range(len(paths))]
        captures = {n: F.when(item.startswith("true"), F.substring(item, 5, 2**31 - 1)) for n, item in zip(paths, items, strict=True)}
        parts = _template_parts(template, captures)
        fields = parts.pop("fields")
        return decoded(F.lit(True), fields, **parts, **_timed(captures, layout, tz, severities, None))

    found = [_xml_found(F.col(text), batch) for batch in _xml_batches(list(paths.values()))]
    return F.get(F.transform(F.array(F.concat(*found) if found else F.array().cast("array<string>")), build), F.lit(0))


def scribble(template: Mapping[str, str]) -> Column:
    """A template as it stands, over every message."""
    parts = _template_parts({k: v for k, v in template.items()}, {})
    fields = parts.pop("fields")
    return decoded(F.lit(True), F.concat(F.col("fields"), fields) if fields is not None else F.col("fields"), **parts)


# Log formats

#: What the variables of an access log's format match; numbers become doubles.
_NUMBERS = {"status", "body_bytes_sent", "bytes_sent", "request_length", "request_time", "connection", "connection_requests", "msec", "content_length", "upstream_response_time", "upstream_status", "remote_port", "server_port"}
_APACHE = {"h": "remote_addr", "a": "remote_addr", "A": "server_addr", "l": "remote_logname", "u": "remote_user", "t": "time_local", "r": "request", "s": "status", "b": "body_bytes_sent", "B": "body_bytes_sent", "D": "request_time", "T": "request_time", "v": "server_name", "V": "server_name", "p": "server_port", "P": "pid", "m": "request_method", "U": "uri", "q": "query_string", "H": "server_protocol", "f": "request_filename", "I": "request_length", "O": "bytes_sent", "X": "connection_status", "k": "connection_requests"}
_COMMON_TIME = "dd/MMM/yyyy:HH:mm:ss Z"


def _access(pieces: list[tuple[str, str]], type_: str, *, agent: bool, agent_keep: bool, agent_conditional: bool, payload_keep: bool, text: str) -> Column:
    """pieces: (literal, variable after it)."""
    pattern, names = "^", []
    for k, (literal, name) in enumerate(pieces):
        pattern += re.escape(literal).replace("/", "/")
        if name:
            follows = pieces[k + 1][0][:1] if k + 1 < len(pieces) else ""
            pattern += r"(-|\d+(?:\.\d+)?)" if name in _NUMBERS else (f"([^{re.escape(follows)}]*)" if follows and follows != " " else r"(\S*)" if follows == " " else "(.*)")
            names.append(name)
    pattern += r"\s*$"
    def build(ok: Column, found: list[Column]) -> Column:
        got = dict(zip(names, found, strict=True))
        parts: dict = {"type": F.lit(type_), "payload": F.col(text) if payload_keep else F.lit("")}
        made = []
        for n, c in got.items():
            if n == "time_local":
                parts["timestamp"] = X.timestamp(c, _COMMON_TIME, fallback=False)
            elif n == "time_iso8601":
                parts["timestamp"] = X.timestamp(c, "RFC3339", fallback=False)
            elif n in _NUMBERS:
                number = F.when(c == "-", F.lit(0.0)).otherwise(c.try_cast("double"))
                made.append(M.field(n, number, "double", {"request_time": "s", "body_bytes_sent": "B", "bytes_sent": "B"}.get(n, "")))
            elif n == "http_user_agent" and agent:
                browser, version, system = X.agent(c)
                made += [M.field("user_agent_browser", browser, "string"), M.field("user_agent_version", version, "double"), M.field("user_agent_os", system, "string")]
                kept = F.lit(True) if agent_keep else (browser.isNull() | system.isNull()) if agent_conditional else F.lit(False)
                made.append(M.field(n, F.when(kept, c), "string"))
            else:
                made.append(M.field(n, c, "string", "ipv4" if n == "remote_addr" else ""))
        return decoded(ok, M.fields(*made), **parts)

    return captured(text, pattern, len(names), build)


def nginx_access(log_format: str, *, type_: str = "nginx.access", user_agent_transform: bool = False, user_agent_keep: bool = False, user_agent_conditional: bool = False, payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    """A line in an nginx log_format."""
    pieces = [(a, b) for a, b in re.findall(r"([^$]*)(?:\$(\w+)|$)", log_format) if a or b]
    return _access(pieces, type_, agent=user_agent_transform, agent_keep=user_agent_keep, agent_conditional=user_agent_conditional, payload_keep=payload_keep, text=text)


def apache_access(log_format: str, *, type_: str = "apache.access", user_agent_transform: bool = False, user_agent_keep: bool = False, user_agent_conditional: bool = False, payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    """A line in an Apache LogFormat."""
    pieces = []
    for literal, header, code in re.findall(r"([^%]*)(?:%[<>]?(?:\{([^}]+)\})?([A-Za-z])|$)", log_format):
        if not (literal or code):
            continue
        name = ("http_" if code == "i" else "sent_http_") + header.lower().replace("-", "_") if header and code in "io" else _APACHE.get(code, code) if code else ""
        if name == "time_local":
            pieces += [(literal + "[", name), ("]", "")]
        elif pieces and not pieces[-1][1]:
            pieces[-1] = (pieces[-1][0] + literal, name)
        else:
            pieces.append((literal, name))
    return _access(pieces, type_, agent=user_agent_transform, agent_keep=user_agent_keep, agent_conditional=user_agent_conditional, payload_keep=payload_keep, text=text)


#: Syslog severities and facilities.
SEVERITIES = {"emerg": 0, "alert": 1, "crit": 2, "err": 3, "error": 3, "warning": 4, "warn": 4, "notice": 5, "info": 6, "debug": 7}


def nginx_error(*, type_: str = "nginx.error", tz: str | None = None, payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    """A line of nginx's error log."""
    pattern = r"^(\d{4}/\d\d/\d\d \d\d:\d\d:\d\d) \[(\w+)\] (\d+)#(\d+): (?:\*(\d+) )?([\s\S]*)$"
    def build(ok: Column, found: list[Column]) -> Column:
        part = lambda k: found[k - 1]
        bag = M.fields(M.field("tid", part(4).try_cast("double"), "double"), M.field("connection", F.nullif(part(5), F.lit("")).try_cast("double"), "double"))
        return decoded(ok, bag, timestamp=X.timestamp(part(1), "yyyy/MM/dd HH:mm:ss", tz, fallback=False), severity=X.severity(part(2), SEVERITIES), pid=part(3).try_cast("int"), payload=F.col(text) if payload_keep else part(6), type=F.lit(type_))

    return captured(text, pattern, 6, build)


def nginx_stub_status(*, type_: str = "nginx_stub_status", payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    names = ["connections", "accepts", "handled", "requests", "reading", "writing", "waiting"]
    pattern = r"^Active connections:\s*(\d+)\s*server accepts handled requests\s*(\d+)\s*(\d+)\s*(\d+)\s*Reading:\s*(\d+)\s*Writing:\s*(\d+)\s*Waiting:\s*(\d+)"
    return _numbers(pattern, names, type_, payload_keep, text)


def _numbers(pattern: str, names: Sequence[str], type_: str, payload_keep: bool, text: str, copied: Sequence[str] = ()) -> Column:
    """Numbers of a pattern as double fields, after which named fields of the message are kept."""
    def build(ok: Column, found: list[Column]) -> Column:
        made = F.array(*[M.field(n, c.try_cast("double"), "double") for n, c in zip(names, found, strict=True)])
        return decoded(ok, F.concat(made, _copied(copied)), type=F.lit(type_), payload=F.col(text) if payload_keep else F.lit(""))

    return captured(text, pattern + r"[\s\S]*$", len(names), build)


def _copied(names: Sequence[str]) -> Column:
    return F.filter("fields", lambda f: f["name"].isin(list(names))) if names else F.array().cast(f"array<{M.FIELD_DDL}>")


def rsyslog(template: str, *, type_: str = "", tz: str | None = None, hostname_keep: bool = False, year: Column | None = None, text: str = PAYLOAD) -> Column:
    """A line of a syslog template: priority, times, host, tag and message."""
    shapes = {"pri": r"(\d{1,3})", "pri-text": r"(\w+\.\w+)", "syslogfacility": r"(\d+)", "syslogseverity": r"(\d)", "syslogpriority": r"(\d)", "syslogfacility-text": r"(\w+)", "syslogseverity-text": r"(\w+)", "syslogpriority-text": r"(\w+)", "hostname": r"(\S+)", "source": r"(\S+)", "programname": r"([^\s\[:/]+)", "syslogtag": r"(\S*)", "app-name": r"(\S+)", "procid": r"(\S+)", "msgid": r"(\S+)"}
    rfc3339 = r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d))"
    pattern, names = "^", []
    pieces = re.findall(r"((?:(?!%[a-zA-Z-]+[^%]*%).)+)|%([a-zA-Z-]+)([^%]*)%", template, re.S)
    for literal, name, options in pieces:
        if literal:
            pattern += re.escape(literal.rstrip("\n")) + ("\\n?" if literal.endswith("\n") else "")
            continue
        name = name.lower()
        if name in ("timestamp", "timereported", "timegenerated"):
            shape = rfc3339 if "date-rfc3339" in options else r"([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d)"
        elif name == "msg" and "sp-if-no-1st-sp" in options:
            pattern += " ?"
            continue
        elif name == "msg":
            shape = r"([\s\S]*?)"
        else:
            shape = shapes.get(name, r"(\S+)")
        pattern += shape
        names.append((name, options))
    pattern += r"\n?$"
    def build(ok: Column, found: list[Column]) -> Column:
        part = {n: (c, o) for (n, o), c in zip(names, found, strict=True)}
        out: dict = {"type": F.lit(type_)} if type_ else {}
        made = []
        for n, (c, o) in part.items():
            when = X.timestamp(c, "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX" if "date-rfc3339" in o else "MMM d HH:mm:ss", tz, fallback=False, year=year)
            if n in ("timestamp", "timereported") and "timestamp" not in out:
                out["timestamp"] = when
            elif n in ("timestamp", "timereported", "timegenerated"):
                made.append(M.field(n, when.cast("double"), "double"))
            elif n == "pri":
                out["severity"] = F.pmod(c.try_cast("int"), F.lit(8))
                made.append(M.field("syslogfacility", F.floor(c.try_cast("int") / 8).cast("double"), "double"))
            elif n.startswith(("syslogseverity", "syslogpriority")):
                out.setdefault("severity", X.severity(c, SEVERITIES))
            elif n == "syslogtag":
                tag = r"^([^\[:]*)(?:\[(\d+)\])?:?$"
                out["pid"] = F.nullif(F.regexp_extract(c, tag, 2), F.lit("")).try_cast("int")
                made.append(M.field("programname", F.regexp_extract(c, tag, 1), "string"))
            elif n in ("hostname", "source") and not hostname_keep:
                out["hostname"] = c
            elif n == "msg":
                out["payload"] = c
            else:
                made.append(M.field(n, c, "string"))
        return decoded(ok, M.fields(*made), **out)

    return captured(text, pattern, len(names), build)


def json(*, type_: str = "json", mapping: Mapping[str, str] | None = None, layout: str | None = None, separator: str = ".", max_depth: int = 1, payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    """A JSON object: mapped keys into the envelope, the rest flattened into fields.

    Keys of nested objects are joined by the separator down to max_depth
    levels; deeper objects, and arrays, stay JSON text.
    """
    mapping = dict(mapping or {})
    whole = F.col(text)
    top = F.when(F.get_json_object(whole, "$").startswith("{"), F.from_json(whole, "map<string,string>"))
    ok = F.try_parse_json(whole).isNotNull() & top.isNotNull()
    parts: dict = {"type": F.lit(type_), "payload": whole if payload_keep else F.lit("")}
    envelope = {"Payload": "payload", "Type": "type", "Logger": "logger", "Hostname": "hostname", "Severity": "severity", "Pid": "pid", "EnvVersion": "env_version"}
    numbers = {"Severity", "Pid"}
    variant = F.try_parse_json(whole)
    kind = lambda key: F.schema_of_variant(F.try_variant_get(variant, f"$['{key}']", "variant"))
    taken = []
    for name, key in mapping.items():
        value = F.try_element_at(top, F.lit(key))
        if name == "Timestamp":
            stamp = X.timestamp(value, X.strftime(layout) if "%" in layout else layout, fallback=False) if layout else value.try_cast("bigint")
            parts["timestamp"] = stamp
            ok = ok & (value.isNull() | stamp.isNotNull())
            taken.append(F.lit(key))
        else:
            right = kind(key).isin("BIGINT", "DOUBLE") | kind(key).startswith("DECIMAL") if name in numbers else kind(key) == "STRING"
            parts[envelope[name]] = F.coalesce(F.when(right, value), parts.get(envelope[name], F.lit(None)))
            taken.append(F.when(right, F.lit(key)))
    skip = F.array(*taken) if taken else F.array().cast("array<string>")
    return decoded(F.coalesce(ok, F.lit(False)), _flattened(whole, separator, max_depth, skip), **parts)


_FLAT = f"array<{M.FIELD_DDL}>"


def _flattened(text: Column, separator: str, max_depth: int, skip: Column) -> Column:
    """Fields of a JSON object of unknown depth: recursion is beyond column functions, so Arrow batches of texts."""
    def fields_of(raw: str | None, without: list | None) -> list | None:
        import json

        try:
            top = json.loads(raw) if raw is not None else None
        except ValueError:
            return None
        if not isinstance(top, dict):
            return None
        out = []

        def add(name: str, value, depth: int) -> None:
            row = {"name": name, "representation": ""}
            if isinstance(value, dict) and depth < max_depth:
                for k, v in value.items():
                    add(f"{name}{separator}{k}", v, depth + 1)
            elif isinstance(value, bool):
                out.append(row | {"value_type": M.BOOL, "value_bool": [value]})
            elif isinstance(value, int | float):
                out.append(row | {"value_type": M.DOUBLE, "value_double": [float(value)]})
            elif isinstance(value, str):
                out.append(row | {"value_type": M.STRING, "value_string": [value]})
            elif isinstance(value, dict | list):
                out.append(row | {"value_type": M.STRING, "value_string": [json.dumps(value, separators=(",", ":"), ensure_ascii=False)]})

        for key, value in top.items():
            if key not in (without or ()):
                add(key, value, 1)
        return out

    kind = pa.list_(pa.struct([("name", pa.string()), ("value_type", pa.int8()), ("representation", pa.string()), ("value_string", pa.list_(pa.string())), ("value_bytes", pa.list_(pa.binary())), ("value_integer", pa.list_(pa.int64())), ("value_double", pa.list_(pa.float64())), ("value_bool", pa.list_(pa.bool_()))]))

    @F.arrow_udf(_FLAT)
    def flatten(texts: pa.Array, without: pa.Array) -> pa.Array:
        return pa.array([fields_of(t, w) for t, w in zip(texts.to_pylist(), without.to_pylist(), strict=True)], kind)

    return flatten(text, skip)


def graylog(*, type_: str = "gelf", payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    """An extended Graylog message; its timestamp must be a number of seconds."""
    whole = F.col(text)
    top = F.from_json(whole, "timestamp double, version string, level int, host string")
    numeric = F.schema_of_variant(F.try_variant_get(F.try_parse_json(whole), "$.timestamp", "variant"))
    ok = F.coalesce(numeric.isin("BIGINT", "DOUBLE") | numeric.startswith("DECIMAL"), F.lit(False))
    skip = F.array(*[F.lit(k) for k in ("timestamp", "version", "level", "host")])
    return decoded(ok, _flattened(whole, ".", 1, skip), timestamp=(top["timestamp"] * 1e9).cast("bigint"), env_version=top["version"], severity=top["level"], hostname=top["host"], type=F.lit(type_), payload=whole if payload_keep else F.lit(""))


def slow_query(*, type_: str = "mysql.slow-query", truncate_sql: int | None = None, mariadb: bool = False, text: str = PAYLOAD) -> Column:
    """An entry of a slow query log of MySQL, or of MariaDB with its thread line."""
    whole = F.col(text)
    one = lambda p: F.regexp_extract(whole, p, 1)
    pattern = r"# User@Host:[\s\S]*?# (?:Thread_id:[^\n]*\n# )?Query_time:\s*([0-9.]+)\s+Lock_time:\s*([0-9.]+)\s+Rows_sent:\s*(\d+)\s+Rows_examined:\s*(\d+)"
    sql = F.regexp_replace(F.regexp_extract(whole, r"(?:^|\n)(?:SET [^\n]*timestamp=\d+;\n)(?:# administrator command:[^\n]*\n)?([\s\S]*)$", 1), r"\n*$", "")
    if truncate_sql:
        short = F.substring(sql.cast("binary"), 1, truncate_sql).cast("string")
        sql = F.when(F.octet_length(sql) > truncate_sql, F.concat(short, F.lit("..."))).otherwise(sql)
    names = [("Query_time", "s", 1), ("Lock_time", "s", 2), ("Rows_sent", "", 3), ("Rows_examined", "", 4)]
    bag = [M.field(n, F.regexp_extract(whole, pattern, k).try_cast("double"), "double", r) for n, r, k in names]
    if mariadb:
        bag += [M.field("Thread_id", F.nullif(one(r"# Thread_id: (\d+)"), F.lit("")).try_cast("double"), "double"), M.field("Schema", F.nullif(one(r"Schema: (\S+)"), F.lit("")), "string"), M.field("QC_hit", F.nullif(one(r"QC_hit: (\w+)"), F.lit("")), "string")]
    return decoded(whole.rlike(pattern) & whole.rlike(r"timestamp=\d+;"), M.fields(*bag), timestamp=one(r"timestamp=(\d+);").try_cast("bigint") * 1_000_000_000, payload=sql, type=F.lit("mariadb.slow-query" if mariadb and type_ == "mysql.slow-query" else type_))


#: Flags of a BIND query and the record types it may ask for.
BIND_FLAGS = {"+": "recursion requested", "-": "recursion not requested", "E": "EDNS used", "S": "query signed", "D": "DNSSEC data wanted", "C": "no DNSSEC validation check", "T": "TCP used"}
BIND_TYPES = "AFSDB APL AXFR CAA CDNSKEY CDS CERT CNAME DHCID DLV DNAME DS HIP IPSECKEY IXFR KEY KX LOC MX NAPTR NSEC3PARAM NSEC3 NSEC NS OPT PTR RRSIG RP SIG SOA SRV SSHFP TA TKEY TLSA TSIG TXT AAAA A".split()


def bind_query(*, type_: str = "bind.query", payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    """A line of BIND's query log."""
    kinds = "|".join(BIND_TYPES) + r"|\*"
    pattern = rf"^(\d\d-[A-Z][a-z]{{2}}-\d{{4}} \d\d:\d\d:\d\d)\.\d{{3}} (?:\S+: )*?client (?:@0x[0-9a-f]+ )?([0-9.]+)#(\d{{0,5}}) \(((?:[A-Za-z0-9_-]+\.)*[A-Za-z0-9_-]+)\): query: (?:([A-Za-z0-9_-]+)\.)?(\S+) (IN|CH|HS) ({kinds}) ([+EDSCT-]+) \(([0-9.]+)\)[\s\S]*$"
    def build(ok: Column, found: list[Column]) -> Column:
        part = lambda k: found[k - 1]
        flags = F.transform(F.filter(F.split(part(9), ""), lambda c: c != ""), lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in BIND_FLAGS.items() for x in kv]), c))
        kind = F.when(part(8) == "DLV", F.lit("DLC")).otherwise(part(8))
        bag = [M.field("ClientIP", part(2), "string", "ipv4"), M.field("FullQuery", part(4), "string"), M.field("QueryName", F.nullif(part(5), F.lit("")), "string"), M.field("QueryDomain", part(6), "string"), M.field("RecordClass", part(7), "string"), M.field("RecordType", kind, "string"), M.field("QueryFlags", flags, "string", is_array=True), M.field("ServerRespondingIP", part(10), "string", "ipv4")]
        return decoded(ok, M.fields(*bag), timestamp=X.timestamp(part(1), "dd-MMM-yyyy HH:mm:ss", fallback=False), type=F.lit(type_), payload=F.col(text) if payload_keep else F.lit(""))

    return captured(text, pattern, 10, build)


def container_event(*, text: str = PAYLOAD) -> Column:
    """A container engine's event as JSON: fields ID, Status, From and Time."""
    top = F.from_json(F.col(text), "id string, status string, `from` string, time bigint")
    bag = M.fields(M.field("ID", top["id"], "string"), M.field("Status", top["status"], "string"), M.field("From", top["from"], "string"), M.field("Time", top["time"], "integer"))
    shown = {"id": top["id"], "status": top["status"], "from": F.coalesce(top["from"], F.lit("")), "time": F.coalesce(top["time"], F.lit(0)).cast("string")}
    words = F.concat_ws(" ", *[F.concat(F.lit(f"{n}:"), c) for n, c in shown.items()])
    return decoded(top["id"].isNotNull() & top["status"].isNotNull(), bag, type=F.lit("DockerEvent"), payload=words, timestamp=top["time"] * 1_000_000_000)


def container_stats(*, text: str = PAYLOAD) -> Column:
    """A container's statistics, left as JSON in the payload, at the time they were read."""
    top = F.from_json(F.col(text), "read string, name string")
    return decoded(top["read"].isNotNull(), M.fields(M.field("ContainerName", F.ltrim(top["name"], F.lit("/")), "string")), type=F.lit("DockerStats"), payload=F.col(text), timestamp=X.timestamp(top["read"], "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", fallback=False))


# /proc and /sys


def load_average(*, payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    return _numbers(r"^(\d+\.?\d*) (\d+\.?\d*) (\d+\.?\d*) (\d+)/\d+ \d+\n", ["1MinAvg", "5MinAvg", "15MinAvg", "NumProcesses"], "stats.loadavg", payload_keep, text, ["FilePath"])


DISK_COLUMNS = ["ReadsCompleted", "ReadsMerged", "SectorsRead", "TimeReading", "WritesCompleted", "WritesMerged", "SectorsWritten", "TimeWriting", "NumIOInProgress", "TimeDoingIO", "WeightedTimeDoingIO"]


def disk_stats(*, payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    return _numbers("^" + r"\s*(\d+)" * 11 + r"\n", DISK_COLUMNS, "stats.diskstats", payload_keep, text, ["FilePath", "TickerInterval"])


def _pairs(pattern: str, make: Callable[[Column], Column], text: str) -> Column:
    return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), make)


def memory_stats(*, payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    """name: value [kB] lines as doubles with their unit."""
    line = r"([^:\n]+):\s+(\d+)( kB)?\n"

    def one(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, line, k)
        return M.field(part(1), part(2).try_cast("double"), "double").withField("representation", F.trim(part(3)))

    return decoded(F.col(text).rlike("^" + line), F.concat(_pairs(line, one, text), _copied(["FilePath"])), type=F.lit("stats.memstats"), payload=F.col(text) if payload_keep else F.lit(""))


def proc_stats(*, payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    """Each key of /proc/stat with its numbers as one field."""
    line = r"(?:^|\n)(\w+) +([0-9 ]+)"
    make = lambda x: M.field(F.regexp_extract(x, line, 1), F.transform(F.split(F.trim(F.regexp_extract(x, line, 2)), " +"), lambda n: n.try_cast("double")), "double", is_array=True)
    return decoded(F.col(text).rlike(r"^\w+ +\d"), _pairs(line, make, text), type=F.lit("stats.procstat"), payload=F.col(text) if payload_keep else F.lit(""))


def net_stats(*, payload_keep: bool = False, text: str = PAYLOAD) -> Column:
    """Pairs of a line of names and a line of numbers, as integers named protocol_name."""
    pair = r"([A-Za-z0-9]+):((?: [A-Za-z0-9]+)+)\n\1:((?: \d+)+)\n"

    def one(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, pair, k)
        names, values = F.split(F.trim(part(2)), " "), F.split(F.trim(part(3)), " ")
        return F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda z: M.field(F.concat(part(1), F.lit("_"), z["n"]), z["v"].try_cast("bigint"), "integer"))

    return decoded(F.col(text).rlike("^" + pair), F.concat(F.flatten(_pairs(pair, one, text)), _copied(["FilePath"])), type=F.lit("stats.netstat"), payload=F.col(text) if payload_keep else F.lit(""))


def net_devices(df: DataFrame, keep: Sequence[str] = (), text: str = PAYLOAD) -> DataFrame:
    """A message for each network device: its counters as integers named receive_ and transmit_ by the header."""
    lines = F.split(F.col(text), "\n")
    heads = F.split(F.get(lines, F.lit(1)), r"\|")
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    named = lambda prefix, k: F.transform(words(F.get(heads, F.lit(k))), lambda w: F.concat(F.lit(prefix), w))
    row = r"^\s*([a-z0-9]+):\s*([0-9 ]+)$"
    rows = df.where(F.col(text).rlike(r"^Inter-\|")).withColumn("_names", F.concat(named("receive_", 1), named("transmit_", 2))).withColumn("_line", F.explode(F.slice(lines, F.lit(3), F.size(lines)))).where(F.col("_line").rlike(row))
    numbers = words(F.regexp_extract("_line", row, 2))
    made = F.transform(F.arrays_zip(F.col("_names").alias("n"), numbers.alias("v")), lambda z: M.field(z["n"], z["v"].try_cast("bigint"), "integer"))
    bag = F.concat(_copied(["FilePath"]), made, F.array(M.field("netdevice", F.regexp_extract("_line", row, 1), "string")))
    return rows.select(*[F.lit("stats.netdev").alias("type") if n == "type" else F.lit("").alias("payload") if n == "payload" else F.col(n) for n in M.ENVELOPE], bag.alias("fields"), *keep)


def stats_to_fields(df: DataFrame, key: str, text: str = PAYLOAD) -> DataFrame:
    """key, timestamp (s), is_main, names and values: stat lines by their time.

    The message itself is the first time's and holds all lines; each other
    time makes a message of its own.  A bad line fails the message.
    """
    lines = df.select(key, F.posexplode(F.filter(F.split(F.col(text), "\n"), lambda l: F.trim(l) != "")).alias("_p", "_l"))
    part = F.split(F.trim("_l"), r"\s+")
    read = lines.select(key, "_p", F.get(part, F.lit(0)).alias("_n"), F.get(part, F.lit(1)).try_cast("double").alias("_v"), F.get(part, F.lit(2)).try_cast("bigint").alias("_t"), (F.size(part) == 3).alias("_three"))
    good = F.col("_three") & F.col("_v").isNotNull() & F.col("_t").between(0, (1 << 32) - 1)
    by_message = read.groupBy(key).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_ok"), F.array_sort(F.collect_list(F.struct("_p", "_n", "_v", "_t"))).alias("_rows")).where("_ok")
    first = F.get(F.col("_rows"), F.lit(0))["_t"]
    times = F.array_distinct(F.transform("_rows", lambda r: r["_t"]))
    each = by_message.select(key, first.alias("_first"), "_rows", F.explode(times).alias("timestamp"))
    own = F.when(F.col("timestamp") == F.col("_first"), F.col("_rows")).otherwise(F.filter("_rows", lambda r: r["_t"] == F.col("timestamp")))
    return each.select(key, "timestamp", (F.col("timestamp") == F.col("_first")).alias("is_main"), F.transform(own, lambda r: r["_n"]).alias("names"), F.transform(own, lambda r: r["_v"]).alias("values"))


def geo_ip(df: DataFrame, ranges: DataFrame, *, source: str = "remote_addr", target: str = "geoip", max_rows: int = 5_000_000) -> DataFrame:
    """df with a JSON bytes field of the address' place; messages without an address, or with an unknown one, stay as they are.

    ranges: low, high (addresses as numbers, not overlapping) and any columns.
    The first 16 bits of an address join the ranges that touch that block, so
    it is an equi-join whether the ranges are broadcast (up to max_rows) or not.
    """
    details = [c for c in ranges.columns if c not in ("low", "high")]
    block = F.explode(F.sequence(F.shiftright("low", 16), F.shiftright("high", 16)))
    places = ranges.select("low", "high", F.to_json(F.struct(*details)).alias("_place"), block.alias("_block"))
    if places.limit(max_rows + 1).count() <= max_rows:
        places = F.broadcast(places)
    addressed = df.withColumn("_ip", X.ipv4(M.value(source, "string"))).withColumn("_block", F.shiftright("_ip", 16))
    on = (addressed["_block"] == places["_block"]) & (F.col("_ip") >= F.col("low")) & (F.col("_ip") <= F.col("high"))
    joined = addressed.join(places, on, "left")
    added = F.array_append("fields", M.field(target, F.col("_place").cast("binary"), "bytes"))
    return joined.withColumn("fields", F.when(F.col("_place").isNotNull(), added).otherwise(F.col("fields"))).select(*df.columns)
