"""The message model: a fixed envelope and an ordered list of typed fields.

Field names may repeat and their order counts, so fields are an array of
structs and not a map.  Timestamps are nanoseconds since the epoch in a long;
Spark's own timestamps have microseconds only.  The envelope is never null:
unset text is '', an unset severity 7 and an unset pid 0, so predicates have
two truth values.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The wire numbers of the value types.
STRING, BYTES, INTEGER, DOUBLE, BOOL = range(5)
VALUE_COLUMNS = {STRING: ("value_string", "string"), BYTES: ("value_bytes", "binary"), INTEGER: ("value_integer", "bigint"), DOUBLE: ("value_double", "double"), BOOL: ("value_bool", "boolean")}
TYPE_NAMES = {"string": STRING, "bytes": BYTES, "integer": INTEGER, "double": DOUBLE, "bool": BOOL}

FIELD_DDL = "struct<name:string,value_type:tinyint,representation:string,value_string:array<string>,value_bytes:array<binary>,value_integer:array<bigint>,value_double:array<double>,value_bool:array<boolean>>"
ENVELOPE = {"uuid": "binary", "timestamp": "bigint", "type": "string", "logger": "string", "severity": "int", "payload": "string", "env_version": "string", "pid": "int", "hostname": "string"}
DEFAULTS = {"uuid": "x''", "timestamp": "0L", "type": "''", "logger": "''", "severity": "7", "payload": "''", "env_version": "''", "pid": "0", "hostname": "''"}
MESSAGE_DDL = ", ".join([f"{k} {v}" for k, v in ENVELOPE.items()] + [f"fields array<{FIELD_DDL}>"])
SEVERITY_DEFAULT = 7


def schema() -> T.StructType:
    return T.StructType.fromDDL(MESSAGE_DDL)


def field(name: str | Column, value: Column, kind: int | str, representation: str = "", *, is_array: bool = False) -> Column:
    """A field struct with one value, or with the values of an array column."""
    kind = TYPE_NAMES[kind] if isinstance(kind, str) else kind
    parts = [(name if isinstance(name, Column) else F.lit(name)).alias("name"), F.lit(kind).cast("tinyint").alias("value_type"), F.lit(representation).alias("representation")]
    for k, (column, sql) in VALUE_COLUMNS.items():
        values = (value if is_array else F.array(value)).cast(f"array<{sql}>") if k == kind else F.lit(None).cast(f"array<{sql}>")
        parts.append(values.alias(column))
    return F.struct(*parts)


def fields(*made: Column) -> Column:
    """An array of fields; those whose first value is null are left out."""
    first = lambda f: F.coalesce(*[F.get(f[c], F.lit(0)).cast("string") for c, _ in VALUE_COLUMNS.values()])
    return F.filter(F.array(*made), lambda f: first(f).isNotNull())


def messages(df: DataFrame, *, extra: list[str] | None = None, required: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """df as messages: each named envelope column and `fields`, defaults for the rest, and extra columns kept.

    Columns in `required` are never null in the source and are taken as they
    are, so that predicates on them reach the scan.
    """
    out = []
    for name, sql in ENVELOPE.items():
        given = columns.get(name)
        default = F.expr(DEFAULTS[name]).cast(sql)
        out.append((default if given is None else given.cast(sql) if name in required else F.coalesce(given.cast(sql), default)).alias(name))
    bag = columns.get("fields")
    empty = F.array().cast(f"array<{FIELD_DDL}>")
    out.append((empty if bag is None else F.coalesce(bag, empty)).alias("fields"))
    return df.select(*out, *(extra or []))


# Accessors


def find(name: str, index: int = 0, bag: str | Column = "fields") -> Column:
    """The index-th field of that name, null if there is none."""
    return F.get(F.filter(bag, lambda f: f["name"] == F.lit(name)), F.lit(index))


def find_all(name: str, bag: str | Column = "fields") -> Column:
    return F.filter(bag, lambda f: f["name"] == F.lit(name))


def value(name: str, kind: int | str, index: int = 0, element: int = 0) -> Column:
    """A typed value of a field; null if missing or of another type."""
    kind = TYPE_NAMES[kind] if isinstance(kind, str) else kind
    return F.get(find(name, index)[VALUE_COLUMNS[kind][0]], F.lit(element))


def number(name: str, index: int = 0, element: int = 0) -> Column:
    """A numeric field as a double, whether it was stored as an integer or a double."""
    found = find(name, index)
    return F.coalesce(F.get(found["value_double"], F.lit(element)), F.get(found["value_integer"], F.lit(element)).cast("double"))


def text(name: str, index: int = 0, element: int = 0) -> Column:
    """A field as text ('' if missing): integers in decimal, doubles in shortest form, booleans as true and false."""
    found = find(name, index)
    at = lambda c: F.get(found[c], F.lit(element))
    return F.coalesce(at("value_string"), at("value_bytes").cast("string"), at("value_integer").cast("string"), shortest(at("value_double")), at("value_bool").cast("string"), F.lit(""))


def shortest(x: Column) -> Column:
    """A double without a needless '.0'."""
    plain = F.abs(x) < F.lit(1e15)
    return F.when((x == F.floor(x)) & plain, F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def general(x: Column) -> Column:
    """A double in the shortest form that reads back, with an exponent of two digits below 1e-4 and from 1e6 on."""
    plain = x.cast("string")
    part = lambda k: F.regexp_extract(plain, r"^(-?)(\d+)\.(\d+)(?:E(-?\d+))?$", k)
    digits = F.regexp_replace(F.concat(part(2), part(3)), r"^0+|0+$", "")
    power = F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0))
    # Java writes an exponent from 1e7 on and below 1e-3, so only 1e6 to 1e7 and 1e-4 to 1e-3 are turned over.
    exponent = F.when(part(4) != "", power).otherwise(F.length(part(2)) - 1)
    raised = F.concat(part(1), F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit("")), F.lit("e"), F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")), F.format_string("%02d", F.abs(exponent)))
    low = F.concat(part(1), F.lit("0.000"), digits)
    size = F.abs(x)
    special = F.when(F.isnan(x), F.lit("NaN")).when(x == F.lit(float("inf")), F.lit("+Inf")).when(x == F.lit(float("-inf")), F.lit("-Inf"))
    shown = F.when(x == 0, F.lit("0")).when((size >= 1e6) | (size < 1e-4), raised).when(size < 1e-3, low).otherwise(F.regexp_replace(plain, r"\.0$", ""))
    return F.coalesce(special, shown)


def variable(name: str) -> Column:
    """A message variable as text, '' if it is missing: Type, Logger, Hostname, Payload, or Fields[name][index][element]."""
    if name in ("Type", "Logger", "Hostname", "Payload"):
        return F.col(name.lower())
    found = re.fullmatch(r"Fields\[([^\]]+)\](?:\[(\d+)\])?(?:\[(\d+)\])?", name)
    if not found:
        raise ValueError(f"no message variable: {name}")
    of = find(found[1], int(found[2] or 0))
    at = lambda c: F.get(of[c], F.lit(int(found[3] or 0)))
    return F.coalesce(at("value_string"), at("value_bytes").cast("string"), at("value_integer").cast("string"), general(at("value_double")), at("value_bool").cast("string"), F.lit(""))


def with_field(added: Column) -> Column:
    return F.array_append("fields", added)


def without_field(name: str, index: int = 0) -> Column:
    """fields less the index-th field of that name; unchanged if there is none."""
    place = F.get(F.filter(F.transform("fields", lambda f, i: F.when(f["name"] == F.lit(name), i)), lambda i: i.isNotNull()), F.lit(index))
    return F.filter("fields", lambda f, i: F.coalesce(i != place, F.lit(True)))


def with_value(name: str, kind: int | str, new: Column, index: int = 0, element: int = 0) -> Column:
    """fields with one element overwritten, or the value list extended by exactly one."""
    kind = TYPE_NAMES[kind] if isinstance(kind, str) else kind
    column = VALUE_COLUMNS[kind][0]
    place = F.get(F.filter(F.transform("fields", lambda f, i: F.when(f["name"] == F.lit(name), i)), lambda i: i.isNotNull()), F.lit(index))

    def put(f: Column, i: Column) -> Column:
        values = f[column]
        longer = F.when(F.size(values) == element, F.array_append(values, new)).otherwise(F.transform(values, lambda v, k: F.when(k == element, new).otherwise(v)))
        return F.when((i == place) & (f["value_type"] == kind), f.withField(column, longer)).otherwise(f)

    return F.transform("fields", put)


def uuid_text(column: str = "uuid") -> Column:
    """8-4-4-4-12 lowercase hex; '' unless there are exactly 16 bytes."""
    h = F.lower(F.hex(column))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.octet_length(column) == 16, F.concat_ws("-", *parts)).otherwise(F.lit(""))


def stable_uuid(*keys: Column) -> Column:
    """A uuid that a repeated task makes again: the MD5 of the keys."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[k.cast("string") for k in keys])))


def wide(df: DataFrame, columns: Mapping[str, int | str]) -> DataFrame:
    """df with the first value of each named field as a plain column, which Catalyst can prune and push down."""
    return df.withColumns({name: value(name, kind) for name, kind in columns.items()})


def micros(ntz: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ntz)


def bucket(seconds: int, ns: str | Column = "timestamp") -> Column:
    """The start, in whole seconds since the epoch, of the tumbling window that holds the time."""
    ns = F.col(ns) if isinstance(ns, str) else ns
    return ((ns - F.pmod(ns, F.lit(seconds * 1_000_000_000).cast("bigint"))) / F.lit(1_000_000_000)).cast("bigint")
