"""Splitters: texts or bytes to records, as rows in order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regex import to_java

MAX_RECORD = 64 * 1024


def _exploded(df: DataFrame, records: Column, keep_truncated: bool, max_record: int | None) -> DataFrame:
    """df with seq and record: a row a record, those over the limit cut or dropped."""
    rows = df.select("*", F.posexplode(records).alias("seq", "record"))
    if max_record is None:
        return rows
    if keep_truncated:
        return rows.withColumn("record", F.when(F.octet_length("record") > max_record, F.substring(F.col("record").cast("binary"), 1, max_record).cast("string")).otherwise(F.col("record")))
    return rows.where(F.octet_length("record") <= max_record)


def whole(df: DataFrame, text: str, **limits) -> DataFrame:
    """The whole text is one record."""
    return _exploded(df, F.array(F.col(text)), limits.get("keep_truncated", False), limits.get("max_record"))


def token(df: DataFrame, text: str, *, delimiter: str = "\n", count: int = 1, deliver_incomplete_final: bool = False, keep_truncated: bool = False, max_record: int | None = None) -> DataFrame:
    """Records of `count` delimiters each, which they keep; what follows the last is a record only if asked for."""
    if len(delimiter.encode()) != 1:
        raise ValueError("the delimiter must be a single byte")
    parts = F.split(F.col(text), re.escape(delimiter))
    n = F.size(parts) - 1
    whole_groups = F.floor(n / count).cast("int")
    joined = lambda g: F.concat(F.array_join(F.slice(parts, g * count + 1, F.lit(count)), delimiter), F.lit(delimiter))
    records = F.when(whole_groups > 0, F.transform(F.sequence(F.lit(0), F.greatest(whole_groups - 1, F.lit(0))), joined)).otherwise(F.array().cast("array<string>"))
    if deliver_incomplete_final:
        rest = F.array_join(F.slice(parts, whole_groups * count + 1, F.size(parts)), delimiter)
        records = F.when(rest != "", F.array_append(records, rest)).otherwise(records)
    return _exploded(df, records, keep_truncated, max_record)


def regex(df: DataFrame, text: str, delimiter: str, *, delimiter_eol: bool = True, deliver_incomplete_final: bool = False, keep_truncated: bool = False, max_record: int | None = None) -> DataFrame:
    """Records between matches.  Without a group the match is dropped; a group's capture ends the
    record before it, or with delimiter_eol=False begins the next one."""
    groups = re.compile(delimiter).groups
    if groups > 1:
        raise ValueError("a delimiter has at most one capture group")
    java = to_java(delimiter)
    if not groups:
        parts = F.split(F.col(text), java)
        marked = F.transform(parts, lambda p: p)
    else:  # each match holds a record and the delimiter after it, and the next begins where it ends
        each = rf"([\s\S]*?)(?:{java})"
        found = lambda k: F.regexp_extract_all(F.col(text), F.lit(each), F.lit(k))
        length = F.aggregate(found(0), F.lit(0), lambda n, x: n + F.length(x))
        rest = F.array(F.substring(F.col(text), length + 1, F.length(text)))
        before, captured, none = F.concat(found(1), rest), found(2), F.array(F.lit(""))
        marked = F.zip_with(before, F.concat(captured, none) if delimiter_eol else F.concat(none, captured), (lambda r, c: F.concat(r, c)) if delimiter_eol else (lambda r, c: F.concat(c, r)))
    last = F.size(marked)
    records = marked if deliver_incomplete_final else F.slice(marked, 1, F.greatest(last - 1, F.lit(0)))
    return _exploded(df, F.filter(records, lambda r: r != "") if groups else records, keep_truncated, max_record)


def pattern_groups(df: DataFrame, key: list[str], text: str, grouping: str, *, max_lines: int = 99) -> DataFrame:
    """key, seq, record: lines that match `grouping` and follow one another are one record, up to max_lines.

    Every line keeps its line break; a last line without one is no record.
    """
    lines = df.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("_p", "_l"), (F.size(F.split(F.col(text), "\n")) - 1).alias("_n")).where(F.col("_p") < F.col("_n"))
    order = Window.partitionBy(*key).orderBy("_p")  # the lines of one text
    marked = lines.withColumn("_in", F.col("_l").rlike(to_java(grouping)))
    starts = (~F.col("_in") | ~F.coalesce(F.lag("_in").over(order), F.lit(False))).cast("int")
    grouped = marked.withColumn("_g", F.sum(starts).over(order))
    inside = Window.partitionBy(*key, "_g").orderBy("_p")
    cut = grouped.withColumn("_k", F.floor((F.row_number().over(inside) - 1) / max_lines))
    made = cut.groupBy(*key, "_g", "_k").agg(F.min("_p").alias("_at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_l"))), lambda x: x["_l"]), "\n").alias("_r"))
    return made.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy("_at")) - 1).alias("seq"), F.concat("_r", F.lit("\n")).alias("record"))
