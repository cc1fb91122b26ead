"""The message matcher: a predicate as text, turned into a Spark column.

Only the terms of the language are read here.  Each becomes a SQL condition
that is never null; the operators and brackets between them are SQL's own, so
Spark parses the whole, and Catalyst folds, prunes and pushes it down.

    Type == 'error' && (Fields[value] > 50 || Payload =~ /^fatal/)
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import message as M
from ..functions.regex import plain_affix, to_java

TEXT = {"Uuid": "", "Type": "type", "Logger": "logger", "Payload": "payload", "EnvVersion": "env_version", "Hostname": "hostname"}
NUMBERS = {"Timestamp": "timestamp", "Severity": "severity", "Pid": "pid"}
_TERM = re.compile(
    r"""\s*(?:
    (?P<field>Fields\[(?P<name>[^\]]+)\](?:\[(?P<fi>\d+)\])?(?:\[(?P<ai>\d+)\])?)\s*(?P<fop>==|!=|>=|<=|>|<|=~|!~)\s*
    |(?P<var>[A-Z][A-Za-z]+)\s*(?P<vop>==|!=|>=|<=|>|<|=~|!~)\s*
    |(?P<constant>TRUE|FALSE)(?![\w])
    |(?P<joint>&&|\|\||\(|\))
    )""",
    re.X,
)
_VALUE = re.compile(r"""'(?P<one>(?:\\.|[^'\\])*)'|"(?P<two>(?:\\.|[^"\\])*)"|/(?P<re>(?:\\.|[^/\\])+)/|(?P<num>[0-9.][0-9.eE+-]*)|(?P<word>NIL|TRUE|FALSE)(?!\w)""", re.S)


class MatcherError(ValueError):
    pass


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(text: str) -> float:
    """A number's value; one that is unreadable or out of range counts as 0."""
    try:
        value = float(text)
    except ValueError:
        return 0.0
    return value if math.isfinite(value) else 0.0


def _checked(java: str) -> None:
    """An error now, and not in the first task, if the pattern is none."""
    context = SparkContext._active_spark_context
    if context is not None:
        context._jvm.java.util.regex.Pattern.compile(java)


def _text_test(sql: str, op: str, value: re.Match) -> str:
    """A condition on text; numbers never match."""
    if value["num"] is not None:
        return "false"
    if value["re"] is not None:
        pattern = value["re"].replace("\\/", "/")
        try:
            java = to_java(pattern)
            _checked(java)
        except (ValueError, KeyError, IllegalArgumentException) as e:
            raise MatcherError(f"{pattern}: {str(e).splitlines()[0]}") from e
        affix = plain_affix(pattern)
        found = f"{affix[0]}({sql}, {_quoted(affix[1])})" if affix else f"rlike({sql}, {_quoted(java)})"
        return found if op == "=~" else f"NOT {found}"
    quote = "'" if value["one"] is not None else '"'
    raw = value["one"] if value["one"] is not None else value["two"]
    literal = value["word"] if value["word"] is not None else raw.replace("\\" + quote, quote)
    return f"{sql} {'=' if op == '==' else op} {_quoted(literal)}"


def _number_test(sql: str, op: str, value: re.Match, *, may_be_nan: bool = False) -> str:
    """A condition on doubles; text never matches, and no comparison with NaN but != holds."""
    if value["num"] is None:
        return "false"
    test = f"cast({sql} as double) {'=' if op == '==' else op} {_number(value['num'])!r}D"
    if may_be_nan:
        return f"({test} OR isnan({sql}))" if op == "!=" else f"({test} AND NOT isnan({sql}))"
    return test


def _field_test(name: str, fi: int, ai: int, op: str, value: re.Match) -> str:
    element = f"get(filter(fields, f -> f.name = {_quoted(name)}), {fi})"
    at = lambda column: f"get({element}.{column}, {ai})"
    values = [at(c) for c in ("value_string", "value_bytes", "value_integer", "value_double", "value_bool")]
    if value["word"] == "NIL":
        exists = " OR ".join(f"{v} IS NOT NULL" for v in values)
        return f"NOT ({exists})" if op == "==" else f"({exists})"
    wanted = "true" if value["word"] == "TRUE" else "false"  # a truth value against anything else tests for false
    tests = [_text_test(values[0], op, value), _text_test(f"cast({values[1]} as string)", op, value), _number_test(values[2], op, value), _number_test(values[3], op, value, may_be_nan=True), f"{values[4]} = {wanted}"]
    branches = " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(tests) if t != "false")
    return f"coalesce(CASE {element}.value_type {branches} ELSE false END, false)"


def _column_test(column: str, kind: str, op: str, value: re.Match) -> str:
    """The same for a field that is a column of one value: a plain comparison, which reaches the scan."""
    if value["word"] == "NIL":
        return f"{column} IS {'' if op == '==' else 'NOT '}NULL"
    if kind in ("string", "bytes"):
        test = _text_test(column if kind == "string" else f"cast({column} as string)", op, value)
    elif kind == "double":
        test = _number_test(column, op, value, may_be_nan=True)
    elif kind == "integer":
        number = _number(value["num"]) if value["num"] is not None else math.nan
        whole = number.is_integer() and abs(number) < 1 << 53  # then both compare alike
        test = f"{column} {'=' if op == '==' else op} {int(number)}L" if whole else _number_test(column, op, value)
    else:
        test = f"{column} = {'true' if value['word'] == 'TRUE' else 'false'}"
    return "false" if test == "false" else f"{column} IS NOT NULL AND {test}"


def to_sql(spec: str, columns: Mapping[str, tuple[str, str]] | None = None) -> str:
    """The matcher as a Spark SQL condition; MatcherError if it is malformed.

    columns: fields that are columns of one value each, as (column, type).
    """
    spec = spec.split("\n", 1)[0].strip()
    if not spec:
        raise MatcherError("empty matcher")
    out, at = [], 0
    while spec[at:].strip():
        m = _TERM.match(spec, at)
        if not m:
            raise MatcherError(f"unreadable at {at}: {spec}")
        at = m.end()
        if m["joint"]:
            out.append({"&&": "AND", "||": "OR"}.get(m["joint"], m["joint"]))
            continue
        if m["constant"]:
            out.append(f"({m['constant'].lower()})")
            continue
        value, op = _VALUE.match(spec, at), m["fop"] or m["vop"]
        if not value:
            raise MatcherError(f"no value at {at}: {spec}")
        at = value.end()
        is_regex = value["re"] is not None
        if is_regex != (op in ("=~", "!~")):
            raise MatcherError(f"{op} goes with {'a pattern' if not is_regex else 'no pattern'}: {spec}")
        if value["word"] == "NIL" and (not m["field"] or op not in ("==", "!=")):
            raise MatcherError(f"NIL tests fields only, by == and !=: {spec}")
        if m["field"]:
            first = not int(m["fi"] or 0) and not int(m["ai"] or 0)
            if columns is None:
                test = _field_test(m["name"], int(m["fi"] or 0), int(m["ai"] or 0), op, value)
            elif m["name"] in columns and first:
                test = _column_test(*columns[m["name"]], op, value)
            else:  # there is no such value
                test = "true" if value["word"] == "NIL" and op == "==" else "false"
            out.append(f"({test})")
        elif m["var"] in TEXT:
            if value["num"] is not None or value["word"]:
                raise MatcherError(f"{m['var']} is text: {spec}")
            column = TEXT[m["var"]] or "CASE WHEN octet_length(uuid) = 16 THEN concat_ws('-', substr(lower(hex(uuid)), 1, 8), substr(lower(hex(uuid)), 9, 4), substr(lower(hex(uuid)), 13, 4), substr(lower(hex(uuid)), 17, 4), substr(lower(hex(uuid)), 21, 12)) ELSE '' END"
            out.append("(" + _text_test(column, op, value) + ")")
        elif m["var"] in NUMBERS:
            if value["num"] is None:
                raise MatcherError(f"{m['var']} is a number: {spec}")
            out.append("(" + _number_test(NUMBERS[m["var"]], op, value) + ")")
        else:
            raise MatcherError(f"unknown variable {m['var']}: {spec}")
    depth = 0
    for part in out:
        depth += (part == "(") - (part == ")")
        if depth < 0:
            break
    if depth:
        raise MatcherError(f"unmatched bracket: {spec}")
    for left, right in zip(["(", *out], [*out, ")"], strict=True):
        if left in ("AND", "OR", "(") and right in ("AND", "OR", ")"):
            raise MatcherError(f"no term beside an operator: {spec}")
    for left, right in zip(out, out[1:], strict=False):
        if left not in ("AND", "OR", "(") and right not in ("AND", "OR", ")"):
            raise MatcherError(f"no operator between two terms: {spec}")
    return " ".join(out)


def compile(spec: str, columns: Mapping[str, tuple[str, str]] | None = None) -> Column:  # noqa: A001
    """The matcher as a boolean column over messages; with columns (a field's name to its column and type),
    over rows that have the envelope and each field as a column of its own."""
    sql = to_sql(spec, columns)
    try:
        return F.expr(sql)
    except ParseException as e:
        raise MatcherError(f"{spec}: {e.getMessage() if hasattr(e, 'getMessage') else e}") from e


def from_columns(df: DataFrame, spec: str, sources: Mapping[str, tuple[Column, str]], *, extra: Sequence[str] = (), **envelope) -> DataFrame:
    """The messages that the matcher chooses of a table whose columns become fields: {name: (column, type)}.

    The choice is made over the columns, so that its comparisons reach the
    scan, and fields are built of what is left.  Further options are those of
    message.messages.
    """
    held = {name: f"_field_{k}" for k, name in enumerate(sources)}
    flat = M.messages(df.withColumns({held[n]: c for n, (c, _) in sources.items()}), extra=[*extra, *held.values()], **envelope)
    chosen = flat.where(compile(spec, {n: (held[n], kind) for n, (_, kind) in sources.items()}))
    bag = M.fields(*[M.field(n, F.col(held[n]), kind) for n, (_, kind) in sources.items()])
    return chosen.select(*M.ENVELOPE, bag.alias("fields"), *extra)


def match(df: DataFrame, spec: str, *, signer: str | None = None) -> DataFrame:
    """The messages that the matcher and, if named, the verified signer choose."""
    found = df.where(compile(spec))
    return found.where(F.col("signer") == signer) if signer else found


def route(df: DataFrame, routes: dict[str, str]) -> DataFrame:
    """A row for each message and route that wants it, with the route's name: one scan, all predicates in one pass."""
    wanted = F.array(*[F.when(compile(spec), F.lit(name)) for name, spec in routes.items()])
    return df.withColumn("route", F.explode(F.filter(wanted, lambda r: r.isNotNull())))


def reinjected(made: DataFrame, spec: str, *, max_loops: int = 4) -> DataFrame:
    """What a filter emits, less what it would match itself and what has gone round too often."""
    again = made.where(~compile(spec))
    return again.withColumn("loop_count", F.col("loop_count") + 1).where(F.col("loop_count") <= max_loops) if "loop_count" in made.columns else again


def injected(made: DataFrame, name: str, *, hostname: str = "", prefix: str = "sandbox.") -> DataFrame:
    """What a user's filter of that name emits, as it may enter the flow: its type has the prefix, and
    logger and hostname are the flow's own, whatever the filter set."""
    return made.withColumns({"type": F.concat(F.lit(prefix), F.col("type")), "logger": F.lit(name), "hostname": F.lit(hostname)})


def limited(made: DataFrame, occasion: Sequence[str], *, most: int) -> DataFrame:
    """made, or an error when it is evaluated if one occasion (a message or a tick) has more than `most`
    rows: a filter that floods the flow is ended, and nothing of it is dropped quietly."""
    counts = made.groupBy(*occasion).agg(F.count(F.lit(1)).alias("_n"))
    fine = F.when(F.col("_n") <= most, F.lit(True)).otherwise(F.raise_error(F.lit(f"more than {most} messages were injected at once")).cast("boolean"))
    return made.join(counts.where(fine).select(*occasion), list(occasion), "left_semi")


def in_set(df: DataFrame, hosts: list[str], output: str) -> DataFrame:
    """Messages of the given hosts, with the name of the output that takes them."""
    return df.where(F.col("hostname").isin(hosts)).withColumn("output", F.lit(output))


def fan_out(routes: dict[str, tuple[str, Callable[[DataFrame], None]]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: {name: (matcher, write)}; the batch is computed once and each consumer gets what it wants."""

    def run(batch: DataFrame, epoch: int = 0) -> None:
        flags = {f"_r{k}": compile(spec) for k, (spec, _) in enumerate(routes.values())}
        marked = batch.withColumns(flags).persist()
        try:
            for k, (_, write) in enumerate(routes.values()):
                write(marked.where(F.col(f"_r{k}")).select(*batch.columns))
        finally:
            marked.unpersist()

    return run
