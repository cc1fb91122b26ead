"""The matcher against a small evaluator of single messages, over random expressions and messages."""

from __future__ import annotations

import math
import operator
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.operators import matcher

OPS = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
WORDS = ["", "a", "ab", "b", "TRUE", "1", "a'b", "x\ny"]
NUMBERS = [0, 1, 5, 7, 2**53 + 1, 0.5, 1e3]
PATTERNS = ["a", "^a", "b$", "^$", "[ab]+$", "a|1", "."]


def values_of(f):
    return f[f["kind"]]


fields = st.lists(
    st.one_of(
        st.fixed_dictionaries({"name": st.sampled_from("fgh"), "kind": st.just("string"), "string": st.lists(st.sampled_from(WORDS), min_size=0, max_size=2)}),
        st.fixed_dictionaries({"name": st.sampled_from("fgh"), "kind": st.just("bytes"), "bytes": st.lists(st.sampled_from(WORDS), min_size=1, max_size=2)}),
        st.fixed_dictionaries({"name": st.sampled_from("fgh"), "kind": st.just("integer"), "integer": st.lists(st.sampled_from([0, 1, 5, -1, 2**53 + 1]), min_size=1, max_size=2)}),
        st.fixed_dictionaries({"name": st.sampled_from("fgh"), "kind": st.just("double"), "double": st.lists(st.sampled_from([0.0, 0.5, 5.0, math.nan, math.inf]), min_size=1, max_size=2)}),
        st.fixed_dictionaries({"name": st.sampled_from("fgh"), "kind": st.just("bool"), "bool": st.lists(st.booleans(), min_size=1, max_size=2)}),
    ),
    max_size=4,
)
messages = st.fixed_dictionaries({"type": st.sampled_from(WORDS), "payload": st.sampled_from(WORDS), "severity": st.integers(0, 7), "fields": fields})
literal = st.one_of(st.sampled_from([w for w in WORDS if "\n" not in w]).map(lambda w: ("text", w)), st.sampled_from(NUMBERS).map(lambda n: ("number", n)), st.sampled_from(["NIL", "TRUE", "FALSE"]).map(lambda w: ("word", w)), st.sampled_from(PATTERNS).map(lambda p: ("re", p)))


@st.composite
def terms(draw):
    kind, value = draw(literal)
    target = draw(st.sampled_from(["Type", "Payload", "Severity", "field"]))
    if target in ("Type", "Payload") and kind not in ("text", "re"):
        kind, value = "text", "a"
    if target == "Severity":
        kind, value = "number", draw(st.sampled_from([0, 3, 7, 2.5]))
    op = draw(st.sampled_from(["=~", "!~"] if kind == "re" else ["==", "!="] if value == "NIL" and kind == "word" else list(OPS)))
    where = (target, 0, 0) if target != "field" else (f"Fields[{draw(st.sampled_from('fghz'))}]", draw(st.integers(0, 1)), draw(st.integers(0, 1)))
    return ("term", where, op, kind, value)


trees = st.recursive(st.one_of(terms(), st.sampled_from([("const", True), ("const", False)])), lambda t: st.tuples(st.sampled_from(["&&", "||"]), t, t), max_leaves=5)


def text_of(t):
    if t[0] == "const":
        return "TRUE" if t[1] else "FALSE"
    if t[0] in ("&&", "||"):
        return f"({text_of(t[1])} {t[0]} {text_of(t[2])})"
    _, (name, fi, ai), op, kind, value = t
    shown = {"text": lambda: '"' + value + '"', "number": lambda: repr(value), "word": lambda: value, "re": lambda: f"/{value}/"}[kind]()
    return f"{name}{f'[{fi}][{ai}]' if name.startswith('Fields') else ''} {op} {shown}"


def holds(t, m):
    if t[0] == "const":
        return t[1]
    if t[0] in ("&&", "||"):
        return holds(t[1], m) and holds(t[2], m) if t[0] == "&&" else holds(t[1], m) or holds(t[2], m)
    _, (name, fi, ai), op, kind, value = t
    if not name.startswith("Fields"):
        return compare({"Type": m["type"], "Payload": m["payload"], "Severity": m["severity"]}[name], op, kind, value)
    found = [f for f in m["fields"] if f["name"] == name[7]]
    if fi >= len(found) or ai >= len(values_of(found[fi])):
        return kind == "word" and value == "NIL" and op == "=="
    v = values_of(found[fi])[ai]
    if kind == "word" and value == "NIL":
        return op == "!="
    if isinstance(v, bool):
        return v == (kind == "word" and value == "TRUE")
    return compare(v, op, kind, value)


def compare(v, op, kind, value):
    if isinstance(v, str):
        if kind == "number":
            return False
        if kind == "re":
            return (re.search(value.replace("$", r"\Z"), v) is not None) == (op == "=~")
        return OPS[op](v, value)
    return kind == "number" and OPS[op](float(v), float(value))


def row(m):
    out = []
    for f in m["fields"]:
        kind = M.TYPE_NAMES[f["kind"]]
        vs = [v.encode() for v in f["bytes"]] if f["kind"] == "bytes" else values_of(f)
        out.append((f["name"], kind, "", *[vs if k == kind else None for k in range(5)]))
    return (m["type"], m["payload"], m["severity"], out)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(st.lists(messages, min_size=8, max_size=8), st.lists(trees, min_size=25, max_size=25))
def test_agrees_with_the_evaluator(spark, ms, ts):
    df = spark.createDataFrame([row(m) for m in ms], f"type string, payload string, severity int, fields array<{M.FIELD_DDL}>").coalesce(1).withColumn("n", F.monotonically_increasing_id())
    got = df.orderBy("n").select(*[matcher.compile(text_of(t)).alias(f"c{i}") for i, t in enumerate(ts)]).collect()
    for m, r in zip(ms, got, strict=True):
        for i, t in enumerate(ts):
            assert r[i] is holds(t, m), (text_of(t), m)
