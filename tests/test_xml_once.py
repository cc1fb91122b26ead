"""All paths of an XML decoder come from one parse of the document, and as they came one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.operators import decoders as D

ROWS = [(1, '<r host="h1"><kind>a</kind><n><k>5</k><k>6</k></n><e/></r>'), (2, "<r><kind> t&#233;xt true </kind></r>"), (3, None), (4, ""), (5, '<r host=""><n><k>7</k></n></r>')]
PATHS = {"host": "/r/@host", "kind": "/r/kind", "k": "/r/n/k", "none": "/r/other"}


def _messages(spark):
    return M.messages(spark.createDataFrame(ROWS, "id int, p string"), extra=["id"], payload=F.col("p"))


def test_a_document_is_parsed_once(spark):
    read = D.decode(_messages(spark), D.payload_xml(PATHS, {k: f"%{k}%" for k in PATHS}), keep=["id"])
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("XPath") == 1, plan
    got = {r.id: [r[k] for k in PATHS] for r in read.select("id", *[M.text(k).alias(k) for k in PATHS]).collect()}
    none = [f"<{k}>" for k in PATHS]
    assert got == {1: ["h1", "a", "5", "<none>"], 2: ["<host>", " téxt true ", "<k>", "<none>"], 3: none, 4: none, 5: ["", "<kind>", "7", "<none>"]}


def test_many_and_grouped_paths_agree_with_single_ones(spark):
    paths = {f"p{k}": p for k, p in enumerate([*PATHS.values(), "count(/r/n/k)", "/r/n/k[2]", "/r/e", "", "/r/n/k[. > 5][last()]", "/r/kind | /r/n/k", "contains(/r/kind, ',')", "//k[position() = 1 or . = 6]", *[f"/r/n/k[. = {k}]" for k in range(8)], "(((((/r/n/k)))))"])}
    read = D.decode(_messages(spark), D.payload_xml(paths, {n: f"%{n}%" for n in paths}), keep=["id"])
    got = {r.id: [r[n] for n in paths] for r in read.select("id", *[M.text(n).alias(n) for n in paths]).collect()}
    want = _messages(spark).select("id", *[(F.coalesce(F.when(F.xpath_boolean("payload", F.lit(p)), F.xpath_string("payload", F.lit(p))), F.lit(f"<{n}>"))).alias(n) for n, p in paths.items()])
    assert got == {r.id: [r[n] for n in paths] for r in want.collect()}
