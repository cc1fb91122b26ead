"""The matcher's grammar, a case or two for each construct, over one order of an invented shop."""

import pytest
from pyspark.sql import functions as F

from weirline.functions import message as M
from weirline.operators import matcher

SF = "/root/testdata/sf0.001"
MALFORMED = {
    "nothing": "",
    "a bare word": "order",
    "one equals sign": "Logger = 'shop'",
    "a text without its end": "Logger == 'shop",
    "a pattern without its end": "Logger =~ /shop",
    "a bracket left open": "(Pid == 40 || Severity == 2",
    "a bracket too many": "Pid == 40)",
    "an unknown variable": "Colour == 'red'",
    "a field without a name": "Fields[] == 1",
    "a field left open": "Fields[items == 1",
    "an index that is no number": "Fields[items][first] == 1",
    "a pattern for a number": "Severity =~ /2/",
    "a comparison with a pattern": "Logger == /shop/",
    "a pattern's operator with text": "Logger =~ 'shop'",
    "text for a number": "Pid == 'forty'",
    "a number for text": "Hostname == 5",
    "nothing for a variable": "Payload == NIL",
    "an order of nothing": "Fields[items] > NIL",
    "an operator without a term": "Pid == 40 &&",
    "two terms and no operator": "Pid == 40 Severity == 2",
    "a pattern that is none": "Logger =~ /(/",
    "a group that looks ahead": "Logger =~ /a(?=b)/",
}
HOLDS = {
    "constants": ["TRUE", "FALSE || TRUE", "TRUE && TRUE"],
    "equal text": ["Logger == 'shop'", 'Logger == "shop"', "Logger != 'Shop'", r"Payload == 'it\'s 3 items'"],
    "ordered text": ["EnvVersion > '2.0'", "EnvVersion >= '2.1'", "EnvVersion < '3'", "EnvVersion <= '2.1'"],
    "numbers": ["Severity == 2", "Severity != 3", "Pid > 39", "Pid >= 40", "Pid < 4e1 || Pid < 41", "Pid <= 40.0", "Timestamp == 1500"],
    "uuid": ["Uuid == 'ffeeddcc-bbaa-9988-7766-554433221100'", "Uuid =~ /^ffee/"],
    "patterns": ["Payload =~ /^it's/", "Payload =~ /items$/", r"Payload =~ /\d items/", "Payload !~ /^items/", "Hostname =~ /^(web|db)-[0-9]+$/", "Payload =~ /(?i)ITEMS/", r"Fields[path] =~ /^\/cart\//"],
    "precedence": ["FALSE && FALSE || TRUE", "TRUE || FALSE && FALSE", "(TRUE || FALSE) && Pid == 40", "((Pid == 40))&&(Severity==2)"],
    "fields": ["Fields[items] == 3", "Fields[total] > 19.98 && Fields[total] < 20", "Fields[path] == '/cart/7'", "Fields[raw] == 'zip'", "Fields[paid] == TRUE"],
    "indexes": ["Fields[coupon] == 'spring'", "Fields[coupon][1] == 'summer'", "Fields[prices][0][1] == 12", "Fields[prices] < 12"],
    "presence": ["Fields[items] != NIL", "Fields[colour] == NIL", "Fields[coupon][2] == NIL", "Fields[prices][0][2] == NIL"],
    "truth as text": ["Fields[word] == TRUE", "Fields[word] == 'TRUE'"],
    "after a line break": ["Pid == 40\nand what follows is not read"],
    "a number out of range is 0": ["Severity > 1e999", "Pid != 1e999"],
}
FAILS = {
    "constants": ["FALSE", "TRUE && FALSE"],
    "text": ["Logger == 'SHOP'", "Logger != 'shop'", "EnvVersion > '2.1'", "EnvVersion < '2.1'"],
    "numbers": ["Severity != 2", "Pid > 40", "Pid < 40", "Timestamp != 1500"],
    "patterns": ["Payload =~ /^items/", "Payload !~ /items/"],
    "what is missing": ["Fields[colour] != 'red'", "Fields[colour] < 5", "Fields[colour] !~ /red/", "Fields[colour] != NIL", "Fields[items][1] == 3", "Fields[prices][0][9] != 1"],
    "another type": ["Fields[items] == 'three'", "Fields[items] != 'three'", "Fields[path] == 7", "Fields[path] != 7", "Fields[total] =~ /19/", "Fields[paid] == FALSE"],
    "a truth value against what is none": ["Fields[paid] != FALSE && Fields[paid] == 'yes'", "Fields[paid] == 1"],
    "no number": ["Fields[nan] > 0", "Fields[nan] == 0", "Fields[nan] <= 0"],
}


@pytest.fixture(scope="module")
def order(spark):
    f = M.field
    many = lambda *v: F.array(*[F.lit(x) for x in v])
    bag = F.array(
        f("items", F.lit(3), "integer"),
        f("coupon", F.lit("spring"), "string"),
        f("total", F.lit(19.99), "double"),
        f("coupon", F.lit("summer"), "string"),
        f("path", F.lit("/cart/7"), "string"),
        f("raw", F.lit("zip").cast("binary"), "bytes"),
        f("paid", F.lit(True), "bool"),
        f("prices", many(5, 12), "integer", is_array=True),
        f("word", F.lit("TRUE"), "string"),
        f("nan", F.lit(float("nan")), "double"),
    )
    uuid = F.unhex(F.lit("ffeeddccbbaa99887766554433221100"))
    return M.messages(spark.range(1), uuid=uuid, timestamp=F.lit(1500), type=F.lit("order"), logger=F.lit("shop"), severity=F.lit(2), payload=F.lit("it's 3 items"), env_version=F.lit("2.1"), pid=F.lit(40), hostname=F.lit("web-12"), fields=bag).cache()


@pytest.mark.parametrize("spec", MALFORMED.values(), ids=MALFORMED)
def test_malformed(spark, spec):
    with pytest.raises(matcher.MatcherError):
        matcher.compile(spec)


@pytest.mark.parametrize(("cases", "truth"), [(HOLDS, True), (FAILS, False)])
def test_truth(order, cases, truth):
    specs = [s for group in cases.values() for s in group]
    row = order.select(*[matcher.compile(s).alias(f"c{i}") for i, s in enumerate(specs)]).first()
    assert [s for s, got in zip(specs, row, strict=True) if got is not truth] == []


def test_field_predicates_reach_the_scan(spark):
    """Numbers and text of fields that are columns: pushed down, and no other column is read."""
    from weirline.plans import queries

    plan = queries.QUERIES["match_field_numeric"](spark, SF)._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThan(value,50.0)" in pushed and "Not(EqualTo(user_id,3))" in pushed and "props" not in pushed[pushed.index("ReadSchema") :].split("\n")[0]
    plan = queries.QUERIES["match_prefix"](spark, SF)._jdf.queryExecution().toString()
    assert "StringStartsWith(event_type,pur)" in plan


def test_columns_and_fields_agree(spark):
    """A matcher over columns chooses what it chooses over the fields built of them."""
    from weirline.plans import tables

    every = tables.events(spark, SF)
    for spec in ["Fields[value] > 50.5", "Fields[user_id] != 3 && Fields[k] <= 7", "Fields[value] == NIL || Fields[k] != NIL", "Fields[user_id] == 'x'", "Fields[k] < 1.5", "Fields[k][1] == NIL && Fields[none] == NIL", "Fields[none] != 1", "Fields[user_id] > 1e999"]:
        assert sorted(r.event_id for r in tables.events(spark, SF, spec).collect()) == sorted(r.event_id for r in matcher.match(every, spec).collect()), spec


def test_dollar_is_the_very_end(spark):
    df = spark.createDataFrame([("b\n",), ("b",)], "type string")
    assert [r[0] for r in df.select(matcher.compile("Type =~ /[b]$/")).collect()] == [False, True]


def test_signer(spark, order):
    signed = order.withColumn("signer", F.lit("ann"))
    assert matcher.match(signed, "TRUE", signer="ann").count() == 1 and matcher.match(signed, "TRUE", signer="bob").count() == 0


def test_reinjected(order):
    turned = lambda n, spec: matcher.reinjected(order.withColumn("loop_count", F.lit(n)), spec)
    assert turned(4, "Type == 'bill'").count() == 0
    assert turned(1, "Type == 'bill'").first().loop_count == 2
    assert turned(1, "Type == 'order'").count() == 0
