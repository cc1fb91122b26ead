"""The driver's tables as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import message as M
from ..operators import matcher


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nanos(ntz: Column) -> Column:
    return M.micros(ntz) * 1000


def events(spark: SparkSession, sf_dir: str, spec: str = "TRUE") -> DataFrame:
    """event_id and the event as a message, of those that the matcher chooses: user_id, value and k are fields."""
    sources = {"user_id": (F.col("user_id"), "integer"), "value": (F.col("value"), "double"), "k": (F.get_json_object("props", "$.k").cast("bigint"), "integer")}
    return matcher.from_columns(
        table(spark, sf_dir, "events"),
        spec,
        sources,
        extra=["event_id"],
        required=("type", "timestamp"),
        uuid=M.stable_uuid(F.lit("events"), F.col("event_id")),
        timestamp=nanos(F.col("ts")),
        type=F.col("event_type"),
        logger=F.lit("events"),
        payload=F.col("props"),
        hostname=F.concat(F.lit("host-"), F.col("user_id").cast("string")),
        severity=F.when(F.col("event_type") == "error", F.lit(3)).otherwise(F.lit(6)),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the document as a message."""
    df = table(spark, sf_dir, "documents")
    bag = M.fields(M.field("n_chars", F.col("n_chars"), "integer", "count"))
    return M.messages(df, extra=["doc_id"], uuid=M.stable_uuid(F.lit("documents"), F.col("doc_id")), type=F.col("lang"), logger=F.col("source"), payload=F.col("text"), fields=bag)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn and the turn as a message."""
    df = table(spark, sf_dir, "conversations")
    return M.messages(df, extra=["conv_id", "turn"], uuid=M.stable_uuid(F.lit("conversations"), F.col("conv_id"), F.col("turn")), type=F.col("role"), logger=F.col("conv_id").cast("string"), payload=F.col("text"), fields=M.fields(M.field("turn", F.col("turn"), "integer")))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and the page as a message; the logger is the host of its address."""
    df = table(spark, sf_dir, "pages")
    return M.messages(df, extra=["page_id"], uuid=M.stable_uuid(F.lit("pages"), F.col("page_id")), type=F.lit("page"), logger=F.coalesce(F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1), F.lit("")), payload=F.col("html"), fields=M.fields(M.field("url", F.col("url"), "string")))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber and the item as a message of type returnflag/linestatus."""
    df = table(spark, sf_dir, "lineitem")
    bag = M.fields(*[M.field(c, F.col(c), "double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return M.messages(df, extra=["l_orderkey", "l_linenumber"], timestamp=nanos(F.col("l_shipdate")), type=F.concat_ws("/", "l_returnflag", "l_linestatus"), logger=F.lit("lineitem"), fields=bag)
