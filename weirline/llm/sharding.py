"""Sharding (operator 2): rendezvous hashing of record keys over weighted shards.

Every shard draws a number from (key, shard) and the shard with the best number
takes the record: -ln(u) / weight is exponential with the shard's weight as its
rate, so each shard wins in proportion to its weight, and a new shard takes
records only into itself.  All of it is a column expression: no shuffle places
a record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

INDEX_BITS = 33  # of monotonically_increasing_id, which holds the partition above them


def _draw(key: Column, shard: int, salt: str) -> Column:
    """Uniform in (0, 1), from the first 52 bits of MD5, which any engine can repeat."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.lit(str(shard)), key)), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def shard_of(key: Column, weights: Sequence[float], salt: str = "") -> Column:
    """The shard, 0 to len(weights) - 1, that takes the key.  A null key is a key of its own."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scores = [F.struct((-F.log(_draw(key, i, salt)) / F.lit(float(w))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str = "slot") -> DataFrame:
    """df with a gapless number from 0 in each group, by the given order.

    A group may hold any share of the rows, so no task gets a whole group:
    rows are range-partitioned over (group, order), with the row's place as a
    last key to split runs of equal rows, and each partition's share of a group
    starts where the partitions before it ended.  What is summed up for that
    has a row per partition and group.
    """
    keys = [group, *order, "_tie"]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    placed = C.checkpointed(dealt.withColumn("_at", at).drop("_tie"))
    placed = placed.withColumn("_part", F.shiftright("_at", INDEX_BITS)).withColumn("_index", F.col("_at").bitwiseAND(F.lit((1 << INDEX_BITS) - 1)))
    runs = placed.groupBy(group, "_part").agg(F.min("_index").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = runs.withColumn("_start", F.expr(f"coalesce(sum(_n) over (partition by `{group}` order by _part rows between unbounded preceding and 1 preceding), 0)"))
    joined = placed.join(before.select(group, "_part", "_first", "_start"), [group, "_part"])
    return joined.withColumn(name, F.col("_start") + F.col("_index") - F.col("_first")).select(*df.columns, name)


def shard(docs: DataFrame, weights: Sequence[float], *, key: str = "doc_id", text: str = "text", grown_weight: float | None = None, salt: str = "") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (the shard with one more) of each row.

    size is the text's UTF-8 bytes plus 1; null counts as no bytes.  slot
    orders a shard by key, size and checksum; rows equal in those are
    interchangeable.  An empty table gives an empty result; other columns of
    docs, whatever their names, are not read.
    """
    raw = F.coalesce(C.col(text), F.lit(""))
    more = [*weights, grown_weight if grown_weight is not None else weights[-1]]
    narrow = docs.select(
        C.col(key).alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        shard_of(C.col(key), weights, salt).alias("shard"),
        shard_of(C.col(key), more, salt).alias("grown_shard"),
    )
    return numbered(narrow, "shard", ["doc_id", "size", "text_crc32"])
