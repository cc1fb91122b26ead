"""Mixing sources to target weights (operator 5): hash-threshold histograms.

Every document has a 60-bit hash.  Sizes are summed by source and by the first
12 bits of the hash; running sums over these 4,096 buckets show in which bucket
a source's budget ends.  Only that bucket's documents are summed again by the
next 12 bits, and so on down to single hashes.  The result is one threshold a
source, and the mix is a filter: nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

LEVEL_BITS, LEVELS = 12, 5
HASH_BITS = LEVEL_BITS * LEVELS
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Sources up to which their thresholds are broadcast: a row of under 200 bytes each.
BROADCAST_SOURCES = 50_000


def words_in(text: Column) -> Column:
    """Words of [^\\x20\\x09-\\x0D]; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(key: Column, salt: str) -> Column:
    """60 bits of MD5; a null key is a key of its own."""
    digest = F.md5(F.concat_ws(":", F.lit(salt), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sources (_src, source, source_size) with a target each.

    Sources in order of their names, null last, have the given weights, over
    and over.  A source's target stops at most times its size; what that frees
    goes to the others by weight.  With sources in order of cap by weight, the
    capped ones come first, so running sums find the level in one pass.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    all_of = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_src")).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        sources.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size").cast("double") * most)
        .withColumn("_budget", F.sum("source_size").over(all_of).cast("double") * share)
        .withColumn("_w_left", F.sum("_w").over(all_of) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_capped", F.col("_cap") * F.col("_w_left") <= F.col("_w") * F.col("_left"))
    )
    free = F.when(~F.col("_capped"), F.col("_w"))
    rest = F.col("_budget") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))).over(all_of), F.lit(0.0))
    return level.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * rest / F.sum(free).over(all_of))).select("_src", "source_size", "target")


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """_src, _threshold: documents with a smaller hash come nearest to the source's budget.

    sized: _src, _size, _hash.  budgets: _src, _budget.  At each level the
    documents that remain are those of one bucket a source, 1/4096 of those
    before in the mean.  Documents of one hash stay together.
    """
    bounds = budgets.select("_src", F.col("_budget").alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    rest = sized
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("_hash", shift).alias("_bucket")
        sums = rest.groupBy("_src", bucket).agg(F.sum("_size").alias("_n"))
        running = Window.partitionBy("_src").orderBy("_bucket")
        crossed = sums.withColumn("_to", F.sum("_n").over(running)).join(bounds.select("_src", "_left"), "_src").where(F.col("_to") > F.col("_left"))
        first = crossed.groupBy("_src").agg(F.min_by(F.struct("_bucket", "_n", "_to", "_left"), "_bucket").alias("_x"))
        last = level == LEVELS - 1
        over = (F.col("_x._to") - F.col("_left")) < (F.col("_left") - (F.col("_x._to") - F.col("_x._n")))
        found = bounds.join(first, "_src", "left").select(
            "_src",
            F.when(F.col("_x").isNull(), F.col("_left")).otherwise(F.col("_left") - (F.col("_x._to") - F.col("_x._n"))).alias("_left"),
            F.when(F.col("_x").isNull(), F.when(F.lit(level == 0), F.lit(1 << HASH_BITS).cast("long")).otherwise(F.col("_prefix"))).otherwise(F.shiftleft(F.col("_x._bucket") + (F.when(over, F.lit(1)).otherwise(F.lit(0)) if last else F.lit(0)), shift)).alias("_prefix"),
            F.col("_x._bucket").alias("_bound"),
        )
        bounds = C.checkpointed(found)
        if last:
            break
        rest = rest.join(_small(bounds.where(F.col("_bound").isNotNull()).select("_src", "_bound")), "_src").where(F.shiftright("_hash", shift) == F.col("_bound")).drop("_bound")
        bounds = bounds.drop("_bound")
    return bounds.select("_src", F.col("_prefix").alias("_threshold"))


def _small(by_source: DataFrame) -> DataFrame:
    """A table of a row a source, to be broadcast if there are not too many of them."""
    return F.broadcast(by_source) if by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else by_source


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), C.col(source)), F.lit("n"))


def _cuts(sized: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """A row a source: _src, source_size, target, _times (whole copies) and _threshold (for one more)."""
    sources = sized.groupBy("_src").agg(F.first("_source").alias("source"), F.sum("_size").alias("source_size"))
    wanted = C.checkpointed(targets(sources, weights, share, most).withColumn("_times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")))
    budgets = wanted.select("_src", (F.col("target") - F.col("_times") * F.col("source_size")).alias("_budget"))
    return _small(wanted.join(thresholds(sized.select("_src", "_size", "_hash"), budgets), "_src"))


def _copies(most: int) -> Column:
    """How often a document with the source's cut beside it is taken."""
    once_more = (F.col("_times") < most) & (F.col("_hash") < F.col("_threshold")) & (F.col("target") > 0)
    return F.col("_times") + once_more.cast("long")


def _sized(docs: DataFrame, key: str, source: str, text: str, salt: str) -> DataFrame:
    columns = [_source_key(source).alias("_src"), C.col(source).alias("_source"), C.col(key).alias("doc_id"), words_in(C.col(text)).alias("_size"), hash_of(C.col(key), salt).alias("_hash")]
    return C.checkpointed(docs.select(*columns))


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, salt: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target and taken of each row.

    taken is a whole multiple of size, up to most times: every document as
    often as the target holds its source's size, and those below the source's
    threshold once more.  Whole documents are taken, so a source misses its
    target by half of one document's size at the most, but where rows share a
    key.  Null text has size 0.  An empty table gives an empty result.  Other
    columns are not read.
    """
    sized = _sized(docs, key, source, text, salt)
    joined = sized.join(_cuts(sized, weights, share, most), "_src")
    return joined.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * _copies(most)).alias("taken"))


def mixed(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, salt: str = "mix") -> DataFrame:
    """The rows of docs that the mix takes, unchanged, each as often as it is taken.

    Only the cuts, a row a source, come from the sized table; documents are
    filtered by their hash where they lie.
    """
    cuts = _cuts(_sized(docs, key, source, text, salt), weights, share, most)
    hashed = docs.select(F.struct("*").alias("_doc"), _source_key(source).alias("_src"), hash_of(C.col(key), salt).alias("_hash"))  # no name of docs can clash
    taken = hashed.join(cuts, "_src").withColumn("_copies", _copies(most).cast("int")).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
