"""N-gram Jaccard join (operator 9): MinHash banding, verified on full n-gram sets.

1. Texts that are equal are one class; only its smallest document goes on.
2. Each class's set of word 5-grams gets a MinHash signature of bands x rows,
   numbers chosen so that a pair at the threshold shares a band with the
   target probability.  Rows (band hash, class) are shuffled by hash.
3. The classes of one band hash are joined to the smallest of them, a star and
   not all pairs; the stars' connected components hold every candidate pair.
4. Each component's full sets are brought together once, and all its pairs are
   verified by counting common 5-grams with products of incidence matrices,
   whether or not they share a band themselves.  A large component is dealt out in tiles of two blocks, so that no
   task holds more; rows come out per class, never per pair.
5. Verified links make the near-duplicate groups, as components again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

NGRAM, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.999, 6
TILE = 512  # classes in a block of a component
SALTS = 16
_WORD = ~C.SPACE
NO_ID = int(np.iinfo(np.int64).min)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of the given rows by which a pair at the threshold meets with the probability recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _shingles(words: C.Words, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of each text, and where each text's begin.  A text of fewer words has one of them all."""
    hashes = words.hashes()
    n = np.where(words.counts >= ngram, words.counts - ngram + 1, (words.counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(first[-1], np.uint64)
    full = words.counts >= ngram
    at = C.ranges(words.first[:-1][full], n[full])
    out[np.repeat(full, n)] = C.window_hashes(hashes, ngram)[at] if len(at) else 0
    for k in np.flatnonzero(~full & (words.counts > 0)).tolist():
        a, b = int(words.first[k]), int(words.first[k + 1])
        out[first[k]] = C.window_hashes(hashes[a:b], b - a)[0]
    return out, first


def _sets(batch_texts: pa.Array, ngram: int):
    """For each text its distinct n-grams, in order."""
    data, offs = C.texts(batch_texts)
    for i, j in C.chunks(offs):
        words = C.Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], _WORD)
        grams, first = _shingles(words, ngram)
        yield i, j, grams, first


def _signatures(bands: int, rows: int, ngram: int):
    draw = np.random.default_rng(20240229)
    mul = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for i, j, grams, first in _sets(batch.column("_text"), ngram):
                n = np.diff(first)
                some = np.flatnonzero(n)
                codes: list = [[]] * (j - i)
                if len(some):
                    made = np.empty((len(some), bands), np.uint64)
                    value = np.empty_like(grams)
                    for band in range(bands):
                        code = np.full(len(some), band + 1, np.uint64)
                        for k in range(band * rows, (band + 1) * rows):
                            np.multiply(grams, mul[k], out=value)
                            value += add[k]
                            code = C.mix(code * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(value, first[some]))
                        made[:, band] = code
                    for k, row in zip(some.tolist(), made.view(np.int64), strict=True):
                        codes[k] = row
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in ("_id", "_h1", "_h2")], pa.array(n), pa.array(codes, pa.list_(pa.int64()))], names=["_id", "_h1", "_h2", "_n", "_codes"])

    return run


def components(edges: DataFrame, steps: int = 40) -> DataFrame:
    """_node, _group (the smallest node of its component) of every node in edges (_a, _b), _a > _b.

    Hooking and shortcutting: each round points every label at the smallest
    label among its neighbours', and then each node at its label's label,
    twice, which halves the paths each time, so that rounds grow with the
    logarithm of the longest path.  Hot nodes are met by aggregations only.
    """
    labels = C.checkpointed(edges.select(F.col("_a").alias("_node")).union(edges.select("_b")).distinct().withColumn("_group", F.col("_node")))
    for _ in range(steps):
        a = labels.select(F.col("_node").alias("_a"), F.col("_group").alias("_ga"))
        b = labels.select(F.col("_node").alias("_b"), F.col("_group").alias("_gb"))
        ends = edges.join(a, "_a").join(b, "_b").where(F.col("_ga") != F.col("_gb"))
        hooks = C.checkpointed(ends.groupBy(F.greatest("_ga", "_gb").alias("_group")).agg(F.min(F.least("_ga", "_gb")).alias("_to")))
        if hooks.isEmpty():
            return labels
        labels = C.checkpointed(labels.join(hooks, "_group", "left").select("_node", F.coalesce("_to", "_group").alias("_group")))
        for _ in range(2):
            labels = labels.join(labels.select(F.col("_node").alias("_group"), F.col("_group").alias("_further")), "_group").select("_node", F.col("_further").alias("_group"))
        labels = C.checkpointed(labels)
    raise RuntimeError("components did not settle")


LINKS = "_node long, _links long, _to long"


def _count_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Common grams of each pair of two lists of distinct ascending grams."""
    out = np.zeros((len(a), len(b)), np.float32)
    own = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
    (ga, ia), (gb, ib) = own(a), own(b)
    if a is b:  # only grams of two sets and more can be common
        seen, counts = np.unique(ga, return_counts=True)
        common = seen[counts > 1]
    else:
        common = np.intersect1d(ga, gb)
    if not len(common):
        return out
    sides = []
    for grams, owner in ((ga, ia), (gb, ib)):
        k = np.searchsorted(common, grams)
        on = common[np.minimum(k, len(common) - 1)] == grams
        order = np.argsort(k[on], kind="stable")
        sides.append((k[on][order], owner[on][order]))
    width = max(64, min(len(common), (1 << 22) // max(len(a), len(b))))
    for at in range(0, len(common), width):
        parts = []
        for (k, owner), n in zip(sides, out.shape, strict=True):
            x = np.zeros((n, width), np.float32)
            lo, hi = np.searchsorted(k, [at, at + width])
            x[owner[lo:hi], k[lo:hi] - at] = 1
            parts.append(x)
        out += parts[0] @ parts[1].T
    return out


def _linked(grams: tuple, threshold: float, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows, columns) that reach the threshold; of one list, each pair once."""
    common = _count_common(*grams).astype(np.int64)
    size = [np.array([len(g) for g in x], np.int64) for x in grams]
    union = size[0][:, None] + size[1][None, :] - common
    rows, columns = np.nonzero((common * 1000 >= round(threshold * 1000) * union) & (common > 0))
    if own:
        rows, columns = rows[rows < columns], columns[rows < columns]
    return rows, columns


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n nodes that links (a, b) connect each node to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(threshold: float):
    """Over one tile, or over several small components: each class's links and the smallest class they connect it to."""

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        part, side, node = (table.column(c).to_numpy() for c in ("_part", "_side", "_node"))
        _, first = np.unique(np.stack([part, side.astype(np.int64), node]), axis=1, return_index=True)  # equal rows of a document once
        first = first[np.lexsort((node[first], side[first], part[first]))]
        part, side, node = part[first], side[first], node[first]
        table = table.take(pa.array(first))
        copies, diagonal = table.column("_copies").to_numpy(), table.column("_diagonal").to_numpy(zero_copy_only=False)
        grams = [np.frombuffer(g, np.uint64) for g in table.column("_grams").to_pylist()]
        links, a_all, b_all = np.zeros(len(node), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cut = np.append(C.runs(part), len(part))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            own = bool(diagonal[lo])
            left, right = slice(lo, mid), slice(lo, hi) if own else slice(mid, hi)
            if hi - lo < 2 if own else mid in (lo, hi):  # a block may be empty
                continue
            left_grams = grams[left]
            rows, columns = _linked((left_grams, left_grams if own else grams[right]), threshold, own)
            rows, columns = rows + left.start, columns + right.start
            np.add.at(links, rows, copies[columns])
            np.add.at(links, columns, copies[rows])
            a_all.append(rows)
            b_all.append(columns)
        nodes, place = np.unique(node, return_inverse=True)
        root = _roots(len(nodes), place[np.concatenate(a_all)], place[np.concatenate(b_all)])
        return pa.table({"_node": node, "_links": links, "_to": nodes[root[place]]})

    return verify


def _with_grams(ngram: int):
    def run(batches):
        for batch in batches:
            made = []
            for i, j, grams, first in _sets(batch.column("_text"), ngram):
                made += [np.unique(grams[first[k] : first[k + 1]]).tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(made, pa.binary())], names=[*batch.schema.names[1:], "_grams"])

    return run


def _row_key(doc_id: str, text: str) -> list[Column]:
    return [F.coalesce(C.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(C.col(text)).alias("_h1"), F.xxhash64(F.lit("second"), C.col(text)).alias("_h2")]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """_text, _id, _h1, _h2 (a 128-bit hash of the text)."""
    C.integer_id(docs, doc_id)
    return docs.select(C.col(text).alias("_text"), *_row_key(doc_id, text))


SIGNED = "_id long, _h1 long, _h2 long, _n long, _codes array<long>"


def _grouped(docs: DataFrame, doc_id: str, text: str, ngram: int, threshold: float, recall: float, rows: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """The rows (_id, _h1, _h2), and the classes of equal texts: _h1, _h2, _first, _links, _group."""
    bands = bands_for(threshold, recall, rows)
    texts = _rows(docs, doc_id, text)
    signed = C.stored(texts.mapInArrow(_signatures(bands, rows, ngram), SIGNED), "signatures")
    equal = signed.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_copies"), F.first("_n").alias("_n"), F.first("_codes").alias("_codes"))
    kinds = C.stored(equal.withColumn("_node", F.monotonically_increasing_id()), "classes")

    by_band = kinds.select("_node", F.explode("_codes").alias("_code"))
    lows = by_band.groupBy("_code").agg(F.min("_node").alias("_b"), F.count(F.lit(1)).alias("_m")).where(F.col("_m") > 1).select("_code", "_b")
    stars = by_band.join(lows, "_code").where(F.col("_node") != F.col("_b")).select(F.col("_node").alias("_a"), "_b").distinct()
    parts = components(C.checkpointed(stars)).withColumnRenamed("_group", "_part")

    sized = kinds.join(parts, "_node")
    blocks = sized.groupBy("_part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("_n") / (tile * 1000))).cast("int").alias("_blocks"))
    chosen = C.checkpointed(sized.join(blocks, "_part").select("_node", "_part", "_blocks", "_copies", "_n", "_first", "_h1", "_h2"))
    packs = 1 + (chosen.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]) // 500_000
    same_text = (texts["_h1"] == chosen["_h1"]) & (texts["_h2"] == chosen["_h2"]) & (texts["_id"] == chosen["_first"])
    sets = texts.join(chosen, same_text).select("_text", "_node", "_part", "_blocks", "_copies").mapInArrow(_with_grams(ngram), "_node long, _part long, _blocks int, _copies long, _grams binary")
    own = F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int")
    tiled = sets.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    single = F.col("_blocks") == 1
    tiled = tiled.select(
        F.when(single, F.pmod(F.xxhash64("_part"), F.lit(packs))).otherwise(F.col("_part")).alias("_pack"),
        F.when(single, F.lit(-1)).otherwise(F.least("_own", "_other") * F.col("_blocks") + F.greatest("_own", "_other")).alias("_tile"),
        (F.col("_own") > F.col("_other")).cast("int").alias("_side"),
        (F.col("_own") == F.col("_other")).alias("_diagonal"),
        "_part", "_node", "_copies", "_grams",
    )
    found = C.checkpointed(tiled.groupBy("_pack", "_tile").applyInArrow(_verify(threshold), LINKS))
    links = found.groupBy("_node").agg(F.sum("_links").alias("_links"))
    groups = components(C.checkpointed(found.where(F.col("_node") != F.col("_to")).select(F.col("_node").alias("_a"), F.col("_to").alias("_b")).distinct()))
    whole = C.checkpointed(kinds.select("_node", "_h1", "_h2", "_first", "_copies").join(links, "_node", "left").join(groups, "_node", "left").withColumn("_alone", F.col("_group").isNull()).withColumn("_group", F.coalesce("_group", "_node")))
    # A group may hold any share of the classes: its rows are salted, and its smallest document repeated for each salt.
    firsts = whole.where("NOT _alone").groupBy("_group").agg(F.min("_first").alias("_smallest")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    grouped = whole.where("NOT _alone").withColumn("_salt", F.pmod(F.xxhash64("_node"), F.lit(SALTS)).cast("int")).join(firsts.hint("merge"), ["_group", "_salt"]).drop("_salt")
    named = grouped.unionByName(whole.where("_alone").withColumn("_smallest", F.col("_first"))).select("_group", "_h1", "_h2", "_first", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"), "_smallest")
    return signed.select("_id", "_h1", "_h2"), named


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """doc_id, copy_id, class_id and n_links of every row.

    copy_id is the smallest document with an equal text, class_id the smallest
    of the near-duplicate group (documents connected by links), n_links the
    number of other documents with a Jaccard similarity of the threshold or
    more on sets of ngram words, copies included.  Words are unchanged.  A text
    of fewer words has one set member, all its words.  Texts without words,
    null among them, are linked only to equal ones.  Ids are integers
    (TypeError if not); rows of one doc_id count as documents of their own; a
    null doc_id is the smallest.  An empty table gives an empty result.  Other
    columns, whatever their names, are not read.  A text's grams are made in
    one task, at about forty times its size.
    """
    all_rows, named = _grouped(docs, doc_id, text, ngram, threshold, recall, rows, tile)
    back = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return all_rows.join(named, ["_h1", "_h2"]).select(back("_id").alias("doc_id"), back("_first").alias("copy_id"), back("_smallest").alias("class_id"), F.col("_links").alias("n_links"))


def keep(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, tile: int = TILE) -> DataFrame:
    """One row of docs, unchanged, of each near-duplicate group as join() finds them: the smallest document's.
    Of rows equal in id and text any one stays.  Columns may have any names; an empty table gives an empty result."""
    all_rows, named = _grouped(docs, doc_id, text, ngram, threshold, recall, rows, tile)
    of_group = all_rows.join(named, ["_h1", "_h2"]).groupBy("_group").agg(F.min(F.struct("_id", "_h1", "_h2")).alias("_k")).select("_k._id", "_k._h1", "_k._h2")
    same = all_rows.join(of_group, ["_id", "_h1", "_h2"]).groupBy("_id", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_same"))
    hashed = docs.select(F.struct("*").alias("_doc"), *_row_key(doc_id, text))
    kept = hashed.join(same, ["_id", "_h1", "_h2"])
    once = kept.where("_same = 1").select("_doc.*")
    return once.unionByName(kept.where("_same > 1").dropDuplicates(["_id", "_h1", "_h2"]).select("_doc.*"))
