"""Line dedup (operator 8): range-partitioned hashes, sorted by document and position.

Each document sends a row per long line: the line's 128-bit hash, the document
and the position, never the text.  The rows are range-partitioned by hash and
document and sorted, and each partition is streamed once.  A run of one hash
that ends inside a partition is decided there.  A hash that touches a
partition's edge may go on in the next one, which is how a line that a third of
all documents hold is split over many tasks; its rows wait for the sums of its
parts, at most two rows a partition.  Dropped lines return to their documents
as compressed keep bitmaps.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Sums up to which they are broadcast: 32 bytes each.
BROADCAST_SUMS = 500_000
LINES = "_h1 long, _h2 long, _id long, _row long, _pos int"
NO_ID = int(np.iinfo(np.int64).min)


def _lines(data: np.ndarray, offs: np.ndarray):
    """Start and end of each line (ends at \\n or the text's end), and the first line of each text."""
    breaks = np.flatnonzero(data == 0x0A)
    per = np.searchsorted(breaks, offs)
    counts = np.diff(per) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_last = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    is_last[first[1:] - 1] = True
    starts[is_first], starts[~is_first] = offs[:-1], breaks + 1
    ends[is_last], ends[~is_last] = offs[1:], breaks
    return starts, ends, first


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Each line without white space at both ends: start, end, code points."""
    solid = np.flatnonzero(~C.SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    s = np.where(some, solid[np.minimum(a, max(len(solid) - 1, 0))] if len(solid) else 0, starts)
    e = np.where(some, solid[np.maximum(b - 1, 0)] + 1 if len(solid) else 0, s)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return s, e, points[e] - points[s]


def _hashed(least_chars: int):
    def run(batches):
        for batch in batches:
            data, offs = C.texts(batch.column("_text"))
            ids = batch.column("_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            rows = batch.column("_row").to_numpy(zero_copy_only=False)
            for i, j in C.chunks(offs):
                part, o = C.LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
                starts, ends, first = _lines(part, o)
                s, e, points = _keys(part, starts, ends)
                long = np.flatnonzero(points >= least_chars)
                if not len(long):
                    continue
                text = np.searchsorted(first, long, "right") - 1
                h = [C.byte_hashes(part, s[long], e[long], C.byte_sums(part, seed)).view(np.int64) for seed in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(ids[i:j][text]), pa.array(rows[i:j][text]), pa.array((long - first[text]).astype(np.int32))], names=["_h1", "_h2", "_id", "_row", "_pos"])

    return run


STREAMED = f"{LINES}, _waits boolean, _new boolean"


def _streamed(least_docs: int):
    """One pass over a sorted partition: the rows to drop, and those of the first and the last
    hash, which wait.  A run that reaches a batch's end is held until the next batch."""

    def marked(table: pa.Table, places: np.ndarray, waits: bool, new_doc: np.ndarray):
        taken = table.take(pa.array(places))
        return taken.append_column("_waits", pa.array(np.full(len(taken), waits))).append_column("_new", pa.array(new_doc[places])).combine_chunks().to_batches()

    def run(batches):
        held, at_start = [], True  # the rows of the last hash so far, as they came
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            h1, h2 = (table.column(c).to_numpy() for c in ("_h1", "_h2"))
            if held and h1[0] == h1[-1] and h2[0] == h2[-1] and same_hash(held[-1], h1[0], h2[0]):
                held.append(table)  # a hash may fill many batches
                continue
            table = pa.concat_tables([*held, table]).combine_chunks()
            h1, h2, ids = (table.column(c).to_numpy() for c in ("_h1", "_h2", "_id"))
            new_hash = np.ones(len(h1), bool)
            new_hash[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_hash.copy()
            new_doc[1:] |= ids[1:] != ids[:-1]
            starts = np.flatnonzero(new_hash)
            held = [table.slice(starts[-1])]
            whole, ends = starts[:-1], starts[1:]
            if at_start and len(whole):
                yield from marked(table, np.arange(ends[0]), True, new_doc)
                whole, ends, at_start = whole[1:], ends[1:], False
            if not len(whole):
                continue
            n_docs = np.add.reduceat(new_doc[: ends[-1]].astype(np.int64), whole)
            many = np.flatnonzero(n_docs >= least_docs)
            lengths = (ends - whole)[many]
            places = C.ranges(whole[many], lengths)
            places = places[ids[places] < np.repeat(ids[ends[many] - 1], lengths)]
            if len(places):
                yield from marked(table, places, False, new_doc)
        if held:
            last = pa.concat_tables(held).combine_chunks()
            ids = last.column("_id").to_numpy()
            yield from marked(last, np.arange(len(last)), True, np.append(True, ids[1:] != ids[:-1]))

    def same_hash(table: pa.Table, h1: int, h2: int) -> bool:
        return table.column("_h1")[-1].as_py() == h1 and table.column("_h2")[-1].as_py() == h2

    return run


def dropped(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """_id, _row, _pos of every line to drop; _row is xxhash64(doc_id, text)."""
    C.integer_id(docs, doc_id)
    rows = docs.select(C.col(doc_id).cast("long").alias("_id"), F.xxhash64(C.col(doc_id), C.col(text)).alias("_row"), C.col(text).alias("_text"))
    lines = C.stored(rows.mapInArrow(_hashed(least_chars), LINES), "hashes")  # range partitioning reads its input twice
    dealt = lines.repartitionByRange("_h1", "_h2", "_id").sortWithinPartitions("_h1", "_h2", "_id", "_pos")
    streamed = C.stored(dealt.mapInArrow(_streamed(least_docs), STREAMED), "lines")
    waiting = streamed.where("_waits")
    # A document's rows of one hash share a partition, so new documents can be counted there.  A partition has two hashes
    # that wait at most, so the sums are broadcast if their count says so, and joined by shuffle beyond.
    sums = waiting.groupBy("_h1", "_h2").agg(F.count_if("_new").alias("_n"), F.max("_id").alias("_last")).where(F.col("_n") >= least_docs)
    sums = C.checkpointed(sums)
    small = sums.limit(BROADCAST_SUMS + 1).count() <= BROADCAST_SUMS
    late = waiting.join(F.broadcast(sums) if small else sums, ["_h1", "_h2"]).where(F.col("_id") < F.col("_last"))
    return streamed.where(~F.col("_waits")).select("_id", "_row", "_pos").union(late.select("_id", "_row", "_pos"))


def bitmaps(gone: DataFrame) -> DataFrame:
    """_id, _row, _bits: zlib-compressed bits up to the last dropped line, 1 for a line to keep."""

    def pack(batches):
        for batch in batches:
            bits = []
            for places in batch.column("_places").to_pylist():
                keep = np.ones((max(places) // 8 + 1) * 8, bool)
                keep[places] = False
                bits.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(bits, pa.binary())], names=["_id", "_row", "_bits"])

    by_doc = gone.groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_places"))
    return by_doc.mapInArrow(pack, "_id long, _row long, _bits binary")


def keep_bits(bits: bytes | None, n: int) -> np.ndarray:
    """Which of a document's n lines its bitmap keeps."""
    keep = np.ones(n, bool)
    if bits:
        got = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[:n].astype(bool)
        keep[: len(got)] = got
    return keep


RESULT = "doc_id long, text string, n_lines long, n_dropped long, kept_sha256 string"


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", with_text: bool = True, **limits) -> DataFrame:
    """doc_id, text (null unless with_text), n_lines, n_dropped and kept_sha256 of every row.

    A line's key is the line without white space at its ends, A-Z lower-cased.
    Keys of least_chars code points in least_docs documents or more lose all
    their lines except in the largest doc_id that holds them.  Rows of one
    doc_id are one document; a null doc_id is the smallest.  A null or empty
    text is one empty line.  Other columns are not read.
    """
    bits = bitmaps(dropped(docs, doc_id=doc_id, text=text, **limits))
    rows = docs.select(C.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(C.col(doc_id), C.col(text)).alias("_row"), C.col(text).alias("text"))
    joined = rows.join(bits.withColumnRenamed("_id", "_of"), (F.coalesce(rows.doc_id, F.lit(NO_ID)) == F.col("_of")) & (rows["_row"] == bits["_row"]), "left").select("doc_id", "text", "_bits")

    def build(batches):
        for batch in batches:
            kept, n_lines, n_dropped, sha = [], [], [], []
            for raw, b in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_bits").to_pylist(), strict=True):
                lines = (raw or b"").split(b"\n")
                if b:
                    keep = keep_bits(b, len(lines))
                    left = b"\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])
                    n_dropped.append(int(len(lines) - keep.sum()))
                else:
                    left = raw or b""
                    n_dropped.append(0)
                n_lines.append(len(lines))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode() if with_text else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "text", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(build, RESULT)
