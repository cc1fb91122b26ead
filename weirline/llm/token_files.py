"""Token ids in binary files (operator 7): planes of fixed-size id blocks, each compressed.

Texts are range-partitioned and sorted by document id and encoded where they
land, so a partition's files hold a stretch of the id stream in order.  A chunk
is a row of a Parquet file, which Spark's committer writes whole or not at all:

    part, seq        place of the chunk: partition, and number in it
    first            ids of the partition before this chunk
    doc_ids, lengths its documents in order and how many ids each has
    block_ids        ids in a block; the last block may hold fewer
    ends             chunk index: where in data each plane of each block ends
    data             the planes, each compressed with zstandard

A block of n 32-bit ids becomes 4 byte planes of n bytes, or 32 bit planes of
n/8 bytes: the high planes of a vocabulary of 50,257 are all zero and cost a
few bytes.  Chunks hold whole documents, so each is decoded by itself.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 18
END_ID = 0
CACHED_UNITS = 500_000
FILES = "part int, seq int, first long, n_ids long, doc_ids array<long>, lengths array<long>, block_ids int, bit_planes boolean, ends array<int>, data binary"


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _is(*codes: int) -> np.ndarray:
    return np.isin(np.arange(256), codes)


_LETTER = _is(*range(0x41, 0x5B), *range(0x61, 0x7B))
_DIGIT = _is(*range(0x30, 0x3A))
_WHITE = C.SPACE | _is(*range(0x1C, 0x20))
_MARK = _is(*range(0x21, 0x7F)) & ~_LETTER & ~_DIGIT


def _splits_like_bytes(tokenizer) -> bool:
    """Whether the file is of the one kind that Encoder may cut into units: a BPE over bytes whose own pattern
    splits the text, with nothing changed before and no added token that takes white space with it."""
    made = json.loads(tokenizer.to_str())
    pre = made.get("pre_tokenizer") or {}
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] and made.get("normalizer")) for t in made.get("added_tokens", []))
    kind = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(kind and plain and not made.get("normalizer") and made["model"].get("type") == "BPE" and len(tokenizer.encode("\n", add_special_tokens=False).ids) == 1)


class Encoder:
    """Encodes texts, each different unit of them once; texts are whole units if the tokenizer is not a BPE over bytes.

    A unit begins at a space after a byte that is not white space, after a
    line break between two ASCII bytes that are not, and where ASCII letters,
    digits and marks meet, except after an apostrophe.  The pattern by which a
    byte-level BPE splits its input never joins what lies on both sides of
    such a place, so the units' ids in a row are the text's.

    New units go to the tokenizer as lines of one text: a line break before a
    space or a character that is no white space is a token of its own, so it
    parts the ids of one unit from the next.  Units with white space inside,
    or that may hold white space beyond ASCII, go one by one.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        #: Strings that are one token wherever they stand, such as the end of a text: no unit ends inside.
        self.fixed = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_units = _splits_like_bytes(self.tokenizer)
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids[0] if self.by_units else None
        self.reset()

    def reset(self) -> None:
        #: 128-bit hashes, in order of the first half, and places in `ends`: a dict would take ten times the memory.
        self.known, self.second, self.places = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        white = _WHITE[data]
        plain = ~white & (data < 0x80)
        cut = np.zeros(len(data), bool)
        cut[1:] = (data[1:] == 0x20) & ~white[:-1]
        cut[2:] |= (data[1:-1] == 0x0A) & plain[:-2] & plain[2:]
        kind = (_LETTER.astype(np.uint8) + 2 * _DIGIT + 3 * _MARK)[data]
        meets = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (data[:-1] != 0x27)
        raw = data.tobytes() if self.fixed else b""
        for text in self.fixed:
            at = raw.find(text)
            while at >= 0:
                meets[at : at + len(text)] = False
                at = raw.find(text, at + 1)
        cut[1:] |= meets
        cut[offs[:-1][offs[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encodes units that are not known; their places among the known ones."""
        lengths = ends - starts + 1
        data = np.append(data, np.uint8(0x0A))[np.minimum(C.ranges(starts, lengths), len(data))]  # the units alone, a byte apart
        ends = np.cumsum(lengths) - 1
        starts = ends - lengths + 1
        data[ends] = 0x0A
        follows = np.append(data[1:], np.uint8(0))
        lead = data >= 0xC2
        odd = _WHITE[data] | (data < 0x20)
        odd |= lead & (((data == 0xC2) & ((follows == 0x85) | (follows == 0xA0))) | ((data == 0xE1) & (follows == 0x9A)) | ((data == 0xE2) & ((follows == 0x80) | (follows == 0x81))) | ((data == 0xE3) & (follows == 0x80)))
        odd[ends] = False
        odd[starts[(data[starts] == 0x20) & (lengths > 2)]] = False  # a space may come first
        lines = np.add.reduceat(odd, starts, dtype=np.int64) == 0
        parts = []
        for own in np.array_split(np.flatnonzero(lines), max(1, int(lines.sum()) // 50_000)):
            if not len(own):
                continue
            text = data[C.ranges(starts[own], lengths[own])]
            ids = np.array(self.tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            breaks = np.flatnonzero(ids == self.line_break)
            if len(breaks) != len(own):
                lines[own] = False
                continue
            parts.append((own, ids[ids != self.line_break], np.diff(breaks, prepend=-1) - 1))
        single = np.flatnonzero(~lines)
        if len(single):
            raw = data.tobytes()
            got = [e.ids for e in self.tokenizer.encode_batch_fast([raw[starts[k] : ends[k]].decode() for k in single], add_special_tokens=False)]
            parts.append((single, np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)))
        place = len(self.ends) - 1
        self.ids = np.concatenate([self.ids, *[ids for _, ids, _ in parts]])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([n for _, _, n in parts]))])
        out = np.empty(len(starts), np.int64)
        out[np.concatenate([p for p, _, _ in parts])] = np.arange(place, place + len(starts))
        return out

    def _encode_each(self, data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every unit by itself, none from what is known."""
        self.reset()
        unit = self._learn(data, starts, ends)
        lengths = (self.ends[1:] - self.ends[:-1])[unit]
        ids = self.ids[C.ranges(self.ends[unit], lengths)]
        self.reset()
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offs)]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        if not self.by_units:
            raw = data.tobytes()
            got = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], add_special_tokens=False)]
            return np.array([i for ids in got for i in ids], np.uint32), np.cumsum([0, *map(len, got)])
        starts = self._cuts(data, offs)
        ends = np.append(starts[1:], len(data))
        hashes, first, which = np.unique(C.byte_hashes(data, starts, ends), return_index=True, return_inverse=True)
        second = C.byte_hashes(data, starts, ends, C.byte_sums(data, 1))
        if (second[first][which] != second).any():  # two units of this chunk have one hash: no unit is remembered or used
            return self._encode_each(data, offs, starts, ends)
        second = second[first]
        if len(self.known) > CACHED_UNITS:
            self.reset()
        at = np.searchsorted(self.known, hashes)
        inside = np.minimum(at, max(len(self.known) - 1, 0))
        seen = self.known[inside] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        if (self.second[inside[seen]] != second[seen]).any():
            return self._encode_each(data, offs, starts, ends)
        unit = np.where(seen, self.places[inside], -1) if len(self.known) else np.full(len(hashes), -1)
        missing = np.flatnonzero(~seen)
        if len(missing):
            unit[missing] = self._learn(data, starts[first[missing]], ends[first[missing]])
            put = lambda old, new: np.insert(old, at[missing], new[missing])
            self.known, self.second, self.places = put(self.known, hashes), put(self.second, second), put(self.places, unit)
        unit = unit[which]
        lengths = (self.ends[1:] - self.ends[:-1])[unit]
        ids = self.ids[C.ranges(self.ends[unit], lengths)]
        return ids, np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, offs)]


@cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker: words come again."""
    return Encoder(path)


def to_planes(ids: np.ndarray, bit_planes: bool) -> list[bytes]:
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bit_planes:
        return [x.tobytes() for x in np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)]
    return [x.tobytes() for x in np.ascontiguousarray(raw.T)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        rows = np.unpackbits(np.stack([np.frombuffer(x, np.uint8) for x in planes]), axis=1, count=n)
        return np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(np.stack([np.frombuffer(x, np.uint8) for x in planes]).T).reshape(-1).view("<u4")


def _write(path: str, end_id: int, block_ids: int, chunk_ids: int, bit_planes: bool):
    def write(batches):
        encoder, pack = _encoder(path), zstandard.ZstdCompressor(level=3)
        part = TaskContext.get().partitionId()
        seq, first = 0, 0
        ids, docs, lengths, held = [], [], [], 0

        def chunk():
            all_ids, ends, data = np.concatenate(ids), [], []
            for at in range(0, len(all_ids), block_ids):
                for plane in to_planes(all_ids[at : at + block_ids], bit_planes):
                    data.append(pack.compress(plane))
                    ends.append((ends[-1] if ends else 0) + len(data[-1]))
            row = {"part": part, "seq": seq, "first": first, "n_ids": len(all_ids), "doc_ids": docs, "lengths": lengths, "block_ids": block_ids, "bit_planes": bit_planes, "ends": ends, "data": b"".join(data)}
            return pa.RecordBatch.from_pylist([row], schema=_FILE_SCHEMA)

        for batch in batches:
            data, offs = C.texts(batch.column("_text"))
            names = batch.column("_id").to_pylist()
            for i, j in C.chunks(offs, 1 << 21):
                found, at = encoder.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for k in range(j - i):
                    ids.append(np.append(found[at[k] : at[k + 1]], np.uint32(end_id)))
                    docs.append(names[i + k])
                    lengths.append(len(ids[-1]))
                    held += lengths[-1]
                    if held >= chunk_ids:
                        yield chunk()
                        seq, first = seq + 1, first + held
                        ids, docs, lengths, held = [], [], [], 0
        if docs:
            yield chunk()

    return write


_FILE_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("block_ids", pa.int32()), ("bit_planes", pa.bool_()), ("ends", pa.list_(pa.int32())), ("data", pa.binary())])


def write(docs: DataFrame, to: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS, chunk_ids: int = CHUNK_IDS, bit_planes: bool = False) -> None:
    """Writes the ids of all texts to the folder `to`, in ascending order of doc_id, null first.

    Ids are integers (TypeError if not); rows of one id stand in an order that
    their texts decide.  A null or empty text is the end id alone.  An empty
    table makes files without rows.  Other columns, whatever their names, are
    not read.  tokenizer is the path of a `tokenizers` file that is on every
    machine: texts are cut into units only if it splits bytes as Encoder
    expects, and are encoded whole by any other.  A text is encoded in one
    task, at about fifty times its size, and a chunk holds whole documents.
    """
    C.integer_id(docs, doc_id)
    rows = docs.select(C.col(doc_id).cast("long").alias("_id"), C.col(text).alias("_text"), F.xxhash64(C.col(text)).alias("_row"))
    keys = ["_id", "_row", "_place"]
    dealt = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.select("_id", "_text").mapInArrow(_write(tokenizer, end_id, block_ids, chunk_ids, bit_planes), FILES).write.option("compression", "none").parquet(to)


def decode(row: dict) -> np.ndarray:
    """All ids of a chunk."""
    unpack = zstandard.ZstdDecompressor()
    ends, data, out, at = row["ends"], row["data"], [], 0
    per = 32 if row["bit_planes"] else 4
    for block in range(len(ends) // per):
        n = min(row["block_ids"], row["n_ids"] - block * row["block_ids"])
        planes = []
        for end in ends[block * per : (block + 1) * per]:
            planes.append(unpack.decompress(data[at:end]))
            at = end
        out.append(from_planes(planes, n))
    return np.concatenate(out)


def read(spark: SparkSession, path: str, *, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and ids (null unless asked
    for) of every document in the files."""
    files = spark.read.parquet(path)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
            for row in batch.to_pylist():
                found = decode(row)
                at, start = 0, row["_before"] + row["first"]
                for name, n in zip(row["doc_ids"], row["lengths"], strict=True):
                    own = found[at : at + n]
                    for key, value in zip(out, (name, start + at, n, zlib.crc32(own.tobytes()), own.tolist() if ids else None), strict=True):
                        out[key].append(value)
                    at += n
            yield pa.RecordBatch.from_pydict(out, schema=_READ_SCHEMA)

    return files.join(parts, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


_READ_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """The documents as read back from files newly written to the shared folder."""
    spark = docs.sparkSession
    path = C.new_path(spark, "tokens")
    write(docs, path, tokenizer, **options)
    return read(spark, path, ids=False).drop("ids")
