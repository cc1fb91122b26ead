"""What the corpus operators share: UTF-8 text as arrays, hashes of words and
word windows, chunks of bounded size, and tables kept in the shared folder.

Inside a task a batch of texts is one array of bytes with offsets.  Words are
found by a lookup of byte classes, and any run of bytes or of words gets a
64-bit polynomial hash from differences of prefix sums, so that the cost is a
few array passes a byte and no Python object is made per word.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the operators' contracts: space and the five control characters from tab on.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes of words as benchmark decontamination takes them: digits, a-z (after lower-casing) and all of UTF-8 beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_GOLD = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = [mix(np.arange(1 + 256 * k, 257 + 256 * k, dtype=np.uint64) * _GOLD) for k in range(2)]


class _Powers:
    """P**i and P**-i modulo 2**64, made once per Python worker and lengthened on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base | 1, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            inverse = pow(self.base, -1, 1 << 64)
            for name, b in (("up", self.base), ("down", inverse)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                np.multiply.accumulate(a, out=a)
                setattr(self, name, a)
        return self.up, self.down


_LETTERS, _WORDS = _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offs = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, end) of runs of whole texts, each of about limit bytes or one text."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some texts: start and end byte, and how many came before each text."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> None:
        self.data, self.offs = data, offs
        self.inside = is_in = inside[data]
        n = len(data)
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        before[1:] = is_in[:-1]
        after[:-1] = is_in[1:]
        edges = offs[(offs > 0) & (offs < n)]
        before[edges] = False
        after[edges - 1] = False
        self.starts = np.flatnonzero(is_in & ~before)
        self.ends = np.flatnonzero(is_in & ~after) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return byte_hashes(self.data, self.starts, self.ends)

    def get(self, i: int, j: int, data: bytes) -> bytes:
        """Words i to j - 1, joined by one space."""
        return b" ".join(data[s:e] for s, e in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist(), strict=True))


def byte_sums(data: np.ndarray, seed: int = 0) -> np.ndarray:
    up, _ = _LETTERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTES[seed][data], up[: len(data)], out=sums[1:])
    np.cumsum(sums, out=sums)
    return sums


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """A hash of data[start:end] for each pair."""
    sums = byte_sums(data) if sums is None else sums
    _, down = _LETTERS.upto(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """A 128-bit BLAKE2b digest of data[start:end] for each pair, as two columns: unequal bytes of equal digest cannot be made."""
    out = np.empty((len(starts), 2), np.uint64)
    raw, digest = data.tobytes(), hashlib.blake2b
    for i in range(0, len(starts), step):
        pairs = zip(starts[i : i + step].tolist(), ends[i : i + step].tolist(), strict=True)
        out[i : i + step] = np.frombuffer(b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in pairs]), np.uint64).reshape(-1, 2)
    return out


def word_sums(words: np.ndarray) -> np.ndarray:
    """Prefix sums from which word_hashes() takes the hash of any run of words."""
    up, _ = _WORDS.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.multiply(words, up[: len(words)], out=sums[1:])
    np.cumsum(sums, out=sums)
    return sums


def word_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words from start to end (exclusive) for each pair."""
    _, down = _WORDS.upto(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size word hashes; as many as there are starts."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = _WORDS.upto(len(words) + 1)
    sums = word_sums(words)
    return mix((sums[size:] - sums[:n]) * down[:n] + np.uint64(size))


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each size neighbouring values, by doubling spans."""
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if span < size:
        values = np.minimum(values[: len(values) - (size - span)], values[size - span :])
    return values


def within(first: np.ndarray, total: int, size: int) -> np.ndarray:
    """Which window starts lie in one text: no window may cross into the next."""
    ok = np.zeros(max(0, total - size + 1), bool)
    text_of_start = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(ok)]
    if len(ok):
        ok[:] = np.arange(len(ok)) + size <= first[1:][text_of_start]
    return ok


def cover(starts: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of total places lie in one of the windows of that size."""
    depth = np.zeros(total + 1, np.int32)
    depth[starts] += 1
    ends = np.minimum(starts + size, total)
    np.subtract.at(depth, ends, 1)
    return np.cumsum(depth[:-1]) > 0


def kept_words(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that the kept words of each text make, joined by one space."""
    data = words.data.copy()
    data[~words.inside] = 0x20
    mask = np.zeros(len(data) + 1, bool)
    mask[:-1][words.inside] = np.repeat(keep, words.ends - words.starts)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    kept = np.flatnonzero(keep)
    last = np.zeros(len(kept), bool)
    if len(kept):
        last[-1] = True
        last[:-1] = text[kept[1:]] != text[kept[:-1]]
    mask[words.ends[kept[~last]]] = True
    at = np.concatenate([[0], np.cumsum(mask[: len(data)])])
    return data[mask[: len(data)]], at[words.offs]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; set here only for a local master, where it may be any folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = context.get() if context.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="weirline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table of its own in the shared folder, so that later jobs read and never remake it."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/weirline-{name}-{uuid.uuid4().hex}"


#: Tables that this driver wrote to the shared folder and has not deleted.
_STORED: list[str] = []


@contextmanager
def cleaned(spark: SparkSession):
    """Deletes the tables stored inside but the last, which is the result of the others; all if an error ends the block."""
    start = len(_STORED)
    try:
        yield
    except BaseException:
        delete(spark, _STORED[start:])
        raise
    delete(spark, _STORED[start:-1])


def newest() -> list[str]:
    """The table stored last."""
    return _STORED[-1:]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables that no DataFrame in use reads."""
    for path in list(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _STORED.remove(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new place in the shared folder and read again.

    A write is committed whole or not at all, so that a lost executor costs the
    tasks it ran and nothing else.
    """
    path = new_path(df.sparkSession, name)
    _STORED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(col(text))), F.lit(0))).first()[0])


def col(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def integer_id(df: DataFrame, doc_id: str) -> DataFrame:
    """df, if its ids are integers; TypeError before any job if they are not."""
    kind = df.schema[doc_id].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{doc_id} must be an integer column, not {kind}")
    return df


def in_blocks(df: DataFrame, doc_id: str, text: str, total: int, block_bytes: int = 6 << 20) -> DataFrame:
    """doc_id, text, _row and _block: blocks of about block_bytes, by a hash of id and text.

    The block depends on the row alone, so that two passes over the same rows,
    or a repeated task, deal them out alike; copies with ids of their own
    spread over all blocks.  Rows equal in id and text may swap places, which
    changes nothing.
    """
    integer_id(df, doc_id)
    n = max(1, -(-total // block_bytes))
    row = F.xxhash64(col(doc_id), col(text))
    return df.select(col(doc_id).cast("long").alias("_id"), col(text).alias("_text"), row.alias("_row")).withColumn("_block", F.pmod("_row", F.lit(n)).cast("int"))


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows in the order that every pass uses."""
    return table.take(pa.compute.sort_indices(table, sort_keys=[("_id", "ascending"), ("_row", "ascending")], null_placement="at_start"))


def ids(table: pa.Table) -> np.ndarray:
    """The document ids; null comes before all others."""
    return table.column("_id").fill_null(np.iinfo(np.int64).min).to_numpy()


def buckets_for(total: int, each: int = 2_000_000) -> int:
    return max(1, -(-total // each))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def packed(values: np.ndarray) -> bytes:
    """64-bit values as byte planes under zstandard: planes of equal bytes cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(np.uint64)


def packed_sorted(values: np.ndarray) -> bytes:
    """Ascending values, as differences."""
    return packed(np.diff(values, prepend=np.uint64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def bucket_cuts(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of n buckets of the hash range ascending hashes fall in: the buckets, and the cuts between them."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    cut = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 40))), [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    return bucket[cut[:-1]].astype(np.int32), cut


def bits(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool)


def returned(table: pa.Table, hashes: np.ndarray, n: int, column: str = "_bits") -> np.ndarray:
    """The flags that the buckets sent back for a block's ascending hashes."""
    flags = np.zeros(len(hashes), bool)
    buckets, cut = bucket_cuts(hashes, n)
    at = {b: k for k, b in enumerate(buckets.tolist())}
    for b, data in zip(table.column("_bucket").to_pylist(), table.column(column).to_pylist(), strict=True):
        k = at[b]
        flags[cut[k] : cut[k + 1]] = unbits(data, int(cut[k + 1] - cut[k]))
    return flags


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours starts."""
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return np.flatnonzero(first)
