"""Benchmark decontamination (operator 1).

The windows of the benchmark texts become a sorted array of hashes that is
broadcast; document words are hashed window by window and looked up, hits are
verified word by word, and the hit words make spans that can be cut, or mark
documents that can be dropped.

What is broadcast grows with the benchmark, never with the corpus, and is flat
arrays: the benchmark's words as one run of bytes, and for each window a hash,
a place and its items, about 30 bytes a word (building it takes some sixty times the text).  Its size is checked: a
benchmark of more than max_block_bytes of text is dealt into blocks of at most
that size, and the documents pass the blocks one after another, so that the
result is the same.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

NGRAM = 10
MAX_BLOCK_BYTES = 8 << 20
MARKS = "struct<n_words:bigint,n_hit:bigint,n_items:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"


class Windows:
    """The distinct windows of one length: hashes in order, where the words of each stand in `text`,
    and its items, as numbers in a list of names."""

    def __init__(self, size: int, text: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray) -> None:
        self.size, self.text = size, text
        order = np.argsort(hashes, kind="stable")
        hashes, starts, ends, items = hashes[order], starts[order], ends[order], items[order]
        group = np.cumsum(np.append(True, hashes[1:] != hashes[:-1])) - 1
        lead = C.runs(hashes)
        raw = np.frombuffer(text, np.uint8)
        same = (ends - starts) == (ends - starts)[lead][group]
        for a in range(0, len(hashes), 1 << 14):  # are windows of one hash the same words?
            part = slice(a, a + (1 << 14))
            n = np.where(same[part], (ends - starts)[part], 0)
            equal = raw[C.ranges(starts[part], n)] == raw[C.ranges(starts[lead][group[part]], n)]
            fine = np.add.reduceat(np.append(equal, False).astype(np.int64), np.cumsum(n) - n)
            same[part] &= np.where(n > 0, fine >= n, same[part])
        if not same.all():  # a collision: words decide, and a hash stands once for each
            words = np.array([hash(text[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
            order = np.lexsort((words, hashes))
            hashes, starts, ends, items, words = hashes[order], starts[order], ends[order], items[order], words[order]
            group = np.cumsum(np.append(True, (hashes[1:] != hashes[:-1]) | (words[1:] != words[:-1]))) - 1
        n_items = int(items.max()) + 1
        pairs = np.unique(group * n_items + items)
        first = C.runs(group)
        self.hashes, self.starts, self.ends = hashes[first], starts[first].astype(np.int32), ends[first].astype(np.int32)
        self.items, self.begin = (pairs % n_items).astype(np.int32), np.append(C.runs(pairs // n_items), len(pairs)).astype(np.int32)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def maybe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose hash is known, and the window that each may be (one row for each that has the hash)."""
        places = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        low, high = (np.searchsorted(self.hashes, hashes[places], side) for side in ("left", "right"))
        return np.repeat(places, high - low), C.ranges(low, high - low)


def _windows(rows: list, ngram: int) -> tuple[list[str], list[Windows]]:
    """The items' names, and their windows by length."""
    names = sorted({item for item, _ in rows})
    number = {n: k for k, n in enumerate(names)}
    raw = [(text or "").encode() for _, text in rows]
    offs = np.cumsum([0, *map(len, raw)])
    words = C.Words(C.LOWER[np.frombuffer(b"".join(raw), np.uint8)], offs, C.ALNUM)
    text, text_offs = C.kept_words(words, np.ones(len(words.starts), bool))
    lengths = words.ends - words.starts
    of = np.repeat(np.arange(len(raw)), words.counts)
    before = np.cumsum(lengths + 1) - lengths - 1
    starts = before - before[np.minimum(words.first[:-1], max(len(before) - 1, 0))][of] + text_offs[:-1][of] if len(before) else before
    ends, sums = starts + lengths, C.word_sums(words.hashes())
    item = np.array([number[n] for n, _ in rows], np.int64)
    sizes = np.minimum(words.counts, ngram)
    made = []
    for size in sorted(set(sizes[sizes > 0].tolist())):
        own = np.flatnonzero(sizes == size)
        first = C.ranges(words.first[:-1][own], words.counts[own] - size + 1)
        made.append(Windows(size, text.tobytes(), C.word_hashes(sums, first, first + size), starts[first], ends[first + size - 1], item[of[first]]))
    return names, made


def _scan(column: pa.Array, windows: tuple[list[str], list[Windows]]):
    """For each text: its chunk's words, its place among them, which words are hit, its items."""
    data, offs = C.texts(column)
    names, by_size = windows
    for i, j in C.chunks(offs):
        part = C.LOWER[data[offs[i] : offs[j]]]
        words = C.Words(part, offs[i : j + 1] - offs[i], C.ALNUM)
        hashes, raw = words.hashes(), None
        hit = np.zeros(len(hashes), bool)
        text_of = np.repeat(np.arange(j - i), words.counts)
        items: list[set] = [set() for _ in range(j - i)]
        for w in by_size:
            places, which = w.maybe(C.window_hashes(hashes, w.size))
            inside = text_of[places] == text_of[places + w.size - 1]
            for p, k in zip(places[inside].tolist(), which[inside].tolist(), strict=True):
                raw = part.tobytes() if raw is None else raw
                if words.get(p, p + w.size, raw) == w.text[w.starts[k] : w.ends[k]]:
                    hit[p : p + w.size] = True
                    items[text_of[p]].update(w.items[w.begin[k] : w.begin[k + 1]].tolist())
        for k in range(j - i):
            yield words, int(words.first[k]), int(words.first[k + 1]), int(words.offs[k]), hit, {names[n] for n in items[k]}


def _blocks(benchmark: DataFrame, item_id: str, text: str, max_block_bytes: int):
    """The benchmark's rows in blocks of bounded size, one on the driver at a time."""
    rows = benchmark.select(C.col(item_id).cast("string").alias("item"), C.col(text).alias("text"))
    n = max(1, -(-C.text_bytes(rows, "text") // max_block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item if r.item is not None else "", r.text) for r in part.collect()]


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", ngram: int = NGRAM, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """docs with a struct column `contamination`: n_words, n_hit, n_items, items, and spans
    (bytes of the UTF-8 text, end exclusive; runs of hit words).

    Null or empty text: no words, no hits.  An item without words has no
    window; a null item_id counts as ''.  Equal rows get equal marks.  A
    column of that name is replaced; others may have any names.  An empty
    benchmark marks nothing, empty docs give an empty result.  A text is
    scanned in one task, at about forty times its size.
    """
    context = docs.sparkSession.sparkContext
    kept = [c for c in docs.columns if c.lower() != "contamination"]
    at = kept.index(text)
    before = docs.select(*[C.col(c) for c in kept], F.lit(None).cast(MARKS).alias("contamination"))
    schema = before.schema

    def scan(windows, batches):
        for batch in batches:
            marks = [_joined(old, *new) for old, new in zip(batch.column(len(kept)).to_pylist(), _scan(batch.column(at), windows.value), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks, _MARK_TYPE)], names=batch.schema.names)

    marked, k = before, 0
    for k, rows in enumerate(_blocks(benchmark, item_id, item_text, max_block_bytes)):
        if k:
            marked = C.stored(marked, "contamination")
        marked = marked.mapInArrow(partial(scan, context.broadcast(_windows(rows, ngram))), schema)
    return marked


_MARK_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _joined(old: dict | None, words: C.Words, first: int, end: int, start: int, hit: np.ndarray, items: set) -> dict:
    """The marks of one text after one more block of the benchmark."""
    hit = hit[first:end]
    starts, ends = words.starts[first:end] - start, words.ends[first:end] - start
    if old and old["n_hit"]:
        hit = hit.copy()
        for span in old["spans"]:
            hit[np.searchsorted(starts, span["start"]) : np.searchsorted(starts, span["end"])] = True
        items = items | set(old["items"])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))) if hit.any() else np.zeros(0, int)
    spans = [{"start": int(starts[s]), "end": int(ends[e - 1])} for s, e in zip(edge[::2], edge[1::2], strict=True)]
    return {"n_words": end - first, "n_hit": int(hit.sum()), "n_items": len(items), "items": sorted(items), "spans": spans}


def remove(docs: DataFrame, benchmark: DataFrame, *, what: str = "documents", text: str = "text", n_chars: str | None = None, **options) -> DataFrame:
    """docs without contaminated documents, or (what="spans") with the hit spans cut out of
    their texts and n_chars, if named, set anew.  Columns keep their names, whatever those are; an empty
    table gives an empty result, and rows with a null text stay."""
    number = {c: f"_{k}" for k, c in enumerate(docs.columns)}  # so that no name of docs can clash
    marked = mark(docs.select(*[C.col(c).alias(n) for c, n in number.items()]), benchmark, text=number[text], **options)
    back = [F.col(n).alias(c) for c, n in number.items()]
    if what == "documents":
        return marked.where("contamination.n_hit = 0").select(*back)
    cut = marked.withColumn(number[text], F.udf(_cut, "string", useArrow=True)(F.col(number[text]), F.col("contamination.spans")))
    if n_chars:
        cut = cut.withColumn(number[n_chars], F.length(number[text]).cast(docs.schema[n_chars].dataType))
    return cut.select(*back)


def _cut(text: str | None, spans: list | None) -> str | None:
    if not spans or text is None:
        return text
    raw, at, out = text.encode(), 0, []
    for span in spans:
        out.append(raw[at : span["start"]])
        at = span["end"]
    return b"".join([*out, raw[at:]]).decode()
