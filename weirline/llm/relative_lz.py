"""Substring dedup (operator 3): relative Lempel-Ziv parsing against the corpus' own blocks.

The corpus is its own reference, cut into blocks of documents, and every block
is indexed.  A document is parsed from the left into factors (source document,
place, length): copies of word runs that start in a document with a smaller
id.  Factors of 13 words and more are duplicate spans.

1. Index.  Of each window of 13 words the 7-word seed with the least hash is
   taken, which depends on the words alone, so that copies of a window have
   their seed at the same offset.  Neighbouring windows with one seed make a
   run, four windows in the mean.  A block's index holds each of its runs once:
   the hash of its seed, the hash of the whole run, and the first document and
   place that hold it.
2. Lookup.  The indexes of all blocks meet by seed in buckets of the hash range.
   A run that a smaller document holds is a copy as a whole, and its block
   learns where from.  Where one seed stands in different runs, a match begins
   or ends inside one of them: only those runs' windows are looked up one by
   one, by hashes of their own.  These are the factors' boundaries.
3. Parse.  From the left, a factor begins at the first window that has a source
   and goes on as long as the next window's source is the next place of the
   same document.  The next factor may begin inside the last one, at the first
   window that goes on beyond its end, so that no copied window is lost between
   two factors.

Only hashes travel, a block's own copies of a run as one entry; sources come
back for copies alone.  Blocks and buckets are of bounded size, whatever a
passage's or a document's share of the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from . import common as C

WINDOW = 13
_WORD = ~C.SPACE
_NO_ID = np.iinfo(np.int64).min


class _Runs:
    """The runs of a chunk of texts: the windows first to last (inclusive) have their seed at `at`."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int) -> None:
        self.words, self.window = C.Words(data, offs, _WORD), window
        hashes = self.words.hashes()
        self.sums = C.word_sums(hashes)
        seed = (window + 1) // 2
        valid = np.flatnonzero(C.within(self.words.first, len(hashes), window))
        if not len(valid):
            self.first = self.last = at = np.zeros(0, np.int64)
        else:
            low = C.window_hashes(hashes, seed)
            low &= ~np.uint64(0xFFFFFFFF)
            low |= np.arange(len(low), dtype=np.uint64)
            at = (C.sliding_least(low, window - seed + 1)[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            cut = C.runs(at)
            self.first, at = valid[cut], at[cut]
            self.last = valid[np.append(cut[1:], len(valid)) - 1]
        self.text = np.searchsorted(self.words.first, self.first, "right") - 1
        self.place = self.first - self.words.first[self.text]
        #: Seeds have the least hashes, so a seed is hashed once more, or the first bucket would get most.
        self.heads = C.mix(C.word_hashes(self.sums, at, at + seed) + np.uint64(1))
        self.wholes = C.mix(C.word_hashes(self.sums, self.first, self.last + window) + (at - self.first).astype(np.uint64))

    def names(self, starts: np.ndarray) -> np.ndarray:
        return C.word_hashes(self.sums, starts, starts + self.window)


class _Block:
    """The runs of a block of documents, in order of document and place, and its distinct runs in order of seed."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.table = C.in_order(table)
        ids = C.ids(self.table)
        data, offs = C.texts(self.table.column("_text"))
        self.chunks = [(i, j, _Runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], window)) for i, j in C.chunks(offs)]
        put = lambda kind, of: np.concatenate([np.zeros(0, kind), *[of(i, c) for i, _, c in self.chunks]])
        heads, wholes = put(np.uint64, lambda i, c: c.heads), put(np.uint64, lambda i, c: c.wholes)
        self.owner, self.place = put(np.int64, lambda i, c: ids[i + c.text]), put(np.int64, lambda i, c: c.place)
        self.n_windows = put(np.int64, lambda i, c: c.last - c.first + 1)
        order = np.lexsort((wholes, heads))  # stable, so the first of equal runs is the smallest document's
        new = np.ones(len(order), bool)
        new[1:] = (heads[order][1:] != heads[order][:-1]) | (wholes[order][1:] != wholes[order][:-1])
        self.first = order[new]
        self.heads, self.wholes = heads[self.first], wholes[self.first]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def open_windows(self, more: np.ndarray):
        """The windows of open runs, each distinct run's once: names, documents, places, and per run where its windows begin."""
        reps = np.sort(self.first[more])
        begin = np.full(len(self.owner), -1)
        begin[reps] = np.cumsum(self.n_windows[reps]) - self.n_windows[reps]
        names, at = [np.zeros(0, np.uint64)], 0
        for _, _, c in self.chunks:
            own = reps[(reps >= at) & (reps < at + len(c.first))] - at
            names.append(c.names(C.ranges(c.first[own], (c.last - c.first + 1)[own])))
            at += len(c.first)
        n = self.n_windows[reps]
        return np.concatenate(names), np.repeat(self.owner[reps], n), C.ranges(self.place[reps], n), begin


def _firsts(names: np.ndarray):
    """Distinct names, the first place of each, and each place's name."""
    if not len(names):
        return names, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(names, return_index=True, return_inverse=True)


SENT = "_block int, _bucket int, _heads binary, _wholes binary, _docs binary, _places binary"
ANSWER = "_block int, _bucket int, _found binary, _more binary, _docs binary, _places binary"


def _sent(block: int, heads: np.ndarray, wholes: np.ndarray | None, docs: np.ndarray, places: np.ndarray, n_buckets: int) -> pa.Table:
    buckets, cut = C.bucket_cuts(heads, n_buckets)
    parts = [slice(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    pack = lambda x: pa.array([None if x is None else C.packed(x[p].view(np.uint64)) for p in parts], pa.binary())
    return pa.table({"_block": pa.array([block] * len(parts), pa.int32()), "_bucket": buckets, "_heads": pa.array([C.packed_sorted(heads[p]) for p in parts], pa.binary()), "_wholes": pack(wholes), "_docs": pack(docs), "_places": pack(places)})


def _send_runs(n_buckets: int, window: int):
    def send(table: pa.Table) -> pa.Table:
        b = _Block(table, window)
        return _sent(table.column("_block")[0].as_py(), b.heads, b.wholes, b.owner[b.first], b.place[b.first], n_buckets)

    return send


def _send_windows(n_runs: int, n_windows: int, window: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not len(table):
            return _sent(0, none.view(np.uint64), None, none, none, n_windows)
        b = _Block(table, window)
        names, docs, places, _ = b.open_windows(C.returned(answers, b.heads, n_runs, "_more"))
        order = np.lexsort((places, docs))
        known, first, _ = _firsts(names[order])
        return _sent(table.column("_block")[0].as_py(), known, None, docs[order][first], places[order][first], n_windows)

    return send


def _meet(table: pa.Table) -> pa.Table:
    """One bucket of the blocks' indexes.  _found: a smaller document holds the entry; _docs and
    _places say where.  _more: none holds it all, but a run with the same seed has another document."""
    heads = [C.unpacked_sorted(x) for x in table.column("_heads").to_pylist()]
    together = lambda column: np.concatenate([C.unpacked(x) for x in table.column(column).to_pylist()]).view(np.int64)
    docs, places = together("_docs"), together("_places")
    ends = np.cumsum([len(x) for x in heads])
    heads = np.concatenate(heads)
    wholes = np.zeros(len(heads), np.int64) if table.column("_wholes").null_count else together("_wholes")
    order = np.lexsort((places, docs, wholes, heads))
    h, w, d, p = heads[order], wholes[order], docs[order], places[order]
    new_head = np.ones(len(h), bool)
    new_head[1:] = h[1:] != h[:-1]
    new_run = new_head.copy()
    new_run[1:] |= w[1:] != w[:-1]
    runs, run = np.flatnonzero(new_run), np.cumsum(new_run) - 1
    source, place = d[runs][run], p[runs][run]
    of_head = C.runs(h[runs])  # the distinct runs of each seed
    low, high = np.minimum.reduceat(d[runs], of_head), np.maximum.reduceat(d[runs], of_head)
    several = np.repeat(low < high, np.diff(of_head, append=len(runs)))[run]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    found, more = (d > source)[back], (several & (d == source))[back]
    source, place = source[back], place[back]
    out: dict[str, list] = {"_found": [], "_more": [], "_docs": [], "_places": []}
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        on = found[a:b]
        out["_found"].append(C.bits(on))
        out["_more"].append(C.bits(more[a:b]))
        out["_docs"].append(C.packed(source[a:b][on].view(np.uint64)))
        out["_places"].append(C.packed(place[a:b][on].view(np.uint64)))
    return pa.table({"_block": table.column("_block"), "_bucket": table.column("_bucket"), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})


def _sources(answers: pa.Table, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of a block's ascending names have a source, and its document and place."""
    found, docs, places = np.zeros(len(names), bool), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    buckets, cut = C.bucket_cuts(names, n)
    at = {b: k for k, b in enumerate(buckets.tolist())}
    for b, flags, d, p in zip(*(answers.column(c).to_pylist() for c in ("_bucket", "_found", "_docs", "_places")), strict=True):
        a, e = int(cut[at[b]]), int(cut[at[b] + 1])
        found[a:e] = C.unbits(flags, e - a)
        docs[a:e][found[a:e]] = C.unpacked(d).view(np.int64)
        places[a:e][found[a:e]] = C.unpacked(p).view(np.int64)
    return found, docs, places


RESULT = "doc_id long, text string, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, factors array<struct<start:int,length:int,source:long,place:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("place", pa.int32())])


def _lists(kind: pa.StructType, counts: np.ndarray, *columns) -> pa.Array:
    made = pa.StructArray.from_arrays([pa.array(x, f.type) if isinstance(x, np.ndarray) else x for x, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), made)


def factors(starts: np.ndarray, docs: np.ndarray, places: np.ndarray, base: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of ascending windows that have sources, of texts that begin at base: each factor's start, length, source and place."""
    goes_on = np.zeros(len(starts), bool)
    goes_on[1:] = (starts[1:] == starts[:-1] + 1) & (docs[1:] == docs[:-1]) & (places[1:] == places[:-1] + 1)
    first = np.flatnonzero(~goes_on | np.isin(starts, base))
    return starts[first], np.diff(first, append=len(starts)) + window - 1, docs[first], places[first]


def _parse(n_runs: int, n_windows: int, window: int, with_text: bool):
    def parse(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(table, window)
        of_runs = answers.filter(pa.compute.equal(answers.column("_level"), 1))
        of_windows = answers.filter(pa.compute.equal(answers.column("_level"), 2))
        found, docs, places = _sources(of_runs, b.heads, n_runs)
        own = b.first[b.which]
        local = ~found[b.which] & (b.owner[own] < b.owner)  # an earlier document of this block
        whole = found[b.which] | local
        source, place = np.where(local, b.owner[own], docs[b.which]), np.where(local, b.place[own], places[b.which])
        names, w_docs, w_places, begin = b.open_windows(C.returned(of_runs, b.heads, n_runs, "_more"))
        order = np.lexsort((w_places, w_docs))
        known, first, where = _firsts(names[order])
        w_found, k_docs, k_places = _sources(of_windows, known, n_windows)
        at_first = order[first]
        w_which = np.empty(len(names), np.int64)
        w_which[order] = where
        w_local = ~w_found[w_which] & (w_docs[at_first][w_which] < w_docs)
        w_source = np.where(w_local, w_docs[at_first][w_which], k_docs[w_which])
        w_place = np.where(w_local, w_places[at_first][w_which], k_places[w_which])
        w_has = w_found[w_which] | w_local

        at, kept, sha, n_words, n_removed = 0, [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        spans, made = [], []
        for i, j, c in b.chunks:
            runs = slice(at, at + len(c.first))
            at += len(c.first)
            n = c.last - c.first + 1
            all_of = np.flatnonzero(whole[runs])
            parts = np.flatnonzero(~whole[runs] & (begin[own[runs]] >= 0))
            window_of = C.ranges(begin[own[runs]][parts], n[parts])
            has = w_has[window_of]
            starts = np.concatenate([C.ranges(c.first[all_of], n[all_of]), C.ranges(c.first[parts], n[parts])[has]])
            from_docs = np.concatenate([np.repeat(source[runs][all_of], n[all_of]), w_source[window_of[has]]])
            from_places = np.concatenate([C.ranges(place[runs][all_of], n[all_of]), w_place[window_of[has]]])
            order = np.argsort(starts)
            f_start, f_length, f_source, f_place = factors(starts[order], from_docs[order], from_places[order], c.words.first, window)
            words, base = c.words, c.words.first
            gone = C.cover(starts, window, len(words.starts))
            edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
            edge[base[:-1][base[:-1] < len(gone)]] = gone[base[:-1][base[:-1] < len(gone)]]  # a text's first word begins a span of its own
            s_start = np.flatnonzero(edge > 0)
            stops = np.append(~gone, True)
            stops[base[1:]] = True
            s_end = np.flatnonzero(stops)[np.searchsorted(np.flatnonzero(stops), s_start, "right")]
            of_span, of_factor = (np.searchsorted(base, x, "right") - 1 for x in (s_start, f_start))
            spans.append((np.bincount(of_span, minlength=j - i), s_start - base[of_span], s_end - base[of_span]))
            made.append((np.bincount(of_factor, minlength=j - i), f_start - base[of_factor], f_length, f_source, f_place))
            left, offs = C.kept_words(words, ~gone)
            n_words.append(words.counts)
            n_removed.append(np.diff(np.concatenate([[0], np.cumsum(gone)])[base]))
            for k in range(j - i):
                raw = left[offs[k] : offs[k + 1]].tobytes()
                sha.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw.decode() if with_text else None)
        joined = lambda parts, width: [np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]]) for k in range(width)]
        s_count, s_start, s_end = joined(spans, 3)
        f_count, f_start, f_length, f_source, f_place = joined(made, 5)
        source_ids = pa.array(f_source, mask=f_source == _NO_ID)
        return pa.table(
            {
                "doc_id": b.table.column("_id"),
                "text": pa.array(kept, pa.string()),
                "n_words": np.concatenate(n_words),
                "n_removed": np.concatenate(n_removed),
                "kept_sha256": pa.array(sha, pa.string()),
                "spans": _lists(_SPAN, s_count, s_start, s_end),
                "factors": _lists(_FACTOR, f_count, f_start, f_length, source_ids, f_place),
            }
        )

    return parse


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, text (the kept words, null unless with_text), n_words, n_removed, kept_sha256, spans
    (of removed words, end exclusive) and factors (start, length, the source's doc_id and the place in
    it, all in words) of every row.

    A window is removed if its words also start in a document with a smaller
    id; windows are judged on the input.  Ids are integers (TypeError if not);
    rows of one id are the same document, null is the smallest id, and a null
    or empty text has no words, no spans and no factors.  An empty table gives
    an empty result.  Runs and windows are compared by 64-bit hashes.  Other
    columns, whatever their names, are not read.  A task holds one block, of
    about 6 MB or one text, at about forty times its size, so that a text of
    20 MB takes about 800 MB.
    """
    total = C.text_bytes(docs, text)
    n_runs, n_windows = C.buckets_for(total // 24, 500_000), C.buckets_for(total // 12, 1_000_000)
    blocks = C.in_blocks(docs, doc_id, text, total)
    by_block = blocks.groupBy("_block")
    of_runs = by_block.applyInArrow(_send_runs(n_runs, window), SENT).groupBy("_bucket").applyInArrow(_meet, ANSWER)
    of_windows = by_block.cogroup(of_runs.groupBy("_block")).applyInArrow(_send_windows(n_runs, n_windows, window), SENT).groupBy("_bucket").applyInArrow(_meet, ANSWER)
    answers = of_runs.selectExpr("*", "1 as _level").unionByName(of_windows.selectExpr("*", "2 as _level"))
    return by_block.cogroup(answers.groupBy("_block")).applyInArrow(_parse(n_runs, n_windows, window, with_text), RESULT)
