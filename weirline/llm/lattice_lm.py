"""LM scoring (operator 6): the likelihood of a text over its whole subword lattice.

The pieces of an existing vocabulary, weighted by its scores, span a lattice
over each word: every way to cut the word into pieces is a path.  A forward
recursion in log space sums all paths, so the score is the text's marginal
probability and no single segmentation's.  The vocabulary is not changed; its
weights are re-estimated by expectation maximisation on the training
documents, where the expected counts come from the same lattices.

A piece begins a word or lies inside one and never holds a space, so a text's
probability is the product of its words' and the end's.  Each distinct word of
the corpus is therefore counted and scored once, in the bucket of its hash;
blocks of documents send their distinct words there and get counts and scores
back.  Of the corpus only 32,000 expected counts reach the driver.
"""

from __future__ import annotations

import math
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FOLDS, HELD_OUT = 5, 1
EM_STEPS = 3
SMOOTHING = 0.1  # of a count, for each piece
STRETCH = 1 << 14  # bytes of a long word whose edges are held at once
_WORD = ~C.SPACE
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64(42)


def vocabulary(path: str) -> dict[bytes, float]:
    """Weights of the pieces of a sentencepiece model, and of all single bytes; a space stands for
    the mark of a word's start.

    A model merged by rank has minus the rank as its score; its weight is that
    of Zipf's law.  Scores that are logarithms of probabilities are used as
    they are.  Bytes that are no piece get the least weight there is.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i).replace("▁", " ").encode(): model.get_score(i) for i in normal}
    ranks = min(scores.values()) < -1000
    weights = {k: 1.0 / (10.0 - s) if ranks else math.exp(s) for k, s in scores.items()}
    least = min(weights.values())
    return weights | {bytes([b]): least for b in range(256) if bytes([b]) not in weights}


class Lattice:
    """All segmentations of words into weighted pieces."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray) -> None:
        self.pieces, self.log_p = {p: k for k, p in enumerate(pieces)}, log_p
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.is_piece, self.is_prefix = np.zeros(1 << 22, bool), np.zeros(1 << 22, bool)
        self.is_piece[((hashes * _SPREAD) >> _BITS).astype(np.int64)] = True
        prefixes = np.array([self._hash(x) for x in {p[:n] for p in pieces for n in range(1, len(p) + 1)}], np.uint64)
        self.is_prefix[((prefixes * _SPREAD) >> _BITS).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _edges(self, letters: np.ndarray, at: int):
        """(length, rows, pieces) of the pieces that begin at that place of the rows."""
        alive = np.arange(len(letters))
        h = np.zeros(len(letters), np.uint64)
        for n in range(1, min(self.longest, letters.shape[1] - at) + 1):
            h = h * _BASE + letters[alive, at + n - 1] + np.uint64(1)
            code = ((h * _SPREAD) >> _BITS).astype(np.int64)
            on = self.is_prefix[code]
            alive, h, code = alive[on], h[on], code[on]
            if not len(alive):
                return
            maybe = np.flatnonzero(self.is_piece[code])
            found = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            true = self.hashes[found] == h[maybe]
            if true.any():
                yield n, alive[maybe[true]], self.order[found[true]]

    def run(self, letters: np.ndarray, counts: np.ndarray | None = None):
        """Log probability of each row of letters (words of one length, with the space before
        them); with counts, the pieces' expected counts instead."""
        n, length = letters.shape
        letters = letters.astype(np.uint64)
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        kept = []
        for at in range(length):
            for size, rows, pieces in self._edges(letters, at):
                alpha[at + size, rows] = np.logaddexp(alpha[at + size, rows], alpha[at, rows] + self.log_p[pieces])
                if counts is not None:
                    kept.append((at, size, rows, pieces))
        if counts is None:
            return alpha[length]
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = 0
        expected = np.zeros(len(self.log_p))
        for at, size, rows, pieces in reversed(kept):
            onward = self.log_p[pieces] + beta[at + size, rows]
            beta[at, rows] = np.logaddexp(beta[at, rows], onward)
            expected += np.bincount(pieces, np.exp(alpha[at, rows] + onward - alpha[length, rows]) * counts[rows], len(expected))
        return expected

    def long_word(self, word: bytes) -> float:
        """The same for one word, for lengths of which there are few."""
        alpha = [0.0] + [-math.inf] * len(word)
        for at in range(len(word)):
            for n in range(1, min(self.longest, len(word) - at) + 1):
                k = self.pieces.get(word[at : at + n])
                if k is not None:
                    a, b = alpha[at + n], alpha[at] + float(self.log_p[k])
                    alpha[at + n] = b + math.log1p(math.exp(a - b)) if a < b else a + math.log1p(math.exp(b - a))
        return alpha[-1]

    def long_expected(self, word: bytes) -> np.ndarray:
        """The pieces' expected counts in one word of any length: of the edges only one stretch's are
        held, and they are made again going backwards."""
        length = len(word)
        padded = np.frombuffer(word + bytes(self.longest), np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.longest)[:length]
        alpha = array("d", [-math.inf]) * (length + 1)
        alpha[0] = 0.0
        for first in range(0, length, STRETCH):
            at, to, pieces = self._stretch(windows, first)
            for i, j, p in zip(at.tolist(), to.tolist(), self.log_p[pieces].tolist(), strict=True):
                a, b = alpha[j], alpha[i] + p
                if b > -math.inf:
                    alpha[j] = b + math.log1p(math.exp(a - b)) if a < b else a + math.log1p(math.exp(b - a))
        beta = array("d", [-math.inf]) * (length + 1)
        beta[length] = 0.0
        expected = np.zeros(len(self.log_p))
        before, after = np.frombuffer(alpha), np.frombuffer(beta)
        for first in reversed(range(0, length, STRETCH)):
            at, to, pieces = self._stretch(windows, first)
            for i, j, p in zip(at[::-1].tolist(), to[::-1].tolist(), self.log_p[pieces[::-1]].tolist(), strict=True):
                a, b = beta[i], beta[j] + p
                if b > -math.inf:
                    beta[i] = b + math.log1p(math.exp(a - b)) if a < b else a + math.log1p(math.exp(b - a))
            expected += np.bincount(pieces, np.exp(before[at] + self.log_p[pieces] + after[to] - alpha[length]), len(expected))
        return expected

    def _stretch(self, windows: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of the edges that begin in one stretch of a word, in order of their begin."""
        none = np.zeros(0, np.int64)
        edges = [(none, none, none), *((rows + first, rows + first + n, pieces) for n, rows, pieces in self._edges(windows[first : first + STRETCH], 0))]
        at, to, pieces = (np.concatenate(x) for x in zip(*edges, strict=True))
        inside = np.flatnonzero(to <= len(windows))  # and not in the padding
        inside = inside[np.argsort(at[inside], kind="stable")]
        return at[inside], to[inside], pieces[inside]

    def _groups(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """(rows, letters) of words of one length, at most 20,000 of them."""
        order = np.argsort(lengths, kind="stable")
        cut = np.append(C.runs(lengths[order]), len(order))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            for k in range(a, b, 20_000):
                rows = order[k : min(b, k + 20_000)]
                n = int(lengths[rows[0]])
                letters = np.full((len(rows), n + 1), 0x20, np.uint8)
                letters[:, 1:] = data[starts[rows][:, None] + np.arange(n)]
                yield rows, letters

    def scores(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = np.empty(len(starts))
        for rows, letters in self._groups(data, starts, lengths):
            if len(rows) < 8 and letters.shape[1] > 40:
                out[rows] = [self.long_word(x.tobytes()) for x in letters]
            else:
                out[rows] = self.run(letters)
        return out

    def expected(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.log_p))
        for rows, letters in self._groups(data, starts, lengths):
            if letters.shape[1] <= 1000:
                total += self.run(letters, counts[rows])
            else:  # run() would hold all edges of all places
                for word, n in zip(letters, counts[rows].tolist(), strict=True):
                    total += n * self.long_expected(word.tobytes())
        return total


def _in_training(ids: list, folds: int, held_out: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % folds != held_out for x in ids], bool)


class _Block:
    """The distinct words of a block of documents, in order of their hashes."""

    def __init__(self, table: pa.Table, folds: int, held_out: int) -> None:
        self.table = C.in_order(table)
        self.training = _in_training(self.table.column("_id").to_pylist(), folds, held_out)
        data, offs = C.texts(self.table.column("_text"))
        self.data = C.LOWER[data]
        hashes, starts, ends, counts = [], [], [], []
        for i, j in C.chunks(offs):
            words = C.Words(self.data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], _WORD)
            hashes.append(words.hashes())
            starts.append(words.starts + offs[i])
            ends.append(words.ends + offs[i])
            counts.append(words.counts)
        none = np.zeros(0, np.int64)
        self.per_text = np.concatenate([none, *counts])
        starts, ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.hashes, first, self.which = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_index=True, return_inverse=True)
        self.starts, self.lengths = starts[first], (ends - starts)[first]
        weight = np.repeat(self.training, self.per_text)
        self.counts = np.bincount(self.which[weight], minlength=len(first)).astype(np.uint64)


SENT = "_block int, _bucket int, _lengths binary, _letters binary, _counts binary"


def _send(n_buckets: int, folds: int, held_out: int):
    def send(table: pa.Table) -> pa.Table:
        block, pack = _Block(table, folds, held_out), zstandard.ZstdCompressor(level=1)
        buckets, cut = C.bucket_cuts(block.hashes, n_buckets)
        lengths, letters, counts = [], [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            lengths.append(C.packed(block.lengths[a:b].astype(np.uint64)))
            letters.append(pack.compress(block.data[C.ranges(block.starts[a:b], block.lengths[a:b])].tobytes()))
            counts.append(C.packed(block.counts[a:b]))
        number = table.column("_block")[0].as_py()
        return pa.table({"_block": pa.array([number] * len(buckets), pa.int32()), "_bucket": buckets, "_lengths": pa.array(lengths, pa.binary()), "_letters": pa.array(letters, pa.binary()), "_counts": pa.array(counts, pa.binary())})

    return send


def _words(table: pa.Table):
    """The distinct words of one bucket and their counts in training, and each block's place among them."""
    unpack = zstandard.ZstdDecompressor()
    lengths = [C.unpacked(x).astype(np.int64) for x in table.column("_lengths").to_pylist()]
    data = np.frombuffer(b"".join(unpack.decompress(x) for x in table.column("_letters").to_pylist()), np.uint8)
    counts = np.concatenate([C.unpacked(x) for x in table.column("_counts").to_pylist()])
    ends_of_blocks = np.cumsum([len(x) for x in lengths])
    lengths = np.concatenate(lengths)
    ends = np.cumsum(lengths)
    _, first, which = np.unique(C.byte_hashes(data, ends - lengths, ends), return_index=True, return_inverse=True)
    total = np.bincount(which, counts.astype(float)).astype(np.int64)
    return data, (ends - lengths)[first], lengths[first], total, which, ends_of_blocks


COUNTED = "_bucket int, _n long, _tokens long, _lengths binary, _letters binary, _counts binary"


def _count(table: pa.Table) -> pa.Table:
    """A bucket's words in training, once each."""
    data, starts, lengths, total, _, _ = _words(table)
    known = np.flatnonzero(total > 0)
    letters = zstandard.ZstdCompressor(level=1).compress(data[C.ranges(starts[known], lengths[known])].tobytes())
    return pa.table({"_bucket": table.column("_bucket").slice(0, 1), "_n": pa.array([len(known)], pa.int64()), "_tokens": pa.array([int(total.sum())], pa.int64()), "_lengths": pa.array([C.packed(lengths[known].astype(np.uint64))], pa.binary()), "_letters": pa.array([letters], pa.binary()), "_counts": pa.array([C.packed(total[known].astype(np.uint64))], pa.binary())})


def _expected(lattice):
    """The expected counts of the pieces in each row's words, summed up by task."""

    def run(batches):
        unpack, total = zstandard.ZstdDecompressor(), None
        for batch in batches:
            for lengths, letters, counts in zip(*(batch.column(c).to_pylist() for c in ("_lengths", "_letters", "_counts")), strict=True):
                lengths = C.unpacked(lengths).astype(np.int64)
                found = lattice.value.expected(np.frombuffer(unpack.decompress(letters), np.uint8), np.cumsum(lengths) - lengths, lengths, C.unpacked(counts).astype(float))
                total = found if total is None else total + found
        if total is not None:
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["_piece", "_expected"])

    return run


ANSWER = "_block int, _bucket int, _counts binary, _scores binary"


def _answer(lattice):
    def answer(table: pa.Table) -> pa.Table:
        data, starts, lengths, total, which, ends = _words(table)
        scores = lattice.value.scores(data, starts, lengths) / math.log(10)
        back = lambda x: pa.array([C.packed(part) for part in np.split(x[which], ends[:-1])], pa.binary())
        return pa.table({"_block": table.column("_block"), "_bucket": table.column("_bucket"), "_counts": back(total.astype(np.uint64)), "_scores": back(scores.view(np.uint64))})

    return answer


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(n_buckets: int, folds: int, held_out: int, tokens: int, distinct: int, ends: int, log_end: float):
    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table, folds, held_out)
        counts, scores = np.zeros(len(block.hashes)), np.zeros(len(block.hashes))
        buckets, cut = C.bucket_cuts(block.hashes, n_buckets)
        at = {b: k for k, b in enumerate(buckets.tolist())}
        for b, c, s in zip(*(answers.column(x).to_pylist() for x in ("_bucket", "_counts", "_scores")), strict=True):
            part = slice(int(cut[at[b]]), int(cut[at[b] + 1]))
            counts[part] = C.unpacked(c)
            scores[part] = C.unpacked(s).view(float)
        text = np.repeat(np.arange(len(block.per_text)), block.per_text)
        sums = lambda x: np.bincount(text, x[block.which], len(block.per_text))
        below = math.log10(tokens + 0.5 * (distinct + 1))
        n_tokens = block.per_text + 1
        base = sums(np.log10(counts + 0.5)) + math.log10(ends + 0.5) - n_tokens * below
        known = sums((counts > 0).astype(float)).astype(np.int64) + int(ends > 0)
        return pa.table({"doc_id": block.table.column("_id"), "held_out": ~block.training, "n_tokens": n_tokens, "n_known": known, "train_tokens": np.full(len(n_tokens), tokens, np.int64), "base_score": base, "score": sums(scores) + log_end / math.log(10)})

    return finish


def score(docs: DataFrame, vocabulary_path: str, *, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, em_steps: int = EM_STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Documents whose crc32 of the id as text is held_out modulo folds are not
    learned from; a null id counts as ''.  Tokens are words, A-Z lower-cased,
    and one end; a null or empty text is one end.  base_score is the word
    unigram's with half a count added, score the lattice's.  With no training
    documents all counts are 0.  Ids are integers (TypeError if not); rows of
    one id are rows of their own.  An empty table gives an empty result.  Other
    columns, whatever their names, are not read.  A task holds one block, of
    about 6 MB or one text, at about forty times its size; a word of any length
    is scored and learned from.
    """
    C.integer_id(docs, doc_id)
    spark = docs.sparkSession
    total = C.text_bytes(docs, text)
    n_buckets = C.buckets_for(total // 60, 200_000)
    in_training = F.pmod(F.crc32(F.coalesce(C.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != held_out
    blocks = lambda rows: C.in_blocks(rows, doc_id, text, total)
    sent = lambda rows: rows.groupBy("_block").applyInArrow(_send(n_buckets, folds, held_out), SENT).groupBy("_bucket")

    words = C.stored(sent(blocks(docs.where(in_training))).applyInArrow(_count, COUNTED), "words")
    sums = words.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_tokens"), F.lit(0)).alias("tokens")).first()
    ends = docs.where(in_training).count()
    tokens, distinct = sums.tokens + ends, sums.n + int(ends > 0)

    weights = vocabulary(vocabulary_path)
    pieces = list(weights)
    p = np.array(list(weights.values()))
    p_end = 1 / 500 if not ends else ends / (2 * tokens + ends)
    p = p / p.sum() * (1 - p_end)
    for _ in range(em_steps if ends else 0):
        held = spark.sparkContext.broadcast(Lattice(pieces, np.log(p)))
        counts = np.full(len(pieces) + 1, SMOOTHING)
        counts[-1] += ends
        for row in words.mapInArrow(_expected(held), "_piece int, _expected double").groupBy("_piece").agg(F.sum("_expected").alias("_n")).collect():  # at most a row a piece
            counts[row._piece] += row._n
        p, p_end = counts[:-1] / counts.sum(), counts[-1] / counts.sum()
    held = spark.sparkContext.broadcast(Lattice(pieces, np.log(p)))

    rows = blocks(docs)
    answers = sent(rows).applyInArrow(_answer(held), ANSWER)
    return rows.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(_finish(n_buckets, folds, held_out, tokens, distinct, ends, math.log(p_end)), RESULT)
