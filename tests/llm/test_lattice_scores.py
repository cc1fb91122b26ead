"""Operator 6's score against expectation maximisation and forward sums in plain Python, over whole documents."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest
from test_operators import LOWER, words

from weirline.llm import lattice_lm, queries


def add(a, b):
    low, high = min(a, b), max(a, b)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def forward(word, log_p, longest):
    out = [0.0] + [-math.inf] * len(word)
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            if (p := log_p.get(word[i:j])) is not None:
                out[j] = add(out[j], out[i] + p)
    return out


def expected(word, log_p, longest):
    before = forward(word, log_p, longest)
    after = [-math.inf] * len(word) + [0.0]
    for i in reversed(range(len(word))):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            if (p := log_p.get(word[i:j])) is not None:
                after[i] = add(after[i], p + after[j])
    out = defaultdict(float)
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            if (p := log_p.get(word[i:j])) is not None:
                out[word[i:j]] += math.exp(before[i] + p + after[j] - before[-1])
    return out


def scores(rows, path, steps):
    weights = lattice_lm.vocabulary(path)
    longest = max(map(len, weights))
    texts = [[b" " + w.encode() for w in words((t or "").translate(LOWER))] for _, t in rows]
    training = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for i, _ in rows]
    counts = Counter(w for t, on in zip(texts, training, strict=True) if on for w in t)
    ends = sum(training)
    p_end = ends / (2 * (sum(counts.values()) + ends) + ends)
    total = sum(weights.values())
    log_p = {k: math.log(v / total * (1 - p_end)) for k, v in weights.items()}
    for _ in range(steps):
        found = dict.fromkeys(log_p, lattice_lm.SMOOTHING)
        for word, n in counts.items():
            for piece, x in expected(word, log_p, longest).items():
                found[piece] += n * x
        p_end = (ends + lattice_lm.SMOOTHING) / (sum(found.values()) + ends + lattice_lm.SMOOTHING)
        whole = sum(found.values()) + ends + lattice_lm.SMOOTHING
        log_p = {k: math.log(v / whole) for k, v in found.items()}
    return [(i, (sum(forward(w, log_p, longest)[-1] for w in t) + math.log(p_end)) / math.log(10)) for (i, _), t in zip(rows, texts, strict=True)]


def test_scores(spark, rows):
    few = [r[:2] for r in rows if len(r[1] or "") < 5_000]
    path = queries.tokenizer_path("piece_bpe_32k.model")
    got = lattice_lm.score(spark.createDataFrame(few, "doc_id bigint, text string").repartition(3), path).collect()
    put = lambda pairs: sorted((-1 if i is None else i, round(s, 5)) for i, s in pairs)
    expected_scores = put(scores(few, path, lattice_lm.EM_STEPS))
    for (i, s), (j, x) in zip(put((r.doc_id, r.score) for r in got), expected_scores, strict=True):
        assert i == j and s == pytest.approx(x, rel=1e-6, abs=1e-4)


def test_a_word_of_200_kilobytes(spark):
    """A text without white space is one word, learned from and scored whole."""
    word = "".join(chr(97 + (k * k) % 26) for k in range(200_000))
    rows = [(0, word), (2, "a few words"), (3, None)]
    path = queries.tokenizer_path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in lattice_lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), path, em_steps=1).collect()}
    assert got[0].n_tokens == 2 and math.isfinite(got[0].score) and got[0].score < got[2].score < 0
