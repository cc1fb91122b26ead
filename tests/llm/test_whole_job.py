"""What earlier versions left out: each case stands for rows that got lost or were counted twice."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from weirline.llm import decontamination, jaccard, lattice_lm, quality

# 6


def _by_brute_force(pieces, p, word):
    """Expected counts of the pieces in a word, from sums over all paths as logarithms, place by place."""
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b))) if min(a, b) > -math.inf else max(a, b)
    n, forward, backward = len(word), [0.0] + [-math.inf] * len(word), [-math.inf] * len(word) + [0.0]
    for j in range(1, n + 1):
        for piece, x in zip(pieces, p, strict=True):
            if word[:j].endswith(piece):
                forward[j] = add(forward[j], forward[j - len(piece)] + math.log(x))
    for i in reversed(range(n)):
        for piece, x in zip(pieces, p, strict=True):
            if word.startswith(piece, i):
                backward[i] = add(backward[i], backward[i + len(piece)] + math.log(x))
    out = np.zeros(len(pieces))
    for k, piece in enumerate(pieces):
        out[k] = sum(math.exp(forward[i] + math.log(p[k]) + backward[i + len(piece)] - forward[n]) for i in range(n) if word.startswith(piece, i))
    return out


@pytest.mark.parametrize("stretch", [64, 1 << 14])
def test_lattice_learns_from_rare_long_words(monkeypatch, stretch):
    monkeypatch.setattr(lattice_lm, "STRETCH", stretch, raising=False)
    pieces = [b" a", b" ", b"a", b"b", b"c", b"ab", b"bca", b"abcab", b"\x00"]
    p = np.array([0.1, 0.2, 0.1, 0.1, 0.1, 0.15, 0.1, 0.1, 0.05])
    lattice = lattice_lm.Lattice(pieces, np.log(p))
    rng = random.Random(3)
    many = ["".join(rng.choice(["abc", "ab", "c", "b"]) for _ in range(900))[:n].encode() for n in (998, 999, 1000, 1300, 1300)]
    lengths = np.array([len(x) for x in many])
    counts = np.array([2.0, 3.0, 1.0, 4.0, 2.0])
    got = lattice.expected(np.frombuffer(b"".join(many), np.uint8), np.cumsum(lengths) - lengths, lengths, counts)
    assert got == pytest.approx(sum(n * _by_brute_force(pieces, p, b" " + x) for n, x in zip(counts, many, strict=True)))
    # the same word alone and among seven others of its length counts alike
    alone = lattice.expected(np.frombuffer(many[3], np.uint8), np.array([0]), lengths[3:4], np.ones(1))
    assert lattice.expected(np.frombuffer(many[3] * 8, np.uint8), np.arange(8) * 1300, np.full(8, 1300), np.ones(8)) == pytest.approx(8 * alone)
    assert lattice.run(np.frombuffer(b" " + many[3], np.uint8)[None, :], np.ones(1)) == pytest.approx(alone)


# 9


def test_jaccard_links_pairs_that_share_no_band(spark):
    """Of 40 near copies of 200 words, with so few bands that some pairs meet only through a third."""
    base = [f"w{k}" for k in range(200)]
    rows = [(n, " ".join([*base[: 4 * n], f"changed{n}", *base[4 * n + 1 :]])) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs, recall=0.6, tile=16).collect()}
    assert got == {n: (0, 39) for n in range(40)}  # 186 of 206 grams or more are common


def test_jaccard_counts_once_in_empty_blocks(spark):
    """30 pairs of near copies in two blocks each: in a quarter of them both copies fall in the first."""
    near = lambda n, end: " ".join([*(f"p{n}w{k}" for k in range(60)), end])
    rows = [(2 * n + k, near(n, end)) for n in range(30) for k, end in enumerate(("one", "two"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs, tile=1).collect()}
    assert got == {n: (n - n % 2, 1) for n, _ in rows}


# 4 and 1: documents with columns of the stages' own names


def test_stages_keep_columns_of_any_name(spark, docs, rows, empty):
    judged = quality.judge(docs, name="verdict").where("verdict.kept").drop("verdict")
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.schema["quality"].dataType == docs.schema["quality"].dataType
    assert Counter(kept.collect()) == Counter(judged.collect())
    bench = spark.createDataFrame([("1", rows[7][1])], "item_id string, text string")
    left = decontamination.remove(docs, bench)
    assert left.columns == docs.columns and left.schema["contamination"].dataType == docs.schema["contamination"].dataType
    clean = Counter(r.doc_id for r in decontamination.mark(docs, bench).where("contamination.n_hit = 0").collect())
    found = left.collect()
    assert 0 < len(found) < len(rows) and Counter(r.doc_id for r in found) == clean
    assert not Counter(found) - Counter(docs.collect())
    cut = decontamination.remove(docs, bench, what="spans", n_chars="n_chars")
    assert cut.columns == docs.columns and {r.contamination for r in cut.collect()} == {"x"}
    assert decontamination.remove(empty, bench).count() == 0 and quality.keep(empty).count() == 0
