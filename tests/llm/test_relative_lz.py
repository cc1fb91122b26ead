"""Operator 3: removed words against brute force, and every factor against the texts."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from test_operators import key, words

from weirline.llm import relative_lz


def removed(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, math.inf), key(i))
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < key(i):
                gone.update(range(k, k + window))
        out.append((i, t, frozenset(gone)))
    return out


def covered(pairs):
    return frozenset(p for a, b in pairs for p in range(a, b))


def check(rows, out, window):
    """Spans are what brute force removes; factors are true copies from smaller ids, cover the same words, and none goes on."""
    assert Counter((r.doc_id, r.n_words, covered((s.start, s.end) for s in r.spans)) for r in out) == Counter((i, len(words(t)), g) for i, t, g in removed(rows, window))
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(words(t))
    n = 0
    for r in out:
        assert covered((f.start, f.start + f.length) for f in r.factors) == covered((s.start, s.end) for s in r.spans)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
        for f, following in zip(r.factors, [*r.factors, None][1:], strict=True):
            n += 1
            assert f.length >= window and key(f.source) < key(r.doc_id)
            if len(texts[r.doc_id]) == len(texts[f.source]) == 1:
                own, source = texts[r.doc_id][0], texts[f.source][0]
                assert own[f.start : f.start + f.length] == source[f.place : f.place + f.length]
                end, there = f.start + f.length, f.place + f.length
                more = end < len(own) and there < len(source) and own[end] == source[there]
                assert not more or following.start <= end - window + 1  # another document's copy goes on in its place
    return n


def test_factors(docs, rows):
    out = relative_lz.dedup_substrings(docs).collect()
    assert check([r[:2] for r in rows], out, 13) > 10


@pytest.mark.parametrize(("seed", "window", "letters"), [(1, 4, "ab"), (2, 5, "abc"), (3, 13, "abcd"), (4, 1, "abcdefghij"), (5, 2, "abcde")])
def test_factors_of_few_words(spark, seed, window, letters):
    """Texts of so few different words that runs with one seed differ everywhere."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(6)]
    rows = []
    for k in range(60):
        parts = [rng.choice(passages)[rng.randrange(20) :] if rng.random() < 0.5 else " ".join(rng.choice(letters) for _ in range(rng.randrange(20))) for _ in range(rng.randrange(4))]
        rows.append((rng.choice([k, k, k, 7, None]), " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert check(rows, relative_lz.dedup_substrings(df, window=window).collect(), window) > 0


@pytest.mark.parametrize("block", [1, 300])
def test_factors_between_blocks(spark, monkeypatch, rows, block):
    """Blocks of single texts and of a few, so that nearly every source is in another block and bucket."""
    from weirline.llm import common

    cut = common.in_blocks
    monkeypatch.setattr(common, "in_blocks", lambda df, i, t, total: cut(df, i, t, total, 1 + total // block))
    monkeypatch.setattr(common, "buckets_for", lambda total, each=0: 5)
    few = [r[:2] for r in rows if len(r[1] or "") < 20_000]
    df = spark.createDataFrame(few, "doc_id bigint, text string")
    assert check(few, relative_lz.dedup_substrings(df).collect(), 13) > 10


def test_ids_are_integers(spark):
    with pytest.raises(TypeError):
        relative_lz.dedup_substrings(spark.createDataFrame([("doc-a", "x")], "doc_id string, text string"))
