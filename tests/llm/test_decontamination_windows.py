"""Operator 1's window index: items of copies, collisions of hashes, and its size."""

from __future__ import annotations

import random
import sys
from collections import Counter

import numpy as np
from test_operators import contaminated

from weirline.llm import common, decontamination


def test_windows_of_one_hash(monkeypatch, spark):
    """With hashes of four bits nearly all windows collide; words decide."""
    full = common.word_hashes
    monkeypatch.setattr(common, "word_hashes", lambda *a: full(*a) & np.uint64(15 << 44))
    monkeypatch.setattr(common, "window_hashes", lambda words, size: common.word_hashes(common.word_sums(words), np.arange(max(0, len(words) - size + 1)), np.arange(max(0, len(words) - size + 1)) + size))
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["ab", "a", "b", "ba"]) for _ in range(n))
    items = [(str(k % 20), text(rng.randrange(0, 6))) for k in range(40)]
    rows = [(k, text(12)) for k in range(30)]
    windows = decontamination._windows([(i, t) for i, t in items], 3)
    column = spark.createDataFrame(rows, "doc_id bigint, text string").toArrow().column("text")
    got = [(k, n - m, int(hit[m:n].sum()), tuple(sorted(found))) for k, (_, m, n, _, hit, found) in enumerate(decontamination._scan(column, windows))]
    assert Counter(got) == Counter(contaminated(rows, items, 3))


def test_index_is_flat():
    """A megabyte of text makes an index of a few megabytes."""
    rng = random.Random(1)
    rows = [(str(k), " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(170))) for k in range(1000)]
    _, (windows,) = decontamination._windows(rows, 10)
    size = sum(v.nbytes if isinstance(v, np.ndarray) else sys.getsizeof(v) for v in vars(windows).values())
    assert len(windows.hashes) > 150_000 and size < 8 << 20


def test_column_names_with_dots(spark, rows):
    docs = spark.createDataFrame([(1, rows[7][1], "x"), (2, "clean", "y"), (3, None, None)], "`doc.id` bigint, `the text` string, `a.b` string")
    bench = spark.createDataFrame([("1", rows[7][1])], "item_id string, text string")
    cut = decontamination.remove(docs, bench, what="spans", text="the text")
    assert cut.columns == docs.columns and [tuple(r)[2] for r in cut.orderBy("`doc.id`").collect()] == ["x", "y", None]
    assert decontamination.remove(docs, bench, text="the text").count() == 2
