"""The pipeline's stages, each against brute force on its own input, over the smallest documents."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import base, contaminated, links_of, words  # noqa: E402

from weirline.llm import common, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(common.stored(stage(spark, states[-1], SF), "test"))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert states[-1].columns == docs.columns
    rows = [[(r.doc_id, r.text, r.lang, r.source) for r in s.collect()] for s in states[:-1]]
    assert set(rows[1]) <= set(rows[0]) and not any(base(t)[-1] for _, t, *_ in rows[1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r for r in rows[0] if labels.get(r[0]) == 1 and not base(r[1])[-1]]
    assert len(set(clean) & set(rows[1])) >= 0.98 * len(clean)
    links, n_groups = links_of(rows[1])
    assert sorted(r[0] for r in rows[2]) == sorted({c for _, c, _ in links}) and len(rows[2]) == n_groups
    hits = {i: n for i, _, n, _ in contaminated(rows[2], items)}
    assert Counter(rows[3]) == Counter(r for r in rows[2] if not hits[r[0]])
    taken = Counter(rows[4])
    assert set(taken) <= set(rows[3]) and max(taken.values()) <= 2
    assert abs(sum(len(words(t)) * n for (_, t, *_), n in taken.items()) - 1.5 * sum(len(words(t)) for _, t, *_ in rows[3])) < 0.1 * sum(len(words(t)) for _, t, *_ in rows[3])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    at, expected = 0, []
    for i, text, *_ in sorted(rows[4]):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in states[-1].collect()) == expected
