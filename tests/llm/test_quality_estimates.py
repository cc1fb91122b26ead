"""Operator 4's verdict against minimum-covariance-determinant estimates in plain NumPy over whole groups."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from weirline.llm import quality

SF = "/root/testdata/sf0.01"


def _groups(rows):
    own = Counter((r.lang, r.source) for r in rows)
    small = Counter(lang for lang, source in own.elements() if own[lang, source] < quality.LEAST_GROUP)
    out = defaultdict(list)
    for k, r in enumerate(rows):
        if own[r.lang, r.source] >= quality.LEAST_GROUP:
            out[r.lang, r.source].append(k)
        else:
            out[(r.lang,) if small[r.lang] >= quality.LEAST_GROUP else ()].append(k)
    return out


def _estimate(x):
    """Exact concentration steps over all documents, from both starts; the lesser determinant."""
    floor = np.diag(np.array(list(quality.STATISTICS.values())) ** 2)
    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    spread = np.maximum((high - low) / 1.349, np.sqrt(np.diag(floor)))
    squeezed = np.tanh((x - middle) / spread)
    with np.errstate(invalid="ignore", divide="ignore"):
        alike = np.nan_to_num(np.corrcoef(squeezed.T))
    np.fill_diagonal(alike, 1)
    found = []
    for start in (np.diag(spread**2), alike * np.outer(spread, spread)):
        mean, cov, was = middle, start + floor, math.inf
        for _ in range(quality.STEPS):
            d = x - mean
            core = np.argsort(np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d), kind="stable")[: math.ceil(quality.CORE * len(x))]
            mean, cov = x[core].mean(axis=0), quality.CONSISTENT * np.cov(x[core].T, bias=True) + floor
            logdet = np.linalg.slogdet(cov)[1]
            if abs(logdet - was) < quality.SETTLED:
                break
            was = logdet
        found.append((logdet, mean, np.linalg.inv(cov)))
    return min(found, key=lambda f: f[0])[1:]


def test_verdicts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    measured = quality.measure(docs).select("doc_id", "lang", "source", "quality").collect()
    rows = [r for r in measured if not r.quality.base_failed]
    x = np.array([r.quality.x for r in rows])
    distance = np.empty(len(rows))
    for places in _groups(rows).values():
        mean, inverse = _estimate(x[places])
        d = x[places] - mean
        distance[places] = np.einsum("ni,ij,nj->n", d, inverse, d)
    expected = {r.doc_id: d for r, d in zip(rows, distance.tolist(), strict=True)}
    cutoff = quality.chi_square(quality.LEVEL)
    got = {r.doc_id: r.quality for r in quality.judge(docs, columns=["doc_id"]).collect()}
    assert len(got) == len(measured)
    for r in measured:
        q = got[r.doc_id]
        if r.quality.base_failed:
            assert not q.kept and q.base_failed
            continue
        assert q.distance == pytest.approx(expected[r.doc_id], rel=0.15, abs=0.5)
        if abs(expected[r.doc_id] - cutoff) > 0.1 * cutoff:
            assert q.kept == (expected[r.doc_id] <= cutoff)
    assert sum(not got[i].kept for i in expected) > 10


def test_chi_square_and_consistency():
    """Against published quantiles, and against draws from a normal distribution."""
    assert quality.chi_square(0.95, 1) == pytest.approx(3.8415, abs=1e-3) and quality.chi_square(0.999, 7) == pytest.approx(24.322, abs=1e-3)
    x = np.random.default_rng(1).standard_normal((200_000, quality.P))
    near = np.argsort((x**2).sum(axis=1))[: int(quality.CORE * len(x))]
    assert quality.CONSISTENT * x[near].var(axis=0).mean() == pytest.approx(1, abs=0.01)

