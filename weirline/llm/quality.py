"""Quality rules (operator 4): robust multivariate outliers by minimum covariance determinant.

Each document has a vector of transformed statistics.  Per language and source,
the minimum-covariance-determinant estimate is the mean and covariance of the
three quarters of the documents whose covariance has the least determinant.
Concentration steps find it from two deterministic starts, medians with
quartile ranges and the correlations of the vectors squeezed by tanh; each
start goes on until its determinant stands still, and the lesser one counts.
The covariance is scaled so that it is right for normal vectors, and documents
go whose squared Mahalanobis distance is over a chi-square quantile.

A concentration step is one aggregation: counts, sums and cross products by
group and by a fine logarithmic bin of the distance.  Bins from the smallest
distance up to the group's three-quarter mark, the last one by its share, are
summed to the next mean and covariance.  All documents of all groups take
part, and no group's rows ever meet in one task, however large its share.
Texts are measured once; what follows reads the narrow table of measures.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .line_dedup import _lines

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistics and the standard deviation that each is taken to have at least, in its transformed unit.
STATISTICS = {"word_length": 0.10, "symbols": 0.10, "capitals": 0.05, "digits": 0.10, "marks": 0.08, "dup_lines": 0.20, "repeats": 0.12}
P = len(STATISTICS)
CORE, STEPS, LEAST_GROUP, BINS = 0.75, 20, 100, 16
#: A start has settled when the logarithm of its determinant moves by less.
SETTLED = 0.001
#: Of the chi-square distribution of P degrees of freedom: documents beyond this share of it are rejected.
LEVEL = 0.999
#: Groups up to which their estimates are broadcast: a row of under 1 kB each.
BROADCAST_GROUPS = 10_000
_WORD = ~C.SPACE
_IS = lambda chars: np.isin(np.arange(256), list(chars))
_SYMBOL, _CAPITAL, _DIGIT = _IS(b"#*$%&|<>"), _IS(range(0x41, 0x5B)), _IS(range(0x30, 0x3A))
_SMALL = _IS(range(0x61, 0x7B))
_MARK = _IS(set(range(0x21, 0x7F)) - set(b"#*$%&|<>")) & ~_CAPITAL & ~_DIGIT & ~_SMALL


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which are not the first of their kind."""
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    _, first, which, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return counts[which] > 1, later


def _measure(data: np.ndarray, offs: np.ndarray, window: int = 5) -> np.ndarray:
    """A row a text: BASE, then capital letters, letters, digits, other marks, lines with a word."""
    words = C.Words(data, offs, _WORD)
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
    starts_char = (data & 0xC0) != 0x80
    of_text = np.repeat(np.arange(len(offs) - 1), words.counts)
    tag = C.mix(np.arange(1, len(offs), dtype=np.uint64))
    n_words = words.counts
    ok = np.flatnonzero(C.within(words.first, len(words.starts), window))
    twice, _ = _again(C.window_hashes(words.hashes(), window)[ok] ^ tag[of_text[ok]])
    covered = C.cover(ok[twice], window, len(words.starts))
    repeat = np.diff(np.concatenate([[0], np.cumsum(covered)])[words.first])
    starts, ends, first = _lines(data, offs)
    solid = np.concatenate([[0], np.cumsum(words.inside)])
    line_of = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    with_word = np.flatnonzero(solid[ends] > solid[starts])
    _, later = _again(C.byte_hashes(data, starts[with_word], ends[with_word]) ^ tag[line_of[with_word]])
    n = len(offs) - 1
    dup = np.bincount(line_of[with_word][later], minlength=n)
    lines = np.bincount(line_of[with_word], minlength=n)
    capitals = per_text(_CAPITAL[data])
    return np.stack([n_words, per_text(starts_char & words.inside), per_text(_SYMBOL[data]), dup, repeat, capitals, capitals + per_text(_SMALL[data] | ((data >= 0x80) & starts_char)), per_text(_DIGIT[data]), per_text(_MARK[data]), lines], axis=1)


def _vectors(m: np.ndarray) -> np.ndarray:
    """The transformed statistics: a logarithm, and square roots of shares, which level their variances."""
    m = m.astype(float)
    n_words, word_chars, n_symbols, dup, repeat, capitals, letters, digits, marks, lines = m.T
    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    return np.stack([np.log(chars / words), np.sqrt(n_symbols / words), np.sqrt(capitals / np.maximum(letters, 1)), np.sqrt(digits / chars), np.sqrt(marks / words), np.sqrt(dup / np.maximum(lines, 1)), np.sqrt(repeat / words)], axis=1)


MEASURES = f"struct<{','.join(f'{n}:bigint' for n in BASE)},base_failed:boolean,x:array<double>>"
_MEASURES = pa.struct([*[(n, pa.int64()) for n in BASE], ("base_failed", pa.bool_()), ("x", pa.list_(pa.float64()))])


def measure(docs: DataFrame, text: str = "text", name: str = "quality") -> DataFrame:
    """docs with a struct column of the statistics of whole texts; a null text has no words."""
    kept = [c for c in docs.columns if c.lower() != name]
    at = kept.index(text)
    before = docs.select(*[C.col(c) for c in kept], F.lit(None).cast(MEASURES).alias(name))

    def run(batches):
        for batch in batches:
            data, offs = C.texts(batch.column(at))
            rows = [_measure(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in C.chunks(offs)]
            m = np.concatenate([np.zeros((0, 10), np.int64), *rows])
            failed = (m[:, 0] < 10) | (100 * m[:, 4] > 20 * m[:, 0])
            x = pa.ListArray.from_arrays(np.arange(0, P * len(m) + 1, P, dtype=np.int32), pa.array(_vectors(m).reshape(-1)))
            made = pa.StructArray.from_arrays([*[pa.array(m[:, k]) for k in range(len(BASE))], pa.array(failed), x], fields=list(_MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=batch.schema.names)

    return before.mapInArrow(run, before.schema)


def _distance(x: str, mean: str, inverse: str) -> Column:
    """Squared Mahalanobis distance, folded over the cells of the inverse: written out, it would be too long to compile well."""
    diff = F.zip_with(x, mean, lambda a, b: a - b)
    cell = lambda d, k: d[F.floor(k / P).cast("int")] * d[F.pmod(k, F.lit(P))] * F.col(inverse)[k]
    fold = lambda d: F.aggregate(F.sequence(F.lit(0), F.lit(P * P - 1)), F.lit(0.0), lambda total, k: total + cell(d, k))
    return F.transform(F.array(diff), fold)[0]


def _gamma_share(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its power series."""
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= x / (a + n)
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi_square(share: float, freedom: int = P) -> float:
    """The quantile of the chi-square distribution, by bisection."""
    low, high = 1e-9, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _gamma_share(freedom / 2, middle / 2) < share else (low, middle)
    return low


#: The covariance of the nearest share of normal vectors, times this, is that of all.
CONSISTENT = CORE / _gamma_share(P / 2 + 1, chi_square(CORE) / 2)
ESTIMATE = "_group string, _start int, _mean array<double>, _inverse array<double>, _logdet double, _moved double"
_ESTIMATE = pa.schema([("_group", pa.string()), ("_start", pa.int32()), ("_mean", pa.list_(pa.float64())), ("_inverse", pa.list_(pa.float64())), ("_logdet", pa.float64()), ("_moved", pa.float64())])
_FLOOR = np.array(list(STATISTICS.values()))
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _covariance(sums: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    mean = sums[:P] / n
    cov = np.empty((P, P))
    for k, (i, j) in enumerate(_PAIRS):
        cov[i, j] = cov[j, i] = sums[P + k] / n - mean[i] * mean[j]
    return mean, cov


def _estimate(group: str, start: int, mean: np.ndarray, cov: np.ndarray, was: float = math.inf) -> dict:
    cov = cov + np.diag(_FLOOR**2)
    logdet = float(np.linalg.slogdet(cov)[1])
    return {"_group": group, "_start": start, "_mean": mean.tolist(), "_inverse": np.linalg.inv(cov).reshape(-1).tolist(), "_logdet": logdet, "_moved": abs(logdet - was)}


def _first(table: pa.Table) -> pa.Table:
    """A group's two starts, from its quartiles and the sums of its squeezed vectors."""
    group = table.column("_group")[0].as_py()
    middle, spread = (x[0] for x in _spread(np.array(table.column("_q")[0].as_py())))
    _, squeezed = _covariance(np.array(table.column("_sums").to_pylist()).sum(axis=0), table.column("_n").to_numpy().sum())
    size = np.sqrt(np.maximum(np.diag(squeezed), 1e-12))
    alike = squeezed / np.outer(size, size)
    np.fill_diagonal(alike, 1.0)
    starts = [_estimate(group, k, middle, c) for k, c in enumerate((np.diag(spread**2), alike * np.outer(spread, spread)))]
    return pa.Table.from_pylist(starts, schema=_ESTIMATE)


def _concentrate(table: pa.Table) -> pa.Table:
    """One group's sums by bin of distance: the mean and covariance of its nearest share."""
    bins, which = np.unique(table.column("_bin").to_numpy(), return_inverse=True)
    n, sums = np.zeros(len(bins)), np.zeros((len(bins), P + len(_PAIRS)))
    np.add.at(n, which, table.column("_n").to_numpy())
    np.add.at(sums, which, np.array(table.column("_sums").to_pylist()))
    before = np.cumsum(n) - n
    weight = np.clip((CORE * n.sum() - before) / n, 0, 1)
    mean, cov = _covariance(weight @ sums, weight @ n)
    first = table.slice(0, 1).to_pylist()[0]
    return pa.Table.from_pylist([_estimate(first["_group"], first["_start"], mean, CONSISTENT * cov, first["_logdet"])], schema=_ESTIMATE)


def _small(df: DataFrame) -> DataFrame:
    """A table of a row a group, to be broadcast if there are not too many of them."""
    return F.broadcast(df) if df.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else df


def _key(lang: str, source: str) -> Column:
    """The group's key: a hash of bounded length, with the language's before it, so that names of any length do."""
    named = lambda c: F.md5(F.coalesce(F.concat(F.lit("v"), C.col(c).cast("string")), F.lit("n")))
    return F.concat(named(lang), F.lit("/"), named(source))


class _Totals:
    """Counts, sums and cross products of vectors by group, start and bin: a task's share of an aggregation."""

    ROWS = 50_000  # held before they go out

    def __init__(self) -> None:
        self.held: dict[tuple, np.ndarray] = {}

    def add(self, groups: pa.Array, starts: np.ndarray, bins: np.ndarray, x: np.ndarray) -> None:
        groups = groups.dictionary_encode()
        code = (groups.indices.to_numpy().astype(np.int64) * 2 + starts) * 4096 + (bins + 2048)
        found, which = np.unique(code, return_inverse=True)
        cells = [np.ones(len(x)), *x.T, *[x[:, i] * x[:, j] for i, j in _PAIRS]]
        sums = np.stack([np.bincount(which, c, len(found)) for c in cells], axis=1)
        names = groups.dictionary.to_pylist()
        for k, row in zip(found.tolist(), sums, strict=True):
            key = names[k // 8192], k // 4096 % 2, k % 4096 - 2048
            self.held[key] = self.held[key] + row if key in self.held else row

    def batch(self) -> pa.RecordBatch:
        keys, rows = list(self.held), list(self.held.values())
        self.held = {}
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array([float(r[0]) for r in rows], pa.float64()), pa.array([r[1:] for r in rows], pa.list_(pa.float64()))], names=["_group", "_start", "_bin", "_n", "_sums"])


_TOTALS = "_group string, _start int, _bin int, _n double, _sums array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(place):
    """Totals of a task's rows; place(batch, vectors) gives each row's start and bin, and the vector to sum."""

    def run(batches):
        totals = _Totals()
        for batch in batches:
            if batch.num_rows:
                totals.add(batch.column("_group"), *place(batch, _matrix(batch.column("_x"))))
            if len(totals.held) > _Totals.ROWS:
                yield totals.batch()
        if totals.held:
            yield totals.batch()

    return run


def _spread(quartiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians, and standard deviations by quartile ranges."""
    q = quartiles.reshape(-1, P, 3)
    return q[:, :, 1], np.maximum((q[:, :, 2] - q[:, :, 0]) / 1.349, _FLOOR)


def _squeezed(batch: pa.RecordBatch, x: np.ndarray):
    middle, spread = _spread(_matrix(batch.column("_q")))
    none = np.zeros(len(x), np.int64)
    return none, none, np.tanh((x - middle) / spread)


def _by_distance(batch: pa.RecordBatch, x: np.ndarray):
    diff = x - _matrix(batch.column("_mean"))
    squared = np.einsum("ni,nij,nj->n", diff, _matrix(batch.column("_inverse")).reshape(-1, P, P), diff)
    return batch.column("_start").to_numpy(), np.floor(np.log2(np.maximum(squared, 0) + 1e-9) * BINS).astype(np.int64), x


def estimates(vectors: DataFrame) -> DataFrame:
    """vectors: _key, _x of the documents that pass the base rules.  _key, _mean, _inverse of every key.

    Pairs of language and source of fewer than LEAST_GROUP documents share one
    estimate a language, and languages whose small pairs still have too few
    share one estimate.
    """
    of_lang = F.substring_index("_key", "/", 1)
    own = F.col("_n") >= LEAST_GROUP
    pooled = F.sum(F.when(~own, F.col("_n"))).over(Window.partitionBy(of_lang))
    groups = vectors.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).select("_key", F.when(own, F.col("_key")).when(pooled >= LEAST_GROUP, of_lang).otherwise(F.lit("*")).alias("_group"))
    groups = C.checkpointed(groups)
    grouped = vectors.join(_small(groups), "_key").select("_group", "_x")
    x = F.col("_x")
    quartiles = F.flatten(F.array(*[F.percentile_approx(x[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)) for i in range(P)]))
    middles = C.checkpointed(grouped.groupBy("_group").agg(quartiles.alias("_q")))
    squeezed = grouped.join(_small(middles), "_group").mapInArrow(_summed(_squeezed), _TOTALS)
    found = C.checkpointed(squeezed.join(_small(middles), "_group").groupBy("_group").applyInArrow(_first, ESTIMATE))
    for _ in range(STEPS):
        near = vectors.join(_small(groups.join(found, "_group")), "_key").select("_group", "_start", "_x", "_mean", "_inverse")
        sums = near.mapInArrow(_summed(_by_distance), _TOTALS).join(_small(found.select("_group", "_start", "_logdet")), ["_group", "_start"])
        found = C.checkpointed(sums.groupBy("_group", "_start").applyInArrow(_concentrate, ESTIMATE))
        moved = found.agg(F.max("_moved")).first()[0]
        if moved is None or moved < SETTLED:
            break
    best = found.groupBy("_group").agg(F.min_by(F.struct("_mean", "_inverse"), F.struct("_logdet", "_start")).alias("_best"))
    return C.checkpointed(groups.join(best, "_group").select("_key", "_best.*"))


def _judged(docs: DataFrame, want: Sequence[str], text: str, lang: str, source: str, level: float) -> tuple[DataFrame, list[Column]]:
    """_0, _1, ... (the wanted columns) and _verdict of every row, and the wanted columns by their names;
    inside, columns go by numbers, so that no name of docs can clash."""
    columns = list(dict.fromkeys([*want, text, lang, source]))
    number = {c: f"_{k}" for k, c in enumerate(columns)}
    rows = docs.select(*[C.col(c).alias(n) for c, n in number.items()])
    measured = measure(rows, number[text], "_m").select(*[number[c] for c in want], F.col("_m").alias("_q"), _key(number[lang], number[source]).alias("_key"))
    measured = C.stored(measured, "measures")
    found = estimates(measured.where(~F.col("_q.base_failed")).select("_key", F.col("_q.x").alias("_x")))
    q = F.col("_q")
    distance = F.when(F.col("_mean").isNotNull(), _distance("_q.x", "_mean", "_inverse"))
    verdict = ~q.base_failed & F.coalesce(distance <= chi_square(level), F.lit(True))
    told = F.struct(*[q[b].alias(b) for b in BASE], q.base_failed.alias("base_failed"), distance.alias("distance"), verdict.alias("kept"))
    judged = measured.join(_small(found), "_key", "left").select(*[number[c] for c in want], told.alias("_verdict"))
    return judged, [F.col(number[c]).alias(c) for c in want]


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", name: str = "quality", level: float = LEVEL, columns: Sequence[str] | None = None) -> DataFrame:
    """The asked columns of docs (all by default) with a struct column: the base statistics, base_failed,
    distance (squared; null if there is no estimate) and kept.

    Documents that fail a base rule take no part in the estimates.  Null
    languages and sources are values of their own; a null or empty text has no
    words and fails.  Equal rows are judged alike.  A column of that name is
    replaced; others may have any names.  An empty table gives an empty
    result.  A text is measured in one task, at about fifty times its size.
    """
    want = list(columns) if columns is not None else [c for c in docs.columns if c.lower() != name]
    judged, back = _judged(docs, want, text, lang, source, level)
    return judged.select(*back, F.col("_verdict").alias(name))


def keep(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", level: float = LEVEL, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of docs (or the asked columns of them) that every rule keeps, unchanged, as judge() finds
    them; columns may have any names."""
    judged, back = _judged(docs, list(columns) if columns is not None else docs.columns, text, lang, source, level)
    return judged.where("_verdict.kept").select(*back)
