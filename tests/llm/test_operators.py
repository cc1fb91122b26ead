"""Every corpus operator against brute force, on rows with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weirline.llm import common, decontamination, jaccard, lattice_lm, line_dedup, mixing, quality, queries, relative_lz, sharding, suffix_dedup, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda b: hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()
words = lambda t: WORD.findall(t or "")
key = lambda i: -math.inf if i is None else i


def same(df, expected, *columns):
    got = Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
    assert got == Counter(expected), list((got - Counter(expected)).items())[:3] + list((Counter(expected) - got).items())[:3]


# 1


def contaminated(rows, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[i : i + size])].add(item or "")
    out = []
    for i, text, *_ in rows:
        w, hit, found = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if of := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= of
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return out


@pytest.mark.parametrize("block", [64 << 20, 60])
def test_decontamination(spark, docs, rows, block):
    long = rows[7][1]
    items = [("1", long), ("10", long[20:]), ("2", "one two THREE"), ("3", None), ("4", "..."), (None, "some other words in it"), ("2", "one two THREE")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    marked = decontamination.mark(docs, bench, max_block_bytes=block)
    assert marked.columns.count("contamination") == 1 and "odd name" in marked.columns
    got = [(r.doc_id, r.contamination.n_words, r.contamination.n_hit, tuple(r.contamination["items"])) for r in marked.collect()]
    assert Counter(got) == Counter(contaminated(rows, items))
    cut = decontamination.remove(docs, bench, what="spans", n_chars="n_chars", max_block_bytes=block)
    assert cut.columns == docs.columns
    for r in cut.where("doc_id = 7").collect():
        assert not ALNUM.findall(r.text) and r.n_chars == len(r.text)
    assert decontamination.remove(docs, bench).count() == sum(1 for x in contaminated(rows, items) if not x[2])


def test_decontamination_of_nothing(spark, docs, empty, rows):
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontamination.remove(docs, none).count() == len(rows)
    assert decontamination.mark(empty, none).count() == 0


# 2


def test_sharding(docs, rows, empty):
    weights = [1.0, 2.0, 1.0]
    out = sharding.shard(docs, weights).collect()
    assert len(out) == len(rows)
    for s in range(3):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == expected
    assert all(r.grown_shard in (r.shard, 3) for r in out)
    by_key = defaultdict(set)
    for r in out:
        by_key[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(v) == 1 for v in by_key.values())
    assert {(r.doc_id, r.size, r.shard, r.slot) for r in out} == {(r.doc_id, r.size, r.shard, r.slot) for r in sharding.shard(docs.repartition(3), weights).collect()}
    assert sharding.shard(empty, weights).count() == 0


def test_sharding_is_fair(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "cast(null as string) as text")
    n = Counter(r.shard for r in df.select(sharding.shard_of(df.doc_id, [1.0, 2.0, 1.0]).alias("shard")).collect())
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] - n[2]) < 500


# 3


def test_relative_lz(docs, rows, empty):
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, math.inf), key(i))
    expected = []
    for i, t, *_ in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(i):
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((i, kept, len(w), len(gone), sha(kept)))
    same(relative_lz.dedup_substrings(docs), expected, "doc_id", "text", "n_words", "n_removed", "kept_sha256")
    assert relative_lz.dedup_substrings(empty).count() == 0


# 4


def base(text):
    w = words(text)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality(docs, rows, empty):
    out = quality.judge(docs)
    assert out.columns.count("quality") == 1
    got = Counter((r.doc_id, *[r.quality[b] for b in quality.BASE], r.quality.base_failed) for r in out.collect())
    assert got == Counter((i, *base(t)) for i, t, *_ in rows)
    assert all(not (r.quality.kept and r.quality.base_failed) for r in out.collect())
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == out.where("quality.kept").count()
    assert quality.keep(empty).count() == 0


def test_quality_finds_what_lies_far_off(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(900):
        w = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(60)]
        if k % 10 == 0:
            w = [x + "###" for x in w]
        rows.append((k, " ".join(w).capitalize() + ".", "en", "hot" if k % 3 else f"s{k % 50}"))
    out = quality.judge(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string"), columns=["doc_id"]).collect()
    assert {r.doc_id for r in out if not r.quality.kept} == set(range(0, 900, 10))


# 5


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (left - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2.0 * sizes[s] for s in over}
    target = {s: capped.get(s, level * weight[s]) for s in order}
    sources = {(r.doc_id, r.size): None for r in out}
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len(words(t))) for i, t, *_ in rows) and sources
    by_size = {v: k for k, v in sizes.items()}
    assert len(by_size) == len(sizes)
    taken = Counter()
    for r in out:
        assert r.target == pytest.approx(target[by_size[r.source_size]])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[by_size[r.source_size]] += r.taken
    largest = max(r.size for r in out)
    assert all(abs(taken[s] - target[s]) <= largest for s in order)
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in out) == sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(docs.repartition(2)).collect())
    repeated = mixing.mixed(docs)
    assert repeated.columns == docs.columns
    assert Counter(r.doc_id for r in repeated.where("size(split(trim(text), ' ')) > 20").collect()) <= Counter({i: 2 * n for i, n in Counter(r[0] for r in rows).items()})
    assert sum(len(words(r.text)) for r in repeated.collect()) == sum(taken.values())
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


# 6


def test_lattice(docs, rows, empty):
    out = lattice_lm.score(docs, queries.tokenizer_path("piece_bpe_32k.model")).collect()
    tokens = {k: [*words((t or "").translate(LOWER)), None] for k, (_, t, *_) in enumerate(rows)}
    training = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for i, *_ in rows]
    c = Counter(x for k, w in tokens.items() if training[k] for x in w)
    total = sum(c.values())
    expected = Counter((i, not training[k], len(tokens[k]), sum(c[x] > 0 for x in tokens[k]), total, round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (len(c) + 1))) for x in tokens[k]), 4)) for k, (i, *_) in enumerate(rows))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    none = lattice_lm.score(empty, queries.tokenizer_path("piece_bpe_32k.model"))
    assert none.count() == 0


def test_lattice_sums_all_paths():
    pieces = [b" a", b"b", b" ab", b" ", b"a", b"c"]
    lattice = lattice_lm.Lattice(pieces, np.log(np.array([0.2, 0.1, 0.05, 0.3, 0.15, 0.2])))
    data = np.frombuffer(b"abacb", np.uint8)
    got = np.exp(lattice.scores(data, np.array([0, 2]), np.array([2, 3])))
    ab = 0.2 * 0.1 + 0.05 + 0.3 * 0.15 * 0.1
    acb = (0.2 + 0.3 * 0.15) * 0.2 * 0.1
    assert got == pytest.approx([ab, acb]) and math.exp(lattice.long_word(b" ab")) == pytest.approx(ab)
    expected = lattice.expected(data, np.array([0]), np.array([2]), np.array([3.0]))
    assert expected == pytest.approx(3 * np.array([0.02, 0.02 + 0.0045, 0.05, 0.0045, 0.0045, 0]) / ab)


def test_training_raises_the_likelihood(spark, docs):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    before, after = (sum(r.score for r in lattice_lm.score(docs, path, em_steps=n).collect() if not r.held_out) for n in (0, 2))
    assert after > before


# 7


@pytest.mark.parametrize("bit_planes", [False, True])
def test_token_files(spark, docs, rows, empty, bit_planes):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    to = common.new_path(spark, "test")
    token_files.write(docs, to, path, bit_planes=bit_planes, block_ids=500, chunk_ids=2000)
    out = token_files.read(spark, to).collect()
    expected = Counter((i, *t.encode(x or "", add_special_tokens=False).ids, 0) for i, x, *_ in rows)
    assert Counter((r.doc_id, *r.ids) for r in out) == expected
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert [key(r.doc_id) for r in sorted(out, key=lambda r: r.start)] == sorted(key(i) for i, *_ in rows)
    assert token_files.round_trip(empty, path).count() == 0


def test_units_encode_as_the_whole():
    path = queries.tokenizer_path()
    encoder = token_files.Encoder(path)
    odd = ["", " ", "a  b", "x\n\ny \n z\n  q \nx", "tail  \n", "it's  'll \t\tx y 　z", "<|endoftext|> a<|endoftext|>b \x1c x\x1c\ny\x85 z \x85q", "日本 語\n語 é\né e\n\x0b\x0c\rx\r\ny", " \n a\n b"]
    raw = [x.encode() for x in odd]
    ids, at = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    for k, x in enumerate(odd):
        assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(x, add_special_tokens=False).ids, x


# 8


def test_line_dedup(docs, rows, empty):
    line_key = lambda l: l.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= 40:
                holders[line_key(line)].add(key(i))
    expected = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(line_key(x), ())) < 5 or key(i) == max(holders[line_key(x)])]
        expected.append((i, "\n".join(kept), len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    assert any(x[3] for x in expected)
    same(line_dedup.dedup_lines(docs), expected, "doc_id", "text", "n_lines", "n_dropped", "kept_sha256")
    assert line_dedup.dedup_lines(empty).count() == 0


# 9


def links_of(rows, threshold=0.8):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            equal = rows[a][1] == rows[b][1]
            if equal or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    smallest = {k: min((rows[m][0] for m in g), key=key) for g in groups.values() for k in g}
    return [(rows[k][0], smallest[k], links[k]) for k in range(len(rows))], len(groups)


@pytest.mark.parametrize("tile", [1024, 2])
def test_jaccard(docs, rows, empty, tile):
    expected, n_groups = links_of(rows)
    assert max(x[2] for x in expected) >= 5
    same(jaccard.join(docs, tile=tile), expected, "doc_id", "class_id", "n_links")
    kept = jaccard.keep(docs, tile=tile)
    assert kept.columns == docs.columns and kept.count() == n_groups
    assert jaccard.join(empty).count() == 0 and jaccard.keep(empty).count() == 0


def test_components(spark):
    chain = [(k + 1, k) for k in range(60)] + [(100 + k, 99) for k in range(1, 30)] + [(203, 201), (203, 202)]
    got = {r._node: r._group for r in jaccard.components(spark.createDataFrame(chain, "_a long, _b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 99 for k in range(99, 130) if k != 100}, 201: 201, 202: 201, 203: 201}


# 10


def test_suffix_dedup(docs, rows, empty):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    expected = []
    for i, b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        expected.append((i, kept, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), sha(kept)))
    assert any(x[3] for x in expected)
    out = suffix_dedup.dedup_bytes(docs)
    assert Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()) == Counter(expected)
    assert suffix_dedup.dedup_bytes(empty).count() == 0
