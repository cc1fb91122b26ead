"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, jaccard, lattice_lm, line_dedup, mixing, quality, relative_lz, sharding, suffix_dedup, token_files


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_words, n_hit, n_items and the items' digest of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark(docs, _table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return marked.select("doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), c.n_items.alias("n_items"), F.sha2(F.array_join(F.array_sort(c["items"]), ","), 256).alias("items_sha256"), (c.n_hit > 0).alias("contaminated"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight equal shards by the key law: doc_id and the number of shards decide."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, [1.0] * 8).withColumn("law", F.lit("key"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that an earlier document holds are removed."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return relative_lz.dedup_substrings(docs, with_text=False).drop("text", "spans", "factors")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of robust distances per language and source."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    q = F.col("quality")
    return quality.judge(docs, columns=["doc_id"]).select("doc_id", *[q[b].alias(b) for b in quality.BASE], q.base_failed.alias("base_failed"), q.kept.alias("kept"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighted 5, 2, 1 share 150% of all words."""
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's probability over its subword lattice, and by a word unigram."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice_lm.score(docs, tokenizer_path("piece_bpe_32k.model"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as token ids, read back from the files."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.round_trip(docs, tokenizer_path())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points and more that 5 documents share stay in the last of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, with_text=False).drop("text")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups: 5-word sets with a Jaccard similarity of 0.8 or more."""
    return jaccard.join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur twice are removed."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_bytes(docs, with_bytes=False).drop("kept", "spans")


QUERIES = {"op1_decontamination": op1_decontamination, "op2_sharding": op2_sharding, "op3_substring_dedup": op3_substring_dedup, "op4_quality_rules": op4_quality_rules, "op5_mixing": op5_mixing, "op6_lattice_lm": op6_lattice_lm, "op7_token_files": op7_token_files, "op8_line_dedup": op8_line_dedup, "op9_ngram_jaccard": op9_ngram_jaccard, "op10_suffix_dedup": op10_suffix_dedup}

#: DuckDB: A-Z lower-cased and nothing else.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH w AS (SELECT doc_id, {ALNUM_WORDS} AS words FROM documents),
b AS (SELECT item_id, words, least(10, len(words)) AS size FROM (SELECT item_id, {ALNUM_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
bw AS (SELECT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(words) - size + 1)) AS i FROM b)),
dw AS (SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS win
       FROM (SELECT w.*, s.size, unnest(generate_series(1, len(words) - s.size + 1)) AS i FROM w CROSS JOIN (SELECT DISTINCT size FROM bw) s)),
hits AS (SELECT DISTINCT doc_id, i, size, item_id FROM dw JOIN bw USING (size, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP3_SQL = f"""
WITH w AS (SELECT doc_id, {SPACE_WORDS} AS words FROM documents),
n AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(words) - 12)) AS i FROM w)),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY win) AS first FROM n),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM m WHERE first < doc_id),
p AS (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS p FROM w),
j AS (SELECT p.*, gone.p IS NOT NULL AS removed FROM p LEFT JOIN gone USING (doc_id, p)),
k AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT removed) AS kept FROM j GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, len({SPACE_WORDS}) AS size, ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM d GROUP BY source),
r AS (SELECT *, source_size::DOUBLE * 2 AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget,
  sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS w_left, coalesce(sum(source_size::DOUBLE * 2) OVER b, 0) AS before FROM s
  WINDOW b AS (ORDER BY source_size::DOUBLE * 2 / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * w_left <= w * (budget - before) AS capped FROM r),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * (budget - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN w END) OVER () END AS target FROM c),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
a AS (SELECT g.*, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
m AS (SELECT a.source, a.h, times < 2 AND target > 0 AND (upto <= target - times * source_size OR
  (upto - n <= target - times * source_size AND upto - (target - times * source_size) < (target - times * source_size) - (upto - n))) AS more
  FROM a JOIN e ON a.source IS NOT DISTINCT FROM e.source)
SELECT d.doc_id, d.size, e.source_size, e.target, d.size * (e.times + CASE WHEN m.more THEN 1 ELSE 0 END) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.h = m.h
"""

OP8_SQL = """
WITH l AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT l.*, coalesce(l.doc_id < k.last, false) AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""

OP9_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, text, {SPACE_WORDS} AS words FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE []::VARCHAR[] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
p AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 1000 >= 800 * (x.n + y.n - c)
  UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text IS NOT DISTINCT FROM y.text AND x.doc_id < y.doc_id),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
k AS (SELECT node, min(root) AS class_id FROM r GROUP BY node),
d AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a),
t AS (SELECT text, min(doc_id) AS copy_id FROM documents GROUP BY text)
SELECT w.doc_id, t.copy_id, k.class_id, coalesce(d.n_links, 0) AS n_links FROM w JOIN t ON w.text IS NOT DISTINCT FROM t.text JOIN k ON k.node = w.doc_id LEFT JOIN d ON d.doc_id = w.doc_id
"""

#: DuckDB has no crc32: the table of its polynomial by rule, then a fold over the bytes.
OP2_SQL = """
WITH tbl AS (SELECT list(v ORDER BY n) AS tbl FROM (SELECT n, list_reduce(list_prepend(n, list_transform(range(8), lambda x: 0::BIGINT)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n))),
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
d AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM b, tbl),
u AS (SELECT DISTINCT doc_id, s, -ln((('0x' || substr(md5(':' || s || ':' || coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS score FROM documents, range(9) r(s)),
k AS (SELECT doc_id, arg_min(s, score) FILTER (s < 8) AS shard, arg_min(s, score) AS grown_shard FROM u GROUP BY doc_id)
SELECT d.doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM d JOIN k ON d.doc_id IS NOT DISTINCT FROM k.doc_id
"""

OP10_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT *, unnest(range(n - 199)) AS i FROM h WHERE n >= 200)),
r AS (SELECT m FROM s GROUP BY m HAVING count(*) > 1),
f AS (SELECT doc_id, i FROM s JOIN r USING (m)),
p AS (SELECT doc_id, unnest(range(n)) AS i, unnest(regexp_extract_all(h, '..')) AS byte FROM h),
c AS (SELECT p.*, coalesce(max(CASE WHEN f.i IS NOT NULL THEN 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 0) AS gone FROM p LEFT JOIN f USING (doc_id, i)),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS starts FROM c),
k AS (SELECT doc_id, count(*) FILTER (gone = 1) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)
"""

SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_sharding": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_mixing": OP5_SQL, "op8_line_dedup": OP8_SQL, "op9_ngram_jaccard": OP9_SQL, "op10_suffix_dedup": OP10_SQL}
