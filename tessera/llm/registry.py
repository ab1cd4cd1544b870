"""Queries of the training-data operators over whole tables, with production parameters, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fingerprints, licenses, mixing, packing, passages, pii, quality, sharding, similarity, spelling, toxicity, url_filter, whitening
from tessera.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.component_table(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filter, op2_toxicity, op3_best_fit_packing, op4_mix_sources, op5_fingerprints, op6_suffix_dedup, op7_license_scan, op8_quality_rules, op9_ngram_jaccard, op10_personal_data, op11_whitened_embeddings, op12_stratified_shards, op13_spelling_variants)
}

WS = "[\\x20\\x09-\\x0D]"
LINES = f"trim(regexp_replace(regexp_replace(lower(l), '[0-9]', '0', 'g'), '{WS}+', ' ', 'g'))"
QUALITY_SQL = f"""
WITH w AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words FROM w),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY 1),
l AS (SELECT doc_id, source, l, {LINES} AS p FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
d AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l GROUP BY 1),
f AS (SELECT source, p, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM l GROUP BY 1, 2),
h AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1),
x AS (SELECT l.doc_id, sum(len(string_split(p, ' '))) AS n FROM l JOIN f USING (source, p) JOIN h USING (source) WHERE f.n > 20 AND f.n > 0.005 * docs AND l.doc_id <> first GROUP BY 1),
b AS (SELECT n.doc_id, n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(x.n, 0) AS BIGINT) AS removed_words
 FROM n LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN x USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < 0.2 * n_words)) AS kept FROM b"""
JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WS}+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5) UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
t AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, t.b FROM r JOIN t ON r.b = t.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r.b) AS component_id FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY 1, 2"""

#: Every window of 50 bytes, the smallest document of each, and what is left between the removed runs.
PASSAGES_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, array_slice(b, i, i + 49) AS s FROM (SELECT doc_id, b, unnest(generate_series(1, n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE low < doc_id),
k AS (SELECT doc_id, i, count(*) FILTER (before IS NULL OR i > before + 50) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g)),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + 49 AS z FROM k GROUP BY doc_id, k),
p AS (SELECT doc_id, k, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) + 1 AS f, a - 1 AS t FROM r UNION ALL SELECT doc_id, max(k) + 1, max(z) + 1, any_value(n) FROM r JOIN d USING (doc_id) GROUP BY doc_id),
h AS (SELECT doc_id, sha256(unhex(string_agg(CASE WHEN t >= f THEN hex(array_slice(b, f, t)) ELSE '' END, '' ORDER BY k))) AS sha FROM p JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, coalesce(sha, sha256(b)) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN h USING (doc_id)"""



def _phrase(phrase: str, label: str) -> str:
    words = phrase.split()
    return f"struct_pack(label := '{label}', spots := list_filter(range(len(w)), lambda i: w[i + 1:i + {len(words)}] = [{', '.join(repr(x) for x in words)}]))"


#: Places of every phrase among the words, for the tests: SQL does not parse the expressions behind tags (the given tables have no tags).
LICENSE_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, [{", ".join(_phrase(*x) for x in licenses.BASE)}] AS b, [{", ".join(_phrase(*x) for x in licenses.NOTICES)}] AS m FROM w),
q AS (SELECT doc_id, n, flatten(list_transform(b, lambda x: x.spots)) AS spots, list_transform(list_filter(b, lambda x: len(x.spots) > 0), lambda x: x.label) AS bl, len(flatten(list_transform(m, lambda x: x.spots))) AS more, list_transform(list_filter(m, lambda x: len(x.spots) > 0), lambda x: x.label) AS ml FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base, CAST(list_min(spots) AS BIGINT) AS first_word, CAST(list_max(spots) AS BIGINT) AS last_word, array_to_string(list_sort(list_distinct(bl)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(bl, ml))), ',') AS labels,
 round(1 - pow(1 - {licenses.SURE["base"]}, len(spots)) * pow(1 - {licenses.SURE["notice"]}, more), 9) AS score, '' AS expressions FROM q"""

#: CRC-32 of a blob's bytes, by the table of the remainders of all bytes.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crcs"


def _crc(blob: str) -> str:
    of_bytes = f"list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce({of_bytes}, lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


SHARDS_SQL = f"""
WITH t AS ({CRC_TABLE}),
x AS (SELECT DISTINCT text, coalesce(CAST({_crc("encode(text)")} AS BIGINT), 0) AS text_crc32 FROM documents, t),
d AS (SELECT doc_id, source, CAST(coalesce(octet_length(encode(x.text)), 0) + {sharding.ROW_BYTES} AS BIGINT) AS size, text_crc32, md5('{sharding.SEED}:' || doc_id) AS k FROM documents JOIN x ON documents.text IS NOT DISTINCT FROM x.text),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id, size, text_crc32) AS r, count(*) OVER (PARTITION BY source) AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n), source NULLS FIRST, k, doc_id, size, text_crc32) - 1 AS p, count(*) OVER () AS c FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * {sharding.SHARDS} // c AS INT) AS shard, p - (p * {sharding.SHARDS} // c * c + {sharding.SHARDS - 1}) // {sharding.SHARDS} AS slot, CAST(NULL AS INT) AS grown_shard, source FROM p"""
#: Near words by the word without each of its characters; forms lead on by recursion.
SPELLING_SQL = f"""
WITH RECURSIVE t AS ({CRC_TABLE}),
o AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents) WHERE length(w) >= {spelling.LEAST_LENGTH} GROUP BY 1, 2),
h AS (SELECT w, c, {_crc("encode(doc_id || ':' || w)")} AS h FROM o, t),
v AS (SELECT CASE WHEN h % {spelling.ONE_IN} = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, CAST(sum(c) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= {spelling.LEAST_LENGTH} AND sum(c) >= {spelling.LEAST_COUNT}),
g AS (SELECT word, n, i, word[:i] || word[i + 2:] AS s FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
e AS (SELECT a.word AS a, b.word AS b, b.n FROM g a JOIN g b ON a.i = b.i AND a.s = b.s AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM g a JOIN v b ON a.s = b.word UNION SELECT b.word, a.word, a.n FROM g a JOIN v b ON a.s = b.word),
m AS (SELECT a, count(DISTINCT b) AS n_near, max(n) AS top, arg_min(b, (-n, b)) AS b FROM e GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {spelling.TIMES} * n THEN b END AS form, CASE WHEN top >= {spelling.TIMES} * n THEN top END AS form_n FROM v LEFT JOIN m ON word = a),
r AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT r.word, f.form, step + 1 FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) z USING (word)"""

ORACLE_SQL: dict[str, str] = {"op12_stratified_shards": SHARDS_SQL, "op13_spelling_variants": SPELLING_SQL, "op6_suffix_dedup": PASSAGES_SQL, "op8_quality_rules": QUALITY_SQL, "op9_ngram_jaccard": JACCARD_SQL}
