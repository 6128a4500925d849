"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_trie import prefix_trie
from .divergence import divergence_rules
from .exact_dedup import exact_groups
from .jaccard_join import near_duplicates
from .licenses import license_scan
from .mixing import mix_sources
from .packing import pack_documents
from .quality import perplexities
from .row_patterns import row_matches
from .substring_dedup import remove_repeats
from .url_filter import filter_urls
from .vector_dedup import near_vectors
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("expressions")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(_table(spark, sf_dir, "documents"))
    return mix.selectExpr("doc_id", "size", "source_size", "target", "size * copies AS taken")


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_matches(_table(spark, sf_dir, "clicks"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_license_scan, op3_url_filter, op4_exact_dedup, op5_warc, op6_quality_classifier, op7_packing, op8_mixing, op9_vector_dedup, op10_jaccard_join, op11_row_patterns, op12_quality_rules, op13_conversation_trie, pipeline)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS own FROM p) WHERE own < doc_id),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM r) GROUP BY doc_id),
x AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x LEFT JOIN (SELECT doc_id, unnest(gone) AS i, 1 AS hit FROM g) h USING (doc_id, i) WHERE hit IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r""",
    "op5_warc": """
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS m FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND m <> page_id THEN m END AS refers_to FROM g""",
    "op8_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
v AS (SELECT *, max(CASE WHEN lv * w <= cap THEN lv END) OVER () AS level FROM l),
t AS (SELECT source, source_size, n, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM v),
r AS (SELECT d.doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, n,
  md5(concat_ws(':', 'mix', doc_id)) AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
z AS (SELECT *, floor(('0x' || substr(draw, 1, 12))::BIGINT / 281474976710656.0::DOUBLE * ceil(n / 4096.0))::INT AS salt FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY source, salt ORDER BY size DESC, draw, doc_id) - 1 AS place, rate - floor(rate) AS part,
  ('0x' || substr(md5(concat_ws(':', 'mix', coalesce('=' || source, ''), salt)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS start FROM z)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + floor((place + 1) * part + start) - floor(place * part + start)))::BIGINT AS taken FROM q""",
    "op9_vector_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
c AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT c.id, l.b FROM c JOIN l ON c.r = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.r AS component_id, e.vec_id = m.r AS kept
FROM embeddings e JOIN (SELECT id, min(r) AS r FROM c GROUP BY id) m ON m.id = e.vec_id""",
    "op10_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 80 * (x.n + y.n - both_n)),
c AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT c.id, l.b FROM c JOIN l ON c.r = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.r AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(r) AS r FROM c GROUP BY id) m ON m.id = d.doc_id""",
    "op11_row_patterns": """
WITH RECURSIVE d AS (SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT client_id, click_id, ts, kind, CASE WHEN isfinite(value) THEN floor(100 * value + 0.5)::BIGINT END AS c, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS i FROM d),
p AS (SELECT *, lag(c) OVER w AS pc, coalesce(ts - lag(ts) OVER w <= INTERVAL 10 MINUTE, false) AS near FROM s WINDOW w AS (PARTITION BY client_id ORDER BY i)),
f AS MATERIALIZED (SELECT *, coalesce(near AND c <> pc AND kind <> 'error', false) AS mid, coalesce(near AND kind = 'purchase' AND c IS NOT NULL, false) AS goal FROM p),
r AS MATERIALIZED (SELECT *, sum((NOT mid)::INT) OVER (PARTITION BY client_id ORDER BY i) AS run FROM f),
b AS (SELECT *, lag(run) OVER (PARTITION BY client_id ORDER BY i) AS prior FROM r),
m AS MATERIALIZED (SELECT a.client_id, a.i, min(g.i) AS j FROM r a JOIN b g ON a.client_id = g.client_id AND g.goal AND g.prior = a.run AND g.i > a.i AND g.c >= a.c GROUP BY 1, 2),
t AS (SELECT client_id, min(i) AS i, 1::BIGINT AS no FROM m GROUP BY 1
  UNION ALL SELECT t.client_id, (SELECT min(q.i) FROM m q WHERE q.client_id = t.client_id AND q.i > n.j) AS i, no + 1 FROM t JOIN m n ON n.client_id = t.client_id AND n.i = t.i WHERE t.i IS NOT NULL)
SELECT t.client_id, t.no AS match_no, arg_min(r.click_id, r.i) AS first_id, arg_max(r.click_id, r.i) AS last_id, count(*) AS n_rows, sum(r.c)::BIGINT AS sum_cents,
  sha256(string_agg(CASE WHEN r.i = n.i THEN 'A' WHEN r.i = n.j THEN 'P' WHEN r.c < r.pc THEN 'D' ELSE 'U' END, '' ORDER BY r.i)) AS labels_sha256
FROM t JOIN m n ON n.client_id = t.client_id AND n.i = t.i JOIN r ON r.client_id = t.client_id AND r.i BETWEEN n.i AND n.j GROUP BY 1, 2""",
    "op12_quality_rules": rf"""
WITH r AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS x, {_WORDS} AS w FROM documents),
a AS (SELECT r.*, coalesce(rank, 0) AS cls FROM r LEFT JOIN (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) AS rank FROM r GROUP BY lang QUALIFY rank <= 256) USING (lang)),
g AS (SELECT id, i, count(*) OVER (PARTITION BY id, k) AS n FROM (SELECT id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM r))),
h AS (SELECT id, count(DISTINCT j) AS n FROM (SELECT id, unnest(range(i, i + 3)) AS j FROM g WHERE n > 1) GROUP BY id),
l AS (SELECT id, list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM r),
b AS MATERIALIZED (SELECT id, doc_id, cls, x, w, len(w)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words,
  list_transform(['[^a-z]', '[^A-Z]', '[^0-9]', '[^\x20\x09\x0B-\x0D]', '[^\x0A]', '[^.,;:!?''"()\-]', '[^#*$%&|<>]', '[^\x00-\x08\x0E-\x1F/=@\[\\\]^_`{{}}~+\x7F]', '[\x00-\x7F]'], lambda c: length(regexp_replace(x, c, '', 'g'))::DOUBLE) AS c
  FROM a JOIN l USING (id) LEFT JOIN h USING (id)),
f AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
t AS MATERIALIZED (SELECT id, cls, word, count(*) AS n FROM (SELECT id, cls, unnest(w) AS word FROM f) GROUP BY 1, 2, 3),
bins AS MATERIALIZED (SELECT cls, word FROM (SELECT cls, word, sum(n) AS n FROM t GROUP BY 1, 2) QUALIFY n * 1024 >= sum(n) OVER (PARTITION BY cls)),
u AS MATERIALIZED (SELECT min(id) AS id, cls FROM f WHERE NOT base_failed GROUP BY cls, x),
v AS MATERIALIZED (SELECT cls, count(*) AS texts, sum(n_words)::DOUBLE AS n, list_transform(range(1, 10), lambda k: list_sum(list_transform(list(c), lambda y: y[k]))) AS q FROM u JOIN f USING (id, cls) GROUP BY cls),
y AS MATERIALIZED (SELECT cls, word, coalesce(sum(n), 0)::DOUBLE AS n FROM bins LEFT JOIN (SELECT t.* FROM t JOIN u USING (id, cls)) USING (cls, word) GROUP BY 1, 2),
z AS (SELECT cls, texts, v.n, q, v.n - coalesce(ns, 0) AS rest, coalesce(ks, 0) + (v.n > coalesce(ns, 0))::INT - 1 AS bins FROM v LEFT JOIN (SELECT cls, sum(n) AS ns, count(*) FILTER (n > 0) AS ks FROM y GROUP BY 1) USING (cls)),
e AS (SELECT id, sum(m)::DOUBLE AS seen, sum(q) AS q, sum(p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) AS s
  FROM (SELECT f.id, t.n AS m, t.n / n_words::DOUBLE AS p, y.n / v.n AS q FROM f JOIN t USING (id, cls) JOIN y USING (cls, word) JOIN v USING (cls)) GROUP BY id),
o AS (SELECT f.*, texts, bins, list_sum(c) AS m, len(list_filter(z.q, lambda k: k > 0)) - 1 AS kinds, list_transform(range(1, 10), lambda k: [c[k] / greatest(list_sum(c), 1), z.q[k] / list_sum(z.q)]) AS pq,
  (n_words - coalesce(seen, 0)) / n_words AS po, rest / n AS qo, coalesce(s, 0) AS s, coalesce(e.q, 0) AS qs FROM f LEFT JOIN z USING (cls) LEFT JOIN e USING (id)),
j AS (SELECT *, list_sum(list_transform(pq, lambda k: CASE WHEN k[1] > 0 THEN k[1] * log2(2 * k[1] / (k[1] + k[2])) ELSE 0 END + CASE WHEN k[2] > 0 THEN k[2] * log2(2 * k[2] / (k[1] + k[2])) ELSE 0 END)) / 2 AS by_char,
  (s + (1 - qo - qs) + CASE WHEN po > 0 THEN po * log2(2 * po / (po + qo)) ELSE 0 END + CASE WHEN qo > 0 THEN qo * log2(2 * qo / (po + qo)) ELSE 0 END) / 2 AS by_word FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false WHEN coalesce(texts, 0) < 20 THEN true
    ELSE by_char <= 0.28 * 0.28 + 4.0 * kinds / (8 * ln(2)) / m AND by_word <= 0.36 * 0.36 + 0.4 * bins / (8 * ln(2)) / n_words END AS kept FROM j""",
    "op13_conversation_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))) AS crc FROM (SELECT DISTINCT conv_id FROM t)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM z),
n0 AS (SELECT conv_id, count(*) AS n FROM t GROUP BY 1),
b AS (SELECT c.conv_id, pos AS depth, r, x FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, least(h, coalesce(n0.n, 0)) + pos - h, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h LEFT JOIN n0 ON n0.conv_id = c.base),
k AS (SELECT conv_id, depth, sha256(string_agg(sha256(r) || sha256(x), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key, length(x) AS chars FROM b),
m AS MATERIALIZED (SELECT conv_id, depth, key, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), '') AS above, chars FROM k UNION ALL SELECT conv_id, 0, '', NULL, 0 FROM c),
n AS MATERIALIZED (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(above) AS above, min(chars) AS chars FROM m GROUP BY 1, 2),
o AS MATERIALIZED (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n q WHERE q.depth = n.depth + 1 AND q.above = n.key) AS n_children FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.key = n.above),
e AS (SELECT depth, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max(depth) AS depth, arg_max(key, depth) AS key FROM m GROUP BY 1) GROUP BY 1, 2),
s AS (SELECT DISTINCT a.depth AS ad, a.key AS ak, b.depth AS bd, b.key AS bk FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
u AS (SELECT ad AS depth, ak AS key, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM s JOIN o ON o.depth = bd AND o.key = bk GROUP BY 1, 2)
SELECT o.conv_id, o.depth::BIGINT AS depth, o.parent_conv_id, o.n_convs, o.n_children, u.n_leaves, u.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM o JOIN u USING (depth, key) LEFT JOIN e USING (depth, key)""",
}
