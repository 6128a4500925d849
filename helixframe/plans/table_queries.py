"""Queries of the table operators that need no sequences: counts, sets, ranks, gates, batches, ids; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import accession as acc
from ..functions import alphabet
from ..operators import batching, cascade, hits, lookup, search
from ..sources.stage import shared_folder
from .queries import _HITS, _SKETCH, _kmers, best_hit_per_query, sketch_search_topk


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def distinct_counts(s, d):
    names = ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    return _t(s, d, "lineitem").agg(*(F.count_distinct(c).alias(c) for c in names))


def timing_stats(s, d):
    return _t(s, d, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("hi"), F.count("*").alias("n"))


def status_histogram(s, d):
    quality = F.when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "failed").otherwise("skip")
    return _t(s, d, "documents").join(_t(s, d, "labels"), "doc_id", "left").groupBy(quality.alias("status")).agg(F.count("*").alias("n"))


def status_prefixes(s, d):
    """Counts by what stands before a status's colon."""
    status = F.concat_ws(":", "event_type", "user_id")
    return _t(s, d, "events").groupBy(F.get(F.split(status, ":"), F.lit(0)).alias("status")).agg(F.count("*").alias("n"))


def sorted_filter(s, d):
    """Documents without an X that reach a bound, the longest first."""
    rows = hits.at_least(_t(s, d, "documents"), "n_chars", 300).where("NOT contains(text, 'X')")
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars")).orderBy(F.desc("n_chars"), "doc_id")


def bound_if_present(s, d):
    """A bound on a column that the table has, and one on a column that it lacks."""
    return hits.at_least(hits.at_least(_t(s, d, "lineitem"), "l_quantity", 30), "approx_pident", 30).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def top_orders(s, d):
    """The ten dearest orders."""
    return _t(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def head_per_group(s, d):
    return hits.best(_t(s, d, "orders"), "o_custkey", F.desc("o_totalprice"), F.asc("o_orderkey"), n=3).select("o_custkey", "o_orderkey")


def select_top_hits(s, d):
    """Of each page's query the top targets by a field that may be no number."""
    rows = _t(s, d, "events").select(F.col("user_id").alias("query"), F.col("event_id").alias("row_idx"), F.get_json_object("props", "$.k").alias("bitscore"))
    return hits.select_top(rows, 4, "bitscore").select("query", "row_idx")


def set_union(s, d):
    a, b = _t(s, d, "orders").select(F.col("o_custkey").alias("id")), _t(s, d, "customer").select(F.col("c_custkey").alias("id"))
    return a.where("id % 3 = 0").union(b.where("id % 2 = 0")).distinct()


def set_difference(s, d):
    """Customers without a finished order."""
    return _t(s, d, "customer").select(F.col("c_custkey").alias("id")).subtract(_t(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")))


def cascade_coverage(s, d):
    """Documents that none of three result tables covers with an output."""
    lab = _t(s, d, "labels")
    a = lab.where("quality = 1").selectExpr("doc_id", "'a' AS path")
    b = lab.where("quality = 0").selectExpr("doc_id", "IF(toxic = 1, 'b', '') AS path")
    c = _t(s, d, "documents").where("source = 'src0'").selectExpr("doc_id", "IF(lang = 'en', 'c', NULL) AS path")
    return hits.uncovered(_t(s, d, "documents").select("doc_id"), "doc_id", a, b, c)


def selected_queries(s, d):
    out = hits.selected_queries(best_hit_per_query(s, d))
    return out.select("row_idx", "n", F.array_join("queries", ",").alias("queries"))


def containment_gate(s, d):
    return sketch_search_topk(s, d).where("containment >= 0.08").select("query", "row_idx", "shared")


def template_gates(s, d):
    """Hits whose containment, identity and coverage all reach their bounds; orders stand in for hits."""
    rows = _t(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_discount AS containment", "l_quantity / 50 AS identity", "1 - l_tax * 5 AS coverage")
    return hits.local_gates(rows).select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


def first_success(s, d):
    """Of each order the first line, in order of its number, that meets a bound, or its last."""
    rows = _t(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    out = hits.first_success(rows, "l_orderkey", "l_linenumber", F.col("q") >= 40)
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "status")


def stop_rule(s, d):
    stop = batching.stops(F.col("l_quantity"), F.col("l_linenumber") - 1, 40, 5, 10)
    return _t(s, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(stop).alias("stopped"), F.count("*").alias("n"))


def length_gate(s, d):
    size = F.octet_length("text")
    return _t(s, d, "documents").select("doc_id", batching.length_gate(F.length("text"), 1000).alias("status"), batching.step_by_size(size, 2500).cast("long").alias("step"))


def _items(s, d):
    return _t(s, d, "documents").select(F.coalesce("source", F.lit("")).alias("lane"), F.col("doc_id").alias("id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("length"))


def token_batches(s, d):
    return batching.token_batches(_items(s, d), 4_000_000)


def lane_batches(s, d):
    """Batches of lanes of 60 items at most."""
    return batching.token_batches(batching.bounded_lanes(_items(s, d), 60), 4_000_000)


def batch_costs(s, d):
    return batching.batch_costs(batching.token_batches(_items(s, d), 4_000_000))


def adaptive_rounds(s, d):
    """Items predicted again until they are sure, out of turns, or hopeless; a hash stands in for the predictor."""
    items = _t(s, d, "customer").select(F.col("c_custkey").alias("id"))
    out = batching.adaptive_rounds(items, lambda df, turn: df.withColumn("score", (F.col("id") * 37 + turn * 53) % 101), 80, 4, 15)
    return out.select("id", "score", F.col("turn").cast("long").alias("turn"))


def tiered_lookup(s, d):
    """The first of three stores that has a document."""
    docs = _t(s, d, "documents")
    return lookup.first_tier(docs, "doc_id", docs.where("source = 'src0'"), _t(s, d, "labels").where("quality = 1"), docs.where("lang = 'en'")).select("doc_id", F.col("tier").cast("long").alias("tier"))


def resumed_rows(s, d):
    """What an earlier run left to do."""
    return lookup.todo(_t(s, d, "documents").select("doc_id"), _t(s, d, "labels").where("quality = 1"), "doc_id")


def sketch_arrays(s, d):
    kept = search.target_sketches(_t(s, d, "documents").selectExpr("doc_id AS row_idx", "text"))
    return search.sketch_arrays(kept, 100).select("row_idx", F.md5(F.array_join("sketch", ",")).alias("sketch"))


def sources_in_turn(s, d):
    """Two databases, the documents of odd and of even ids; the second is asked for what the first lacks."""
    db = _t(s, d, "documents").selectExpr("doc_id AS row_idx", "text")
    sources = {name: search.build_index(db.where(f"row_idx % 2 = {k}")) for k, name in ((1, "odd"), (0, "even"))}
    return cascade.search_in_turn(_t(s, d, "benchmark").selectExpr("item_id AS query", "text"), sources)


def written_lookup(s, d):
    """The index written by prefix, then read for the keys alone: folders of other prefixes are pruned at run time."""
    docs = _t(s, d, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("h"), F.col("source"), F.col("doc_id"))
    rows = lookup.fragment_rows(docs, "h", "source", "doc_id")
    numbered = rows.withColumn("fragment_id", F.regexp_extract("fragment_id", "([0-9]+)$", 1).cast("int"))
    path = f"{shared_folder(s)}/prefix-{uuid.uuid4().hex}"
    lookup.write_prefix_index(numbered, path)
    keys = _t(s, d, "labels").where("toxic = 1").select(F.md5(F.col("doc_id").cast("string")).alias("protein_hash"))
    out = lookup.lookup(lookup.read_prefix_index(s, path), keys)
    return out.select("protein_hash", F.col("fragment_id").cast("long").alias("fragment_id"), F.col("frag_row").cast("long").alias("frag_row"))


def _ids(s, d):
    return _t(s, d, "documents").selectExpr("doc_id", "CASE pmod(doc_id, 4) WHEN 0 THEN concat(md5(CAST(doc_id AS STRING)), '|', doc_id, '|', doc_id * 3) WHEN 1 THEN concat('h', doc_id, '|x|3') WHEN 2 THEN concat('AF-Q', doc_id, '-F1') ELSE concat('a b/', doc_id, '.é') END AS id")


def composite_ids(s, d):
    x = acc.composite_id(F.col("id"))
    return _ids(s, d).select("doc_id", x["protein_hash"].alias("hash"), x["fragment_id"].cast("long").alias("fragment_id"), x["frag_row"].cast("long").alias("frag_row"))


def safe_names(s, d):
    return _ids(s, d).where("pmod(doc_id, 4) <> 3").select("doc_id", acc.safe_id(F.col("id")).alias("name"), F.get(F.split("id", r"\|"), F.lit(0)).alias("first"))


def file_urls(s, d):
    a = acc.accession(F.col("id"))
    return _ids(s, d).where("id LIKE 'AF-%'").select("doc_id", acc.file_url("https://models.example/files/", a, "model").alias("model"), acc.file_url("https://models.example/files", a, "predicted_aligned_error").alias("pae"), acc.structure_name(a).alias("name"))


def database_labels(s, d):
    path = F.concat(F.lit("/db/"), F.element_at(F.array(*map(F.lit, ("ESM_v1.sidx", "x/AFDB.v6.sidx", "alphafold.pq", "own.set.sidx", ".hidden"))), (F.col("doc_id") % 5 + 1).cast("int")))
    return _t(s, d, "documents").select("doc_id", acc.db_label(path).alias("label"), acc.stem(path).alias("stem"))


def first_column(s, d):
    """The id of a table under the first of several names that it has."""
    from ..sources.readers import first_existing

    docs = _t(s, d, "documents")
    return docs.select(F.col(first_existing(docs, "rep_id", "header", "doc_id", "source")).alias("id"))


def scan_lookup(s, d):
    """Keys of one prefix."""
    return lookup.lookup_scan(_t(s, d, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("protein_hash")), "a")


_NAMES = (distinct_counts, timing_stats, status_histogram, status_prefixes, sorted_filter, bound_if_present, top_orders, head_per_group, select_top_hits, set_union, set_difference, cascade_coverage, selected_queries, containment_gate, template_gates, first_success, stop_rule, length_gate, token_batches, lane_batches, batch_costs, adaptive_rounds, tiered_lookup, resumed_rows, sketch_arrays, sources_in_turn, written_lookup, composite_ids, safe_names, file_urls, database_labels, first_column, scan_lookup)
QUERIES = {f.__name__: f for f in _NAMES}

_IDS = "WITH i AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN md5(doc_id::VARCHAR) || '|' || doc_id || '|' || doc_id * 3 WHEN 1 THEN 'h' || doc_id || '|x|3' WHEN 2 THEN 'AF-Q' || doc_id || '-F1' ELSE 'a b/' || doc_id || '.é' END AS id FROM documents)"
_BATCH = """WITH RECURSIVE o AS (SELECT coalesce(source, '') AS lane, doc_id AS id, coalesce(length(text), 0)::BIGINT AS length, row_number() OVER (PARTITION BY source ORDER BY coalesce(length(text), 0), doc_id) AS k FROM documents),
b AS (SELECT lane, id, length, k, 0::BIGINT AS batch, 1::BIGINT AS size FROM o WHERE k = 1 UNION ALL
  SELECT o.lane, o.id, o.length, o.k, CASE WHEN (size + 1) * o.length * o.length > 4000000 THEN batch + 1 ELSE batch END, CASE WHEN (size + 1) * o.length * o.length > 4000000 THEN 1 ELSE size + 1 END
  FROM b JOIN o ON o.lane = b.lane AND o.k = b.k + 1)"""

def _in_turn() -> str:
    """The search over each half of the documents for itself; of the second only queries without a hit in the first."""
    half = """, f{k} AS (SELECT h, count(*) AS df FROM k WHERE id % 2 = {k} GROUP BY h),
s{k} AS (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY h) AS pos FROM k JOIN f{k} USING (h) WHERE df <= 10 AND id % 2 = {k}),
c{k} AS (SELECT q.id AS query, s.id AS row_idx, count(*) AS shared FROM q JOIN s{k} s USING (h) WHERE pos <= 100 GROUP BY 1, 2 HAVING count(*) >= 2),
t{k} AS (SELECT query, row_idx, shared FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, row_idx DESC) AS n FROM c{k}) WHERE n <= 5)"""
    return f"""WITH {_kmers('documents', 'doc_id', 'k')}, {_kmers('benchmark', 'item_id', 'qk')}, q AS (SELECT id, h FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h) AS n FROM qk) WHERE n <= 100){half.format(k=1)}{half.format(k=0)}
SELECT query, 'odd' AS source, row_idx, shared, shared / 100.0::DOUBLE AS containment FROM t1
UNION ALL SELECT query, 'even', row_idx, shared, shared / 100.0::DOUBLE FROM t0 WHERE query NOT IN (SELECT query FROM t1)"""


SQL = {
    "distinct_counts": "SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")) + " FROM lineitem",
    "timing_stats": "SELECT event_type, min(value) AS lo, round(avg(value), 6) AS mean, max(value) AS hi, count(*) AS n FROM events GROUP BY 1",
    "status_histogram": "SELECT CASE quality WHEN 1 THEN 'ok' WHEN 0 THEN 'failed' ELSE 'skip' END AS status, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "status_prefixes": "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1",
    "sorted_filter": "SELECT doc_id, n_chars::BIGINT AS n_chars FROM documents WHERE n_chars >= 300 AND NOT contains(text, 'X') ORDER BY n_chars DESC, doc_id",
    "bound_if_present": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity >= 30 GROUP BY 1",
    "top_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "head_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3",
    "select_top_hits": "SELECT user_id AS query, event_id AS row_idx FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) DESC, event_id DESC) AS k FROM events) WHERE k <= 4",
    "set_union": "SELECT o_custkey AS id FROM orders WHERE o_custkey % 3 = 0 UNION SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0",
    "set_difference": "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'",
    "cascade_coverage": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR quality = 0 AND toxic = 1) AND NOT coalesce(source = 'src0' AND lang = 'en', false)",
    "selected_queries": _HITS + ", b AS (SELECT query, max(row_idx) AS row_idx FROM t JOIN (SELECT query, max(shared) AS shared FROM t GROUP BY query) USING (query, shared) GROUP BY query) SELECT row_idx, count(*) AS n, string_agg(query::VARCHAR, ',' ORDER BY query) AS queries FROM b GROUP BY row_idx",
    "containment_gate": _HITS + " SELECT query, row_idx, shared FROM t WHERE containment >= 0.08",
    "template_gates": "SELECT l_orderkey, l_linenumber::BIGINT AS line FROM lineitem WHERE l_discount >= 0.08::DOUBLE AND l_quantity / 50 >= 0.4::DOUBLE AND 1 - l_tax * 5 >= 0.7::DOUBLE",
    "first_success": "SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (l_quantity >= 40), max(l_linenumber))::BIGINT AS line, CASE WHEN bool_or(l_quantity >= 40) THEN 'ok' ELSE 'failed' END AS status FROM lineitem GROUP BY 1",
    "stop_rule": "SELECT l_orderkey, count(*) FILTER (l_quantity >= 40 OR l_linenumber > 5 OR l_linenumber = 1 AND l_quantity < 10) AS stopped, count(*) AS n FROM lineitem GROUP BY 1",
    "length_gate": "SELECT doc_id, CASE WHEN length(text) > 1000 THEN 'too_long' ELSE 'ok' END AS status, CASE WHEN strlen(text) > 2500 THEN 3 ELSE 2 END::BIGINT AS step FROM documents",
    "token_batches": _BATCH + " SELECT lane, id, length, batch FROM b",
    "lane_batches": _BATCH.replace("coalesce(source, '') AS lane", "lane").replace("PARTITION BY source", "PARTITION BY lane").replace("FROM documents)", "FROM (SELECT *, coalesce(source, '') || CASE WHEN m > 1 THEN '/' || ((doc_id % m) + m) % m ELSE '' END AS lane FROM (SELECT *, ceil(count(*) OVER (PARTITION BY source) / 60.0)::BIGINT AS m FROM documents)))", 1) + " SELECT lane, id, length, batch FROM b",
    "batch_costs": _BATCH + " SELECT lane, batch, count(*) AS items, max(length) AS longest, count(*) * max(length) * max(length) AS cost FROM b GROUP BY 1, 2",
    "adaptive_rounds": """WITH s AS (SELECT c_custkey AS id, turn, (c_custkey * 37 + turn * 53) % 101 AS score FROM customer CROSS JOIN (SELECT unnest(range(0, 5)) AS turn))
SELECT id, score, turn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn) AS k FROM s WHERE score >= 80 OR turn >= 4 OR turn = 0 AND score < 15) WHERE k = 1""",
    "tiered_lookup": "SELECT doc_id, CASE WHEN source = 'src0' THEN 0 WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 WHEN lang = 'en' THEN 2 END::BIGINT AS tier FROM documents",
    "resumed_rows": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "sources_in_turn": _in_turn(),
    "written_lookup": """SELECT md5(doc_id::VARCHAR) AS protein_hash, regexp_extract(source, '([0-9]+)$', 1)::BIGINT AS fragment_id, r AS frag_row
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents) d WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "sketch_arrays": _SKETCH + " SELECT id AS row_idx, md5(array_to_string(list_resize(list(h ORDER BY h), 100, 4294967295), ',')) AS sketch FROM p GROUP BY id",
    "composite_ids": _IDS + " SELECT doc_id, split_part(id, '|', 1) AS hash, CASE WHEN doc_id % 4 = 0 THEN doc_id ELSE -1 END AS fragment_id, CASE WHEN doc_id % 4 = 0 THEN doc_id * 3 ELSE -1 END AS frag_row FROM i",
    "safe_names": _IDS + r" SELECT doc_id, regexp_replace(id, '[^A-Za-z0-9_.-]', '_', 'g') AS name, split_part(id, '|', 1) AS first FROM i WHERE doc_id % 4 <> 3",
    "file_urls": _IDS + " SELECT doc_id, 'https://models.example/files/' || id || '-model_v6.pdb' AS model, 'https://models.example/files/' || id || '-predicted_aligned_error_v6.json' AS pae, id || '-model_v6.pdb' AS name FROM i WHERE id LIKE 'AF-%'",
    "database_labels": "SELECT doc_id, ['ESM Atlas', 'AFDB', 'AFDB', 'own.set', '.hidden'][doc_id % 5 + 1] AS label, ['ESM_v1', 'AFDB', 'alphafold', 'own', 'hidden'][doc_id % 5 + 1] AS stem FROM documents",
    "first_column": "SELECT doc_id AS id FROM documents",
    "scan_lookup": "SELECT md5(doc_id::VARCHAR) AS protein_hash FROM documents WHERE md5(doc_id::VARCHAR) LIKE 'a%'",
}
