"""Registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import accession as acc
from ..functions import alphabet, alignment
from ..operators import cascade, hits, lookup, search, structures
from ..sources.stage import spread, staged


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _db(spark, d):
    return _t(spark, d, "documents").selectExpr("doc_id AS row_idx", "text")


def _q(spark, d):
    return _t(spark, d, "benchmark").selectExpr("item_id AS query", "text")


def fasta_filter(s, d):
    return _t(s, d, "documents").where("NOT contains(text, 'X') AND length(text) BETWEEN 1 AND 2000").select("doc_id", F.length("text").cast("long").alias("len"))


def recode_alphabets(s, d):
    seq = alphabet.strip(F.col("text"))
    return spread(_t(s, d, "documents").select("doc_id", "text")).select("doc_id", *(F.md5(alphabet.recode(seq, k)).alias(k) for k in alphabet.SCHEMES))


def kmer_doc_freq(s, d):
    return alphabet.kmer_frequency(_db(s, d), "text")


def kmer_keep_band(s, d):
    return search.keep_band(kmer_doc_freq(s, d), 10)


def bottom_n_sketch(s, d):
    return search.target_sketches(_db(s, d)).withColumn("pos", F.col("pos").cast("long"))


def posting_lists(s, d):
    return search.posting_lists(search.build_index(_db(s, d))).select("h", "n", F.array_join("rows", ",").alias("targets"))


def sketch_search_topk(s, d):
    return search.containment_search(search.build_index(_db(s, d)), _q(s, d))


def sketch_search_segmented(s, d):
    how = {"k": 5, "n": 100}
    return search.containment_search(search.build_index(_db(s, d), max_freq=50, **how), _q(s, d), **how)


def annotate_hits(s, d):
    q = _q(s, d).select("query", alphabet.strip(F.col("text")).alias("seq"))
    t = _db(s, d).withColumnRenamed("text", "seq")
    a = _t(s, d, "labels").selectExpr("doc_id AS row_idx", "quality AS group_size")
    out = hits.annotate(sketch_search_topk(s, d), q, t, a, alphabet.strip)
    return out.select("query", "row_idx", "shared", F.col("qlen").cast("long").alias("qlen"), F.col("slen").cast("long").alias("slen"), F.col("group_size").cast("long").alias("group_size"))


def best_hit_per_query(s, d):
    return hits.best(sketch_search_topk(s, d), "query", F.desc("shared"), F.desc("row_idx")).select("query", "row_idx", "shared")


def cascade_anti_join(s, d):
    solved = sketch_search_topk(s, d).where("shared >= 50")
    return hits.without(_q(s, d).select("query"), solved)


def merge_hits_union_by_name(s, d):
    docs = _t(s, d, "documents")
    a = docs.where("source = 'src0'").selectExpr("doc_id", "n_chars AS score")
    b = docs.where("source <> 'src0'").selectExpr("doc_id", "lang")
    return hits.merge_by_name(a, b)


def hits_filter_tolerant(s, d):
    rows = _t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return hits.filter_tolerant(rows, k=50).select("event_id")


def prefix_partition_lookup(s, d):
    docs = _t(s, d, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("h"), F.col("source"), F.col("doc_id"))
    index = lookup.with_prefix(lookup.fragment_rows(docs, "h", "source", "doc_id"))
    keys = _t(s, d, "labels").where("quality = 1").select(F.md5(F.col("doc_id").cast("string")).alias("protein_hash"))
    return lookup.lookup(index, keys).select("protein_hash", "fragment_id", F.col("frag_row").cast("long").alias("frag_row"))


def parse_accession(s, d):
    docs = _t(s, d, "documents").selectExpr("doc_id", "CASE pmod(doc_id, 3) WHEN 0 THEN concat('sp:AF-A', doc_id, '-F1-model_v4') WHEN 1 THEN concat('AF-', lpad(CAST(doc_id AS STRING), 16, '0')) ELSE concat('x', doc_id) END AS id")
    a = acc.accession(F.col("id"))
    return docs.select("doc_id", a.alias("acc"), F.when(a.isNotNull(), acc.model_version(a)).cast("long").alias("version"))


def gap_rules(s, d):
    docs = _t(s, d, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "-").alias("g"))
    runs = alignment.gap_runs(F.col("g"))
    return docs.select("doc_id", F.md5(alignment.fix_hanging(F.col("g"))).alias("fixed"), F.size(runs).cast("long").alias("n_runs"), F.coalesce(F.array_max(runs), F.lit(0)).cast("long").alias("longest"))


def nw_best_hits(s, d):
    """Global alignment of each query, up to the longest query's length, with its best hit's sequence."""
    q = _q(s, d).select("query", alphabet.strip(F.col("text")).alias("seq"))
    t = _db(s, d).withColumnRenamed("text", "seq")
    out = cascade.aligned_hits(best_hit_per_query(s, d), q, t, clean=alphabet.strip)
    return out.select("query", "row_idx", "x.score", "x.identity", "x.coverage", "x.class_a")


def _points(s, d):
    at = F.explode(F.sequence(F.lit(0), F.lit(20))).alias("pos")
    e = _t(s, d, "embeddings").select(F.col("vec_id").alias("ref_id"), "embedding", at)
    return e.select("ref_id", F.col("pos").cast("long").alias("pos"), *(F.expr(f"CAST(get(embedding, pos * 3 + {k}) AS DOUBLE) * 10").alias(c) for k, c in enumerate("xyz")))


def _cells(s, d):
    e = _t(s, d, "embeddings").select(F.col("vec_id").alias("ref_id"), F.posexplode("embedding").alias("at", "v"))
    return e.selectExpr("ref_id", "CAST(at DIV 8 AS LONG) AS i", "CAST(at % 8 AS LONG) AS j", "abs(CAST(v AS DOUBLE)) * 10 AS pae")


def chain_breaks(s, d):
    return structures.chain_breaks(_points(s, d), 1.5).select("ref_id", "pos", F.col("segment").cast("long").alias("segment"))


def break_segments(s, d):
    b = structures.chain_breaks(_points(s, d), 1.5)
    return b.groupBy("ref_id", "segment").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n")).withColumn("segment", F.col("segment").cast("long"))


def segment_islands(s, d):
    return structures.islands(_points(s, d).withColumn("up", F.col("x") > 0), "up")


def uncovered_segments(s, d):
    return structures.uncovered_segments(_points(s, d).withColumn("up", F.col("x") > 0), "up", 2)


def interpolate_anchors(s, d):
    out = structures.interpolate(_points(s, d).withColumn("up", F.col("y") > 0), "up", "x")
    return out.select("ref_id", "pos", F.round("x", 6).alias("x"))


def pae_edges(s, d):
    return structures.pae_edges(_cells(s, d), 1.0).select("ref_id", "i", "j", F.round("weight", 4).alias("weight"))


def expand_indices(s, d):
    docs = _t(s, d, "benchmark").selectExpr("item_id AS ref_id", "CAST(length(text) AS LONG) AS n_full", "explode(sequence(0L, CAST(length(text) DIV 3 AS LONG))) AS i")
    return structures.expand_indices(docs, 3, "n_full").select("ref_id", "i", "pos")


def domain_gate(s, d):
    r = _t(s, d, "lineitem").selectExpr("l_suppkey AS ref_id", "l_linenumber AS domain_id", "l_orderkey AS pos", "CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS plddt")
    out = structures.domain_gate(r, 30, 25.0)
    return out.select("ref_id", F.col("domain_id").cast("long").alias("domain_id"), "n", "start", "end", F.round("plddt", 6).alias("plddt"))


def status_counts(s, d):
    ok = F.col("quality") == 1
    return _t(s, d, "documents").join(_t(s, d, "labels"), "doc_id").groupBy(acc.db_type(F.col("source")).alias("db")).agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("fail"))


def status_map_default(s, d):
    done = _t(s, d, "labels").selectExpr("doc_id", "IF(quality = 1, 'ok', 'fail') AS status")
    return _t(s, d, "documents").select("doc_id").join(done, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("skip")).alias("status"))


def frequency_totals(s, d):
    return kmer_doc_freq(s, d).groupBy("df").agg(F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))


def classes(found, queries, targets, clean=None):
    """(query, row_idx, class), a row for each query: A with its first candidate that passes, else B or C by its best ranked, C without a row_idx where nothing could be aligned.  B asks for an identity of 0.4 over the query's span."""
    rows = hits.annotate(found, queries, targets, clean=clean).select("query", "row_idx", "shared", "full_qseq", "full_sseq")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    picked = rows.groupBy("query").applyInPandas(alignment.first_class_a(), f"query {kinds['query']}, row_idx {kinds['row_idx']}, q string, s string, class_a boolean, identity double")
    kind = F.when(F.col("class_a"), "A").when(alignment.class_b(F.col("q"), F.col("s")) & (F.col("identity") >= 0.4), "B").otherwise("C")
    return queries.select("query").join(picked.select("query", "row_idx", kind.alias("class")), "query", "left").na.fill("C", ["class"])


def identity_classes(s, d):
    """Rule classes of all queries: their candidates are aligned in order of rank until one is of class A."""
    q = _q(s, d).select("query", alphabet.strip(F.col("text")).alias("seq"))
    t = _db(s, d).withColumnRenamed("text", "seq")
    return classes(search.containment_search(search.build_index(_db(s, d)), _q(s, d), top=100), q, t, alphabet.strip)


def full_cascade(s, d):
    """Template classes of all queries, C split by coverage and identity, D without a hit."""
    q = _q(s, d).select("query", alphabet.strip(F.col("text")).alias("seq"))
    t = _db(s, d).withColumnRenamed("text", "seq")
    found = staged(search.containment_search(search.build_index(_db(s, d)), _q(s, d), top=100), "hits")
    solved = staged(classes(found, q, t, alphabet.strip), "classes")
    still = found.join(solved.where("class IN ('A', 'B')").select("query"), "query", "left_anti")  # only these are aligned again
    return cascade.template_classes(solved, cascade.aligned_hits(still, q, t, clean=alphabet.strip), q)


def first_seen(s, d):
    return hits.first_seen(_t(s, d, "events"), "user_id", "event_id")


def first_qualifying(s, d):
    """Line numbers repeat within an order: of equal ones the row that stands first in the files."""
    rows = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    out = hits.first_qualifying(rows, "l_orderkey", "l_linenumber", F.col("l_quantity") >= 30, "file", "at")
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey")


def mask_letter(s, d):
    x = hits.mask_letter(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")))
    return _t(s, d, "benchmark").select("item_id", x.alias("x")).select("item_id", F.md5("x.masked").alias("masked"), F.size("x.at").cast("long").alias("n"))


_NAMES = (full_cascade, first_seen, first_qualifying, mask_letter, chain_breaks, break_segments, segment_islands, uncovered_segments, interpolate_anchors, pae_edges, expand_indices, domain_gate, status_counts, status_map_default, frequency_totals, identity_classes, fasta_filter, recode_alphabets, kmer_doc_freq, kmer_keep_band, bottom_n_sketch, posting_lists, sketch_search_topk, sketch_search_segmented, annotate_hits, best_hit_per_query, cascade_anti_join, merge_hits_union_by_name, hits_filter_tolerant, prefix_partition_lookup, parse_accession, gap_rules, nw_best_hits)
QUERIES = {f.__name__: f for f in _NAMES}


def _translate(seq: str, scheme: str) -> str:
    c = alphabet.SCHEMES[scheme]
    return f"translate({seq}, '{''.join(c)}', '{''.join(str(i) * len(x) for i, x in enumerate(c))}')"


_SEQ = f"upper(regexp_replace(coalesce(text, ''), '[^{alphabet.RESIDUES}{alphabet.RESIDUES.lower()}]', '', 'g'))"
def _kmers(table: str, key: str, name: str, k: int = 9) -> str:
    """Distinct k-mers of each text's runs of residue letters."""
    classes = alphabet.SCHEMES["murphy2000_5"]
    others = "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in alphabet.RESIDUES)
    letters, digits = "".join(classes) + others, "".join(str(i) * len(x) for i, x in enumerate(classes)) + "*" * len(others)
    r = f"translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '*', 'g')), '{letters}', '{digits}')"
    runs = f"SELECT {key} AS id, unnest(string_split_regex({r}, '\\*+')) AS r FROM {table}"
    w = f"SELECT DISTINCT id, substr(r, i::INT, {k}) AS w FROM (SELECT id, r, unnest(range(1, length(r) - {k - 2})) AS i FROM ({runs}) WHERE length(r) >= {k})"
    code = " + ".join(f"substr(w, {j + 1}, 1)::BIGINT * {5 ** (k - 1 - j)}" for j in range(k))
    return f"{name} AS MATERIALIZED (SELECT id, {code} AS h FROM ({w}))"


def _sketch(k: int, most: int) -> str:
    kept = f"s AS (SELECT id, h, row_number() OVER (PARTITION BY id ORDER BY h) AS pos FROM k JOIN f USING (h) WHERE df <= {most})"
    return f"WITH {_kmers('documents', 'doc_id', 'k', k)}, f AS (SELECT h, count(*) AS df FROM k GROUP BY h), {kept}, p AS (SELECT id, pos, h FROM s WHERE pos <= 100)"


def _hits(k: int = 9, most: int = 10) -> str:
    return _sketch(k, most) + f""", {_kmers('benchmark', 'item_id', 'qk', k)}, q AS (SELECT id, h FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY h) AS n FROM qk) WHERE n <= 100),
c AS (SELECT q.id AS query, p.id AS row_idx, count(*) AS shared FROM q JOIN p USING (h) GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT query, row_idx, shared, shared / 100.0::DOUBLE AS containment FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, row_idx DESC) AS n FROM c) WHERE n <= 5)"""


_DF = f"WITH {_kmers('documents', 'doc_id', 'k')}, f AS (SELECT h, count(*) AS df FROM k GROUP BY h)"
_SKETCH, _HITS = _sketch(9, 10), _hits()

_POINTS = "WITH p AS (SELECT vec_id AS ref_id, pos, " + ", ".join(f"embedding[pos * 3 + {k + 1}]::DOUBLE * 10 AS {c}" for k, c in enumerate("xyz")) + " FROM (SELECT *, unnest(range(0, 21)) AS pos FROM embeddings))"
_BROKEN = _POINTS + """, s AS (SELECT ref_id, pos, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)) AS step FROM p WINDOW w AS (PARTITION BY ref_id ORDER BY pos)),
b AS (SELECT ref_id, pos, least(coalesce(sum(CASE WHEN step > 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY ref_id ORDER BY pos), 0), 25)::BIGINT AS segment FROM s)"""

SQL = {
    "fasta_filter": "SELECT doc_id, length(text)::BIGINT AS len FROM documents WHERE NOT contains(text, 'X') AND length(text) BETWEEN 1 AND 2000",
    "recode_alphabets": "SELECT doc_id, " + ", ".join(f"md5({_translate(_SEQ, k)}) AS {k}" for k in alphabet.SCHEMES) + " FROM documents",
    "kmer_doc_freq": _DF + " SELECT h, df FROM f",
    "kmer_keep_band": _DF + " SELECT h, df FROM f WHERE df <= 10",
    "bottom_n_sketch": _SKETCH + " SELECT id AS row_idx, pos, h FROM p",
    "posting_lists": _SKETCH + " SELECT h, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS targets FROM p GROUP BY h",
    "sketch_search_topk": _HITS + " SELECT * FROM t",
    "sketch_search_segmented": _hits(5, 50) + " SELECT * FROM t",
    "annotate_hits": _HITS + f" SELECT query, row_idx, shared, (SELECT length({_SEQ}) FROM benchmark WHERE item_id = query)::BIGINT AS qlen, (SELECT length({_SEQ}) FROM documents WHERE doc_id = row_idx)::BIGINT AS slen, coalesce(quality, 0)::BIGINT AS group_size FROM t LEFT JOIN labels ON doc_id = row_idx",
    "best_hit_per_query": _HITS + " SELECT query, max(row_idx) AS row_idx, max(shared) AS shared FROM t JOIN (SELECT query, max(shared) AS shared FROM t GROUP BY query) USING (query, shared) GROUP BY query",
    "cascade_anti_join": _HITS + " SELECT item_id AS query FROM benchmark WHERE item_id NOT IN (SELECT query FROM t WHERE shared >= 50)",
    "merge_hits_union_by_name": "SELECT doc_id, CASE WHEN source = 'src0' THEN n_chars END AS score, CASE WHEN source <> 'src0' THEN lang END AS lang FROM documents WHERE source IS NOT NULL",
    "hits_filter_tolerant": "SELECT event_id FROM events WHERE coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE) >= 50, true)",
    "prefix_partition_lookup": "SELECT protein_hash, fragment_id, frag_row FROM (SELECT doc_id, md5(doc_id::VARCHAR) AS protein_hash, source AS fragment_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS frag_row FROM documents) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "gap_rules": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(g, '^([^-]{1,3})(-{3,})', '\2\1'), '(-{3,})([^-]{1,3})$', '\2\1')) AS fixed, len(r)::BIGINT AS n_runs,
coalesce(list_max(list_transform(r, lambda x: length(x))), 0)::BIGINT AS longest FROM (SELECT doc_id, g, regexp_extract_all(g, '-+') AS r FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '-', 'g') AS g FROM documents))""",
    "parse_accession": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'AF-A' || doc_id || '-F1' WHEN 1 THEN 'AF-' || lpad(doc_id::VARCHAR, 16, '0') END AS acc, CASE doc_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 1 END::BIGINT AS version FROM documents",
} | {
    "chain_breaks": _BROKEN + " SELECT ref_id, pos, segment FROM b",
    "break_segments": _BROKEN + ' SELECT ref_id, segment, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM b GROUP BY ref_id, segment',
    "segment_islands": _POINTS + """, g AS (SELECT ref_id, pos, pos - row_number() OVER (PARTITION BY ref_id ORDER BY pos) AS g FROM p WHERE x > 0)
SELECT ref_id, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM g GROUP BY ref_id, g""",
    "uncovered_segments": _POINTS + """, g AS (SELECT *, pos - row_number() OVER (PARTITION BY ref_id ORDER BY pos) AS g FROM p WHERE NOT x > 0),
u AS (SELECT ref_id, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM g GROUP BY ref_id, g HAVING count(*) >= 2)
SELECT ref_id, CASE WHEN start > 0 THEN start - 1 END AS prev, CASE WHEN "end" < 20 THEN "end" + 1 END AS "next", start, "end", n FROM u""",
    "interpolate_anchors": _POINTS + """, a AS (SELECT ref_id, pos, x FROM p WHERE y > 0),
n AS (SELECT p.ref_id, p.pos, max(CASE WHEN a.pos <= p.pos THEN a.pos END) AS p0, min(CASE WHEN a.pos >= p.pos THEN a.pos END) AS p1 FROM p LEFT JOIN a USING (ref_id) GROUP BY 1, 2)
SELECT n.ref_id, n.pos, round(CASE WHEN p0 = p1 THEN l.x WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN l.x + (r.x - l.x) * (n.pos - p0) / (p1 - p0)
  WHEN p0 IS NOT NULL THEN l.x + 3.8::DOUBLE * (n.pos - p0) ELSE r.x - 3.8::DOUBLE * (p1 - n.pos) END, 6) AS x
FROM n LEFT JOIN a l ON l.ref_id = n.ref_id AND l.pos = p0 LEFT JOIN a r ON r.ref_id = n.ref_id AND r.pos = p1""",
    "pae_edges": """SELECT ref_id, i, j, round(1 / greatest(pae, 1e-6::DOUBLE), 4) AS weight
FROM (SELECT vec_id AS ref_id, k // 8 AS i, k % 8 AS j, abs(embedding[k + 1]::DOUBLE) * 10 AS pae FROM (SELECT *, unnest(range(0, 64)) AS k FROM embeddings)) WHERE pae < 1 AND i < j""",
    "expand_indices": "SELECT item_id AS ref_id, pos // 3 AS i, pos FROM (SELECT item_id, unnest(range(0, length(text))) AS pos FROM benchmark)",
    "domain_gate": """SELECT l_suppkey AS ref_id, l_linenumber::BIGINT AS domain_id, count(*) AS n, min(l_orderkey) AS start, max(l_orderkey) AS "end", round(avg(l_quantity) FILTER (l_returnflag <> 'N'), 6) AS plddt
FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 30 AND coalesce(avg(l_quantity) FILTER (l_returnflag <> 'N') >= 25, true)""",
    "status_counts": "SELECT coalesce(nullif(source, ''), 'afdb') AS db, count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality <> 1) AS fail FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "status_map_default": "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'skip' WHEN quality = 1 THEN 'ok' ELSE 'fail' END AS status FROM documents LEFT JOIN labels l USING (doc_id)",
    "frequency_totals": _DF + " SELECT df, count(*) AS n, min(h) AS lo, max(h) AS hi FROM f GROUP BY df",
    "first_seen": "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id",
    "first_qualifying": "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_quantity >= 30) WHERE n = 1",
    "mask_letter": "SELECT item_id, md5(replace(u, 'U', 'C')) AS masked, length(u) - length(replace(u, 'U', '')) AS n FROM (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS u FROM benchmark)",
}
