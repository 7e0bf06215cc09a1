"""Queries of the registry, retrieval, reconciliation, case file, chronology and answer operators."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from casegrid.functions import patterns as P, textcols as T
from casegrid.operators import answerset, answers, casefile, chronology, chunking, reconcile, registry, rendering, retrieval
from casegrid.plans import adapters as A
from casegrid.plans.catalog import query
from casegrid.plans.text_queries import RECORDS

# ---- registry: aggregates, filters, joins, sorts, sets, mutations

_RUNS = "runs AS (SELECT source, substr(sha256('/ws/' || source), 1, 16) AS run_id, '/ws/' || source AS run_dir, count(*) AS total_documents, min(doc_id) AS first_doc, CASE WHEN min(doc_id) % 5 = 4 THEN 'pending' ELSE 'indexed' END AS status FROM documents WHERE source IS NOT NULL GROUP BY source)"
#: Letters stand for chunks here: one a document of a nation's case.
_CASES = f"{RECORDS}, runs AS (SELECT run_id, run_dir, count(*) AS total_documents, CASE WHEN min(record_id) % 5 = 4 THEN 'pending' ELSE 'indexed' END AS status FROM r GROUP BY run_id, run_dir)"


def _letters(spark, sf_dir):
    r = A.records(spark, sf_dir)
    return r.select("run_id", "run_dir", "doc_id", "chunk_id", "record_id", F.col("record_id").cast("int").alias("chunk_index"), "text", F.col("doctor").alias("author"), F.col("order_date").alias("date_extracted"), "original_filename", F.col("patient").alias("patient_name"))


def _letter_runs(chunks):
    return chunks.groupBy("run_id", "run_dir").agg(F.count("*").alias("total_documents"), F.when(F.min("record_id") % 5 == 4, "pending").otherwise("indexed").alias("status"))


@query("AGG1_corpus_stats", f"""WITH {_CASES} SELECT (SELECT count(*) FROM runs WHERE status = 'indexed') AS indexed_runs, (SELECT count(DISTINCT doc_id) FROM r) AS indexed_documents, count(*) AS chunks, count(DISTINCT doctor) AS authors, min(order_date) AS date_min, max(order_date) AS date_max FROM r""")
def corpus_stats(spark, sf_dir):
    c = _letters(spark, sf_dir)
    return registry.corpus_stats(_letter_runs(c), c.select("doc_id", F.lit("indexed").alias("status")).distinct(), c)


@query("AGG2_runs_with_stats", f"WITH {_CASES} SELECT run_id, run_dir, total_documents, count(*) AS chunks, count(DISTINCT doctor) AS authors, min(order_date) AS date_min, max(order_date) AS date_max FROM runs JOIN r USING (run_id, run_dir) WHERE status = 'indexed' GROUP BY ALL")
def runs_with_stats(spark, sf_dir):
    c = _letters(spark, sf_dir)
    return registry.runs_with_stats(_letter_runs(c), c).drop("status")


@query("AGG3_run_totals", f"WITH {RECORDS} SELECT run_id, count(DISTINCT doc_id) AS documents, count(*) AS chunks FROM r GROUP BY run_id")
def run_totals(spark, sf_dir):
    return _letters(spark, sf_dir).groupBy("run_id").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))


@query("AGG4_date_range_for_run", f"WITH {RECORDS} SELECT run_id, min(order_date) AS date_min, max(order_date) AS date_max FROM r GROUP BY run_id")
def date_range(spark, sf_dir):
    return _letters(spark, sf_dir).groupBy("run_id").agg(F.min("date_extracted").alias("date_min"), F.max("date_extracted").alias("date_max"))


_POINTS = """ids AS (SELECT vec_id, label, substr(sha256('doc-' || vec_id || ':0'), 1, 24) AS chunk FROM embeddings),
h AS (SELECT *, sha256(chunk) AS x FROM ids),
points AS (SELECT vec_id, label, CASE WHEN vec_id % 11 = 10 THEN 'orphan-' || vec_id ELSE chunk END AS chunk_id,
 CASE WHEN vec_id % 13 = 12 THEN 'odd-' || vec_id ELSE substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-' || substr(x, 17, 4) || '-' || substr(x, 21, 12) END AS point_id,
 CASE WHEN vec_id % 11 = 10 THEN 'run-lost' ELSE 'run-' || (vec_id % 20) END AS run_id, 'doc-' || vec_id AS doc_id FROM h)"""
_REGISTRY = _POINTS + """, g AS (SELECT doc_id AS number, 'doc-' || doc_id AS doc_id, 'run-' || (doc_id % 20) AS run_id, substr(sha256('doc-' || doc_id || ':0'), 1, 24) AS chunk_id FROM documents),
chunks AS (SELECT number, chunk_id, doc_id, run_id, CASE WHEN number % 7 = 6 THEN NULL WHEN number % 17 = 16 THEN 'shared-point' ELSE substr(sha256(chunk_id), 1, 8) || '-' || substr(sha256(chunk_id), 9, 4) || '-' || substr(sha256(chunk_id), 13, 4) || '-' || substr(sha256(chunk_id), 17, 4) || '-' || substr(sha256(chunk_id), 21, 12) END AS point_id FROM g),
docs AS (SELECT doc_id, run_id, CASE WHEN number % 19 = 18 THEN 'pending' ELSE 'indexed' END AS status FROM g)"""


@query("AGG5_run_vector_counts", f"WITH {_POINTS} SELECT CASE WHEN label IS NULL THEN NULL ELSE label % 3 END AS collection, run_id, count(*) AS points FROM points GROUP BY ROLLUP (1, 2)")
def run_vector_counts(spark, sf_dir):
    return A.points(spark, sf_dir).withColumn("collection", F.col("label") % 3).rollup("collection", "run_id").agg(F.count("*").alias("points"))


@query("AGG6_baseline_delta", f"""WITH {_REGISTRY}, a AS (SELECT run_id, count(DISTINCT doc_id) AS documents, count(*) AS chunks, count(DISTINCT point_id) AS refs FROM chunks GROUP BY run_id), b AS (SELECT run_id, count(*) AS points FROM points GROUP BY run_id)
SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(documents, 0) AS documents, coalesce(chunks, 0) AS chunks, coalesce(refs, 0) AS refs, coalesce(points, 0) AS points, coalesce(points, 0) - coalesce(refs, 0) AS delta, a.run_id IS NULL AS points_only FROM a FULL JOIN b ON a.run_id = b.run_id""")
def baseline_delta(spark, sf_dir):
    a = A.registry(spark, sf_dir)["chunks"].groupBy("run_id").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.countDistinct("point_id").alias("refs"), F.lit(True).alias("known"))
    b = A.points(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("points"))
    both = a.join(b, "run_id", "full").withColumn("points_only", F.col("known").isNull()).fillna(0, ["documents", "chunks", "refs", "points"])
    return both.select("run_id", "documents", "chunks", "refs", "points", (F.col("points") - F.col("refs")).alias("delta"), "points_only")


@query("AGG13_cache_info", "SELECT event_type AS prefix, count(*) AS entries FROM (SELECT event_type, user_id, max(ts) AS last FROM events GROUP BY 1, 2) WHERE last + INTERVAL 30 DAY > (SELECT max(ts) FROM events) GROUP BY 1")
def cache_info(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    cache = e.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"), F.col("event_id").cast("string").alias("value"), F.col("ts").alias("written_at"), (F.col("ts") + F.expr("interval 30 days")).alias("expires_at"))
    now = e.agg(F.max("ts").alias("now"))
    live = registry.live_entries(cache.join(F.broadcast(now)), F.col("now"))
    return live.groupBy(F.split_part("key", F.lit(":"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("entries"))


@query("AGG14_counters", "SELECT event_type AS stat, cast(round(sum(value), 2) AS double) AS total, count(*) AS n FROM events GROUP BY 1")
def counters(spark, sf_dir):
    return A.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stat")).agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


@query("AGG15_qa_metrics", "SELECT event_type AS task, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(CASE WHEN event_id % 10 = 0 THEN 1.0 ELSE 0.0 END), 6) AS limit_rate FROM events GROUP BY 1")
def qa_metrics(spark, sf_dir):
    """Parsed from rendered log lines, as a log reader would see them."""
    line = F.concat(F.lit("task="), "event_type", F.lit(" latency="), F.col("value").cast("string"), F.lit(" limit="), (F.col("event_id") % 10 == 0).cast("string"))
    log = A.table(spark, sf_dir, "events").select(line.alias("line"))
    got = log.select(F.regexp_extract("line", r"task=(\S+)", 1).alias("task"), F.regexp_extract("line", r"latency=(\S+)", 1).cast("double").alias("latency"), (F.regexp_extract("line", r"limit=(\S+)", 1) == "true").alias("hit"))
    return got.groupBy("task").agg(F.count("*").alias("n"), F.round(F.percentile("latency", 0.5), 6).alias("median"), F.round(F.percentile("latency", 0.95), 6).alias("p95"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("limit_rate"))


@query("AGG19_upload_manifest", "SELECT source AS file, count(*) AS files, sum(strlen(text)) AS bytes, sum(CASE WHEN doc_id % 3 > 0 THEN (length(text) + 999) // 1000 END) AS pages FROM documents GROUP BY ROLLUP (1)")
def upload_manifest(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    pages = F.when(F.col("doc_id") % 3 > 0, F.floor((F.length("text") + 999) / 1000))
    return d.rollup(F.col("source").alias("file")).agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(pages).alias("pages"))


@query("AGG18_embedding_telemetry", "SELECT label AS collection, count(*) AS points, count_if(vec_id % 4 = 0) AS cached FROM embeddings GROUP BY 1")
def embedding_telemetry(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("collection")).agg(F.count("*").alias("points"), F.count_if(F.col("vec_id") % 4 == 0).alias("cached"))


@query("FLT1_metadata_filter", f"WITH {RECORDS} SELECT record_id FROM r WHERE doctor = 'Aaab' AND run_dir = '/ws/nation3'")
def metadata_filter(spark, sf_dir):
    return A.records(spark, sf_dir).where((F.col("doctor") == "Aaab") & (F.col("run_dir") == "/ws/nation3")).select("record_id")


@query("FLT2_date_range", "SELECT o_orderkey FROM orders WHERE o_orderkey % 9 > 0 AND o_orderdate >= '1994-03-01' AND o_orderdate <= '1996-02-29'")
def date_range_filter(spark, sf_dir):
    """Bounds of any form; rows without a date drop out."""
    o = A.table(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_orderkey") % 9 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.where(F.col("d").between(T.iso_bound(F.lit("1994-3")), T.iso_bound(F.lit("1996-2-29")))).select("o_orderkey")


@query("FLT4_indexed_only", f"WITH {_RUNS} SELECT run_id, run_dir FROM runs WHERE status = 'indexed'")
def indexed_only(spark, sf_dir):
    return A.runs(spark, sf_dir).where("status = 'indexed'").orderBy(F.desc("first_doc"), "run_id").select("run_id", "run_dir")


@query("FLT5_term_match_any", "SELECT doc_id FROM documents WHERE text ILIKE '%tion%the%' OR text ILIKE '%keit_der%'")
def term_match_any(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id").withColumn("chunk_index", F.lit(0))
    return retrieval.lexical_search(d, ["tion%the", "keit_der"]).select(F.col("chunk_id").alias("doc_id"))


@query("FLT7_excluded_date_roles", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 5 IN (0)")
def excluded_roles(spark, sf_dir):
    roles = F.array(F.lit("event_date"), *[F.lit(r) for r in P.EXCLUDED_ROLES])
    rows = A.table(spark, sf_dir, "lineitem").withColumn("role", F.get(roles, F.col("l_linenumber") % 5))
    return rows.where(~F.col("role").isin(*P.EXCLUDED_ROLES)).select("l_orderkey", "l_linenumber")


@query("FLT8_ignore_keywords", "SELECT p_partkey FROM part WHERE NOT regexp_matches(lower(p_name), '" + P.IGNORED_NAMES + "')")
def ignore_keywords(spark, sf_dir):
    return A.table(spark, sf_dir, "part").where(~F.lower("p_name").rlike(P.IGNORED_NAMES)).select("p_partkey")


@query("JN1_page_map", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN cast((length(text) + 999) // 1000 AS bigint) END AS pages FROM documents")
def page_map(spark, sf_dir):
    """Markdown names joined to page maps by name, else without their number prefix."""
    d = A.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("file"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    files = d.select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("12_"), name)).otherwise(name).alias("name"))
    maps = d.where("doc_id % 3 < 2").select(name.alias("map_name"), F.floor((F.length("text") + 999) / 1000).alias("pages"))
    first = files.join(maps, F.col("name") == F.col("map_name"), "left").withColumnRenamed("pages", "exact").drop("map_name")
    both = first.withColumn("bare", F.regexp_replace("name", r"^\d+_", "")).join(maps, F.col("bare") == F.col("map_name"), "left")
    return both.select("doc_id", F.coalesce("exact", "pages").alias("pages"))


@query("JN6_hit_lookup", f"WITH {_REGISTRY} SELECT vec_id, p.chunk_id, coalesce(c.doc_id, 'preview') AS found FROM points p LEFT JOIN chunks c ON p.point_id = c.point_id")
def hit_lookup(spark, sf_dir):
    c = A.registry(spark, sf_dir)["chunks"].select("point_id", F.col("doc_id").alias("c_doc"))
    return A.points(spark, sf_dir).join(c, "point_id", "left").select("vec_id", "chunk_id", F.coalesce("c_doc", F.lit("preview")).alias("found"))


@query("JN9_page_lookup", "SELECT l_orderkey, l_linenumber, cast(floor(l_quantity / 10) + 1 AS integer) AS page FROM lineitem")
def page_lookup(spark, sf_dir):
    ranges = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i * 10).alias("start"), (i * 10 + 10).alias("end"), (i + 1).alias("page")))
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", chunking.page_of(F.col("l_quantity"), ranges).alias("page"))


@query("JN13_policy", "SELECT event_id, CASE event_type WHEN 'click' THEN 0.15 WHEN 'view' THEN 0.05 ELSE 0.15 END AS threshold FROM events")
def policy(spark, sf_dir):
    """Modes joined to a fixed table of policies; an unknown mode gets the default."""
    policies = spark.createDataFrame([("click", 0.15), ("view", 0.05)], "mode string, threshold double")
    e = A.table(spark, sf_dir, "events")
    return e.join(F.broadcast(policies), e["event_type"] == policies["mode"], "left").select("event_id", F.coalesce("threshold", F.lit(0.15)).alias("threshold"))


@query("SET1_touched_ids", "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def touched(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).union(A.table(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("SET2_stale_ids", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def stale(spark, sf_dir):
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).subtract(A.table(spark, sf_dir, "orders").select("o_custkey"))


@query("SET3_run_ids", f"WITH {_REGISTRY} (SELECT run_id FROM docs UNION SELECT run_id FROM points) INTERSECT SELECT run_id FROM points WHERE label % 2 = 0")
def run_ids(spark, sf_dir):
    p = A.points(spark, sf_dir)
    return A.registry(spark, sf_dir)["documents"].select("run_id").union(p.select("run_id")).distinct().intersect(p.where("label % 2 = 0").select("run_id"))


@query("SRT6_distinct_values", f"WITH {RECORDS} SELECT DISTINCT run_id, doctor AS author FROM r")
def distinct_values(spark, sf_dir):
    return A.records(spark, sf_dir).select("run_id", F.col("doctor").alias("author")).distinct()


@query("MUT1_upsert_runs", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS run_dir, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'pending' ELSE 'indexed' END AS status FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 3 = 0")
def upsert_runs(spark, sf_dir):
    """Odd keys are registered; keys divisible by three come again or new: totals change, an existing status stays."""
    c = A.table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("id"), F.lit("old").alias("run_dir"), F.lit("indexed").alias("status"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("run_dir"), F.lit("pending").alias("status"))
    return registry.upsert(old, new, "id", keep=["status"])


@query("MUT3_upsert_chunks", "SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS text FROM orders")
def upsert_chunks(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    return registry.upsert(o.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderstatus").alias("text")), o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("chunk_id"), F.lit("new").alias("text")), "chunk_id")


@query("MUT4_replace_document_chunks", "SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, 'old' AS text FROM lineitem WHERE l_orderkey % 10 > 0 UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderkey % 10 = 0")
def replace_document_chunks(spark, sf_dir):
    li, o = A.table(spark, sf_dir, "lineitem"), A.table(spark, sf_dir, "orders")
    new = o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("new").alias("text"))
    return registry.replace_documents(li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), F.lit("old").alias("text")), new, new)


@query("MUT5_delete_documents_not_in_run", "SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 3 = 1)")
def delete_documents(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("run_id"))
    li = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"))
    return registry.retain_documents(o, li, "F", o.where("doc_id % 3 <> 1"))[1].join(o.select("doc_id"), "doc_id", "left_semi")


@query("MUT8_point_diff_apply", "SELECT id AS point_id, CASE WHEN o IS NULL THEN 'new' WHEN n IS NULL THEN 'stale' ELSE 'overwritten' END AS change FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS id, a.o_orderkey AS o, b.o_orderkey AS n FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) b ON a.o_orderkey = b.o_orderkey)")
def point_diff(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"))
    return registry.point_diff(o.where("point_id % 2 = 0"), o.where("point_id % 3 = 0"))


@query("MUT11_dimension_guard", "SELECT vec_id, len(embedding) AS dimension FROM embeddings")
def dimension_guard(spark, sf_dir):
    p = registry.guard_dimension(A.points(spark, sf_dir), 64)
    return p.select("vec_id", F.size("vector").cast("bigint").alias("dimension"))


@query("MUT12_ttl_cache", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS value FROM events GROUP BY user_id HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def ttl_cache(spark, sf_dir):
    e = A.table(spark, sf_dir, "events")
    cache = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("written_at"), (F.col("ts") + F.expr("interval 86400 seconds")).alias("expires_at"))
    live = registry.live_entries(cache.join(F.broadcast(e.agg(F.max("ts").alias("now")))), F.col("now"))
    return live.select(F.col("key").alias("user_id"), "value")


# ---- retrieval


@query("RET3_vector_search", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM e),
s AS (SELECT q.vec_id AS query_id, p.vec_id AS item_id, round(list_dot_product(q.v, p.v) / q.l / p.l, 6) AS score FROM n q, n p WHERE q.vec_id % 50 = 0),
k AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS integer) AS rank FROM s) SELECT * FROM k WHERE rank <= 10""")
def vector_search(spark, sf_dir):
    return retrieval.vector_search(A.queries(spark, sf_dir), A.points(spark, sf_dir).select(F.col("vec_id").alias("item_id"), "vector"), 10)


@query("FLT3_score_threshold", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM e),
s AS (SELECT q.vec_id AS query_id, p.vec_id AS item_id, round(list_dot_product(q.v, p.v) / q.l / p.l, 6) AS score FROM n q, n p WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT query_id, item_id, score FROM k WHERE rank <= 30 AND score >= 0.25""")
def score_threshold(spark, sf_dir):
    return retrieval.vector_search(A.queries(spark, sf_dir), A.points(spark, sf_dir).select(F.col("vec_id").alias("item_id"), "vector"), 30, 0.25).drop("rank")


_TERMS = ("tion", "the on", "heit", "ción")


@query("RET4_lexical_search", "WITH s AS (SELECT doc_id, (" + " + ".join(f"(CASE WHEN text ILIKE '%{t}%' THEN 1 ELSE 0 END)" for t in _TERMS) + ") / 4.0 AS score FROM documents) SELECT doc_id, cast(score AS double) AS score FROM s WHERE score > 0")
def lexical_search(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id").withColumn("chunk_index", F.lit(0))
    return retrieval.lexical_search(d, list(_TERMS)).select(F.col("chunk_id").alias("doc_id"), "score")


@query("SRT5_lexical_top_k", "SELECT doc_id, score FROM (SELECT doc_id, cast((" + " + ".join(f"(CASE WHEN text ILIKE '%{t}%' THEN 1 ELSE 0 END)" for t in _TERMS) + ") / 4.0 AS double) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 24")
def lexical_top_k(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id").withColumn("chunk_index", F.lit(0))
    return retrieval.lexical_search(d, list(_TERMS), limit=24).select(F.col("chunk_id").alias("doc_id"), "score")


@query("RET5_targeted_terms", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '" + P.IMAGING_WORDS + "') THEN 4 ELSE 0 END AS n FROM conversations")
def targeted_terms(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(retrieval.targeted_terms(F.coalesce("text", F.lit("")))).alias("n"))


#: Line items as hits: an order is a query, a part a chunk, the supplier its document, the price its score.
_HITS = "h AS (SELECT l_orderkey AS query_id, l_partkey || ':' || l_linenumber || ':' || l_suppkey || ':' || cast(round(l_extendedprice * 100) AS bigint) AS chunk_id, l_linenumber AS facet_no, l_extendedprice / 100000 AS score, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE 's' || l_suppkey % 7 END AS doc_id, l_returnflag || l_linestatus AS text, CASE WHEN l_suppkey % 4 = 0 THEN 'radiology_report' ELSE 'specialist_letter' END AS document_type, l_returnflag AS author, cast(l_shipdate AS date) AS date_extracted FROM lineitem)"


def _hits(spark, sf_dir):
    s = F.col("l_suppkey")
    return A.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_partkey", "l_linenumber", "l_suppkey")], F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")).alias("chunk_id"), F.col("l_linenumber").alias("facet_no"), (F.col("l_extendedprice") / 100000).alias("score"),
        F.when(s % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("s"), (s % 7).cast("string"))).alias("doc_id"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.when(s % 4 == 0, "radiology_report").otherwise("specialist_letter").alias("document_type"), F.col("l_returnflag").alias("author"), F.col("l_shipdate").cast("date").alias("date_extracted"),
    )


@query("AGG12_facet_merge", "WITH h AS (SELECT o_custkey AS query_id, o_orderstatus AS chunk_id, cast(o_orderkey % 8 AS integer) AS facet_no, o_totalprice AS score FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, facet_no) AS r FROM h) SELECT b.query_id, b.chunk_id, b.score, b.facet_no, f.facets FROM b JOIN (SELECT query_id, chunk_id, string_agg(facet_no, ',' ORDER BY facet_no) AS facets FROM (SELECT DISTINCT query_id, chunk_id, facet_no FROM h) GROUP BY 1, 2) f ON b.query_id = f.query_id AND b.chunk_id = f.chunk_id WHERE r = 1")
def facet_merge(spark, sf_dir):
    h = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderstatus").alias("chunk_id"), (F.col("o_orderkey") % 8).cast("int").alias("facet_no"), F.col("o_totalprice").alias("score"))
    return retrieval.facet_merge(h).withColumn("facets", F.array_join(F.col("retrieval_facets").cast("array<string>"), ",")).drop("retrieval_facets")


@query("RET7_hybrid_merge", f"WITH {_HITS}, v AS (SELECT * FROM h WHERE facet_no <= 3), l AS (SELECT *, greatest(score, CASE WHEN document_type = 'radiology_report' THEN 0.95 ELSE 0.84 END) AS f FROM h WHERE facet_no >= 3) SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id, greatest(v.score, l.f) AS score, v.chunk_id IS NULL AND l.document_type = 'radiology_report' AS primary_evidence, l.chunk_id IS NOT NULL AS named FROM v FULL JOIN l ON v.query_id = l.query_id AND v.chunk_id = l.chunk_id")
def hybrid_merge(spark, sf_dir):
    h = _hits(spark, sf_dir)
    return retrieval.hybrid_merge(h.where("facet_no <= 3").select("query_id", "chunk_id", "score"), h.where("facet_no >= 3"))


@query("RET8_fingerprint_dedup", f"WITH {_HITS}, k AS (SELECT *, CASE WHEN document_type = 'radiology_report' THEN 'r:' || lower(author) || date_extracted WHEN doc_id IS NOT NULL THEN doc_id || ':' || lower(text) ELSE '-' || chunk_id END AS fp FROM h) SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fp ORDER BY score DESC, chunk_id) AS r FROM k) WHERE r = 1")
def fingerprint_dedup(spark, sf_dir):
    return retrieval.drop_duplicates(_hits(spark, sf_dir)).select("query_id", "chunk_id")


@query("RET9_doc_diversify", f"WITH {_HITS}, a AS (SELECT *, doc_id IS NOT NULL AND row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) = 1 AS lead FROM h), b AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY lead DESC, score DESC, chunk_id) AS integer) AS rank FROM a) SELECT query_id, chunk_id, rank FROM b WHERE rank <= 4")
def doc_diversify(spark, sf_dir):
    return retrieval.diversify(_hits(spark, sf_dir), 4).select("query_id", "chunk_id", "rank")


@query("RET10_rerank", f"WITH {_HITS}, s AS (SELECT query_id, chunk_id, CASE WHEN facet_no % 2 = 0 THEN 1 / (1 + exp(-(score * 4 - 2))) ELSE score END AS score FROM h) SELECT query_id, chunk_id, round(score, 9) AS score, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS integer) AS rank FROM s")
def rerank(spark, sf_dir):
    h = _hits(spark, sf_dir)
    logits = h.where("facet_no % 2 = 0").select("query_id", "chunk_id", (F.col("score") * 4 - 2).alias("logit"))
    return retrieval.rerank(h.select("query_id", "chunk_id", "score"), logits).withColumn("score", F.round("score", 9))


@query("RET11_primary_floor", f"WITH {_HITS}, s AS (SELECT query_id, chunk_id, CASE WHEN document_type = 'radiology_report' THEN greatest(score, 0.99) ELSE score END AS score FROM h) SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS integer) AS rank FROM s")
def primary_floor(spark, sf_dir):
    h = _hits(spark, sf_dir).select("query_id", "chunk_id", "score", (F.col("document_type") == "radiology_report").alias("primary_evidence"))
    return retrieval.primary_floor(h).drop("primary_evidence")


@query("RET12_mmr")
def mmr(spark, sf_dir):
    """Every 50th vector's 60 nearest documents, ten chosen."""
    found = retrieval.vector_search(A.queries(spark, sf_dir), A.points(spark, sf_dir).select(F.col("vec_id").alias("item_id"), "vector"), 60)
    texts = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return retrieval.mmr(found.join(texts, "item_id").select("query_id", F.col("rank").cast("bigint").alias("ord"), "score", "text"), 10)


@query("RET12_mmr_of_600")
def mmr_of_600(spark, sf_dir):
    """Every 50th vector's 600 nearest documents, a hundred chosen."""
    found = retrieval.vector_search(A.queries(spark, sf_dir), A.points(spark, sf_dir).select(F.col("vec_id").alias("item_id"), "vector"), 600)
    texts = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return retrieval.mmr(found.join(texts, "item_id").select("query_id", F.col("rank").cast("bigint").alias("ord"), "score", "text"), 100)


#: Every 50th vector asks a question in one of seven modes; the vectors after it stand for its facets.
_ASKED = ["free_qa", "timeline", "expert_analysis", "general_knowledge", "judge_analysis", "prognosis", "made up"]


def _answer_set(spark, sf_dir, mmr):
    e = A.table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.get(F.array(*[F.lit(m) for m in _ASKED]), (F.col("vec_id") / 50 % len(_ASKED)).cast("int")).alias("mode"), F.when(F.col("vec_id") % 100 == 0, "What does imaging show?").otherwise("What was found?").alias("text"), F.lit(12).alias("top_k"))
    vectors = e.where("vec_id % 50 < 9").select((F.col("vec_id") - F.col("vec_id") % 50).alias("query_id"), (F.col("vec_id") % 50).cast("int").alias("facet_no"), F.col("embedding").alias("query_vector"))
    d, n = A.table(spark, sf_dir, "documents"), F.col("doc_id")
    chunks = d.select(
        n.alias("item_id"), F.concat(F.lit("c"), n.cast("string")).alias("chunk_id"), F.lit(0).alias("chunk_index"), F.when(n % 10 > 0, F.concat(F.lit("s"), (n % 97).cast("string"))).alias("doc_id"),
        F.when(n % 4 == 0, "radiology_report").otherwise("specialist_letter").alias("document_type"), F.concat(F.lit("a"), (n % 31).cast("string")).alias("author"), F.lit(None).cast("date").alias("date_extracted"), F.concat("text", F.when(n % 89 == 0, " Conclusion: none").otherwise("")).alias("text"),
    )
    points = e.join(d.select(n.alias("vec_id")), "vec_id").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    # a chunk's logit is the same for all questions, so none is made for pairs that no search finds
    logits = chunks.where("item_id % 2 = 0").select("chunk_id", F.expr("(item_id % 41) / 10 - 2").cast("double").alias("logit")).where("logit > 0")
    found = answerset.answer_set(q, vectors, points, chunks, logits, mmr=mmr)
    return found.select("query_id", "mode", "rank", "chunk_id", F.round("score", 6).alias("score"), "primary_evidence", F.array_join(F.col("facets").cast("array<string>"), ",").alias("facets"))


_ANSWER_SQL = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM e),
m AS (SELECT * FROM (VALUES ('free_qa', 3, 16, 0.15, false), ('expert_analysis', 9, 50, 0.05, true), ('judge_analysis', 9, 50, 0.05, true), ('prognosis', 8, 50, 0.05, true), ('timeline', 1, 50, 0.05, false)) t(mode, searches, hits, least, rerank)),
q AS (SELECT vec_id AS query_id, {_ASKED}[vec_id // 50 % {len(_ASKED)} + 1] AS said, vec_id % 100 = 0 AS imaging FROM e WHERE vec_id % 50 = 0),
o AS (SELECT q.query_id, q.imaging, m.* FROM q JOIN m ON m.mode = CASE WHEN said = 'made up' THEN 'free_qa' ELSE said END),
c AS (SELECT doc_id AS item_id, 'c' || doc_id AS chunk_id, CASE WHEN doc_id % 10 > 0 THEN 's' || doc_id % 97 END AS doc_id, CASE WHEN doc_id % 4 = 0 THEN 'radiology_report' ELSE 'specialist_letter' END AS document_type, 'a' || doc_id % 31 AS author, text || CASE WHEN doc_id % 89 = 0 THEN ' Conclusion: none' ELSE '' END AS text FROM documents),
s AS (SELECT o.query_id, f.vec_id % 50 AS facet_no, p.vec_id AS item_id, CASE WHEN searches = 1 THEN hits ELSE greatest(8, least(20, hits // 3)) END AS k, least, searches, round(list_dot_product(f.v, p.v) / f.l / p.l, 6) AS score
  FROM o JOIN n f ON f.vec_id - f.vec_id % 50 = o.query_id AND f.vec_id % 50 < searches, n p WHERE p.vec_id IN (SELECT doc_id FROM documents)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, facet_no ORDER BY score DESC, item_id) AS rank FROM s),
h AS (SELECT query_id, searches, facet_no, item_id, score, rank FROM t WHERE rank <= k AND score >= least),
g AS (SELECT query_id, item_id, max(score) AS score, string_agg(facet_no, ',' ORDER BY facet_no) AS facets FROM h WHERE searches > 1 GROUP BY 1, 2),
lex AS (SELECT item_id, document_type, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM (SELECT *, ({" + ".join(f"(CASE WHEN text ILIKE '%{t}%' THEN 1 ELSE 0 END)" for t in P.IMAGING_TERMS)}) / 4.0 AS score FROM c) WHERE score > 0),
x AS (SELECT query_id, item_id, greatest(score, CASE WHEN document_type = 'radiology_report' THEN 0.95 ELSE 0.84 END) AS score, document_type = 'radiology_report' AS prim FROM o JOIN lex ON place <= greatest(12, least(24, hits)) WHERE imaging AND searches > 1),
b AS (SELECT coalesce(g.query_id, x.query_id) AS query_id, coalesce(g.item_id, x.item_id) AS item_id, greatest(g.score, x.score) AS score, g.item_id IS NULL AND x.prim AS prim, coalesce(facets, '') AS facets FROM g FULL JOIN x ON g.query_id = x.query_id AND g.item_id = x.item_id),
w AS (SELECT b.*, c.chunk_id, c.doc_id, CASE WHEN document_type = 'radiology_report' THEN 'r:' || author WHEN doc_id IS NOT NULL AND trim(text) <> '' THEN doc_id || ':' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ELSE '-' || chunk_id END AS fp FROM b JOIN c USING (item_id)),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, fp ORDER BY score DESC, chunk_id) AS dup FROM w) WHERE dup = 1),
a AS (SELECT *, doc_id IS NOT NULL AND row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) = 1 AS lead FROM d),
r AS (SELECT a.*, o.rerank, row_number() OVER (PARTITION BY a.query_id ORDER BY lead DESC, score DESC, chunk_id) AS rank FROM a JOIN o ON o.query_id = a.query_id QUALIFY rank <= o.hits),
z AS (SELECT *, CASE WHEN NOT rerank THEN score ELSE greatest(CASE WHEN item_id % 2 = 0 AND item_id % 41 > 20 THEN 1 / (1 + exp(-((item_id % 41) / 10 - 2))) ELSE score END, CASE WHEN prim THEN 0.99 ELSE 0 END) END AS final FROM r),
y AS (SELECT query_id, CASE WHEN rerank THEN row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) ELSE rank END AS rank, chunk_id, round(final, 6) AS score, prim AS primary_evidence, facets FROM z
  UNION ALL SELECT query_id, rank, 'c' || item_id, score, false, '0' FROM h WHERE searches = 1)
SELECT y.query_id, o.mode, y.rank::integer AS rank, y.chunk_id, y.score, y.primary_evidence, y.facets FROM y JOIN o ON o.query_id = y.query_id"""


@query("RET13_answer_set_by_score", _ANSWER_SQL)
def answer_set_by_score(spark, sf_dir):
    """All modes in one plan, without the choice of different hits."""
    return _answer_set(spark, sf_dir, mmr=False)


@query("RET13_full_answer_set")
def full_answer_set(spark, sf_dir):
    return _answer_set(spark, sf_dir, mmr=True)


@query("GEN10_subqueries", "WITH m AS (SELECT * FROM (VALUES ('judge_analysis', 9, 16), ('expert_analysis', 9, 16), ('causation', 8, 16), ('free_qa', 3, 8), ('timeline', 1, 50)) t(mode, searches, k)) SELECT item_id AS query_id, m.mode, f::integer AS facet_no, k::integer AS k, f > 0 AS focused FROM (SELECT item_id, ['judge_analysis', 'expert_analysis', 'causation', 'free_qa', 'timeline', 'general_knowledge', NULL][item_id % 7 + 1] AS said FROM benchmark) b JOIN m ON m.mode = coalesce(said, 'free_qa'), range(0, 9) t(f) WHERE f < searches")
def mode_subqueries(spark, sf_dir):
    """Every benchmark item as a question: its searches by mode."""
    said = F.get(F.array(*[F.lit(m) for m in ("judge_analysis", "expert_analysis", "causation", "free_qa", "timeline", "general_knowledge", None)]), (F.col("item_id") % 7).cast("int"))
    asked = A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), said.alias("mode"), "text", F.lit(10).alias("top_k"))
    return answerset.subqueries(asked).select("query_id", "mode", "facet_no", "k", F.col("subquery").contains(P.FACET_LEAD).alias("focused"))


@query("WIN8_context_budget", "WITH t AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, cast(o_orderkey % 50 AS integer) AS tokens FROM orders), u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM t) SELECT query_id, rank, used FROM u WHERE used <= 60 OR rank = 1")
def context_budget(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), rank.alias("rank"), F.repeat(F.lit("abcd"), (F.col("o_orderkey") % 50).cast("int")).alias("text"))
    return retrieval.context_budget(rows, 60).select("query_id", "rank", "used")


@query("RET14_assemble_context", "WITH b AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) SELECT c_custkey AS query_id, coalesce(string_agg('[Source ' || n || ']' || chr(10) || o_orderstatus, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n), 'No relevant documents found.') AS context FROM customer LEFT JOIN b ON o_custkey = c_custkey GROUP BY 1")
def assemble_context(spark, sf_dir):
    none, no = F.lit(None).cast("string"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), no.alias("source_no"), "o_orderstatus")
    blocks = rows.withColumn("block", T.context_block(F.col("source_no"), none, none, none, none, none, F.col("o_orderstatus")))
    return retrieval.assemble_context(A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id")), blocks)


@query("WIN10_per_query_rank", "SELECT l_orderkey AS query_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS source_no FROM lineitem")
def per_query_rank(spark, sf_dir):
    w = W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_linenumber")
    return A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), "l_partkey", F.row_number().over(w).alias("source_no"))


# ---- reconciliation


def _sides(spark, sf_dir):
    r = A.registry(spark, sf_dir)
    return r["documents"], r["chunks"], A.points(spark, sf_dir)


@query("REC1_chunks_without_point", f"WITH {_REGISTRY} SELECT run_id, chunk_id FROM chunks c WHERE point_id IS NULL OR NOT EXISTS (SELECT 1 FROM points p WHERE p.point_id = c.point_id)")
def rec1(spark, sf_dir):
    _, c, p = _sides(spark, sf_dir)
    return reconcile.chunks_without_point(c, p)


@query("REC2_points_without_chunk", f"WITH {_REGISTRY} SELECT run_id, point_id FROM points p WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE p.chunk_id = c.chunk_id)")
def rec2(spark, sf_dir):
    _, c, p = _sides(spark, sf_dir)
    return reconcile.points_without_chunk(c, p)


@query("REC3_duplicate_point_refs", f"WITH {_REGISTRY}, d AS (SELECT point_id, count(*) AS chunks FROM chunks WHERE point_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT DISTINCT c.run_id, d.point_id, d.chunks FROM chunks c JOIN d ON c.point_id = d.point_id")
def rec3(spark, sf_dir):
    return reconcile.duplicate_point_refs(_sides(spark, sf_dir)[1])


_POINT_ID = "substr(sha256({0}), 1, 8) || '-' || substr(sha256({0}), 9, 4) || '-' || substr(sha256({0}), 13, 4) || '-' || substr(sha256({0}), 17, 4) || '-' || substr(sha256({0}), 21, 12)"


@query("REC4_nondeterministic_ids", f"WITH {_REGISTRY} SELECT run_id, chunk_id, 'registry' AS side FROM chunks WHERE point_id <> {_POINT_ID.format('chunk_id')} UNION ALL SELECT run_id, chunk_id, 'points' FROM points WHERE point_id <> {_POINT_ID.format('chunk_id')}")
def rec4(spark, sf_dir):
    _, c, p = _sides(spark, sf_dir)
    return reconcile.nondeterministic_ids(c, p)


@query("REC5_duplicate_points", f"WITH {_REGISTRY} SELECT run_id, chunk_id, count(*) AS points FROM points GROUP BY 1, 2 HAVING count(*) > 1")
def rec5(spark, sf_dir):
    return reconcile.duplicate_points(_sides(spark, sf_dir)[2])


@query("REC6_payload_mismatch", f"WITH {_REGISTRY} SELECT p.run_id, p.chunk_id, p.point_id FROM points p JOIN chunks c ON p.chunk_id = c.chunk_id WHERE p.point_id IS DISTINCT FROM c.point_id OR p.doc_id IS DISTINCT FROM c.doc_id OR p.run_id IS DISTINCT FROM c.run_id")
def rec6(spark, sf_dir):
    _, c, p = _sides(spark, sf_dir)
    return reconcile.payload_mismatch(c, p)


@query("REC7_incomplete_documents", f"WITH {_REGISTRY}, s AS (SELECT c.doc_id, count_if(p.chunk_id IS NULL OR p.chunk_id <> c.chunk_id OR p.run_id <> c.run_id) AS bad FROM chunks c LEFT JOIN points p ON c.point_id = p.point_id GROUP BY 1) SELECT d.run_id, d.doc_id, cast(coalesce(bad, 0) AS bigint) AS bad_chunks FROM docs d LEFT JOIN s ON d.doc_id = s.doc_id WHERE status = 'indexed' AND (bad IS NULL OR bad > 0)")
def rec7(spark, sf_dir):
    return reconcile.incomplete_documents(*_sides(spark, sf_dir))


@query("REC8_reconcile", f"""WITH {_REGISTRY}, x AS (
SELECT run_id, 'chunks_without_point' AS category FROM chunks c WHERE point_id IS NULL OR NOT EXISTS (SELECT 1 FROM points p WHERE p.point_id = c.point_id)
UNION ALL SELECT run_id, 'points_without_chunk' FROM points p WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE p.chunk_id = c.chunk_id)
UNION ALL SELECT run_id, 'duplicates' FROM (SELECT DISTINCT run_id, point_id FROM chunks WHERE point_id IN (SELECT point_id FROM chunks WHERE point_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT run_id, 'duplicates' FROM (SELECT run_id, chunk_id FROM points GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT run_id, 'nondeterministic_ids' FROM chunks WHERE point_id <> {_POINT_ID.format('chunk_id')} UNION ALL SELECT run_id, 'nondeterministic_ids' FROM points WHERE point_id <> {_POINT_ID.format('chunk_id')}
UNION ALL SELECT p.run_id, 'payload_mismatch' FROM points p JOIN chunks c ON p.chunk_id = c.chunk_id WHERE p.point_id IS DISTINCT FROM c.point_id OR p.doc_id IS DISTINCT FROM c.doc_id OR p.run_id IS DISTINCT FROM c.run_id
UNION ALL SELECT d.run_id, 'incomplete_documents' FROM docs d LEFT JOIN (SELECT c.doc_id, count_if(p.chunk_id IS NULL OR p.chunk_id <> c.chunk_id OR p.run_id <> c.run_id) AS bad FROM chunks c LEFT JOIN points p ON c.point_id = p.point_id GROUP BY 1) s ON d.doc_id = s.doc_id WHERE status = 'indexed' AND (bad IS NULL OR bad > 0)),
runs AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, CASE WHEN a.run_id IS NULL THEN 'points-only' ELSE 'registered' END AS status FROM (SELECT DISTINCT run_id FROM docs) a FULL JOIN (SELECT DISTINCT run_id FROM points) b ON a.run_id = b.run_id)
SELECT r.run_id, r.status, k.category, count(x.category) AS issues FROM runs r CROSS JOIN (SELECT unnest([{', '.join(repr(c) for c in reconcile.CATEGORIES)}]) AS category) k LEFT JOIN x ON x.run_id = r.run_id AND x.category = k.category GROUP BY 1, 2, 3""")
def rec8(spark, sf_dir):
    return reconcile.reconcile(*_sides(spark, sf_dir))


# ---- case file


_NAMES = f"""names AS (SELECT run_id, string_agg(patient, ';' ORDER BY n) AS names FROM (SELECT run_id, patient, row_number() OVER (PARTITION BY run_id ORDER BY length(patient) DESC, patient) AS n
  FROM (SELECT DISTINCT run_id, patient FROM r WHERE NOT regexp_matches(lower(patient), '{P.IGNORED_NAMES}'))) WHERE n <= 2 GROUP BY 1)"""
_INJURIES = """phrases AS (SELECT run_id, chunk_id, no, CASE no WHEN 0 THEN 'Priority ' ELSE 'Injury of priority ' END || lower(priority) AS phrase FROM r, (SELECT unnest([0, 1]) AS no)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY run_id, phrase ORDER BY chunk_id, no) AS k FROM phrases),
injuries AS (SELECT run_id, string_agg(phrase, ';' ORDER BY n) AS injuries FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY chunk_id, no) AS n FROM firsts WHERE k = 1) WHERE n <= 4 GROUP BY 1)"""


@query("AGG8_case_metadata", f"""WITH {RECORDS}, {_NAMES}, {_INJURIES}
SELECT run_id, coalesce(names, '') AS names, '01/02/1970' AS dob, '' AS dob_unparsed, injuries FROM (SELECT DISTINCT run_id FROM r) LEFT JOIN names USING (run_id) LEFT JOIN injuries USING (run_id)""")
def case_metadata(spark, sf_dir):
    found = casefile.case_metadata(_letters(spark, sf_dir), "chunk_id")
    return found.select("run_id", "dob", *[F.array_join(c, ";").alias(c) for c in ("names", "dob_unparsed", "injuries")])


@query("CASE1_client_names", f"WITH {RECORDS}, {_NAMES} SELECT run_id, coalesce(names, '') AS names FROM (SELECT DISTINCT run_id FROM r) LEFT JOIN names USING (run_id)")
def client_names(spark, sf_dir):
    return casefile.case_metadata(_letters(spark, sf_dir)).select("run_id", F.array_join("names", ";").alias("names"))


@query("CASE1_names_from_text", f"WITH {RECORDS}, {_NAMES}, t AS (SELECT run_id, arg_min(patient, (chunk_id)) AS first FROM r WHERE nation % 2 = 1 AND NOT regexp_matches(lower(patient), '{P.IGNORED_NAMES}') GROUP BY 1) SELECT a.run_id, CASE WHEN a.nation % 2 = 0 THEN coalesce(names, '') ELSE coalesce(first || ' Dob', '') END AS names FROM (SELECT DISTINCT run_id, nation FROM r) a LEFT JOIN names USING (run_id) LEFT JOIN t ON t.run_id = a.run_id")
def names_from_text(spark, sf_dir):
    """Half of the cases have no name column: the first letter that names its patient decides. The form takes up to four words that begin with a capital, so the mark of the birth date comes along."""
    chunks = _letters(spark, sf_dir).join(A.records(spark, sf_dir).select("chunk_id", "nation"), "chunk_id")
    chunks = chunks.withColumn("patient_name", F.when(F.col("nation") % 2 == 0, F.col("patient_name")))
    return chunks.select("run_id").distinct().join(casefile.case_names(chunks, "chunk_id"), "run_id", "left").select("run_id", F.coalesce(F.array_join("names", ";"), F.lit("")).alias("names"))


@query("AGG16_dashboard_rows", f"WITH {RECORDS}, {_NAMES}, {_INJURIES}, s AS (SELECT run_id, any_value(nation) AS nation, count(DISTINCT doc_id) AS documents_count, count(*) AS chunks_count, count(DISTINCT doctor) AS authors_count, min(order_date) AS earliest_date, max(order_date) AS latest_date FROM r GROUP BY 1) SELECT s.run_id, 'nation' || nation AS run_name, CASE WHEN nation % 4 = 3 THEN '{P.UNKNOWN_CLIENT}' ELSE coalesce(replace(names, ';', ', '), '{P.UNKNOWN_CLIENT}') END AS client_name, CASE WHEN nation % 4 = 3 THEN '{P.NO_DOB}' ELSE '01/02/1970' END AS dob, CASE WHEN nation % 4 = 3 THEN '' ELSE injuries END AS injuries, documents_count, chunks_count, authors_count, strftime(earliest_date, '%Y-%m-%d') AS earliest_date, strftime(latest_date, '%Y-%m-%d') AS latest_date FROM s LEFT JOIN names USING (run_id) LEFT JOIN injuries USING (run_id)")
def dashboard_rows(spark, sf_dir):
    """All cases; those of some nations have no metadata yet."""
    letters = _letters(spark, sf_dir)
    runs = letters.groupBy("run_id", "run_dir").agg(F.countDistinct("doc_id").alias("total_documents"), F.count("*").alias("total_chunks"), F.countDistinct("author").alias("unique_authors"), F.min("date_extracted").alias("earliest_date"), F.max("date_extracted").alias("latest_date"))
    known = letters.where(F.regexp_extract("run_dir", "([0-9]+)$", 1).cast("int") % 4 != 3)
    rows = casefile.case_dashboard(runs, casefile.case_metadata(known, "chunk_id"))
    return rows.select("run_id", "run_name", "client_name", "dob", F.array_join("injuries", ";").alias("injuries"), "documents_count", "chunks_count", "authors_count", F.col("earliest_date").cast("string").alias("earliest_date"), F.col("latest_date").cast("string").alias("latest_date"))


@query("CASE2_dob", f"WITH {RECORDS} SELECT DISTINCT run_id, '01/02/1970' AS dob FROM r")
def dob(spark, sf_dir):
    return casefile.case_metadata(_letters(spark, sf_dir)).select("run_id", "dob")


@query("CASE3_injuries", f"WITH {RECORDS}, {_INJURIES} SELECT * FROM injuries")
def injuries(spark, sf_dir):
    return casefile.case_injuries(_letters(spark, sf_dir)).select("run_id", F.array_join("injuries", ";").alias("injuries"))


@query("CASE4_case_timeline", f"""WITH {RECORDS} SELECT run_id, doc_id, iso AS date_iso, doctor AS physician, 'Claim No: C' || record_id AS ref_no, clinic, 'Page ' || (record_id % 5 + 1) AS page_range, 'parsed' AS date_status FROM r""")
def case_timeline(spark, sf_dir):
    page = (F.col("record_id") % 5 + 1).cast("int")
    c = _letters(spark, sf_dir).withColumns({"date_raw": F.lit(None).cast("string"), "document_type": F.lit("specialist_letter"), "page_start": page, "page_end": page, "source_char_start": F.lit(0), "source_char_end": F.length("text"), "provenance_type": F.lit("original_pdf")})
    return casefile.case_timeline(c).select("run_id", "doc_id", "date_iso", "physician", "ref_no", "clinic", "page_range", "date_status")


@query("AGG7_timeline_groups", "SELECT l_suppkey % 10 AS supp, cast(l_shipdate AS date)::varchar AS date_iso, min(l_linenumber) AS page_start, CASE WHEN count(CASE WHEN l_quantity > 3 THEN 1 END) = count(*) THEN max(l_linenumber) END AS page_end, count(*) AS n FROM lineitem GROUP BY 1, 2")
def timeline_groups(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.lit("r").alias("run_id"), (F.col("l_suppkey") % 10).alias("doc_id"), F.monotonically_increasing_id().alias("ord"), F.col("l_shipdate").cast("date").cast("string").alias("date_raw"), F.col("l_shipdate").cast("date").cast("string").alias("date_iso"),
        *[F.lit(None).cast("string").alias(c) for c in ("physician", "document_type", "ref_no", "clinic", "summary")], F.col("l_linenumber").alias("page_start"), F.when(F.col("l_quantity") > 3, F.col("l_linenumber")).alias("page_end"), F.lit(1).alias("char_start"), F.lit(1).alias("char_end"), F.lit("original_pdf").alias("provenance_type"),
    )
    counts = li.groupBy((F.col("l_suppkey") % 10).alias("supp"), F.col("l_shipdate").cast("date").cast("string").alias("date_iso")).agg(F.count("*").alias("n"))
    return casefile.timeline_groups(rows).select(F.col("doc_id").alias("supp"), "date_iso", "page_start", "page_end").join(counts, ["supp", "date_iso"])


# ---- chronology


@query("WIN2_exact_dup_drop", "SELECT doc_id, min(chunk_index) AS chunk_index FROM (SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, l_returnflag || ' ' || l_linestatus AS t FROM lineitem) GROUP BY doc_id, t")
def exact_dup_drop(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), F.concat(F.col("l_returnflag"), F.repeat(F.lit(" "), F.col("l_linenumber")), F.col("l_linestatus")).alias("text"), F.lit("c").alias("chunk_id"))
    return chronology.drop_exact_repeats(li).select("doc_id", "chunk_index")


@query("WIN3_overlap_trim", "WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, l_linenumber * 80 AS s, l_linenumber * 80 + 100 AS e, lag(l_linenumber * 80 + 100) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pe FROM lineitem) SELECT doc_id, chunk_index, CASE WHEN pe > s AND pe - s < 100 THEN pe ELSE s END AS char_start, CASE WHEN pe > s AND pe - s < 100 THEN 100 - (pe - s) ELSE 100 END AS n FROM t")
def overlap_trim(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), F.lit("c").alias("chunk_id"), (F.col("l_linenumber") * 80).alias("char_start"), (F.col("l_linenumber") * 80 + 100).alias("char_end"), F.repeat(F.lit("x"), F.lit(100)).alias("text"))
    return chronology.trim_overlaps(li).select("doc_id", "chunk_index", "char_start", F.length("text").alias("n"))


@query("WIN4_greedy_batches", f"WITH {RECORDS} SELECT run_id, chunk_id, cast((row_number() OVER (PARTITION BY run_id ORDER BY original_filename, doc_id, record_id, chunk_id) - 1) // {P.FAST_BATCH_CHUNKS} AS integer) AS batch_no FROM r")
def greedy_batches(spark, sf_dir):
    return chronology.greedy_batches(_letters(spark, sf_dir), P.FAST_BATCH_CHARS, P.FAST_BATCH_CHUNKS)


@query("WIN4_batches_by_characters", f"""WITH RECURSIVE {RECORDS}, o AS (SELECT run_id, chunk_id, length(text) + {P.BATCH_OVERHEAD} AS size, row_number() OVER (PARTITION BY run_id ORDER BY original_filename, doc_id, record_id, chunk_id) AS n FROM letters),
w AS (SELECT run_id, n, size AS held, 1 AS rows, 0 AS batch_no FROM o WHERE n = 1 UNION ALL
  SELECT w.run_id, o.n, CASE WHEN held + size > {P.FAST_BATCH_CHARS} OR rows >= 13 THEN size ELSE held + size END, CASE WHEN held + size > {P.FAST_BATCH_CHARS} OR rows >= 13 THEN 1 ELSE rows + 1 END, batch_no + CASE WHEN held + size > {P.FAST_BATCH_CHARS} OR rows >= 13 THEN 1 ELSE 0 END FROM w JOIN o ON o.run_id = w.run_id AND o.n = w.n + 1)
SELECT run_id, chunk_id, batch_no FROM w JOIN o USING (run_id, n)""")
def batches_by_characters(spark, sf_dir):
    """A batch ends by its characters, or with 13 letters, whichever comes first."""
    letters = _letters(spark, sf_dir)
    return chronology.greedy_batches(letters, P.FAST_BATCH_CHARS, 13)


@query("GEN4_segment_encounters", f"WITH {RECORDS} SELECT chunk_id || ':unit:' || u AS chunk_id, CASE u WHEN 0 THEN 0 ELSE 60 END AS source_char_start FROM r, (SELECT unnest([0, 1]) AS u)")
def segment_encounters(spark, sf_dir):
    """Two visit headers in every letter: two units."""
    one = lambda: F.concat(F.lit("Surgery recorded by: "), F.col("doctor"), F.lit(" Visit date: "), F.date_format("order_date", "dd/MM/yyyy"), F.lit("\n\n"))
    pad = F.rpad(one(), 60, "\n")
    rows = A.records(spark, sf_dir).select("chunk_id", F.concat(pad, one()).alias("text"), F.lit(0).alias("source_char_start"), F.lit(120).alias("source_char_end"))
    return chronology.segment_units(rows).select("chunk_id", "source_char_start")


@query("GEN5_dated_mentions", f"WITH {RECORDS} SELECT run_id, chunk_id, iso AS event_date, raw AS date_original, 'Dated record event' AS event_type, doctor AS provider, raw || '.' AS source_quote FROM r")
def dated_mentions(spark, sf_dir):
    return chronology.dated_mentions(_letters(spark, sf_dir)).select("run_id", "chunk_id", "event_date", "date_original", "event_type", "provider", "source_quote")


@query("AGG9_merge_events", f"WITH {RECORDS} SELECT run_id, iso AS event_date, doctor AS provider, count(*) AS n_sources FROM r GROUP BY 1, 2, 3")
def merge_events(spark, sf_dir):
    return chronology.merge_events(chronology.dated_mentions(_letters(spark, sf_dir))).select("run_id", "event_date", "provider", F.size("sources").cast("bigint").alias("n_sources"))


@query("CHR2_rule_chronology", f"WITH {RECORDS} SELECT run_id, iso AS event_date, count(*) AS n_sources FROM r GROUP BY 1, 2")
def rule_chronology(spark, sf_dir):
    c = _letters(spark, sf_dir).withColumns({"source_char_start": F.lit(0), "source_char_end": F.length("text")})
    return chronology.rule_chronology(c).select("run_id", "event_date", F.size("sources").cast("bigint").alias("n_sources"))


@query("CHR11_render", f"""WITH {RECORDS}, e AS (SELECT run_id, iso, raw, doctor, count(*) AS n FROM r GROUP BY ALL)
SELECT run_id, concat_ws(chr(10), '| Date | Event | Provider | Record | Sources |', '|---|---|---|---|---|', string_agg('| ' || raw || ' | Dated record event | ' || doctor || ' | ' || raw || '. | ' || n || ' |', chr(10) ORDER BY iso, lower(doctor))) AS chronology FROM e GROUP BY 1""")
def render(spark, sf_dir):
    return chronology.render(chronology.merge_events(chronology.dated_mentions(_letters(spark, sf_dir))))


_CHRONOLOGY_SQL = f"""WITH {RECORDS},
e AS (SELECT run_id, chunk_id, record_id AS k, nation, CASE WHEN record_id % 7 < 5 THEN iso WHEN record_id % 7 = 5 THEN substr(iso, 1, 7) ELSE '' END AS value, CASE WHEN record_id % 5 = 0 THEN '{P.MISSING}' ELSE doctor END AS provider, CASE record_id % 3 WHEN 0 THEN 'North|South' ELSE '' END AS facility,
  ['fast', 'ultra_fast', 'detailed'][nation % 3 + 1] AS profile, 'letter, author: ' || doctor || ', ' || original_filename || CASE record_id % 3 WHEN 0 THEN ', chars 0–90' WHEN 1 THEN ', p. 1' ELSE ', pp. 1–2' END || '; verification: “' || CASE WHEN record_id % 4 = 3 THEN raw || repeat(' seen', 25) || ' s…' ELSE raw || ' seen' END || '”' AS source FROM r),
s AS (SELECT *, CASE WHEN k % 7 < 5 THEN substr(value, 9, 2) || '/' || substr(value, 6, 2) || '/' || substr(value, 1, 4) WHEN k % 7 = 5 THEN substr(value, 6, 2) || '/' || substr(value, 1, 4) || ' [Date Incomplete]' ELSE 'around then [Date Incomplete]' END AS shown,
  CASE WHEN provider = '{P.MISSING}' THEN provider WHEN profile <> 'detailed' AND k % 2 = 0 THEN 'Recorded by: ' || provider ELSE provider END AS named FROM e),
l AS (SELECT *, '| ' || shown || ' | ' || CASE WHEN facility = '' THEN named WHEN provider = '{P.MISSING}' THEN 'North\\|South' ELSE named || '; North\\|South' END || ' | ' || CASE WHEN profile <> 'detailed' THEN 'Consultation' || CASE k % 4 WHEN 0 THEN '; pain' WHEN 1 THEN '; sprain' ELSE '' END
  ELSE CASE k % 4 WHEN 0 THEN 'pain' ELSE '{P.MISSING}' END || ' | ' || CASE k % 4 WHEN 1 THEN 'sprain' ELSE '{P.MISSING}' END || ' | {P.MISSING}' END || ' | ' || CASE WHEN k % 8 = 0 THEN 'rest<br>ice' ELSE '{P.MISSING}' END || ' | ' || source || ' |' AS line FROM s),
n AS (SELECT run_id, 1 AS part, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN value = '' THEN 9999 ELSE cast(substr(value, 1, 4) AS int) END, CASE WHEN value = '' THEN 12 ELSE cast(substr(value, 6, 2) AS int) END, CASE WHEN value = '' THEN 31 WHEN length(value) < 8 THEN 1 ELSE cast(substr(value, 9, 2) AS int) END, CASE WHEN k % 7 < 5 THEN 0 WHEN k % 7 = 5 THEN 1 ELSE 3 END, lower(provider), chunk_id) AS line_no, line FROM l),
a AS (SELECT run_id, any_value(profile) AS profile, any_value(nation) AS nation, count(*) AS c, count(*) FILTER (k % 6 = 0) AS w FROM e GROUP BY 1),
h AS (SELECT run_id, 0 AS part, list_filter(['{P.CHRONOLOGY_TITLE}' || CASE profile WHEN 'fast' THEN ' — Fast Profile' WHEN 'ultra_fast' THEN ' — Ultra-Fast Profile' ELSE '' END, CASE WHEN nation % 4 = 0 OR nation % 5 = 0 THEN '{P.INCOMPLETE_HEAD}' END, '', CASE WHEN profile = 'ultra_fast' THEN '{P.ULTRA_FAST_NOTE}' END, CASE WHEN profile = 'ultra_fast' THEN '' END,
  CASE WHEN profile = 'detailed' THEN '{P.LONG_COLUMNS}' ELSE '{P.SHORT_COLUMNS}' END, CASE WHEN profile = 'detailed' THEN '|---|---|---|---|---|---|---|' ELSE '|---|---|---|---|---|' END], lambda x: x IS NOT NULL) AS lines FROM a),
t AS (SELECT run_id, 2 AS part, list_filter(['', '### Completeness and data-quality audit', '', '- Chronology profile: **' || CASE profile WHEN 'fast' THEN 'Fast' WHEN 'ultra_fast' THEN 'Ultra_Fast' ELSE 'Detailed' END || '**', '- Documents audited: **' || (10 - CASE WHEN nation % 5 = 0 THEN 1 ELSE 0 END) || '/10**', '- Source chunks successfully processed: **' || c || '/' || c || '**',
  '- Extraction batches processed: **3/4**', '- Valid extraction pages checkpointed: **5**', '- Source chunks completed: **' || c || '/' || c || '**', '- Events extracted before deduplication: **' || (c + 2) || '**', '- Chronology events rendered: **' || c || '**', '- Events rejected for missing/invalid provenance or source quotation: **2**',
  '- Failed extraction batches: **' || CASE WHEN nation % 4 = 0 THEN 1 ELSE 0 END || '**', '- Entries carrying validation warnings: **' || w || '**', CASE WHEN nation % 5 = 0 THEN '' END, CASE WHEN nation % 5 = 0 THEN '{P.MISSED_DOCUMENTS}' END, CASE WHEN nation % 4 = 0 THEN '' END, CASE WHEN nation % 4 = 0 THEN '{P.FAILED_BATCHES}' END, CASE WHEN w > 0 THEN '' END, CASE WHEN w > 0 THEN '{P.WARNED_ENTRIES}' END], lambda x: x IS NOT NULL) AS lines FROM a),
x AS (SELECT run_id, part, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS line FROM (SELECT * FROM h UNION ALL SELECT * FROM t))"""


def _chronology(spark, sf_dir):
    """Every letter as an event with all its fields, and each nation's case with its audit."""
    r, k, n = A.records(spark, sf_dir), F.col("record_id"), F.col("nation")
    iso, raw, none = F.col("order_date").cast("string"), F.date_format("order_date", "dd/MM/yyyy"), F.lit(P.MISSING)
    pages = lambda c: F.when(k % 3 > 0, c).cast("int")
    source = F.struct(F.lit("letter").alias("document_type"), F.col("doctor").alias("author"), "original_filename", pages(F.lit(1)).alias("page_start"), pages(k % 3).alias("page_end"), F.lit(0).alias("source_char_start"), F.lit(90).alias("source_char_end"))
    events = r.select(
        "run_id", "chunk_id", F.when(k % 7 < 5, iso).when(k % 7 == 5, F.substring(iso, 1, 7)).otherwise("").alias("event_date"), F.when(k % 7 < 5, "day").when(k % 7 == 5, "month").otherwise("unknown").alias("date_precision"), F.lit("around then").alias("date_original"),
        F.lit("Consultation").alias("event_type"), F.when(k % 5 == 0, none).otherwise(F.col("doctor")).alias("provider"), F.when(k % 2 == 0, "documenting_provider").otherwise("treating").alias("provider_role"),
        F.when(k % 3 == 0, "North|South").when(k % 3 == 1, P.NOT_GIVEN[1]).otherwise("").alias("facility"), F.when(k % 4 == 0, "pain").otherwise(none).alias("presenting_symptoms"), F.when(k % 4 == 1, "sprain").otherwise(none).alias("diagnosis"), F.lit(None).cast("string").alias("investigations_findings"),
        F.when(k % 8 == 0, "rest\nice").otherwise(none).alias("intervention_plan"), F.concat(raw, F.when(k % 4 == 3, F.repeat(F.lit(" \n seen"), 40)).otherwise("  seen ")).alias("source_quote"), F.array(source).alias("sources"), F.when(k % 6 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    audits = r.groupBy("run_id", "nation").agg(F.count("*").alias("c")).select(
        "run_id", F.get(F.array(F.lit("fast"), F.lit("ultra_fast"), F.lit("detailed")), (n % 3).cast("int")).alias("profile"), F.lit(10).alias("documents_total"), F.when(n % 5 == 0, 9).otherwise(10).alias("documents_audited"), F.col("c").alias("chunks_total"), F.col("c").alias("chunks_completed"), F.lit(4).alias("batches_total"),
        F.lit(3).alias("batches_processed"), F.when(n % 4 == 0, 1).otherwise(0).alias("batches_failed"), F.lit(5).alias("pages_completed"), (F.col("c") + 2).alias("events_extracted"), F.col("c").alias("events_rendered"), F.lit(2).alias("rejected_without_source"),
    )
    return events, audits


@query("CHR11_chronology_lines", f"{_CHRONOLOGY_SQL} SELECT * FROM n UNION ALL SELECT * FROM x")
def chronology_lines(spark, sf_dir):
    return rendering.chronology_lines(*_chronology(spark, sf_dir))


@query("CHR11_chronology_text", f"{_CHRONOLOGY_SQL} SELECT run_id, string_agg(line, chr(10) ORDER BY part, line_no) AS chronology FROM (SELECT * FROM n UNION ALL SELECT * FROM x) GROUP BY 1")
def chronology_text(spark, sf_dir):
    return rendering.render_chronology(*_chronology(spark, sf_dir))


#: Recorded responses rendered from the letters; the order of the kinds decides what is wrong with an event.
_KINDS = ("good", "no_source", "not_quoted", "birth", "absent_date", "misread")


def _responses(spark, sf_dir):
    r = A.records(spark, sf_dir).withColumn("kind", F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("record_id") % len(_KINDS)).cast("int")))
    raw, kind = F.date_format("order_date", "dd/MM/yyyy"), F.col("kind")
    event = F.struct(
        F.when(kind == "misread", F.lit("1960-06-06")).when(kind == "absent_date", F.lit("1950-05-05")).otherwise(F.col("order_date").cast("string")).alias("event_date"), F.lit("day").alias("date_precision"),
        F.when(kind == "absent_date", F.lit("05/05/1950")).otherwise(raw).alias("date_original"), F.when(kind == "birth", "date_of_birth").otherwise("event_date").alias("date_role"), F.lit("Consultation").alias("event_type"),
        F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("Dr "), "doctor")).otherwise(F.lit("Dr Nobody")).alias("provider"), F.lit("").alias("facility"), F.lit("pain was reported").alias("presenting_symptoms"), F.lit("likely influenza").alias("diagnosis"),
        F.when(kind == "not_quoted", F.lit("something never written")).otherwise(F.concat(F.lit("pain was reported on "), raw)).alias("source_quote"), F.array(F.when(kind == "no_source", 9).otherwise(1)).alias("source_ids"),
    )
    text = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(event).alias("events"), F.lit(True).alias("complete"))), F.lit("\n```"))
    sources = r.select(F.col("record_id").alias("batch_id"), F.lit(1).alias("source_no"), "text", F.col("doctor").alias("author"))
    return r.select(F.col("record_id").alias("batch_id"), F.lit(1).alias("page"), text.alias("response")), sources


@query("GEN9_llm_events", f"WITH {RECORDS} SELECT record_id AS batch_id, 0 AS event_no, true AS complete, CASE record_id % 6 WHEN 5 THEN '1960-06-06' WHEN 4 THEN '1950-05-05' ELSE iso END AS event_date FROM r")
def llm_events(spark, sf_dir):
    return chronology.response_events(_responses(spark, sf_dir)[0]).select("batch_id", "event_no", "complete", "event_date")


@query("CHR5_ground_events", f"""WITH {RECORDS} SELECT record_id AS batch_id, CASE record_id % 6 WHEN 1 THEN 'no single valid source' WHEN 2 THEN 'quotation not in the source' WHEN 3 THEN 'date role is no event date' WHEN 4 THEN 'date not in the source' WHEN 5 THEN 'date reads differently in the source' END AS reject_reason,
CASE WHEN record_id % 6 = 1 THEN '' WHEN record_id % 2 = 0 THEN 'Dr ' || doctor ELSE '' END AS provider FROM r""")
def ground_events(spark, sf_dir):
    """CHR5 and CHR6: reasons to reject, and providers that the source doesn't name."""
    responses, sources = _responses(spark, sf_dir)
    return chronology.ground_events(chronology.response_events(responses), sources).select("batch_id", "reject_reason", "provider")


@query("CHR7_ground_fields", f"WITH {RECORDS} SELECT record_id AS batch_id, CASE WHEN record_id % 6 = 1 THEN '' ELSE 'pain was reported' END AS presenting_symptoms, '' AS diagnosis FROM r")
def ground_fields(spark, sf_dir):
    """CHR7 and CHR8: fields that the source doesn't bear out, or that only infer."""
    responses, sources = _responses(spark, sf_dir)
    return chronology.ground_events(chronology.response_events(responses), sources).select("batch_id", "presenting_symptoms", "diagnosis")


@query("CHR8_warnings", f"WITH {RECORDS} SELECT record_id AS batch_id, 'diagnosis only infers' || CASE WHEN record_id % 2 = 1 THEN ',provider not in the source' ELSE '' END || CASE WHEN record_id % 6 = 1 THEN ',presenting_symptoms not in the source' ELSE '' END AS warnings FROM r")
def inference_guard(spark, sf_dir):
    responses, sources = _responses(spark, sf_dir)
    return chronology.ground_events(chronology.response_events(responses), sources).select("batch_id", F.array_join("warnings", ",").alias("warnings"))


@query("CHR9_validate_pages", f"WITH {RECORDS}, k AS (SELECT record_id AS batch_id, record_id % 6 AS kind, unnest([1, 2]) AS page FROM r) SELECT batch_id, page, (page = 1 AND kind IN (0, 2)) OR (page = 2 AND kind = 0) AS accepted FROM k")
def validate_pages(spark, sf_dir):
    """Two pages a letter: good; cut off; second page no later; completeness no boolean; events no list; 13 events."""
    r, sources = A.records(spark, sf_dir), _responses(spark, sf_dir)[1]
    kind = F.col("record_id") % 6
    event = lambda quote: F.concat(F.lit('{"q": "'), F.lit(quote), F.lit('", "src": 1, "t": "note"}'))
    one, two = event("pain was reported"), F.when(kind == 2, event("pain was reported")).otherwise(event("Diagnosis: injury"))
    held = F.when(kind == 4, one).when(kind == 5, F.concat(F.lit("["), F.array_join(F.array_repeat(one, 13), ","), F.lit("]"))).otherwise(F.concat(F.lit("["), one, F.lit("]")))
    said = F.concat(F.when(kind == 1, "Incomplete response ").otherwise(""), F.lit('{"events": '), held, F.lit(', "complete": '), F.when(kind == 3, '"no"').otherwise("false"), F.lit("}"))
    pages = F.array(F.struct(F.lit(1).alias("page"), said.alias("response")), F.struct(F.lit(2).alias("page"), F.concat(F.lit('{"events": ['), two, F.lit('], "complete": true}')).alias("response")))
    rows = r.select(F.col("record_id").alias("batch_id"), F.inline(pages))
    return chronology.validate_pages(rows, sources).select("batch_id", "page", "accepted")


@query("WIN5_page_chain", "WITH t AS (SELECT o_custkey AS batch_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 9 > 0 AS valid FROM orders), u AS (SELECT *, min(valid::int) OVER (PARTITION BY batch_id ORDER BY page) = 1 AS ok FROM t) SELECT batch_id, cast(page AS integer) AS page, ok AND page <= 4 AS accepted FROM u")
def page_chain(spark, sf_dir):
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch_id"), n.alias("page"), (F.col("o_orderkey") % 9 > 0).alias("valid"))
    pages = rows.withColumns({"cursors": F.array(F.col("page") * 10, F.col("page") * 10 + 5), "complete": F.col("page") == 4})
    return chronology.page_chain(pages).select("batch_id", "page", "accepted")


@query("CHR10_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0")
def resume(spark, sf_dir):
    b = A.table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("digest"))
    done = b.where("o_orderkey % 5 = 0").select("digest", F.lit(True).alias("valid")).union(b.where("o_orderkey % 7 = 0").select("digest", F.lit(False)))
    return chronology.resume(b, done).select("o_orderkey")


@query("WIN11_running_progress", "SELECT event_id, least(1000, cast(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS double)) AS progress FROM events")
def running_progress(spark, sf_dir):
    top = F.max("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    return A.table(spark, sf_dir, "events").select("event_id", F.least(F.lit(1000.0), top).alias("progress"))


# ---- answers and sessions


def _answers(spark, sf_dir):
    return A.messages(spark, sf_dir).where("role = 'assistant'").select(F.xxhash64("session_id", "turn").alias("query_id"), "session_id", "turn", F.col("content").alias("answer"), F.lit(2).alias("source_count"))


_ANS = "m AS (SELECT conv_id AS session_id, turn, coalesce(text, '') AS t, turn % 4 AS a, turn + 1 AS b FROM conversations WHERE role = 'assistant')"


@query("ANS4_invalid_citations", f"WITH {_ANS} SELECT session_id, turn, n AS source_no FROM (SELECT DISTINCT session_id, turn, cast(unnest([a, b]) AS integer) AS n FROM m) WHERE n < 1 OR n > 2")
def invalid_citations(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.select("session_id", "turn", F.explode(answers.invalid_sources(F.col("answer"), F.col("source_count"))).alias("source_no"))


@query("ANS5_sanitise_citations", f"""WITH {_ANS} SELECT session_id, turn, t || ' ' || CASE WHEN a BETWEEN 1 AND 2 AND b BETWEEN 1 AND 2 THEN '[Source ' || a || ', ' || b || ']'
 ELSE concat_ws(' ', CASE WHEN a BETWEEN 1 AND 2 THEN '[Source ' || a || ']' WHEN b BETWEEN 1 AND 2 THEN '[Source ' || b || ']' END, '[citation reference unavailable: ' || concat_ws(', ', CASE WHEN NOT a BETWEEN 1 AND 2 THEN a END, CASE WHEN NOT b BETWEEN 1 AND 2 THEN b END) || ']') END AS answer FROM m""")
def sanitise_citations(spark, sf_dir):
    return _answers(spark, sf_dir).select("session_id", "turn", answers.sanitise(F.col("answer"), F.col("source_count")).alias("answer"))


@query("ANS6_resolve_citations", f"WITH {_ANS} SELECT session_id, turn, t || ' (' || CASE WHEN a BETWEEN 1 AND 2 THEN 'Label ' || a ELSE 'Source ' || a END || '; ' || CASE WHEN b BETWEEN 1 AND 2 THEN 'Label ' || b ELSE 'Source ' || b END || ')' AS answer FROM m")
def resolve_citations(spark, sf_dir):
    a = _answers(spark, sf_dir)
    labels = a.select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("source_no")).withColumn("label", F.concat(F.lit("Label "), F.col("source_no").cast("string")))
    got = answers.resolve_citations(a.select("query_id", "answer"), labels)
    return a.select("query_id", "session_id", "turn").join(got, "query_id").drop("query_id")


@query("ANS7_assurance_flags", f"WITH {_ANS} SELECT session_id, turn, true AS verification_missing, NOT (a BETWEEN 1 AND 2 OR b BETWEEN 1 AND 2) AS no_citation, NOT (a BETWEEN 1 AND 2 AND b BETWEEN 1 AND 2) AS invalid_citation FROM m")
def assurance_flags(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return a.select("query_id", "session_id", "turn").join(answers.assurance_flags(a), "query_id").drop("query_id")


@query("ANS1_evidence_ledger", f"WITH {RECORDS} SELECT record_id, 'retrieved record excerpt' AS evidence_status, true AS substantive, false AS date_conflict FROM r WHERE record_id % 2 = 0 UNION ALL SELECT record_id, 'indirect index/reference', true, true FROM r WHERE record_id % 2 = 1")
def evidence_ledger(spark, sf_dir):
    r = A.records(spark, sf_dir)
    odd = F.col("record_id") % 2 == 1
    hits = r.select("record_id", F.when(odd, "document index").otherwise("letter").alias("document_type"), F.concat(F.lit("treatment noted on "), F.date_format("order_date", "dd/MM/yyyy")).alias("text"), F.date_sub("order_date", 1).alias("date_extracted"))
    return answers.evidence_ledger(hits).select("record_id", "evidence_status", "substantive", "date_conflict")


@query("ANS2_classify_question", """WITH q AS (SELECT o_orderkey AS query_id, o_orderkey % 4 AS k, count(l_orderkey) AS n, count(CASE WHEN l_linenumber % 2 = 0 THEN 1 END) AS dated FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT query_id, CASE k WHEN 0 THEN 'chronology' WHEN 1 THEN 'comparison' WHEN 2 THEN 'summary' ELSE 'factual_qa' END AS task, k = 0 AS broad, k = 3 AS multipart, cast(n + 2 * dated + CASE WHEN k = 3 THEN 8 ELSE 0 END AS bigint) AS complexity,
CASE WHEN k = 0 OR n + 2 * dated + CASE WHEN k = 3 THEN 8 ELSE 0 END >= 40 THEN 4096 WHEN k = 3 OR n + 2 * dated >= 20 THEN 2560 ELSE 1536 END AS output_tokens FROM q""")
def classify_question(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    asked = F.when(k == 0, "Give the full timeline").when(k == 1, "Do the reports conflict?").when(k == 2, "Summarise the care").otherwise("a) who? b) when? (c) where?")
    questions = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), asked.alias("question"))
    evidence = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("undated").alias("text"))
    got = answers.classify_questions(questions, evidence)
    return got.select("query_id", "task", "broad", "multipart", F.col("complexity").cast("bigint").alias("complexity"), "output_tokens")


@query("ANS3_inspect_answer", f"WITH {RECORDS} SELECT record_id AS query_id, record_id % 3 = 0 AS truncated, CASE WHEN record_id % 2 = 0 THEN '5' ELSE '' END AS invalid, record_id % 3 = 0 AS false_completeness, record_id % 5 = 0 AS date_error_claim, CASE WHEN record_id % 4 = 0 THEN '1950-05-05' ELSE '' END AS ungrounded FROM r")
def inspect_answer(spark, sf_dir):
    r = A.records(spark, sf_dir)
    k = F.col("record_id")
    says = F.concat_ws(" ", F.lit("A complete answer about"), F.date_format("order_date", "dd/MM/yyyy"), F.lit("[Source 1]"), F.when(k % 2 == 0, "[Source 5]"), F.when(k % 4 == 0, "and 05/05/1950"), F.when(k % 5 == 0, "the dates are probably an OCR error"), F.when(k % 3 == 0, "[limit]"))
    ledger = answers.evidence_ledger(r.select(k.alias("query_id"), F.lit("letter").alias("document_type"), "text", F.col("order_date").alias("date_extracted")))
    got = answers.inspect_answers(r.select(k.alias("query_id"), says.alias("answer"), F.lit(2).alias("source_count")), ledger, "[limit]")
    return got.select("query_id", "truncated", F.array_join(F.col("invalid").cast("array<string>"), ",").alias("invalid"), "false_completeness", "date_error_claim", F.array_join("ungrounded_dates", ",").alias("ungrounded"))


@query("WIN6_last_messages", "SELECT conv_id AS session_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 6")
def last_messages(spark, sf_dir):
    return answers.last_messages(A.messages(spark, sf_dir)).select("session_id", "turn", "role")


@query("WIN7_tail_run_same_mode", "SELECT session_id, turn FROM (SELECT conv_id AS session_id, turn, max(CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS other FROM conversations) WHERE other = 0")
def tail_run(spark, sf_dir):
    return answers.tail_run(A.messages(spark, sf_dir), "free_qa").select("session_id", "turn")


@query("SNK3_transcripts", """SELECT conv_id AS session_id, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY turn, line), '') AS text
FROM (SELECT conv_id, turn, '**' || upper(substr(role, 1, 1)) || substr(role, 2) || ':** ' || coalesce(text, '') || CASE role WHEN 'assistant' THEN ' [Source ' || turn % 4 || ', ' || (turn + 1) || ']' ELSE '' END AS line FROM conversations) GROUP BY 1""")
def transcripts(spark, sf_dir):
    return answers.transcript(A.messages(spark, sf_dir))


_PLAIN = r"regexp_replace(regexp_replace(regexp_replace(c, '(?m)^#{1,6}\s+', '', 'g'), '\*{1,3}([^*]+)\*{1,3}', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"


@query("SNK3_text_transcripts", f"""WITH m AS (SELECT conv_id AS session_id, turn, role, CASE WHEN turn % 2 = 0 THEN '## Heading' || chr(10) ELSE '' END || '**bold** [link](http://x) ' || coalesce(text, '') AS c FROM conversations WHERE role IN ('user', 'assistant')),
b AS (SELECT *, CASE role WHEN 'user' THEN 'USER QUERY:' ELSE 'ANALYSIS RESPONSE:' END || chr(10) || repeat('-', 40) || chr(10) || CASE role WHEN 'user' THEN c ELSE {_PLAIN} || chr(10) || chr(10) || repeat('=', 60) END || chr(10) AS block FROM m)
SELECT session_id, concat_ws(chr(10), 'RAG ANALYSIS EXPORT', repeat('=', 60), 'Messages:  ' || count(*), repeat('=', 60), '', string_agg(block, chr(10) ORDER BY turn, role)) AS text FROM b GROUP BY 1""")
def text_transcripts(spark, sf_dir):
    marked = F.concat(F.when(F.col("turn") % 2 == 0, "## Heading\n").otherwise(""), F.lit("**bold** [link](http://x) "), F.coalesce("text", F.lit("")))
    c = A.table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    return answers.text_transcript(c.select(F.col("conv_id").alias("session_id"), "turn", "role", marked.alias("content")))


@query("GEN7_markdown_table_rows", "SELECT o_orderkey AS session_id, r AS row_no, CASE r WHEN 0 THEN 'Date' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS first, CASE r WHEN 0 THEN 'Event' ELSE 'a | b ' || o_orderstatus END AS second FROM orders, (SELECT unnest([0, 2]) AS r)")
def markdown_table_rows(spark, sf_dir):
    text = F.concat(F.lit("| Date | Event |\n|---|:-:|\n| "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" | a \\| b "), F.col("o_orderstatus"), F.lit(" |\nend"))
    rows = answers.table_rows(A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.lit(0).alias("turn"), text.alias("content")))
    return rows.select("session_id", "row_no", F.get("cells", F.lit(0)).alias("first"), F.get("cells", F.lit(1)).alias("second"))
