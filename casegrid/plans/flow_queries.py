"""Queries of sources, sinks, streams, and of joins, sets, sorts and mutations not covered elsewhere."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from casegrid.functions import textcols as T
from casegrid.operators import answers, chronology, registry, retrieval, similarity
from casegrid.plans import adapters as A
from casegrid.plans.case_queries import _REGISTRY, _responses
from casegrid.plans.catalog import query
from casegrid.plans.text_queries import RECORDS
from casegrid.sources import io, tables, versions
from casegrid.streaming import progress, streams
from casegrid.workspace import materialize, shared_dir


def _folder(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/casegrid-{uuid.uuid4().hex[:12]}-{tag}"


# ---- round trips through files


@query("SRC2_scan_ocr_results", "SELECT doc_id || '.pdf' AS original_filename, cast((length(text) + 999) // 1000 AS integer) AS pages FROM documents")
def scan_ocr_results(spark, sf_dir):
    docs = A.case_documents(spark, sf_dir)
    pages = F.transform("page_ranges", lambda r: F.array(r["start"], r["end"], r["page"]))
    lines = docs.select(F.to_json(F.struct(F.struct(F.concat(F.lit("in/"), F.col("source_doc").cast("string"), F.lit(".pdf")).alias("Source-File")).alias("metadata"), F.struct(pages.alias("pdf_page_numbers")).alias("attributes"))).alias("value"))
    path = _folder(spark, "ocr")
    lines.write.text(path)
    return io.scan_ocr_results(spark, path).select("original_filename", F.size("page_ranges").alias("pages"))


@query("SNK2_write_timeline_csv", f"WITH {RECORDS} SELECT record_id, iso, 'attended; \"' || patient || '\", ' || doctor AS event FROM r")
def timeline_csv(spark, sf_dir):
    path = _folder(spark, "csv")
    io.write_timeline_csv(A.records(spark, sf_dir).select("record_id", F.col("order_date").cast("string").alias("iso"), F.concat(F.lit('attended; "'), "patient", F.lit('", '), "doctor").alias("event")), path)
    return spark.read.schema("record_id bigint, iso string, event string").csv(path, header=True, escape='"')


@query("SNK5_audit_log", "SELECT event_type AS action, count(*) AS n, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first FROM events GROUP BY 1")
def audit_log(spark, sf_dir):
    path = _folder(spark, "audit")
    e = A.table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("action"), F.lit("ok").alias("outcome"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("details"))
    io.append_audit(e, path)
    return io.read_audit(spark, path).groupBy("action").agg(F.count("*").alias("n"), F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("first"))


@query("SNK4_write_report", f"WITH {_REGISTRY} SELECT run_id, count(*) AS points FROM points GROUP BY 1")
def report_json(spark, sf_dir):
    path = _folder(spark, "report")
    io.write_report_json(A.points(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("points")), path)
    return spark.read.schema("run_id string, points bigint").json(path)


@query("SRC8_validate_uploads", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'bad name' WHEN page_id % 4 = 1 THEN 'wrong extension' WHEN page_id % 4 = 2 THEN 'control characters' END AS problem FROM pages")
def validate_uploads(spark, sf_dir):
    k = F.col("page_id") % 4
    name = F.when(k == 0, "a/b.md").when(k == 1, "a.txt").otherwise("a.MD")
    body = F.concat(F.regexp_replace(F.col("html"), r"[\x00-\x08\x0B\x0E-\x1F\x7F]", ""), F.when(k == 2, F.lit("\u0007")).otherwise(F.lit("")))
    return A.table(spark, sf_dir, "pages").select("page_id", io.upload_problem(name, body.cast("binary")).alias("problem"))


@query("SRC7_folder_sizes", "SELECT source AS folder, sum(strlen(text)) AS bytes FROM documents GROUP BY 1")
def folder_sizes(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    by = d.groupBy(F.col("source").alias("folder")).agg(F.sum(F.octet_length("text")).alias("bytes"))
    return by.withColumn("size", io.human_size(F.col("bytes"))).where("size is not null").drop("size")


@query("SRC4_scan_points", f"WITH {_REGISTRY} SELECT vec_id, CASE WHEN run_id = 'run-lost' THEN '<missing-run-id>' ELSE run_id END AS run_id FROM points")
def scan_points(spark, sf_dir):
    return A.points(spark, sf_dir).select("vec_id", F.coalesce(F.when(F.col("run_id") != "run-lost", F.col("run_id")), F.lit("<missing-run-id>")).alias("run_id"))


@query("SRC4_point_pages", f"WITH {_REGISTRY} SELECT CASE WHEN run_id = 'run-lost' THEN '<missing-run-id>' ELSE run_id END AS run, count(*) AS n, min(point_id) AS first, (count(*) + 99) // 100 AS pages FROM points GROUP BY 1")
def point_pages(spark, sf_dir):
    """All points written in pages of a hundred and scanned again; a page is a file."""
    path = _folder(spark, "points")
    io.write_points(A.points(spark, sf_dir).withColumn("run_id", F.when(F.col("run_id") != "run-lost", F.col("run_id"))).select("point_id", "run_id", "chunk_id"), path, 100)
    held = io.scan_points(spark, path, "point_id string, run_id string, chunk_id string").withColumn("file", F.input_file_name())
    return held.groupBy("run").agg(F.count("*").alias("n"), F.min("point_id").alias("first"), F.countDistinct("file").alias("pages"))


def _case_files(spark, sf_dir, tag):
    """The documents' texts as files of at most a hundred documents, in a folder a source."""
    path = _folder(spark, tag)
    A.table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "text").repartition("source").sortWithinPartitions("source").write.partitionBy("source").option("maxRecordsPerFile", 100).text(path)
    return path


@query("SRC6_object_inventory", "WITH d AS (SELECT source, count(*) AS n, sum(strlen(coalesce(text, '')) + 1) AS bytes FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT 'source=' || source AS bucket, (n + 99) // 100 AS objects, bytes::bigint AS bytes FROM d UNION ALL SELECT 'source=missing', 0, 0")
def object_inventory(spark, sf_dir):
    path = _case_files(spark, sf_dir, "objects")
    names = [r["source"] for r in A.table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source").distinct().collect()]  # the buckets that one asks for
    return io.object_inventory(spark, path, [f"source={n}" for n in [*names, "missing"]])


@query("SRC7_folders_of_files", "SELECT 'source=' || source AS folder, sum(strlen(coalesce(text, '')) + 1)::bigint AS bytes, CASE WHEN sum(strlen(coalesce(text, '')) + 1) < 1024 THEN sum(strlen(coalesce(text, '')) + 1) || ' B' WHEN sum(strlen(coalesce(text, '')) + 1) < 1048576 THEN printf('%.2f KB', sum(strlen(coalesce(text, '')) + 1) / 1024.0) ELSE printf('%.2f MB', sum(strlen(coalesce(text, '')) + 1) / 1048576.0) END AS size FROM documents WHERE source IS NOT NULL GROUP BY source")
def folders_of_files(spark, sf_dir):
    sizes = io.folder_sizes(spark, _case_files(spark, sf_dir, "folders"))
    return sizes.select(F.element_at(F.split("folder", "/"), -1).alias("folder"), "bytes", "size")


@query("SRC5_list_runs", "SELECT source AS case_name, count(*) AS files, min(doc_id) % 5 <> 4 AS indexed FROM documents WHERE source IS NOT NULL GROUP BY 1")
def list_runs(spark, sf_dir):
    return A.runs(spark, sf_dir).orderBy(F.desc("run_dir")).select(T.case_name(F.col("run_dir")).alias("case_name"), F.col("total_documents").alias("files"), (F.col("status") == "indexed").alias("indexed"))


# ---- streams


@query("STR1_incremental_ingest", f"""WITH {RECORDS}, t AS (SELECT record_id || '.md' AS original_filename, text || CASE WHEN cust % 3 = 0 THEN ' (second)' WHEN nation % 2 = 0 THEN ' (amended)' ELSE '' END AS text FROM letters)
SELECT original_filename, 1::bigint AS chunks, text, count(*) OVER () AS total_documents, count(*) OVER () AS total_chunks, 3::bigint AS versions FROM t""")
def incremental_ingest(spark, sf_dir):
    """A folder stream in three batches: all letters; those of some nations again, each name twice; then those of some customers."""
    base = _folder(spark, "ingest")
    letters = A.records(spark, sf_dir).withColumn("original_filename", F.concat(F.col("record_id").cast("string"), F.lit(".md")))
    files = lambda rows, path, more: rows.select("original_filename", F.concat(F.lit(path), "original_filename").alias("path"), F.concat("text", F.lit(more)).alias("text"))
    some = letters.where("nation % 2 = 0")
    for part in (files(letters, "/1/", ""), files(some, "/2/", " (amended)").unionByName(files(some, "/3/", " (left out)")), files(letters.where("cust % 3 = 0"), "/4/", " (second)")):
        part.write.mode("append").parquet(f"{base}/in")
        arriving = spark.readStream.schema("original_filename string, path string, text string").parquet(f"{base}/in")
        streams.incremental_ingest(arriving, f"{base}/out", "/ws/letters", f"{base}/checkpoint").awaitTermination()
    at = versions.snapshot(spark, f"{base}/out")
    held = versions.read(spark, f"{base}/out", "chunks", at=at).groupBy("original_filename").agg(F.count("*").alias("chunks"), F.min_by("text", "chunk_index").alias("text"))
    total = versions.read(spark, f"{base}/out", "runs", at=at).select("total_documents", "total_chunks")
    return held.join(F.broadcast(total.limit(1))).withColumn("versions", F.lit(at.number).cast("bigint"))


@query("MUT9_commit_log", "SELECT o_orderstatus AS status, sum(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END)::bigint AS first, count(*) AS second, sum(CASE WHEN o_custkey % 5 = 0 THEN 2 ELSE 1 END)::bigint AS third FROM orders GROUP BY 1")
def commit_log(spark, sf_dir):
    """Three commits of one bucketed table: half of the orders, the others, then the orders of some customers replaced; each version stays readable."""
    root = _folder(spark, "log")
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("n"))
    for part in (o.where("o_orderkey % 2 <> 0"), o.where("o_orderkey % 2 = 0"), o.where("o_custkey % 5 = 0").withColumn("n", F.lit(2))):
        versions.commit(spark, root, lambda held, part=part: versions.replace_keys(spark, root, held, "orders", part, part, key="o_orderkey", buckets=16))
    read = lambda number, name: versions.read(spark, root, "orders", at=number).select("status", F.lit(name).alias("at"), "n")
    every = read(1, "first").unionByName(read(2, "second")).unionByName(read(3, "third"))
    return every.groupBy("status").agg(*[F.coalesce(F.sum(F.when(F.col("at") == c, F.col("n"))), F.lit(0)).cast("bigint").alias(c) for c in ("first", "second", "third")])


@query("STR3_audit_stream", "SELECT date_trunc('day', ts) AS window_start, event_type AS action, count(*) AS n, round(avg(value), 6) AS latency FROM events GROUP BY 1, 2")
def audit_stream(spark, sf_dir):
    base = _folder(spark, "audit-stream")
    A.table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("action"), F.col("value").alias("latency")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("ts timestamp, action string, latency double").parquet(f"{base}/in")
    streams.run_to_table(streams.audit_windows(stream), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


@query("STR2_ocr_progress", "WITH l AS (SELECT user_id % 8 AS worker, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' ELSE 'failed' END AS state, arg_max(event_id, (ts, event_id)) AS n FROM events GROUP BY 1, 2) SELECT state, cast(sum(n) AS bigint) AS n FROM l GROUP BY 1")
def ocr_progress(spark, sf_dir):
    base = _folder(spark, "ocr-stream")
    state = F.get(F.array(F.lit("pending"), F.lit("completed"), F.lit("failed")), (F.col("event_id") % 3).cast("int"))
    line = F.concat(F.lit("INFO worker "), (F.col("user_id") % 8).cast("string"), F.lit(" "), state, F.lit(": "), F.col("event_id").cast("string"))
    A.table(spark, sf_dir, "events").select("ts", line.alias("line")).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("ts timestamp, line string").parquet(f"{base}/in")
    streams.run_to_table(streams.worker_counts(stream), f"{base}/out", f"{base}/checkpoint", streams.total_progress)
    return spark.read.parquet(f"{base}/out")


@query("STR4_index_progress", "SELECT o_custkey AS run, cast(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 ELSE 0 END) AS bigint) AS chunks, max_by(o_orderkey % 70, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey END) AS vectors, max_by(o_orderstatus, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey END) AS stage FROM orders GROUP BY 1")
def index_progress(spark, sf_dir):
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.concat(F.lit("created "), (k % 50).cast("string"), F.lit(" chunks"))).when(k % 3 == 1, F.concat(F.lit("embedded "), (k % 70).cast("string"))).otherwise(F.concat(F.lit("stage: "), "o_orderstatus"))
    return streams.index_progress(A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), k.alias("line_no"), line.alias("line")))


def _arriving(lines: DataFrame, parts: int, base: str, make) -> DataFrame:
    """Feed numbered lines to a progress stream in some parts, each out of order, and return what its table holds then."""
    spark, lines = lines.sparkSession, materialize(lines, "lines")  # numbered once, not once a part
    for k in range(parts):
        lines.where(F.pmod(F.xxhash64("run_id", "line_no"), F.lit(parts)) == k).write.mode("append").parquet(f"{base}/in")
        progress.run_to_versions(make(spark.readStream.schema(lines.schema).parquet(f"{base}/in")), f"{base}/out", "progress", f"{base}/checkpoint")
    return versions.read(spark, f"{base}/out", "progress")


@query("STR2_ocr_stream", """WITH l AS (SELECT user_id % 16 AS run_id, event_id AS e, event_id % 10 AS k, event_id % 5 AS worker, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT run_id, n, worker, (e * 7) % 60 - lag((e * 7) % 60, 1, 0) OVER (PARTITION BY run_id, worker ORDER BY n) AS f, e % 7 - lag(e % 7, 1, 0) OVER (PARTITION BY run_id, worker ORDER BY n) AS b FROM l WHERE k > 1),
s AS (SELECT run_id, worker, sum(f) OVER (PARTITION BY run_id ORDER BY n) AS f, sum(b) OVER (PARTITION BY run_id ORDER BY n) AS b FROM w),
t AS (SELECT run_id, max(f) AS f, max(b) AS b, count(DISTINCT worker) AS workers FROM s GROUP BY 1),
c AS (SELECT run_id, count(*) AS lines, coalesce(max(CASE WHEN k = 0 THEN e % 300 END), 0) AS f, coalesce(max(CASE WHEN k = 1 THEN e % 40 END), 0) AS b FROM l GROUP BY 1)
SELECT run_id, coalesce(workers, 0) AS workers, cast(least(100 + run_id * 20, greatest(coalesce(t.f, 0), c.f)) AS bigint) AS completed_pages, cast(greatest(coalesce(t.b, 0), c.b) AS bigint) AS failed_pages, 100 + run_id * 20 AS total_pages, lines, 0::bigint AS waiting, 0::bigint AS late, 0::bigint AS skipped FROM c LEFT JOIN t USING (run_id)""")
def ocr_stream(spark, sf_dir):
    """Every event as a log line of one of 16 runs, in three parts that each lack lines between."""
    e, run = F.col("event_id"), F.col("user_id") % 16
    row = F.concat_ws(" | ", (e % 5).cast("string"), (e % 7).cast("string"), ((e * 7) % 60).cast("string"), F.lit("0"))
    line = F.when(e % 10 == 0, F.concat(F.lit("Completed pages: "), (e % 300).cast("string"))).when(e % 10 == 1, F.concat(F.lit("failed_pages "), (e % 40).cast("string"), F.lit(".0"))).otherwise(row)
    lines = A.table(spark, sf_dir, "events").select(run.alias("run_id"), F.row_number().over(W.partitionBy(run).orderBy("ts", "event_id")).cast("bigint").alias("line_no"), line.alias("line"), (run * 20 + 100).alias("total"))
    return _arriving(lines, 3, _folder(spark, "ocr-lines"), progress.ocr_progress)


@query("STR2_file_status", "SELECT d.source AS run_id, d.doc_id AS file_no, d.doc_id || '.pdf' AS filename, d.n_chars // 1000 + 1 AS pages, CASE WHEN l.toxic = 1 THEN 'failed' WHEN e.vec_id IS NOT NULL THEN 'completed' ELSE 'pending' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON e.vec_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id WHERE d.source IS NOT NULL")
def file_status(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").where("source IS NOT NULL")
    files = d.select(F.col("source").alias("run_id"), F.col("doc_id").alias("file_no"), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), F.expr("n_chars div 1000 + 1").alias("pages"))
    outputs = A.table(spark, sf_dir, "embeddings").join(d, F.col("vec_id") == F.col("doc_id")).select(F.col("source").alias("run_id"), F.concat(F.col("vec_id").cast("string"), F.lit("_scan.md")).alias("output"))
    failed = A.table(spark, sf_dir, "labels").where("toxic = 1").join(d, "doc_id").select(F.col("source").alias("run_id"), F.col("doc_id").alias("file_no"))
    return progress.file_status(files, outputs, failed)


@query("STR4_index_stream", """WITH l AS (SELECT o_custkey AS run_id, o_orderkey AS o, o_orderkey % 7 AS k, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
m AS (SELECT *, CASE WHEN k = 0 THEN 2 WHEN k = 1 THEN 3 WHEN k IN (2, 3) THEN 4 WHEN k = 4 THEN 5 WHEN k = 5 THEN 1 WHEN p = '1-URGENT' THEN 6 END AS s FROM l),
r AS (SELECT run_id, count(*) AS lines, coalesce(arg_max(s, n) FILTER (s IS NOT NULL), 1) AS s, coalesce(sum(CASE WHEN k = 1 THEN o % 50 END), 0) AS chunks, coalesce(arg_max(o % 90, n) FILTER (k = 3), 0) AS ed, coalesce(arg_max(CASE WHEN k = 2 THEN o % 80 ELSE 90 END, n) FILTER (k IN (2, 3)), 0) AS et,
  coalesce(arg_max(o % 60, n) FILTER (k = 4), 0) AS id, coalesce(arg_max(CASE WHEN k = 2 THEN o % 80 ELSE 60 END, n) FILTER (k IN (2, 4)), 0) AS it FROM m GROUP BY 1),
g AS (SELECT r.*, x.i AS stage_no FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS i) x)
SELECT run_id, stage_no::integer AS stage_no, ['prepare', 'upload', 'chunk', 'embed', 'index'][stage_no] AS stage, CASE WHEN stage_no < s THEN 'success' WHEN stage_no = s THEN 'running' ELSE 'pending' END AS status,
  CASE WHEN stage_no = 4 AND et > 0 THEN ed || '/' || et || ' chunks' WHEN stage_no = 5 AND it > 0 THEN id || '/' || it || ' chunks' ELSE '' END AS details,
  cast(CASE WHEN stage_no = 4 AND s = 4 AND et > 0 THEN ed * 100 // et WHEN stage_no = 5 AND s = 5 AND it > 0 THEN id * 100 // it END AS integer) AS percent, chunks::bigint AS chunks, lines, 0::bigint AS waiting, 0::bigint AS late, 0::bigint AS skipped FROM g""")
def index_stream(spark, sf_dir):
    """Every order as a log line of its customer's indexing, in two parts that each lack lines between."""
    o = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    line = (
        F.when(o % 7 == 0, F.lit("Uploaded a file")).when(o % 7 == 1, text("Created **", o % 50, "** chunk(s)")).when(o % 7 == 2, text("Embedding and indexing **", o % 80, "** chunks")).when(o % 7 == 3, text("[PROGRESS:embedding:", o % 90, "/90]"))
        .when(o % 7 == 4, text("[PROGRESS:indexing:", o % 60, "/60]")).when(o % 7 == 5, F.lit("Copied a file")).when(F.col("o_orderpriority") == "1-URGENT", F.lit("✅ Done.")).otherwise(F.lit("nothing of note"))
    )
    lines = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint").alias("line_no"), line.alias("line"))
    return _arriving(lines, 2, _folder(spark, "index-lines"), progress.index_progress)


# ---- joins, sets, sorts, mutations


@query("JN3_documents_runs", "SELECT d.doc_id, '/ws/' || source AS run_dir FROM documents d WHERE source IS NOT NULL")
def documents_runs(spark, sf_dir):
    d = A.case_documents(spark, sf_dir).select("run_id", F.col("source_doc").alias("doc_id"))
    return d.join(A.runs(spark, sf_dir).select("run_id", "run_dir"), "run_id").select("doc_id", "run_dir")


@query("JN5_counts_over_left_joins", f"WITH {_REGISTRY} SELECT r.run_id, count(DISTINCT d.doc_id) AS documents, count(DISTINCT c.chunk_id) AS chunks FROM (SELECT DISTINCT run_id FROM points) r LEFT JOIN docs d ON d.run_id = r.run_id LEFT JOIN chunks c ON c.doc_id = d.doc_id GROUP BY 1")
def left_join_counts(spark, sf_dir):
    r = A.registry(spark, sf_dir)
    runs = A.points(spark, sf_dir).select("run_id").distinct()
    joined = runs.join(r["documents"].select("run_id", "doc_id"), "run_id", "left").join(r["chunks"].select("doc_id", "chunk_id"), "doc_id", "left")
    return joined.groupBy("run_id").agg(F.countDistinct("doc_id").alias("documents"), F.countDistinct("chunk_id").alias("chunks"))


@query("JN7_texts_without_vector", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def texts_without_vector(spark, sf_dir):
    """RET1's first half: texts that the vector cache doesn't hold."""
    cached = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return A.table(spark, sf_dir, "documents").select("doc_id").join(cached, "doc_id", "left_anti")


@query("RET2_build_points", f"WITH {RECORDS} SELECT doc_id, chunk_id, cast(strftime(order_date, '%Y%m%d') AS integer) AS date_int, substr(text, 1, 200) AS preview FROM letters WHERE record_id IN (SELECT vec_id FROM embeddings)")
def build_points(spark, sf_dir):
    r = A.records(spark, sf_dir)
    v = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), "embedding")
    return r.join(v, "record_id").select("doc_id", "chunk_id", T.date_int(F.col("order_date").cast("string")).alias("date_int"), F.substring("text", 1, 200).alias("preview"))


@query("JN8_id_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def id_semi_join(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return A.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("JN11_token_jaccard", "WITH t AS (SELECT item_id, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / cast(len(list_distinct(list_concat(a.w, b.w))) AS double), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id AND a.item_id // 10 = b.item_id // 10")
def token_jaccard(spark, sf_dir):
    """Similarity of candidates inside a group of ten."""
    t = A.table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"), F.floor(F.col("item_id") / 10).alias("g"))
    a, b = t.select(F.col("item_id").alias("a"), F.col("w").alias("wa"), "g"), t.select(F.col("item_id").alias("b"), F.col("w").alias("wb"), "g")
    both = a.join(b, "g").where("a < b")
    return both.select("a", "b", F.round(F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb")), 6).alias("jaccard"))


@query("JN11_jaccard_all_items", "WITH t AS (SELECT item_id, list_distinct(list_transform(string_split(lower(text), ' '), lambda x: substr(x, 1, 3))) AS w FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / cast(len(list_distinct(list_concat(a.w, b.w))) AS double), 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.w, b.w)) / cast(len(list_distinct(list_concat(a.w, b.w))) AS double) >= 0.2")
def jaccard_all_items(spark, sf_dir):
    """All benchmark items as the candidates of one query, by the first letters of their words."""
    tokens = F.transform(F.split(F.lower("text"), " "), lambda x: F.substring(x, 1, 3))
    t = A.table(spark, sf_dir, "benchmark").select(F.lit(1).alias("query_id"), "item_id", tokens.alias("tokens"))
    return similarity.jaccard_pairs(t, 0.2).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("JN11_jaccard_in_groups", "WITH t AS (SELECT o_custkey, o_orderkey, list(DISTINCT (l_suppkey % 9) || l_returnflag) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2), p AS (SELECT a.o_custkey AS query_id, a.o_orderkey AS a, b.o_orderkey AS b, len(list_intersect(a.w, b.w)) AS o, len(list_distinct(list_concat(a.w, b.w))) AS u FROM t a JOIN t b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey) SELECT query_id, a, b, round(o / cast(u AS double), 6) AS jaccard FROM p WHERE o / cast(u AS double) >= 0.5")
def jaccard_in_groups(spark, sf_dir):
    """A customer is a query, the orders are its candidates, suppliers and flags their tokens."""
    l = A.table(spark, sf_dir, "lineitem").join(A.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sets = l.groupBy(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id")).agg(F.collect_set(F.concat((F.col("l_suppkey") % 9).cast("string"), "l_returnflag")).alias("tokens"))
    return similarity.jaccard_pairs(sets, 0.5).select("query_id", "a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("SET4_ungrounded_dates", f"WITH {RECORDS} SELECT record_id, CASE WHEN record_id % 4 = 0 THEN '1950-05-05' ELSE '' END AS ungrounded FROM r")
def ungrounded_dates(spark, sf_dir):
    says = F.concat_ws(" ", F.date_format("order_date", "yyyy/MM/dd"), F.when(F.col("record_id") % 4 == 0, "05.05.1950"))
    return A.records(spark, sf_dir).select("record_id", F.array_join(F.array_except(T.canonical_dates(says), T.canonical_dates(F.col("text"))), ",").alias("ungrounded"))


@query("SET5_audited_documents", "SELECT count(*) AS documents, count(*) FILTER (doc_id IN (SELECT vec_id FROM embeddings)) AS audited FROM documents")
def audited_documents(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("hit")).distinct()
    return A.table(spark, sf_dir, "documents").select("doc_id").join(e, "doc_id", "left").agg(F.count("*").alias("documents"), F.count("hit").alias("audited"))


@query("MUT2_upsert_documents", "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'pending' ELSE 'indexed' END AS status FROM customer")
def upsert_documents(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return registry.upsert(c.withColumn("status", F.lit("indexed")), c.where("doc_id % 2 = 0").withColumn("status", F.lit("pending")), "doc_id")


@query("MUT6_mark_status", "SELECT o_custkey AS run_id, count(*) AS total_documents, CASE WHEN bool_and(o_orderstatus <> 'O') THEN 'indexed' ELSE 'pending' END AS status FROM orders GROUP BY 1")
def mark_status(spark, sf_dir):
    """Totals are refreshed from counts; a run is indexed when all its documents are."""
    return A.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("total_documents"), F.when(F.every(F.col("o_orderstatus") != "O"), "indexed").otherwise("pending").alias("status"))


@query("MUT7_delete_run", f"WITH {_REGISTRY} SELECT 'documents' AS t, count(*) AS n FROM docs WHERE run_id <> 'run-3' UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE run_id <> 'run-3' UNION ALL SELECT 'points', count(*) FROM points WHERE run_id <> 'run-3'")
def delete_run(spark, sf_dir):
    left = registry.delete_run(A.registry(spark, sf_dir) | {"points": A.points(spark, sf_dir)}, F.col("run_id") == "run-3")
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("t"), "n") for name, t in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("MUT13_delete_all", f"WITH {_REGISTRY} SELECT 'documents' AS t, count(*) AS n_before, 0::bigint AS n_after FROM docs UNION ALL SELECT 'chunks', count(*), 0 FROM chunks UNION ALL SELECT 'points', count(*), 0 FROM points")
def delete_all(spark, sf_dir):
    root = _folder(spark, "emptied")
    before = A.registry(spark, sf_dir) | {"points": A.points(spark, sf_dir)}
    registry.delete_all(before, root)
    after = {name: registry.published(spark, root, name) for name in before}
    rows = [t.select(F.lit(name).alias("t"), F.lit(was).alias("was")) for held, was in ((before, 1), (after, 0)) for name, t in held.items()]
    return functools.reduce(DataFrame.unionByName, rows).groupBy("t").agg(F.count_if(F.col("was") == 1).alias("n_before"), F.count_if(F.col("was") == 0).alias("n_after"))


@query("SNK1_write_tables", "SELECT 'doc-' || doc_id AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'indexed' END AS status, true AS no_pages FROM documents")
def write_tables(spark, sf_dir):
    """Documents published without a status gain it, and the layout's other columns."""
    root = _folder(spark, "layout")
    d = A.registry(spark, sf_dir)["chunks"].select("doc_id", "run_id", F.when(F.col("number") % 3 > 0, F.lit("2020-01-01").cast("timestamp")).alias("indexed_at"))
    registry.publish({"documents": d}, root)
    tables.write_tables(spark, root)
    return registry.published(spark, root, "documents").select("doc_id", "status", F.col("pdf_total_pages").isNull().alias("no_pages"))


@query("SRC3_chunks_for_runs", "SELECT 'run-' || doc_id % 20 AS run_id, doc_id AS number, 'doc-' || doc_id || '.md' AS original_filename FROM documents WHERE doc_id % 20 IN (SELECT doc_id % 20 FROM documents WHERE doc_id % 19 < 18)")
def chunks_for_runs(spark, sf_dir):
    r = A.registry(spark, sf_dir)
    named = r["documents"].withColumn("original_filename", F.concat("doc_id", F.lit(".md")))
    got = tables.chunks_for_runs(r["chunks"].withColumn("chunk_index", F.lit(0)), named, named.where("status = 'indexed'"))
    return got.select("run_id", "number", "original_filename")


@query("SRC9_documents_for_runs", "SELECT o_custkey AS run_id, o_orderkey || '.md' AS original_filename FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def documents_for_runs(spark, sf_dir):
    d = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".md")).alias("original_filename"))
    return tables.documents_for_runs(d, A.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("run_id")))


@query("SRC10_chunks_for_documents", "SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def chunks_for_documents(spark, sf_dir):
    c = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"))
    return tables.chunks_for_documents(c, A.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id")))


@query("SRC11_point_ids_for_runs", f"WITH {_REGISTRY} SELECT run_id, count(*) AS n FROM points WHERE run_id IN (SELECT run_id FROM docs) GROUP BY 1")
def point_ids_for_runs(spark, sf_dir):
    got = tables.point_ids_for_runs(A.points(spark, sf_dir), A.registry(spark, sf_dir)["documents"])
    return got.groupBy("run_id").agg(F.count("*").alias("n"))


@query("MUT9_all_or_nothing", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def all_or_nothing(spark, sf_dir):
    """A second, failing publication leaves the first version in place."""
    root = _folder(spark, "published")
    o = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    registry.publish({"orders": o}, root)
    try:
        registry.publish({"orders": o.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 97 == 5, F.raise_error(F.lit("injected failure")).cast("bigint")).otherwise(F.col("o_orderkey")))}, root)
    except Exception as e:
        if "injected failure" not in str(e):
            raise
    return registry.published(spark, root, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("MUT10_is_run_indexed", f"WITH {_REGISTRY} SELECT DISTINCT run_id FROM docs WHERE status = 'indexed' AND run_id IN (SELECT run_id FROM points)")
def is_run_indexed(spark, sf_dir):
    d = A.registry(spark, sf_dir)["documents"].where("status = 'indexed'").select("run_id").distinct()
    return d.join(A.points(spark, sf_dir).select("run_id"), "run_id", "left_semi")


@query("MUT14_delete_points", f"WITH {_REGISTRY} SELECT vec_id FROM points WHERE vec_id % 3 <> 0")
def delete_points(spark, sf_dir):
    p = A.points(spark, sf_dir)
    return p.join(p.where("vec_id % 3 = 0").select("point_id"), "point_id", "left_anti").select("vec_id")


@query("RET6_facet_search", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM e),
f AS (SELECT vec_id - vec_id % 100 AS query_id, vec_id % 100 AS facet_no, v, l FROM n WHERE vec_id % 100 IN (0, 25, 50)),
s AS (SELECT f.query_id, f.facet_no, p.vec_id AS chunk_id, round(list_dot_product(f.v, p.v) / f.l / p.l, 6) AS score FROM f, n p),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, facet_no ORDER BY score DESC, chunk_id) AS r FROM s), t AS (SELECT * FROM k WHERE r <= 8)
SELECT query_id, chunk_id, max(score) AS score, string_agg(facet_no, ',' ORDER BY facet_no) AS facets FROM t GROUP BY 1, 2""")
def facet_search(spark, sf_dir):
    """A query and two facets of it, searched in one plan and merged."""
    p = A.points(spark, sf_dir)
    f = p.where("vec_id % 100 in (0, 25, 50)").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    found = retrieval.vector_search(f, p.select(F.col("vec_id").alias("item_id"), "vector"), 8)
    hits = found.select((F.col("query_id") - F.col("query_id") % 100).alias("query_id"), (F.col("query_id") % 100).alias("facet_no"), F.col("item_id").alias("chunk_id"), "score")
    return retrieval.facet_merge(hits).select("query_id", "chunk_id", "score", F.array_join(F.col("retrieval_facets").cast("array<string>"), ",").alias("facets"))


@query("CHR1_prepare_case", "SELECT l_orderkey AS doc_id, min(l_linenumber) AS chunk_index FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS t FROM lineitem) GROUP BY l_orderkey, t")
def prepare_case(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.lit("c").alias("chunk_id"), (F.col("l_linenumber") * 80).alias("char_start"), (F.col("l_linenumber") * 80 + 2).alias("char_end"))
    return chronology.prepare_case(li).select("doc_id", "chunk_index")


@query("CHR4_keep_list", "WITH o AS (SELECT o_custkey AS run_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS no FROM orders) SELECT run_id, o_orderkey AS ord FROM o WHERE no // 3 % 2 = 0 AND no % 3 IN (0, 2)")
def keep_list(spark, sf_dir):
    """Groups of three; even groups keep the first and third, odd groups have a list that is no JSON."""
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("ord"))
    n = o.groupBy("run_id").agg(F.floor((F.count("*") - 1) / 3).cast("int").alias("last"))
    lists = n.select("run_id", F.explode(F.sequence(F.lit(0), "last")).alias("group_no")).withColumn("response", F.when(F.col("group_no") % 2 == 0, "[1, 3]").otherwise("keep them"))
    return chronology.keep_listed(o, lists, 3)


@query("CHR12_split_failed", "WITH o AS (SELECT o_custkey, o_orderkey, ntile(2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS h FROM orders WHERE o_custkey % 4 = 1) SELECT o_custkey || '.' || h AS batch_id, 1 AS depth, o_orderkey AS ord FROM o")
def split_failed(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("batch_id"), F.lit(0).alias("depth"), F.col("o_orderkey").alias("ord"), F.lit("c").alias("chunk_id"), "o_custkey")
    return chronology.split_failed(o.drop("o_custkey"), o.where("o_custkey % 4 = 1")).select("batch_id", "depth", "ord")


@query("AGG10_chronology_audit", f"WITH {RECORDS} SELECT run_id, count(DISTINCT doc_id) AS documents, count(*) AS chunks, count_if(record_id % 6 = 0) AS events, count_if(record_id % 6 > 0) AS rejected FROM r GROUP BY 1")
def chronology_audit(spark, sf_dir):
    responses, sources = _responses(spark, sf_dir)
    grounded = chronology.ground_events(chronology.response_events(responses), sources)
    r = A.records(spark, sf_dir)
    named = grounded.join(r.select(F.col("record_id").alias("batch_id"), "run_id"), "batch_id")
    return chronology.audit(named, r).select("run_id", "documents", "chunks", "events", "rejected")


@query("ANS8_chat_history", "SELECT conv_id AS session_id, string_agg(role, ',' ORDER BY turn, role) AS roles FROM conversations WHERE role <> 'system' GROUP BY 1")
def chat_history(spark, sf_dir):
    m = A.messages(spark, sf_dir).where(F.col("role").isin("user", "assistant"))
    return m.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


@query("WIN1_chunk_index", "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_linenumber) - 1 AS chunk_index FROM lineitem")
def chunk_index(spark, sf_dir):
    w = W.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey", "l_linenumber")
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.row_number().over(w) - 1).alias("chunk_index"))


@query("AGG17_ledger_ratio", "SELECT o_custkey AS query_id, count(*) AS entries, count_if(o_orderkey % 3 = 0) * 2 <= count(*) AS claim_unsupported FROM orders GROUP BY 1")
def ledger_ratio(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    hits = o.select(F.col("o_custkey").alias("query_id"), F.when(F.col("o_orderkey") % 3 == 0, "attachment list").otherwise("letter").alias("document_type"), F.lit("x").alias("text"), F.col("o_orderdate").cast("date").alias("date_extracted"))
    return answers.evidence_ledger(hits).groupBy("query_id").agg(F.count("*").alias("entries"), (F.count_if(F.col("evidence_status") == "indirect index/reference") * 2 <= F.count("*")).alias("claim_unsupported"))


@query("SRT3_timeline_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 7 = 0), CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END, o_orderpriority, o_orderkey) AS position FROM orders")
def timeline_order(spark, sf_dir):
    """Dates in order, those without one last, then by the written form."""
    iso = F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate"))
    w = W.partitionBy("o_custkey").orderBy(iso.asc_nulls_last(), "o_orderpriority", "o_orderkey")
    return A.table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("position"))


@query("AGG16_case_dashboard", f"WITH {RECORDS} SELECT run_id, count(DISTINCT doc_id) AS documents, count(*) AS chunks, strftime(min(order_date), '%d/%m/%Y') || ' - ' || strftime(max(order_date), '%d/%m/%Y') AS date_range, '01/02/1970' AS dob FROM r GROUP BY 1")
def case_dashboard(spark, sf_dir):
    from casegrid.operators.casefile import case_metadata

    r = A.records(spark, sf_dir)
    stats = r.groupBy("run_id").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.concat_ws(" - ", F.date_format(F.min("order_date"), "dd/MM/yyyy"), F.date_format(F.max("order_date"), "dd/MM/yyyy")).alias("date_range"))
    return stats.join(case_metadata(r.withColumnRenamed("patient", "patient_name")).select("run_id", "dob"), "run_id", "left")
