"""Queries of the scalar functions and table-generating operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from casegrid.functions import textcols as T
from casegrid.operators import chunking
from casegrid.plans import adapters as A
from casegrid.plans.catalog import query


def _name_sql(key: str, width: int) -> str:
    low = f"translate(lpad(cast({key} AS varchar), {width}, '0'), '0123456789', 'abcdefghij')"
    return f"upper(substr({low}, 1, 1)) || substr({low}, 2)"


#: The letters' source columns in DuckDB.
RECORDS = f"""
r AS (SELECT o_orderkey AS record_id, o_custkey AS cust, c_nationkey AS nation, '/ws/nation' || c_nationkey AS run_dir, substr(sha256('/ws/nation' || c_nationkey), 1, 16) AS run_id,
  cast(o_orderdate AS date) AS order_date, strftime(o_orderdate, '%d/%m/%Y') AS raw, strftime(o_orderdate, '%Y-%m-%d') AS iso, c_mktsegment AS clinic, o_custkey || '.md' AS original_filename,
  substr(sha256(substr(sha256('/ws/nation' || c_nationkey), 1, 16) || ':' || o_custkey), 1, 24) AS doc_id, substr(sha256(o_custkey || ':' || o_orderkey), 1, 24) AS chunk_id, o_orderpriority AS priority,
  {_name_sql("o_custkey", 6)} || ' ' || {_name_sql("c_nationkey", 3)} AS patient, {_name_sql("o_custkey % 97", 4)} AS doctor
  FROM orders JOIN customer ON o_custkey = c_custkey),
letters AS (SELECT *, raw || ' consultation attended for treatment' || chr(10) || 'Re: ' || patient || ' DOB: 01/02/1970' || chr(10) || chr(10) || 'Dear Dr Smith' || chr(10) || 'Claim No: C' || record_id || chr(10) || 'Clinic: ' || clinic || chr(10) || chr(10)
  || 'On examination pain was reported on ' || raw || '. Diagnosis: injury of priority ' || lower(priority) || chr(10) || chr(10) || 'Kind regards' || chr(10) || chr(10) || 'Dr ' || doctor AS text FROM r)"""


def _on_records(name: str, sql: str, **columns):
    @query(name, f"WITH {RECORDS} SELECT record_id, {sql} FROM letters")
    def run(spark, sf_dir):
        return A.records(spark, sf_dir).select("record_id", *[f(F.col("text")).alias(c) for c, f in columns.items()])

    return run


_on_records("FN1_first_date_raw", "raw AS first_date", first_date=T.first_date_raw)
_on_records("FN2_first_date_iso", "iso AS first_date", first_date=T.first_date_iso)
_on_records("FN3_author", "doctor AS author", author=T.author)
_on_records("FN6_document_type", "'specialist_letter' AS document_type", document_type=T.document_type)
_on_records("FN7_section_type", "'clinical_findings' AS section_type", section_type=T.section_type)
_on_records("FN8_patient_name", "patient AS patient_name", patient_name=T.patient_name)
_on_records("FN15_clinic_ref_summary", "clinic, 'Claim No: C' || record_id AS ref_no, raw || ' consultation attended for treatment Re: ' || patient || ' DOB: 01/02/1970' AS summary", clinic=T.clinic, ref_no=T.reference_number, summary=T.summary)
_on_records("FN22_canonical_dates", "'1970-02-01,' || iso AS dates", dates=lambda t: F.array_join(T.canonical_dates(t), ","))
_on_records("FN10_token_estimate", "cast(length(text) // 4 AS integer) AS token_count", token_count=T.token_estimate)
_on_records("FN34_query_cache_key", "substr(sha256(text), 1, 32) AS cache_key", cache_key=T.cache_key)
_on_records("FN29_payload_preview", "substr(text, 1, 200) AS text_preview", text_preview=lambda t: F.substring(t, 1, 200))


@query("FN4_radiology_author", f"WITH {RECORDS} SELECT record_id, 'Dr ' || doctor || ' Senior' AS author FROM r")
def radiology_author(spark, sf_dir):
    """Imaging reports rendered from the letters: a signed name, or a last line, in turn."""
    signed = F.concat(F.lit("CT OF SPINE\nDr Someone Else\n\nFindings: none\nDr "), F.col("doctor"), F.lit(" Senior\n"), F.when(F.col("record_id") % 2 == 0, "Electronically signed").otherwise(""))
    return A.records(spark, sf_dir).select("record_id", T.radiology_author(signed).alias("author"))


@query("FN5_radiology_date", f"WITH {RECORDS} SELECT record_id, iso AS date_iso, day(order_date) || ' ' || strftime(order_date, '%b') || ' ' || year(order_date) AS date_raw FROM r")
def radiology_date(spark, sf_dir):
    d = F.col("order_date")
    text = F.concat(F.lit("MRI BOTH HIPS\nReported "), F.dayofmonth(d).cast("string"), F.lit("th "), F.date_format(d, "MMM"), F.lit(" "), F.year(d).cast("string"))
    got = T.radiology_date(text)
    return A.records(spark, sf_dir).select("record_id", got["iso"].alias("date_iso"), got["raw"].alias("date_raw"))


@query("FN9_ids", """
WITH d AS (SELECT doc_id AS source_doc, substr(sha256('/ws/' || coalesce(source, 'unsorted')), 1, 16) AS run_id FROM documents),
e AS (SELECT *, substr(sha256(run_id || ':' || source_doc || '.md'), 1, 24) AS doc_id FROM d),
c AS (SELECT *, substr(sha256(doc_id || ':0'), 1, 24) AS chunk_id FROM e)
SELECT source_doc, run_id, doc_id, chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT *, sha256(chunk_id) AS h FROM c)""")
def ids(spark, sf_dir):
    d = A.case_documents(spark, sf_dir).select("source_doc", "run_id", "doc_id")
    return d.withColumn("chunk_id", T.chunk_id(F.col("doc_id"), F.lit(0))).withColumn("point_id", T.point_id(F.col("chunk_id")))


@query("FN11_date_int", "SELECT o_orderkey, cast(strftime(o_orderdate, '%Y%m%d') AS integer) AS date_int FROM orders")
def date_int(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", T.date_int(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_int"))


@query("FN12_iso_bound", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || '-01' WHEN 2 THEN strftime(o_orderdate, '%Y') || '-01-01'
  WHEN 3 THEN strftime(to_timestamp(86400 * 1000 + o_orderkey * 1000) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS bound FROM orders""")
def iso_bound(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    given = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-M")).when(k == 2, F.date_format(d, "yyyy")).when(k == 3, (F.lit(86400 * 1000) + F.col("o_orderkey") * 1000).cast("string")).otherwise("soon")
    return A.table(spark, sf_dir, "orders").select("o_orderkey", T.iso_bound(given).alias("bound"))


@query("FN13_timeline_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def timeline_date(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    given = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "d.M.yyyy")).when(k == 2, F.date_format(d, "d MMMM yyyy")).otherwise("31/02/2020")
    return A.table(spark, sf_dir, "orders").select("o_orderkey", T.timeline_date(given).alias("iso"))


@query("FN14_source_date", f"""WITH {RECORDS} SELECT record_id, CASE record_id % 3 WHEN 0 THEN raw WHEN 1 THEN iso ELSE raw END AS raw, CASE record_id % 3 WHEN 0 THEN iso WHEN 1 THEN iso ELSE iso END AS iso FROM r""")
def source_date(spark, sf_dir):
    k = F.col("record_id") % 3
    got = T.source_date(F.when(k == 1, F.col("order_date")), F.when(k == 0, F.date_format("order_date", "dd/MM/yyyy")), F.col("text"))
    return A.records(spark, sf_dir).select("record_id", got["raw"].alias("raw"), got["iso"].alias("iso"))


_MENTION = """CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%d %B %Y') WHEN 3 THEN strftime(o_orderdate, '%B %d, %Y') WHEN 4 THEN strftime(o_orderdate, '%B %Y') ELSE strftime(o_orderdate, '%Y') END"""


def _mention():
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    return F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "dd MMMM yyyy")).when(k == 3, F.date_format(d, "MMMM dd, yyyy")).when(k == 4, F.date_format(d, "MMMM yyyy")).otherwise(F.date_format(d, "yyyy"))


@query("FN16_documented_date", f"""SELECT o_orderkey, {_MENTION} AS mention, CASE WHEN o_orderkey % 6 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 6 = 4 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS value,
CASE WHEN o_orderkey % 6 < 4 THEN 'day' WHEN o_orderkey % 6 = 4 THEN 'month' ELSE 'year' END AS precision FROM orders""")
def documented_date(spark, sf_dir):
    got = T.documented_date(F.col("mention"))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", _mention().alias("mention")).select("o_orderkey", "mention", got["value"].alias("value"), got["precision"].alias("precision"))


_EVENTS_SQL = """e AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'month' WHEN 2 THEN 'year' WHEN 3 THEN 'unknown' ELSE 'day' END AS precision,
CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y') WHEN 3 THEN 'x' ELSE strftime(o_orderdate, '%Y') || '-02-31' END AS value, o_orderpriority AS provider, o_orderstatus AS event_type FROM orders)"""


def _events(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    value = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM")).when(k == 2, F.date_format(d, "yyyy")).when(k == 3, "x").otherwise(F.concat(F.date_format(d, "yyyy"), F.lit("-02-31")))
    precision = F.when(k == 1, "month").when(k == 2, "year").when(k == 3, "unknown").otherwise("day")
    return A.table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"), precision.alias("precision"), F.col("o_orderpriority").alias("provider"), F.col("o_orderstatus").alias("event_type"))


@query("FN17_event_date_norm", f"""WITH {_EVENTS_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN value ELSE '' END AS value, CASE WHEN o_orderkey % 5 < 3 THEN precision ELSE 'unknown' END AS precision,
CASE o_orderkey % 5 WHEN 3 THEN 'Event date is not available as a normalised value' WHEN 4 THEN 'Invalid calendar date: ' || value END AS warning FROM e""")
def event_date_norm(spark, sf_dir):
    got = T.event_date_norm(F.col("value"), F.col("precision"))
    return _events(spark, sf_dir).select("o_orderkey", got["value"].alias("value"), got["precision"].alias("precision"), got["warning"].alias("warning"))


@query("FN18_display_date", f"""WITH {_EVENTS_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN substr(value, 9, 2) || '/' || substr(value, 6, 2) || '/' || substr(value, 1, 4) WHEN o_orderkey % 5 = 1 THEN substr(value, 6, 2) || '/' || substr(value, 1, 4) || ' [Date Incomplete]'
WHEN o_orderkey % 5 = 2 THEN value || ' [Date Incomplete]' ELSE 'around then [Date Incomplete]' END AS shown FROM e""")
def display_date(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("n", T.event_date_norm(F.col("value"), F.col("precision")))
    return e.select("o_orderkey", T.display_date(F.col("n.value"), F.col("n.precision"), F.lit("around then")).alias("shown"))


@query("FN19_date_sort_key", f"""WITH {_EVENTS_SQL}, k AS (SELECT *, o_orderkey % 5 AS m FROM e)
SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN m < 3 THEN cast(substr(value, 1, 4) AS int) ELSE 9999 END, CASE WHEN m < 2 THEN cast(substr(value, 6, 2) AS int) WHEN m = 2 THEN 1 ELSE 12 END,
CASE WHEN m = 0 THEN cast(substr(value, 9, 2) AS int) WHEN m < 3 THEN 1 ELSE 31 END, CASE WHEN m < 3 THEN m ELSE 3 END, lower(provider), lower(event_type), o_orderkey) AS position FROM k""")
def date_sort_key(spark, sf_dir):
    """SRT2's key; the positions come from range-partitioned sorting, not from one task."""
    e = _events(spark, sf_dir).withColumn("n", T.event_date_norm(F.col("value"), F.col("precision")))
    keyed = e.select("o_orderkey", T.date_sort_key(F.col("n.value"), F.col("n.precision"), F.col("provider"), F.col("event_type")).alias("k")).withColumn("month", F.col("k.y") * 100 + F.col("k.m"))
    before = keyed.groupBy("month").agg(F.count("*").alias("n")).select(F.col("month").alias("b_month"), F.coalesce(F.sum("n").over(W.orderBy("month").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(W.partitionBy("month").orderBy("k", "o_orderkey"))
    return keyed.withColumn("own", own).join(before, F.col("month") == F.col("b_month")).select("o_orderkey", (F.col("own") + F.col("before")).alias("position"))


@query("FN20_clinical_duration", "SELECT l_orderkey, l_linenumber, l_linenumber % 4 < 2 AS is_duration FROM lineitem")
def clinical_duration(spark, sf_dir):
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 4
    text = F.when(k == 0, F.concat(F.lit("review in "), q, F.lit("/52"))).when(k == 1, F.concat(F.lit("for "), q, F.lit(" - 60 / 7 days"))).when(k == 2, F.concat(q, F.lit("/120"))).otherwise(F.concat(F.lit("1"), F.lit(" of "), q))
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.is_duration(text).alias("is_duration"))


@query("FN21_evidence_text", r"SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_]+', ' ', 'g')) AS evidence FROM documents")
def evidence_text(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", T.evidence_text(F.col("text")).alias("evidence"))


_PLACE = "CASE WHEN record_id % 3 = 0 THEN 'page ' || (record_id % 9) WHEN record_id % 3 = 1 THEN 'pages ' || (record_id % 9) || '-' || (record_id % 9 + 2) ELSE 'chars 0-' || length(text) END"


def _placed(spark, sf_dir):
    p = (F.col("record_id") % 9).cast("int")
    k = F.col("record_id") % 3
    place = T.page_label(F.when(k < 2, p), F.when(k == 0, p).when(k == 1, p + 2), F.lit(0), F.length("text"))
    return A.records(spark, sf_dir).withColumn("place", place)


@query("FN23_source_label", f"WITH {RECORDS} SELECT record_id, 'Specialist Letter, ' || doctor || ', ' || original_filename || ', ' || {_PLACE} AS label FROM letters")
def source_label(spark, sf_dir):
    return _placed(spark, sf_dir).select("record_id", T.source_label(T.document_type(F.col("text")), F.col("doctor"), F.col("original_filename"), F.col("place")).alias("label"))


@query("FN24_citation_text", f"WITH {RECORDS} SELECT record_id, concat_ws(', ', CASE WHEN record_id % 2 = 0 THEN original_filename END, doctor, {_PLACE}, 'Claim No: C' || record_id) AS citation FROM letters")
def citation_text(spark, sf_dir):
    file = F.when(F.col("record_id") % 2 == 0, F.col("original_filename")).otherwise(F.concat(F.md5(F.col("original_filename")), F.lit(".md")))
    return _placed(spark, sf_dir).select("record_id", F.concat_ws(", ", T.visible_file(file), "doctor", "place", T.reference_number(F.col("text"))).alias("citation"))


@query("FN25_context_block", f"WITH {RECORDS} SELECT record_id, concat_ws(' | ', '[Source 1]', original_filename, {_PLACE}, 'Author: ' || doctor, 'Date: ' || iso, 'Type: specialist_letter') || chr(10) || text AS block FROM letters")
def context_block(spark, sf_dir):
    block = T.context_block(F.lit(1), F.col("original_filename"), F.col("place"), F.col("doctor"), F.col("order_date").cast("string"), T.document_type(F.col("text")), F.col("text"))
    return _placed(spark, sf_dir).select("record_id", block.alias("block"))


@query("FN26_case_label", "SELECT p_partkey, substr(regexp_replace(p_name, '[^A-Za-z0-9_-]+', '_', 'g'), 1, 60) AS case_name FROM part")
def case_label(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", T.case_name(F.concat(F.lit("/ws/a/"), F.translate("p_name", "/", " "), F.lit("/"))).alias("case_name"))


@query("FN26_selector_label", f"WITH {RECORDS} SELECT run_id, '📁 nation' || any_value(nation) || ' (' || count(DISTINCT doc_id) || ' docs, ' || count(*) || ' chunks)' AS label FROM r GROUP BY 1")
def selector_label(spark, sf_dir):
    cases = A.records(spark, sf_dir).groupBy("run_id", "run_dir").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))
    return cases.select("run_id", T.case_label(F.col("run_dir"), F.col("documents"), F.col("chunks")).alias("label"))


@query("FN33_entities", "SELECT l_orderkey, l_linenumber, chr(cast(160 + l_suppkey % 90 AS integer)) || ' ' || chr(cast(945 + l_linenumber AS integer)) || ' & é &lt; x' AS text FROM lineitem")
def entities(spark, sf_dir):
    """Entities by decimal and hexadecimal number, by name, and one that is escaped twice."""
    l = A.table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("&#"), (160 + F.col("l_suppkey") % 90).cast("string"), F.lit("; &#x"), F.hex(945 + F.col("l_linenumber")), F.lit("; &amp; &eacute; &amp;lt; x"))
    return l.select("l_orderkey", "l_linenumber", T.unescape(text).alias("text"))


@query("FN27_collection_name", "SELECT p_partkey, 'records_' || trim(lower(right(regexp_replace(p_type || '/' || p_brand, '[^A-Za-z0-9]+', '_', 'g'), 40)), '_') AS collection FROM part")
def collection_name(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_partkey", T.collection_name(F.concat_ws("/", "p_type", "p_brand")).alias("collection"))


@query("FN28_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS score FROM customer")
def sigmoid(spark, sf_dir):
    return A.table(spark, sf_dir, "customer").select("c_custkey", F.round(T.sigmoid(F.col("c_acctbal") / 1000), 6).alias("score"))


@query("FN30_run_filter_resolve", """WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), k AS (SELECT *, row_number() OVER (ORDER BY source) % 4 AS m FROM c)
SELECT CASE m WHEN 0 THEN substr(sha256('/ws/' || source), 1, 16) WHEN 1 THEN '/ws/' || source WHEN 2 THEN source ELSE source || ' (' || n || ' files)' END AS asked, substr(sha256('/ws/' || source), 1, 16) AS run_id FROM k""")
def run_filter_resolve(spark, sf_dir):
    """A case is named by its id, its folder, the folder's base name, or that with its number of files."""
    runs = A.runs(spark, sf_dir).withColumn("base", F.element_at(F.split("run_dir", "/"), -1))
    m = F.row_number().over(W.orderBy("base")) % 4  # one row a case
    asked = runs.select(F.when(m == 0, F.col("run_id")).when(m == 1, F.col("run_dir")).when(m == 2, F.col("base")).otherwise(F.concat(F.col("base"), F.lit(" ("), F.col("total_documents").cast("string"), F.lit(" files)"))).alias("asked"))
    keys = runs.select("run_id", F.explode(F.array("run_id", "run_dir", "base")).alias("key")).distinct()
    return asked.withColumn("key", F.regexp_replace("asked", r" \(\d+ files\)$", "")).join(keys, "key").select("asked", "run_id")


@query("FN31_progress_eta", "SELECT o_orderkey, round(least(1.0, (o_orderkey % 100) / 90.0) * 100, 1) AS percent, CASE WHEN o_orderkey % 100 > 0 THEN round(60.0 / (o_orderkey % 100) * greatest(90 - o_orderkey % 100, 0), 4) END AS remaining FROM orders")
def progress_eta(spark, sf_dir):
    got = T.progress((F.col("o_orderkey") % 100).cast("double"), F.lit(90.0), F.lit(60.0))
    return A.table(spark, sf_dir, "orders").select("o_orderkey", got["percent"].alias("percent"), F.round(got["remaining"], 4).alias("remaining"))


@query("FN32_l2_normalise", "SELECT vec_id, round(sum(x * x), 6) AS norm FROM (SELECT vec_id, unnest(embedding)::double AS x FROM embeddings) GROUP BY vec_id")
def l2_normalise(spark, sf_dir):
    v = T.l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3))
    return A.table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(T.dot(F.col("v"), F.col("v")), 6).alias("norm"))


_UNTAG = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):  # those that the pages hold; &amp; last
    _UNTAG = f"replace({_UNTAG}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query("FN33_strip_html", rf"SELECT page_id, trim(regexp_replace({_UNTAG}, '[\s\x0B\x1c-\x1f\x85\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS text FROM pages")
def strip_html(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


# ---- table-generating operators


@query("GEN1_split_sections", f"WITH {RECORDS} SELECT record_id, 0 AS section_no, 0 AS section_start, length(text) AS section_end FROM letters")
def split_sections(spark, sf_dir):
    """Every section of every letter."""
    s = chunking.sections(A.records(spark, sf_dir), "record_id")
    return s.select("record_id", "section_no", F.col("start").alias("section_start"), F.col("end").alias("section_end"))


@query("GEN2_split_chunks")
def split_chunks(spark, sf_dir):
    """Spans of every document's chunks; exact slices (tested against a plain loop)."""
    return A.chunks(spark, sf_dir).select("doc_id", "chunk_index", "source_char_start", "source_char_end", F.sha2("text", 256).alias("text_sha256"))


@query("GEN3_chunk_documents")
def chunk_documents(spark, sf_dir):
    return A.chunks(spark, sf_dir)


@query("GEN6_page_slices", "SELECT doc_id AS source_doc, cast(p + 1 AS integer) AS page, substr(text, p * 1000 + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(greatest(1, (length(text) + 999) // 1000))) AS p FROM documents)")
def page_slices(spark, sf_dir):
    docs = A.case_documents(spark, sf_dir)
    return chunking.page_slices(docs.drop("doc_id").withColumnRenamed("source_doc", "doc_id")).select(F.col("doc_id").alias("source_doc"), "page", "text")


@query("GEN8_source_tags", """WITH m AS (SELECT conv_id AS session_id, turn FROM conversations WHERE role = 'assistant')
SELECT session_id, turn, cast(turn % 4 AS integer) AS source_no FROM m UNION ALL SELECT session_id, turn, cast(turn + 1 AS integer) FROM m""")
def source_tags(spark, sf_dir):
    from casegrid.operators.answers import source_numbers

    m = A.messages(spark, sf_dir)
    return m.select("session_id", "turn", F.explode(source_numbers(F.col("content"))).alias("source_no"))


@query("GEN10_facet_queries", "SELECT item_id AS query_id, cast(f AS integer) AS facet_no FROM benchmark, range(0, 8) t(f)")
def facet_queries(spark, sf_dir):
    from casegrid.operators.retrieval import facet_queries as fan

    return fan(A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "analytical").select("query_id", "facet_no")


@query("GEN11_injury_phrases", f"WITH {RECORDS} SELECT record_id, 'injury of priority ' || lower(priority) AS phrase FROM r UNION ALL SELECT record_id, 'priority ' || lower(priority) FROM r")
def injury_phrases(spark, sf_dir):
    from casegrid.operators.casefile import injury_phrases as phrases

    return A.records(spark, sf_dir).select("record_id", F.explode_outer(phrases(F.col("text"))).alias("phrase")).where(F.col("phrase").isNotNull())


@query("SRC1_documents_scan", "SELECT doc_id, source, length(text) AS n_chars FROM documents WHERE lang = 'en'")
def documents_scan(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source", F.length("text").alias("n_chars"))



