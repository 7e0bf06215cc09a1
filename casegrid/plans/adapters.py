"""The case model's tables, derived from the given ones.

runs, case documents, chunks, points, queries, messages and letters are plain
DataFrames over the Parquet tables, so every query's work grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casegrid.functions import textcols as T
from casegrid.operators import chunking

PAGE_CHARS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a case: a source is a case, a document a Markdown file."""
    docs = table(spark, sf_dir, "documents")
    run_dir = F.concat(F.lit("/ws/"), F.coalesce("source", F.lit("unsorted")))
    run = T.run_id(run_dir)
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(
        run_dir.alias("run_dir"), run.alias("run_id"), T.doc_id(run, name).alias("doc_id"), name.alias("original_filename"), F.col("doc_id").alias("source_doc"),
        "text", F.lit("original_pdf").alias("provenance_type"),
        F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / PAGE_CHARS).cast("int"))), lambda i: F.struct((i * PAGE_CHARS).alias("start"), ((i + 1) * PAGE_CHARS).alias("end"), (i + 1).alias("page"))).alias("page_ranges"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases; every fifth one is still pending."""
    docs = table(spark, sf_dir, "documents").where("source is not null")
    run_dir = F.concat(F.lit("/ws/"), F.col("source"))
    by_case = docs.groupBy("source").agg(F.count("*").alias("total_documents"), F.min("doc_id").alias("first_doc"))
    status = F.when(F.col("first_doc") % 5 == 4, "pending").otherwise("indexed")
    return by_case.select(T.run_id(run_dir).alias("run_id"), run_dir.alias("run_dir"), "total_documents", status.alias("status"), "first_doc")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(case_documents(spark, sf_dir))


def letters_name(key: Column, width: int) -> Column:
    """A name of letters only for a number."""
    low = F.translate(F.lpad(key.cast("string"), width, "0"), "0123456789", "abcdefghij")
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 100))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as consultation letters, with the values that the letters are made of."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    o = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    patient = F.concat_ws(" ", letters_name(F.col("o_custkey"), 6), letters_name(F.col("c_nationkey"), 3))
    doctor = letters_name(F.col("o_custkey") % 97, 4)
    date = F.date_format("o_orderdate", "dd/MM/yyyy")
    text = F.concat(
        date, F.lit(" consultation attended for treatment\nRe: "), patient, F.lit(" DOB: 01/02/1970\n\nDear Dr Smith\nClaim No: C"), F.col("o_orderkey").cast("string"),
        F.lit("\nClinic: "), F.col("c_mktsegment"), F.lit("\n\nOn examination pain was reported on "), date, F.lit(". Diagnosis: injury of priority "), F.lower("o_orderpriority"), F.lit("\n\nKind regards\n\nDr "), doctor,
    )
    case = F.concat(F.lit("/ws/nation"), F.col("c_nationkey").cast("string"))
    return o.select(
        F.col("o_orderkey").alias("record_id"), T.run_id(case).alias("run_id"), case.alias("run_dir"), F.col("o_custkey").alias("cust"), F.col("c_nationkey").alias("nation"),
        T.chunk_id(F.col("o_custkey").cast("string"), F.col("o_orderkey")).alias("chunk_id"), T.doc_id(T.run_id(case), F.col("o_custkey").cast("string")).alias("doc_id"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".md")).alias("original_filename"), F.col("o_orderdate").cast("date").alias("order_date"), patient.alias("patient"), doctor.alias("doctor"), text.alias("text"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as points of the document with the same number; every 11th is an orphan of a run that no registry knows."""
    e = table(spark, sf_dir, "embeddings")
    orphan = F.col("vec_id") % 11 == 10
    chunk = T.chunk_id(F.concat(F.lit("doc-"), F.col("vec_id").cast("string")), F.lit(0))
    return e.select(
        "vec_id", F.col("embedding").alias("vector"), "label", F.when(orphan, F.concat(F.lit("orphan-"), F.col("vec_id").cast("string"))).otherwise(chunk).alias("chunk_id"),
        F.when(F.col("vec_id") % 13 == 12, F.concat(F.lit("odd-"), F.col("vec_id").cast("string"))).otherwise(T.point_id(chunk)).alias("point_id"),
        F.when(orphan, F.lit("run-lost")).otherwise(F.concat(F.lit("run-"), (F.col("vec_id") % 20).cast("string"))).alias("run_id"), F.concat(F.lit("doc-"), F.col("vec_id").cast("string")).alias("doc_id"),
    )


def registry(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Registry of the points: every 7th chunk has lost its point, every 17th shares one, every 19th document is pending."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = F.col("doc_id")
    name, run = F.concat(F.lit("doc-"), n.cast("string")), F.concat(F.lit("run-"), (n % 20).cast("string"))
    chunk = T.chunk_id(name, F.lit(0))
    documents = docs.select(name.alias("doc_id"), run.alias("run_id"), F.when(n % 19 == 18, "pending").otherwise("indexed").alias("status"))
    point = F.when(n % 7 == 6, F.lit(None)).when(n % 17 == 16, F.lit("shared-point")).otherwise(T.point_id(chunk))
    held = docs.select(n.alias("number"), chunk.alias("chunk_id"), name.alias("doc_id"), run.alias("run_id"), point.alias("point_id"))
    return {"documents": documents, "chunks": held}


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th embedding is a query."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat sessions; assistants cite sources and every third turn is general knowledge."""
    c = table(spark, sf_dir, "conversations")
    tag = F.concat(F.lit(" [Source "), (F.col("turn") % 4).cast("string"), F.lit(", "), (F.col("turn") + 1).cast("string"), F.lit("]"))
    content = F.when(F.col("role") == "assistant", F.concat(F.coalesce("text", F.lit("")), tag)).otherwise(F.coalesce("text", F.lit("")))
    return c.select(F.col("conv_id").alias("session_id"), "turn", "role", content.alias("content"), F.when(F.col("turn") % 3 == 2, "general_knowledge").otherwise("free_qa").alias("mode"))
