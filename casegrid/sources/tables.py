"""The registry's tables: their layout, and reads of whole sets of cases or documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrid.sources import versions

#: The columns of every table.
SCHEMAS = {
    "runs": "run_id string, run_dir string, created_at timestamp, indexed_at timestamp, total_documents int, total_chunks int, status string",
    "documents": "doc_id string, run_id string, original_filename string, pdf_total_pages int, markdown_path string, minio_pdf_key string, minio_md_key string, olmocr_version string, created_at timestamp, indexed_at timestamp, status string, metadata_json string",
    "chunks": "chunk_id string, doc_id string, run_id string, chunk_index int, text string, char_start int, char_end int, source_char_start int, source_char_end int, page_number int, page_start int, page_end int, provenance_type string, "
    "document_type string, author string, date_extracted date, date_raw string, section_type string, patient_name string, token_count int, embedding_model string, qdrant_point_id string, created_at timestamp",
}


def write_tables(spark: SparkSession, root: str) -> int:
    """SNK1: publish every table with its columns; tables that are there keep their rows and gain missing columns as nulls.

    A document without a status, or pending although indexed, is set to what
    its ``indexed_at`` says. Columns that the layout doesn't know stay.
    """
    indexed = F.col("indexed_at").isNotNull()
    status = F.when(F.col("status").isNull() | (indexed & (F.col("status") == "pending")), F.when(indexed, "indexed").otherwise("pending")).otherwise(F.col("status"))

    def evolved(held: dict[str, DataFrame]) -> dict[str, DataFrame]:
        empty = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
        made = {name: e.unionByName(held[name], allowMissingColumns=True) if name in held else e for name, e in empty.items()}
        return made | {"documents": made["documents"].withColumn("status", status)}

    return versions.rewrite(spark, root, evolved)


def chunks_for_runs(chunks: DataFrame, documents: DataFrame, runs: DataFrame) -> DataFrame:
    """SRC3: every chunk of the given cases with its document's file name, in stable source order."""
    named = documents.select("doc_id", "original_filename")
    mine = chunks.join(runs.select("run_id"), "run_id", "left_semi")
    return mine.join(named, "doc_id").orderBy("run_id", "original_filename", "doc_id", "chunk_index")


def documents_for_runs(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """SRC9: the documents of the given cases by file name."""
    return documents.join(runs.select("run_id"), "run_id", "left_semi").orderBy("run_id", "original_filename")


def chunks_for_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """SRC10: the chunks of the given documents by position."""
    return chunks.join(documents.select("doc_id"), "doc_id", "left_semi").orderBy("doc_id", "chunk_index")


def point_ids_for_runs(points: DataFrame, runs: DataFrame) -> DataFrame:
    """SRC11: every point id of the given cases, once."""
    return points.select("run_id", "point_id").join(runs.select("run_id"), "run_id", "left_semi").distinct()
