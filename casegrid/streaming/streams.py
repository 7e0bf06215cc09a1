"""Structured Streaming: incremental ingest, progress of workers and of indexing, audit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrid.functions import textcols as T
from casegrid.operators import chunking, registry
from casegrid.sources import io, versions
from casegrid.workspace import discard, materialize

#: Hash buckets of the chunk and document tables that an ingest makes first; later ones keep what the table has.
INGEST_BUCKETS = 64


def markdown_stream(spark: SparkSession, incoming: str) -> DataFrame:
    """Markdown files that arrive in a folder: (original_filename, path, text)."""
    files = spark.readStream.text(incoming, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_name").alias("original_filename"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def ingest_batch(batch: DataFrame, batch_no: int, root: str, run_dir: str, *, stream: str = "ingest", buckets: int = INGEST_BUCKETS) -> int:
    """STR1: one batch of files (original_filename, path, text) into the versioned tables below ``root``; the version.

    Of files with one name the first path wins; a bad name, or a text without
    any chunk, is skipped and leaves the document as it was. One commit holds
    the chunks and the documents of the batch (only the hash buckets of these
    documents are read and written), the case's totals, and what changed for the
    vector store (point_changes: new, overwritten or stale). A batch that the
    log already holds is left out, so a batch that runs again counts once.
    """
    spark = batch.sparkSession
    latest = versions.snapshot(spark, root)
    if latest.marks.get(stream, -1) >= batch_no:
        return latest.number
    run = T.run_id(F.lit(run_dir))
    named = batch.where(F.col("original_filename").isNotNull() & io.upload_problem(F.col("original_filename"), F.lit(b"x")).isNull() & F.col("text").isNotNull())
    # texts are dealt out once: a name's files meet in the task that chunks the document
    files = chunking.deal(named.select(T.doc_id(run, F.col("original_filename")).alias("doc_id"), "original_filename", "path", "text"))
    first = files.groupBy("doc_id", "original_filename").agg(F.min_by("text", "path").alias("text"))
    docs = first.select(run.alias("run_id"), "doc_id", "original_filename", "text", F.lit("external_markdown").alias("provenance_type"))
    new = materialize(chunking.chunk_documents(docs, dealt=True), "chunks")
    # read by every step below, so it is counted once
    made = materialize(new.groupBy("doc_id", "run_id", "original_filename").agg(F.count("*").alias("chunks")).withColumn("status", F.lit("indexed")), "documents")

    def change(held: versions.Snapshot) -> versions.Change:
        old_chunks = versions.read_keys(spark, root, "chunks", made, at=held) if "chunks" in held.tables else new.limit(0)
        old_docs = versions.read_keys(spark, root, "documents", made, at=held) if "documents" in held.tables else made.limit(0)
        count = lambda t, sign: t.select(F.lit(run_dir).alias("run_dir"), F.lit(sign).alias("documents"), (F.col("chunks") * sign).alias("chunks"))
        moved = count(made, 1).unionByName(count(old_docs, -1))
        if "runs" in held.tables:
            was = versions.read(spark, root, "runs", at=held).where(F.col("run_dir") == run_dir)
            moved = moved.unionByName(was.select("run_dir", F.col("total_documents").alias("documents"), F.col("total_chunks").alias("chunks")))
        total = moved.groupBy("run_dir").agg(F.sum("documents").cast("bigint").alias("total_documents"), F.sum("chunks").cast("bigint").alias("total_chunks"))
        runs = total.select(T.run_id(F.col("run_dir")).alias("run_id"), "run_dir", "total_documents", "total_chunks", F.lit("indexed").alias("status"))
        points = lambda t: t.select(T.point_id(F.col("chunk_id")).alias("point_id"))
        diff = registry.point_diff(points(old_chunks), points(new)).withColumn("batch", F.lit(batch_no).cast("bigint"))
        return (
            versions.replace_keys(spark, root, held, "chunks", new, new, key="doc_id", buckets=buckets)
            | versions.replace_keys(spark, root, held, "documents", made, made, key="doc_id", buckets=buckets)
            | versions.replace_keys(spark, root, held, "runs", runs, runs, key="run_id", buckets=1)
            | versions.append(diff, root, "point_changes")
        )

    number = versions.commit(spark, root, change, mark=(stream, batch_no))
    discard(new, made)
    return number


def incremental_ingest(rows: DataFrame, root: str, run_dir: str, checkpoint: str, *, stream: str = "ingest", buckets: int = INGEST_BUCKETS):
    """STR1: what arrives in a stream of files replaces its documents in the versioned tables; each micro-batch is one commit."""
    write = lambda batch, no: ingest_batch(batch, no, root, run_dir, stream=stream, buckets=buckets)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def worker_counts(lines: DataFrame) -> DataFrame:
    """STR2: log lines (ts, line) -> the latest count of every (worker, state)."""
    got = lines.select("ts", F.regexp_extract("line", r"worker (\d+)", 1).alias("worker"), F.regexp_extract("line", r"(pending|completed|failed): (\d+)", 1).alias("state"), F.regexp_extract("line", r"(?:pending|completed|failed): (\d+)", 1).cast("bigint").alias("n"))
    return got.where("worker <> '' and state <> ''").groupBy("worker", "state").agg(F.max_by("n", F.struct("ts", "n")).alias("n"))


def total_progress(counts: DataFrame) -> DataFrame:
    return counts.groupBy("state").agg(F.sum("n").alias("n"))


def audit_windows(events: DataFrame, watermark: str = "1 day", window: str = "1 day") -> DataFrame:
    """STR3: (ts, action, latency) -> records and mean latency by action and tumbling window."""
    w = events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "action").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("latency"))
    return w.select(F.col("window.start").alias("window_start"), "action", "n", "latency")


def index_progress(lines: DataFrame) -> DataFrame:
    """STR4: log lines (run, line_no, line) -> chunks created (summed), vectors done (latest) and the last stage named."""
    got = lines.select("run", "line_no", F.regexp_extract("line", r"created (\d+) chunks", 1).try_cast("bigint").alias("chunks"), F.regexp_extract("line", r"embedded (\d+)", 1).try_cast("bigint").alias("vectors"), F.nullif(F.regexp_extract("line", r"stage: (\w+)", 1), F.lit("")).alias("stage"))
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    return got.groupBy("run").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), latest("vectors"), latest("stage"))


def run_to_table(result: DataFrame, path: str, checkpoint: str, after=lambda batch: batch) -> None:
    """Run a complete-mode stream over what is there; ``path`` holds the latest state."""
    def write(batch: DataFrame, _: int) -> None:
        after(batch).write.mode("overwrite").parquet(path)

    result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
