"""One handle for a store of cases: index, read, summarise, reconcile, delete; every answer is a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrid.functions import textcols as T
from casegrid.operators import casefile, chronology, reconcile, registry
from casegrid.sources import io, versions
from casegrid.streaming import streams


class Corpus:
    """The versioned tables below ``root`` (chunks, documents, runs, point_changes) and what can be asked of them.

    ``cases`` are run folders, as they were indexed; without them a question is
    asked of all cases. ``at`` reads an earlier version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def index(self, files: DataFrame, case: str) -> int:
        """Files (original_filename, text and, to choose among equal names, path) as documents of a case; the new version."""
        rows = files if "path" in files.columns else files.withColumn("path", F.col("original_filename"))
        return streams.ingest_batch(rows, 0, self.root, case, stream=f"index-{uuid.uuid4().hex}")

    def index_folder(self, folder: str, case: str) -> int:
        """All Markdown files of a folder."""
        return self.index(io.scan_markdown(self.spark, folder), case)

    def follow(self, folder: str, case: str, checkpoint: str):
        """Take in what has arrived in a folder since the last time; the streaming query."""
        return streams.incremental_ingest(streams.markdown_stream(self.spark, folder), self.root, case, checkpoint, stream=checkpoint)

    def versions(self) -> list[int]:
        return versions.history(self.spark, self.root)

    def table(self, name: str, cases: list[str] | None = None, at: int | None = None) -> DataFrame:
        held = versions.read(self.spark, self.root, name, at=at)
        return held if cases is None else held.where(F.col("run_id").isin([self.case_id(c) for c in cases]))

    def case_id(self, case: str) -> str:
        return self.spark.range(1).select(T.run_id(F.lit(case))).first()[0]

    def chunks(self, cases: list[str] | None = None, at: int | None = None) -> DataFrame:
        return self.table("chunks", cases, at)

    def stats(self) -> DataFrame:
        """One row of totals (AGG1)."""
        return registry.corpus_stats(self.table("runs"), self.table("documents"), self.chunks())

    def cases(self) -> DataFrame:
        """Every case with the statistics of its chunks (AGG2)."""
        return registry.runs_with_stats(self.table("runs"), self.chunks())

    def dashboard(self, cases: list[str] | None = None) -> DataFrame:
        """A row for each case: client, birth date, injuries, counts and dates (AGG16)."""
        chunks = self.chunks(cases)
        found = chunks.groupBy("run_id").agg(F.countDistinct("author").alias("unique_authors"), F.min("date_extracted").alias("earliest_date"), F.max("date_extracted").alias("latest_date"))
        return casefile.case_dashboard(self.table("runs", cases).join(found, "run_id", "left"), casefile.case_metadata(chunks, "chunk_id"))

    def timeline(self, cases: list[str] | None = None) -> DataFrame:
        """Dated documents of each case (CASE4)."""
        return casefile.case_timeline(self.chunks(cases))

    def chronology(self, cases: list[str] | None = None) -> DataFrame:
        """Dated events of each case without a model (CHR2)."""
        return chronology.rule_chronology(chronology.prepare_case(self.chunks(cases)))

    def point_ids(self, cases: list[str] | None = None) -> DataFrame:
        """The point that each chunk should have in the vector store."""
        return self.chunks(cases).select("run_id", "doc_id", "chunk_id", T.point_id(F.col("chunk_id")).alias("point_id"))

    def reconcile(self, points: DataFrame) -> DataFrame:
        """Drift between the chunks and ``points`` (point_id, chunk_id, doc_id, run_id), by case and category (REC8)."""
        return reconcile.reconcile(self.table("documents").select("doc_id", "run_id", "status"), self.point_ids(), points)

    def delete(self, case: str) -> int:
        """Take a case out of every table; its points are listed as stale in point_changes. The new version."""
        run = self.case_id(case)

        def change(held: versions.Snapshot) -> versions.Change:
            read = lambda name: versions.read(self.spark, self.root, name, at=held)
            docs = read("documents").where(F.col("run_id") == run)
            gone = versions.read_keys(self.spark, self.root, "chunks", docs, at=held)
            stale = gone.select(T.point_id(F.col("chunk_id")).alias("point_id"), F.lit("stale").alias("change"), F.lit(-1).cast("bigint").alias("batch"))
            drop = lambda name, key, keys: versions.replace_keys(self.spark, self.root, held, name, keys, read(name).limit(0), key=key, buckets=1)
            runs = read("runs").where(F.col("run_id") == run)
            return drop("chunks", "doc_id", docs) | drop("documents", "doc_id", docs) | drop("runs", "run_id", runs) | versions.append(stale, self.root, "point_changes")

        return versions.commit(self.spark, self.root, change)
