"""Drift between the chunk registry and the points."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casegrid.functions import textcols as T

CATEGORIES = ("chunks_without_point", "points_without_chunk", "duplicates", "nondeterministic_ids", "payload_mismatch", "incomplete_documents")


def chunks_without_point(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """REC1/JN7."""
    known = points.select("point_id").distinct()
    return chunks.where("point_id is null").unionByName(chunks.where("point_id is not null").join(known, "point_id", "left_anti").select(chunks.columns)).select("run_id", "chunk_id")


def points_without_chunk(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """REC2."""
    return points.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").select("run_id", "point_id")


def duplicate_point_refs(chunks: DataFrame) -> DataFrame:
    """REC3: points that several chunks name, for each run involved."""
    by_point = chunks.where("point_id is not null").groupBy("point_id").agg(F.count("*").alias("chunks")).where("chunks > 1")
    return chunks.join(by_point, "point_id", "left_semi").select("run_id", "point_id").distinct().join(by_point, "point_id")


def nondeterministic_ids(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """REC4: ids that don't follow from the chunk id, in the registry or in the points."""
    a = chunks.where(F.col("point_id").isNotNull() & (F.col("point_id") != T.point_id(F.col("chunk_id")))).select("run_id", "chunk_id", F.lit("registry").alias("side"))
    return a.unionByName(points.where(F.col("point_id") != T.point_id(F.col("chunk_id"))).select("run_id", "chunk_id", F.lit("points").alias("side")))


def duplicate_points(points: DataFrame) -> DataFrame:
    """REC5."""
    return points.groupBy("run_id", "chunk_id").agg(F.count("*").alias("points")).where("points > 1")


def payload_mismatch(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """REC6."""
    c = chunks.select("chunk_id", F.col("point_id").alias("c_point"), F.col("doc_id").alias("c_doc"), F.col("run_id").alias("c_run"))
    wrong = ~F.col("point_id").eqNullSafe(F.col("c_point")) | ~F.col("doc_id").eqNullSafe(F.col("c_doc")) | ~F.col("run_id").eqNullSafe(F.col("c_run"))
    return points.join(c, "chunk_id").where(wrong).select("run_id", "chunk_id", "point_id")


def incomplete_documents(documents: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """REC7: indexed documents without chunks, or with a chunk whose point is missing or belongs elsewhere."""
    p = points.select(F.col("point_id"), F.col("chunk_id").alias("p_chunk"), F.col("run_id").alias("p_run")).dropDuplicates(["point_id"])
    state = chunks.join(p, "point_id", "left").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("p_chunk").isNull() | (F.col("p_chunk") != F.col("chunk_id")) | (F.col("p_run") != F.col("run_id"))).alias("bad"))
    return documents.where("status = 'indexed'").join(state, "doc_id", "left").where("chunks is null or bad > 0").select("run_id", "doc_id", F.coalesce("bad", F.lit(0)).cast("bigint").alias("bad_chunks"))


def reconcile(documents: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """REC8/AGG11: (run_id, category, issues), and for runs that only the points know a status of their own."""
    tagged = [
        chunks_without_point(chunks, points).select("run_id", F.lit(CATEGORIES[0]).alias("category")), points_without_chunk(chunks, points).select("run_id", F.lit(CATEGORIES[1]).alias("category")),
        duplicate_point_refs(chunks).select("run_id", F.lit(CATEGORIES[2]).alias("category")), duplicate_points(points).select("run_id", F.lit(CATEGORIES[2]).alias("category")),
        nondeterministic_ids(chunks, points).select("run_id", F.lit(CATEGORIES[3]).alias("category")), payload_mismatch(chunks, points).select("run_id", F.lit(CATEGORIES[4]).alias("category")),
        incomplete_documents(documents, chunks, points).select("run_id", F.lit(CATEGORIES[5]).alias("category")),
    ]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    counted = every.groupBy("run_id", "category").agg(F.count("*").alias("issues"))
    registered = documents.select("run_id", F.lit("registered").alias("status")).distinct()
    runs = registered.join(points.select("run_id").distinct(), "run_id", "full").select("run_id", F.coalesce("status", F.lit("points-only")).alias("status"))
    grid = runs.select("*", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    return grid.join(counted, ["run_id", "category"], "left").select("run_id", "status", "category", F.coalesce("issues", F.lit(0)).cast("bigint").alias("issues"))
