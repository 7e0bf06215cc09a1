"""Registry tables: statistics, set steps and copy-on-write mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from casegrid.sources import versions


def corpus_stats(runs: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """AGG1: one row of totals; every table is reduced on its own."""
    a = runs.agg(F.count_if(F.col("status") == "indexed").alias("indexed_runs"))
    b = documents.agg(F.count_if(F.col("status") == "indexed").alias("indexed_documents"))
    c = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("author").alias("authors"), F.min("date_extracted").alias("date_min"), F.max("date_extracted").alias("date_max"))
    one = F.lit(1).alias("one")
    return a.select("*", one).join(b.select("*", one), "one").join(c.select("*", one), "one").drop("one")


def runs_with_stats(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """AGG2/JN4: indexed runs with their chunks' statistics; a run without chunks stays."""
    by_run = chunks.groupBy("run_id").agg(F.count("*").alias("chunks"), F.countDistinct("author").alias("authors"), F.min("date_extracted").alias("date_min"), F.max("date_extracted").alias("date_max"))
    return runs.where("status = 'indexed'").join(by_run, "run_id", "left").fillna(0, ["chunks", "authors"])


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """MUT1-MUT3: rows of ``new`` replace those of the same key; columns in ``keep`` stay as they were on conflict."""
    if not keep:
        return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    n = new.select(F.col(key), *[F.col(c).alias(f"n_{c}") for c in new.columns if c != key], F.lit(True).alias("is_new"))
    both = old.withColumn("is_old", F.lit(True)).join(n, key, "full")
    pick = lambda c: F.when(F.col("is_new") & F.col("is_old").isNull(), F.col(f"n_{c}")).when(F.col("is_new") & F.lit(c not in keep), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(key, *[pick(c) for c in old.columns if c != key])


def replace_documents(old: DataFrame, new: DataFrame, listed: DataFrame) -> DataFrame:
    """MUT4: all chunks of the listed documents go, then the new ones come."""
    return old.join(listed.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new)


def retain_documents(documents: DataFrame, chunks: DataFrame, run: str, retained: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MUT5: of one run only the retained documents stay; chunks follow."""
    gone = documents.where(F.col("run_id") == run).join(retained.select("doc_id"), "doc_id", "left_anti").select("doc_id")
    return documents.join(gone, "doc_id", "left_anti"), chunks.join(gone, "doc_id", "left_anti")


def delete_run(tables: dict[str, DataFrame], run: Column) -> dict[str, DataFrame]:
    """MUT7: the run leaves every table."""
    return {name: t.where(~F.coalesce(run, F.lit(False))) for name, t in tables.items()}


def delete_all(tables: dict[str, DataFrame], root: str) -> int:
    """MUT13: publish every table, and the points, without rows and with the same columns."""
    return publish({name: t.where(F.lit(False)) for name, t in tables.items()}, root)


def point_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """MUT8/SET1/SET2: every point id of either side with what happens to it; a missing id is like none of the other side."""
    side = lambda t, was: t.select("point_id", F.lit(was).alias("was"), F.when(F.col("point_id").isNull(), F.lit(was)).alias("apart"))
    both = side(old, True).unionByName(side(new, False)).groupBy("point_id", "apart").agg(F.max("was").alias("was"), F.min("was").alias("gone"))
    return both.select("point_id", F.when(~F.col("was"), "new").when(F.col("gone"), "stale").otherwise("overwritten").alias("change"))


def guard_dimension(points: DataFrame, size: int, column: str = "vector") -> DataFrame:
    """MUT11: fails the job on a vector of another dimension."""
    return points.withColumn(column, F.when(F.size(column) == size, F.col(column)).otherwise(F.raise_error(F.lit(f"vector is not of dimension {size}")).cast("array<float>")))


def live_entries(cache: DataFrame, now: Column) -> DataFrame:
    """MUT12: the latest live entry of every key."""
    latest = F.row_number().over(W.partitionBy("key").orderBy(F.desc("written_at"), F.desc("value")))
    return cache.withColumn("r", latest).where((F.col("r") == 1) & (F.col("expires_at") > now)).drop("r")


def publish(tables: dict[str, DataFrame], root: str) -> int:
    """MUT9: the tables as one new version, committed under the next number; a failed step leaves the last version in place."""
    return versions.publish(next(iter(tables.values())).sparkSession, root, tables)


def published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    return versions.read(spark, root, name, at=version)
