"""Readers and writers of case folders, logs and reports, all through Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Upload limits and the extension that is taken.
MOST_FILE_BYTES, MOST_FILES, EXTENSION = 20 * 1024 * 1024, 200, ".md"
MISSING_RUN = "<missing-run-id>"
OCR_SCHEMA = "metadata struct<`Source-File`:string>, attributes struct<pdf_page_numbers:array<array<int>>>"


def scan_markdown(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: (original_filename, text), one row a Markdown file, sorted by name."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_name").alias("original_filename"), F.col("value").alias("text")).orderBy("original_filename")


def scan_ocr_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: (original_filename, page_ranges) of OCR result lines; lines that are no JSON or name no file are left out."""
    lines = spark.read.schema(OCR_SCHEMA).json(path, mode="PERMISSIVE")
    base = F.element_at(F.split("metadata.Source-File", "/"), -1)
    pages = F.transform(F.filter("attributes.pdf_page_numbers", lambda r: F.size(r) >= 3), lambda r: F.struct(F.get(r, F.lit(0)).alias("start"), F.get(r, F.lit(1)).alias("end"), F.get(r, F.lit(2)).alias("page")))
    return lines.where(base.isNotNull()).select(base.alias("original_filename"), F.coalesce(pages, F.array().cast("array<struct<start:int,end:int,page:int>>")).alias("page_ranges"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def object_inventory(spark: SparkSession, path: str, buckets: list[str]) -> DataFrame:
    """SRC6: objects and bytes of each bucket (folder below ``path``); a missing bucket has zeros."""
    bucket = F.regexp_extract("path", r".*/([^/]+)/[^/]+$", 1)
    counted = _files(spark, path).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("objects"), F.sum("length").alias("bytes"))
    return spark.createDataFrame([(b,) for b in buckets], "bucket string").join(counted, "bucket", "left").fillna(0, ["objects", "bytes"])


def write_points(points: DataFrame, path: str, page_rows: int = 10_000) -> None:
    """SRC4: points in folders by case, in files of at most ``page_rows`` rows sorted by id: the pages that a scroll reads. A point without a case is kept under MISSING_RUN."""
    held = points.withColumn("run", F.coalesce(F.nullif(F.trim("run_id"), F.lit("")), F.lit(MISSING_RUN)))
    held.hint("rebalance", F.col("run")).sortWithinPartitions("run", "point_id").write.partitionBy("run").option("maxRecordsPerFile", page_rows).parquet(path)


def scan_points(spark: SparkSession, path: str, schema: str, runs: list[str] | None = None) -> DataFrame:
    """SRC4: every point, with its case in ``run``; of the given cases only, whose folders alone are read. Columns and filters that follow reach the files."""
    held = spark.read.schema(f"{schema}, run string").option("basePath", path).parquet(path)
    return held if runs is None else held.where(F.col("run").isin(*runs))


def scroll_points(points: DataFrame, page: int, after: str | None = None) -> DataFrame:
    """SRC4: the next ``page`` points by id after the one named; the last id of a page asks for the next."""
    rest = points if after is None else points.where(F.col("point_id") > after)
    return rest.orderBy("point_id").limit(page)


def human_size(size: Column) -> Column:
    """SRC7: bytes with a unit."""
    unit = lambda n: F.concat(F.format_number(size / 1024**n, 2), F.lit(f" {'KMGT'[n - 1]}B"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, unit(1)).when(size < 1024**3, unit(2)).when(size < 1024**4, unit(3)).otherwise(unit(4))


def folder_sizes(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: bytes of every folder that holds files, with a readable size."""
    by = _files(spark, path).groupBy(F.regexp_extract("path", r"(.*)/[^/]+$", 1).alias("folder")).agg(F.sum("length").alias("bytes"))
    return by.withColumn("size", human_size(F.col("bytes")))


def upload_problem(name: Column, content: Column) -> Column:
    """SRC8: the first reason to refuse a file (name string, content binary), or null."""
    text = F.try_validate_utf8(content.cast("string"))
    return (
        F.when(~name.rlike(r"^[^/\\\x00-\x1f]{1,200}$") | name.startswith("."), "bad name").when(~F.lower(name).endswith(EXTENSION), "wrong extension").when(F.octet_length(content) > MOST_FILE_BYTES, "too large")
        .when(text.isNull(), "not UTF-8").when(text.rlike(r"[\x00-\x08\x0B\x0E-\x1F\x7F]"), "control characters")
    )


def write_timeline_csv(timeline: DataFrame, path: str) -> None:
    """SNK2."""
    timeline.write.csv(path, header=True, escape='"')


def write_report_json(report: DataFrame, path: str) -> None:
    """SNK4."""
    report.write.json(path)


def append_audit(records: DataFrame, path: str) -> None:
    """SNK5: one JSON object a line."""
    records.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp timestamp, action string, outcome string, details map<string,string>").json(path)
