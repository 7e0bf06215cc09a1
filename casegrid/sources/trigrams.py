"""A posting table of trigrams over a versioned table's texts: which hash buckets can hold a term, so that the others aren't read."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrid.operators import retrieval
from casegrid.sources import versions

#: Buckets of the posting table itself.
INDEX_BUCKETS = 64


def trigrams_of(term: str) -> set[str]:
    """The trigrams that any text with a match of the term holds, in lower case; wildcards and the escape sign part a term."""
    parts = re.split(r"[%_\\]", term.lower())
    return {p[i : i + 3] for p in parts for i in range(len(p) - 2)}


def _held(texts: DataFrame) -> DataFrame:
    """(trigram, bucket) of rows (bucket, text): each pair once a task before it is shuffled."""
    low = F.lower(F.col("text"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, 3)))
    return texts.where(F.length(low) > 2).select("bucket", F.explode(grams).alias("trigram")).distinct()


def build(spark: SparkSession, root: str, name: str = "chunks", text: str = "text") -> int:
    """RET4: index a table as it is now; the index's version.

    Of a trigram the numbers of its buckets are kept, as many as the table has
    at most. A later search also reads the buckets that have changed since.
    """
    at = versions.snapshot(spark, root)
    table = at.tables[name]
    rows = versions.read(spark, root, name, at=at).select(versions.bucket_of(table.key, table.buckets).alias("bucket"), F.col(text).alias("text"))
    postings = _held(rows).groupBy("trigram").agg(F.collect_set("bucket").alias("buckets")).withColumn("made_from", F.lit(at.number).cast("bigint"))
    made = versions.write_whole(postings, root, "trigram", INDEX_BUCKETS)
    return versions.commit(spark, root, lambda _: versions.Change(whole={f"{name}_trigrams": made}))


def candidates(spark: SparkSession, root: str, terms: Iterable[str], name: str = "chunks", at: versions.Snapshot | None = None) -> list[str]:
    """The buckets that can hold one of the terms; all of them if a term has no three letters in a row."""
    at = at or versions.snapshot(spark, root)
    files = at.tables[name].files
    wanted = [trigrams_of(t) for t in terms]
    index = at.tables.get(f"{name}_trigrams")
    if index is None or not all(wanted):
        return list(files)
    asked = spark.createDataFrame([(g,) for g in sorted(set().union(*wanted))], "trigram string")
    rows = versions.read_keys(spark, root, f"{name}_trigrams", asked, at=at).collect()  # a row for each trigram of the terms
    where = {r["trigram"]: {str(b) for b in r["buckets"]} for r in rows}
    found = set().union(*(set.intersection(*(where.get(g, set()) for g in grams)) for grams in wanted))
    if rows:
        then = versions.snapshot(spark, root, rows[0]["made_from"]).tables[name].files
    else:
        first = versions.read(spark, root, f"{name}_trigrams", at=at).select("made_from").first()
        then = versions.snapshot(spark, root, first[0]).tables[name].files if first else {}
    return [b for b in files if b in found or files[b] != then.get(b)]


def search(spark: SparkSession, root: str, terms: list[str], limit: int | None = None, name: str = "chunks") -> DataFrame:
    """RET4/SRT5/FLT5: as ``retrieval.lexical_search`` over the whole table, from the buckets that can hold a term."""
    at = versions.snapshot(spark, root)
    return retrieval.lexical_search(versions.read(spark, root, name, at=at, buckets=candidates(spark, root, terms, name, at)), terms, limit)
