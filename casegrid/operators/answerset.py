"""RET13: from questions with a mode to each question's ranked evidence, all questions and modes in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from casegrid.functions import patterns as P
from casegrid.operators import retrieval

#: Facets of one question, at most, with the question itself.
_FACETS = 16


def policy_table(spark: SparkSession) -> DataFrame:
    """JN13: a row for each mode: facets (null: one plain search), least_hits, threshold, rerank, retrieves."""
    rows = [(mode, list(P.FACETS[kind]) if kind else None, k, t, again, True) for mode, (kind, k, t, again) in P.MODES.items()]
    return spark.createDataFrame([*rows, (P.NO_RETRIEVAL_MODE, None, 0, 0.0, False, False)], "mode string, facets array<string>, least_hits int, threshold double, rerank boolean, retrieves boolean")


def with_policy(asked: DataFrame) -> DataFrame:
    """JN13: questions (mode and other columns) with the policy of their mode; an unknown or missing mode is taken for the default one."""
    policies = policy_table(asked.sparkSession)
    known = F.coalesce("mode", F.lit(P.DEFAULT_MODE)).isin(*P.MODES, P.NO_RETRIEVAL_MODE)
    named = asked.withColumn("mode", F.when(known, F.coalesce("mode", F.lit(P.DEFAULT_MODE))).otherwise(P.DEFAULT_MODE))
    return named.join(F.broadcast(policies), "mode")  # one row a mode


def subqueries(asked: DataFrame) -> DataFrame:
    """GEN10: (query_id, facet_no, subquery, k, threshold): every question as itself (0) and, by its mode, once for each facet.

    A facet's search takes a third of the hits asked for, within P.FACET_HITS.
    """
    low, high = P.FACET_HITS
    rows = with_policy(asked).where("retrieves").withColumn("hits", F.greatest(F.coalesce("top_k", F.lit(0)), "least_hits"))
    texts = F.concat(F.array("text"), F.transform(F.coalesce("facets", F.array().cast("array<string>")), lambda f: F.concat(F.col("text"), F.lit(P.FACET_LEAD), f)))
    k = F.when(F.col("facets").isNull(), F.col("hits")).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.col("hits") / 3)))).cast("int")
    return rows.select("query_id", "mode", "hits", "rerank", F.col("facets").isNotNull().alias("many"), k.alias("k"), "threshold", F.posexplode(texts).alias("facet_no", "subquery"), F.col("text").alias("question"))


def _named(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Lexical hits of the fixed headings, for the questions that ask about imaging."""
    low, high = P.NAMED_HITS
    hits = retrieval.lexical_search(chunks, list(P.IMAGING_TERMS), limit=high)  # the same few for every question
    place = F.row_number().over(W.orderBy(F.desc("score"), "chunk_index", "chunk_id"))
    hits = hits.withColumn("place", place).select("chunk_id", "document_type", "score", "place")
    wants = asked.where("many").where(F.size(retrieval.targeted_terms(F.col("question"))) > 0).select("query_id", F.greatest(F.lit(low), F.least(F.lit(high), F.col("hits"))).alias("most"))
    return wants.join(F.broadcast(hits), F.col("place") <= F.col("most")).select("query_id", "chunk_id", "document_type", "score")


def answer_set(asked: DataFrame, vectors: DataFrame, points: DataFrame, chunks: DataFrame, logits: DataFrame | None = None, *, mmr: bool = True) -> DataFrame:
    """RET13: (query_id, mode, rank, chunk_id, score, primary_evidence, facets) of every question that its mode gives hits.

    ``asked``: query_id bigint, mode, text, top_k. ``vectors``: query_id,
    facet_no, query_vector for the rows of ``subqueries`` (one without a vector
    is not searched). ``points``: item_id, vector. ``chunks``: item_id, chunk_id,
    chunk_index, doc_id, document_type, author, date_extracted, text. ``logits``:
    chunk_id, logit and, where they differ by question, query_id, used where the
    mode reranks. Hits per search, thresholds, facets and switches come from the
    mode's policy as columns.

    A search takes twice its hits and keeps the most relevant and different ones
    (``mmr=False``: the best scores). A mode without facets ends there; others
    merge their facets, add named reports, drop duplicates, spread over documents
    and, if the mode says so, rerank.
    """
    subs = subqueries(asked)
    at = (F.col("query_id") * _FACETS + F.col("facet_no")).alias("sub_id")
    sized = subs.select("query_id", "facet_no", "k", "threshold", at)
    search = vectors.join(sized, ["query_id", "facet_no"]).select(F.col("sub_id").alias("query_id"), "query_vector", (F.col("k") * (2 if mmr else 1)).alias("k"), "threshold")
    found = retrieval.vector_search(search, points)
    if mmr:
        texts = found.join(chunks.select("item_id", "text"), "item_id").join(sized.select(F.col("sub_id").alias("query_id"), "k"), "query_id")
        chosen = retrieval.mmr(texts.select("query_id", F.col("rank").cast("bigint").alias("ord"), "score", "text", "k"))
        found = found.join(chosen.select("query_id", F.col("ord").cast("int").alias("rank"), "mmr_rank"), ["query_id", "rank"])
    else:
        found = found.withColumn("mmr_rank", F.col("rank"))
    own = subs.select("query_id", "mode", "hits", "rerank", "many", "question").distinct()
    place = chunks.select("item_id", "chunk_id", "doc_id", "document_type", "author", "date_extracted", "text")
    hits = found.select(F.floor(F.col("query_id") / _FACETS).cast("bigint").alias("query_id"), (F.col("query_id") % _FACETS).cast("int").alias("facet_no"), "item_id", "score", F.col("mmr_rank").cast("int").alias("rank"))
    hits = hits.join(place.select("item_id", "chunk_id"), "item_id").join(own.select("query_id", "many"), "query_id")

    one = hits.where("NOT many").select("query_id", "rank", "chunk_id", "score", F.lit(False).alias("primary_evidence"), F.array("facet_no").alias("facets"))
    merged = retrieval.facet_merge(hits.where("many").select("query_id", "chunk_id", "facet_no", "score"))
    both = retrieval.hybrid_merge(merged.select("query_id", "chunk_id", "score"), _named(own, chunks))
    both = both.join(merged.select("query_id", "chunk_id", F.col("retrieval_facets").alias("facets")), ["query_id", "chunk_id"], "left")
    whole = both.join(place.drop("item_id"), "chunk_id").join(own.select("query_id", "hits", "rerank"), "query_id")
    spread = retrieval.diversify(retrieval.drop_duplicates(whole), F.col("hits")).select("query_id", "rank", "chunk_id", "score", "primary_evidence", "facets", "rerank")
    if logits is not None:
        kept = spread.where("rerank").drop("rank")
        again = retrieval.primary_floor(retrieval.rerank(kept, logits).drop("rank"))
        spread = spread.where("NOT rerank").unionByName(again.select(spread.columns))
    out = one.unionByName(spread.select(one.columns))
    return out.join(own.select("query_id", "mode"), "query_id").select("query_id", "mode", "rank", "chunk_id", "score", "primary_evidence", F.coalesce("facets", F.array().cast("array<int>")).alias("facets"))
