"""Retrieval: exact cosine top-k, lexical scoring, facet merge, duplicates, diversity, reranking, context."""

from __future__ import annotations

from itertools import groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from casegrid.functions import patterns as P, textcols as T

#: At most so many queries are sent to all tasks.
SENT_QUERIES = 2048
#: Where there are more, one task scores so many queries, which ask for so many hits together, at once.
QUERY_BLOCK, BLOCK_HITS = 4096, 1 << 20
#: Tasks for each core at least, if there are few blocks of queries.
TASKS = 3


def facet_queries(queries: DataFrame, kind: str) -> DataFrame:
    """GEN10: a query as itself (facet 0) and once for each facet of its kind."""
    facets = F.array(F.lit(None).cast("string"), *[F.lit(f) for f in P.FACETS[kind]])
    rows = queries.select("*", F.posexplode(facets).alias("facet_no", "facet"))
    return rows.withColumn("subquery", F.concat_ws(P.FACET_LEAD, "text", "facet"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length one; a zero vector stays zero."""
    if not len(column):
        return np.empty((0, 0))
    width = pc.list_value_length(column)
    if column.null_count or pc.count_distinct(width).as_py() > 1:
        raise ValueError("vectors need one length")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


_FOUND = "query_id bigint, item_id bigint, score double"


class _Best:
    """The best points so far of each query of a block, by its own (k, threshold)."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: np.ndarray, least: np.ndarray):
        self.ids, self.q, self.k = ids, q, k
        self.bound = np.where(k > 0, least, np.inf)
        self.row, self.item, self.score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.new, self.size = [], 0
        self.most, self.step = max(1 << 18, int(k.sum())), max(64, min(4096, (1 << 20) // max(1, len(q))))

    def add(self, items: np.ndarray, x: np.ndarray) -> None:
        for low in range(0, len(items), self.step):
            scores = self.q @ x[low : low + self.step].T
            row, at = np.nonzero(scores >= (self.bound - 1e-6)[:, None])
            score = np.round(scores[row, at], 6)
            held = score >= self.bound[row]
            self.new.append((row[held], items[low + at[held]], score[held]))
            self.size += int(held.sum())
            if self.size > self.most:
                self._trim()

    def _trim(self) -> None:
        row, item, score = (np.concatenate(c) for c in zip((self.row, self.item, self.score), *self.new, strict=True))
        order = np.lexsort((item, -score, row))
        row, item, score = row[order], item[order], score[order]
        first = np.searchsorted(row, np.arange(len(self.k) + 1))
        top = np.arange(len(row)) - first[row] < self.k[row]
        full = np.flatnonzero((np.diff(first) >= self.k) & (self.k > 0))
        self.bound[full] = np.maximum(self.bound[full], score[first[full] + self.k[full] - 1])
        self.row, self.item, self.score, self.new, self.size = row[top], item[top], score[top], [], 0

    def batch(self) -> pa.RecordBatch:
        self._trim()
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.item), pa.array(self.score)], ["query_id", "item_id", "score"])


def _best(queries: pa.Table | pa.RecordBatch) -> _Best:
    k, least = queries.column("k").fill_null(0).to_numpy(), queries.column("threshold").fill_null(-np.inf).to_numpy()
    vectors = queries.column("query_vector")
    return _Best(queries.column("query_id").to_numpy().astype(np.int64), _matrix(vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors), k.astype(np.int64), least.astype(np.float64))


def _best_of_batches(queries: pa.Table):
    """A task's points, batch by batch -> its best for each query."""

    def run(batches):
        best = _best(queries)
        for batch in batches:
            best.add(batch.column("item_id").to_numpy(), _matrix(batch.column("vector")))
        yield best.batch()

    return run


def _best_of_blocks(batches):
    """Rows by task, a task's queries first, then its points -> the best of each of its queries."""
    for _, parts in groupby(_pieces(batches), lambda p: p[0]):
        asked, best = [], None
        for _, side, part in parts:
            if side == 0:
                asked.append(part)
            elif asked:
                best = best or _best(pa.Table.from_batches(asked).rename_columns(["task", "side", "query_id", "query_vector", "k", "threshold"]))
                best.add(part.column("id").to_numpy(), _matrix(part.column("vector")))
        if best is not None:
            yield best.batch()


def _pieces(batches):
    """(task, side, rows) of each run of rows of one task and side."""
    for batch in batches:
        task, side = (batch.column(c).to_numpy() for c in ("task", "side"))
        cuts = [0, *(np.flatnonzero((np.diff(task) != 0) | (np.diff(side) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            if b > a:
                yield task[a], side[a], batch.slice(a, b - a)


def vector_search(queries: DataFrame, points: DataFrame, k: int | None = None, threshold: float | None = None, shares: int | None = None) -> DataFrame:
    """RET3/SRT4: (query_id, item_id, score, rank), exact; ties by the smaller id.

    ``queries``: query_id, query_vector and, where they differ by query, k and
    threshold (null: none). ``points``: item_id, vector; filters go on ``points``
    before. Up to SENT_QUERIES queries are sent to the points, which stay where
    they are; a task sends back at most k a query. More queries meet the points
    in blocks, in shares of the points by hash. Vectors hold numbers and have one length.
    """
    most = F.col("k").cast("int") if k is None else F.lit(k)
    least = F.col("threshold").cast("double") if "threshold" in queries.columns else F.lit(threshold).cast("double")
    queries = queries.select("query_id", "query_vector", most.alias("k"), least.alias("threshold"))
    first = queries.limit(SENT_QUERIES + 1).toArrow()
    if first.num_rows <= SENT_QUERIES and shares is None:
        if not first.num_rows:
            return points.limit(0).select(F.lit(0).cast("bigint").alias("query_id"), F.col("item_id").cast("bigint"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        found = points.select(F.col("item_id").cast("bigint").alias("item_id"), "vector").mapInArrow(_best_of_batches(first), _FOUND)
    else:
        found = _by_blocks(queries, points, shares)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    ranked = found.withColumn("rank", rank)
    if k is not None:
        return ranked.where(F.col("rank") <= k)
    return ranked.join(queries.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k")).drop("k")


def _by_blocks(queries: DataFrame, points: DataFrame, shares: int | None) -> DataFrame:
    """Every block of queries meets every share of the points once; a share's best k a query.

    The points are dealt out once for each block. There are no more shares than give all cores work, so what the tasks
    send back keeps its proportion to the queries; a task holds its block's queries and their best, and reads its points as they come.
    """
    spark = points.sparkSession
    n, hits = queries.agg(F.count("*"), F.coalesce(F.sum(F.col("k").cast("bigint")), F.lit(0))).first()
    blocks = max(1, -(-n // QUERY_BLOCK), -(-hits // BLOCK_HITS))
    shares = shares or max(1, -(-TASKS * spark.sparkContext.defaultParallelism // blocks))
    task = lambda block, share: (block * shares + share).cast("int").alias("task")
    of = lambda key, most: F.pmod(F.xxhash64(key), F.lit(most))
    every = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    kind = "array<double>" if "double" in points.schema["vector"].dataType.simpleString() + queries.schema["query_vector"].dataType.simpleString() else "array<float>"
    asked = queries.withColumn("share", every(shares)).select(task(of("query_id", blocks), F.col("share")), F.lit(0).alias("side"), F.col("query_id").cast("bigint").alias("id"), F.col("query_vector").cast(kind).alias("vector"), "k", "threshold")
    # every point meets every block of queries: the only product in here, and its second side is counted in blocks of queries
    met = points.withColumn("block", every(blocks)).select(task(F.col("block"), of("item_id", shares)), F.lit(1).alias("side"), F.col("item_id").cast("bigint").alias("id"), F.col("vector").cast(kind).alias("vector"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("threshold"))
    return asked.unionByName(met).repartitionById(blocks * shares, F.col("task")).sortWithinPartitions("task", "side").mapInArrow(_best_of_blocks, _FOUND)


def lexical_search(chunks: DataFrame, terms: list[str], limit: int | None = None) -> DataFrame:
    """RET4/FLT5: share of the terms that a text holds, any match; % and _ in a term stay wildcards."""
    hits = [F.col("text").ilike(f"%{t}%") for t in terms]
    score = sum((h.cast("int") for h in hits), F.lit(0)) / F.lit(float(len(terms)))
    any_hit = hits[0]
    for h in hits[1:]:
        any_hit = any_hit | h
    out = chunks.where(any_hit).withColumn("score", score)
    return out.orderBy(F.desc("score"), "chunk_index", "chunk_id").limit(limit) if limit else out


def targeted_terms(question: Column) -> Column:
    """RET5: fixed headings for questions about imaging."""
    return F.when(F.lower(question).rlike(P.IMAGING_WORDS), F.array(*[F.lit(t) for t in P.IMAGING_TERMS])).otherwise(F.array().cast("array<string>"))


def facet_merge(hits: DataFrame) -> DataFrame:
    """AGG12: the best row of (query_id, chunk_id), first facet on ties, with its facets in query order."""
    best = F.max_by(F.col("score"), F.struct(F.col("score"), (-F.col("facet_no")).alias("f"))).alias("score")
    return hits.groupBy("query_id", "chunk_id").agg(best, F.min_by("facet_no", F.struct((-F.col("score")).alias("s"), "facet_no")).alias("facet_no"), F.array_sort(F.collect_set("facet_no")).alias("retrieval_facets"))


def hybrid_merge(hits: DataFrame, lexical: DataFrame) -> DataFrame:
    """RET7: lexical hits get a floor for their kind; a hit that both have keeps its columns and the greater score."""
    primary = F.col("document_type") == "radiology_report"
    lex = lexical.withColumn("l_score", F.greatest("score", F.when(primary, P.PRIMARY_SCORE).otherwise(P.NAMED_SCORE))).select("query_id", "chunk_id", "l_score", primary.alias("l_primary"))
    both = hits.join(lex, ["query_id", "chunk_id"], "full")
    return both.select("query_id", "chunk_id", F.greatest("score", "l_score").alias("score"), F.when(F.col("score").isNull(), F.col("l_primary")).otherwise(F.lit(False)).alias("primary_evidence"), F.col("l_score").isNotNull().alias("named"))


def drop_duplicates(hits: DataFrame) -> DataFrame:
    """RET8: the best of equal fingerprints; hits without one all stay."""
    words = F.trim(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "))
    print_ = F.when(F.col("document_type") == "radiology_report", F.concat_ws(":", F.lit("radiology"), F.lower(F.coalesce("author", F.lit(""))), F.coalesce(F.col("date_extracted").cast("string"), F.lit("")))).when((F.coalesce("doc_id", F.lit("")) != "") & (words != ""), F.concat_ws(":", "doc_id", words))
    rank = F.row_number().over(W.partitionBy("query_id", "fingerprint").orderBy(F.desc("score"), "chunk_id"))
    return hits.withColumn("fingerprint", F.coalesce(F.sha2(print_, 256), F.concat(F.lit("-"), F.col("chunk_id")))).withColumn("dup", rank).where("dup = 1").drop("dup", "fingerprint")


def diversify(hits: DataFrame, k: int | Column) -> DataFrame:
    """RET9: first every document's best hit, then the rest by score; k in all (a number, or a column of each query's)."""
    own = F.when(F.coalesce("doc_id", F.lit("")) != "", F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "chunk_id")))
    rows = hits.withColumn("lead", F.coalesce(own == 1, F.lit(False)))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("lead"), F.desc("score"), "chunk_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank(hits: DataFrame, logits: DataFrame) -> DataFrame:
    """RET10: scores become the logistic of supplied logits; hits without one keep their score.

    ``logits``: chunk_id, logit and, where they differ by query, query_id; without it a chunk's logit holds for every query.
    """
    rows = hits.join(logits, ["query_id", "chunk_id"] if "query_id" in logits.columns else ["chunk_id"], "left").withColumn("score", F.coalesce(T.sigmoid(F.col("logit")), "score")).drop("logit")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def primary_floor(hits: DataFrame) -> DataFrame:
    """RET11."""
    rows = hits.withColumn("score", F.when(F.col("primary_evidence"), F.greatest("score", F.lit(P.PRIMARY_FLOOR))).otherwise(F.col("score")))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def mmr_order(scores: np.ndarray, texts: list[str], k: int, weight: float = P.MMR_LAMBDA) -> list[int]:
    """Greedy choice by weight * score - (1 - weight) * greatest Jaccard to the chosen; ties to the earlier one."""
    number: dict[str, int] = {}
    own = [np.array([number.setdefault(w, len(number)) for w in set((t or "").lower().split())], np.int64) for t in texts]
    size = np.array([len(x) for x in own], np.int64)
    tokens = np.concatenate(own) if own else np.empty(0, np.int64)
    by = np.argsort(tokens, kind="stable")
    holders, begin = np.repeat(np.arange(len(own)), size)[by], np.searchsorted(tokens[by], np.arange(len(number) + 1))
    worst, open_, chosen = np.zeros(len(own)), np.isfinite(scores), []
    while open_.any() and len(chosen) < k:
        value = np.where(open_, weight * scores - (1 - weight) * worst, -np.inf)
        i = int(value.argmax())
        chosen.append(i)
        open_[i] = False
        # who shares how many of its tokens, from the tokens' holders
        shared = np.bincount(np.concatenate([holders[begin[t] : begin[t + 1]] for t in own[i]]), minlength=len(own)) if size[i] else np.zeros(len(own), np.int64)
        worst = np.maximum(worst, shared / np.maximum(size + size[i] - shared, 1))
    return chosen


def mmr(hits: DataFrame, k: int | None = None) -> DataFrame:
    """RET12: (query_id, ord, score, mmr_rank) of the chosen hits; a query's candidates are a top-k, so a group is bounded.

    Without ``k`` each query's own is in the column k; up to k candidates stay in their order then.
    """

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ord")
        most = int(f["k"].iloc[0])
        order = range(len(f)) if k is None and len(f) <= most else mmr_order(f["score"].to_numpy(float), list(f["text"]), most)
        return f.iloc[list(order)][["query_id", "ord", "score"]].assign(mmr_rank=range(1, len(order) + 1))

    return hits.select("query_id", "ord", "score", "text", F.col("k") if k is None else F.lit(k).alias("k")).groupBy("query_id").applyInPandas(one, "query_id bigint, ord bigint, score double, mmr_rank int")


def context_budget(hits: DataFrame, budget: int) -> DataFrame:
    """WIN8: the best hits whose estimated tokens fit; the first always stays."""
    used = F.sum(T.token_estimate(F.col("text"))).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return hits.withColumn("used", used).where((F.col("used") <= budget) | (F.col("rank") == 1))


#: Fixed value.
NO_CONTEXT = "No relevant documents found."


def assemble_context(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """RET14: one context a query, blocks by source number; a fixed sentence without hits."""
    held = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_no", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("context"))
    return queries.select("query_id").join(held, "query_id", "left").select("query_id", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"))
