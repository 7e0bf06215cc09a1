"""Ranked lexical search by pipelined term partitioning.

The terms of the query items are dealt to owners, the rarest terms to the first.
Items travel in bundles, and a bundle travels once for each block of documents,
with sparse accumulators of that block's scores. One owner's stage after the
other is a cogroup of the bundles with the owner's postings of the same block:
it adds integer contributions, and lets go of accumulators that can no longer
come among the block's best, as what later owners can add is bounded. After the
last stage each block gives its best rows of each item to the final selection.

A block has a bounded number of documents, so a term that all documents hold is
spread over all blocks. Items are searched in waves with a bounded number of
terms, whose dictionary goes to every task; any number of items is searched. A
64-bit hash stands for a term.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window as W

from casegrid.llm.packed import blob, split_points
from casegrid.llm.text_tables import read_table
from casegrid.llm.words import text_words
from casegrid.workspace import discard, materialize

#: Term owners, and the share of all postings that those up to each one hold.
SHARES = (0.05, 0.2, 0.5, 1.0)
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 2_000_000
BUNDLE_ITEMS = 256
#: A wave holds about so many items and term occurrences at most (one item at least).
WAVE_ITEMS, WAVE_TERMS = 4_096, 1 << 20
#: Bytes of terms are kept, A-Z in lower case; all others are spaces.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each term of all texts, in order."""
    return text_words([(t or "").encode().translate(_TERM) for t in texts])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _items(batches):
    """Of each item row: the id and its terms' hashes, repeats included."""
    for batch in batches:
        owner, hashes = terms(batch.column(1).to_pylist())
        at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([blob(hashes[a:b]) for a, b in zip(at, at[1:])], pa.binary())], ["item", "terms"])


class Wave:
    """The items of a wave: ids, a dictionary of their terms, and how often which item of which bundle holds each."""

    def __init__(self, rows):
        held: dict[object, list[np.ndarray]] = {}
        for r in rows:
            held.setdefault(r["item"], []).append(np.frombuffer(r["terms"], np.uint64))
        self.ids = list(held)
        self.words = np.unique(np.concatenate([x for parts in held.values() for x in parts] or [np.empty(0, np.uint64)]))
        counted = [np.unique(np.searchsorted(self.words, np.concatenate(parts)), return_counts=True) for parts in held.values()]
        item = np.repeat(np.arange(len(counted)), [len(t) for t, _ in counted])
        term = np.concatenate([t for t, _ in counted] or [np.empty(0, np.int64)]).astype(np.int64)
        count = np.concatenate([c for _, c in counted] or [np.empty(0, np.int64)]).astype(np.int64)
        self.bundles = []
        for low in range(0, len(counted), BUNDLE_ITEMS):
            own = np.flatnonzero((item >= low) & (item < low + BUNDLE_ITEMS))
            own = own[np.argsort(term[own], kind="stable")]
            starts, ends = split_points(term[own])
            self.bundles.append({"first": low, "size": min(BUNDLE_ITEMS, len(counted) - low), "terms": term[own][starts], "starts": starts, "ends": ends, "item": item[own] - low, "count": count[own]})


def _index(known):
    """Blocks of documents: ids and numbers of terms, and the postings of the wave's terms sorted by term."""

    def run(batches):
        words, block = known.value, TaskContext.get().partitionId() << 32
        ids, sizes, postings, docs, found = [], [], [], 0, 0

        def close():
            nonlocal block, ids, sizes, postings, docs, found
            term, doc, tf = (np.concatenate(x) for x in zip(*postings, strict=True))
            order = np.argsort(term, kind="stable")
            every = pa.concat_arrays(ids)
            null = np.asarray(every.is_null())
            numbers = np.asarray(every.cast(pa.int64()).fill_null(0))
            row = [block, numbers, np.packbits(null), np.concatenate(sizes), term[order].astype(np.int32), doc[order].astype(np.int32), tf[order].astype(np.int64)]
            block, ids, sizes, postings, docs, found = block + 1, [], [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(row[:1]), *(pa.array([blob(x)], pa.binary()) for x in row[1:])], ["block", "ids", "nulls", "sizes", "terms", "docs", "tfs"])

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                owner, hashes = terms(part.column(1).to_pylist())
                at = np.searchsorted(words, hashes)
                at[at == len(words)] = 0
                hit = np.flatnonzero(words[at] == hashes) if len(words) else np.empty(0, np.int64)
                code, tf = np.unique(at[hit] * 512 + owner[hit], return_counts=True)
                ids.append(part.column(0))
                sizes.append(np.bincount(owner, minlength=part.num_rows).astype(np.int64))
                postings.append((code // 512, code % 512 + docs, tf))
                docs, found = docs + part.num_rows, found + len(code)
                if docs >= BLOCK_DOCS or found >= BLOCK_POSTINGS:
                    yield close()
        if docs:
            yield close()

    return run


def _counts(n_terms: int):
    """What one task's blocks count: (term, documents, most in one), and as terms -1 and -2 the documents with terms and all terms."""

    def run(batches):
        df, most, docs, total = np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            for terms_, tfs, sizes in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                t, sizes = np.frombuffer(terms_.as_py(), np.int32), np.frombuffer(sizes.as_py(), np.int64)
                df += np.bincount(t, minlength=n_terms)
                np.maximum.at(most, t, np.frombuffer(tfs.as_py(), np.int64))
                docs, total = docs + int((sizes > 0).sum()), total + int(sizes.sum())
        seen = np.flatnonzero(df)
        term, n, m = np.concatenate([[-1, -2], seen]), np.concatenate([[docs, total], df[seen]]), np.concatenate([[0, 0], most[seen]])
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["term", "n", "most"])

    return run


def _deal(bundles, owner: np.ndarray):
    """For each block and bundle: its documents (owner -1), and each owner's postings of the bundle's terms."""

    def run(batches):
        held = bundles.value
        for batch in batches:
            for row in batch.to_pylist():
                term, doc, tf = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["docs"], np.int32), np.frombuffer(row["tfs"], np.int64)
                out = []
                for b, bundle in enumerate(held):
                    out.append((-1, b, row["ids"], row["sizes"], row["nulls"]))
                    mine = np.isin(term, bundle["terms"])
                    for s in range(len(SHARES)):
                        at = np.flatnonzero(mine & (owner[term] == s))
                        if len(at):
                            out.append((s, b, blob(term[at]), blob(doc[at]), blob(tf[at])))
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array([row["block"]] * len(out), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["owner", "bundle", "block", "a", "b", "c"])

    return run


_STATE = "bundle int, block bigint, ids binary, sizes binary, nulls binary, acc_item binary, acc_doc binary, acc_score binary"
_STATE_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _stage(known, last: bool, k: int, id_type):
    """An owner's stage: the bundle's accumulators of a block, and the owner's postings of it."""

    def add(key, bundle_rows: pa.Table, postings: pa.Table) -> pa.Table:
        held = known.value
        bundle, (state,) = held["bundles"][key[0].as_py()], bundle_rows.to_pylist()
        sizes = np.frombuffer(state["sizes"], np.int64)
        place = 100 - 75 + (75 * sizes * held["docs"]) // max(held["terms"], 1)
        acc = np.zeros((bundle["size"], len(sizes)), np.int64)
        acc[np.frombuffer(state["acc_item"], np.int16), np.frombuffer(state["acc_doc"], np.int32)] = np.frombuffer(state["acc_score"], np.int64)
        for row in postings.to_pylist():
            term, doc, tf = np.frombuffer(row["a"], np.int32), np.frombuffer(row["b"], np.int32), np.frombuffer(row["c"], np.int64)
            part = (1_000_000_000 * tf) // (1000 * tf + 8 * place[doc]) * held["weights"][term]
            starts, ends = split_points(term)
            for a, b, at in zip(starts, ends, np.searchsorted(bundle["terms"], term[starts]), strict=True):
                own = slice(bundle["starts"][at], bundle["ends"][at])
                acc[np.ix_(bundle["item"][own], doc[a:b])] += bundle["count"][own][:, None] * part[a:b]
        kth = np.partition(acc, -k, axis=1)[:, -k] if acc.shape[1] > k else np.zeros(len(acc), np.int64)
        if not last:
            item, doc = np.nonzero((acc > 0) & (acc + bundle["later"][held["stage"]][:, None] >= kth[:, None]))
            values = [[state[c]] for c in ("ids", "sizes", "nulls")] + [[blob(item.astype(np.int16))], [blob(doc.astype(np.int32))], [blob(acc[item, doc])]]
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *(pa.array(v, pa.binary()) for v in values)], _STATE_NAMES)
        item, doc = np.nonzero((acc > 0) & (acc >= kth[:, None]))
        ids, null = np.frombuffer(state["ids"], np.int64)[doc], np.unpackbits(np.frombuffer(state["nulls"], np.uint8), count=len(sizes))[doc].astype(bool)
        score = acc[item, doc]
        order = np.lexsort((ids, null, -score, item))
        starts, ends = split_points(item[order])
        best = order[np.arange(len(order)) - np.repeat(starts, ends - starts) < k]
        return pa.table([pa.array(item[best] + bundle["first"], pa.int32()), pa.array(ids[best], mask=null[best]).cast(id_type), pa.array(score[best])], ["item", "doc", "score"])

    return add


def _search(spark, docs: DataFrame, wave: Wave, k: int) -> tuple[DataFrame, DataFrame]:
    """The best documents of a wave's items (item, doc, score), and the table that they are made from."""
    from pyspark.sql.pandas.types import to_arrow_type

    doc_type = docs.schema["doc"].dataType
    words = spark.sparkContext.broadcast(wave.words)  # bounded by the wave
    blocks = materialize(docs.mapInArrow(_index(words), "block bigint, ids binary, nulls binary, sizes binary, terms binary, docs binary, tfs binary"), "blocks")
    counted = blocks.select("terms", "tfs", "sizes").mapInArrow(_counts(len(wave.words)), "term int, n bigint, most bigint").groupBy("term").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    df, most, total = np.zeros(len(wave.words), np.int64), np.ones(len(wave.words), np.int64), {}
    for t, n, m in counted.collect():  # a row for each term of the wave at most
        if t < 0:
            total[t] = n
        else:
            df[t], most[t] = n, m
    n_docs = total.get(-1, 0)
    weights = np.array([weight(n_docs, int(x)) if x else 0 for x in df], np.int64)
    order, owner = np.argsort(df, kind="stable"), np.zeros(len(df), np.int64)
    owner[order] = np.searchsorted(SHARES, np.cumsum(df[order]) / max(1, df.sum()) - 1e-9).clip(0, len(SHARES) - 1)
    greatest = weights * ((1_000_000_000 * most) // (1000 * most + 8 * 25))  # no document is shorter than m = 25 makes it
    for bundle in wave.bundles:
        term = np.repeat(bundle["terms"], bundle["ends"] - bundle["starts"])
        bundle["later"] = [np.bincount(bundle["item"], np.where(owner[term] > s, bundle["count"] * greatest[term], 0).astype(np.float64), bundle["size"]).astype(np.int64) + 1 for s in range(len(SHARES))]

    bundles = spark.sparkContext.broadcast(wave.bundles)
    owned = materialize(blocks.mapInArrow(_deal(bundles, owner), "owner int, bundle int, block bigint, a binary, b binary, c binary"), "owned")
    discard(blocks)
    none = F.lit(b"")
    state = owned.where("owner = -1").select("bundle", "block", F.col("a").alias("ids"), F.col("b").alias("sizes"), F.col("c").alias("nulls"), none.alias("acc_item"), none.alias("acc_doc"), none.alias("acc_score"))
    for s in range(len(SHARES)):
        known = spark.sparkContext.broadcast({"bundles": wave.bundles, "weights": weights, "docs": n_docs, "terms": total.get(-2, 0), "stage": s})
        last = s == len(SHARES) - 1
        schema = f"item int, doc {doc_type.simpleString()}, score bigint" if last else _STATE
        own = owned.where(F.col("owner") == s).select("bundle", "block", "a", "b", "c")
        state = state.groupBy("bundle", "block").cogroup(own.groupBy("bundle", "block")).applyInArrow(_stage(known, last, k, to_arrow_type(doc_type)), schema)
    return state, owned


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """For each item its ``k`` best documents: item_col, rank (from 1), id_col, score.

    Rows of one item id are one item, a null id among them; items without terms
    or matches give no row. Document ids are whole numbers or null; every row is
    a document of its own, also if it repeats an id or text. Null, empty and
    term-less texts count for nothing. Equal scores rank by ascending id, null
    last. Very long texts are read whole. Only the columns named are read, so
    clashing names don't matter. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    narrow, asked = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    item_type = asked.schema["item"].dataType.simpleString()
    packed = materialize(asked.mapInArrow(_items, f"item {item_type}, terms binary"), "items")
    n, size = packed.agg(F.count("*"), F.coalesce(F.sum(F.length("terms")) / 8, F.lit(0))).first()
    waves = max(1, -(-n // WAVE_ITEMS), -(-int(size) // WAVE_TERMS))
    found = None
    for w in range(waves):
        wave = Wave(packed.where(F.pmod(F.xxhash64("item"), F.lit(waves)) == w).toLocalIterator())
        best, owned = _search(spark, narrow, wave, k)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(wave.ids)], f"item int, name {item_type}")
        part = best.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("doc").alias(id_col), "score")  # at most a wave's items
        if waves > 1:
            part = materialize(part, "found")
            discard(owned)
        found = part if found is None else found.union(part)
    return found


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
td AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qc AS (SELECT item_id, term, count(*) AS c FROM q GROUP BY ALL),
size AS (SELECT r, count(*) AS n FROM td GROUP BY r),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM td WHERE term IN (SELECT term FROM qc) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
p AS (SELECT tf.r, tf.doc_id, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + ((75 * size.n * n_docs) // n_terms)))) AS part FROM tf JOIN size USING (r) JOIN w USING (term), whole),
s AS (SELECT item_id, r, doc_id, sum(c * part)::BIGINT AS score FROM qc JOIN p USING (term) GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
