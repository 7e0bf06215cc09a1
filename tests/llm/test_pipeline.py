"""The pipeline's stages against brute force on a small table, and the registered queries."""

import duckdb

import corpus_pipeline
import __spark_entry__ as entry
from casegrid.llm import exact_dedup
from tests.llm import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "source_mix", "best_fit_packing"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    one = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert one.columns == docs.columns and one.count() == len(texts)  # all of them are in known languages
    two = corpus_pipeline.STAGES[1][1](spark, one, sf_dir)
    groups = {}
    for i, t in texts.items():
        groups.setdefault(t.translate({ord(c): None for c in brute.SPACES}), []).append(i)
    kept = {min(ids, key=lambda i: (-len(texts[i]), i)) for ids in groups.values()}
    assert {r["doc_id"] for r in two.collect()} == kept
    three = corpus_pipeline.STAGES[2][1](spark, two, sf_dir)
    near = brute.jaccard_components({i: texts[i] for i in kept}, 5, 80)
    assert {r["doc_id"] for r in three.collect()} == {i for i, (_, c) in near.items() if i == c}
    four = corpus_pipeline.STAGES[3][1](spark, three, sf_dir)
    words = sum(len(brute.words(r["text"])) for r in three.collect())
    assert abs(sum(len(brute.words(r["text"])) for r in four.collect()) - words) < 0.02 * words and four.columns == docs.columns
    five = corpus_pipeline.STAGES[4][1](spark, four, sf_dir)
    assert five.agg({"length": "sum"}).first()[0] > words


def test_stages_with_repeated_and_null_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    schema = docs.schema
    kept = [r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, corpus_pipeline.STAGES[1][1](spark, docs, sf_dir), sf_dir).collect()]
    base = sorted((r.asDict() | {"source": "s"} for r in docs.collect() if r["doc_id"] in set(kept)), key=lambda r: r["doc_id"])
    a, b, c, d = base[:4]
    long = a | {"doc_id": None, "text": a["text"].replace(" ", "  ", 3)}  # a null id has the longest text of its group
    extra = [dict(b), dict(b), c | {"doc_id": b["doc_id"]}, dict(b), long, d | {"doc_id": None}]
    alone = base.pop()  # unique and clean, without an id
    table = spark.createDataFrame([tuple(r[f] for f in schema.names) for r in [*base, *extra, alone | {"doc_id": None}]], schema).repartition(3)
    rows = lambda t: sorted(((r["doc_id"], r["text"]) for r in t.collect()), key=str)
    two = corpus_pipeline.STAGES[1][1](spark, table, sf_dir)
    want = {r["text"]: r["doc_id"] for r in base} | {c["text"]: min(b["doc_id"], c["doc_id"]), long["text"]: None, alone["text"]: None}
    del want[a["text"]]
    want = sorted(((i, t) for t, i in want.items()), key=str)
    assert rows(two) == want and two.columns == table.columns
    again = spark.createDataFrame([(5, "one two three four five six seven"), (5, "other words that are not like the first"), (None, "one two three four five six seven  "), (None, "no copy of mine is anywhere in here")], "doc_id bigint, text string")
    assert rows(corpus_pipeline.STAGES[2][1](spark, again, sf_dir)) == sorted([r for r in map(tuple, again.collect()) if not r[1].endswith("  ")], key=str)
    three = corpus_pipeline.STAGES[2][1](spark, two, sf_dir)
    assert rows(three) == want
    assert rows(corpus_pipeline.STAGES[3][1](spark, three, sf_dir)) == want  # one source: all of it, once


def test_exact_duplicates_with_null_ids_follow_the_sql(spark):
    table = spark.createDataFrame([(1, "a b"), (None, "a  b"), (2, "ab"), (None, "x"), (None, "y"), (3, "y")], "doc_id bigint, text string").coalesce(1)
    con = duckdb.connect()
    con.register("documents", table.toArrow())
    got = [tuple(r) for r in exact_dedup.exact_duplicates(table).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=str) == sorted(con.sql(exact_dedup.OP7_SQL).fetchall(), key=str)


def test_registered(spark):
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
