"""Ranked lexical search against its SQL, on small tables with the hard cases."""

import math
import random

import duckdb
import pytest

from casegrid.llm import lexical_search

SCHEMA = "doc_id bigint, text string, item int, score int, rank string, block int, terms string"


def by_sql(docs, items):
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    c.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = c.sql(lexical_search.OP12_SQL)
    return sorted(got.fetchall(), key=str), got.columns


def searched(spark, docs, items, partitions=3, **kw):
    table = spark.createDataFrame([(i, t, 1, 2, "x", 3, "y") for i, t in docs], SCHEMA).repartition(partitions)
    asked = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, doc string")
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in lexical_search.ranked_search(table, asked, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def queries(corpus):
    rng, texts = random.Random(9), [t for t in corpus.values() if t]
    out = [(i, " ".join(rng.choice(texts).split(" ")[:30])) for i in range(12)]
    return [*out, (50, "alpha ALPHA alpha, alpha-beta"), (51, None), (52, ""), (53, "!!! ---"), (54, "nowhere-to-be-found"), (55, "é\U0001F600 x7 ab\x7fab"), (None, "gamma delta")]


def test_against_sql(spark, corpus, queries):
    docs = [*corpus.items(), *[(200 + i, "alpha alpha beta") for i in range(30)], (300, "alpha " * 5000), (301, "x7é\U0001F600")]
    want, columns = by_sql(docs, queries)
    assert sorted(columns) == ["doc_id", "item_id", "rank", "score"]
    assert searched(spark, docs, queries) == want
    assert any(r[0] == 50 for r in want) and not any(r[0] in (51, 52, 53, 54) for r in want)


def test_bundles_and_waves(spark, corpus, queries, monkeypatch):
    docs = list(corpus.items())
    want, _ = by_sql(docs, queries)
    monkeypatch.setattr(lexical_search, "BUNDLE_ITEMS", 5)
    assert searched(spark, docs, queries, 6) == want
    monkeypatch.setattr(lexical_search, "WAVE_ITEMS", 7)
    assert searched(spark, docs, queries, 2) == want


def test_ties_repeated_and_null_ids(spark):
    docs = [(i, "one two three") for i in range(20, 0, -1)] + [(None, "one two three"), (3, "one two three"), (3, "two")]
    got = searched(spark, docs, [(1, "one"), (1, "three")], 5)
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: r[1])] == [(k + 1, i) for k, i in enumerate([1, 2, 3, 3, 4, 5, 6, 7, 8, 9])]
    few = [(None, "one"), (4, "one"), (5, "nothing else")]
    assert [(r[1], r[2]) for r in sorted(searched(spark, few, [(1, "one")]), key=lambda r: r[1])] == [(1, 4), (2, None)]


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "one")]) == [] == searched(spark, [(1, "one")], []) == searched(spark, [(1, None), (2, "--")], [(1, "one")])


def test_weight_is_floored_in_doubles():
    assert lexical_search.weight(10, 10) == math.floor(1000 * math.log(22 / 21)) and lexical_search.weight(5, 1) == math.floor(1000 * math.log(4))
