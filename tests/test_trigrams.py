"""The trigram index: the same rows as a scan, from fewer files, also after changes."""

import pytest

from casegrid.operators import retrieval
from casegrid.sources import trigrams, versions

SCHEMA = "chunk_id string, chunk_index int, text string"


def put(spark, root, rows, buckets=16):
    new = spark.createDataFrame(rows, SCHEMA)
    versions.commit(spark, root, lambda at: versions.replace_keys(spark, root, at, "chunks", new, new, key="chunk_id", buckets=buckets))


def test_trigrams_of_terms():
    assert trigrams.trigrams_of("KneE") == {"kne", "nee"} and trigrams.trigrams_of("ab%cd_e") == set() and trigrams.trigrams_of("abc%xyz") == {"abc", "xyz"}


def test_same_rows_from_fewer_files(spark, tmp_path):
    root = str(tmp_path)
    rows = [(f"c{i}", i % 5, f"common words {i} " + ("Zygote here" if i in (3, 70) else "plain") + (" é" if i % 2 else "")) for i in range(100)] + [("n", 0, None), ("s", 0, "zy"), ("e", 0, "")]
    put(spark, root, rows)
    whole = lambda terms, **kw: [tuple(r) for r in retrieval.lexical_search(versions.read(spark, root, "chunks"), terms, **kw).collect()]
    unindexed = trigrams.search(spark, root, ["zygote"])
    assert sorted(map(tuple, unindexed.collect())) == sorted(whole(["zygote"]))
    trigrams.build(spark, root)
    found = trigrams.search(spark, root, ["zygOTE", "z_gote he"])
    assert sorted(map(tuple, found.collect())) == sorted(whole(["zygOTE", "z_gote he"])) and found.count() == 2
    assert len(found.inputFiles()) <= 2 < len(unindexed.inputFiles())
    for terms in (["zy"], ["nowhere"], ["words 7", "zygote%é"], ["common"], ["%"]):
        assert sorted(map(tuple, trigrams.search(spark, root, terms).collect())) == sorted(whole(terms))
    assert [tuple(r) for r in trigrams.search(spark, root, ["common"], limit=7).collect()] == whole(["common"], limit=7)
    put(spark, root, [("c50", 0, "a new zygote"), ("c3", 0, "gone")])
    assert sorted(r["chunk_id"] for r in trigrams.search(spark, root, ["zygote"]).collect()) == ["c50", "c70"]
    trigrams.build(spark, root)
    assert sorted(r["chunk_id"] for r in trigrams.search(spark, root, ["zygote"]).collect()) == ["c50", "c70"] and trigrams.search(spark, root, ["nowhere"]).count() == 0
