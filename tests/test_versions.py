"""The commit log: numbered commits, crashes between the steps, writers at the same time, buckets."""

import os
import subprocess
import sys
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casegrid.operators import registry
from casegrid.sources import versions
from casegrid.streaming import streams

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id string, n int"


def put(spark, root, rows, name="t", buckets=4):
    new = spark.createDataFrame(rows, DOCS)
    return versions.commit(spark, root, lambda held: versions.replace_keys(spark, root, held, name, new, new, key="doc_id", buckets=buckets))


def held(spark, root, name="t", **kw):
    return sorted(map(tuple, versions.read(spark, root, name, **kw).collect()))


def test_versions_stay_readable_and_whole_states_are_kept(spark, tmp_path):
    root = str(tmp_path)
    for n in range(1, 13):
        assert put(spark, root, [(f"d{n % 5}", n)]) == n
    assert held(spark, root) == [("d0", 10), ("d1", 11), ("d2", 12), ("d3", 8), ("d4", 9)]
    assert held(spark, root, at=3) == [("d1", 1), ("d2", 2), ("d3", 3)]
    assert versions._entry(spark, root, 10)["base"] and not versions._entry(spark, root, 11)["base"]
    for n in range(1, 10):
        os.remove(versions._log(root, n))
    assert held(spark, root) == [("d0", 10), ("d1", 11), ("d2", 12), ("d3", 8), ("d4", 9)]
    os.remove(versions._log(root, 11))
    with pytest.raises(RuntimeError, match="gap"):
        versions.snapshot(spark, root)
    with pytest.raises(ValueError, match="no version"):
        versions.snapshot(spark, root, 4)


def test_a_number_is_created_once(spark, tmp_path):
    path, won = f"{tmp_path}/_log/1.json", []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if versions.put_if_absent(spark, path, f"text {k}") else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and Path(path).read_text() == f"text {won[0]}" and [f for f in os.listdir(f"{tmp_path}/_log") if f.endswith(".draft")] == []


def test_two_writers_at_the_same_time(spark, tmp_path):
    """Different documents, the same document, and one count that both change: nothing is lost."""
    root = str(tmp_path)
    put(spark, root, [("count", 0)], "c", 1)

    def add(k):
        def change(at):
            one = versions.read(spark, root, "c", at=at).select("doc_id", (F.col("n") + 1).alias("n"))
            new = spark.createDataFrame([(f"d{k}", k), ("both", k)], DOCS)
            return versions.replace_keys(spark, root, at, "c", one, one, key="doc_id", buckets=1) | versions.replace_keys(spark, root, at, "t", new, new, key="doc_id", buckets=4)

        versions.commit(spark, root, change)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert versions.history(spark, root) == [1, 2, 3, 4, 5] and held(spark, root, "c") == [("count", 4)]
    got = dict(held(spark, root))
    assert {k: got.pop(f"d{k}") for k in range(4)} == {k: k for k in range(4)} and set(got) == {"both"}


def test_a_change_is_made_again_only_if_what_it_read_changed(spark, tmp_path):
    root, made = str(tmp_path), []
    put(spark, root, [("a", 1)])

    def change(at):
        made.append(at.number)
        if len(made) == 1:
            put(spark, root, [("a", 2)], "other")  # another writer is faster, with another table
        new = spark.createDataFrame([("b", 5)], DOCS)
        return versions.replace_keys(spark, root, at, "t", new, new, key="doc_id", buckets=1)

    assert versions.commit(spark, root, change) == 3 and made == [1]
    made.clear()
    meddle = lambda at: (made.append(at.number), put(spark, root, [("c", 7)]) if len(made) == 1 else None, versions.replace_keys(spark, root, at, "t", one, one, key="doc_id", buckets=4))[2]
    one = spark.createDataFrame([("c", 8)], DOCS)
    versions.commit(spark, root, meddle)
    assert made == [3, 4] and dict(held(spark, root))["c"] == 8


def test_killed_between_the_steps(spark, tmp_path):
    """A process that dies after its data files, or with its commit half written, leaves the version before it; its files can be cleared away."""
    root = str(tmp_path / "t")
    put(spark, root, [("a", 1)])
    code = f"""
import os
from pyspark.sql import SparkSession
from casegrid.sources import versions
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
os.link = lambda *a: os._exit(9)  # the draft is written, the commit isn't there yet
new = spark.createDataFrame([("a", 2), ("b", 2)], "doc_id string, n int")
versions.commit(spark, {root!r}, lambda held: versions.replace_keys(spark, {root!r}, held, "t", new, new, key="doc_id", buckets=4))
"""
    died = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, timeout=240)
    assert died.returncode == 9, died.stderr[-2000:]
    assert len(os.listdir(f"{root}/data")) == 2 and held(spark, root) == [("a", 1)]
    assert versions.vacuum(spark, root) == [] and len(versions.vacuum(spark, root, least_age=0)) == 1
    assert held(spark, root) == [("a", 1)] and put(spark, root, [("a", 3)]) == 2 and held(spark, root) == [("a", 3)]


def test_only_the_buckets_of_the_keys_are_written(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, [(f"d{i}", 0) for i in range(100)], buckets=16)
    before = versions.snapshot(spark, root).tables["t"].files
    put(spark, root, [("d7", 1)])
    after = versions.snapshot(spark, root).tables["t"]
    assert after.buckets == 16 and sum(before[b] != after.files[b] for b in before) == 1
    assert held(spark, root).count(("d7", 1)) == 1 and len(held(spark, root)) == 100
    one = spark.createDataFrame([("d7",), ("none",)], "doc_id string")
    got = versions.read_keys(spark, root, "t", one)
    assert [tuple(r) for r in got.collect()] == [("d7", 1)] and len(got.inputFiles()) < 16
    gone = spark.createDataFrame([("d7",)], "doc_id string")
    versions.commit(spark, root, lambda at: versions.replace_keys(spark, root, at, "t", gone, spark.createDataFrame([], DOCS), key="doc_id", buckets=16))
    assert len(held(spark, root)) == 99


def test_columns_may_be_added(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, [("a", 1), ("b", 1)])
    new = spark.createDataFrame([("a", 2, "x")], DOCS + ", more string")
    versions.commit(spark, root, lambda at: versions.replace_keys(spark, root, at, "t", new, new, key="doc_id", buckets=4))
    assert held(spark, root) == [("a", 2, "x"), ("b", 1, None)]


def test_ingest_counts_a_batch_once_and_keeps_totals(spark, tmp_path):
    root = str(tmp_path)
    batch = lambda *rows: spark.createDataFrame([*rows], "original_filename string, path string, text string")
    first = batch(("a.md", "/2/a.md", "late a"), ("a.md", "/1/a.md", "early a"), ("b.md", "/1/b.md", "text b. " * 300), ("c.txt", "/1/c.txt", "no"), ("../d.md", "/d.md", "no"), ("e.md", "/e.md", "  "), (None, "/f", "x"), ("g.md", "/g", None))
    assert streams.ingest_batch(first, 0, root, "/ws/x", buckets=8) == 1 == streams.ingest_batch(first, 0, root, "/ws/x", buckets=8)
    texts = lambda: {r["original_filename"]: r["text"] for r in versions.read(spark, root, "chunks").where("chunk_index = 0").select("original_filename", "text").collect()}
    assert texts()["a.md"] == "early a" and set(texts()) == {"a.md", "b.md"}
    chunks = versions.read(spark, root, "chunks").count()
    run = versions.read(spark, root, "runs").first()
    assert (run["total_documents"], run["total_chunks"], run["status"]) == (2, chunks, "indexed") and chunks > 3
    assert streams.ingest_batch(batch(("b.md", "/3/b.md", "short b"), ("a.md", "/3/a.md", " \n")), 1, root, "/ws/x") == 2
    assert texts() == {"a.md": "early a", "b.md": "short b"}  # a text without chunks leaves the document as it was
    assert versions.read(spark, root, "runs").select("total_documents", "total_chunks").first() == (2, 2)
    streams.ingest_batch(batch(("a.md", "/a.md", "another case")), 2, root, "/ws/y")
    assert {r["run_dir"]: r["total_chunks"] for r in versions.read(spark, root, "runs").collect()} == {"/ws/x": 2, "/ws/y": 1}
    changes = {(r["batch"], r["change"]): r["n"] for r in versions.read(spark, root, "point_changes").groupBy("batch", "change").agg(F.count("*").alias("n")).collect()}
    assert changes == {(0, "new"): chunks, (1, "overwritten"): 1, (1, "stale"): chunks - 2, (2, "new"): 1}


def test_replaced_rows_are_dealt_out_once(spark, tmp_path):
    """Old and new rows meet in the shuffle by bucket that the write needs; rows without a key are like no others, listed keys without new rows go."""
    table = lambda *rows: spark.createDataFrame([*rows], "doc_id string, n int")
    old = table(*[(f"d{i}", i) for i in range(50)], (None, -1), ("d1", 100))
    keys, new = table(("d1", 0), ("d2", 0), ("d3", 0), (None, 0)), table(("d1", 7), ("d1", 8), ("d3", 9), (None, -2))
    rows = versions._replaced(old, keys, new, "doc_id", 3)
    want = sorted([*[(f"d{i}", i) for i in range(50) if i not in (1, 2, 3)], ("d1", 7), ("d1", 8), ("d3", 9), ("", -1), ("", -2)])
    assert sorted((r["doc_id"] or "", r["n"]) for r in rows.collect()) == want
    rows._jdf.queryExecution().executedPlan()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan
    root = str(tmp_path)
    for keys, new in ((old, old), (keys, new)):
        versions.commit(spark, root, lambda at, keys=keys, new=new: versions.replace_keys(spark, root, at, "t", keys, new, key="doc_id", buckets=3))
    got = versions.read(spark, root, "t")
    assert sorted((r["doc_id"] or "", r["n"]) for r in got.collect()) == want and got.columns == ["doc_id", "n"]


def test_point_changes_need_one_shuffle(spark):
    old, new = (spark.createDataFrame([(p,) for p in ids], "point_id string") for ids in (["a", "b", "b", None], ["b", "c", "c", None]))
    diff = registry.point_diff(old, new)
    assert sorted((r["point_id"] or "", r["change"]) for r in diff.collect()) == [("", "new"), ("", "stale"), ("a", "stale"), ("b", "overwritten"), ("c", "new")]
    assert diff._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_ingest_deals_texts_out_once(spark, tmp_path, monkeypatch):
    """Files of one name meet in the task that chunks the document, whatever the path."""
    plans, kept = [], streams.materialize
    monkeypatch.setattr(streams, "materialize", lambda df, tag: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or kept(df, tag))
    batch = spark.createDataFrame([(f"{i % 40}.md", f"/{i:03}/x", f"text {i}") for i in range(120)], "original_filename string, path string, text string")
    streams.ingest_batch(batch, 0, str(tmp_path), "/ws/x", buckets=4)
    got = versions.read(spark, str(tmp_path), "chunks").select("original_filename", "text").collect()
    assert sorted(map(tuple, got)) == sorted((f"{i}.md", f"text {i}") for i in range(40))
    assert dict(plans)["chunks"].count("Exchange hashpartitioning") == 1
