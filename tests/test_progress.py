"""Progress streams: lines in any order, repeated and missing ones, totals that never fall."""

import random
import time

from casegrid.sources import versions
from casegrid.streaming import progress


def feed(spark, base, batches, make, schema, **kw):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = make(spark.readStream.schema(schema).parquet(f"{base}/in"), **kw)
        progress.run_to_versions(stream, f"{base}/out", "t", f"{base}/checkpoint", buckets=2)
    return {tuple(r)[:2] if "stage" in r else r["run_id"]: r.asDict() for r in versions.read(spark, f"{base}/out", "t").collect()}


LOG = ["noise", "Worker ID | finished | started", "0 | 3 | 9", "1 | 4 | 9", "Worker ID | errored | finished | started", "1 | 2 | 1 | 9", "Completed pages: 1,005", "failed_pages 7.0 of", "completed_pages 12.9", "2 | 5 | 100 | 0", "x | 1 | 2", "3 |"]


def folded(lines, total=0):
    held = {"head": [], "workers": {}, "completed": 0, "failed": 0, "total": total}
    out = []
    for x in lines:
        progress.ocr_step(held, x)
        out.append((held["completed"], held["failed"]))
    return out


def test_ocr_steps():
    # 7 pages by both workers; worker 1 falls to 1 but the total doesn't; 1,005 as said; 7 failed, then 2 + 5 = 7
    assert folded(LOG) == [(0, 0), (0, 0), (3, 0), (7, 0), (7, 0), (7, 2), (1005, 2), (1005, 7), (1005, 7), (1005, 7), (1005, 7), (1005, 7)]
    assert folded(LOG, 50)[-1] == (50, 7)
    assert folded(["5 | 6 | 7", "5 | 1 | 9 | 9"]) == [(6, 0), (9, 1)]  # rows without a head


def test_ocr_lines_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(r, i + 1, x, 50 if r == "b" else None) for r in "abc" for i, x in enumerate(LOG)]
    rng.shuffle(rows)
    rows[5:5] = rows[:3]  # repeated lines
    cut = [rows[:9], rows[9:10], rows[10:25], rows[25:]]
    got = feed(spark, str(tmp_path), cut, progress.ocr_progress, "run_id string, line_no bigint, line string, total bigint")
    assert {k: (r["completed_pages"], r["failed_pages"], r["lines"], r["waiting"], r["skipped"]) for k, r in got.items()} == {k: (50 if k == "b" else 1005, 7, 12, 0, 0) for k in "abc"}
    assert sum(r["late"] for r in got.values()) == 3 and {r["workers"] for r in got.values()} == {3}
    assert versions.history(spark, f"{tmp_path}/out") == [1, 2, 3, 4]


def test_a_missing_line_is_skipped_after_the_time_out(spark, tmp_path):
    schema = "run_id string, line_no bigint, line string"
    rows = [("a", 1, "0 | 3 | 9"), ("a", 3, "1 | 4 | 9"), ("a", 6, "1 | 5 | 9")]
    got = feed(spark, str(tmp_path), [rows], progress.ocr_progress, schema, patience="1 second")
    assert (got["a"]["completed_pages"], got["a"]["waiting"], got["a"]["skipped"]) == (3, 2, 0)
    time.sleep(2)
    got = feed(spark, str(tmp_path), [[("b", 1, "0 | 1 | 1")]], progress.ocr_progress, schema, patience="1 second")
    assert (got["a"]["completed_pages"], got["a"]["waiting"], got["a"]["skipped"], got["a"]["lines"]) == (8, 0, 3, 3)
    got = feed(spark, str(tmp_path), [[("a", 2, "1 | 99 | 9"), ("a", 7, None)]], progress.ocr_progress, schema, patience="1 second")
    assert (got["a"]["completed_pages"], got["a"]["late"], got["a"]["lines"]) == (8, 1, 4)


def test_index_stages(spark, tmp_path):
    schema = "run_id string, line_no bigint, line string"
    log = ["📁 Creating new case: **x**...", "Created **4** chunk(s) for a.", "Created *3* chunk(s)", "Embedding and indexing 7 chunks", "now indexing **7** chunks", "[PROGRESS:embedding:3/8] and so on", "[PROGRESS:indexing:5/7]"]
    rows = [("a", i + 1, x) for i, x in enumerate(log)] + [("b", 1, "Copied"), ("b", 2, "[PROGRESS:embedding:1/3]"), ("c", 1, log[1]), ("c", 2, "✅ Done.")]
    got = feed(spark, str(tmp_path), [rows[::-1][:5], rows[::-1][5:]], progress.index_progress, schema)
    by = lambda r: [tuple(got[r, k][c] for c in ("stage", "status", "details", "percent", "chunks")) for k in range(1, 6)]
    assert by("a") == [("prepare", "success", "", None, 7), ("upload", "success", "", None, 7), ("chunk", "success", "", None, 7), ("embed", "success", "3/8 chunks", None, 7), ("index", "running", "5/7 chunks", 71, 7)]
    assert by("b")[2:] == [("chunk", "success", "", None, 0), ("embed", "running", "1/3 chunks", 33, 0), ("index", "pending", "", None, 0)]
    assert {x[1] for x in by("c")} == {"success"} and by("c")[0][4] == 4


def test_file_status(spark):
    files = spark.createDataFrame([("r", i, f"{i}.pdf", 2 if i else None) for i in range(4)], "run_id string, file_no bigint, filename string, pages int")
    outputs = spark.createDataFrame([("r", "1_x.md"), ("r", "1_x.md"), ("r", "2_y.md"), ("r", "3_z.pdf"), ("s", "0_a.md"), ("r", None)], "run_id string, output string")
    failed = spark.createDataFrame([("r", 2)], "run_id string, file_no int")
    assert sorted((r["file_no"], r["pages"], r["status"]) for r in progress.file_status(files, outputs, failed).collect()) == [(0, 0, "pending"), (1, 2, "completed"), (2, 2, "failed"), (3, 2, "pending")]


def test_many_keys_share_a_call_and_keep_their_own_time_outs(spark, tmp_path, monkeypatch):
    """All keys in one group: numbers, late lines and time-outs are still each key's own."""
    monkeypatch.setattr(progress, "GROUPS", 1)
    schema = "run_id bigint, line_no bigint, line string"
    rows = [(r, n, f"0 | {n} | 9") for r in range(40) for n in (1, 3)]
    got = feed(spark, str(tmp_path), [rows], progress.ocr_progress, schema, patience="1 second")
    assert {(r["completed_pages"], r["lines"], r["waiting"]) for r in got.values()} == {(1, 1, 1)} and set(got) == {*range(40)}
    time.sleep(2)
    got = feed(spark, str(tmp_path), [[(7, 2, "0 | 2 | 9"), (7, 5, "0 | 5 | 9"), (7, 1, "0 | 8 | 9")]], progress.ocr_progress, schema, patience="1 second")
    assert [got[7][c] for c in ("completed_pages", "lines", "waiting", "late", "skipped")] == [3, 3, 1, 1, 0]
    assert {tuple(got[k][c] for c in ("completed_pages", "lines", "waiting", "late", "skipped")) for k in got if k != 7} == {(3, 2, 0, 0, 1)}
