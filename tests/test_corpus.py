"""The one handle over a store of cases."""

from pyspark.sql import functions as F

from casegrid.corpus import Corpus

LETTER = "12/03/2019 consultation attended\nRe: Orla Pim DOB: 01/02/1970\n\nDear Dr Roe\n\nOn examination pain was reported on {}. Diagnosis: sprain of the ankle\n\nKind regards\n\nDr Wren Tarn"


def test_index_ask_and_delete(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "store"))
    (tmp_path / "in").mkdir()
    for i, day in enumerate(("12/03/2019", "15/04/2019")):
        (tmp_path / "in" / f"{i}.md").write_text(LETTER.format(day))
    assert c.index_folder(str(tmp_path / "in"), "/ws/a") == 1
    more = spark.createDataFrame([("x.md", LETTER.format("01/05/2020"))], "original_filename string, text string")
    assert c.index(more, "/ws/b") == 2 == c.index(more.limit(0), "/ws/b") - 1
    totals = c.stats().first()
    assert (totals["indexed_runs"], totals["indexed_documents"], totals["chunks"], totals["authors"]) == (2, 3, 3, 1)
    assert {r["run_dir"]: r["chunks"] for r in c.cases().collect()} == {"/ws/a": 2, "/ws/b": 1}
    (a,) = c.dashboard(["/ws/a"]).collect()
    assert (a["run_name"], a["client_name"], a["dob"], a["documents_count"], a["chunks_count"]) == ("a", "Orla Pim", "01/02/1970", 2, 2)
    assert c.timeline(["/ws/b"]).count() == 1
    assert {r["event_date"] for r in c.chronology(["/ws/a"]).collect()} == {"2019-03-12", "2019-04-15"}
    points = c.point_ids()
    assert c.reconcile(points).where("issues > 0").count() == 0
    lost = {(r["category"], r["issues"]) for r in c.reconcile(points.where(F.col("run_id") == c.case_id("/ws/a"))).where("issues > 0").collect()}
    assert ("chunks_without_point", 1) in lost
    c.delete("/ws/a")
    assert c.stats().first()["chunks"] == 1 and c.chunks(["/ws/a"]).count() == 0 and c.chunks(["/ws/a"], at=2).count() == 2
    assert {r["run_dir"] for r in c.cases().collect()} == {"/ws/b"}
    assert c.table("point_changes").where("change = 'stale'").count() == 2 and c.versions() == [1, 2, 3, 4]
