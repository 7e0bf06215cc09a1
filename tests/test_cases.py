"""Retrieval, chronology, answers, registry and streams on small tables."""

import datetime
import json

import numpy as np
from pyspark.sql import functions as F

from casegrid.operators import answers, casefile, chronology, reconcile, registry, retrieval
from casegrid.sources import io, tables
from casegrid.streaming import streams


def test_mmr_order():
    assert retrieval.mmr_order(np.array([0.9, 0.85, 0.7]), ["shoulder pain acute", "acute shoulder pain", "knee replacement surgery"], 2) == [0, 2]
    assert retrieval.mmr_order(np.array([0.9, -np.inf, -np.inf]), ["a", "b", "c"], 3) == [0]


def test_vector_search_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id bigint, vector array<double>")
    queries = points.where("item_id % 20 = 0").withColumnsRenamed({"item_id": "query_id", "vector": "query_vector"})
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in retrieval.vector_search(queries, points, 5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 200, 20):
        scores = np.round(u @ u[q], 6)
        assert [got[q, k + 1] for k in range(5)] == list(np.lexsort((np.arange(200), -scores))[:5])


def test_vector_search_in_blocks(spark, monkeypatch):
    """More queries than are sent: the same hits, and what the tasks send back doesn't grow with the session's partitions."""
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((600, 4)), 1)  # many equal scores
    x[7] = 0
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id bigint, vector array<double>").repartition(5)
    queries = points.where("item_id % 3 = 0").select(F.col("item_id").alias("query_id"), F.col("vector").alias("query_vector"), (F.col("item_id") % 7 * 5).cast("int").alias("k"), F.when(F.col("item_id") % 2 == 0, 0.6).alias("threshold"))
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = set()
    for q in range(0, 600, 3):
        scores = np.round(u @ u[q], 6)
        want |= {(q, int(i), n + 1) for n, i in enumerate(np.lexsort((np.arange(600), -scores))[: q % 7 * 5]) if q % 2 or scores[i] >= 0.6}
    hits = lambda df: {(r["query_id"], r["item_id"], r["rank"]) for r in df.collect()}
    assert hits(retrieval.vector_search(queries, points)) == want
    monkeypatch.setattr(retrieval, "SENT_QUERIES", 20)
    assert hits(retrieval.vector_search(queries, points)) == want
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 30)
    assert hits(retrieval.vector_search(queries, points)) == want
    assert hits(retrieval.vector_search(queries, points, shares=2)) == want
    sent = []
    for n in (4, 60):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        sent.append(retrieval._by_blocks(queries, points, None).count())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sent[0] == sent[1]


def test_chronology_segments_and_clauses(spark):
    text = "2011 - Arthroscopy for pain of the left knee; 1998? - Fracture treated after reported pain."
    c = spark.createDataFrame([("r", "c", "A", text)], "run_id string, chunk_id string, author string, text string")
    got = [(r["event_date"], r["source_quote"]) for r in chronology.dated_mentions(c).orderBy("ord").collect()]
    assert [d for d, _ in got] == ["2011", "1998"]
    assert "1998" not in got[0][1] and "2011" not in got[1][1]


def test_near_duplicate_events_merge_sources(spark):
    rows = [("r", "2020-01-01", "day", f"c{i}", i, "x", "event_date", "T", "A", q, [f"c{i}"]) for i, q in enumerate(["left knee pain reported today again", "left knee pain reported today", "other words entirely here"])]
    e = spark.createDataFrame(rows, "run_id string, event_date string, date_precision string, chunk_id string, ord int, date_original string, date_role string, event_type string, provider string, source_quote string, sources array<string>")
    got = sorted((r["source_quote"], r["sources"]) for r in chronology.near_duplicate_events(e).collect())
    assert got == [("left knee pain reported today again", ["c0", "c1"]), ("other words entirely here", ["c2"])]


def test_greedy_batches_put_an_oversized_chunk_alone(spark):
    c = spark.createDataFrame([("r", "f", "d", i, f"c{i}", "x" * n) for i, n in enumerate([100, 100, 9000, 100])], "run_id string, original_filename string, doc_id string, chunk_index int, chunk_id string, text string")
    got = {r["chunk_id"]: r["batch_no"] for r in chronology.greedy_batches(c, 2000).collect()}
    assert got == {"c0": 0, "c1": 0, "c2": 1, "c3": 2}


def test_answers(spark):
    a = spark.createDataFrame([(1, "x [Source 1, 3] y [sources: 9]", 2), (2, "plain", 0)], "query_id int, answer string, source_count int")
    got = a.select(answers.invalid_sources(F.col("answer"), F.col("source_count")).alias("i"), answers.sanitise(F.col("answer"), F.col("source_count")).alias("s")).collect()
    assert got[0]["i"] == [3, 9] and got[1]["s"] == "plain"
    assert got[0]["s"] == "x [Source 1] [citation reference unavailable: 3] y [citation reference unavailable: 9]"
    m = spark.createDataFrame([(1, 0, "| a | b |\n|---|---|\n| 1 | x \\| y |")], "session_id int, turn int, content string")
    assert [r["cells"] for r in answers.table_rows(m).orderBy("row_no").collect()] == [["a", "b"], ["1", "x | y"]]


def test_client_names_and_injuries(spark):
    got = spark.createDataFrame([(["mr john smith", "John Smith", "12 High Street", "Al"], "diagnosis of broken left wrist. He has whiplash")], "n array<string>, t string").select(casefile.client_names(F.col("n")).alias("n"), casefile.injury_phrases(F.col("t")).alias("i")).first()
    assert got["n"] == ["John Smith"]
    assert got["i"] == ["broken left wrist", "Whiplash"]


def test_reconcile_small(spark):
    docs = spark.createDataFrame([("doc-1", "r", "indexed"), ("doc-2", "r", "indexed")], "doc_id string, run_id string, status string")
    chunks = spark.createDataFrame([("c1", "doc-1", "r", "p1"), ("c2", "doc-2", "r", None)], "chunk_id string, doc_id string, run_id string, point_id string")
    points = spark.createDataFrame([("p1", "c1", "doc-1", "r"), ("p2", "gone", "doc-9", "r"), ("p3", "gone", "doc-9", "s")], "point_id string, chunk_id string, doc_id string, run_id string")
    got = {(r["run_id"], r["category"]): r["issues"] for r in reconcile.reconcile(docs, chunks, points).collect()}
    assert (got["r", "chunks_without_point"], got["r", "points_without_chunk"], got["s", "points_without_chunk"], got["r", "incomplete_documents"]) == (1, 1, 1, 1)


def test_publish_keeps_the_old_version_on_failure(spark, tmp_path):
    root = str(tmp_path / "t")
    a = spark.range(5)
    registry.publish({"a": a}, root)
    try:
        registry.publish({"a": a.withColumn("id", F.raise_error(F.lit("no")).cast("bigint"))}, root)
    except Exception as e:
        assert "no" in str(e)
    assert registry.published(spark, root, "a").count() == 5


def test_incremental_ingest_replaces_one_document(spark, tmp_path):
    inbox, root, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "a.md").write_text("first text of a")
    (inbox / "b.md").write_text("text of b")
    streams.incremental_ingest(streams.markdown_stream(spark, str(inbox)), root, "/ws/x", state, buckets=4).awaitTermination()
    assert sorted(r["text"] for r in registry.published(spark, root, "chunks").collect()) == ["first text of a", "text of b"]
    sub = inbox / "later"
    sub.mkdir()
    (sub / "a.md").write_text("second text of a")
    streams.incremental_ingest(streams.markdown_stream(spark, str(inbox)), root, "/ws/x", state, buckets=4).awaitTermination()
    assert sorted(r["text"] for r in registry.published(spark, root, "chunks").collect()) == ["second text of a", "text of b"]


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "1_a.md").write_text("hello\nthere")
    assert [tuple(r) for r in io.scan_markdown(spark, str(tmp_path / "x")).collect()] == [("1_a.md", "hello\nthere")]
    assert {r["bucket"]: (r["objects"], r["bytes"]) for r in io.object_inventory(spark, str(tmp_path), ["x", "y"]).collect()} == {"x": (1, 11), "y": (0, 0)}
    (tmp_path / "r.jsonl").write_text('{"metadata": {"Source-File": "p/a.pdf"}, "attributes": {"pdf_page_numbers": [[0, 5, 1]]}}\n\nnot json\n')
    got = io.scan_ocr_results(spark, str(tmp_path / "r.jsonl")).collect()
    assert [(r["original_filename"], r["page_ranges"][0]["page"]) for r in got] == [("a.pdf", 1)]


def test_timeline_needs_every_end_page(spark):
    rows = [("r", "d", i, "1/2/2020", "2020-02-01", "A", "letter", None, None, "s", p, e, 0, 9, "original_pdf") for i, (p, e) in enumerate([(2, 3), (4, None)])]
    t = spark.createDataFrame(rows, "run_id string, doc_id string, ord int, date_raw string, date_iso string, physician string, document_type string, ref_no string, clinic string, summary string, page_start int, page_end int, char_start int, char_end int, provenance_type string")
    r = casefile.timeline_groups(t).first()
    assert (r["page_range"], r["page_provenance"]) == ("Starts on page 2; end page not present in source metadata", "Incomplete original-PDF page provenance")
    assert datetime.date(2020, 2, 1)


def test_case_names_beyond_a_thousand_rejected_ones(spark):
    junk = [("r", f"{i} Long High Street Of A Distant Town {i}") for i in range(1200)]
    few = ["mr john smith", "John Smith", "12 High Street", "Al", "jane roe", "Dr Jane Roe", "smith", None]
    rows = junk + [("r", n) for n in few] + [("s", n) for n in few] + [("t", "12 High Street"), ("t", None)]
    chunks = spark.createDataFrame([(r, n, "text") for r, n in rows], "run_id string, patient_name string, text string")
    got = {r["run_id"]: r["names"] for r in casefile.case_metadata(chunks).collect()}
    whole = chunks.where("patient_name is not null").groupBy("run_id").agg(casefile.client_names(F.array_sort(F.collect_set("patient_name"))).alias("n"))
    assert got == {r["run_id"]: r["n"] for r in whole.collect()} and got["r"] == ["John Smith", "Jane Roe"] and got["t"] == []


def test_mmr_query_reads_whole_texts(spark, tmp_path):
    from casegrid.plans import case_queries

    same, tails = "word " * 200, ["alpha " + " ".join(f"x{i}" for i in range(300))] * 2 + [" ".join(f"y{i}" for i in range(300))]
    vectors = [[1.0, 0.0], [0.9, float(np.sqrt(1 - 0.81))], [0.8, 0.6]]
    spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>").withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, same + t) for i, t in enumerate(tails)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["ord"] for r in case_queries.mmr(spark, str(tmp_path)).where("query_id = 0").orderBy("mmr_rank").collect()]
    assert got == [1, 3, 2]  # 2 repeats 1; 3 differs only after the first 800 characters


def test_responses_short_keys_and_all_fields(spark):
    long = {"event_date": "2021-13-01", "date_precision": "day", "date_role": "made up", "event_type": "visit", "provider": "Dr Ann Low", "facility": "Nowhere Clinic", "source_ids": [1, 9], "source_quote": "seen for knee pain"}
    long |= {"investigations_findings": "scan showed tumour growth", "intervention_plan": "knee brace", "administrative_context": "probably billed", "diagnosis": "patient with knee pain"}
    short = {"d": "2021-02-03", "p": "day", "od": "03/02/2021", "pr": "Pat Reed", "src": 1, "q": "Seen for  knee pain"}
    held = {"q": "seen for knee pain", "src": 1, "t": "Missing-value phrase"}
    text = "```json\n" + json.dumps({"events": [long, short, held, {"src": 2, "q": "seen"}, "none"], "complete": False}) + "\n```"
    sources = spark.createDataFrame([("b", 1, "03/02/2021 Dr Ann Low: seen for knee pain, given a knee brace", "pat reed")], "batch_id string, source_no int, text string, author string")
    responses = spark.createDataFrame([("b", 1, text)], "batch_id string, page int, response string")
    got = {r["event_no"]: r for r in chronology.ground_events(chronology.response_events(responses), sources).collect()}
    assert [got[i]["reject_reason"] for i in range(5)] == [None, None, "placeholder text", "no single valid source", "no single valid source"]
    a = got[0]
    assert (a["event_date"], a["date_precision"], a["date_role"], a["provider"], a["facility"], a["quote_at"]) == ("", "unknown", "ambiguous", "Dr Ann Low", "", 23)
    assert (a["investigations_findings"], a["intervention_plan"], a["administrative_context"], a["diagnosis"]) == ("", "knee brace", "", "patient with knee pain")
    assert a["warnings"] == ["administrative_context only infers", "facility not in the source", "investigations_findings not in the source"]
    assert (got[1]["event_type"], got[1]["date_role"], got[1]["provider"], got[1]["provider_role"], got[1]["event_date"]) == ("clinical event", "event_date", "Pat Reed", "documenting_provider", "2021-02-03")


def test_pages_end_at_an_empty_or_missing_one(spark):
    page = lambda quotes, complete=False: json.dumps({"events": [{"q": q, "src": 1} for q in quotes], "complete": complete})
    rows = [("a", 1, page(["one"])), ("a", 2, page([])), ("a", 3, page(["two"])), ("b", 1, page(["one", "two"])), ("b", 3, page(["three"])), ("c", 1, page(["two", "one"])), ("d", 1, None), ("e", 1, page(["one"], True)), ("e", 2, page(["two"]))]
    sources = spark.createDataFrame([(b, 1, "one two three", None) for b in "abcde"], "batch_id string, source_no int, text string, author string")
    got = chronology.validate_pages(spark.createDataFrame(rows, "batch_id string, page int, response string"), sources)
    assert {(r["batch_id"], r["page"]) for r in got.where("accepted").collect()} == {("a", 1), ("a", 2), ("b", 1), ("e", 1)}


def test_tables_are_created_evolved_and_emptied(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write_tables(spark, root)
    assert {n: registry.published(spark, root, n).count() for n in tables.SCHEMAS} == {"runs": 0, "documents": 0, "chunks": 0}
    d = spark.createDataFrame([("d1", "r", "pending", 1), ("d2", "r", None, 2)], "doc_id string, run_id string, status string, more int").withColumn("indexed_at", F.when(F.col("doc_id") == "d1", F.current_timestamp()))
    registry.publish({"documents": d}, root)
    tables.write_tables(spark, root)
    held = registry.published(spark, root, "documents")
    assert {(r["doc_id"], r["status"], r["more"]) for r in held.collect()} == {("d1", "indexed", 1), ("d2", "pending", 2)} and "markdown_path" in held.columns
    registry.delete_all({"documents": held}, root)
    assert registry.published(spark, root, "documents").count() == 0 and registry.published(spark, root, "documents").columns == held.columns


def test_names_from_text(spark):
    texts = [("a", 1, None, "Patient: Road Street\nRe: Mrs. Orla Pim\nx"), ("a", 0, " ", "no name"), ("b", 0, "Tam Lin", "Client Not Used"), ("c", 0, None, "Re: The Referral Letter, Client Ina Bell called"), ("d", 0, None, "nothing"), ("e", 2, "12 High Street", "Uma Vell DOB 1/1/1970"), ("e", 1, None, "Patient Zed O`Neil")]
    got = casefile.case_names(spark.createDataFrame(texts, "run_id string, at int, patient_name string, text string"), "at")
    assert {r["run_id"]: r["names"] for r in got.collect()} == {"a": ["Orla Pim"], "b": ["Tam Lin"], "c": ["Ina Bell"], "e": ["Zed O`Neil"]}


def test_dashboard_of_cases_without_metadata(spark):
    runs = spark.createDataFrame([("r1", "/ws/run_x/", 2, 3, 1), ("r2", None, None, None, None)], "run_id string, run_dir string, total_documents int, total_chunks int, unique_authors int").withColumns({"earliest_date": F.lit(None).cast("date"), "latest_date": F.lit(None).cast("date")})
    meta = spark.createDataFrame([("r1", ["A B", "C D"], "01/01/1990", ["Sprain"])], "run_id string, names array<string>, dob string, injuries array<string>")
    got = {r["run_id"]: tuple(r)[1:8] for r in casefile.case_dashboard(runs, meta).collect()}
    assert got == {"r1": ("run_x", "A B, C D", "01/01/1990", ["Sprain"], 2, 3, 1), "r2": ("r2", "Unknown Client", "—", [], 0, 0, 0)}


def test_a_text_is_searched_for_dates_once(spark):
    """Mentions by their places, with clauses cut at stops, and a plan that runs the dates' pattern over a text once (over a clause once more)."""
    text = "Seen. Pain on 3 Feb 2020; <b>surgery</b>\n on 2020-02-30. Scan 1/2/2019, review\t12.3.2019; x"
    c = spark.createDataFrame([("r", "c", None, text)], "run_id string, chunk_id string, author string, text string")
    found = chronology.dated_mentions(c)
    assert [(r["ord"], r["event_date"], r["date_original"], r["source_quote"]) for r in found.orderBy("ord").collect()] == [(14, "2020-02-03", "3 Feb 2020", "Pain on 3 Feb 2020;"), (54, "2019-02-01", "1/2/2019", "1/2/2019, review"), (71, "2019-03-12", "12.3.2019", "12.3.2019;")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?i)(?=[0-9]|ja") == 2


def test_injury_phrases_are_looked_for_once_and_by_their_words(spark):
    """Plain patterns and the words that go before them find the same; the plan names each pattern once."""
    texts = ["DIAGNOSIS OF torn left labrum. x", "was Diagnosed with a bad knee. Sustained a fall at work", "RE: Mr A Date of Birth: 1/2/1970\nsore right elbow joint", "Injury: broken toe bone", "Injuries were many and varied", "old SLAP tear, Whiplash", "nothing", None]
    c = spark.createDataFrame([("r", f"c{i}", t) for i, t in enumerate(texts)], "run_id string, chunk_id string, text string")
    plain = F.concat(*[F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(1)) for p in (*casefile.P.INJURIES, f"({casefile.P.NAMED_INJURIES})")])
    rows = c.where("text IS NOT NULL").select(plain.alias("p"), casefile.injury_phrases(F.col("text")).alias("i")).collect()
    assert [bool(r["p"]) for r in rows] == [bool(r["i"]) for r in rows] == [True] * 6 + [False]
    found = casefile.case_injuries(c)
    assert found.first()["injuries"] == ["Torn left labrum", "A bad knee", "Fall at work", "Sore right elbow joint"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?i)injury\\s*:") == 1


def test_grounding_flattens_without_touching_single_blanks(spark):
    """Quotations are found over any white space; single blanks are no match of the pattern that makes runs one."""
    e = spark.createDataFrame([(1, 1, '{"events": [{"q": "Pain  was\\u2003felt", "src": 1, "t": "note"}], "complete": true}')], "batch_id bigint, page int, response string")
    sources = spark.createDataFrame([(1, 1, "So:\n\n pain \t was felt today", "A")], "batch_id bigint, source_no int, text string, author string")
    found = chronology.ground_events(chronology.response_events(e), sources)
    assert [(r["source_no"], r["quote_at"], r["reject_reason"]) for r in found.collect()] == [(1, 4, None)]
    assert "(?U)\\s+" not in found._jdf.queryExecution().optimizedPlan().toString()
