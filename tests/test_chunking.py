import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from casegrid.functions import patterns as P, textcols as T
from casegrid.operators import chunking
from casegrid.plans import adapters


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n\t", max_size=400), st.integers(1, 60), st.integers(-5, 80))
def test_chunk_spans_progress_and_cover(text, size, overlap):
    spans = chunking.chunk_spans(text, size, overlap)
    assert all(a < b for a, b in spans) or len(text) <= size
    assert all(x[0] < y[0] for x, y in zip(spans, spans[1:]))
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    if len(text) > size:
        assert all(b - a <= size for a, b in spans)


def test_chunks_are_exact_slices_with_unique_ids(spark, sf_dir):
    chunks, docs = adapters.chunks(spark, sf_dir), adapters.case_documents(spark, sf_dir)
    joined = chunks.join(docs.select(F.col("doc_id").alias("d"), F.col("text").alias("full")), F.col("doc_id") == F.col("d"))
    wrong = joined.where(F.expr("substring(full, source_char_start + 1, source_char_end - source_char_start) <> text"))
    assert wrong.count() == 0
    assert chunks.count() == chunks.select("chunk_id").distinct().count() > 0


def test_sections_and_page_edges(spark):
    text = "\n" * 50 + "Dear Dr A\n" + "x" * 300 + "\nCT OF SPINE\nfindings\U0001F600" + "y" * 300 + "\nElectronically signed by B\n" + "z" * 250
    docs = spark.createDataFrame([("d", "r", "f.md", text, [(0, 40, 1), (40, 2000, 2)], "original_pdf"), ("e", "r", "g.md", "  \n ", [], "x"), ("n", "r", "h.md", None, [], "x")], "doc_id string, run_id string, original_filename string, text string, page_ranges array<struct<start:int,end:int,page:int>>, provenance_type string")
    found = chunking.sections(docs).orderBy("start").collect()
    assert all(text[s["start"] : s["end"]] == s["section_text"] for s in found)
    assert [s["section_text"].split("\n")[0][:11] for s in found] == ["Dear Dr A", "CT OF SPINE", "z" * 11]
    first = chunking.chunk_documents(docs).orderBy("chunk_index").first()
    assert (first["source_char_start"], first["page_start"]) == (50, 2)
    assert chunking.chunk_documents(docs.limit(0)).count() == 0


def test_split_sections_query_returns_every_section_of_long_texts(spark, monkeypatch):
    import random
    import re

    from casegrid.functions import patterns as P
    from casegrid.plans import text_queries

    def brute(text):
        titles = {m.start() for m in re.finditer(P.REPORT_TITLE, text)}
        marks = {0} | titles | {m.end() for m in re.finditer(P.SIGNED_LINE, text)} | {m.start() for p in P.SECTION_STARTS for m in re.finditer(p, text)}
        kept = []
        for b in sorted(marks):
            if not kept or b - kept[-1] >= P.LEAST_SECTION:
                kept.append(b)
            elif b in titles and kept[-1] not in titles:
                kept[-1] = b
        cut = [(n, a, text[a:b]) for n, (a, b) in enumerate(zip(kept, [*kept[1:], len(text)], strict=True))]
        return [(n, a + len(t) - len(t.lstrip()), a + len(t.rstrip())) for n, a, t in cut if t.strip()]

    rng = random.Random(2)
    lines = ["Dear Dr A", "CT OF SPINE", "Electronically signed by B", "Re: a claim", "ELECTRONIC TRANSMISSION", "plain words " * 9, "more words " * 25, ""]
    texts = {i: "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 40))) for i in range(30)} | {99: "Dear Dr A\n" + "long " * 21000 + "\nCT OF SPINE\n" + "found " * 60}
    table = spark.createDataFrame(list(texts.items()), "record_id bigint, text string")
    monkeypatch.setattr(text_queries.A, "records", lambda spark, sf_dir: table)
    got = sorted(tuple(r[c] for c in ("record_id", "section_no", "section_start", "section_end")) for r in text_queries.split_sections(spark, "").collect())
    assert got == sorted((i, *s) for i, t in texts.items() for s in brute(t)) and len([g for g in got if g[0] == 99]) == 2


WORDED = [
    (P.REPORT_TITLE, P.REPORT_TITLE_WORDS), (P.SIGNED_LINE, P.SIGNED_LINE_WORDS), *zip(P.SECTION_STARTS, P.SECTION_START_WORDS), (T.loose(P.AUTHOR_SIGNATURE), P.AUTHOR_SIGNATURE_WORDS), (T.loose(P.AUTHOR_SENDER), P.AUTHOR_SENDER_WORDS),
    *[(T.loose(p), P.DOCUMENT_TYPE_WORDS[n]) for n, p in P.DOCUMENT_TYPES.items()], (T.loose(P.RADIOLOGY_PART), P.RADIOLOGY_PART_WORDS), *[(T.loose(p), P.SECTION_TYPE_WORDS[n]) for n, p in P.SECTION_TYPES.items()], *[(T.loose(p), w) for p, w in zip(P.PATIENT, P.PATIENT_WORDS)],
]


@pytest.mark.parametrize("pattern,words", WORDED)
def test_whatever_a_pattern_matches_holds_one_of_its_words(pattern, words):
    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern)))
    def holds(text):
        if all(ord(c) < 128 for c in text) or not pattern.startswith("(?i)"):  # the column form folds ASCII letters only
            assert any(w in text.casefold() for w in words)

    holds()


def test_section_starts_in_one_pass():
    body = "word " * 60
    text = f"Dear Dr Roe\n{body}\nRe: close to it\n{body}\nRe: a\nCT OF THE KNEE\n{body}\nElectronically signed by X\n{body}"
    title, re_, end = text.index("CT OF"), text.index("Re: close"), text.index("signed by X") + 11
    assert chunking.section_starts(text) == [0, re_, title, end]  # the title takes the place of the line before it
    assert chunking.section_starts("") == [0] and chunking.section_starts("Re: x\nRe: y") == [0]


def test_a_section_says_whether_it_is_its_whole_text(spark):
    """What was found in a text is not looked for again in its only section; padded or split texts are."""
    texts = ["Dear Dr A, seen on 3 May 2011.\n\nKind regards\n\nDr Odo Fennick", " padded ", "first " * 60 + "\nDear Dr B\n" + "second " * 60]
    docs = spark.createDataFrame([(str(i), "r", f"{i}.md", t, [], "p") for i, t in enumerate(texts)], "doc_id string, run_id string, original_filename string, text string, page_ranges array<struct<start:int,end:int,page:int>>, provenance_type string")
    got = chunking.sections(docs).orderBy("doc_id", "section_no").select("doc_id", "whole").collect()
    assert [tuple(r) for r in got] == [("0", True), ("1", False), ("2", False), ("2", False)]
    one = chunking.chunk_documents(docs).where("doc_id = '0'").first()
    assert (one["document_type"], one["author"], str(one["date_extracted"]), one["date_raw"]) == ("specialist_letter", "Odo Fennick", "2011-05-03", "3 May 2011")


def test_large_batches_are_cut_in_pieces():
    """A batch of long texts comes in pieces of bounded size, whole and in order; so do null and empty texts."""
    texts = ["x" * 400_000, None, "", "y" * 3_000_000, "z", *["w" * 1000] * 5000]
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": texts})
    pieces = list(chunking._pieces([batch, batch.slice(0, 0)], "text"))
    assert [i for p in pieces for i in p.column("n").to_pylist()] == list(range(len(texts)))
    assert len(pieces) > 5 and all(len(p) == 1 or sum(len(t or "") for t in p.column("text").to_pylist()[:-1]) <= chunking.SLICE for p in pieces)
    schema = pa.schema([("n", pa.int64()), *((c, pa.int32()) for c in ("section_no", "start", "end")), ("section_text", pa.string()), ("whole", pa.bool_())])
    assert len(list(chunking._cut("n", (), schema)([batch.filter(pc.is_valid(batch.column("text")))]))) > 5  # null texts never come here


def test_documents_without_pages_need_no_page_ranges(spark):
    docs = spark.createDataFrame([("0", "r", "0.md", "Dear Dr A, seen on 3 May 2011.\n\nKind regards\n\nDr Odo Fennick", [], "p"), ("1", "r", "1.md", "first " * 60 + "\nDear Dr B\n" + "second. " * 300, [], "p")], "doc_id string, run_id string, original_filename string, text string, page_ranges array<struct<start:int,end:int,page:int>>, provenance_type string")
    with_, without = chunking.chunk_documents(docs), chunking.chunk_documents(docs.drop("page_ranges"))
    assert with_.schema == without.schema and sorted(with_.collect()) == sorted(without.collect()) and without.count() > 4
