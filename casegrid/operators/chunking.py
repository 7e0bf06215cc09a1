"""Sections and chunks of documents; every chunk is an exact slice of its source."""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as Y
from pyspark.sql.pandas.types import to_arrow_schema

from casegrid.functions import patterns as P, textcols as T

#: Stands in front of every match while offsets are found; never part of a text that is split.
SIGN = "\u0001"
#: Bytes of text that are cut at once.
SLICE = 1 << 20


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end>> of all matches, code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(0))), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["n"]).alias("end")))).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


_TITLE = re.compile(P.REPORT_TITLE)
_STARTS = [(words, re.compile(p)) for words, p in zip(P.SECTION_START_WORDS, P.SECTION_STARTS, strict=True)]
_SIGNED = re.compile(P.SIGNED_LINE)


def section_starts(text: str) -> list[int]:
    """GEN1: where sections begin. Boundaries closer than the least size to the last kept one are dropped, but a report
    title replaces a nearby generic one. A pattern is looked for only in a text that has one of its words, and a start that
    is no title only from the least size on: before it, it is too close to the first. (Case folding moves no word forward.)"""
    low, least = text.casefold(), P.LEAST_SECTION
    titles = {m.start() for m in _TITLE.finditer(text)} if any(w in low for w in P.REPORT_TITLE_WORDS) else set()
    bounds = {0, *titles}
    for words, pattern in _STARTS:
        if any(low.find(w, least) >= 0 for w in words):
            bounds.update(m.start() for m in pattern.finditer(text, least))
    if any(w in low for w in P.SIGNED_LINE_WORDS):
        bounds.update(m.end() for m in _SIGNED.finditer(text))
    kept: list[int] = []
    for b in sorted(bounds):
        if not kept or b - kept[-1] >= P.LEAST_SECTION:
            kept.append(b)
        elif b in titles and kept[-1] not in titles:
            kept[-1] = b
    return kept


def _pieces(batches, column: str):
    """Batches of thousands of texts in pieces of about SLICE bytes of ``column``, if a single text isn't longer."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        piece = (np.cumsum(size) - size) // SLICE
        for a, b in pairwise([*np.flatnonzero(np.diff(piece, prepend=-1)).tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def _cut(key: str, carried: tuple[str, ...], schema: pa.Schema):
    def run(batches):
        for batch in _pieces(batches, "text"):
            at, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                kept = section_starts(text)
                for no, (a, b) in enumerate(zip(kept, [*kept[1:], len(text)], strict=True)):
                    body = text[a:b].lstrip()
                    start, body = b - len(body), body.rstrip()
                    if body:
                        at.append(i)
                        out.append((no, start, start + len(body), body, len(body) == len(text)))
            held = batch.select([key, *carried]).take(pa.array(at, pa.int64()))
            made = list(zip(*out, strict=True)) or [()] * 5
            columns = [*held.columns, *[pa.array(c, f.type) for c, f in zip(made, list(schema)[len(carried) + 1 :], strict=True)]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def sections(docs: DataFrame, key: str = "doc_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """GEN1: (key, carried columns, section_no, start, end, section_text, whole) of every section; blanks at both ends are
    trimmed; ``whole``: the section is all of its text. A document's sections come out in order, in the task that held its row; nothing is shuffled."""
    rows = docs.where(F.length(F.trim("text")) > 0).select(key, *carried, "text")
    schema = Y.StructType([*[rows.schema[c] for c in (key, *carried)], *[Y.StructField(c, Y.IntegerType()) for c in ("section_no", "start", "end")], Y.StructField("section_text", Y.StringType()), Y.StructField("whole", Y.BooleanType())])
    return rows.mapInArrow(_cut(key, carried, to_arrow_schema(schema)), schema)


_PARAGRAPH = re.compile(r"\n[ \t]*\n+")


def chunk_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """GEN2: greedy spans of at most ``size`` characters: break at the last paragraph gap, sentence end or line end in
    the second half, else hard; the next one begins ``overlap`` characters before the end and always later."""
    n = len(text)
    if n <= size:
        return [(0, n)]
    overlap, spans, at = max(0, min(overlap, size - 1)), [], 0
    while True:
        while at < n and text[at].isspace():
            at += 1
        if at >= n:
            return spans
        limit = min(at + size, n)
        cut = limit
        if limit < n:
            half = at + size // 2
            gaps = [at + m.start() for m in _PARAGRAPH.finditer(text[at:limit]) if at + m.start() >= half]
            sentence, line = text.rfind(". ", at, limit), text.rfind("\n", at, limit)
            cut = gaps[-1] if gaps else sentence + 1 if sentence >= half else line if line >= half else limit
        end = at + len(text[at:cut].rstrip())
        if end <= at:
            at = max(at + 1, cut)
            continue
        spans.append((at, end))
        if end >= n:
            return spans
        at = max(at + 1, end - overlap if overlap else cut)


def _page(position: int, ranges: list[dict]) -> int | None:
    return next((r["page"] for r in ranges if r["start"] <= position < r["end"]), None)


def _split(size: int, overlap: int, kept: tuple[str, ...], paged: bool, schema: pa.Schema):
    """Chunks of sections that come in order, numbered within their document."""

    def run(batches):
        doc, no, index = None, -1, 0
        for batch in _pieces(batches, "section_text"):
            at, out = [], []
            held = [batch.column(c).to_pylist() for c in ("doc_id", "section_no", "start", "section_kind", "section_text")]
            rows = zip(*held, batch.column("page_ranges").to_pylist() if paged else [None] * batch.num_rows, strict=True)
            for i, (own, section, first, kind, text, ranges) in enumerate(rows):
                if own != doc or section <= no:
                    index = 0
                doc, no = own, section
                pages = [r for r in ranges or () if r and r["start"] is not None and r["end"] is not None and r["start"] < first + len(text) and r["end"] > first]
                for a, b in chunk_spans(text, max(size, P.RADIOLOGY_SIZE) if kind == "radiology_report" else size, overlap):
                    at.append(i)
                    out.append((index, first + a, first + b, _page(first + a, pages) if pages else None, _page(first + b - 1, pages) if pages else None, text[a:b], b - a == len(text)))
                    index += 1
            held = batch.select(list(kept)).take(pa.array(at, pa.int64()))
            made = list(zip(*out, strict=True)) or [()] * (len(schema) - len(kept))
            columns = [*held.columns, *[pa.array(c, f.type) for c, f in zip(made, list(schema)[len(kept) :], strict=True)]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def page_of(position: Column, ranges: Column) -> Column:
    """JN9: the first page that holds a position."""
    return F.get(F.transform(F.filter(ranges, lambda r: (r["start"] <= position) & (position < r["end"])), lambda r: r["page"]), F.lit(0))


def deal(docs: DataFrame) -> DataFrame:
    """Rows of a document in one task, in as many tasks as the session's shuffle partitions."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def chunk_documents(docs: DataFrame, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP, *, dealt: bool = False) -> DataFrame:
    """GEN3: chunks with provenance and annotations; a chunk's own finding wins over its section's, then its document's.

    ``docs``: doc_id, run_id, original_filename, text, page_ranges, provenance_type; each row is a document of its own.
    Documents without pages need no page_ranges, which would be carried through every step.
    ``dealt``: the documents have just been dealt out by id.
    """
    if size <= 0:
        raise ValueError("chunk size must be greater than zero")
    # one exchange evens out files of few row groups and very long texts; every later step is narrow. The work is in the
    # texts' patterns, not in their bytes, so the session's partitions are kept as they are instead of being joined by size
    ranges = ("page_ranges",) if "page_ranges" in docs.columns else ()
    docs = docs.select("doc_id", "run_id", "original_filename", "text", *ranges, "provenance_type")
    docs = docs if dealt else deal(docs)
    docs = docs.withColumns({"doc_kind": T.document_type(F.col("text")), "doc_patient": T.patient_name(F.col("text"))})
    s = F.col("section_text")
    section = sections(docs, "doc_id", ("run_id", "original_filename", *ranges, "provenance_type", "doc_kind", "doc_patient"))
    # what was found in a text is not looked for again in its only section, nor a section's in its only chunk
    again = lambda same, known, found: F.when(F.col(same), F.col(known)).otherwise(found)
    section = section.withColumns({"own_kind": again("whole", "doc_kind", T.document_type(s)), "s_author": T.author(s), "s_raw": T.first_date_raw(s), "s_patient": again("whole", "doc_patient", T.patient_name(s))})
    section = section.withColumns({"section_kind": F.when(F.col("own_kind") != "unknown", F.col("own_kind")).otherwise(F.col("doc_kind")), "s_parts": T.date_parts(F.col("s_raw")), "patient_name": F.coalesce("s_patient", "doc_patient")})
    section = section.withColumn("s_iso", T.iso_of_parts(F.col("s_parts")))
    kept = ("doc_id", "run_id", "original_filename", "provenance_type", "section_kind", "s_author", "s_raw", "s_iso", "patient_name")
    section = section.select(*kept, "section_no", "start", "section_text", *ranges)
    found = Y.StructType([*[section.schema[c] for c in kept], *[Y.StructField(c, Y.IntegerType()) for c in ("chunk_index", "source_char_start", "source_char_end", "page_start", "page_end")], Y.StructField("text", Y.StringType()), Y.StructField("whole", Y.BooleanType())])
    rows = section.mapInArrow(_split(size, overlap, kept, bool(ranges), to_arrow_schema(found)), found)
    t, radiology = F.col("text"), F.col("section_kind") == "radiology_report"
    rows = rows.withColumns({"radiology_date": F.when(radiology, T.radiology_date(t)), "own_raw": again("whole", "s_raw", T.first_date_raw(t))})
    return rows.select(
        T.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), "doc_id", "run_id", "chunk_index", "text", F.col("source_char_start").alias("char_start"), F.col("source_char_end").alias("char_end"),
        "source_char_start", "source_char_end", F.col("page_start").alias("page_number"), "page_start", "page_end", "original_filename", "provenance_type", F.col("section_kind").alias("document_type"),
        F.coalesce(F.when(radiology, T.radiology_author(t)), again("whole", "s_author", T.author(t)), "s_author").alias("author"),
        F.coalesce("radiology_date.iso", again("whole", "s_iso", T.first_date_iso(F.col("own_raw"))), "s_iso").cast("date").alias("date_extracted"), F.coalesce("radiology_date.raw", "own_raw", "s_raw").alias("date_raw"),
        T.section_type(t).alias("section_type"), "patient_name", T.token_estimate(t).alias("token_count"),
    )


def page_slices(docs: DataFrame) -> DataFrame:
    """GEN6: (doc_id, page, text) by the page map; without one, parts between rule lines or page marks, else the whole."""
    mapped = docs.where(F.size("page_ranges") > 0).select("doc_id", "text", F.explode("page_ranges").alias("r")).select("doc_id", F.col("r.page").alias("page"), F.substring(F.col("text"), F.col("r.start") + 1, F.col("r.end") - F.col("r.start")).alias("text"))
    parts = F.split(F.col("text"), r"(?m)^(?:---|<!-- page \d+ -->)$", -1)
    loose = docs.where(F.size("page_ranges") <= 0).select("doc_id", F.posexplode(parts).alias("page", "text")).select("doc_id", (F.col("page") + 1).alias("page"), "text")
    return mapped.unionByName(loose)
