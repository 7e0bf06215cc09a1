"""CHR11: chronologies as Markdown: the table in five or seven columns, notices and the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from casegrid.functions import patterns as P, textcols as T


def _given(value: Column) -> Column:
    return ~F.coalesce(value, F.lit("")).isin(*P.NOT_GIVEN, "")


def _cell(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value, F.lit(P.MISSING)), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(_cell, cells)), F.lit(" |"))


def source_name(s: Column) -> Column:
    """A source struct as type, author, file, and pages or else characters."""
    text = lambda c: F.nullif(F.trim(F.coalesce(s[c].cast("string"), F.lit(""))), F.lit(""))
    span = lambda sign, a, b: F.concat(F.lit(sign), s[a].cast("string"), F.lit("–"), s[b].cast("string"))
    pages = F.when(s["page_start"] == s["page_end"], F.concat(F.lit("p. "), s["page_start"].cast("string"))).otherwise(span("pp. ", "page_start", "page_end"))
    return F.concat_ws(", ", text("document_type"), F.concat(F.lit("author: "), text("author")), F.coalesce(text("original_filename"), F.lit(P.NO_FILE)), F.coalesce(pages, span("chars ", "source_char_start", "source_char_end")))


def event_sources(sources: Column, quote: Column) -> Column:
    """All sources of an event, and the quotation (cut to 140 characters) that it was checked by."""
    said = F.trim(F.regexp_replace(F.coalesce(quote, F.lit("")), r"(?U)\s+", " "))
    short = F.when(F.length(said) > 140, F.concat(F.rtrim(F.substring(said, 1, 137)), F.lit("…"))).otherwise(said)
    names = F.array_join(F.transform(sources, source_name), "; ")
    return F.when(short != "", F.concat(names, F.lit("; verification: “"), short, F.lit("”"))).otherwise(names)


def _lines(table: DataFrame, part: int, lines: Column) -> DataFrame:
    """Rows (run_id, part, line_no, line) of an array of lines; null ones are left out."""
    return table.select("run_id", F.lit(part).alias("part"), F.posexplode(F.array_compact(lines)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint") + 1)


def chronology_lines(events: DataFrame, audits: DataFrame) -> DataFrame:
    """CHR11: (run_id, part, line_no, line) of each case's chronology: head 0, events 1, audit 2.

    ``events``: run_id, chunk_id, event_date, date_precision, date_original,
    event_type, provider, provider_role, facility, presenting_symptoms,
    diagnosis, investigations_findings, intervention_plan, source_quote,
    sources (structs), warnings (array). ``audits``: a row for each case with
    profile (fast and ultra_fast have five columns, others seven) and counts. A
    case without events has head and audit. No case is gathered in a row.
    """
    short = F.col("profile").isin("fast", "ultra_fast")
    incomplete = (F.col("documents_audited") < F.col("documents_total")) | (F.col("chunks_completed") < F.col("chunks_total")) | (F.col("batches_failed") > 0)
    title = F.concat(F.lit(P.CHRONOLOGY_TITLE), F.when(F.col("profile") == "ultra_fast", " — Ultra-Fast Profile").when(F.col("profile") == "fast", " — Fast Profile").otherwise(""))
    blank, ultra = F.lit(""), F.col("profile") == "ultra_fast"
    columns = F.when(short, P.SHORT_COLUMNS).otherwise(P.LONG_COLUMNS)
    rule = F.when(short, "|" + "---|" * 5).otherwise("|" + "---|" * 7)
    head = F.array(title, F.when(incomplete, P.INCOMPLETE_HEAD), blank, F.when(ultra, P.ULTRA_FAST_NOTE), F.when(ultra, ""), columns, rule)

    warned = events.groupBy("run_id").agg(F.sum(F.coalesce(F.size("warnings"), F.lit(0))).alias("n_warnings"))
    audited = audits.join(warned, "run_id", "left").withColumn("n_warnings", F.coalesce("n_warnings", F.lit(0)))
    item = lambda name, *values: F.concat(F.lit(f"- {name}: **"), F.concat_ws("/", *[F.col(v).cast("string") for v in values]), F.lit("**"))
    missed = F.col("documents_audited") < F.col("documents_total")
    after = [x for cond, note in ((missed, P.MISSED_DOCUMENTS), (F.col("batches_failed") > 0, P.FAILED_BATCHES), (F.col("n_warnings") > 0, P.WARNED_ENTRIES)) for x in (F.when(cond, ""), F.when(cond, note))]
    tail = F.array(
        blank, F.lit("### Completeness and data-quality audit"), blank, F.concat(F.lit("- Chronology profile: **"), T.title_case(F.col("profile")), F.lit("**")), item("Documents audited", "documents_audited", "documents_total"),
        item("Source chunks successfully processed", "chunks_completed", "chunks_total"), item("Extraction batches processed", "batches_processed", "batches_total"), item("Valid extraction pages checkpointed", "pages_completed"),
        item("Source chunks completed", "chunks_completed", "chunks_total"), item("Events extracted before deduplication", "events_extracted"), item("Chronology events rendered", "events_rendered"),
        item("Events rejected for missing/invalid provenance or source quotation", "rejected_without_source"), item("Failed extraction batches", "batches_failed"), item("Entries carrying validation warnings", "n_warnings"), *after,
    )

    e = events.join(audits.select("run_id", "profile"), "run_id")
    provider = F.coalesce("provider", F.lit(P.MISSING))
    named = F.when(short & (F.col("provider_role") == "documenting_provider") & (provider != P.MISSING), F.concat(F.lit("Recorded by: "), provider)).otherwise(provider)
    who = F.when(_given(F.col("facility")), F.when(provider != P.MISSING, F.concat_ws("; ", named, "facility")).otherwise(F.col("facility"))).otherwise(named)
    date = T.display_date(F.col("event_date"), F.col("date_precision"), F.col("date_original"))
    told = ("presenting_symptoms", "diagnosis", "investigations_findings")
    summary = F.concat_ws("; ", "event_type", *[F.when(_given(F.col(c)), F.col(c)) for c in told])
    sources = event_sources(F.col("sources"), F.col("source_quote"))
    line = F.when(short, _row(date, who, summary, F.col("intervention_plan"), sources)).otherwise(_row(date, who, *[F.col(c) for c in told], F.col("intervention_plan"), sources))
    key = T.date_sort_key(F.col("event_date"), F.col("date_precision"), F.col("provider"), F.col("event_type"))
    number = F.row_number().over(W.partitionBy("run_id").orderBy("key", "chunk_id", "line")).cast("bigint")
    rows = e.select("run_id", F.lit(1).alias("part"), key.alias("key"), "chunk_id", line.alias("line")).select("run_id", "part", number.alias("line_no"), "line")
    return _lines(audited, 0, head).unionByName(rows).unionByName(_lines(audited, 2, tail))


def render_chronology(events: DataFrame, audits: DataFrame) -> DataFrame:
    """CHR11: (run_id, chronology), a case's lines as one text, which is as long as a reader's document may be."""
    held = F.array_sort(F.collect_list(F.struct("part", "line_no", "line")))
    return chronology_lines(events, audits).groupBy("run_id").agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("chronology"))
