"""Per-case metadata and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from casegrid.functions import patterns as P, textcols as T


def _clean(phrase: Column) -> Column:
    p = F.trim(F.regexp_replace(phrase, r"(?U)\s+", " "))
    p = F.trim(F.regexp_replace(p, r"^(?:[-*•\s\d]+|[A-Za-z]\)\s*)", ""))
    return F.regexp_replace(p, r"""[,.;:"'-]+$""", "")


def injury_phrases(text: Column) -> Column:
    """GEN11: phrases of the five patterns and named injuries, cleaned, distinct without case, in order of pattern."""
    # the lower-case text is an argument, as it would be made again for each word otherwise
    return F.get(F.transform(F.array(F.lower(text)), lambda low: _phrases(text, low)), F.lit(0))


def _phrases(text: Column, low: Column) -> Column:
    none = F.array().cast("array<string>")
    by_pattern = F.concat(*[F.when(T.holds(low, words), F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1))).otherwise(none) for words, p in zip(P.INJURY_WORDS, P.INJURIES, strict=True)])
    good = F.filter(by_pattern, lambda x: ~F.lower(x).rlike(P.IGNORED_NAMES))
    cleaned = F.filter(F.transform(good, _clean), lambda x: (F.length(x) > 5) & (F.length(x) < 90))
    named = F.when(T.holds(low, P.NAMED_INJURIES.split("|")), F.transform(F.regexp_extract_all(text, F.lit(f"(?i)(?:{P.NAMED_INJURIES})"), F.lit(0)), T.title_case)).otherwise(none)
    fold = lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.concat(a, F.array(x)))
    wide = lambda a, x: F.when(F.exists(a, lambda y: F.lower(y).contains(F.lower(x)) | F.lower(x).contains(F.lower(y))), a).otherwise(F.concat(a, F.array(x)))
    return F.aggregate(named, F.aggregate(cleaned, F.array().cast("array<string>"), fold), wide)


def client_names(names: Column) -> Column:
    """CASE1: title case, stop words out, longest first, honorific off, no name inside a kept one; two at most."""
    titled = F.transform(F.filter(F.transform(names, F.trim), lambda n: F.length(n) > 2), T.title_case)
    kept = F.array_distinct(F.filter(titled, lambda n: ~F.lower(n).rlike(P.IGNORED_NAMES)))
    order = F.array_sort(kept, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    bare = F.filter(F.transform(order, lambda n: F.trim(F.regexp_replace(n, r"(?i)^(mr|mrs|ms|dr|prof)\.?\s+", ""))), lambda n: n != "")
    return F.slice(F.aggregate(bare, F.array().cast("array<string>"), lambda a, n: F.when(F.exists(a, lambda y: y.contains(n)), a).otherwise(F.concat(a, F.array(n)))), 1, 2)


def name_in_text(text: Column) -> Column:
    """CASE1: a name as the first of four forms gives it that isn't a stop word; null without one."""
    forms = [F.trim(T.found(text, p, 1)) for p in P.NAMES_IN_TEXT]
    good = [F.when((F.length(n) > 3) & ~F.lower(n).rlike(P.IGNORED_NAMES), n) for n in forms]
    return F.when(T.holds(text, P.NAME_IN_TEXT_WORDS), T.title_case(F.coalesce(*good)))


def case_names(chunks: DataFrame, order: str | None = None) -> DataFrame:
    """CASE1: names by column and, where ``order`` names the column of the source order, for cases without any the first name that a text gives."""
    held = _column_names(chunks)
    if not order:
        return held
    bare = F.trim(F.regexp_replace(F.col("n"), r"(?i)^(mr|mrs|ms|dr|prof)\.?\s+", ""))
    told = chunks.join(held.select("run_id"), "run_id", "left_anti").select("run_id", F.col(order).alias("at"), name_in_text(F.col("text")).alias("n")).where("n IS NOT NULL")
    first = told.groupBy("run_id").agg(F.min_by("n", F.struct("at", "n")).alias("n")).select("run_id", F.array(bare).alias("names"))
    return held.unionByName(first)


def _column_names(chunks: DataFrame) -> DataFrame:
    """(run_id, names): what ``client_names`` makes of all of a case's names, by two aggregates: the first in order, then the first that it doesn't contain."""
    trimmed = chunks.select("run_id", F.trim("patient_name").alias("n")).where(F.length("n") > 2).distinct()
    titled = trimmed.select("run_id", T.title_case(F.col("n")).alias("n")).where(~F.lower("n").rlike(P.IGNORED_NAMES))
    order = F.struct((-F.length("n")).alias("l"), "n")  # before the honorific is off
    bare = titled.select("run_id", order.alias("o"), F.trim(F.regexp_replace("n", r"(?i)^(mr|mrs|ms|dr|prof)\.?\s+", "")).alias("bare")).where("bare <> ''")
    first = bare.groupBy("run_id").agg(F.min_by("bare", "o").alias("first"))
    second = bare.join(first, "run_id").where(~F.contains("first", "bare")).groupBy("run_id").agg(F.min_by("bare", "o").alias("second"))
    return first.join(second, "run_id", "left").select("run_id", F.array_compact(F.array("first", "second")).alias("names"))


def case_metadata(chunks: DataFrame, order: str | None = None) -> DataFrame:
    """AGG8: per case names, dob and, if ``order`` names the column of the source order, injuries; over distinct values only.

    Ties that a set would leave open go to the smaller text. Names are cleaned
    row by row and the two results found by aggregates, so no list of a case's
    names is gathered; the texts themselves never are.
    """
    raw = F.replace(T.found(F.col("text"), "(?i)" + P.DOB, 1), F.lit("."), F.lit("/"))
    dobs = chunks.select("run_id", raw.alias("raw")).where("raw is not null").distinct().withColumn("iso", T.timeline_date(F.col("raw")))
    by_dob = dobs.groupBy("run_id").agg(F.max_by("raw", F.when(F.col("iso").isNotNull(), F.struct(F.length("raw"), "raw"))).alias("dob"), F.array_sort(F.collect_set(F.when(F.col("iso").isNull(), F.col("raw")))).alias("dob_unparsed"))
    cases = chunks.select("run_id").distinct().join(case_names(chunks, order), "run_id", "left").join(by_dob, "run_id", "left")
    lists = ["dob_unparsed"]
    if order:
        cases, lists = cases.join(case_injuries(chunks, order), "run_id", "left"), [*lists, "injuries"]
    return cases.select("run_id", F.coalesce("names", F.array().cast("array<string>")).alias("names"), F.coalesce("dob", F.lit("Not present in source")).alias("dob"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists])


def case_injuries(chunks: DataFrame, order: str = "chunk_id") -> DataFrame:
    """CASE3: a case's first four injuries in source order, generic ones dropped."""
    # "outer": a plain one has its array computed again in a filter below
    rows = chunks.select("run_id", F.col(order).alias("at"), F.posexplode_outer(injury_phrases(F.col("text"))).alias("no", "phrase")).where(F.col("phrase").isNotNull() & ~F.lower("phrase").rlike(P.GENERIC_INJURIES))
    firsts = rows.groupBy("run_id", F.lower("phrase").alias("low")).agg(F.min(F.struct("at", "no", "phrase")).alias("m"))
    ranked = firsts.withColumn("r", F.row_number().over(W.partitionBy("run_id").orderBy("m"))).where("r <= 4")
    shown = F.concat(F.upper(F.substring("m.phrase", 1, 1)), F.substring("m.phrase", 2, 1000))
    return ranked.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", shown.alias("x")))), lambda s: s["x"]).alias("injuries"))


def case_dashboard(runs: DataFrame, metadata: DataFrame) -> DataFrame:
    """AGG16: a row for each case with its name, client, birth date, injuries, counts and dates.

    ``runs``: run_id, run_dir, total_documents, total_chunks, unique_authors,
    earliest_date, latest_date. ``metadata``: run_id, names, dob, injuries; a
    case that it lacks has an unknown client.
    """
    base = F.nullif(F.element_at(F.split(F.regexp_replace(F.coalesce("run_dir", F.lit("")), "/+$", ""), "/"), -1), F.lit(""))
    meta = metadata.select("run_id", "names", "dob", "injuries", F.lit(True).alias("known"))
    count = lambda c, name: F.coalesce(c, F.lit(0)).cast("bigint").alias(name)
    return runs.join(meta, "run_id", "left").select(
        "run_id", F.coalesce(base, "run_id", F.lit("unknown")).alias("run_name"), F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise(P.UNKNOWN_CLIENT).alias("client_name"), F.when(F.col("known"), F.col("dob")).otherwise(P.NO_DOB).alias("dob"),
        F.coalesce("injuries", F.array().cast("array<string>")).alias("injuries"), count("total_documents", "documents_count"), count("total_chunks", "chunks_count"), count("unique_authors", "authors_count"), "earliest_date", "latest_date",
    )


def timeline_groups(rows: DataFrame) -> DataFrame:
    """AGG7/CASE4: one event for each (document, date, physician, type, reference).

    The last page counts only if every row has one. ``rows``: run_id, doc_id, ord, date_raw, date_iso, physician,
    document_type, ref_no, clinic, summary, page_start, page_end, char_start, char_end, provenance_type.
    """
    key = ["run_id", "doc_id", F.coalesce("date_iso", "date_raw").alias("k_date"), "physician", "document_type", "ref_no"]
    first = lambda c: F.min_by(c, "ord").alias(c)
    grouped = rows.groupBy(*key).agg(*[first(c) for c in ("date_raw", "date_iso", "clinic", "summary", "provenance_type")], F.min("page_start").alias("page_start"), F.when(F.count("page_end") == F.count("*"), F.max("page_end")).alias("page_end"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    outside, start, end = F.col("provenance_type") == "external_markdown", F.col("page_start"), F.when(F.col("page_start").isNotNull(), F.col("page_end"))
    pages = F.when(outside, F.lit(None).cast("string")).when(end == start, F.concat(F.lit("Page "), start.cast("string"))).when(end.isNotNull(), F.concat(F.lit("Pages "), start.cast("string"), F.lit("-"), end.cast("string"))).when(start.isNotNull(), F.concat(F.lit("Starts on page "), start.cast("string"), F.lit("; end page not present in source metadata")))
    provenance = F.when(outside, "No original-PDF page provenance (external Markdown)").when(end.isNotNull(), "Original PDF").when(start.isNotNull(), "Incomplete original-PDF page provenance").otherwise("Original-PDF page provenance not present")
    return grouped.withColumns({"page_range": pages, "page_provenance": provenance, "date_status": F.when(F.col("date_iso").isNotNull(), "parsed").otherwise("unparsed")}).drop("k_date")


def case_timeline(chunks: DataFrame) -> DataFrame:
    """CASE4 rows from chunks; order by SRT3: date_iso nulls last, then date_raw."""
    got = T.source_date(F.col("date_extracted"), F.col("date_raw"), F.col("text"))
    rows = chunks.select(
        "run_id", "doc_id", F.col("chunk_index").alias("ord"), got["raw"].alias("date_raw"), got["iso"].alias("date_iso"), F.when(F.length(F.trim("author")) > 2, F.trim("author")).alias("physician"), "document_type",
        T.reference_number(F.col("text")).alias("ref_no"), T.clinic(F.col("text")).alias("clinic"), T.summary(F.col("text")).alias("summary"), "page_start", "page_end", F.col("source_char_start").alias("char_start"), F.col("source_char_end").alias("char_end"), "provenance_type",
    )
    return timeline_groups(rows)
