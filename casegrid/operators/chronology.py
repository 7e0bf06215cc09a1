"""Complete-case chronologies: preparation, dated mentions, grounding, merging, rendering."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as Y, Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from casegrid.functions import patterns as P, textcols as T
from casegrid.operators import batching
from casegrid.operators.chunking import match_spans

_ORDER = ("original_filename", "doc_id", "chunk_index", "chunk_id")


def drop_exact_repeats(chunks: DataFrame) -> DataFrame:
    """WIN2: of a document's chunks with equal text (white space normalised) the first stays; blank ones go."""
    rows = chunks.where(F.length(F.trim("text")) > 0).withColumn("digest", F.sha2(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), 256))
    first = F.row_number().over(W.partitionBy("doc_id", "digest").orderBy("chunk_index", "chunk_id"))
    return rows.withColumn("r", first).where("r = 1").drop("r", "digest")


def trim_overlaps(chunks: DataFrame) -> DataFrame:
    """WIN3: a chunk loses what the kept one before it in its document already holds."""
    w = W.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")
    text = F.trim("text")
    over = F.greatest(F.lit(0), F.lag("char_end").over(w) - F.col("char_start"))
    rows = chunks.withColumn("over", F.coalesce(over, F.lit(0))).withColumn("over", F.when((F.col("over") > 0) & (F.col("over") < F.length(text)), F.col("over")).otherwise(0))
    return rows.withColumns({"text": F.when(F.col("over") > 0, F.expr("substring(trim(text), over + 1)")).otherwise(F.col("text")), "char_start": F.col("char_start") + F.col("over")}).drop("over")


def prepare_case(chunks: DataFrame) -> DataFrame:
    """CHR1."""
    return trim_overlaps(drop_exact_repeats(chunks))


def segment_units(chunks: DataFrame) -> DataFrame:
    """GEN4: a chunk with two or more visit headers becomes one unit for each, with its own id and span."""
    starts = F.filter(F.transform(match_spans(F.regexp_replace("text", P.VISIT_HEADER, "\u0001"), "\u0001"), lambda s: s["start"]), lambda x: x >= 0)
    # every sign in front shifts later offsets by one; a text without a header's words isn't searched
    real = F.when(T.holds(F.lower("text"), P.VISIT_HEADER_WORDS), F.transform(starts, lambda x, i: x - i)).otherwise(F.array().cast("array<int>"))
    rows = chunks.withColumn("starts", real)
    cut = F.when(F.size("starts") >= 2, F.array_distinct(F.concat(F.array(F.lit(0)), "starts"))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("cuts", cut).select("*", F.posexplode_outer("cuts").alias("unit", "from"))  # "outer": a plain one has its array computed again in a filter below
    end = F.coalesce(F.get("cuts", F.col("unit") + 1), F.length("text"))
    many = F.size("cuts") > 1
    out = rows.withColumn("to", end).withColumn("piece", F.substring(F.col("text"), F.col("from") + 1, F.col("to") - F.col("from"))).where(F.length(F.trim("piece")) > 0)
    return out.withColumns({
        "chunk_id": F.when(many, F.concat_ws(":", "chunk_id", F.lit("unit"), F.col("unit").cast("string"))).otherwise(F.col("chunk_id")),
        "source_char_end": F.when(many, F.col("source_char_start") + F.col("to")).otherwise(F.col("source_char_end")), "source_char_start": F.col("source_char_start") + F.col("from"), "text": F.col("piece"),
    }).drop("starts", "cuts", "unit", "from", "to", "piece")


def greedy_batches(chunks: DataFrame, most_chars: int = P.BATCH_CHARS, most_chunks: int | None = None) -> DataFrame:
    """WIN4: (run_id, chunk_id, batch_no): consecutive chunks of a case, an oversized one alone."""
    return batching.greedy_batches(chunks, _ORDER, most_chars, most_chunks)


def _apart(value: Column) -> Column:
    """The same value; a step that names it is kept out of its stage's single method, which the JVM never compiles once it is too long."""
    return F.get(F.transform(F.array(value), lambda x: x), F.lit(0))


def dated_mentions(chunks: DataFrame) -> DataFrame:
    """GEN5/FLT6/WIN9: one row for each documented date with its clause, typed; mentions that are no events go.

    ``chunks``: run_id, chunk_id, author, text. Sentences end at `. ` or `; `.
    """
    # every kind of date holds one of these centuries, unless entities hide its digits
    rows = chunks.where(T.holds(F.col("text"), ("19", "20", "&"))).select("run_id", "chunk_id", "author", F.col("text").alias("html"))
    # the window below needs a chunk's mentions together: dealing the chunks out before they are exploded ships each text once
    rows = _once(rows.repartition("run_id", "chunk_id"), "text", T.strip_html(F.col("html"))).drop("html")
    # the pattern runs once over a text: a line feed goes before each mention and a tab behind it; a stripped text has neither
    rows = rows.withColumns({"marked": F.regexp_replace("text", P.DOCUMENTED_DATE, "\n$0\t"), "plain": _apart(F.replace(F.col("text"), F.lit("; "), F.lit(". ")))})
    rows = rows.select("*", F.posexplode_outer(F.slice(F.split("marked", "\n", -1), 2, 1 << 30)).alias("i", "part")).where(F.col("part").isNotNull())
    rows = rows.withColumn("mention", F.substring_index("part", "\t", 1)).withColumn("value", _apart(T.documented_value(F.col("mention"))))
    text, s, e, i = F.col("text"), F.col("s"), F.col("e"), F.col("i")
    start = lambda k: F.length(F.call_function("substring_index", F.col("marked"), F.lit("\n"), k + 1)) - k * 2
    rows = rows.withColumns({"s": start(i), "before": F.when(i > 0, start(i - 1)), "after": F.when((i + 1) * 2 < F.length("marked") - F.length(text), start(i + 1))}).withColumn("e", s + F.length("mention"))
    # the last stop that ends before the mention, and the first one behind it
    back, ahead = F.instr(F.reverse(F.substring(F.col("plain"), F.lit(1), s)), " ."), F.call_function("locate", F.lit(". "), F.col("plain"), e + 1)
    rows = rows.withColumns({"back": back, "ahead": ahead}).withColumns({"left": F.when(F.col("back") > 0, s - F.col("back") - 1).otherwise(-1), "right": F.when(F.col("ahead") > 0, F.col("ahead") - 1)})
    following = F.when(F.col("after") < F.coalesce("right", F.length(text)), F.col("after"))
    end = F.least(F.coalesce(F.col("right") + 1, F.length(text)), e + 220)
    many = F.coalesce(F.col("before") > F.col("left"), F.lit(False)) | following.isNotNull()
    rows = rows.withColumns({"from": F.when(many, s).otherwise(F.greatest(F.col("left") + 2, s - 140)), "to": F.when(many, F.coalesce(following, end)).otherwise(end)})
    quote = F.trim(F.substring(text, F.col("from") + 1, F.col("to") - F.col("from")))
    clip = F.greatest(F.lit(0), s - F.col("from") - 90)
    rows = rows.withColumn("quote", quote).withColumn("quote", F.when(F.length("quote") > 260, F.regexp_replace(F.substring(F.col("quote"), clip + 1, F.lit(260)), "^[ ,;:-]+|[ ,;:-]+$", "")).otherwise(F.col("quote")))
    prefix, context = F.substring(text, F.greatest(F.lit(0), s - 35) + 1, s - F.greatest(F.lit(0), s - 35)), F.substring(text, F.greatest(F.lit(0), s - 100) + 1, e + 150 - F.greatest(F.lit(0), s - 100))
    q = F.col("quote")
    event = F.col("value").isNotNull() & (q != "") & ~prefix.rlike(T.loose(P.BIRTH_PREFIX)) & context.rlike(T.loose(P.EVENT_SIGNAL)) & ~q.rlike(T.loose(P.NON_EVENT)) & (F.regexp_count(q, F.lit(P.DOCUMENTED_DATE)) < 3)
    bare_year = context.rlike(T.loose(P.YEAR_SIGNAL)) & (F.regexp_count(q, F.lit("[A-Za-z]{3,}")) >= 3) & ~q.rlike(T.loose(P.YEAR_EXCLUDED))
    # of equal clauses the first decides, so none may go before the window; but what reads the text is settled there, and the text isn't sorted
    rows = rows.select("run_id", "chunk_id", _apart(F.col("author")).alias("author"), "s", "mention", "value", "quote", F.lower("quote").alias("low"), (event & ((T.value_precision(F.col("value")) != "year") | bare_year)).alias("event"))
    first = F.row_number().over(W.partitionBy("run_id", "chunk_id", "value", "low").orderBy("s"))
    rows = rows.withColumn("r", first).where((F.col("r") == 1) & F.col("event"))
    kind = F.lit(P.OTHER_EVENT)
    for name, words in reversed(P.EVENT_TYPES):
        kind = F.when(F.col("low").rlike(words), F.lit(name)).otherwise(kind)
    who = F.trim(F.coalesce("author", F.lit(P.MISSING)))
    provider = F.when(who.rlike(r"(?i)^(?:electronically approved by|unknown)|\bvisit$"), P.MISSING).otherwise(who)
    role = F.when(F.col("low").rlike("(?U)" + P.HISTORICAL), "historical_event_date").otherwise("event_date")
    return rows.select("run_id", "chunk_id", F.col("s").alias("ord"), F.col("value").alias("event_date"), T.value_precision(F.col("value")).alias("date_precision"), F.col("mention").alias("date_original"), role.alias("date_role"), kind.alias("event_type"), provider.alias("provider"), q.alias("source_quote"))


def merge_events(events: DataFrame) -> DataFrame:
    """AGG9: events of one fingerprint become one; the first stands, with all sources."""
    norm = lambda c: T.evidence_text(F.coalesce(F.col(c), F.lit("")))
    key = [F.col("run_id"), F.col("event_date"), F.col("date_precision"), norm("provider").alias("f_provider"), norm("event_type").alias("f_type"), norm("source_quote").alias("f_quote")]
    order = F.struct("chunk_id", "ord")
    first = lambda c: F.min_by(c, order).alias(c)
    out = events.groupBy(*key).agg(*[first(c) for c in ("chunk_id", "ord", "date_original", "date_role", "event_type", "provider", "source_quote")], F.array_sort(F.collect_set("chunk_id")).alias("sources"))
    return out.drop("f_provider", "f_type", "f_quote")


_WORD = re.compile("[a-z0-9]{3,}")


def _merge_near(batches, least: float):
    """Events sorted by group and order; holds what one group keeps. Two token sets that are similar enough share one of
    the first tokens of each in sorted order, so an event is compared with the kept ones under these alone."""
    place, kept, under = None, [], {}
    done = lambda: [row | {"sources": list(sources)} for _, row, sources in kept]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            here = (row["run_id"], row["event_date"], row.pop("kind"))
            if here != place:
                out += done()
                place, kept, under = here, [], {}
            tokens = sorted(set(_WORD.findall(row["source_quote"].lower())))
            held, lead = set(tokens), tokens[: len(tokens) - math.ceil(least * len(tokens) - 1e-9) + 1]
            near = sorted({k for t in lead for k in under.get(t, ())})
            same = next((k for k in near if len(held & kept[k][0]) / len(held | kept[k][0]) >= least), None)
            if same is None:
                for t in lead:
                    under.setdefault(t, []).append(len(kept))
                kept.append((held, row, dict.fromkeys(row["sources"])))
            else:
                kept[same][2].update(dict.fromkeys(row["sources"]))
        if out:
            yield out
    if kept:
        yield done()


def near_duplicate_events(events: DataFrame, least: float = P.NEAR_EVENT) -> DataFrame:
    """CHR3: of events of a case with one date and type, each that resembles an earlier kept one is merged into it."""
    names = ["run_id", "event_date", "date_precision", "chunk_id", "ord", "date_original", "date_role", "event_type", "provider", "source_quote", "sources"]
    schema = events.select(*names).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for rows in _merge_near(batches, least):
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kind = F.when(F.col("date_role") == "historical_event_date", "historical").otherwise(F.col("event_type"))
    rows = events.select(*names, kind.alias("kind")).repartition("run_id", "event_date", "kind")
    return rows.sortWithinPartitions("run_id", "event_date", "kind", "chunk_id", "ord", "source_quote").mapInArrow(run, schema)


def rule_chronology(chunks: DataFrame) -> DataFrame:
    """CHR2: the model-free chronology of every case."""
    return near_duplicate_events(merge_events(dated_mentions(segment_units(chunks))))


def sort_key() -> Column:
    return T.date_sort_key(F.col("event_date"), F.col("date_precision"), F.col("provider"), F.col("event_type"))


def render(events: DataFrame) -> DataFrame:
    """CHR11: one Markdown table a case, five columns, in date order."""
    bar = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    shown = T.display_date(F.col("event_date"), F.col("date_precision"), F.col("date_original"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", shown, bar(F.col("event_type")), bar(F.col("provider")), bar(F.col("source_quote")), F.size("sources").cast("string")), F.lit(" |"))
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(sort_key().alias("k"), "chunk_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return events.groupBy("run_id").agg(F.concat(F.lit("| Date | Event | Provider | Record | Sources |\n|---|---|---|---|---|\n"), held).alias("chronology"))


#: Short keys that a response may use for an event's fields, and the fields that describe what happened.
SHORT_KEYS = {
    "event_date": "d", "date_precision": "p", "date_original": "od", "date_role": "dr", "date_quote": "dq", "provider_role": "prr", "event_type": "t", "provider": "pr", "facility": "f", "presenting_symptoms": "s",
    "diagnosis": "dx", "investigations_findings": "ix", "intervention_plan": "ip", "administrative_context": "a", "source_ids": "src", "source_quote": "q",
}
DESCRIPTIVE = ("presenting_symptoms", "diagnosis", "investigations_findings", "intervention_plan", "administrative_context")
_FIELDS = tuple(n for n in SHORT_KEYS if n != "source_ids")
RESPONSE_EVENT = Y.StructType([Y.StructField(n, Y.StringType()) for n in (*SHORT_KEYS, *SHORT_KEYS.values())])
RESPONSE = Y.StructType([Y.StructField("events", Y.StringType()), Y.StructField("complete", Y.BooleanType())])
_JSON = r"(?s)(\{.*\})"


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row, however often it is named later: no step moves an expression through a generator."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _with_parsed(responses: DataFrame) -> DataFrame:
    """Adds ``complete`` (null unless a boolean) and ``listed``: the events' JSON texts, null unless they are a list."""
    fenced = F.when(F.col("response").contains("```"), T.found(F.col("response"), r"(?is)```(?:json)?\s*(\{.*\})\s*```", 1))
    # dealt out by batch, as parsing is the work; the step that looks up a batch's sources finds its rows in place
    dealt = responses.repartition(int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch_id")
    rows = _once(dealt, "parsed", F.from_json(F.coalesce(fenced, T.found(F.col("response"), _JSON, 1)), RESPONSE))
    rows = _once(rows, "listed", F.when(F.startswith(F.col("parsed.events"), F.lit("[")), F.from_json("parsed.events", "array<string>")))
    return rows.withColumn("complete", F.col("parsed.complete")).drop("parsed")


def _clean_event(e: Column) -> list[Column]:
    """Trimmed fields ('' where nothing is documented), known precisions and roles, dates that fit their precision, whole source numbers."""
    raw = {n: F.coalesce(F.trim(F.coalesce(e[n], e[short])), F.lit("")) for n, short in SHORT_KEYS.items()}
    precision, role = F.lower(raw["date_precision"]), F.lower(raw["date_role"])
    day = F.when(precision == "day", raw["event_date"]).when(precision == "month", F.concat(raw["event_date"], F.lit("-01"))).when(precision == "year", F.concat(raw["event_date"], F.lit("-01-01")))
    fits = F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day, "yyyy-MM-dd").isNotNull(), F.lit(False))
    listed = F.from_json(F.concat(F.lit("["), F.regexp_replace(raw["source_ids"], r"^\[|\]$", ""), F.lit("]")), "array<string>")
    made = {
        "event_date": F.when(fits, raw["event_date"]).otherwise(""), "date_precision": F.when(fits, precision).otherwise("unknown"),
        "date_role": F.when(role == "", "event_date").when(role.isin(*P.DATE_ROLES), role).otherwise("ambiguous"), "event_type": F.coalesce(F.nullif(raw["event_type"], F.lit("")), F.lit("clinical event")),
        "provider_role": F.coalesce(F.nullif(F.lower(raw["provider_role"]), F.lit("")), F.lit("unknown")),
    }
    ids = F.array_distinct(F.array_compact(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: x.try_cast("int"))))
    return [made.get(n, raw[n]).alias(n) for n in _FIELDS] + [ids.alias("source_ids"), F.exists(F.array(*raw.values()), lambda v: F.lower(v).isin(*P.PLACEHOLDERS)).alias("placeholder")]


def response_events(responses: DataFrame) -> DataFrame:
    """GEN9: recorded responses (batch_id, page, response), fenced or bare JSON, as event rows.

    Fields may come by their short keys; a source number may stand alone or in
    a list; a date that doesn't fit its precision becomes an unknown one.
    """
    rows = _with_parsed(responses).select("batch_id", "page", "complete", F.size("listed").alias("in_batch"), F.posexplode("listed").alias("event_no", "text"))
    rows = _once(rows, "event", F.from_json("text", RESPONSE_EVENT))
    return rows.select("batch_id", "page", "complete", "in_batch", "event_no", *_clean_event(F.col("event")))


#: A batch with more events than this is rejected as a whole; events and pages that a page and a batch may have.
MOST_EVENTS, MOST_ON_PAGE, MOST_ON_THOROUGH_PAGE, MOST_PAGES = 100, 12, 24, 50


def ground_events(events: DataFrame, sources: DataFrame) -> DataFrame:
    """CHR5-CHR8: events with the first reason to reject them (null if none), and fields that their source doesn't bear out blanked.

    ``sources``: batch_id, source_no, text, author. ``quote_at`` is the place of
    the quotation in its source (from 0, white space normalised). Each blanked
    field leaves a warning.
    """
    last = sources.groupBy("batch_id").agg(F.max("source_no").alias("n_sources"))
    rows = events.join(last, "batch_id", "left").withColumn("source_ids", F.filter("source_ids", lambda i: (i >= 1) & (i <= F.col("n_sources")))).drop("n_sources")
    rows = rows.withColumn("source_no", F.when(F.size("source_ids") == 1, F.get("source_ids", F.lit(0))))
    flat = lambda c: F.trim(T.one_blank(F.lower(c)))
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    # the three forms in which a source is searched are made once a source, and a date is read once an event. The work is in
    # the patterns, not in the bytes, so the session's partitions are kept instead of being joined by size
    parts, at = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["batch_id", "source_no"]
    s = sources.select(*at, F.col("text").alias("s_text"), F.col("author").alias("s_author")).repartition(parts, *at)
    s = s.withColumns({"s_author": _apart(F.col("s_author")), "s_flat": flat("s_text"), "s_words": T.evidence_text(F.col("s_text")), "s_tokens": tokens("s_text")})
    rows = _once(rows.repartition(parts, *at), "read", T.documented_value(F.col("date_original")))
    rows = rows.join(s, at, "left")
    quote, text, date = F.coalesce("source_quote", F.lit("")), F.col("s_text"), F.col("read")
    undated = (F.col("date_precision") == "unknown") | (F.coalesce("event_date", F.lit("")) == "")
    exact = undated | date.eqNullSafe(F.col("event_date")) & (T.value_precision(date) == F.col("date_precision"))
    reason = (
        F.when(F.col("in_batch") > MOST_EVENTS, "too many events in the batch").when(F.col("placeholder"), "placeholder text").when(text.isNull(), "no single valid source").when(quote.rlike(r"\.\.\.|…"), "ellipsis in the quotation").when((quote == "") | ~F.contains(F.col("s_flat"), flat(quote)), "quotation not in the source")
        .when(F.col("date_role").isin(*P.EXCLUDED_ROLES) | F.col("date_original").rlike("^(?:" + P.DURATION + ")$"), "date role is no event date").when(~undated & ~F.contains(F.col("s_flat"), flat(F.col("date_original"))), "date not in the source").when(~exact, "date reads differently in the source")
    )
    given = lambda c: ~F.coalesce(F.col(c), F.lit("")).isin("", *P.NOT_GIVEN)
    held = lambda c: F.coalesce(F.contains(F.col("s_words"), T.evidence_text(F.col(c))), F.lit(False))
    telling = lambda c: F.array_except(tokens(F.col(c)), F.array(*[F.lit(w) for w in P.GROUNDING_STOP_WORDS]))
    borne = lambda c: F.coalesce(F.size(F.array_intersect(telling(c), "s_tokens")) * 2 >= F.size(telling(c)), F.lit(False))
    guarded = lambda c: F.coalesce(F.contains(F.lower(quote), F.lower(T.found(F.col(c), "(?i)" + P.INFERENCE))), F.lit(True))
    by_author = F.coalesce(T.evidence_text(F.col("provider")) == T.evidence_text(F.col("s_author")), F.lit(False))
    in_source = {"provider": held("provider") | by_author, "facility": held("facility")} | {c: borne(c) for c in DESCRIPTIVE}
    inferred = [F.when(given(c) & ~guarded(c), F.lit(f"{c} only infers")) for c in in_source]
    lost = [F.when(given(c) & guarded(c) & ~ok, F.lit(f"{c} not in the source")) for c, ok in in_source.items()]
    role = F.when(given("provider") & guarded("provider"), F.when(~in_source["provider"], "unknown").when(~held("provider"), "documenting_provider").otherwise(F.col("provider_role"))).otherwise(F.col("provider_role"))
    kept = {c: F.when(given(c) & guarded(c) & ok, F.col(c)).otherwise(F.lit("")) for c, ok in in_source.items()}
    return rows.withColumns({"reject_reason": reason, "warnings": F.array_compact(F.array(*inferred, *lost)), "provider_role": role, "quote_at": F.instr(F.col("s_flat"), flat(quote)) - 1, "source_no": _apart(F.col("source_no"))} | kept).drop("s_text", "s_author", "s_flat", "s_words", "s_tokens", "read", "placeholder")


def validate_pages(responses: DataFrame, sources: DataFrame, most: int = MOST_ON_PAGE) -> DataFrame:
    """CHR9: recorded pages (batch_id, page, response) with valid, complete and accepted.

    A page is valid if it isn't cut off, its events are a list of at most
    ``most`` without a rejected one, and it says whether it is complete. Its
    cursors are the places of its quotations: (source, position), in the order
    of the events. See ``page_chain`` for what is accepted.
    """
    made = _with_parsed(responses).select(
        "batch_id", "page", F.coalesce("complete", F.lit(False)).alias("complete"),
        F.coalesce(~F.contains(F.col("response"), F.lit("Incomplete response")) & F.col("listed").isNotNull() & F.col("complete").isNotNull() & (F.size("listed") <= most), F.lit(False)).alias("well_formed"),
    )
    cursor = F.struct("source_no", "quote_at")
    grounded = ground_events(response_events(responses), sources).where(F.col("in_batch") <= most)
    by_page = grounded.groupBy("batch_id", "page").agg(F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"), F.transform(F.array_sort(F.collect_list(F.struct("event_no", cursor.alias("at")))), lambda x: x["at"]).alias("cursors"))
    rows = made.join(by_page, ["batch_id", "page"], "left")
    none = F.array().cast("array<struct<source_no:int,quote_at:int>>")
    pages = rows.withColumns({"valid": F.col("well_formed") & (F.coalesce("rejected", F.lit(0)) == 0) & (F.col("page") <= MOST_PAGES), "cursors": F.coalesce("cursors", none)})
    return page_chain(pages).select("batch_id", "page", "valid", "complete", "accepted")


def page_chain(pages: DataFrame) -> DataFrame:
    """WIN5/CHR9: pages (batch_id, page, cursors, valid, complete) that are accepted: the valid prefix up to the first complete or empty one.

    Pages count from 1 without a gap. A page is valid only if its cursors rise
    and its first one lies after the last of the page before.
    """
    w = W.partitionBy("batch_id").orderBy("page")
    rises = F.array_sort("cursors").eqNullSafe(F.col("cursors"))
    after = F.coalesce(F.get("cursors", F.lit(0)) > F.lag(F.try_element_at("cursors", F.lit(-1))).over(w), F.lit(True))
    rows = pages.withColumn("good", F.coalesce(F.col("valid") & rises & after & (F.row_number().over(w) == F.col("page")), F.lit(False)))
    ends = F.col("complete") | (F.size("cursors") == 0)
    so_far, done = F.min("good").over(w.rowsBetween(W.unboundedPreceding, 0)), F.coalesce(F.max(ends).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    return rows.withColumn("accepted", so_far & ~done)


def resume(batches: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """CHR10: batches whose content digest has no valid recorded response yet."""
    return batches.join(checkpoints.where("valid").select("digest").distinct(), "digest", "left_anti")


def split_failed(batches: DataFrame, failed: DataFrame, depth: int = 8) -> DataFrame:
    """CHR12: one round: failed batches (batch_id, depth) fall into two halves in order, until ``depth``.

    ``batches``: batch_id, depth, ord, chunk_id.
    """
    rows = batches.join(failed.select("batch_id").distinct(), "batch_id", "left_semi").where(F.col("depth") < depth)
    half = F.ntile(2).over(W.partitionBy("batch_id").orderBy("ord")) - 1
    return rows.select(F.concat_ws(".", "batch_id", half.cast("string")).alias("batch_id"), (F.col("depth") + 1).alias("depth"), "ord", "chunk_id")


def keep_listed(events: DataFrame, lists: DataFrame, group: int = 30) -> DataFrame:
    """CHR4: events in groups of ``group`` by order; of a group stay the 1-based numbers in its recorded list; a bad list keeps none.

    ``events``: run_id, ord; ``lists``: run_id, group_no, response (a JSON array of integers).
    """
    no = F.row_number().over(W.partitionBy("run_id").orderBy("ord")) - 1
    rows = events.withColumn("no", no).withColumn("group_no", F.floor(F.col("no") / group).cast("int")).withColumn("listed", F.col("no") % group + 1)
    kept = lists.select("run_id", "group_no", F.explode(F.from_json("response", "array<int>")).alias("listed")).distinct()
    return rows.join(kept, ["run_id", "group_no", "listed"], "left_semi").drop("no", "group_no", "listed")


def audit(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """AGG10/SET5: one row a case: documents, chunks, events, rejected, warnings, incomplete."""
    a = chunks.groupBy("run_id").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"))
    b = events.groupBy("run_id").agg(F.count_if(F.col("reject_reason").isNull()).alias("events"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"), F.sum(F.size("warnings")).alias("warnings"), F.max(~F.col("complete")).alias("incomplete"))
    return a.join(b, "run_id", "left").fillna(0, ["events", "rejected", "warnings"]).fillna(False, ["incomplete"])
