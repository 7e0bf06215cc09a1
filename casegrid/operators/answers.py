"""Citations, dates and evidence of generated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from casegrid.functions import patterns as P, textcols as T


def source_numbers(text: Column) -> Column:
    """GEN8: every cited number in order, repeats included."""
    tags = F.regexp_extract_all(text, F.lit(P.SOURCE_TAG), F.lit(1))
    return F.transform(F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)))), lambda n: n.cast("int"))


def invalid_sources(text: Column, count: Column) -> Column:
    """ANS4: sorted distinct cited numbers that no source has."""
    return F.array_sort(F.array_distinct(F.filter(source_numbers(text), lambda n: (n < 1) | (n > count))))


def sanitise(text: Column, count: Column) -> Column:
    """ANS5: tags keep their valid numbers; the others are named as unavailable."""
    tags = F.regexp_extract_all(text, F.lit(P.SOURCE_TAG), F.lit(1))
    gaps = F.split(text, P.SOURCE_TAG, -1)

    def tag(t):
        numbers = F.transform(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))
        good, bad = F.filter(numbers, lambda n: (n >= 1) & (n <= count)), F.filter(numbers, lambda n: (n < 1) | (n > count))
        joined = lambda a: F.array_join(a.cast("array<string>"), ", ")
        kept = F.when(F.size(good) == 1, F.concat(F.lit("[Source "), joined(good), F.lit("]"))).when(F.size(good) > 1, F.concat(F.lit("[Sources "), joined(good), F.lit("]")))
        return F.concat_ws(" ", kept, F.when(F.size(bad) > 0, F.concat(F.lit("[citation reference unavailable: "), joined(bad), F.lit("]"))))

    shown = F.transform(tags, tag)
    rewritten = F.array_join(F.zip_with(gaps, shown, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")
    return F.when(F.size(invalid_sources(text, count)) > 0, rewritten).otherwise(text)


def resolve_citations(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """ANS6: (query_id, answer) with each tag replaced by its sources' labels; unknown numbers show as `Source n`.

    ``labels``: query_id, source_no, label. Numbers are joined as rows, so no answer's sources are held in one place.
    """
    tags = F.regexp_extract_all("answer", F.lit(P.SOURCE_TAG), F.lit(1))
    parts = answers.select("query_id", "answer", F.posexplode_outer(tags).alias("tag_no", "tag"))
    numbers = parts.select("query_id", "tag_no", F.posexplode_outer(F.regexp_extract_all("tag", F.lit(r"\d+"), F.lit(0))).alias("n_no", "n")).withColumn("source_no", F.col("n").cast("int"))
    named = numbers.join(labels, ["query_id", "source_no"], "left").withColumn("shown", F.coalesce("label", F.concat(F.lit("Source "), F.col("n"))))
    by_tag = named.where("tag_no is not null").groupBy("query_id", "tag_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_no", "shown"))), lambda x: x["shown"]), "; ").alias("shown"))
    by_query = by_tag.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tag_no", "shown"))), lambda x: F.concat(F.lit("("), x["shown"], F.lit(")"))).alias("shown"))
    gaps = F.split("answer", P.SOURCE_TAG, -1)
    return answers.join(by_query, "query_id", "left").select("query_id", F.array_join(F.zip_with(gaps, F.coalesce("shown", F.array().cast("array<string>")), lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "").alias("answer"))


def evidence_ledger(hits: DataFrame) -> DataFrame:
    """ANS1: hits with evidence_status, substantive and date_conflict (indirect evidence that cites a later date)."""
    head = F.lower(F.concat_ws(" ", F.coalesce("document_type", F.lit("")), F.substring("text", 1, 300)))
    indirect = head.rlike(P.INDIRECT)
    later = F.exists(T.canonical_dates(F.col("text")), lambda d: d > F.date_format("date_extracted", "yyyy-MM-dd"))
    return hits.withColumns({
        "evidence_status": F.when(indirect, "indirect index/reference").otherwise("retrieved record excerpt"), "substantive": F.lower("text").rlike(P.SUBSTANTIVE),
        "date_conflict": F.coalesce(indirect & F.col("date_extracted").isNotNull() & later, F.lit(False)),
    })


def classify_questions(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """ANS2: task, broad, multipart, evidence counts, output tokens and compact for (query_id, question)."""
    counts = evidence.groupBy("query_id").agg(F.count("*").alias("evidence"), F.count_if(F.col("text").rlike(P.CANONICAL_DATE)).alias("dated"))
    low = F.concat(F.lit(" "), F.lower("question"), F.lit(" "))
    task = F.when(low.rlike("chronolog|timeline"), "chronology").when(low.rlike(P.COMPARISON), "comparison").when(low.rlike("summar|history"), "summary").otherwise("factual_qa")
    rows = questions.join(counts, "query_id", "left").fillna(0, ["evidence", "dated"])
    rows = rows.withColumns({"task": task, "broad": low.rlike(P.BROAD), "multipart": F.regexp_count(F.col("question"), F.lit(P.MULTIPART)) >= 2})
    rows = rows.withColumn("complexity", F.col("evidence") + 2 * F.col("dated") + F.when(F.col("multipart"), 8).otherwise(0))
    tokens = F.when(F.col("broad") | (F.col("complexity") >= 40), P.OUTPUT_TOKENS[2]).when(F.col("multipart") | (F.col("complexity") >= 20), P.OUTPUT_TOKENS[1]).otherwise(P.OUTPUT_TOKENS[0])
    return rows.withColumns({"output_tokens": tokens, "compact": F.col("broad") | (F.col("complexity") >= 32)})


def generation_tokens(requested: Column, remaining: Column, user_most: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.coalesce(user_most, requested), remaining))


def inspect_answers(answers: DataFrame, ledger: DataFrame, limit_warning: str) -> DataFrame:
    """ANS3: findings for (query_id, answer, source_count) against its evidence ledger."""
    dates = F.array_distinct(F.flatten(F.collect_list(F.concat(T.canonical_dates(F.col("text")), F.array_compact(F.array(F.date_format("date_extracted", "yyyy-MM-dd")))))))
    known = ledger.groupBy("query_id").agg(F.count("*").alias("entries"), F.count_if(F.col("evidence_status") == "indirect index/reference").alias("indirect"), dates.alias("dates"))
    rows = answers.join(known, "query_id", "left")
    truncated, a = F.col("answer").contains(limit_warning), F.col("answer")
    return rows.select(
        "query_id", truncated.alias("truncated"), invalid_sources(a, F.col("source_count")).alias("invalid"), (truncated & a.rlike(r"(?i)\b(?:comprehensive|complete)\b")).alias("false_completeness"),
        F.coalesce(a.rlike(P.CORPUS_CLAIM) & (F.col("entries") > 0) & (F.col("indirect") * 2 <= F.col("entries")), F.lit(False)).alias("unsupported_corpus"), a.rlike(P.DATE_ERROR_CLAIM).alias("date_error_claim"),
        F.when(F.col("entries") > 0, F.array_except(T.canonical_dates(a), F.col("dates"))).otherwise(F.array().cast("array<string>")).alias("ungrounded_dates"),
    )


def assurance_flags(answers: DataFrame) -> DataFrame:
    """ANS7: what a reader has to be told about (query_id, answer, source_count)."""
    numbers = source_numbers(F.col("answer"))
    return answers.select(
        "query_id", (~F.lower("answer").contains("verification note")).alias("verification_missing"),
        (F.size(F.filter(numbers, lambda n: (n >= 1) & (n <= F.col("source_count")))) == 0).alias("no_citation"), (F.size(invalid_sources(F.col("answer"), F.col("source_count"))) > 0).alias("invalid_citation"),
    )


def last_messages(messages: DataFrame, most: int = 6) -> DataFrame:
    """WIN6: the last messages of every session."""
    rank = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn"), F.desc("role")))
    return messages.withColumn("from_end", rank).where(F.col("from_end") <= most)


def tail_run(messages: DataFrame, mode: str) -> DataFrame:
    """WIN7: the messages at a session's end that all have ``mode``."""
    other = F.max(F.when(F.col("mode").eqNullSafe(mode), 0).otherwise(1)).over(W.partitionBy("session_id").orderBy(F.desc("turn"), F.desc("role")))
    return messages.withColumn("other", other).where("other = 0").drop("other")


def transcript(messages: DataFrame) -> DataFrame:
    """SNK3: one Markdown text a session."""
    line = F.concat(F.lit("**"), F.initcap("role"), F.lit(":** "), F.col("content"))
    held = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return messages.groupBy("session_id").agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n\n").alias("text"))


def plain_text(content: Column) -> Column:
    """SNK3: without heading marks, emphasis marks and link targets."""
    bare = F.regexp_replace(content, r"(?md)^#{1,6}\s+", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\*{1,3}([^*]+)\*{1,3}", "$1"), r"\[([^\]]+)\]\([^)]+\)", "$1")


def text_transcript(messages: DataFrame) -> DataFrame:
    """SNK3: one plain text a session (session_id, text): a title, then each message under its role's heading; answers lose their marks."""
    thin, thick = F.lit("-" * 40), F.lit("=" * 60)
    role = F.col("role")
    heading = F.when(role == "user", "USER QUERY:").when(role == "reasoning", "ADMINISTRATIVE LLM REASONING AUDIT:").otherwise("ANALYSIS RESPONSE:")
    body = F.when(role.isin("user", "reasoning"), F.col("content")).otherwise(F.concat(plain_text(F.col("content")), F.lit("\n\n"), thick))
    block = F.concat_ws("\n", heading, thin, body, F.lit(""))
    held = messages.groupBy("session_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role", block.alias("block")))).alias("held"))
    title = F.concat_ws("\n", F.lit("RAG ANALYSIS EXPORT"), thick, F.concat(F.lit("Messages:  "), F.col("n").cast("string")), thick, F.lit(""))
    return held.select("session_id", F.concat_ws("\n", title, F.array_join(F.transform("held", lambda x: x["block"]), "\n")).alias("text"))


def table_rows(messages: DataFrame) -> DataFrame:
    """GEN7: (session_id, turn, row_no, cells) of Markdown table rows; separator rows go, escaped bars stay in a cell."""
    lines = messages.select("session_id", "turn", F.posexplode(F.split("content", "\n")).alias("row_no", "line")).where(F.trim("line").rlike(r"^\|.*\|$"))
    lines = lines.where(~F.trim("line").rlike(r"^\|(?:\s*:?-+:?\s*\|)+$"))
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    return lines.select("session_id", "turn", "row_no", cells.alias("cells"))
