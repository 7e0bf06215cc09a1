"""Column expressions over text: dates, names, types, labels, ids."""

from __future__ import annotations

import functools
import json
import zlib
from html import unescape as html_unescape
from html.entities import html5

from pyspark.sql import Column, functions as F

from casegrid.functions import patterns as P

#: Unicode classes and case folding as the patterns expect; only a line feed ends a line.
EXACT, LINES, LOOSE_LINES = "(?U)", "(?U)(?md)", "(?U)(?imd)"
#: Fixed value: white space beyond ASCII.
WIDE_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def loose(pattern: str, first: str = "") -> str:
    """Without regard to case, any white space for `\\s`; far faster than switching the whole pattern to Unicode classes.
    ``first``: the letters that every match begins with; most places of a text fail there at once."""
    wide = pattern.replace(r"\s", WIDE_SPACE)
    return f"(?i)(?=[{first}])(?:{wide})" if first else f"(?i){wide}"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match's group, or null. The match is named once: within a branch, nullif would look for it twice. (A filter
    also keeps the step out of whole-stage code, where several patterns make one method that is too long for the JVM to compile.)"""
    return F.get(F.filter(F.array(F.regexp_extract(text, pattern, group)), lambda m: m != ""), F.lit(0))


def holds(text: Column, words) -> Column:
    """Whether a text holds one of the words: a plain byte search, far cheaper than a pattern that can't match without them."""
    return functools.reduce(Column.__or__, [text.contains(w) for w in words])


def one_blank(text: Column) -> Column:
    """Runs of white space as one blank; a single blank is no match, so most of a text is left in place."""
    return F.regexp_replace(text, r"(?U)[\s&&[^ ]]\s*| \s+", " ")


def padded(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def month_number(name: Column) -> Column:
    """1 to 12 from an English month, long or three letters; else null."""
    at = F.call_function("locate", F.lower(F.substring(name, 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    return F.when((F.length(name) >= 3) & (at > 0) & ((at - 1) % 3 == 0), ((at - 1) / 3 + 1).cast("int"))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """`yyyy-MM-dd`, or null for an impossible day."""
    text = F.concat(padded(year, 4), F.lit("-"), padded(month, 2), F.lit("-"), padded(day, 2))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def full_year(year: Column) -> Column:
    y = year.cast("int")
    return F.when(y < P.PIVOT_YEAR, y + 2000).when(y < 100, y + 1900).otherwise(y)


_FIRST_DATE = loose("(?=[0-9JFMASOND])(?:" + "|".join((P.DATE_NUMERIC, P.DATE_DAY_FIRST, P.DATE_MONTH_FIRST)) + ")")


def first_date_raw(text: Column) -> Column:
    """FN1: the leftmost date as written."""
    return F.when(text.rlike("[0-9]"), found(text, _FIRST_DATE))


def first_date_iso(text: Column) -> Column:
    """FN2: the leftmost date, day first, two-digit years by pivot; null if impossible."""
    return iso_of_parts(date_parts(first_date_raw(text)))


def date_parts(raw: Column) -> Column:
    """The numbers and the month of a date as written."""
    return F.regexp_extract_all(raw, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0))


def iso_of_parts(parts: Column) -> Column:
    """FN2 from the parts of a date."""
    a, b, year = (F.get(parts, F.lit(k)) for k in range(3))
    # 3/12/2020, 3 December 2020 or December 3, 2020
    return F.when(a.rlike("[A-Za-z]"), iso_date(year, month_number(a), b)).when(b.rlike("[A-Za-z]"), iso_date(year, month_number(b), a)).otherwise(iso_date(full_year(year), b, a))


def author(text: Column) -> Column:
    """FN3: signature block, else sender line, else a titled name that is no addressee."""
    low = F.lower(text)
    signed = F.when(holds(low, P.AUTHOR_SIGNATURE_WORDS), found(text, loose(P.AUTHOR_SIGNATURE, P.AUTHOR_SIGNATURE_FIRST), 1))
    sender = F.when(holds(low, P.AUTHOR_SENDER_WORDS), found(text, loose(P.AUTHOR_SENDER, P.AUTHOR_SENDER_FIRST), 1))
    return F.trim(F.coalesce(signed, sender, F.when(holds(text, P.AUTHOR_TITLES), found(text, EXACT + P.AUTHOR_TITLE, 1))))


def radiology_author(text: Column) -> Column:
    """FN4: who signed electronically, else the last line that is a doctor's name."""
    lines = F.regexp_extract_all(text, F.lit(LINES + P.RADIOLOGIST_LINE), F.lit(1))
    return F.concat(F.lit("Dr "), F.coalesce(found(text, LOOSE_LINES + P.RADIOLOGIST_SIGNED, 1), F.try_element_at(lines, F.lit(-1))))


def radiology_date(text: Column) -> Column:
    """FN5: struct(iso, raw) of the first day-month-year."""
    g = lambda k: found(text, LOOSE_LINES + P.RADIOLOGY_DATE, k)
    iso = iso_date(g(3), month_number(g(2)), g(1))
    return F.struct(iso.alias("iso"), F.when(iso.isNotNull(), F.concat_ws(" ", g(1), g(2), g(3))).alias("raw"))


def document_type(text: Column) -> Column:
    """FN6: radiology by title and part, else the type with most matches, ties by order."""
    low = F.lower(text)
    worded = lambda name: holds(low, P.DOCUMENT_TYPE_WORDS[name]) & (holds(low, P.DOCUMENT_TYPE_ALSO[name]) if name in P.DOCUMENT_TYPE_ALSO else F.lit(True))
    counts = [F.struct(F.when(worded(name), F.regexp_count(text, F.lit(loose(p, P.DOCUMENT_TYPE_FIRST[name])))).otherwise(0).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, p) in enumerate(P.DOCUMENT_TYPES.items())]
    # without a match "unknown" comes first; the best one is named once, or all patterns would be counted again
    best = F.array_max(F.array(*counts, F.struct(F.lit(0).alias("n"), F.lit(1).alias("order"), F.lit("unknown").alias("name"))))
    radiology = holds(low, P.RADIOLOGY_PART_WORDS) & text.rlike(loose(P.RADIOLOGY_TITLE)) & text.rlike(loose(P.RADIOLOGY_PART))
    return F.when(radiology, F.lit("radiology_report")).otherwise(best["name"])


def section_type(text: Column) -> Column:
    """FN7: the first pattern that matches, else general."""
    out, low = F.lit("general"), F.lower(text)
    for name, p in reversed(P.SECTION_TYPES.items()):
        out = F.when(holds(low, P.SECTION_TYPE_WORDS[name]) & text.rlike(loose(p, P.SECTION_TYPE_FIRST[name])), F.lit(name)).otherwise(out)
    return out


def patient_name(text: Column) -> Column:
    """FN8."""
    low = F.lower(text)
    return F.trim(F.coalesce(*[F.when(holds(low, words), found(text, loose(p), 1)) for words, p in zip(P.PATIENT_WORDS, P.PATIENT, strict=True)]))


def run_id(run_dir: Column) -> Column:
    """FN9."""
    return F.substring(F.sha2(run_dir, 256), 1, 16)


def doc_id(run: Column, file: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", run, file), 256), 1, 24)


def chunk_id(doc: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", doc, index.cast("string")), 256), 1, 24)


def point_id(chunk: Column) -> Column:
    return F.regexp_replace(F.substring(F.sha2(chunk, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def token_estimate(text: Column) -> Column:
    """FN10."""
    return F.floor(F.length(text) / 4).cast("int")


def date_int(iso: Column) -> Column:
    """FN11: yyyymmdd of a valid ISO date, else null."""
    return F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyyMMdd").cast("int")


def iso_bound(value: Column) -> Column:
    """FN12: a date bound as ISO; year-month and year start a month or year, digits beyond a year are epoch seconds (UTC)."""
    v = F.trim(value)
    return (
        F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), iso_date(F.split_part(v, F.lit("-"), F.lit(1)), F.split_part(v, F.lit("-"), F.lit(2)), F.split_part(v, F.lit("-"), F.lit(3))))
        .when(v.rlike(r"^\d{4}-\d{1,2}$"), iso_date(F.split_part(v, F.lit("-"), F.lit(1)), F.split_part(v, F.lit("-"), F.lit(2)), F.lit("1")))
        .when(v.rlike(r"^\d{4}$"), F.when(v != "0000", F.concat(v, F.lit("-01-01"))))
        .when(v.rlike(r"^\d{5,12}$"), F.date_format(F.timestamp_seconds(v.cast("bigint")), "yyyy-MM-dd"))
    )


def timeline_date(value: Column) -> Column:
    """FN13: ISO, numeric day first or named date as ISO, else null."""
    v = F.trim(value)
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.date_format(F.try_to_date(v, "yyyy-MM-dd"), "yyyy-MM-dd"))
    whole = v.rlike(loose("^(?:" + "|".join((P.DATE_NUMERIC, P.DATE_DAY_FIRST, P.DATE_MONTH_FIRST)) + ")$"))
    return F.coalesce(iso, F.when(whole, first_date_iso(v)))


def source_date(extracted: Column, raw: Column, text: Column) -> Column:
    """FN14: struct(raw, iso); a raw date alone decides the normalised one."""
    raw = F.nullif(F.trim(raw), F.lit(""))
    written = F.coalesce(raw, F.date_format(extracted, "yyyy-MM-dd"), first_date_raw(text))
    iso = F.when(raw.isNotNull(), timeline_date(raw)).otherwise(F.coalesce(F.date_format(extracted, "yyyy-MM-dd"), first_date_iso(text)))
    return F.struct(written.alias("raw"), iso.alias("iso"))


def clinic(text: Column) -> Column:
    return F.trim(found(text, LOOSE_LINES + P.CLINIC, 1))


def reference_number(text: Column) -> Column:
    """FN15: without trailing commas, stops and semicolons."""
    return F.regexp_replace(found(text, loose(P.REFERENCE)), "[,.;]+$", "")


def summary(text: Column) -> Column:
    """FN15: the first paragraph, without source tags, at most 200 characters."""
    first = F.trim(F.regexp_replace(F.trim(F.translate(F.split_part(text, F.lit("\n\n"), F.lit(1)), "\n", " ")), r"\[Source \d+\]", ""))
    return F.when(F.length(first) > 200, F.concat(F.substring(first, 1, 197), F.lit("..."))).otherwise(first)


def documented_value(mention: Column) -> Column:
    """`yyyy-MM-dd`, `yyyy-MM` or `yyyy` of a typed date mention, null for an impossible day or another text. No part of
    it is named twice: an expression inlined over and over becomes a method too long for the JVM to compile."""
    kind = lambda *names: mention.rlike("(?i)^(?:" + "|".join(P.DOCUMENTED[n] for n in names) + ")$")
    part = lambda pattern: F.regexp_extract(mention, pattern, 1)
    day, year = part(r"(?i)(?<![0-9])([0-3]?\d)(?:st|nd|rd|th)?(?![0-9])"), part(r"((?:19|20)\d{2})")
    at = F.call_function("locate", F.lower(F.substring(part(rf"(?i)({P.SHORT_MONTHS})"), 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec"))
    month = F.lpad(F.floor((at + 2) / 3).cast("string"), 2, "0")
    checked = lambda text: text.try_cast("date").cast("string")
    return (
        F.when(kind("iso", "numeric"), checked(F.regexp_replace(mention, r"^(\d\d?)[./-](\d\d?)[./-](\d{4})$", "$3-$2-$1")))
        .when(kind("year"), mention).when(kind("month"), F.concat(year, F.lit("-"), month)).when(kind("dmy", "mdy"), checked(F.concat(year, F.lit("-"), month, F.lit("-"), day)))
    )


def value_precision(value: Column) -> Column:
    """The precision of a documented value, by its length."""
    return F.when(F.length(value) >= 10, "day").when(F.length(value) == 7, "month").when(F.length(value) < 7, "year").otherwise("unknown")


def documented_date(mention: Column) -> Column:
    """FN16: struct(value, precision) of a typed date mention."""
    value = documented_value(mention)
    return F.struct(value.alias("value"), value_precision(value).alias("precision"))


def event_date_norm(value: Column, precision: Column) -> Column:
    """FN17: struct(value, precision, warning)."""
    v = F.trim(F.coalesce(value, F.lit("")))
    none = lambda w: F.struct(F.lit("").alias("value"), F.lit("unknown").alias("precision"), w.alias("warning"))
    shape = F.when(precision == "day", v.rlike(r"^\d{4}-\d{2}-\d{2}$")).when(precision == "month", v.rlike(r"^\d{4}-\d{2}$")).otherwise(v.rlike(r"^\d{4}$"))
    real = F.try_to_date(F.concat(v, F.when(precision == "month", "-01").when(precision == "year", "-01-01").otherwise("")), "yyyy-MM-dd").isNotNull()
    return (
        F.when((v == "") | (precision == "unknown"), none(F.lit("Event date is not available as a normalised value")))
        .when(~shape, none(F.concat(F.lit("Invalid "), precision, F.lit("-precision event date: "), v)))
        .when(~real, none(F.concat(F.lit("Invalid calendar date: "), v)))
        .otherwise(F.struct(v.alias("value"), precision.alias("precision"), F.lit(None).cast("string").alias("warning")))
    )


def display_date(value: Column, precision: Column, original: Column) -> Column:
    """FN18."""
    sign = F.lit("[Date Incomplete]")
    parts = lambda k: F.split_part(value, F.lit("-"), F.lit(k))
    return (
        F.when((precision == "day") & (value != ""), F.concat_ws("/", parts(3), parts(2), parts(1)))
        .when((precision == "month") & (value != ""), F.concat(parts(2), F.lit("/"), parts(1), F.lit(" "), sign))
        .when((precision == "year") & (value != ""), F.concat_ws(" ", value, sign))
        .otherwise(F.concat_ws(" ", F.nullif(F.trim(original), F.lit("")), sign))
    )


def date_sort_key(value: Column, precision: Column, provider: Column, event_type: Column) -> Column:
    """FN19: struct to sort events by; unknown dates last."""
    part = lambda k, d: F.coalesce(F.nullif(F.split_part(value, F.lit("-"), F.lit(k)), F.lit("")).cast("int"), F.lit(d))
    known = precision.isin("day", "month", "year")
    rank = F.when(precision == "day", 0).when(precision == "month", 1).when(precision == "year", 2).otherwise(3)
    return F.struct(
        F.when(known, part(1, 9999)).otherwise(9999).alias("y"), F.when(known, part(2, 1)).otherwise(12).alias("m"), F.when(known, part(3, 1)).otherwise(31).alias("d"),
        rank.alias("rank"), F.lower(provider).alias("provider"), F.lower(event_type).alias("type"),
    )


def is_duration(text: Column) -> Column:
    """FN20."""
    return text.rlike(P.DURATION)


def evidence_text(text: Column) -> Column:
    """FN21: lower case, runs of non-word characters as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\W+", " "))


def canonical_dates(text: Column) -> Column:
    """FN22: sorted distinct ISO dates; a numeric date with the year last is day first."""

    def iso(d):
        parts = F.split(d, "[-/.]")
        first = F.length(F.get(parts, F.lit(0))) == 4
        year, day = F.when(first, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(2))), F.when(first, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0)))
        return iso_date(year, F.get(parts, F.lit(1)), day)

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(P.CANONICAL_DATE), F.lit(0)), iso))))


def page_label(page_start: Column, page_end: Column, char_start: Column, char_end: Column) -> Column:
    """Pages, or else the character span."""
    pages = F.when(page_start == F.coalesce(page_end, page_start), F.concat(F.lit("page "), page_start.cast("string"))).otherwise(F.concat(F.lit("pages "), page_start.cast("string"), F.lit("-"), page_end.cast("string")))
    return F.coalesce(pages, F.concat(F.lit("chars "), char_start.cast("string"), F.lit("-"), char_end.cast("string")))


def source_label(document_type: Column, author: Column, file: Column, place: Column) -> Column:
    """FN23: what a citation shows."""
    kind = F.initcap(F.translate(document_type, "_", " "))
    return F.concat_ws(", ", F.nullif(kind, F.lit("")), F.nullif(author, F.lit("")), F.nullif(file, F.lit("")), place)


def visible_file(file: Column) -> Column:
    """FN24: names that are 32 hexadecimal digits are hidden."""
    return F.when(~file.rlike(r"^[0-9a-f]{32}(?:\.\w+)?$"), file)


def context_block(source_no: Column, file: Column, place: Column, author: Column, date: Column, document_type: Column, text: Column) -> Column:
    """FN25: header parts joined by a bar, then the text."""
    head = F.concat_ws(" | ", F.concat(F.lit("[Source "), source_no.cast("string"), F.lit("]")), file, place, F.concat(F.lit("Author: "), author), F.concat(F.lit("Date: "), date), F.concat(F.lit("Type: "), document_type))
    return F.concat(head, F.lit("\n"), text)


def case_name(run_dir: Column) -> Column:
    """FN26: the folder's base name, only safe characters, at most 60."""
    base = F.element_at(F.split(F.regexp_replace(run_dir, "/+$", ""), "/"), -1)
    return F.substring(F.regexp_replace(base, r"[^A-Za-z0-9_-]+", "_"), 1, 60)


def collection_name(model: Column, prefix: str = "records") -> Column:
    """FN27: a safe suffix of the model name."""
    safe = F.lower(F.right(F.regexp_replace(model, r"[^A-Za-z0-9]+", "_"), F.lit(40)))
    return F.concat(F.lit(prefix + "_"), F.btrim(safe, F.lit("_")))


def sigmoid(x: Column) -> Column:
    """FN28."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def progress(completed: Column, total: Column, elapsed: Column) -> Column:
    """FN31: struct(percent, remaining seconds at the observed rate)."""
    share = F.when(total > 0, F.least(F.lit(1.0), completed / total)).otherwise(F.lit(0.0))
    return F.struct(F.round(share * 100, 1).alias("percent"), F.when(completed > 0, elapsed / completed * F.greatest(total - completed, F.lit(0))).alias("remaining"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """FN32; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


def _dealt(names, n: int) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in range(n)]
    for name in names:
        out[zlib.crc32(name.encode()) % n].append(name)
    return out


#: Entities that need no semicolon, longest first, and the others by name; numbers below 160 have values of their own. All from the standard library's table.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:" + "|".join(_BARE) + "))"
_DEALT = 512
_NAMES = json.dumps([{n: html5[n] for n in names} for names in _dealt(html5, _DEALT)])
_SHORT, _LOW = json.dumps({n: html5[n] for n in _BARE}), json.dumps({f"#{n}": html_unescape(f"&#{n};") for n in range(160)})


def _number(digits: Column, low: Column) -> Column:
    """The sign of a hexadecimal number; ``low``: what one below 160 stands for."""
    number = F.when(F.length(digits) > 8, F.lit(1 << 40)).otherwise(F.conv(digits, 16, 10).cast("bigint"))
    none = lambda n: ((n >= 0xFDD0) & (n <= 0xFDEF)) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    sign = lambda n: F.when(n < 160, F.try_element_at(low, F.concat(F.lit("#"), n.cast("string")))).when((n > 0x10FFFF) | ((n >= 0xD800) & (n <= 0xDFFF)), "\ufffd").when(none(n), "").otherwise(F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
    return F.get(F.transform(F.array(number), sign), F.lit(0))


def _entity(e: Column) -> Column:
    """What one entity stands for; one without a meaning stays. A map is searched from its start, so names are dealt over many small ones."""
    low = F.from_json(F.lit(_LOW), "map<string,string>")
    table = F.get(F.from_json(F.lit(_NAMES), "array<map<string,string>>"), F.pmod(F.crc32(F.encode(F.substring(e, 2, 64), "UTF-8")), F.lit(_DEALT)).cast("int"))
    hexadecimal, decimal = F.regexp_extract(e, "^&#[xX]0*([0-9a-fA-F]+)", 1), F.regexp_extract(e, "^&#0*([0-9]+)", 1)
    digits = F.when(F.lower(F.substring(e, 3, 1)) == "x", hexadecimal).when(F.length(decimal) < 10, F.conv(decimal, 10, 16)).otherwise("FFFFFFFF")
    sign = F.get(F.transform(F.array(digits), lambda d: _number(d, low)), F.lit(0))
    bare = F.regexp_extract(e, "^&(" + "|".join(_BARE) + ")", 1)
    named = F.coalesce(F.try_element_at(table, F.substring(e, 2, 64)), F.get(F.transform(F.array(bare), lambda b: F.when(b != "", F.concat(F.try_element_at(F.from_json(F.lit(_SHORT), "map<string,string>"), b), e.substr(F.length(b) + 2, F.length(e))))), F.lit(0)))
    return F.coalesce(F.when(e.startswith("&#"), sign).otherwise(named), e)


def unescape(text: Column) -> Column:
    """Every HTML entity, named or by number, as what it stands for; in one pass, so `&amp;lt;` becomes `&lt;`."""
    # cut at the ampersands, where every entity begins: a longer pattern would be compiled again for each text by a split
    parts = F.split(text, "&", -1)
    seen = F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.struct(p.alias("p"), F.regexp_extract(F.concat(F.lit("&"), p), "^" + _ENTITY, 0).alias("e")))
    resolved = F.transform(seen, lambda x: F.when(x["e"] == "", F.concat(F.lit("&"), x["p"])).otherwise(F.concat(_entity(x["e"]), x["p"].substr(F.length(x["e"]), F.length(x["p"])))))
    return F.when(text.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(resolved, ""))).otherwise(text)


def strip_html(html: Column) -> Column:
    """FN33: tags as spaces, entities resolved, runs of blanks as one."""
    out = F.when(html.contains("<"), F.regexp_replace(html, "<[^>]+>", " ")).otherwise(html)
    return F.trim(one_blank(unescape(out)))


def case_label(run_dir: Column, documents: Column, chunks: Column) -> Column:
    """FN26: the selector's label of a case, with its counts."""
    base = F.nullif(F.element_at(F.split(F.regexp_replace(F.coalesce(run_dir, F.lit("")), "/+$", ""), "/"), -1), F.lit(""))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    return F.concat(F.lit("📁 "), F.coalesce(base, F.lit("unknown")), F.lit(" ("), count(documents), F.lit(" docs, "), count(chunks), F.lit(" chunks)"))


def cache_key(text: Column) -> Column:
    """FN34."""
    return F.substring(F.sha2(text, 256), 1, 32)


def title_case(text: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 100000)))), "")
