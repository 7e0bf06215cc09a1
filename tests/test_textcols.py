"""Golden values of the scalar functions."""

import html
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from casegrid.functions import patterns as P, textcols as T

GOLDENS = [
    (T.first_date_iso, "An X-ray was taken on 7/11/2016.", "2016-11-07"), (T.first_date_iso, "printed 03.09.2017 at the desk", "2017-09-03"), (T.first_date_iso, "the scan of 5 March 2015 was clear", "2015-03-05"), (T.first_date_iso, "Back at work since October 9, 2021", "2021-10-09"),
    (T.first_date_iso, "leap day 29-2-2016", "2016-02-29"), (T.first_date_iso, "due 30/02/2016", None), (T.first_date_iso, "undated", None), (T.first_date_iso, "1/2/49", "2049-02-01"), (T.first_date_iso, "1/2/50", "1950-02-01"), (T.first_date_iso, None, None),
    (T.author, "Seen by Dr Quilla Marrow, Ward Physician", "Quilla Marrow"), (T.author, "Kind regards\n\nDr Odo Fennick, MB", "Odo Fennick"), (T.author, "Yours faithfully\n\n(Typed in absence)\n\nA/Prof. Wren B. Tarn", "Wren B. Tarn"), (T.author, "nobody", None),
    (T.document_type, "Dear Doctor, the knee has healed.", "specialist_letter"), (T.document_type, "plain", "unknown"), (T.document_type, "CT OF SPINE\nDear Dr A\nFindings: none", "radiology_report"),
    (T.patient_name, "Re: Imaginary VON EXAMPLE DOB: 03.02.1990", "Imaginary VON EXAMPLE"), (T.patient_name, "Re: Mr. Imaginary Von Example", "Imaginary Von Example"),
    (T.iso_bound, "2020-3", "2020-03-01"), (T.iso_bound, "2020", "2020-01-01"), (T.iso_bound, "86400", "1970-01-02"), (T.iso_bound, "soon", None), (T.iso_bound, "2020-02-31", None),
    (T.evidence_text, "A-b,  Çé!", "a b çé"), (T.title_case, "o'brien smith-JONES", "O'Brien Smith-Jones"), (T.strip_html, "<b>a&amp;b</b> &lt;c&gt;", "a&b <c>"),
]


@pytest.mark.parametrize("function", list(dict.fromkeys(g[0] for g in GOLDENS)), ids=lambda f: f.__name__)
def test_goldens(spark, function):
    cases = [(text, want) for f, text, want in GOLDENS if f is function]
    rows = spark.createDataFrame(cases, "text string, want string").withColumn("got", function(F.col("text"))).collect()
    assert [(r["text"], r["got"]) for r in rows] == cases


def test_documented_date_and_canonical_dates(spark):
    cases = [("2020-02-30", None, "unknown"), ("3 Feb 2020", "2020-02-03", "day"), ("Sept 2020".replace("Sept", "Sep"), "2020-09", "month"), ("February 3rd, 2020", "2020-02-03", "day"), ("1999", "1999", "year"), ("31/12/1999", "1999-12-31", "day")]
    rows = spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", T.documented_date(F.col("t")).alias("d")).collect()
    assert [(r["t"], r["d"]["value"], r["d"]["precision"]) for r in rows] == cases
    got = spark.createDataFrame([("on 1/2/2020, 2020.02.01 and 31/2/2020",)], "t string").select(T.canonical_dates(F.col("t")).alias("d")).first()
    assert got["d"] == ["2020-02-01"]


ENTITIES = ["&eacute;&Alpha;", "&#233;&#xE9;&#Xe9", "&#128;&#0;&#x110000;&#xD800;&#1;&#65534;&#x1F600;", "&amp;lt;", "&notit; &notanentity; &", "&lt&gt", "AT&T &copy 2020", "&#99999999999999;", "&#x0000041;", "no entity", "&NotEqualTilde;", "&;&#;&#x;", "a&nbsp;b"]


def test_entities_as_the_standard_library_resolves_them(spark):
    rows = spark.createDataFrame([(e,) for e in ENTITIES], "t string").select("t", T.unescape(F.col("t")).alias("u")).collect()
    assert [(r["t"], r["u"]) for r in rows] == [(e, html.unescape(e)) for e in ENTITIES]


def test_selector_label(spark):
    rows = spark.createDataFrame([("/ws/run_a/", 2, 5), (None, None, 0), ("x", 1, 1)], "d string, n int, c int").select(T.case_label(F.col("d"), F.col("n"), F.col("c")).alias("l")).collect()
    assert [r["l"] for r in rows] == ["📁 run_a (2 docs, 5 chunks)", "📁 unknown (0 docs, 0 chunks)", "📁 x (1 docs, 1 chunks)"]


def test_entities_compile_no_pattern_for_each_text(spark):
    """Random texts as the standard library resolves them; the only split is at a single character, as a longer pattern is compiled for every row."""
    import random

    deal, names = random.Random(3), sorted(html.entities.html5)
    bits = [*ENTITIES, "&", ";", "&&amp;", "x", "&#", "&#x", "&#0;", "&#x00;", "&#xFDD0;", "&#1114111;", "&#2147483648;", "&#x80", "&#159;", "&#160;", "&#xZ;", "é&", "\n"]
    texts = ["".join(deal.choice(bits) if deal.random() < 0.5 else "&" + deal.choice(names) for _ in range(12)) for _ in range(400)] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.unescape(F.col("t")).alias("u"))
    assert [(r["t"], r["u"]) for r in rows.collect()] == [(t, t if t is None else html.unescape(t)) for t in texts]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == plan.count(", &, -1)") > 0


def test_a_text_is_searched_once_for_each_pattern(spark):
    """In every plan a pattern stands once: a second mention in a branch would be a second search."""
    rows = spark.createDataFrame([("Kind regards\n\nDr Odo Fennick",), ("IME",), (None,)], "t string")
    for function, sign, want in ((T.document_type, "Please", ["specialist_letter", "medicolegal_report", "unknown"]), (T.author, "faithfully\\|Signed", ["Odo Fennick", None, None])):
        got = rows.select(function(F.col("t")).alias("v"))
        assert [r["v"] for r in got.collect()] == want
        assert len(re.findall(sign, got._jdf.queryExecution().optimizedPlan().toString())) == 1, function


FIRST = [*[(p, P.DOCUMENT_TYPE_FIRST[n]) for n, p in P.DOCUMENT_TYPES.items()], *[(p, P.SECTION_TYPE_FIRST[n]) for n, p in P.SECTION_TYPES.items()], (P.AUTHOR_SIGNATURE, P.AUTHOR_SIGNATURE_FIRST), (P.AUTHOR_SENDER, P.AUTHOR_SENDER_FIRST)]


@pytest.mark.parametrize("pattern,first", FIRST)
def test_first_letters_lose_no_match(pattern, first):
    plain, quick = re.compile(T.loose(pattern), re.A), re.compile(T.loose(pattern, first), re.A)

    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.from_regex(plain) | st.text(max_size=5), max_size=4).map(" ".join))
    def same(text):
        assert [m.span() for m in plain.finditer(text)] == [m.span() for m in quick.finditer(text)]

    same()


@pytest.mark.parametrize("name", P.DOCUMENT_TYPE_ALSO)
def test_whatever_a_type_matches_holds_one_of_its_further_words(name):
    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(T.loose(P.DOCUMENT_TYPES[name]), re.A)))
    def holds(text):
        if all(ord(c) < 128 for c in text):
            assert any(w in text.casefold() for w in P.DOCUMENT_TYPE_ALSO[name])

    holds()
