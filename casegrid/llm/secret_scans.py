"""Secret scans with DataFrame functions only.

Base findings come from three patterns. The entropy scan adds candidate strings
(runs of key-like characters) whose best sliding window has a Shannon entropy
above its class's threshold; a window's entropy is kept up to date by counts:
the character that enters and the one that leaves change two counts and the sum
of c*log2(c). An allow-list takes back candidates that only look like secrets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from casegrid.llm.text_tables import read_table, text_or_empty

#: The kinds in their order, with their patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # likewise: a shorter run holds no longer match
HEX = r"[0-9a-f]{24,}"  # the same spans as all runs of which those under 24 characters are dropped
MIN_ASSIGN = 6

#: A candidate is a run of these characters; windows of WINDOW characters slide over it.
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
WINDOW = 24
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character class of a candidate -> least entropy in bits of its best window.
THRESHOLDS = {"hex": 3.0, "alnum": 3.8, "base64": 3.9}
#: Candidates that contain one of these, or that match a form below, are never reported.
ALLOW_WORDS = ("example", "sample", "placeholder", "changeme", "xxxxxxxx", "00000000", "abcdefgh", "lorem")
ALLOW_FORMS = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # a UUID
    r"^[A-Za-z_=/+-]+$",  # no digit: words, paths, rules
    r"^[0-9_=/+-]+$",  # no letter: numbers, dates
    r"^(.{1,8})\1{2,}",  # a short unit over and over
)


SLICE = 128


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, pattern: str, kind: str, good) -> Column:
    """array<struct<start,end,kind>> of the non-overlapping matches that ``good(match)`` keeps; code points.

    ``split`` gives the text between matches, so running lengths give offsets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    both = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))

    def step(state, x):
        begin = state["at"] + x["gap"]
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    def part(matches, state, k):
        """Offsets of one slice of the matches, so that no long list grows by one at a time."""
        start = F.struct(state["at"].alias("at"), F.array().cast("array<struct<start:int,end:int,m:string>>").alias("out"))
        done = F.aggregate(F.slice(matches, k * SLICE + 1, F.lit(SLICE)), start, step)
        return _bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,m:string>>>").alias("out"))
    placed = _bound(both, lambda m: F.flatten(F.aggregate(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / SLICE).cast("int")), empty, lambda s, k: part(m, s, k), lambda s: s["out"])))
    kept = F.transform(F.filter(placed, lambda x: good(x["m"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return F.when(text.rlike(pattern), kept).otherwise(none)


def best_entropy(candidate: Column) -> Column:
    """The greatest Shannon entropy, in bits, of any WINDOW characters of ``candidate``."""
    codes = F.transform(F.split(candidate, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1)
    # each character with the one that leaves the window as it enters
    moves = _bound(codes, lambda c: F.slice(F.zip_with(c, F.concat(F.array_repeat(F.lit(-1), WINDOW), c), lambda x, y: F.struct(x.alias("came"), y.alias("left"))), 1, F.size(c)))
    gain = lambda c: F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), F.lit(0).alias("at"))

    def step(state, move):
        counts, at, code, out_code = state["counts"], state["at"], move["came"], move["left"]
        same = out_code == code
        came, left = F.get(counts, code), F.when(out_code >= 0, F.get(counts, out_code)).otherwise(F.lit(0))
        s = F.when(same, state["s"]).otherwise(state["s"] + gain(came + 1) - gain(came) - F.when(out_code >= 0, gain(left) - gain(left - 1)).otherwise(F.lit(0.0)))
        new = F.when(same, counts).otherwise(F.transform(counts, lambda c, i: c + (i == code).cast("int") - (i == out_code).cast("int")))
        return _bound(s, lambda v: F.struct(new.alias("counts"), v.alias("s"), F.when(at >= WINDOW - 1, F.greatest(state["best"], F.lit(math.log2(WINDOW)) - v / F.lit(float(WINDOW)))).otherwise(state["best"]).alias("best"), (at + 1).alias("at")))

    return F.aggregate(moves, zero, step, lambda s: s["best"])


def char_class(candidate: Column) -> Column:
    return F.when(candidate.rlike("^[0-9a-fA-F]+$"), F.lit("hex")).when(candidate.rlike("^[0-9A-Za-z]+$"), F.lit("alnum")).otherwise(F.lit("base64"))


def allowed(candidate: Column) -> Column:
    low = F.lower(candidate)
    hit = F.lit(False)
    for word in ALLOW_WORDS:
        hit = hit | low.contains(word)
    for form in ALLOW_FORMS:
        hit = hit | candidate.rlike(form)
    return hit


def _entropy_good(candidate: Column) -> Column:
    least = F.lit(None).cast("double")
    for name, value in THRESHOLDS.items():
        least = F.when(char_class(candidate) == name, F.lit(value)).otherwise(least)
    return ~allowed(candidate) & (best_entropy(candidate) >= least)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col and ``base`` and ``added``, arrays of struct(start, end, kind).

    Offsets are code points, end exclusive. ``base`` holds the kinds assign,
    access and hex in the order (start, kind as listed); ``added`` holds the
    kind entropy. Null and empty texts have empty arrays; repeated rows stay;
    columns other than the two named are not read, so names can't clash.
    """
    text = text_or_empty(text_col)
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGN
    carried = [F.col(c) for c in carry or []]
    found = docs.select(
        F.col(id_col), *carried, _spans(text, ASSIGN, "assign", value).alias("assign"), _spans(text, ACCESS, "access", lambda m: F.lit(True)).alias("access"),
        _spans(text, HEX, "hex", lambda m: F.lit(True)).alias("hex"), _spans(text, CANDIDATE, "entropy", _entropy_good).alias("added"),
    )
    def less(a, b):
        rank = lambda x: F.when(x["kind"] == "assign", 0).when(x["kind"] == "access", 1).when(x["kind"] == "hex", 2).otherwise(3)
        return F.when(a["start"] != b["start"], F.signum((a["start"] - b["start"]).cast("double")).cast("int")).otherwise(rank(a) - rank(b))

    return found.select(
        F.col(id_col), *carried, F.size("assign").cast("bigint").alias("n_assign"), F.size("access").cast("bigint").alias("n_access"), F.size("hex").cast("bigint").alias("n_hex"),
        F.array_sort(F.concat("assign", "access", "hex"), less).alias("base"), F.array_sort(F.concat("assign", "access", "hex", "added"), less).alias("every"), "added",
    )


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``id_col`` and the text in which ``mask`` stands for every base and added span; null texts become empty."""
    text = text_or_empty(text_col)
    found = find_secrets(docs.select(F.col(id_col), F.col(text_col), text.alias("__whole")), id_col=id_col, text_col=text_col, carry=["__whole"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, x):
        covered = x["end"] <= state["at"]
        gap = F.when(x["start"] > state["at"], F.col("__whole").substr(state["at"] + 1, x["start"] - state["at"])).otherwise(F.lit(""))
        sign = F.when(x["start"] >= state["at"], F.lit(mask)).otherwise(F.lit(""))
        return F.when(covered, state).otherwise(F.struct(x["end"].alias("at"), F.concat(state["out"], gap, sign).alias("out")))

    masked = F.aggregate("every", start, step, lambda s: F.concat(s["out"], F.col("__whole").substr(s["at"] + 1, F.length("__whole"))))
    return found.select(F.col(id_col), masked.alias(text_col))


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("every")).alias("spans"),
        F.size("added").cast("bigint").alias("n_entropy"),
    )
