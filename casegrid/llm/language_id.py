"""Language ID by rank-order profiles.

Each language's profile is the list of its most frequent character n-grams in
learning texts; a document's list is compared with each profile by the
out-of-place distance: the sum of rank differences, with a fixed penalty for an
n-gram that the profile lacks. N-grams are taken inside words (runs of letters,
lower case, with one space on either side).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from casegrid.llm.text_tables import read_table

#: At most about this many documents of a language teach its profile, chosen by hash.
LEARN_DOCS = 4000
PROFILE, MAX_N, SPACE = 400, 3, 32
_letters: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case if it is a letter, else a space."""
    if not _letters:
        low = np.full(0x110000, SPACE, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                small = chr(c).lower()
                low[c] = ord(small[0])
        _letters.append(low)
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """N-gram codes of a whole text and their counts; None without letters."""
    low = _tables()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    low = np.concatenate(([SPACE], low, [SPACE])).astype(np.int64)
    solid = low != SPACE
    if not solid.any():
        return None
    low = low[np.concatenate(([True], solid[1:] | solid[:-1]))]  # one space of each run
    solid = low != SPACE
    two = low[:-1] << 21 | low[1:]
    three = two[:-1] << 21 | low[2:]
    codes = np.concatenate((low[solid], two[solid[:-1] | solid[1:]], three[solid[1:-1]]))
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, len(codes)))


def top(codes: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes in rank order; ties by code."""
    return codes[np.lexsort((codes, -counts))[:most]]


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", learn_docs: int = LEARN_DOCS) -> dict[str, np.ndarray]:
    """Language -> ranked n-gram codes, from rows with a language and a text.

    Up to about ``learn_docs`` documents a language, chosen by the hash of
    their id; fewer labelled rows are all used. The result holds PROFILE
    numbers a language.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    labelled = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    draw = F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(1 << 20))
    wanted = F.lit(False)
    for lang, n in labelled.items():
        wanted = wanted | ((F.col("lang") == lang) & (draw < int((1 << 20) * min(1.0, learn_docs / n))))
    if not labelled:
        return {}

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := grams(text):
                    held = total.setdefault(lang, {})
                    for c, n in zip(*(x.tolist() for x in found), strict=True):
                        held[c] = held.get(c, 0) + n
        for lang, held in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(held), "code": list(held), "n": list(held.values())}, pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())]))

    counted = rows.where(wanted).select("lang", "text").mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list] = {}
    for r in ranked.orderBy("lang", "rank").collect():  # PROFILE rows a language
        profiles.setdefault(r["lang"], []).append(r["code"])
    return {lang: np.array(codes, np.int64) for lang, codes in profiles.items()}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], *, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1.

    The score is 1 minus the mean out-of-place distance over the greatest
    possible. Null texts and texts without letters give ``und`` and 0; ties go
    to the language that sorts first; without any profile all rows are ``und``.
    Very long texts are counted whole; rows stay one by one, repeated or without
    an id; other columns may have any names; an empty table gives an empty
    result.
    """
    langs = sorted(profiles)
    known = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.empty(0, np.int64)
    ranks = np.full((len(langs), len(known) + 1), -1, np.int64)
    for i, lang in enumerate(langs):
        ranks[i, np.searchsorted(known, profiles[lang])] = np.arange(len(profiles[lang]))

    def one(text: str | None) -> tuple[str, float]:
        found = grams(text) if text and langs else None
        if found is None:
            return "und", 0.0
        own = top(*found)
        at = np.searchsorted(known, own)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != own)] = len(known)
        theirs = ranks[:, at]
        apart = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(own)))).sum(1)
        best = int(apart.argmin())
        return langs[best], float(1 - apart[best] / (PROFILE * len(own)))

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                got = [one(t) for t in part.column(part.num_columns - 1).to_pylist()]
                arrays = [*part.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kept = [c for c in docs.columns if c not in into]
    names = [*kept, *into]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + f", `{into[0]}` string, `{into[1]}` double"
    own = "text"
    while own in docs.columns:
        own += "_"
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(own)).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """A quarter of the documents, by crc32 of the id as text, never teaches a profile."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out()))
    out = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(out, profiles).select("doc_id", "held_out", "lang_pred", "score")
