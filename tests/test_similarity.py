"""JN11 against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from casegrid.operators.similarity import jaccard_pairs

SCHEMA = "query_id string, item_id bigint, tokens array<string>"


def plain(rows, threshold):
    out, sets = set(), [(g, i, {x for x in t or [] if x is not None}) for g, i, t in rows]
    for g, i, s in sets:
        for h, j, t in sets:
            if g == h and i < j and s and t and len(s & t) / len(s | t) >= threshold - 1e-9:
                out.add((g, i, j, round(len(s & t) / len(s | t), 9)))
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.8, 1.0])
def test_against_all_pairs(spark, threshold):
    rng, words, rows = random.Random(3), "abcdefghijklmnopqrstuvwxyz", []
    for g in ("q", "r", None):
        base = [rng.choice(words) for _ in range(12)]
        for i in range(60):
            t = [rng.choice(words[:14]) for _ in range(rng.randrange(1, 9))] if i % 2 else [x if rng.random() < 0.9 else rng.choice(words) for x in base] + [f"own{i}"] * (i % 3 == 0)
            rows.append((g, i, t))
    rows += [("q", 90, []), ("q", 91, None), ("q", 92, [None]), ("q", 93, ["zz", "zz", None]), ("q", 94, ["zz"]), ("s", 1, ["a"])]
    got = jaccard_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold).collect()
    want = plain(rows, threshold)
    assert len(got) == len(want) and {(r["query_id"], r["a"], r["b"], round(r["jaccard"], 9)) for r in got} == want and want


def test_sets_of_one_template_are_never_paired(spark):
    """Four common tokens and one of its own: not similar at 0.8, and no candidate either (all pairs would be 8 x 10^8)."""
    n = 40_000
    sets = spark.range(n).select(F.lit("q").alias("query_id"), F.col("id").alias("item_id"), F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma"), F.lit("delta"), F.concat(F.lit("u"), "id")).alias("tokens"))
    assert jaccard_pairs(sets, 0.8).count() == 0


def test_edges(spark):
    assert jaccard_pairs(spark.createDataFrame([], SCHEMA), 0.5).count() == 0
    with pytest.raises(ValueError):
        jaccard_pairs(spark.createDataFrame([], SCHEMA), 0)
