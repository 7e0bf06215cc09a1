"""JN11: pairs of similar token sets inside groups, by a prefix-filtered self join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

#: Below a count by so much, rounding does not decide.
_EPS = 1e-9


def jaccard_pairs(sets: DataFrame, threshold: float, *, group: str = "query_id", item: str = "item_id", tokens: str = "tokens") -> DataFrame:
    """JN11: (group, a, b, jaccard) of all pairs a < b of one group whose Jaccard similarity is at least ``threshold`` (above 0).

    ``sets``: group, item (once in a group) and an array of tokens, repeats
    ignored. Null groups are a group; empty, null and token-less sets pair with
    nothing. No pair is left out, and none is formed that these rules exclude:

    - tokens that no other set of the group holds can't be shared: they only count in a set's size;
    - sorted by rarity, two similar sets share a token of their prefixes, of size ``matchable - ceil(threshold * size) + 1``;
    - sizes n, m with fewer than ``threshold / (1 + threshold) * (n + m)`` matchable tokens on either side don't meet, so
      sets from one template whose own tokens differ are never paired, however many there are.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a share above 0")
    every = sets.select(F.col(group).alias("g"), F.col(item).alias("id"), F.array_distinct(F.filter(tokens, lambda x: x.isNotNull())).alias("words")).where(F.size("words") > 0)
    words = every.select("g", "id", F.size("words").alias("n"), F.explode("words").alias("word"))
    shared = words.groupBy("g", "word").agg(F.count("*").alias("df")).where("df > 1").select(F.col("g").alias("dg"), F.col("word").alias("dword"), "df")
    matchable = words.join(shared, F.col("g").eqNullSafe(F.col("dg")) & (F.col("word") == F.col("dword"))).drop("dg", "dword")
    own = W.partitionBy("g", "id")
    need = F.ceil(F.col("n") * threshold - _EPS)
    ranked = matchable.withColumns({"at": F.row_number().over(own.orderBy("df", "word")), "s": F.count("*").over(own)})
    prefix = ranked.where(F.col("at") <= F.col("s") - need + 1).select("g", "id", "word", "n", "s", "at")

    # which shapes (size, matchable) can meet: few rows, whatever the number of sets
    shapes = prefix.select("g", "n", "s").distinct()
    a = shapes.select(F.col("g").alias("ag"), F.col("n").alias("an"), F.col("s").alias("as"), F.explode(F.sequence(F.col("n").cast("bigint"), F.floor(F.col("n") / threshold + _EPS))).alias("m"))
    b = shapes.select(F.col("g").alias("bg"), F.col("n").alias("bn"), F.col("s").alias("bs"))
    least = F.ceil((F.col("an") + F.col("bn")) * (threshold / (1 + threshold)) - _EPS)
    meets = a.join(b, F.col("ag").eqNullSafe(F.col("bg")) & (F.col("m") == F.col("bn"))).where(least <= F.least("as", "bs")).select("ag", "an", "as", "bn", "bs")

    left = prefix.join(meets, F.col("g").eqNullSafe(F.col("ag")) & (F.col("n") == F.col("an")) & (F.col("s") == F.col("as"))).select("g", "word", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("s").alias("xs"), F.col("at").alias("xat"), "bn", "bs")
    right = prefix.select(F.col("g").alias("rg"), F.col("word").alias("rword"), F.col("id").alias("y"), F.col("n").alias("yn"), F.col("s").alias("ys"), F.col("at").alias("yat"))
    met = left.join(right, F.col("g").eqNullSafe(F.col("rg")) & (F.col("word") == F.col("rword")) & (F.col("bn") == F.col("yn")) & (F.col("bs") == F.col("ys")))
    # what can still be shared from this token on must do, if it is the first that they share; the pair's first shared token always passes
    room = F.least(F.col("xs") - F.col("xat"), F.col("ys") - F.col("yat")) + 1
    enough = room + F.least("xat", "yat") - 1 >= F.ceil((F.col("xn") + F.col("yn")) * (threshold / (1 + threshold)) - _EPS)
    pairs = met.where(((F.col("xn") < F.col("yn")) | (F.col("x") < F.col("y"))) & enough)
    pairs = pairs.select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    of = lambda side: every.select(F.col("g").alias(f"{side}g"), F.col("id").alias(f"{side}id"), F.col("words").alias(f"{side}words"))
    both = pairs.join(of("p"), F.col("g").eqNullSafe(F.col("pg")) & (F.col("a") == F.col("pid"))).join(of("q"), F.col("g").eqNullSafe(F.col("qg")) & (F.col("b") == F.col("qid")))
    overlap = F.size(F.array_intersect("pwords", "qwords"))
    scored = both.select(F.col("g").alias(group), "a", "b", (overlap / (F.size("pwords") + F.size("qwords") - overlap)).alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold - _EPS)
