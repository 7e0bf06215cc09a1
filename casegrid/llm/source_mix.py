"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length). Each source's target says how
many whole copies of the source fit; the rest is a budget that a bounded
knapsack over the length counts fills: an even share of every length first, then
lengths from large to small, then a bitset subset-sum over the counts that are
left, which finds the best fill of the last words. The knapsack sees counts
only (as many rows as a source has distinct lengths); which documents carry a
length count is settled by a seeded hash order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from casegrid.llm.text_tables import read_table, text_or_empty
from casegrid.workspace import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: The last budget is searched exactly up to this many words.
EXACT_BUDGET = 1 << 16


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Share ``sum(sizes)`` by weight; no target above ``most`` times its size, the excess reshared until none is."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        weight = sum(weights[i] for i in open_)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = most * sizes[i]
        open_ -= set(over)
    return out


def fill(budget: int, lengths: list[int], counts: list[int]) -> list[int]:
    """How many documents of each length to take so that their words come nearest below ``budget``."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left <= EXACT_BUDGET:
            break
        if lengths[i]:
            more = min(counts[i] - taken[i], (left - EXACT_BUDGET) // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    parts, sums = [], [1]
    mask = (1 << (left + 1)) - 1
    for i in order:
        spare, unit = min(counts[i] - taken[i], left // lengths[i] if lengths[i] else 0), 1
        while spare > 0:
            unit = min(unit, spare)
            now = (sums[-1] | (sums[-1] << (unit * lengths[i]))) & mask
            if now != sums[-1]:
                parts.append((i, unit))
                sums.append(now)
            spare -= unit
            unit *= 2
        if sums[-1] >> left & 1:
            break
    at = sums[-1].bit_length() - 1
    for k in range(len(parts) - 1, -1, -1):
        if not sums[k] >> at & 1:
            i, unit = parts[k]
            taken[i] += unit
            at -= unit * lengths[i]
    return taken


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 20, row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, size, source_size, target, taken (and row_col).

    Size is the number of words (null: 0). Sources in code point order, null
    last, get ``weights`` in turn; ``taken`` is size times the copies the mix
    takes, between 0 and ``most`` copies. Sizes of 0 take nothing. Equal rows
    are told apart only by their id and text; rows equal in both are taken
    together, unless ``row_col`` names a column of row keys: then the text, then
    the key decides among rows of one id, and rows without an id are dealt by
    their text. Results depend on the data and the seed alone. Columns other than
    the three named are not read. An empty table gives an empty result.
    """
    own = [] if row_col is None else [F.col(row_col).alias("row"), F.xxhash64(text_col).alias("tie")]
    dealt = F.xxhash64(F.lit(seed), "id") if row_col is None else F.when(F.col("id").isNull(), F.xxhash64(F.lit(seed), "tie")).otherwise(F.xxhash64(F.lit(seed), "id"))
    narrow = materialize(
        docs.select(*own, F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")).withColumn("order", dealt),
        "sizes",
    )
    lengths = narrow.groupBy("source", "size").agg(F.count("*").alias("docs"))
    by_source = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    ranked = by_source.withColumn("at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)

    def shared(frames):
        held = [f for f in frames if len(f)]
        if held:
            f = pd.concat(held).sort_values("at")
            f["target"] = targets([int(x) for x in f["source_size"]], [float(weights[int(a) % len(weights)]) for a in f["at"]], most)
            yield f[["source", "source_size", "target"]]

    source_type = narrow.schema["source"].dataType.simpleString()
    goals = ranked.coalesce(1).mapInPandas(shared, f"source {source_type}, source_size bigint, target double")

    def filled(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("size")
        size, goal = int(f["source_size"].iloc[0]), float(f["target"].iloc[0])
        copies = min(int(goal // size), most) if size else 0
        take = fill(round(goal) - copies * size, list(map(int, f["size"])), list(map(int, f["docs"]))) if size and copies < most else [0] * len(f)
        return f.assign(copies=copies, more=take)[["source", "size", "source_size", "target", "docs", "copies", "more"]]

    with_goal = lengths.join(goals, lengths["source"].eqNullSafe(goals["source"])).select(lengths["source"], "size", "docs", "source_size", "target")
    quotas = materialize(with_goal.groupBy("source").applyInPandas(filled, f"source {source_type}, size bigint, source_size bigint, target double, docs bigint, copies int, more bigint"), "quotas")
    return _select(narrow, quotas, id_col, row_col)


def _select(narrow: DataFrame, quotas: DataFrame, id_col: str, row_col: str | None) -> DataFrame:
    """Give ``more`` documents of each (source, size), first in hash order, one copy more.

    A count of many documents is cut into slices of the hash order; slices
    below the quota are taken whole, only the slice at the quota is ranked.
    """
    cut = quotas.withColumn("slices", F.greatest(F.lit(1), (F.col("docs") / 1000).cast("bigint")))
    q = cut.select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), "source_size", "target", "copies", "more", "slices")
    rows = narrow.join(q, narrow["source"].eqNullSafe(q["q_source"]) & (narrow["size"] == q["q_size"])).drop("q_source", "q_size")
    # the order's upper bits as a number in [0, 1) give the slice
    part = F.floor((F.shiftrightunsigned("order", 11).cast("double") / F.lit(float(1 << 53))) * F.col("slices"))
    rows = materialize(rows.withColumn("slice", F.least(part, F.col("slices") - 1)), "rows")
    full = rows.where("more > 0").groupBy("source", "size", "slice", "more").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    quota = full.withColumn("here", F.greatest(F.lit(0), F.least(F.col("n"), F.col("more") - before))).select(F.col("source").alias("h_source"), F.col("size").alias("h_size"), F.col("slice").alias("h_slice"), "here")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("source", "size", "slice").orderBy("order", "id", *["tie", "row"] * (row_col is not None))))
    same = ranked["source"].eqNullSafe(quota["h_source"]) & (ranked["size"] == quota["h_size"]) & (ranked["slice"] == quota["h_slice"])
    out = ranked.join(quota, same, "left")
    extra = (F.col("rank") <= F.coalesce("here", F.lit(0))).cast("bigint")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("copies") + extra)).cast("bigint").alias("taken"), *([] if row_col is None else [F.col("row").alias(row_col)]))


def op3_source_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))
