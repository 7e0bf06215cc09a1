"""All pairs inside groups, as block products: a group of any size becomes tasks of two bounded blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from casegrid.llm.packed import split_points


def block_tasks(groups: DataFrame, group: str, item: str, rows: DataFrame, key: str, block_rows: int, partitions: int) -> DataFrame:
    """``rows`` with ``task`` and ``side``, sorted by task within partitions.

    ``groups`` says which ``item`` is in which ``group``; blocks are planned on
    it alone, then ``rows`` (whose ``key`` names the item) are joined once. A
    group of n items has b = ceil(n / block_rows) blocks by hash of the item and
    a task for each pair of blocks; a row goes to b tasks. ``side`` is 2 in a
    block's task with itself, else 0 or 1; pairs of a task are all pairs of side
    2, or those between sides 0 and 1.
    """
    sizes = groups.groupBy(group).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("__blocks")).withColumnRenamed(group, "__g")
    plan = groups.join(sizes, groups[group] == sizes["__g"]).select(F.col(item).alias("__item"), F.col(group).alias("__group"), "__blocks")
    out = rows.join(plan, rows[key] == plan["__item"])
    out = out.withColumn("__own", F.pmod(F.xxhash64("__item"), F.col("__blocks")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    side = F.when(F.col("__own") == F.col("__other"), 2).when(F.col("__own") < F.col("__other"), 0).otherwise(1)
    out = out.withColumn("task", F.xxhash64("__group", F.least("__own", "__other"), F.greatest("__own", "__other"))).withColumn("side", side.cast("int"))
    return out.select("task", "side", *[rows[c] for c in rows.columns]).repartition(partitions, "task").sortWithinPartitions("task")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs of two blocks of sets: one incidence matrix times the other's transpose, column by column."""
    n, m = len(left), len(right)
    out = np.zeros((n, m), np.float32)
    every, owner = np.concatenate([*left, *right]), np.repeat(np.arange(n + m), [len(s) for s in (*left, *right)])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts, ends = split_points(every)
    df = ends - starts
    common = np.flatnonzero(df >= 24)
    for low in range(0, len(common), 1024):  # dense columns
        cols = common[low : low + 1024]
        dense = np.zeros((n + m, len(cols)), np.float32)
        rows = np.concatenate([owner[starts[c] : ends[c]] for c in cols])
        dense[rows, np.repeat(np.arange(len(cols)), df[cols])] = 1
        out += dense[:n] @ dense[n:].T
    flat = out.reshape(-1)
    for d in np.unique(df[(df > 1) & (df < 24)]):  # thin columns: their few pairs, all columns of a count at once
        rows = owner[starts[df == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        for low in range(0, len(rows), max(1, 1_000_000 // len(i))):
            part = rows[low : low + max(1, 1_000_000 // len(i))]
            a, b = part[:, i].astype(np.int64).ravel(), part[:, j].astype(np.int64).ravel()
            across = (a < n) & (b >= n)
            at, k = np.unique(a[across] * m + b[across] - n, return_counts=True)
            flat[at] += k
    return out


def sparse_overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, overlap) of all pairs i < j that share an element, where few sets share any one element."""
    n = len(sets)
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts, ends = split_points(every)
    df, codes = ends - starts, [np.empty(0, np.int64)]
    for d in np.unique(df[df > 1]):
        rows = owner[starts[df == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        codes.append((rows[:, i] * n + rows[:, j]).ravel())
    at, k = np.unique(np.concatenate(codes), return_counts=True)
    return at // n, at % n, k
