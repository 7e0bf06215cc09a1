"""Embedding near-dedup by sorted projection passes.

In each pass a vector's key is the concatenation of random hashes (signs of
random projections); vectors are put in lexicographic order of the key, each is
compared by exact cosine with its next neighbours in that order, and the
verified pairs of all passes are united. The passes settle who belongs
together; the number of links of a vector is then counted exactly inside its
component by block products, so it doesn't depend on the window.

Two vectors agree on the first bits of a key with a probability that depends on
their angle alone, but how many others share these bits depends on the data. So
vectors with the same first ``cell_bits`` bits are a cell, all pairs of a cell
are compared however many they are, and a cell never crosses a partition's
border: cells of up to SPREAD windows in the sorted order, larger ones (where
many vectors resemble each other) in bounded blocks over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegrid.components import components
from casegrid.llm.packed import blob, by_key, forest
from casegrid.llm.pair_blocks import block_tasks
from casegrid.llm.text_tables import partitions_for, read_table
from casegrid.workspace import materialize

BITS, WINDOW, PASS_GROUP, BLOCK_ROWS = 48, 40, 16, 1024
#: A cell of more than SPREAD windows is compared in blocks of DENSE_ROWS rows, TILE rows of a block at a time.
SPREAD, DENSE_ROWS, TILE = 8, 4096, 512


def passes_for(rows: int, cosine: float, window: int = WINDOW, miss: float = 0.02) -> int:
    """Passes so that a pair at the threshold shares a cell with probability 1 - miss.

    A bit agrees with probability 1 - angle/pi; a cell has log2(rows / window)
    bits, rounded down.
    """
    same = (1 - math.acos(cosine) / math.pi) ** max(1.0, math.log2(max(2, rows / window)))
    return max(8, math.ceil(math.log(miss) / math.log(1 - same)))


def cell_bits(rows: int, window: int = WINDOW) -> int:
    return min(BITS, max(1, math.floor(math.log2(max(2, rows / window)))))


def can_link(id_col: str, vector_col: str):
    """Whether a vector can link: it has an id, none of its components is null or not finite, not all are zero."""
    good = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    return F.coalesce(F.col(id_col).isNotNull() & good, F.lit(False))


def unit_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, unit) of the vectors that can link: a key of the row, the id, the unit vector's doubles as bytes."""
    rows = table.where(can_link(id_col, vector_col)).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                out = []
                for v in part.column(2).to_pylist():
                    x = np.array(v, np.float64)
                    x = x / np.abs(x).max()
                    out.append(blob(x / math.sqrt(float(x @ x))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["row", "id", "unit"])

    return rows.mapInArrow(run, "row bigint, id bigint, unit binary")


def _keys(passes: range, seed: int, bits: int, with_unit: bool):
    """Every vector once for each pass, with its key and its cell (the pass and the key's first bits)."""

    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                units = part.column(1).to_pylist()
                dims = np.array([len(u) // 8 for u in units])
                for p in passes:
                    key = np.empty(len(units), np.int64)
                    for d in np.unique(dims):
                        at = np.flatnonzero(dims == d)
                        if (p, d) not in planes:
                            planes[p, d] = np.random.default_rng([seed, p, d]).standard_normal((d, BITS))
                        x = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), d)
                        key[at] = (x @ planes[p, d] > 0) @ weights
                    columns = [pa.array((np.int64(p) << BITS) | (key >> (BITS - bits))), pa.array(key), part.column(0)] + [part.column(1)] * with_unit
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "key", "id", "unit"][: len(columns)])

    return run


def _forest_batch(ids: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Links a-b (positions in ``ids``) cut down to a forest."""
    names, at = np.unique(np.concatenate((ids[a], ids[b])), return_inverse=True)
    root = forest(at[: len(a)], at[len(a) :], len(names))
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_pydict({"a": names[root[moved]].astype(np.int64), "b": names[moved].astype(np.int64)})


def _windows(cosine: float, window: int, spread: int):
    """Neighbours in key order, up to ``spread`` places apart within a cell -> verified links; a slice's links are cut down to a forest."""

    def links(ids, units, cells):
        found_a, found_b = [], []
        sizes = np.array([len(u) for u in units])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x, c = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), -1), cells[at]
            for step in range(1, min(spread, len(at) - 1) + 1):
                near = np.flatnonzero(c[:-step] == c[step:] if step > window else c[:-step] >> BITS == c[step:] >> BITS)
                if not len(near):
                    break
                ok = near[np.einsum("ij,ij->i", x[near], x[near + step]) >= cosine] if len(near) < len(at) - step else np.flatnonzero(np.einsum("ij,ij->i", x[:-step], x[step:]) >= cosine)
                found_a.append(at[ok])
                found_b.append(at[ok + step])
        return _forest_batch(ids, np.concatenate(found_a), np.concatenate(found_b)) if found_a else None

    def run(batches):
        tail = None
        for batch in batches:
            for low in range(0, batch.num_rows, 8192):
                part = pa.Table.from_batches([batch.slice(low, 8192)])
                held = pa.concat_tables([tail, part]) if tail is not None else part
                out = links(held.column("id").to_numpy(), held.column("unit").to_pylist(), held.column("cell").to_numpy())
                if out is not None and out.num_rows:
                    yield out
                tail = held.slice(max(0, held.num_rows - spread))

    return run


def _blocks(cosine: float):
    """A task's vectors -> the verified links among all its pairs, cut down to a forest."""

    def run(batches):
        for _, table in by_key(batches, "task"):
            ids, side, units = table.column("id").to_numpy(), table.column("side").to_numpy(), table.column("unit").to_pylist()
            sizes = np.array([len(u) for u in units])
            found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for d in np.unique(sizes):
                left, right = np.flatnonzero((sizes == d) & (side != 1)), np.flatnonzero((sizes == d) & (side != 0))
                x, y = (np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), d // 8) for at in (left, right))
                for low in range(0, len(left), TILE):
                    a, b = np.nonzero(x[low : low + TILE] @ y.T >= cosine)
                    root = forest(left[a + low], right[b], len(ids))
                    moved = np.flatnonzero(root != np.arange(len(ids)))
                    found_a.append(root[moved])
                    found_b.append(moved)
            yield _forest_batch(ids, np.concatenate(found_a), np.concatenate(found_b))

    return run


def _dense_links(members: DataFrame, pairs: float, classes: DataFrame, cosine: float) -> DataFrame:
    """Links among all pairs that share a dense cell; ``members``: cell, id; ``pairs``: sum of the cells' squared sizes.

    Where the cells of several passes hold the same vectors again and again, all
    of these vectors are compared once with each other instead.
    """
    once = members.select("id").distinct()
    if float(once.count()) ** 2 <= pairs:
        members = once.select(F.lit(0).cast("bigint").alias("cell"), "id")
    tasks = block_tasks(members.withColumnRenamed("id", "member"), "cell", "member", classes.select("id", "unit"), "id", DENSE_ROWS, partitions_for(classes.sparkSession, 0, 1) * 2)
    return tasks.mapInArrow(_blocks(cosine), "a bigint, b bigint").distinct()


def _counts(cosine: float):
    """A task's vectors -> how many of the others (copies counted) each links to."""

    def run(batches):
        for _, table in by_key(batches, "task"):
            ids, copies, side = (table.column(c).to_numpy() for c in ("id", "copies", "side"))
            units = table.column("unit").to_pylist()
            sizes = np.array([len(u) for u in units])
            links = np.zeros(len(ids), np.int64)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                x = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(len(at), -1)
                near = x @ x.T >= cosine
                near &= (side[at][:, None] == 2) | (side[at][:, None] != side[at][None, :])
                np.fill_diagonal(near, False)
                links[at] += near @ copies[at]
            yield pa.RecordBatch.from_pydict({"id": ids.astype(np.int64), "links": links})

    return run


def near_duplicates(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, passes: int | None = None, window: int = WINDOW, seed: int = 8) -> DataFrame:
    """One row per row of ``table``: id_col, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without an id, link with nothing. Equal vectors are one class that
    is compared once; copies link to each other. Vectors of different lengths
    never link. ``id_col`` holds integers; rows that repeat an id are vectors of
    their own, each with the smallest id of its component. Labels and other
    columns are not read. An empty table gives an empty result.
    """
    spark = table.sparkSession
    units = materialize(unit_vectors(table, id_col, vector_col), "units")
    classes = materialize(units.groupBy("unit").agg(F.min("row").alias("id"), F.min("id").alias("name"), F.count("*").alias("copies")), "classes")
    rows = classes.count()
    todo, links = range(passes or passes_for(rows, cosine, window)), None
    bits, spread = cell_bits(rows, window), SPREAD * window
    vectors = classes.select("id", "unit")
    for low in range(0, len(todo), PASS_GROUP):
        group = todo[low : low + PASS_GROUP]
        narrow = vectors.mapInArrow(_keys(group, seed, bits, False), "cell bigint, key bigint, id bigint").select("cell", "id")
        dense = materialize(narrow.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > spread + 1), "dense")
        cells, pairs = dense.agg(F.count("*"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
        keyed = vectors.mapInArrow(_keys(group, seed, bits, True), "cell bigint, key bigint, id bigint, unit binary")
        if cells:
            keyed = keyed.join(dense.select("cell"), "cell", "left_anti")
        parts = partitions_for(spark, rows * len(group), 200_000)
        ordered = keyed.repartitionByRange(parts, "cell").sortWithinPartitions("cell", "key", "id")
        found = materialize(ordered.mapInArrow(_windows(cosine, window, spread), "a bigint, b bigint").distinct(), "links")
        links = found if links is None else links.union(found)
        if cells:
            members = materialize(narrow.join(dense.select("cell"), "cell", "left_semi"), "members")
            links = links.union(materialize(_dense_links(members, pairs, classes, cosine), "links"))
    united = components(links)
    tasks = block_tasks(united, "component", "node", classes, "id", BLOCK_ROWS, partitions_for(spark, 0, 1) * 2)
    counted = tasks.select("task", "side", "id", "unit", "copies").mapInArrow(_counts(cosine), "id bigint, links bigint").groupBy("id").agg(F.sum("links").alias("links"))
    # a class goes by its least row; a component is named by the least id in it
    named = classes.select("id", "name", "unit", "copies").join(counted.withColumnRenamed("id", "k_id"), F.col("id") == F.col("k_id"), "left").join(united, F.col("id") == F.col("node"), "left")
    named = materialize(named.select("name", "component", F.col("unit").alias("n_unit"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    least = named.where("component is not null").groupBy("component").agg(F.min("name").alias("least")).withColumnRenamed("component", "l_component")
    named = named.join(least, F.col("component") == F.col("l_component"), "left").select("n_unit", "n_links", F.coalesce("least", "name").alias("component_id"))
    linked = units.join(named, F.col("unit") == F.col("n_unit")).select("id", "n_links", "component_id")
    apart = table.where(~can_link(id_col, vector_col)).select(F.col(id_col).cast("bigint").alias("id"), F.lit(0).alias("n_links"), F.col(id_col).cast("bigint").alias("component_id"))
    out = linked.union(apart)
    return out.select(F.col("id").cast(table.schema[id_col].dataType).alias(id_col), F.col("n_links").cast("bigint").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


#: DuckDB SQL for the rows of op8.
OP8_SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS unit FROM embeddings
  WHERE len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.unit, b.unit) >= 0.9),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, e.b FROM reach AS r JOIN e ON r.other = e.a)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) AS c LEFT JOIN (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a) AS n USING (vec_id)
"""
