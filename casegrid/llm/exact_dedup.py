"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition turns its rows into a run: keys in ascending order, equal
ones merged. Runs then meet in rounds: in every round the run with number r
moves to the run with number r // fan_in (for ``fan_in`` 2 the binomial tree),
where the sorted pieces that have arrived are merged. At every level equal
keys are compared in full (SHA-256, length and a second hash of the normalised
text) and only the row with the longest original, then the smallest id, is
retained with the number of rows that it stands for.

Runs travel in pieces: a run is cut by digest range into as many pieces as its
length asks for, so pieces keep their size while runs grow, and no task holds
a whole run. A key occurs once in each run, so a group of a third of all rows
reaches a merge as one row a run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegrid.llm.packed import blob, by_key, split_points
from casegrid.llm.text_tables import SPACES, partitions_for, read_table, sent_if_small, text_or_empty
from casegrid.workspace import discard, materialize

KEY = ["digest", "norm_len", "check"]
#: A row's own key, where rows that share an id are told apart.
ROW = "__exact_row"
#: Rows of a piece, about, and of a block that is sorted at once.
PIECE_ROWS, BLOCK_ROWS = 200_000, 500_000


def digests(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per document: id, full key of the normalised text, length of the original, and the columns ``carry``."""
    text = text_or_empty(text_col)
    norm = F.translate(text, SPACES, "")
    return docs.select(F.col(id_col).alias("id"), *carry, F.length(text).cast("bigint").alias("chars"), norm.alias("norm")).select(
        "id", *carry, "chars", F.unhex(F.sha2("norm", 256)).alias("digest"), F.length("norm").cast("bigint").alias("norm_len"), F.xxhash64("norm").alias("check")
    )


_PIECES = pa.schema([("key", pa.int64()), ("digest", pa.binary()), ("numbers", pa.binary()), ("nameless", pa.binary())])
_DDL = "key bigint, digest binary, numbers binary, nameless binary"


def merge_runs(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge sorted pieces of runs; of equal keys the best row stays, with the sum of the counts.

    A piece is the digests (four 64-bit words each), rows of numbers
    (norm_len, check, chars, id, row, n) and whether the id is null.
    """
    digest, numbers, nameless = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces], axis=1), np.concatenate([p[2] for p in pieces])
    order = np.argsort(digest[:, 0], kind="stable")  # merges the runs that are sorted already
    full = np.column_stack((digest, numbers[:2].T.view(np.uint64)))
    differ = lambda o: (full[o[1:]] != full[o[:-1]]).any(1)
    if (differ(order) & (digest[order[1:], 0] == digest[order[:-1], 0])).any():  # different keys with equal leading words
        order = np.lexsort(full.T[::-1])
    starts = np.flatnonzero(np.concatenate(([True], differ(order)))[: len(order)])
    size = np.diff(np.append(starts, len(order)))
    chars, ids, rows, n = numbers[2:6, order]
    none = nameless[order]
    # the longest original, then a row with an id, then the smallest id, then the first row
    left = np.ones(len(order), bool)
    for value in (-chars, none.astype(np.int64), ids, rows):
        held = np.where(left, value, np.iinfo(np.int64).max)
        left &= value == np.repeat(np.minimum.reduceat(held, starts), size)
    best = np.flatnonzero(left)
    best = best[np.searchsorted(best, starts)]  # rows alike in everything: any one
    out = np.concatenate((numbers[:2, order[best]], np.stack((chars[best], ids[best], rows[best], np.add.reduceat(n, starts)))))
    return digest[order[best]], out, none[best]


def _pieces(run: int, merged, cuts: int):
    """The rows of a run's pieces: one for each of ``cuts`` digest ranges."""
    digest, numbers, nameless = merged
    at = ((digest[:, 0] >> np.uint64(32)) * np.uint64(cuts) >> np.uint64(32)).astype(np.int64)
    rows = [((run << 32) + int(at[a]), digest[a:b].tobytes(), blob(numbers[:, a:b]), blob(nameless[a:b])) for a, b in zip(*split_points(at), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def _cuts(rows: int, runs: int) -> int:
    return max(1, -(-rows // (PIECE_ROWS * runs)))


def _sorted_runs(fan_in: int, cuts: int):
    """A partition's rows -> its run, on its way to the first merge. A long run goes in several sorted blocks."""

    def block(held):
        table = pa.Table.from_batches(held)
        ids = table.column("id").combine_chunks()
        digest = np.frombuffer(b"".join(table.column("digest").to_pylist()), ">u8").reshape(-1, 4).astype(np.uint64)
        columns = [table.column(c).to_numpy() for c in ("norm_len", "check", "chars")] + [ids.fill_null(0).to_numpy(zero_copy_only=False), table.column("row").to_numpy(), np.ones(len(digest), np.int64)]
        return _pieces(int(table.column("run")[0].as_py()) // fan_in, merge_runs([(digest, np.stack(columns), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8))]), cuts)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield block(held)
                held, rows = [], 0
        if held:
            yield block(held)

    return run


def _round(fan_in: int, cuts: int | None):
    """Pieces of several runs -> pieces of the merged run, on their way to the next one; without ``cuts`` the groups of the last run."""
    schema = pa.schema([("digest", pa.binary()), ("norm_len", pa.int64()), ("check", pa.int64()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())])

    def run(batches):
        for key, table in by_key(batches, "key"):
            pieces = []
            for r in table.to_pylist():
                digest = np.frombuffer(r["digest"], np.uint64).reshape(-1, 4)
                pieces.append((digest, np.frombuffer(r["numbers"], np.int64).reshape(6, -1), np.frombuffer(r["nameless"], np.uint8)))
            merged = merge_runs(pieces)
            if cuts is not None:
                yield _pieces((int(key) >> 32) // fan_in, merged, cuts)
                continue
            digest, numbers, nameless = merged
            at = np.flatnonzero(numbers[5] > 1)
            raw = digest[at].astype(">u8").tobytes()
            columns = [pa.array([raw[32 * k : 32 * k + 32] for k in range(len(at))], pa.binary()), pa.array(numbers[0, at]), pa.array(numbers[1, at]), pa.array(numbers[3, at], mask=nameless[at] > 0), pa.array(numbers[4, at]), pa.array(numbers[5, at])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _groups(narrow: DataFrame, fan_in: int) -> DataFrame:
    """The groups of more than one row: w_ columns of the key, keep_id, keep_row (0 if rows have no keys), group_size."""
    spark = narrow.sparkSession
    total, runs = narrow.count(), max(1, narrow.rdd.getNumPartitions())
    parts = partitions_for(spark, total, PIECE_ROWS)
    row = F.col(ROW) if ROW in narrow.columns else F.lit(0).cast("bigint")
    rows = narrow.select(*KEY, F.spark_partition_id().alias("run"), "chars", F.col("id").cast("bigint").alias("id"), row.alias("row"))
    merged, left = rows, runs
    first = True
    while first or left > 1:
        left = -(-left // fan_in)
        cuts = _cuts(total, left)
        merged = merged.mapInArrow(_sorted_runs(fan_in, cuts) if first else _round(fan_in, cuts), _DDL).repartition(parts, "key").sortWithinPartitions("key")
        first = False
    found = merged.mapInArrow(_round(fan_in, None), "digest binary, norm_len bigint, check bigint, keep_id bigint, keep_row bigint, group_size bigint")
    return found.select(*[F.col(k).alias(f"w_{k}") for k in KEY], "keep_id", "keep_row", "group_size")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting `[\\x20\\x09-\\x0D]`; the row
    with the most code points in the original, then the smallest id, stays.
    Null counts as empty, so all null and blank texts form one group. Rows that
    repeat an id count separately and are all marked if their id stays; a null
    id comes after the others. As in the SQL, ``kept`` is null where the id or
    keep_id is; ``drop_exact_duplicates`` decides row by row instead. Texts are
    taken whole, however long. ``id_col`` holds integers. Extra columns are not
    read. An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    narrow = materialize(digests(docs, id_col, text_col), "digests")
    groups = _groups(narrow, fan_in)
    same = [narrow[k] == groups[f"w_{k}"] for k in KEY]
    joined = narrow.join(groups, same, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").cast(id_type).alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("id") == keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that an equal text replaces; columns unchanged.

    Exactly one row of a group stays, whether ids are repeated or null. Null
    texts count as empty; an empty table gives an empty result.
    """
    keyed = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")
    narrow = materialize(digests(keyed, id_col, text_col, (ROW,)), "digests")
    groups = _groups(narrow, 4)
    gone = materialize(narrow.join(groups, [narrow[k] == groups[f"w_{k}"] for k in KEY]).where(F.col(ROW) != F.col("keep_row")).select(F.col(ROW).alias("__gone")), "gone")
    discard(narrow)
    return keyed.join(sent_if_small(gone), F.col(ROW) == F.col("__gone"), "left_anti").drop(ROW)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


#: DuckDB SQL for the rows of op7.
OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept, text_sha256
FROM n
"""
