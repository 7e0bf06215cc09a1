"""WIN4: consecutive chunks of a case in batches of bounded size, however many chunks a case has.

Where a batch that begins at a chunk ends is found for all chunks of a segment
at once, by binary search in the prefix sums of their sizes. Pointer doubling
over these ends tells, for each of the few places where a segment's first new
batch can begin, how many batches begin in it and what its last one holds. Only
these summaries of a case come together, in order; they say where each segment
really begins, and each segment then numbers its own chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from casegrid.functions import patterns as P
from casegrid.workspace import materialize

SEGMENT_ROWS = 20_000


def batch_ends(sizes: np.ndarray, most: int, most_rows: int | None) -> np.ndarray:
    """For each row the first one after a batch that begins with it; a too large row is a batch of its own."""
    total, every = np.concatenate(([0], np.cumsum(sizes))), np.arange(len(sizes))
    ends = np.searchsorted(total, total[:-1] + most, "right") - 1
    if most_rows is not None:
        ends = np.minimum(ends, every + most_rows)
    return np.clip(ends, every + 1, len(sizes))


def jumps(ends: np.ndarray) -> list[np.ndarray]:
    """Where 1, 2, 4, ... batches lead; the last row's successor leads to itself."""
    out = [np.append(ends, len(ends))]
    while (out[-1][:-1] < len(ends)).any():
        out.append(out[-1][out[-1]])
    return out


def summary(sizes: np.ndarray, entries: int, most: int, most_rows: int | None) -> np.ndarray:
    """For each entry row: batches that begin from it on, and the size and rows of the last one."""
    n, at = len(sizes), np.arange(min(entries, len(sizes)))
    count = np.ones(len(at), np.int64)
    for k, jump in reversed(list(enumerate(jumps(batch_ends(sizes, most, most_rows))))):
        inside = jump[at] < n
        at, count = np.where(inside, jump[at], at), count + (inside << k)
    total = np.concatenate(([0], np.cumsum(sizes)))
    return np.stack([count, total[-1] - total[at], n - at])


def starts_from(sizes: np.ndarray, entry: int, most: int, most_rows: int | None) -> np.ndarray:
    """The rows that begin a batch, from the first one on."""
    found = np.array([entry]) if entry < len(sizes) else np.empty(0, np.int64)
    for jump in jumps(batch_ends(sizes, most, most_rows)) if len(found) else []:
        found = np.unique(np.concatenate((found, jump[found])))
        found = found[found < len(sizes)]
    return found


def _segments(entries: int, most: int, most_rows: int | None, rows: int, names: list[str]):
    """Sorted rows to segments of one case: ids, sizes, and the summary."""

    def run(batches):
        part, no, case, ids, sizes = TaskContext.get().partitionId(), 0, None, [], []

        def close():
            nonlocal no, ids, sizes
            held = np.array(sizes, np.int64)
            row = [[case], [part], [no], [ids], [held.tobytes()], [held[:entries].tobytes()], [summary(held, entries, most, most_rows).tobytes()], [len(held)], [int(held.sum())]]
            no, ids, sizes = no + 1, [], []
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names)

        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            for run_id, chunk, size in zip(*(batch.column(c).to_pylist() for c in ("run_id", "chunk_id", "size")), strict=True):
                if ids and (run_id != case or len(ids) >= rows):
                    yield close()
                case = run_id
                ids.append(chunk)
                sizes.append(size)
        if ids:
            yield close()

    return run


def _compose(most: int, most_rows: int | None, names: list[str]):
    """Summaries in order to each segment's first row that begins a batch, and the batches of the case that begin before it."""

    def run(batches):
        case, chars, rows, begun = (), 0, 0, 0
        for batch in batches:
            out = []
            for r in (row for low in range(0, batch.num_rows, 256) for row in batch.slice(low, 256).to_pylist()):
                head, exits = np.frombuffer(r["head"], np.int64), np.frombuffer(r["exits"], np.int64).reshape(3, -1)
                if (r["run_id"],) != case:
                    case, chars, rows, begun, entry = (r["run_id"],), 0, 0, 0, 0
                else:
                    full = chars + np.cumsum(head) > most
                    if most_rows is not None:
                        full |= rows + np.arange(len(head)) >= most_rows
                    entry = int(full.argmax()) if full.any() else r["n"]
                out.append((r["run_id"], r["part"], r["segment"], entry, begun))
                if entry < r["n"]:
                    begun, chars, rows = begun + int(exits[0, entry]), int(exits[1, entry]), int(exits[2, entry])
                else:  # the whole segment goes on with the batch before
                    chars, rows = chars + r["chars"], rows + r["n"]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    return run


def _assign(most: int, most_rows: int | None):
    def run(batches):
        # a batch may hold thousands of segments: one is read at a time, and its ids stay Arrow's
        for batch in batches:
            for i in range(batch.num_rows):
                run_id, sizes, entry, begun = (batch.column(c)[i].as_py() for c in ("run_id", "sizes", "entry", "begun"))
                sizes, ids = np.frombuffer(sizes, np.int64), batch.column("ids")[i].values
                begins = np.zeros(len(sizes), np.int64)
                begins[starts_from(sizes, entry, most, most_rows)] = 1
                number = begun - 1 + np.cumsum(begins)
                yield pa.RecordBatch.from_arrays([pa.array([run_id] * len(sizes), pa.string()), ids, pa.array(number, pa.int32())], ["run_id", "chunk_id", "batch_no"])

    return run


def greedy_batches(chunks: DataFrame, order: tuple[str, ...], most_chars: int = P.BATCH_CHARS, most_chunks: int | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """WIN4: (run_id, chunk_id, batch_no): each batch takes the next chunks of a case in ``order`` while they fit; an oversized one stands alone.

    A case of any size is spread over range partitions. A null text counts as empty.
    """
    if most_chars <= 0 or most_chunks is not None and most_chunks <= 0:
        raise ValueError("a batch needs room for a chunk")
    # every chunk counts BATCH_OVERHEAD at least, so a batch ends within so many rows
    entries = min(most_chars // P.BATCH_OVERHEAD + 1, most_chunks or 1 << 30)
    size = (F.length(F.coalesce("text", F.lit(""))) + P.BATCH_OVERHEAD).cast("bigint").alias("size")
    rows = chunks.select(F.col("run_id").cast("string"), *[c for c in order if c not in ("run_id", "chunk_id")], "chunk_id", size)
    keys = ["run_id", *order]
    partitions = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).select("run_id", "chunk_id", "size")
    names = ["run_id", "part", "segment", "ids", "sizes", "head", "exits", "n", "chars"]
    packed = materialize(dealt.mapInArrow(_segments(entries, most_chars, most_chunks, segment_rows, names), "run_id string, part bigint, segment bigint, ids array<string>, sizes binary, head binary, exits binary, n bigint, chars bigint"), "segments")
    in_order = packed.drop("ids", "sizes").repartition("run_id").sortWithinPartitions("run_id", "part", "segment")
    places = in_order.mapInArrow(_compose(most_chars, most_chunks, ["run", "p", "s", "entry", "begun"]), "run string, p bigint, s bigint, entry bigint, begun bigint")
    joined = packed.join(places, (F.col("part") == F.col("p")) & (F.col("segment") == F.col("s")))  # a segment of a part is of one case
    return joined.select("run_id", "ids", "sizes", "entry", "begun").mapInArrow(_assign(most_chars, most_chunks), "run_id string, chunk_id string, batch_no int")
