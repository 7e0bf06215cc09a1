"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity``; only piece lengths
matter to the packing, and there are at most ``capacity`` of them, so the bins
are planned on counts by length: open a bin with the longest length left, find
by a bitset subset-sum over the available counts the fullest feasible
combination for the rest, and remove it as often as the counts allow. Every
pattern uses up at least one length, so there are about as many patterns as
lengths, whatever the number of documents. Pieces are then numbered within
their length, and the number decides bin and place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from casegrid.llm.text_tables import read_table
from casegrid.llm.token_counts import load_encoder
from casegrid.workspace import materialize

#: Pieces of one length are numbered in buckets, so that no task numbers them all.
BUCKET_ROWS = 20_000


def fullest(room: int, lengths: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """(length, how many) of the combination with the greatest sum <= room. ``lengths`` ascend."""
    mask, parts, sums = (1 << (room + 1)) - 1, [], [1]
    for n, c in zip(lengths, counts, strict=True):
        spare, unit = min(c, room // n), 1
        while spare > 0:
            unit = min(unit, spare)
            parts.append((n, unit))
            sums.append((sums[-1] | (sums[-1] << (unit * n))) & mask)
            spare -= unit
            unit *= 2
    at, used = sums[-1].bit_length() - 1, {}
    for k in range(len(parts) - 1, -1, -1):
        if not sums[k] >> at & 1:
            n, unit = parts[k]
            used[n] = used.get(n, 0) + unit
            at -= unit * n
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, per bin, first bin, offset in the bin): which ranks of a length go where."""
    left, ranks, slots, bins = {n: c for n, c in histogram.items() if c}, {}, [], 0
    while left:
        top = max(left)
        spare = left | {top: left[top] - 1}
        open_ = sorted(n for n, c in spare.items() if c and n <= capacity - top)
        inside = dict(fullest(capacity - top, open_, [spare[n] for n in open_])) if open_ else {}
        inside[top] = inside.get(top, 0) + 1
        times, offset = min(left[n] // k for n, k in inside.items()), 0
        for n, k in sorted(inside.items(), reverse=True):
            slots.append((n, ranks.get(n, 0), k, bins, offset))
            ranks[n] = ranks.get(n, 0) + k * times
            offset += n * k
            left[n] -= k * times
            if not left[n]:
                del left[n]
        bins += times
    return slots


def token_pieces(docs: DataFrame, tokenizer: str, eos: int, capacity: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids). The first piece of a long document takes the odd rest."""

    def cut(batches):
        encoder, end = load_encoder(tokenizer), int(eos).to_bytes(4, "little")
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = []
                for i, ids in zip(part.column(0).to_pylist(), encoder.ids_of([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    n, start, k = len(ids) // 4, 0, 0
                    while start < n:
                        size = (n - 1) % capacity + 1 if not k else capacity
                        held = ids[4 * start : 4 * (start + size)]
                        rows.append((i, k, start, size, zlib.crc32(held), np.frombuffer(held, "<u4").astype(np.int32) if with_ids else None))
                        start, k = start + size, k + 1
                if rows:
                    columns = list(zip(*rows, strict=True))
                    arrays = [pa.array(columns[0], part.column(0).type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:5])]
                    yield pa.RecordBatch.from_arrays(arrays + ([pa.array(columns[5], pa.list_(pa.int32()))] if with_ids else []), names)

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(cut, f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, *, eos: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A null text is empty: one piece that holds the end id alone. Rows with the
    same id are packed as separate documents. Columns other than the two named
    are not read. An empty table gives an empty result. Sequences are filled
    without gaps from 0 and hold at most ``capacity`` ids.
    """
    pieces = materialize(token_pieces(docs, tokenizer, eos, capacity, id_col, text_col, with_ids), "pieces")
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(max(1, pieces.count() // BUCKET_ROWS))))
    counts = materialize(bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = plan(histogram, capacity)
    before = counts.select(
        F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket"),
        F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    own = F.row_number().over(W.partitionBy("bucket", "length").orderBy("id", "piece", "ids_crc32")) - 1
    placed = bucketed.withColumn("own", own).join(before, (F.col("bucket") == F.col("b_bucket")) & (F.col("length") == F.col("b_length")))
    ranked = placed.withColumn("rank", F.col("own") + F.col("before"))

    by_length: dict[int, list] = {}
    for n, *slot in slots:
        by_length.setdefault(n, []).append(slot)
    tables = {n: np.array(s, np.int64) for n, s in by_length.items()}

    def place(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                first, each, bin_, offset = tables[int(n)].T
                k = np.searchsorted(first, ranks[at], "right") - 1
                past = ranks[at] - first[k]
                bins[at], offsets[at] = bin_[k] + past // each[k], offset[k] + past % each[k] * n
            kept = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bins), pa.array(offsets)], names)

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["sequence_id", "offset"]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids + ", sequence_id bigint, offset bigint"
    return ranked.select(*names[:-2], "rank").mapInArrow(place, schema).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and its ids in order, from ``pack(..., with_ids=True)``; a sequence is bounded by the capacity."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(held, lambda x: x["ids"])).alias("ids"))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
