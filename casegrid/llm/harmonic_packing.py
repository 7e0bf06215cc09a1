"""Harmonic packing: documents of like length share bins of a fixed document count.

A document of n ids is of class ``capacity // n``, and a bin of class k takes k
of them: they always fit, so a worker fills its bins by counting, without asking
any other worker. What k documents leave open is filled from donors, documents
that are cut: those longer than a sequence, those that no bin of their class was
full enough for, and, if these don't suffice, the documents of the emptiest
bins. What donors have left becomes full sequences, and the rest of less than
one sequence is cut into powers of two, which need no padding.

Each worker packs the documents of its own partition in lots of bounded size:
there is no shuffle, and a lost task runs again with the same result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from casegrid.llm.text_tables import read_table
from casegrid.llm.token_counts import batched, load_encoder

#: A lot ends once it holds so many ids or documents.
LOT_IDS, LOT_DOCS = 4_000_000, 16_384
#: Texts of about so many characters are encoded at once: words that they share are looked up once.
ENCODE_CHARS = 6_000_000


def harmonic_bins(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each document (-1: it donates) and where it starts in its bin. Only bins that hold their class's count are kept."""
    bins, offsets, n_bins = np.full(len(sizes), -1), np.zeros(len(sizes), np.int64), 0
    fits = np.flatnonzero(sizes <= capacity)
    classes = capacity // sizes[fits]
    for k in np.unique(classes):
        members = fits[classes == k]
        whole = members[: len(members) // k * k].reshape(-1, k)
        bins[whole] = n_bins + np.arange(len(whole))[:, None]
        offsets[whole] = np.cumsum(sizes[whole], axis=1) - sizes[whole]
        n_bins += len(whole)
    return bins, offsets


def pack_lot(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """(document, start, length, sequence, offset) of each piece; sequences are numbered from 0 and hold no gaps.

    Every sequence but the last few is full, and those hold a power of two.
    """
    bins, offsets = harmonic_bins(sizes, capacity)
    used = np.bincount(bins[bins >= 0], sizes[bins >= 0]).astype(np.int64)
    slack = capacity - used
    order = np.argsort(slack, kind="stable")  # the fullest first
    given = sizes[bins < 0].sum() + used.sum() - np.cumsum(used[order])
    kept = int(np.searchsorted(np.cumsum(slack[order]) > given, True))  # so many bins can be filled up by what the others hold
    number = np.full(len(used), -1)
    number[order[:kept]] = np.arange(kept)
    bins = np.where(bins >= 0, number[bins] if kept else -1, -1)
    stay, donors = np.flatnonzero(bins >= 0), np.flatnonzero(bins < 0)

    # room for the donors' ids: first what the kept bins leave open, then whole sequences, then powers of two
    spare = slack[order[:kept]]
    left = int(sizes[donors].sum() - spare.sum())
    tail = [1 << b for b in range(left % capacity).__reversed__() if left % capacity >> b & 1] if left % capacity else []
    room = np.concatenate([spare, np.full(left // capacity, capacity), np.array(tail, np.int64)]).astype(np.int64)
    begins = np.concatenate([capacity - spare, np.zeros(len(room) - kept, np.int64)])
    ends, room_ends = np.cumsum(sizes[donors]), np.cumsum(room)
    cuts = np.union1d(ends, room_ends[room > 0])
    first = np.concatenate(([0], cuts[:-1])).astype(np.int64) if len(cuts) else np.empty(0, np.int64)
    length = np.asarray(cuts, np.int64) - first
    whose, where = np.searchsorted(ends, first, "right"), np.searchsorted(room_ends, first, "right")
    start = first - (ends - sizes[donors])[whose]
    offset = begins[where] + first - (room_ends - room)[where]
    pieces = (np.concatenate([stay, donors[whose]]), np.concatenate([np.zeros(len(stay), np.int64), start]), np.concatenate([sizes[stay], length]), np.concatenate([bins[stay], where]), np.concatenate([offsets[stay], offset]))
    by = np.lexsort((pieces[1], pieces[0]))
    return tuple(p[by] for p in pieces)


def pack_harmonic(docs: DataFrame, tokenizer: str, *, eos: int = 0, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null or empty text holds the end id alone. Rows with equal or null ids are
    packed as documents of their own; other columns are not read, so their names
    don't matter. Very long texts are encoded whole and cut into as many pieces
    as they need. An empty table gives an empty result. Each id of a document
    lies in one piece, sequences are filled without gaps from 0, and all hold
    ``capacity`` ids or a power of two.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def packed(batches):
        encoder, end = load_encoder(tokenizer), int(eos).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 36

        def close(keys: list, held: list[bytes]):
            nonlocal sequence
            sizes = np.array([len(h) // 4 for h in held], np.int64)
            doc, start, length, bin_, offset = pack_lot(sizes, capacity)
            parts = [held[d][4 * a : 4 * (a + n)] for d, a, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            columns = [pa.concat_arrays(keys).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(sizes[doc]), pa.array(bin_ + sequence), pa.array(offset)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int32) for p in parts], pa.list_(pa.int32())))
            sequence += int(bin_.max()) + 1
            whole = pa.RecordBatch.from_arrays(columns, names)
            yield from (whole.slice(low, 8192) for low in range(0, whole.num_rows, 8192))

        keys, held, total = [], [], 0
        for batch in batches:
            texts = ((i, t.as_py() or "") for i, t in enumerate(batch.column(1)))
            for group in batched(((i, t, len(t)) for i, t in texts), ENCODE_CHARS):
                keys.append(batch.column(0).slice(group[0][0], len(group)))
                for ids in encoder.ids_of([t for _, t, _ in group]):
                    held.append(ids + end)
                    total += len(ids) // 4 + 1
                if total >= LOT_IDS or len(held) >= LOT_DOCS:
                    yield from close(keys, held)
                    keys, held, total = [], [], 0
        if held:
            yield from close(keys, held)

    schema = f"`{id_col}` {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(packed, schema)


def op13_harmonic_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_harmonic(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
