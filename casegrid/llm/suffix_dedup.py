"""Suffix-array dedup of repeated byte strings.

The suffixes of all texts are sorted by their first ``length`` bytes: equal
neighbours are repeats. To keep the suffix array sparse, every window of
``length`` bytes is represented by its least-hashed ``anchor``-byte string (its
minimiser), so windows that are equal have equal anchors, and a run of windows
with one anchor is a segment of text. Three steps:

1. Anchors are counted in blocks by hash. Segments that are equal as a whole
   settle all their windows at once: all but the least document's are repeats.
   What stays open are the distinct segments of anchors that differ (about two
   for each place where a repeated passage begins or ends).
2. Open segments are range-partitioned by sampled splitters on the leading
   bytes of their anchor; each bucket expands its segments to suffixes, sorts
   them by multikey refinement (eight bytes at a time, within ties only) and
   compares neighbours; a run of equal leading bytes that crosses a batch
   boundary is held until it is complete.
3. The repeated windows go back to their documents, whose bytes are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from casegrid.llm.packed import blob, bucket_of, by_key, mixed, risen, rising, split_points
from casegrid.llm.text_tables import partitions_for, read_table
from casegrid.workspace import materialize

LENGTH, ANCHOR = 50, 20
BLOCK_CHARS = 12_000_000
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_CHUNK = 1 << 18
REPEAT, OPEN = 1, 2

_ROWS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("data", pa.binary()), ("more", pa.binary())])
_DDL = "part int, kind int, ids binary, counts binary, data binary, more binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def _segments(t: np.ndarray, length: int, anchor: int):
    n, w = len(t), length - anchor + 1
    power, inverse = _tables(_CHUNK + length + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    least = mixed((sums[anchor:] - sums[:-anchor]) * inverse[: n - anchor + 1])
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if w > span:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    first, last = split_points(least)
    whole = mixed((sums[last - 1 + length] - sums[first]) * inverse[first]) ^ mixed((last - first).astype(np.uint64))
    return least[first], whole, first, last


def segments(data: bytes, length: int = LENGTH, anchor: int = ANCHOR):
    """(anchor hash, segment hash, first window, end of windows) of the runs of windows with one anchor.

    Very long texts go in chunks of windows; a run that a chunk's end parts
    becomes two segments, which only moves windows to the open ones.
    """
    t = np.frombuffer(data, np.uint8)
    if len(t) < length:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    parts = []
    for low in range(0, len(t) - length + 1, _CHUNK):
        a, w, f, e = _segments(t[low : low + _CHUNK + length - 1], length, anchor)
        parts.append((a, w, f + low, e + low))
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _anchors(blocks: int, length: int, anchor: int):
    """Texts -> packed anchors by block."""

    def run(batches):
        shift = np.uint64(64 - max(1, (blocks - 1).bit_length()))
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                found = [segments(_encoded(t), length, anchor)[:2] for t in part.column(1).to_pylist()]
                sizes = [len(f[0]) for f in found]
                if not sum(sizes):
                    continue
                owner = np.repeat(np.arange(len(ids)), sizes)
                least, whole = (np.concatenate(x) for x in zip(*found, strict=True))
                at = (least >> shift).astype(np.int64) % blocks
                order = np.argsort(at, kind="stable")
                owner, least, whole, at = owner[order], least[order], whole[order], at[order]
                out = []
                for a, b in zip(*split_points(at), strict=True):
                    s, e = split_points(owner[a:b])
                    # 40 bits of the anchor beside the block's own are enough to bring equal ones together
                    short = blob((least[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)) + blob((least[a:b] >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8))
                    out.append((int(at[a]), 1, rising(ids[owner[a:b][s]]), blob((e - s).astype(np.uint32)), blob(whole[a:b]), short))
                yield _rows(out)

    return run


def _settle(buckets: int):
    """A block's anchors -> for each document, segments that are repeats and segments that stay open, by segment hash."""

    def run(batches):
        for _, table in by_key(batches, "part"):
            ids, least, whole = [], [], []
            for row in table.to_pylist():
                counts = np.frombuffer(row["counts"], np.uint32)
                n = int(counts.sum())
                ids.append(np.repeat(risen(row["ids"]), counts))
                whole.append(np.frombuffer(row["data"], np.uint64))
                least.append(np.frombuffer(row["more"][: 4 * n], np.uint32).astype(np.uint64) | np.frombuffer(row["more"][4 * n :], np.uint8).astype(np.uint64) << np.uint64(32))
            ids, least, whole = np.concatenate(ids), np.concatenate(least), np.concatenate(whole)
            order = np.argsort(least, kind="stable")
            ids, least, whole = ids[order], least[order], whole[order]
            starts, ends = split_points(least)
            spread = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
            several = np.repeat(spread, ends - starts)
            ids, least, whole = ids[several], least[several], whole[several]
            if not len(ids):
                continue
            order = np.lexsort((ids, whole, least))
            ids, least, whole = ids[order], least[order], whole[order]
            starts, ends = split_points(least)
            new = np.concatenate(([True], (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])))
            kind_of = np.cumsum(new) - 1
            smallest = ids[np.flatnonzero(new)][kind_of]
            kinds = np.add.reduceat(new.astype(np.int64), starts)
            mixed_group = np.repeat(kinds > 1, ends - starts)
            status = np.where(ids > smallest, REPEAT, np.where(mixed_group, OPEN, 0)).astype(np.uint8)
            told = status > 0
            ids, whole, status = ids[told], whole[told], status[told]
            to = bucket_of(ids, buckets)
            order = np.lexsort((ids, to))
            ids, whole, status, to = ids[order], whole[order], status[order], to[order]
            out = []
            for a, b in zip(*split_points(to), strict=True):
                s, e = split_points(ids[a:b])
                out.append((int(to[a]), 1, rising(ids[a:b][s]), blob((e - s).astype(np.uint32)), blob(whole[a:b]), blob(status[a:b])))
            if out:
                yield _rows(out)

    return run


def _texts(buckets: int):
    """Texts, compressed, on their way to their documents' buckets."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                to = bucket_of(ids, buckets)
                order = np.argsort(to, kind="stable")
                texts = part.column(1).to_pylist()
                out = []
                for a, b in zip(*split_points(to[order]), strict=True):
                    data = [_encoded(texts[i]) for i in order[a:b]]
                    out.append((int(to[order[a]]), 0, rising(ids[order[a:b]]), blob(np.array([len(d) for d in data], np.int64)), pack.compress(b"".join(data)), None))
                yield _rows(out)

    return run


def _bucket(table: pa.Table):
    """A bucket's texts, one packed row at a time, and what came back for its documents, sorted by id."""
    rows = table.to_pylist()
    back = [r for r in rows if r["kind"] == 1]

    def texts():
        unpack = zstandard.ZstdDecompressor()
        for r in rows:
            if r["kind"] == 0:
                sizes, at = np.frombuffer(r["counts"], np.int64), 0
                data = unpack.decompress(r["data"], max_output_size=int(sizes.sum())) if sizes.sum() else b""
                for i, n in zip(risen(r["ids"]).tolist(), sizes.tolist(), strict=True):
                    yield i, data[at : at + n]
                    at += n

    return texts(), back


_OUT = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("mark", pa.binary()), ("first", pa.binary()), ("last", pa.binary()), ("at", pa.int64()), ("lead", pa.binary()), ("segment", pa.binary())])


def _mark(data: bytes) -> bytes:
    """Tells the texts of rows that repeat an id apart."""
    return xxhash.xxh3_64_digest(data)


def _addressed(batches):
    """Windows of documents as packed rows for their buckets."""
    for batch in batches:
        ids = [i.to_bytes(8, "little", signed=True) for i in batch.column(1).to_pylist()]
        kind = pa.array(np.ones(len(ids), np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), kind, pa.array(ids, pa.binary()), batch.column(2), batch.column(3), batch.column(4)], schema=_ROWS)


def _lead(piece: bytes, length: int, anchor: int) -> bytes:
    """The anchor's bytes: the leading tokens by which suffixes are partitioned."""
    t = np.frombuffer(piece, np.uint8)
    power, inverse = _tables(_CHUNK + length + 1)
    sums = np.zeros(len(t) + 1, np.uint64)
    np.cumsum((t.astype(np.uint64) + np.uint64(1)) * power[: len(t)], out=sums[1:])
    h = mixed((sums[anchor:] - sums[:-anchor]) * inverse[: len(t) - anchor + 1])
    k = int(h.argmin())  # wherever it stands first: windows of one run may have it in several places
    return piece[k : k + anchor]


def _reopen(length: int, anchor: int, buckets: int):
    """Bucket of texts and verdicts -> repeated windows of each document, and its open segments."""

    def run(batches):
        for _, table in by_key(batches, "part"):
            texts, back = _bucket(table)
            if not back:
                continue
            ids = np.concatenate([np.repeat(risen(r["ids"]), np.frombuffer(r["counts"], np.uint32)) for r in back])
            whole = np.concatenate([np.frombuffer(r["data"], np.uint64) for r in back])
            status = np.concatenate([np.frombuffer(r["more"], np.uint8) for r in back])
            order = np.lexsort((whole, ids))
            ids, whole, status = ids[order], whole[order], status[order]
            out = []
            for i, data in texts:
                a, b = np.searchsorted(ids, i, "left"), np.searchsorted(ids, i, "right")
                if a == b:
                    continue
                _, own, first, last = segments(data, length, anchor)
                at = np.minimum(np.searchsorted(whole[a:b], own), b - a - 1)
                told = np.where(whole[a:b][at] == own, status[a:b][at], 0)
                part, mark = int(bucket_of(np.array([i]), buckets)[0]), _mark(data)
                if (r := told == REPEAT).any():
                    out.append((part, i, mark, blob(first[r]), blob(last[r]), None, None, None))
                for k in np.flatnonzero(told == OPEN):
                    piece = data[first[k] : last[k] - 1 + length]
                    out.append((part, i, mark, None, None, int(first[k]), _lead(piece, length, anchor), piece))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def suffix_classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Class of each suffix by its first ``length`` bytes: multikey refinement, eight bytes at a time within ties."""
    cls = np.zeros(len(starts), np.int64)
    tied = np.arange(len(starts))
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        words = np.ascontiguousarray(data[starts[tied][:, None] + np.arange(depth, depth + 8)]).view(">u8").reshape(-1)
        order = np.lexsort((words, cls[tied]))
        c, w = cls[tied][order], words[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(new)))
        number = np.cumsum(new) - 1
        fresh = np.empty(len(tied), np.int64)
        fresh[order] = number
        base = int(cls.max()) + 1
        cls[tied] = base + fresh
        alone = np.empty(len(tied), bool)
        alone[order] = size[number] == 1
        tied = tied[~alone]
        if not len(tied):
            break
    return np.unique(cls, return_inverse=True)[1]


def _compare(length: int, buckets: int):
    """Open segments in order of their leading bytes -> windows that a smaller document has too."""
    most = 300_000  # suffixes expanded at once; a run of equal leading bytes is never parted

    def settle(tables):
        table = pa.concat_tables(tables)
        ids, at = table.column("id").to_numpy(), table.column("at").to_numpy()
        pieces = table.column("segment").to_pylist()
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(pieces)), windows)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = (np.cumsum(sizes) - sizes)[owner] + inside
        cls = suffix_classes(data, starts, length)
        least = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, cls, ids[owner])
        hit = least[cls] < ids[owner]
        run = np.flatnonzero(hit)
        if not len(run):
            return None
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(run) != 1) | (owner[run][1:] != owner[run][:-1]))))
        first, last = run[cut], run[np.append(cut[1:], len(run)) - 1]
        o = owner[first]
        begin, end = at[o] + inside[first], at[o] + inside[last] + 1
        arrays = [pa.array(bucket_of(ids[o], buckets)), pa.array(ids[o]), table.column("mark").combine_chunks().take(pa.array(o)), pa.array([blob(x) for x in begin], pa.binary()), pa.array([blob(x) for x in end], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(list(_OUT)[:5]))

    def run(batches):
        held, size = [], 0
        for _, table in by_key(batches, "lead"):
            n = pc.sum(pc.binary_length(table.column("segment"))).as_py() - (length - 1) * table.num_rows
            if held and size + n > most:
                if (out := settle(held)) is not None:
                    yield out
                held, size = [], 0
            held.append(table)
            size += n
        if held and (out := settle(held)) is not None:
            yield out

    return run


def _remove(length: int, with_kept: bool):
    """Bucket of texts and repeated windows -> what is left of each text."""
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept

    def run(batches):
        for _, table in by_key(batches, "part"):
            texts, back = _bucket(table)
            windows: dict[tuple, list] = {}
            for r in back:
                key = int.from_bytes(r["ids"], "little", signed=True), r["counts"]
                windows.setdefault(key, []).append((np.frombuffer(r["data"], np.int64), np.frombuffer(r["more"], np.int64)))
            named = {k[0] for k in windows}
            out = []
            for i, data in texts:
                found = windows.get((i, _mark(data))) if i in named else None
                removed = spans = 0
                kept = data
                if found:
                    change = np.zeros(len(data) + 1, np.int32)
                    for first, last in found:
                        np.add.at(change, first, 1)
                        np.add.at(change, last - 1 + length, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    removed, spans = int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((i, len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
                if len(out) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left).

    A byte goes if a ``length``-byte string that covers it also starts in a
    document with a smaller id; strings are judged on the input. Null texts are
    empty; texts shorter than ``length`` lose nothing. Rows that repeat an id
    don't take from each other. Rows without an id come back with nulls. Columns
    other than the two named are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = max(8, int(chars // BLOCK_CHARS))
    parts = partitions_for(spark, blocks, 2)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    anchors = rows.mapInArrow(_anchors(blocks, length, anchor), _DDL).repartition(parts, "part").sortWithinPartitions("part")
    told = materialize(anchors.mapInArrow(_settle(parts), _DDL), "verdicts")
    texts = rows.mapInArrow(_texts(parts), _DDL)
    ddl = "part int, id bigint, mark binary, first binary, last binary, at bigint, lead binary, segment binary"
    found = materialize(texts.union(told).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_reopen(length, anchor, parts), ddl), "found")
    opened = found.where("segment is not null").repartitionByRange(parts, "lead").sortWithinPartitions("lead")
    more = materialize(opened.select("id", "mark", "at", "lead", "segment").mapInArrow(_compare(length, parts), "part int, id bigint, mark binary, first binary, last binary"), "more")
    windows = found.where("segment is null").select(*more.columns).union(more)
    back = windows.mapInArrow(_addressed, _DDL)
    ddl = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept
    out = texts.union(back).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_remove(length, with_kept), ddl)
    nameless = docs.where(F.col(id_col).isNull()).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema])
    out = out.union(nameless)
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


#: DuckDB SQL for the rows of op10.
OP10_SQL = r"""
WITH b AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, substr(h, 400 * k + 1, 498) AS piece FROM (SELECT doc_id, h, unnest(range(0, (len(h) // 2 + 199) // 200)) AS k FROM b)),
s AS MATERIALIZED (SELECT doc_id, 200 * k + i AS pos, substr(piece, 2 * i + 1, 100) AS part FROM (SELECT doc_id, k, piece, unnest(range(0, least(200, len(piece) // 2 - 49))) AS i FROM c)),
f AS (SELECT part, min(doc_id) AS first_doc FROM s GROUP BY part),
m AS (SELECT s.doc_id, s.pos, lag(s.pos) OVER (PARTITION BY s.doc_id ORDER BY s.pos) AS before FROM s JOIN f USING (part) WHERE s.doc_id > f.first_doc),
r AS (SELECT doc_id, pos, sum(CASE WHEN pos <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m),
g AS (SELECT doc_id, min(pos) AS first, max(pos) + 50 AS last FROM r GROUP BY doc_id, run),
k AS (SELECT g.doc_id, first, last, substr(h, 2 * lag(last, 1, 0) OVER w + 1, 2 * (first - lag(last, 1, 0) OVER w)) AS held FROM g JOIN b USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY first)),
t AS (SELECT doc_id, sum(last - first) AS n_removed, count(*) AS n_spans, max(last) AS last, string_agg(held, '' ORDER BY first) AS held FROM k GROUP BY doc_id)
SELECT b.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(held, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN t USING (doc_id)
"""
