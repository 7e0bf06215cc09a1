"""N-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are documents, columns are hashed word n-grams. A document
of n n-grams links to none if more than n - ceil(t*n) of them are in no other
document. So the first blocks of columns only tell the documents how many of
their n-grams no other one has, and those with too many drop out; what is in the
other blocks could only drop more. Documents with equal n-gram sets are one row.

The rest goes in blocks of columns again, with all n-grams: each block counts in
how many documents they occur and sends every document those that another
document has too. With all its n-grams ordered from rare to common, a document
can only reach the threshold with another one if they share one of its first
n - ceil(t*n) + 1 (a size-derived bound); documents whose own n-grams alone
fill that prefix drop out as well.

What links the rest is found in two products. First, each column's least row is
multiplied with blocks of the rows that share the column; that unites most of
a group of near copies at a cost in proportion to its rows. Then only rows that
share a column and are not united yet are multiplied: those of a short column
pair by pair, those of long ones block by block. Overlaps are summed up over
the columns, and pairs are discarded below the bounds for their sizes, for the
places of the shared column and for a parity bitmap before, and below the
threshold after.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from casegrid.components import components
from casegrid.llm.packed import blob, bucket_of, by_key, forest, mixed, risen, rising, short, split_points, unshort, whole_groups
from casegrid.llm.pair_blocks import block_tasks, overlaps
from casegrid.llm.text_tables import partitions_for, read_table, sent_if_small
from casegrid.llm.words import text_words
from casegrid.workspace import discard, materialize

#: Characters of text that one block of columns stands for, on average.
BLOCK_CHARS = 8_000_000
#: Bytes of text whose n-grams are held at once, if a single text isn't longer.
SLICE = 4_000_000
#: Blocks that tell documents of n-grams of their own: this many times the share of a document's n-grams that a link leaves open.
SIEVE = 3
#: Bits, as a power of 2, of the map of the documents that are left; two documents may share a bit, which only keeps one that could go.
MAP_BITS = 27
#: What is left of a column of at most FEW rows goes pair by pair; rows of longer ones in blocks of BLOCK_ROWS.
FEW, BLOCK_ROWS = 16, 2048
#: N-grams of the rows that one row is multiplied with in one task.
CHUNK = 1_000_000
#: 64-bit words of a parity bitmap; it says nothing about sets much larger than its bits.
PARITY = 8
_FOLD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit hash of every distinct k-word sequence, by text and hash; a shorter text is one sequence."""
    owner, w = text_words(texts)
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    sizes = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    whole = max(0, len(w) - k + 1)
    h = w[:whole].copy()
    for j in range(1, k):
        h = mixed(h * _FOLD + w[j : j + whole])
    inside = owner[:whole] == owner[len(w) - whole :]
    full = np.repeat(n >= k, sizes)
    out = np.empty(int(sizes.sum()), np.uint64)
    out[full] = mixed(h[inside] + np.uint64(k))
    of = np.repeat(np.arange(len(texts)), sizes)
    for m in range(1, k):
        texts_m = np.flatnonzero(n == m)
        x = w[first[texts_m]]
        for j in range(1, m):
            x = mixed(x * _FOLD + w[first[texts_m] + j])
        out[np.searchsorted(of, texts_m)] = mixed(x + np.uint64(m))
    at = np.cumsum(sizes)
    for a, b in zip((at - sizes).tolist(), at.tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return of[new], out[new]


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent/100 * n): what a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


_ROWS = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("data", pa.binary()), ("more", pa.binary())])
_DDL = "part int, kind int, ids binary, counts binary, data binary, more binary"


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


def _text_slices(batches, left=None):
    """(row, id, key, lower-cased text) in lists of about SLICE bytes, of texts whose key is in the map ``left``; ``key`` is a hash of id and text."""
    held, size = [], 0
    bits, seen = left.value if left else (0, b"")
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            for row, i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                text = (text or b"").lower()
                key = xxhash.xxh3_64_intdigest(text, i & 0xFFFFFFFFFFFFFFFF)
                at = key >> 64 - bits
                if left and not seen[at >> 3] & 128 >> (at & 7):
                    continue
                held.append((row, i, key, text))
                size += len(text)
                if size >= SLICE or len(held) >= 4096:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _digests(owner: np.ndarray, every: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 128-bit digest of each text's set."""
    sizes = np.bincount(owner, minlength=texts)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    marks = np.zeros((texts, 2), np.uint64)
    for c, salt in enumerate((_FOLD, _OTHER)):
        if len(every):
            marks[sizes > 0, c] = np.add.reduceat(mixed(every ^ salt), starts)
    return sizes, marks


def _by_block(owner: np.ndarray, every: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, n-grams and their blocks of columns, sorted by block and text."""
    at = ((every >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.uint16 if blocks < 1 << 16 else np.int64)
    order = np.argsort(at, kind="stable")
    return owner[order], every[order], at[order]


_HEAD = np.dtype([("id", "<i8"), ("n", "<u4"), ("mark", "<u8", 2), ("key", "<u8")])
_TOLD = pa.schema([("part", pa.int32()), ("slice", pa.int64()), ("owners", pa.binary()), ("data", pa.binary())])
_TOLD_DDL = "part int, slice bigint, owners binary, data binary"


def _told_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TOLD, strict=True)], schema=_TOLD)


def near(places: np.ndarray) -> bytes:
    """Rising places in a slice as differences, their lower bytes before their upper ones, which are nearly all zero."""
    return np.diff(places.astype(np.uint16), prepend=np.uint16(0)).view(np.uint8).reshape(-1, 2).T.tobytes()


def places(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view(np.uint16).reshape(-1), dtype=np.int64)


def _first_columns(k: int, blocks: int, asked: int, heads: int):
    """Text rows -> a slice's n-grams in the first ``asked`` of the blocks of columns, four bytes each, and its heads."""

    def run(batches):
        for part in _text_slices(batches):
            owner, every = shingle_sets([t for *_, t in part], k)
            head = np.zeros(len(part), _HEAD)
            head["id"], head["key"] = [i for _, i, *_ in part], np.array([x for _, _, x, _ in part], np.uint64)
            head["n"], head["mark"] = _digests(owner, every, len(part))
            row = part[0][0]
            out = [(int(asked + (row & 0x7FFFFFFF) % heads), row, None, blob(head))]
            owner, every, at = _by_block(owner, every, blocks)
            for a, b in zip(*split_points(at[: np.searchsorted(at, asked)]), strict=True):
                out.append((int(at[a]), row, near(owner[a:b]), blob(every[a:b].astype(np.uint32))))
            yield _told_rows(out)

    return run


def _alone(batches):
    """A block's n-grams -> to each slice, the places of texts for each n-gram that no other text has. Equal hashes of different n-grams only hide some."""
    for _, table in by_key(batches, "part"):
        rows = table.to_pylist()
        if heads := [tuple(r.values()) for r in rows if r["owners"] is None]:
            yield _told_rows(heads)
        rows = [r for r in rows if r["owners"] is not None]
        if not rows:
            continue
        hashes = np.concatenate([np.frombuffer(r["data"], np.uint32) for r in rows])
        order = np.argsort(hashes)
        starts, ends = split_points(hashes[order])
        alone = np.zeros(len(hashes), bool)
        alone[order[starts[ends - starts == 1]]] = True
        at, out = 0, []
        for r in rows:
            owners = places(r["owners"])
            owners, at = owners[alone[at : at + len(owners)]], at + len(owners)
            if len(owners):
                out.append((r["part"], r["slice"], near(owners), None))
        if out:
            yield _told_rows(out)


def _left(percent: int):
    """A slice's heads and what it was told -> (id, n, mark, key, may): whether a text may still link."""

    def run(batches):
        for _, table in by_key(batches, "slice"):
            rows = table.to_pylist()
            head = np.frombuffer(next(r["data"] for r in rows if r["owners"] is None), _HEAD)
            alone = np.zeros(len(head), np.int64)
            for r in rows:
                if r["owners"] is not None:
                    alone += np.bincount(places(r["owners"]), minlength=len(head))
            n = head["n"].astype(np.int64)
            columns = [pa.array(head["id"]), pa.array(n), pa.array([bytes(m) if k else None for m, k in zip(head["mark"], n, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(head["key"].astype(np.int64)), pa.array(can_link(n, alone, percent))], ["id", "n", "mark", "key", "may"])

    return run


def can_link(n: np.ndarray, alone: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set of n, of which ``alone`` are known to be in no other set, may reach the threshold with a set that isn't equal."""
    return (n > 0) & (alone <= n - least_overlap(n, percent)) & (percent * (n + 1) <= 100 * n)


def _columns(k: int, blocks: int, heads: int, left):
    """Text rows in the map ``left`` -> packed rows by block of columns, and a head row for each document."""

    def run(batches):
        for part in _text_slices(batches, left):
            keys, ids = np.array([r for r, *_ in part], np.int64), np.array([i for _, i, *_ in part], np.int64)
            owner, every = shingle_sets([t for *_, t in part], k)
            sizes, marks = _digests(owner, every, len(keys))
            out = [(int(blocks + (keys[0] & 0x7FFFFFFF) % heads), 0, rising(keys), blob(sizes), blob(marks), rising(ids))]
            owner, every, at = _by_block(owner, every, blocks)
            for a, b in zip(*split_points(at), strict=True):
                s, e = split_points(owner[a:b])
                out.append((int(at[a]), 1, rising(keys[owner[a:b][s]]), blob((e - s).astype(np.uint32)), short(every[a:b]), None))
            yield _packed_rows(out)

    return run


def _shared(buckets: int):
    """Packed rows of a block of columns -> n-grams that several documents have, back to the documents' buckets."""

    def grouped(ids):
        """An order by bucket and id, with the bucket of each place."""
        order = np.argsort(ids)
        to = bucket_of(ids[order], buckets)
        again = np.argsort(to.astype(np.uint16) if buckets < 1 << 16 else to, kind="stable")
        return order[again], to[again]

    def run(batches):
        for _, table in by_key(batches, "part"):
            ids, hashes = [], []
            for row in table.to_pylist():
                if row["kind"] == 0:
                    own, named = risen(row["ids"]), risen(row["more"])
                    sizes, marks = np.frombuffer(row["counts"], np.int64), np.frombuffer(row["data"], "V16")
                    order, to = grouped(own)
                    yield _packed_rows([(int(to[a]), 0, rising(own[order[a:b]]), blob(sizes[order[a:b]]), blob(marks[order[a:b]]), rising(named[order[a:b]])) for a, b in zip(*split_points(to), strict=True)])
                else:
                    ids.append(np.repeat(risen(row["ids"]), np.frombuffer(row["counts"], np.uint32)))
                    hashes.append(unshort(row["data"]))
            if not ids:
                continue
            ids, hashes = np.concatenate(ids), np.concatenate(hashes)
            order = np.argsort(hashes)
            ids, hashes = ids[order], hashes[order]
            del order
            starts, ends = split_points(hashes)
            df = np.repeat(ends - starts, ends - starts)
            many = df > 1
            ids, hashes, df = ids[many], hashes[many], np.minimum(df[many], 65535).astype(np.uint16)
            order, to = grouped(ids)
            ids, hashes, df = ids[order], hashes[order], df[order]
            for a, b in zip(*split_points(to), strict=True):
                s, e = split_points(ids[a:b])
                yield _packed_rows([(int(to[a]), 1, rising(ids[a:b][s]), blob((e - s).astype(np.uint32)), short(hashes[a:b]), blob(df[a:b]))])

    return run


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap for each set in which every element flips one bit: elements in which two sets differ flip at most one bit each."""
    out = np.zeros((len(sets), PARITY * 64), np.uint8)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    bit = (mixed(np.concatenate(sets)) % np.uint64(PARITY * 64)).astype(np.int64)
    flips = np.bincount(owner * (PARITY * 64) + bit, minlength=out.size)
    return np.packbits((flips & 1).astype(np.uint8).reshape(out.shape), axis=1).view(np.uint64)


_SETS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("alone", pa.int64()), ("prefix", pa.list_(pa.int64())), ("parity", pa.binary()), ("grams", pa.binary())])


def _prefixes(percent: int):
    """A bucket's heads and shared n-grams -> a row for each document, with its prefix and shared n-grams if it can link."""

    def run(batches):
        for _, table in by_key(batches, "part"):
            heads, ids, hashes, df = [], [], [], []
            for row in table.to_pylist():
                if row["kind"] == 0:
                    heads.append((risen(row["ids"]), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["data"], "V16"), risen(row["more"])))
                else:
                    ids.append(np.repeat(risen(row["ids"]), np.frombuffer(row["counts"], np.uint32)))
                    hashes.append(unshort(row["data"]))
                    df.append(np.frombuffer(row["more"], np.uint16))
            own, sizes, marks, named = (np.concatenate(x) for x in zip(*heads, strict=True))
            del heads, table
            if ids:
                ids, hashes, df = np.concatenate(ids), np.concatenate(hashes), np.concatenate(df)
                order = np.argsort(ids)
                ids, hashes, df = ids[order], hashes[order], df[order]
                first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
            else:
                first = last = np.zeros(len(own), np.int64)
            length = sizes - least_overlap(sizes, percent) + 1
            alone = sizes - (last - first)
            can = can_link(sizes, alone, percent)
            for low in range(0, len(own), 256):
                part = range(low, min(low + 256, len(own)))
                held, prefix = {}, {}
                for i in part:
                    if can[i]:
                        h = hashes[first[i] : last[i]]
                        prefix[i] = h[np.lexsort((h, df[first[i] : last[i]]))][: length[i] - alone[i]].view(np.int64)
                        held[i] = np.sort(h)
                bits = dict(zip(held, parity(list(held.values())), strict=True)) if held else {}
                columns = [own[part.start : part.stop], named[part.start : part.stop], sizes[part.start : part.stop], [bytes(marks[i]) if sizes[i] else None for i in part], alone[part.start : part.stop]]
                columns += [[prefix.get(i) for i in part], [blob(bits[i]) if i in bits else None for i in part], [blob(held[i]) if i in held else None for i in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SETS, strict=True)], schema=_SETS)

    return run


def pairs_of_runs(starts: np.ndarray, ends: np.ndarray, most: int = 2_000_000):
    """Positions (i, j), i < j < ends[i], of all pairs that ``starts``..``ends`` name; ``ends`` is given for each position. In pieces."""
    count = ends - starts - 1
    total = np.cumsum(count)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right")))
        c = count[low:high]
        i = np.repeat(starts[low:high], c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + i + 1
        if len(i):
            yield i, j
        low = high


def reachable(n: np.ndarray, group: np.ndarray, percent: int) -> np.ndarray:
    """For rows sorted by (group, n): the end of the rows behind each one whose size can reach the threshold with it."""
    _, ends = split_points(group)
    end = np.repeat(ends, np.diff(np.concatenate(([0], ends)))) if len(ends) else np.empty(0, np.int64)
    wide = np.int64(int(n.max(initial=0)) + 2)
    rank = np.cumsum(np.concatenate(([0], group[1:] != group[:-1]))) * wide
    return np.minimum(end, np.searchsorted(rank + n, rank + np.minimum(100 * n // percent, wide - 1), "right"))


def may_link(n_a, n_b, pos_a, pos_b, bits_a, bits_b, percent: int) -> np.ndarray:
    """Positional and bitmap filter on pairs that share the element at these places."""
    need = -(-percent * (n_a + n_b) // (100 + percent))
    ok = np.minimum(pos_a, pos_b) + np.minimum(n_a - pos_a, n_b - pos_b) >= need
    ok[ok] = np.bitwise_count(bits_a(ok) ^ bits_b(ok)).sum(1) <= (n_a + n_b - 2 * need)[ok]
    return ok


_PAIRS = "a bigint, b bigint, n bigint"


def _pairs(percent: int):
    """Rows sorted by (task, n) -> pairs of one task that may link, of different components."""

    def found(table):
        task, node, n, pos, comp = (table.column(c).to_numpy() for c in ("task", "node", "n", "pos", "comp"))
        bits = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(len(node), -1)
        ends = reachable(n, task, percent)
        left, right = [], []
        for i, j in pairs_of_runs(np.arange(len(node)), ends):
            ok = comp[i] != comp[j]
            i, j = i[ok], j[ok]
            ok = may_link(n[i], n[j], pos[i], pos[j], lambda k, i=i: bits[i[k]], lambda k, j=j: bits[j[k]], percent)
            left.append(i[ok])
            right.append(j[ok])
        if not left:
            return None
        i, j = np.concatenate(left), np.concatenate(right)
        swap = node[i] > node[j]
        a, b = np.where(swap, node[j], node[i]), np.where(swap, node[i], node[j])
        once = np.unique(np.stack([a, b, np.where(swap, n[i], n[j])], axis=1), axis=0) if len(a) else np.empty((0, 3), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(once[:, c]) for c in range(3)], ["a", "b", "n"])

    def run(batches):
        for table in whole_groups(batches, "task", 50_000):
            if (out := found(table)) is not None:
                yield out

    return run


def products(one: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of a row with a block of rows, summed up over the row's columns. All sets are sorted."""
    every = np.concatenate(rows)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    hit = np.concatenate(([0], np.cumsum(one[at] == every)))
    ends = np.cumsum([len(r) for r in rows])
    return hit[ends] - hit[np.concatenate(([0], ends[:-1]))]


def _verified(percent: int):
    """Rows sorted by (task, side), a task's single row first -> links of that row with the others."""

    def run(batches):
        now, ones, block, size = None, [], [], 0

        def flush():
            out = ([], [])
            if ones and block:
                n = np.array([x[1] for x in block])
                for node, m, one in ones:
                    o = products(one, [x[2] for x in block])
                    for k in np.flatnonzero(100 * o >= percent * (m + n - o)):
                        out[0].append(node)
                        out[1].append(block[k][0])
            return pa.RecordBatch.from_pydict({"a": np.array(out[0], np.int64), "b": np.array(out[1], np.int64)})

        for batch in batches:
            for task, side, node, n, grams in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "node", "n", "grams")), strict=True):
                if task != now or size > CHUNK:
                    yield flush()
                    block, size = [], 0
                    if task != now:
                        now, ones = task, []
                (ones if side == 0 else block).append((node, n, np.frombuffer(grams, np.uint64)))
                size += len(grams) // 8
        yield flush()

    return run


def _links(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of those ``pairs`` (a, b, n of b) that reach the threshold; a row with many partners goes to several tasks."""
    spark = pairs.sparkSession
    pairs = materialize(pairs.groupBy("a", "b").agg(F.max("n").alias("n")), "pairs")
    chunks = pairs.groupBy("a").agg(F.ceil(F.sum("n") / CHUNK).alias("chunks")).where("chunks > 1").select(F.col("a").alias("c_a"), "chunks")
    dealt = pairs.join(chunks, F.col("a") == F.col("c_a"), "left").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.coalesce("chunks", F.lit(1)))).alias("task"))
    items = dealt.select("task", F.lit(0).alias("side"), F.col("a").alias("of")).distinct().union(dealt.select("task", F.lit(1), "b"))
    sent = items.join(rows.select("node", "n", "grams"), F.col("of") == F.col("node")).select("task", "side", "node", "n", "grams")
    return sent.repartition(partitions_for(spark, 0, 1) * 2, "task").sortWithinPartitions("task", "side").mapInArrow(_verified(percent), "a bigint, b bigint").where("a <> b")


def _text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))


def set_heads(docs: DataFrame, chars: int, *, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, mark, key, may) of every document: ``mark`` is a 128-bit digest of the n-gram set, null if empty; without ``may`` it links to none but equal sets."""
    blocks = max(8, chars // BLOCK_CHARS)
    asked = min(blocks, -(-blocks * SIEVE * (100 - percent) // 100))
    partitions = partitions_for(docs.sparkSession, asked, 2)
    sent = _text_rows(docs, id_col, text_col).mapInArrow(_first_columns(words, blocks, asked, partitions), _TOLD_DDL).repartition(partitions, "part").sortWithinPartitions("part")
    told = sent.mapInArrow(_alone, _TOLD_DDL).repartition(partitions, "slice").sortWithinPartitions("slice")
    return materialize(told.mapInArrow(_left(percent), "id bigint, n bigint, mark binary, key bigint, may boolean"), "heads")


def _map_parts(batches):
    """Places sorted by part -> each part's 65,536 bits."""
    for part, table in by_key(batches, "part"):
        bits = np.zeros(1 << 16, bool)
        bits[table.column("at").to_numpy() & 0xFFFF] = True
        yield pa.RecordBatch.from_pylist([{"part": int(part), "seen": blob(np.packbits(bits))}], schema=pa.schema([("part", pa.int32()), ("seen", pa.binary())]))


def key_map(keys: DataFrame) -> tuple[int, bytes]:
    """Power and bits of a map of the column ``key``: about 64 bits for each, 2**MAP_BITS in all at most (16 MB)."""
    bits = min(MAP_BITS, max(16, (64 * keys.count()).bit_length()))
    at = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("at")).withColumn("part", F.shiftright("at", 16).cast("int"))
    parts = at.repartition(partitions_for(keys.sparkSession, 0, 1), "part").sortWithinPartitions("part").mapInArrow(_map_parts, "part int, seen binary")
    seen = bytearray(1 << bits - 3)
    for r in parts.collect():  # 2**(bits - 16) rows of 8 kB
        seen[r["part"] << 13 : r["part"] + 1 << 13] = r["seen"]
    return bits, bytes(seen)


def ngram_sets(docs: DataFrame, left, chars: int, *, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, mark, alone, prefix, parity, grams) of the documents in the map ``left``, which have about ``chars`` characters."""
    blocks = max(8, chars // BLOCK_CHARS)
    partitions = partitions_for(docs.sparkSession, blocks, 2)
    columns = _text_rows(docs, id_col, text_col).mapInArrow(_columns(words, blocks, partitions, left), _DDL).repartition(partitions, "part").sortWithinPartitions("part")
    back = columns.mapInArrow(_shared(blocks), _DDL).repartition(partitions, "part").sortWithinPartitions("part")
    return materialize(back.mapInArrow(_prefixes(percent), "row bigint, id bigint, n bigint, mark binary, alone bigint, prefix array<bigint>, parity binary, grams binary"), "sets")


def _tiles(percent: int):
    """A task's rows -> a forest of the links between those of different components, from the product of its two blocks."""

    def run(batches):
        for _, table in by_key(batches, "task"):
            node, n, side, comp = (table.column(c).to_numpy() for c in ("node", "n", "side", "comp"))
            grams = table.column("grams").to_pylist()
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if not len(left) or not len(right):
                continue
            o = overlaps(*([np.frombuffer(grams[k], np.uint64) for k in at] for at in (left, right)))
            union = (n[left][:, None] + n[right][None, :]).astype(np.float32) - o
            i, j = np.nonzero((100 * o >= percent * union) & (comp[left][:, None] != comp[right][None, :]))
            root = forest(left[i], right[j], len(node))
            moved = np.flatnonzero(root != np.arange(len(node)))
            yield pa.RecordBatch.from_pydict({"a": node[root[moved]].astype(np.int64), "b": node[moved].astype(np.int64)})

    return run


def _united(rows: DataFrame, percent: int) -> DataFrame:
    """(node, component) for the rows (node, n, alone, prefix, parity, grams) that link to another one."""
    spark = rows.sparkSession
    entries = rows.select("node", "n", "alone", "parity", F.posexplode("prefix").alias("place", "gram"))
    found = entries.groupBy("gram").agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("docs")).where("docs > 1")
    grams = materialize(found.select(F.col("gram").alias("g"), F.col("first.node").alias("first"), F.col("first.n").alias("first_n"), "docs"), "grams")
    known = materialize(entries.join(grams, F.col("gram") == F.col("g")).select("gram", "node", "n", (F.col("alone") + F.col("place")).alias("pos"), "parity", "first", "first_n", "docs"), "postings")
    fits = F.least("n", "first_n") * 100 >= F.greatest("n", "first_n") * percent
    stars = known.where((F.col("node") != F.col("first")) & fits).select(F.col("first").alias("a"), F.col("node").alias("b"), "n")
    links = materialize(_links(stars, rows, percent), "verified")
    comps = materialize(components(links).select(F.col("node").alias("c_node"), "component"), "united")
    # what the columns' least rows have not united yet
    told = known.join(comps, F.col("node") == F.col("c_node"), "left").select("gram", "node", "n", "pos", "parity", F.coalesce("component", "node").alias("comp"), "docs")
    split = told.groupBy("gram").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select(F.col("gram").alias("g"))
    open_ = materialize(told.join(split, F.col("gram") == F.col("g"), "left_semi"), "open")
    discard(grams, known)
    few = open_.where(F.col("docs") <= FEW).select(F.col("gram").alias("task"), "node", "n", "pos", "comp", "parity")
    parts = partitions_for(spark, 0, 1) * 2
    pairs = few.repartition(parts, "task").sortWithinPartitions("task", "n").mapInArrow(_pairs(percent), _PAIRS)
    links = links.union(_links(pairs, rows, percent))
    many = open_.where(F.col("docs") > FEW)
    if many.head(1):
        least = many.groupBy("gram").agg(F.min("node").alias("a")).withColumnRenamed("gram", "g")
        clusters = components(many.join(least, F.col("gram") == F.col("g")).select("a", F.col("node").alias("b")))
        kept = many.select("node", "comp").distinct()
        sent = rows.select("node", "n", "grams").join(kept.withColumnRenamed("node", "k_node"), F.col("node") == F.col("k_node")).select("node", "n", "grams", "comp")
        tasks = block_tasks(clusters.withColumnRenamed("node", "item"), "component", "item", sent, "node", BLOCK_ROWS, parts)
        links = links.union(tasks.mapInArrow(_tiles(percent), "a bigint, b bigint"))
    return components(links)


def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id.

    Words are runs outside `[\\x20\\x09-\\x0D]`, A-Z lower-cased; two documents
    link when 100 * overlap >= percent * union of their sets of distinct
    ``words``-word shingles; shorter texts are one shingle. Null texts and texts
    without words have the empty set and link with nothing; very long texts are
    taken whole. ``docs`` is read twice and must give the same ids and texts both
    times, in any order. ``id_col`` holds integers; rows that repeat an id are
    documents of their own, each with the smallest id of its component; rows
    without an id come back with nulls. Columns other than the two named are not
    read. An empty table gives an empty result.
    """
    spark, how = docs.sparkSession, {"words": words, "percent": percent, "id_col": id_col, "text_col": text_col}
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    heads = set_heads(docs, chars, **how)
    # equal sets are one class, named by its least id; of a class that may link, a document of that id goes on
    least = F.min(F.struct("id", "key")).alias("least")
    found = heads.where("mark is not null").groupBy("mark").agg(least, F.max("may").alias("may"), F.max("n").alias("n"))
    classes = materialize(found.select(F.col("mark").alias("c_mark"), F.col("least.id").alias("name"), F.col("least.key").alias("key"), "may", "n"), "classes")
    share = classes.where("may").agg(F.sum("n")).first()[0] or 0
    total = heads.agg(F.sum("n")).first()[0] or 1
    left = spark.sparkContext.broadcast(key_map(classes.where("may").select("key")))
    sets = ngram_sets(docs, left, int(chars * share // total), **how)
    # documents that share id and text, or a bit of the map, can still be of one class: the least row stands for it
    stands = sets.where("mark is not null").groupBy(F.col("mark").alias("s_mark")).agg(F.min("row").alias("stands"))
    standing = materialize(stands.join(classes, F.col("s_mark") == F.col("c_mark")).select("s_mark", "stands", "name"), "standing")
    can = sets.where("prefix is not null and size(prefix) > 0")
    rows = can.join(standing, (F.col("mark") == F.col("s_mark")) & (F.col("row") == F.col("stands"))).select(F.col("row").alias("node"), "n", "alone", "prefix", "parity", "grams")
    rows = materialize(rows, "rows")
    discard(sets)
    united = _united(rows, percent)
    named = united.join(standing, F.col("node") == F.col("stands"))
    least = named.groupBy("component").agg(F.min("name").alias("least")).withColumnRenamed("component", "l_component")
    linked = named.join(least, F.col("component") == F.col("l_component")).select(F.col("s_mark").alias("l_mark"), "least")
    named = classes.join(linked, F.col("c_mark") == F.col("l_mark"), "left").select("c_mark", F.coalesce("least", "name").alias("name"))
    known = heads.join(named, F.col("mark") == F.col("c_mark"), "left")
    out = materialize(known.select("id", F.col("n").alias("n_shingles"), F.coalesce("name", "id").alias("component_id")), "components")
    discard(heads, classes, standing, rows)
    nameless = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("bigint").alias("id"), *[F.lit(None).cast("bigint").alias(c) for c in ("n_shingles", "component_id")])
    return out.union(nameless).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def keep_one_of_each(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (null last); columns unchanged.

    Rows are compared one by one, so those that share an id or have none are
    documents of their own.
    """
    keyed = materialize(docs.withColumn("__near_row", F.monotonically_increasing_id()), "keyed")
    found = jaccard_components(keyed, words=words, percent=percent, id_col="__near_row", text_col=text_col).select(F.col("__near_row").alias("row"), F.col("component_id").alias("component"))
    shared = found.join(found.where("row <> component").select(F.col("component").alias("s")).distinct(), F.col("component") == F.col("s")).select("row", "component")
    named = materialize(shared.join(keyed.select(F.col("__near_row").alias("k"), F.col(id_col).alias("id")), F.col("row") == F.col("k")).select("row", "component", "id"), "shared")
    first = named.groupBy("component").agg(F.min_by("row", F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")).select(F.col("component").alias("c"), "first")
    gone = named.join(first, F.col("component") == F.col("c")).where("row <> first").select(F.col("row").alias("__gone"))
    gone = materialize(gone, "gone")
    discard(named)
    return keyed.join(sent_if_small(gone), F.col("__near_row") == F.col("__gone"), "left_anti").drop("__near_row")


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), words=3, percent=90)


#: DuckDB SQL for the rows of op4.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)]) END AS grams
  FROM w
),
p AS MATERIALIZED (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM p AS a JOIN p AS b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM reach AS r JOIN e ON r.other = e.a)
SELECT s.doc_id, len(s.grams) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) AS c USING (doc_id)
"""
