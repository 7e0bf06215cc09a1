"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity; two lines that
reach the threshold share one of the first n - ceil(t*n) + 1 words of each, so
only these prefixes are joined. Length filter (sizes within the threshold),
positional filter (what can still follow the shared word) and a bitmap filter
(each differing word flips at most one parity bit; long lines have more bits,
and lines near a border between two widths take part in both joins) discard
most pairs before the word sets of the rest are fetched and their Jaccard
verified. Words that occur only once in the corpus take up places in a prefix,
but are not shipped. A line that matches an earlier one, by document and line number, is removed. Lines
with equal sets are one line of the join, named by their first occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegrid.components import components
from casegrid.llm.ngram_jaccard import may_link, pairs_of_runs, reachable
from casegrid.llm.packed import blob, bucket_of, by_key, forest, mixed, risen, rising, split_points, whole_groups
from casegrid.llm.pair_blocks import block_tasks, overlaps, sparse_overlaps
from casegrid.llm.suffix_dedup import _DDL, _ROWS, _bucket, _rows, _texts
from casegrid.llm.text_tables import partitions_for, read_table
from casegrid.llm.words import word_hashes
from casegrid.workspace import materialize

#: Exact counts order at most this many frequent words; rarer ones come first, by hash.
FREQUENT = 1 << 19
#: Bits of the map of words that occur more than once; two words may share a bit, which only keeps one that could go.
SEEN_BITS = 27
BLOCK_CHARS, BLOCK_ROWS = 8_000_000, 512
#: Tasks of at most so many lines are verified together.
SMALL = 24
#: Bytes of text whose words are hashed and sorted at once.
PIECE = 2_000_000
_TOP = np.uint64(1 << 63)
#: (kind of row, bitmap words, most distinct words of a line); a pair joins where the longer line belongs.
WIDTHS = ((1, 1, 60), (4, 2, 125), (5, 8, 1 << 40))


def slices(batches):
    """(id, number of the first line here, whether the text ends here, lower-cased text), in lists of bounded size.

    Long texts are cut at line feeds, so that one list holds some lines of one text.
    """
    held, size = [], 0
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text, at, number = (text or b"").lower(), 0, 0
                while len(text) - at > PIECE and (cut := text.find(b"\n", at + PIECE)) >= 0:
                    yield [(i, number, False, text[at:cut])]
                    number += text.count(b"\n", at, cut) + 1
                    at = cut + 1
                held.append((i, number, True, text[at:]))
                size += len(text) - at
                if size >= PIECE or len(held) >= 2048:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def line_words(texts: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and number of each line that has words, and line and hash of each word, repeats included.

    The texts are lower-cased; ``first`` is the number of each text's first line.
    """
    data = b"\n".join(texts)
    start, hashes = word_hashes(data)
    ends = np.searchsorted(start, np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), len(data)))
    sizes = np.diff(ends, prepend=0)
    lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), lines)
    number = np.arange(len(of)) - np.repeat(np.cumsum(lines) - lines - first, lines)
    used = sizes > 0
    return of[used], number[used], np.repeat(np.arange(int(used.sum())), sizes[used]), hashes


def ordered_sets(line: np.ndarray, hashes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
    """Each line's distinct words from rare to common: (line, place among keys), line starts and ends, and the sorted order keys."""
    own, at = np.unique(hashes, return_inverse=True)
    key = own >> np.uint64(1)
    if len(words):
        near = np.minimum(np.searchsorted(words, own), len(words) - 1)
        key = np.where(words[near] == own, _TOP | ranks[near], key)
    order = np.argsort(key)
    place = np.empty(len(own), np.uint64)
    place[order] = np.arange(len(own), dtype=np.uint64)
    both = np.sort(line.astype(np.uint64) << np.uint64(32) | place[at])
    both = both[np.concatenate(([True], both[1:] != both[:-1]))[: len(both)]]
    line = (both >> np.uint64(32)).astype(np.int64)
    return line, (both & np.uint64(0xFFFFFFFF)).astype(np.int64), *split_points(line), key[order]


def _summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(np.concatenate(words), return_inverse=True)
    return own, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def _count_words(batches):
    """A task's words with their occurrences, packed by block; any count that all tasks share orders words alike."""
    words: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    fresh = 0
    for part in slices(batches):
        found = np.unique(word_hashes(b"\n".join(t for *_, t in part))[1], return_counts=True)
        words.append(found[0])
        counts.append(found[1])
        fresh += len(found[0])
        if fresh > max(1_000_000, len(words[0])):
            (words[:], counts[:]), fresh = ([x] for x in _summed(words, counts)), 0
    if words:
        h, n = _summed(words, counts)
        at = (h >> np.uint64(56)).astype(np.int64)
        if len(h):
            yield _rows([(int(at[a]), 0, blob(h[a:b]), blob(n[a:b]), None, None) for a, b in zip(*split_points(at), strict=True)])


def _sum_words(batches):
    """Words of more than three occurrences with their number, and for each block a map of those of more than one."""
    schema = pa.schema([("word", pa.int64()), ("lines", pa.int64()), ("part", pa.int32()), ("seen", pa.binary())])
    size = 1 << SEEN_BITS - 8
    for part, table in by_key(batches, "part"):
        words = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("ids").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()])
        u, n = _summed([words], [counts])
        bits = np.zeros(size, bool)
        bits[(u[n > 1] >> np.uint64(64 - SEEN_BITS)).astype(np.int64) & (size - 1)] = True
        yield pa.RecordBatch.from_pylist([{"part": int(part), "seen": blob(np.packbits(bits))}], schema=schema)
        often = n > 3
        for low in range(0, int(often.sum()), 100_000):
            columns = [u[often][low : low + 100_000].view(np.int64), n[often][low : low + 100_000]]
            none = len(columns[0])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], schema=schema)


def frequent_words(rows: DataFrame, partitions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most FREQUENT words, sorted by hash, with their ranks by number of lines; and the map of words seen more than once."""
    counted = materialize(rows.mapInArrow(_count_words, _DDL).repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_sum_words, "word bigint, lines bigint, part int, seen binary"), "words")
    seen = np.zeros(1 << SEEN_BITS - 3, np.uint8)
    for r in counted.where("seen is not null").select("part", "seen").toLocalIterator():  # 256 rows, 2**SEEN_BITS bits in all
        seen[r["part"] << SEEN_BITS - 11 : r["part"] + 1 << SEEN_BITS - 11] = np.frombuffer(r["seen"], np.uint8)
    counted = counted.where("seen is null")
    steps = counted.groupBy(F.floor(F.log2("lines") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("lines").alias("least")).orderBy(F.desc("step")).collect()  # a few hundred rows
    held, least = 0, None
    for s in steps:
        if held + s["n"] > FREQUENT:
            break
        held, least = held + s["n"], s["least"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), seen
    found = counted.where(F.col("lines") >= least).select("word", "lines").toArrow()
    words, lines = found.column("word").to_numpy().view(np.uint64), found.column("lines").to_numpy()
    rank = np.empty(len(words), np.uint64)
    rank[np.lexsort((words, lines))] = np.arange(len(words), dtype=np.uint64)
    order = np.argsort(words)
    return words[order], rank[order], seen


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (-(-percent * n // 100)) + 1


def _entries(blocks: int, buckets: int, percent: int, frequent):
    """Texts -> prefix entries by word block, lines by set block, a head for each document."""

    def run(batches):
        words, ranks, seen = frequent.value
        for part in slices(batches):
            ids, first, ended = np.array([i for i, *_ in part], np.int64), np.array([k for _, k, *_ in part], np.int64), np.array([e for *_, e, _ in part], bool)
            texts = [t for *_, t in part]
            lines = np.array([k + t.count(b"\n") + 1 if t or k else 0 for _, k, _, t in part], np.int64)
            to = bucket_of(ids, buckets)
            order = np.argsort(to, kind="stable")
            order = order[ended[order]]
            out = [(int(2 * blocks + to[order[a]]), 3, rising(ids[order[a:b]]), blob(lines[order[a:b]]), None, None) for a, b in zip(*split_points(to[order]), strict=True)]
            doc, number, line, hashes = line_words(texts, first)
            if len(hashes):
                line, place, first, last, keys = ordered_sets(line, hashes, words, ranks)
                n = last - first
                one, two = mixed(keys)[place], mixed(keys ^ np.uint64(0x5851F42D4C957F2D))[place]
                mark, other = np.add.reduceat(one, first), np.add.reduceat(two, first)
                bit = np.uint64(1) << (one & np.uint64(63))
                # lines by set: the first of equal sets is found in one place
                at = (mark % np.uint64(blocks)).astype(np.int64)
                o = np.argsort(at, kind="stable")
                for a, b in zip(*split_points(at[o]), strict=True):
                    k = o[a:b]
                    out.append((int(blocks + at[k[0]]), 2, rising(ids[doc[k]]), rising(number[k]), blob(mark[k]), blob(other[k])))
                # prefix entries: of equal sets in this slice only the first
                sets = np.lexsort((number, ids[doc], other, mark))
                fresh = np.ones(len(sets), bool)
                fresh[1:] = (mark[sets][1:] != mark[sets][:-1]) | (other[sets][1:] != other[sets][:-1])
                stands = np.zeros(len(n), bool)
                stands[sets[fresh]] = True
                position = np.arange(len(line)) - first[line]
                p = prefix_length(n, percent)
                can = stands & (percent * (n + 1) <= 100 * n)  # smaller sets only match equal ones
                at = (keys >> np.uint64(63 - SEEN_BITS)).astype(np.int64) & (1 << SEEN_BITS) - 1
                again = ((keys & _TOP > 0) | (seen[at >> 3] >> (7 - (at & 7)) & 1 > 0))[place]  # a word that occurs once joins nothing
                least = 0
                for tier, (kind, wide, most) in enumerate(WIDTHS):
                    chosen = can & (n <= most) & (100 * n >= percent * least)
                    least = most + 1
                    e = np.flatnonzero((position < p[line]) & chosen[line] & again)
                    if not len(e):
                        continue
                    parity = np.zeros((len(n), wide), np.uint64)
                    held = np.flatnonzero(chosen[line])  # the words of these lines alone
                    starts, _ = split_points(line[held])
                    word = (one[held] >> np.uint64(32)) % np.uint64(wide)
                    for w in range(wide):
                        parity[line[held[starts]], w] = np.bitwise_xor.reduceat(np.where(word == np.uint64(w), bit[held], np.uint64(0)), starts)
                    at = (one[e] % np.uint64(blocks)).astype(np.int64)
                    o = np.argsort(at, kind="stable")
                    e, at = e[o], at[o]
                    for a, b in zip(*split_points(at), strict=True):
                        k, of = e[a:b], line[e[a:b]]
                        more = blob(np.stack([n[of], position[k]]).astype(np.uint32)) + blob((mark[of] >> np.uint64(32)).astype(np.uint32)) + blob(parity[of])
                        out.append((int(at[a] + ((tier + 1) * blocks + buckets if tier else 0)), kind, rising(ids[doc[of]]), rising(number[of]), blob(keys[place[k]]), more))
            if out:
                yield _rows(out)

    return run


_JOINED = pa.schema([("kind", pa.int32()), ("a_id", pa.int64()), ("a_line", pa.int64()), ("b_id", pa.int64()), ("b_line", pa.int64())])


def _joined(percent: int):
    """Blocks of entries -> candidate links (kind 1); of lines -> later copies (kind 2, b is removed); heads pass (kind 3)."""

    def emit(kind, a_id, a_line, b_id, b_line):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a_id), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (a_id, a_line, b_id, b_line))], schema=_JOINED)

    def run(batches):
        for _, table in by_key(batches, "part"):
            rows = table.to_pylist()
            kind = rows[0]["kind"]
            ids = np.concatenate([risen(r["ids"]) for r in rows])
            if kind == 3:
                yield emit(3, ids, np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]), ids, ids)
                continue
            number = np.concatenate([risen(r["counts"]) for r in rows])
            data = np.concatenate([np.frombuffer(r["data"], np.uint64) for r in rows])
            if kind == 2:
                other = np.concatenate([np.frombuffer(r["more"], np.uint64) for r in rows])
                o = np.lexsort((number, ids, other, data))
                ids, number, data, other = ids[o], number[o], data[o], other[o]
                new = np.concatenate(([True], (data[1:] != data[:-1]) | (other[1:] != other[:-1])))
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                yield emit(2, ids[lead][~new], number[lead][~new], ids[~new], number[~new])
                continue
            sizes = [len(r["data"]) // 8 for r in rows]
            both = [np.frombuffer(r["more"][: 8 * s], np.uint32).reshape(2, s) for r, s in zip(rows, sizes, strict=True)]
            n, pos = np.concatenate(both, axis=1).astype(np.int64)
            tag = np.concatenate([np.frombuffer(r["more"][8 * s : 12 * s], np.uint32) for r, s in zip(rows, sizes, strict=True)])
            parity = np.concatenate([np.frombuffer(r["more"][12 * s :], np.uint64).reshape(s, -1) for r, s in zip(rows, sizes, strict=True)])
            o = np.lexsort((n.astype(np.uint64) << np.uint64(32) | tag, data))
            ids, number, data, n, pos, parity, tag = (x[o] for x in (ids, number, data, n, pos, parity, tag))
            new = np.concatenate(([True], (data[1:] != data[:-1]) | (n[1:] != n[:-1]) | (parity[1:] != parity[:-1]).any(1) | (tag[1:] != tag[:-1])))
            at = np.flatnonzero(new)  # equal sets are one line, named by the first of them
            least = np.minimum.reduceat(ids, at)
            number = np.minimum.reduceat(np.where(ids == np.repeat(least, np.diff(np.append(at, len(ids)))), number, np.iinfo(np.int64).max), at)
            ids, data, n, pos, parity = least, data[at], n[at], pos[at], parity[at]
            for i, j in pairs_of_runs(np.arange(len(ids)), reachable(n, data, percent), 500_000):
                ok = may_link(n[i], n[j], pos[i], pos[j], lambda k, i=i: parity[i[k]], lambda k, j=j: parity[j[k]], percent)
                i, j = i[ok], j[ok]
                if len(i):  # cut down to a forest
                    at, both = np.unique(np.concatenate((i, j)), return_inverse=True)
                    root = forest(both[: len(i)], both[len(i) :], len(at))
                    moved = np.flatnonzero(root != np.arange(len(at)))
                    a, b = at[root[moved]], at[moved]
                    yield emit(1, ids[a], number[a], ids[b], number[b])

    return run


def _fetched(batches):
    """Bucket of texts and wanted lines -> the word sets of those lines."""
    schema = pa.schema([("id", pa.int64()), ("line", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())])
    none = np.empty(0, np.uint64)

    def sets(named, lines):
        of, _, line, hashes = line_words(lines, np.zeros(len(lines), np.int64))
        _, place, first, last, keys = ordered_sets(line, hashes, none, none)
        out = [(*named[k], b - a, blob(keys[place[a:b]])) for k, a, b in zip(of, first, last, strict=True)]
        for low in range(0, len(out), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[low : low + 4096], strict=True), schema, strict=True)], schema=schema)

    for _, table in by_key(batches, "part"):
        texts, back = _bucket(table)
        wanted: dict[int, list] = {}
        for r in back:
            wanted.setdefault(int.from_bytes(r["ids"], "little", signed=True), []).append(np.frombuffer(r["data"], np.int64))
        named, lines, size = [], [], 0
        for i, data in texts:
            if i in wanted:
                own = data.lower().split(b"\n")
                for (k,) in wanted[i]:
                    if k < len(own):
                        named.append((i, int(k)))
                        lines.append(own[k])
                        size += len(own[k])
                if size >= PIECE:
                    yield from sets(named, lines)
                    named, lines, size = [], [], 0
        if named:
            yield from sets(named, lines)


def _later(percent: int):
    """A task's lines -> those that match an earlier one. Small tasks are looked at many at once."""

    def run(batches):
        for table in whole_groups(batches, "task", 2000):
            task, ids, line, n, side = (table.column(c).to_numpy() for c in ("task", "id", "line", "n", "side"))
            place = np.empty(len(ids), np.int64)
            place[np.lexsort((line, ids))] = np.arange(len(ids))
            sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
            first, last = split_points(task)
            small = np.repeat((last - first <= SMALL) & (side[first] == 2), last - first)
            found = []
            if small.any():
                at = np.flatnonzero(small)
                salt = mixed(task.astype(np.int64).view(np.uint64))
                i, j, same = sparse_overlaps([mixed(sets[k] ^ salt[k]) for k in at])
                found.append((at[i], at[j], same))
            for a, b in zip(first[~small[first]], last[~small[first]], strict=True):
                left, right = a + np.flatnonzero(side[a:b] != 1), a + np.flatnonzero(side[a:b] != 0)
                if len(left) and len(right):
                    same = overlaps([sets[k] for k in left], [sets[k] for k in right])
                    i, j = np.nonzero(same)
                    found.append((left[i], right[j], same[i, j].astype(np.int64)))
            hit = np.empty(0, np.int64)
            for i, j, same in found:
                ok = (100 * same >= percent * (n[i] + n[j] - same)) & (place[i] != place[j])
                hit = np.concatenate((hit, np.where(place[i] < place[j], j, i)[ok]))
            hit = np.unique(hit)  # an earlier line matches it
            if len(hit):
                yield pa.RecordBatch.from_pydict({"id": ids[hit].astype(np.int64), "line": line[hit].astype(np.int64)})

    return run


def _wanted(buckets: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            data = batch.column("line").to_numpy()[:, None]
            none = pa.array([None] * len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(ids, buckets)), pa.array(np.ones(len(ids), np.int32)), pa.array([blob(x) for x in ids[:, None]], pa.binary()), none, pa.array([blob(x) for x in data], pa.binary()), none], schema=_ROWS)

    return run


def _names(found: DataFrame):
    """How (id, line number) becomes a node and back: one long if both fit into it, else a struct of the two."""
    low, high, lines = found.where("kind = 3").agg(F.min("a_id"), F.max("a_id"), F.max("a_line")).first()
    bits = (lines or 0).bit_length()
    if low is not None and low >= 0 and high.bit_length() + bits < 63:
        return lambda i, k: F.shiftleft(i, bits).bitwiseOR(F.col(k)), lambda x: F.shiftright(x, bits), lambda x: F.col(x).bitwiseAND(F.lit((1 << bits) - 1))
    return lambda i, k: F.struct(F.col(i).alias("id"), F.col(k).alias("line")), lambda x: F.col(f"{x}.id"), lambda x: F.col(f"{x}.line")


def repeated_lines(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_lines, removed (ascending numbers of the lines that repeat an earlier one).

    Lines end at a line feed and are compared as sets of words
    (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); 100 * overlap >= percent * union
    is a match; order is (id, line number), from 0. Lines without words stay.
    Null texts have no lines. ``id_col`` holds integers; rows that repeat an id
    are one document with all their lines compared; rows without an id come back with nulls. Columns other than the
    two named are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = max(8, int(chars // BLOCK_CHARS))
    parts = partitions_for(spark, blocks, 2)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_words(rows, parts))
    entries = rows.mapInArrow(_entries(blocks, parts, percent, frequent), _DDL).repartition(parts, "part").sortWithinPartitions("part")
    found = materialize(entries.mapInArrow(_joined(percent), "kind int, a_id bigint, a_line bigint, b_id bigint, b_line bigint"), "joined")
    ref, id_of, line_of = _names(found)
    clusters = components(found.where("kind = 1").select(ref("a_id", "a_line").alias("a"), ref("b_id", "b_line").alias("b")))
    lines = clusters.select(id_of("node").alias("id"), line_of("node").alias("line"))
    fetched = rows.mapInArrow(_texts(parts), _DDL).union(lines.mapInArrow(_wanted(parts), _DDL)).repartition(parts, "part").sortWithinPartitions("part")
    sets = materialize(fetched.mapInArrow(_fetched, "id bigint, line bigint, n bigint, grams binary"), "lines")
    tasks = block_tasks(clusters, "component", "node", sets.withColumn("item", ref("id", "line")), "item", BLOCK_ROWS, partitions_for(spark, 0, 1) * 2)
    later = tasks.select("task", "side", "id", "line", "n", "grams").mapInArrow(_later(percent), "id bigint, line bigint")
    gone = later.union(found.where("kind = 2").select(F.col("b_id").alias("id"), F.col("b_line").alias("line")))
    by_doc = gone.groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("removed")).withColumnRenamed("id", "g_id")
    heads = found.where("kind = 3").select(F.col("a_id").alias("id"), F.col("a_line").alias("n_lines"))
    out = heads.join(by_doc, F.col("id") == F.col("g_id"), "left").select("id", "n_lines", F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"))
    out = out.union(docs.where(F.col(id_col).isNull()).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema]))
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def drop_repeated_lines(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of the text; other columns unchanged."""
    found = repeated_lines(docs, percent=percent, id_col=id_col, text_col=text_col).where(F.size("removed") > 0).select(F.col(id_col).alias("__id"), "removed")
    joined = docs.join(found.withColumnRenamed("removed", "__gone"), F.col(id_col) == F.col("__id"), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    left = F.filter(F.transform(lines, lambda x, i: F.struct(i.cast("bigint").alias("i"), x.alias("x"))), lambda s: ~F.array_contains("__gone", s["i"]))
    kept = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda s: s["x"]), "\n"))
    return joined.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


#: DuckDB SQL for the rows of op9: prefixes of each distinct line's rarest words give the candidates.
OP9_SQL = r"""
WITH t AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) END AS lines FROM documents),
u AS MATERIALIZED (
  SELECT doc_id, no, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS no FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
s AS MATERIALIZED (SELECT words, len(words) AS n, min({'doc': doc_id, 'no': no}) AS first, row_number() OVER () AS sid FROM u GROUP BY words),
w AS MATERIALIZED (SELECT sid, n, first, unnest(words) AS word FROM s),
f AS (SELECT word, count(*) AS held FROM w GROUP BY word),
p AS MATERIALIZED (
  SELECT * FROM (SELECT sid, n, first, word, row_number() OVER (PARTITION BY sid ORDER BY held, word) AS place FROM w JOIN f USING (word))
  WHERE place <= n - (4 * n + 4) // 5 + 1
),
c AS MATERIALIZED (SELECT DISTINCT a.sid AS a, b.sid AS b FROM p AS a JOIN p AS b ON a.word = b.word WHERE a.first < b.first AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
l AS (
  SELECT DISTINCT b FROM (SELECT b, len(list_intersect(x.words, y.words)) AS o, x.n + y.n AS sizes FROM c JOIN s AS x ON x.sid = a JOIN s AS y ON y.sid = b)
  WHERE 100 * o >= 80 * (sizes - o)
),
g AS (SELECT u.doc_id, u.no FROM u JOIN s USING (words) WHERE u.doc_id <> s.first.doc OR u.no <> s.first.no OR s.sid IN (SELECT b FROM l)),
r AS (SELECT doc_id, count(*) AS n_removed, string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) AS removed_lines FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines FROM t LEFT JOIN r USING (doc_id)
"""
