"""Conversation prefix trie from sorted matrices of turn ids.

A conversation is rebuilt from the heads of its block of 20 and its own turns,
as a path of 16-byte turn digests. Paths are dealt by range, so conversations
that begin alike are neighbours, and equal paths are ordered (and, if there are
many, split) by conversation id. Each range shard turns its paths into padded
matrices of turn ids, a tile of columns at a time: numpy's lexsort orders the
rows, column change masks that are OR-accumulated along a row mark where nodes
start, and ``reduceat`` over the starts aggregates the nodes of every depth.

A node that holds a shard's first or last row may go on in the next shard. For
such boundary nodes the shards' sums are added up, and what two neighbouring
shards counted apart is set right by the prefix that their meeting rows share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window as W

from casegrid.llm.packed import blob, split_points, whole_groups
from casegrid.llm.text_tables import read_table, sent_if_small
from casegrid.workspace import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Conversations whose ids share c - c % BLOCK share a head.
BLOCK = 20
#: Cells of a tile; turns of a shard, about; conversation ids of a piece of a boundary node's list.
TILE_CELLS, SHARD_TURNS, PIECE_IDS = 2_000_000, 500_000, 8_192
_NO_IDS = hashlib.sha256(b"").hexdigest()


def ids_digest(ids) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _rebuild(batches):
    """Rows sorted by (base, conversation, turn, digest) become one row of each conversation: its path and the words of its turns."""
    for table in whole_groups(batches, "base", 50_000):
        table = table.combine_chunks()
        base, conv, head = (table.column(c).to_numpy() for c in ("base", "conv", "head"))
        starts, ends = split_points(conv)  # a conversation is of one base, so its rows are together
        own, conv, base, head = ends - starts, conv[starts], base[starts], head[starts]
        at = np.searchsorted(conv, base)  # sorted by base, then conversation; the base is the least of its block
        there = (at < len(conv)) & (conv[np.minimum(at, len(conv) - 1)] == base)
        at = np.where(there, at, 0)
        lead = np.where(there, np.minimum(head, own[at]), 0)
        rest = np.maximum(own - head, 0)
        total = lead + rest
        offsets = np.concatenate(([0], np.cumsum(total)))
        nth = np.arange(offsets[-1]) - np.repeat(offsets[:-1], total)
        from_head = nth < np.repeat(lead, total)
        row = np.where(from_head, np.repeat(starts[at], total) + nth, np.repeat(starts + head - lead, total) + nth)
        digests = np.frombuffer(b"".join(table.column("digest").to_pylist()), np.uint8).reshape(-1, 16)[row]
        words = table.column("words").to_numpy()[row]
        for low in range(0, len(conv), 4096):
            a, b = offsets[low], offsets[min(low + 4096, len(conv))]
            cut = (offsets[low : low + 4097] - a).astype(np.int64)
            pieces = [pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(blob(cut * n)), pa.py_buffer(blob(x[a:b]))]).cast(pa.binary()) for n, x in ((16, digests), (8, words.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([pa.array(conv[low : low + 4096], pa.int64()), *pieces], ["conv", "path", "words"])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv, path (16 bytes a turn) and words (8 bytes a turn) of each rebuilt conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        (F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK))).alias("base"), F.col("conv_id").alias("conv"), F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(4)).alias("head"), "turn",
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    dealt = turns.repartition("base").sortWithinPartitions("base", "conv", "turn", "digest").drop("turn")
    return dealt.mapInArrow(_rebuild, "conv bigint, path binary, words binary")


class Paths:
    """A shard's conversations as ragged arrays: turn ids that keep the digests' order, words so far."""

    def __init__(self, conv: np.ndarray, paths: list[bytes], words: list[bytes]):
        self.conv, self.n = conv, len(conv)
        self.size = np.array([len(p) // 16 for p in paths], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        halves = np.frombuffer(b"".join(paths), ">u8").reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        change = (halves[order][1:] != halves[order][:-1]).any(axis=1)
        self.turn = np.empty(len(order), np.int32)
        self.turn[order] = np.concatenate(([0], np.cumsum(change)))[: len(order)]
        self.words = np.frombuffer(b"".join(words), np.int64)
        summed = np.concatenate(([0], np.cumsum(self.words)))
        self.so_far = summed[1:] - np.repeat(summed[self.begin], self.size)

    def sort(self):
        """Rows in order of their paths, then ids; and the tiles: (first column, positions in the order, turn ids or -1, where nodes start)."""
        order, group, tiles, low = np.arange(self.n), np.zeros(self.n, np.int64), [], 0
        if self.n and not self.size.any():
            return np.argsort(self.conv, kind="stable"), tiles
        while True:
            at = np.flatnonzero(self.size[order] > low)  # positions; shorter rows stand first in their group
            if not len(at):
                return order, tiles
            rows = order[at]
            width = int(min(max(16, TILE_CELLS // len(at)), self.size[rows].max() - low))
            column = low + np.arange(width)
            real = column < self.size[rows][:, None]
            matrix = np.full((len(at), width), -1, np.int32)
            matrix[real] = self.turn[(self.begin[rows][:, None] + column)[real]]
            by = np.lexsort((self.conv[rows], *(matrix[:, c] for c in range(width - 1, -1, -1)), group[at]))
            matrix, real = matrix[by], real[by]
            if low:
                order[at] = rows[by]
            else:  # the first tile also places the rows that have no turn, by their ids
                none = np.flatnonzero(self.size == 0)
                order = np.concatenate((none[np.argsort(self.conv[none], kind="stable")], rows[by]))
                at = np.arange(len(none), self.n)
            apart = np.ones((len(at), width + 1), bool)
            apart[1:, 0] = group[at][1:] != group[at][:-1]
            apart[1:, 1:] = matrix[1:] != matrix[:-1]
            np.logical_or.accumulate(apart, axis=1, out=apart)
            tiles.append((low, at, real, apart[:, 1:] & real))
            group = np.zeros(self.n, np.int64)
            group[at] = np.cumsum(apart[:, -1])
            low += width


def shard_nodes(p: Paths):
    """The nodes that begin in a shard, depth by depth, tile by tile, as dicts of arrays; "edge" is 1 or 2 where a node holds the first or last row."""
    order, tiles = p.sort()
    conv, size, begin = p.conv[order], p.size[order], p.begin[order]
    shared = np.zeros(p.n, np.int64)  # leading turns that a row has in common with the row before
    for _, at, real, start in tiles:
        shared[at] += (real & ~start).sum(axis=1)
    so_far = lambda rows, depth: np.where(depth > 0, p.so_far[np.maximum(begin[rows] + depth - 1, 0)], 0) if len(p.so_far) else np.zeros(len(rows), np.int64)
    every = np.arange(p.n)
    words = so_far(every, shared)
    following = np.append(shared[1:], 0)
    leaf = ((every == p.n - 1) | (following < size)).astype(np.int64)  # no later row has the whole path: a leaf's last row

    begins = np.zeros(p.n, np.int64)  # for the tile before: which depth + 1 nodes start at a row's last column
    begins[np.flatnonzero((size > 0) & (shared == 0))] = 1
    parent, edge_above = np.full(p.n, conv.min()), np.ones(p.n, np.int8)

    def level(rows, starts, depth, ended, child):
        """Nodes over ``rows``, cut at ``starts``, that end at ``depth`` (an array for each row)."""
        n = np.diff(np.append(starts, len(rows)))
        first = rows[starts]
        above = so_far(first, depth[starts] - 1)
        return {
            "depth": depth[starts], "conv": np.minimum.reduceat(conv[rows], starts), "n": n, "children": np.add.reduceat(child, starts), "leaves": np.add.reduceat(leaf[rows], starts),
            "saved": np.add.reduceat(words[rows], starts) - words[first] - (n - 1) * above, "ended": np.add.reduceat(ended, starts), "first": first, "above": above,
        }

    root = level(every, np.zeros(1, np.int64), np.zeros(p.n, np.int64), (size == 0).astype(np.int64), begins)
    yield root | {"parent": np.array([-1]), "parent_edge": np.array([0], np.int8), "edge": np.array([1], np.int8), "order": conv}
    for t, (low, at, real, start) in enumerate(tiles):
        after = tiles[t + 1] if t + 1 < len(tiles) else None
        child = np.zeros(real.shape, np.int64)
        child[:, :-1] = start[:, 1:]
        if after is not None:
            child[np.searchsorted(at, after[1]), -1] = after[3][:, 0]
        cells = real.T.nonzero()  # column by column, rows in order
        depth, rows = cells[0] + low + 1, at[cells[1]]
        starts = np.flatnonzero(start.T[cells])
        out = level(rows, starts, depth, (size[rows] == depth).astype(np.int64), child.T[cells])
        ends = np.append(starts[1:], len(rows)) - 1
        edge = np.select([rows[starts] == 0, rows[ends] == p.n - 1], [1, 2]).astype(np.int8)
        # a node's parent: the node of the same row one column to the left
        node_of = np.cumsum(start.T[cells]) - 1
        grid = np.full(real.shape, -1)
        grid[cells[1], cells[0]] = node_of
        row_at, col = cells[1][starts], cells[0][starts]
        left = np.where(col > 0, grid[row_at, np.maximum(col - 1, 0)], -1)
        out["parent"] = np.where(col > 0, out["conv"][left], parent[rows[starts]])
        out["parent_edge"] = np.where(col > 0, edge[left], edge_above[rows[starts]])
        full = np.flatnonzero(real[:, -1])
        parent[at[full]], edge_above[at[full]] = out["conv"][grid[full, -1]], edge[grid[full, -1]]
        yield out | {"edge": edge, "order": conv}


_SCHEMA = "kind int, shard int, conv_id bigint, depth bigint, parent_conv_id bigint, parent_edge int, edge int, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, above bigint, key binary, ids binary, words binary"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_KINDS = dict(c.split() for c in _SCHEMA.split(", "))


def _records(n: int, **columns):
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _TYPES[_KINDS[c]]) if c in columns else pa.nulls(n, _TYPES[_KINDS[c]]) for c in _NAMES], _NAMES)


def _keys(path: bytes) -> list[bytes]:
    """The name of the node at each depth of a path."""
    running, out = hashlib.sha256(), []
    for k in range(0, len(path) + 1, 16):
        out.append(running.digest()[:16] + (k // 16).to_bytes(6, "big"))
        running.update(path[k : k + 16])
    return out


def _shard(batches):
    """Kind 0: whole nodes. 1: a boundary node's share. 2: a piece of the ids that end at a boundary node. 3: a shard's first (edge 1) and last (2) path."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table, shard = pa.Table.from_batches(held), TaskContext.get().partitionId()
    paths, words = table.column("path").to_pylist(), table.column("words").to_pylist()
    p = Paths(table.column("conv").to_numpy(), paths, words)
    order, _ = p.sort()
    rims = [int(order[0]), int(order[-1])]
    keys = [_keys(paths[r]) for r in rims]
    yield _records(2, kind=[3, 3], shard=[shard] * 2, edge=[1, 2], ids=[paths[r] for r in rims], words=[words[r] for r in rims])
    for nodes in shard_nodes(p):
        conv, whole = nodes["order"], np.flatnonzero(nodes["edge"] == 0)
        for low in range(0, len(whole), 16_384):
            at = whole[low : low + 16_384]
            digests = [_NO_IDS] * len(at)
            for k in np.flatnonzero(nodes["ended"][at]):
                first = nodes["first"][at[k]]
                digests[k] = ids_digest(conv[first : first + nodes["ended"][at[k]]].tolist())
            yield _records(
                len(at), kind=np.zeros(len(at), np.int32), shard=np.full(len(at), shard), conv_id=nodes["conv"][at], depth=nodes["depth"][at], parent_conv_id=nodes["parent"][at], parent_edge=nodes["parent_edge"][at], edge=np.zeros(len(at), np.int32),
                n_convs=nodes["n"][at], n_children=nodes["children"][at], n_leaves=nodes["leaves"][at], saved_tokens=nodes["saved"][at], ends_sha256=digests,
            )
        rim = np.flatnonzero(nodes["edge"])
        if len(rim):
            names = [keys[e - 1][d] for e, d in zip(nodes["edge"][rim], nodes["depth"][rim], strict=True)]
            yield _records(
                len(rim), kind=np.ones(len(rim), np.int32), shard=np.full(len(rim), shard), conv_id=nodes["conv"][rim], depth=nodes["depth"][rim], parent_edge=nodes["parent_edge"][rim], edge=nodes["edge"][rim],
                n_convs=nodes["n"][rim], n_children=nodes["children"][rim], n_leaves=nodes["leaves"][rim], saved_tokens=nodes["saved"][rim], above=nodes["above"][rim], key=names,
            )
            for k, name in zip(rim, names, strict=True):
                first, ended = nodes["first"][k], nodes["ended"][k]
                for low in range(0, int(ended), PIECE_IDS):
                    yield _records(1, kind=[2], shard=[shard], depth=[low], key=[name], ids=[blob(conv[first + low : first + min(low + PIECE_IDS, ended)])])


def _meet(batches):
    """What two neighbouring shards counted apart, for each node on the prefix that the last row of one and the first of the other share."""
    for batch in batches:
        for row in batch.to_pylist():
            a, b = (np.frombuffer(row[c], np.int64).reshape(-1, 2) for c in ("last_path", "first_path"))
            short = min(len(a), len(b))
            differ = np.flatnonzero((a[:short] != b[:short]).any(axis=1))
            common = int(differ[0]) if len(differ) else short
            so_far = np.concatenate(([0], np.cumsum(np.frombuffer(row["first_words"], np.int64)[:common])))
            depth = np.arange(common + 1)
            above = so_far[np.maximum(depth - 1, 0)]
            keys = _keys(row["first_path"][: 16 * common])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(-(depth < common).astype(np.int64)), pa.array(np.full(common + 1, -int(common == len(a)), np.int64)), pa.array(so_far[common] - above, pa.int64())],
                ["key", "n_children", "n_leaves", "saved_tokens"],
            )


def _hash_ids(batches):
    """Ids in pieces, sorted by node, shard and place, to the hash of each node's list; only the hash is held."""
    running, now = None, None
    for batch in batches:
        keys, hashes = [], []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            text = ",".join(map(str, np.frombuffer(ids, np.int64).tolist())).encode()
            if key == now:
                running.update(b"," + text)
                continue
            if now is not None:
                keys.append(now)
                hashes.append(running.hexdigest())
            now, running = key, hashlib.sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], ["key", "ends_sha256"])


def prefix_trie(conversations: DataFrame, *, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Reads conv_id, turn, role and text; other columns don't matter. Rows without
    a conv_id belong to no conversation and are left out. Null turns come first;
    turns of one number, repeated rows included, are ordered by their digest.
    Null role or text is empty. c % 20 is never negative. A conversation that is
    rebuilt without turns is a member of the root alone. An empty table has no
    nodes. Very long texts are hashed whole; a conversation travels as one row
    of 24 bytes a turn, so it is bounded by what a row may hold.
    """
    spark = conversations.sparkSession
    paths = materialize(rebuilt(conversations), "paths")
    turns = paths.agg(F.sum(F.length("path") / 16)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(turns) // shard_turns))
    made = materialize(paths.repartitionByRange(shards, "path", "conv").mapInArrow(_shard, _SCHEMA), "nodes")
    discard(paths)

    share = made.where("kind = 1")
    rims = made.where("kind = 3")
    numbered = rims.where("edge = 1").select("shard").withColumn("before", F.lag("shard").over(W.orderBy("shard"))).where("before IS NOT NULL")  # a row for each shard
    first = rims.where("edge = 1").select(F.col("shard").alias("f"), F.col("ids").alias("first_path"), F.col("words").alias("first_words"))
    last = rims.where("edge = 2").select(F.col("shard").alias("l"), F.col("ids").alias("last_path"))
    pairs = numbered.join(first, F.col("shard") == F.col("f")).join(last, F.col("before") == F.col("l"))
    apart = pairs.select("last_path", "first_path", "first_words").mapInArrow(_meet, "key binary, n_children bigint, n_leaves bigint, saved_tokens bigint")

    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    none = [F.lit(None).cast("bigint").alias(c) for c in ("conv_id", "depth", "n_convs")]
    every = share.select("key", "conv_id", "depth", *sums).unionByName(apart.select("key", *none, "n_children", "n_leaves", "saved_tokens"))
    merged = materialize(every.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in sums]), "boundary")
    ends = made.where("kind = 2").select("key", "shard", "depth", "ids").repartition("key").sortWithinPartitions("key", "shard", "depth").select("key", "ids").mapInArrow(_hash_ids, "key binary, ends_sha256 string")
    # who a shard's boundary nodes are once they are merged
    named = share.join(merged.select(F.col("key").alias("k"), F.col("conv_id").alias("parent")), F.col("key") == F.col("k"))
    above = sent_if_small(materialize(named.select(F.col("shard").alias("s"), F.col("edge").alias("e"), (F.col("depth") + 1).alias("d"), "parent"), "above"))
    place = (F.col("shard") == F.col("s")) & (F.col("parent_edge") == F.col("e")) & (F.col("depth") == F.col("d"))
    # the parent of a boundary node is a boundary node of the same shard
    up = share.join(above, place).groupBy("key").agg(F.min("parent").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    boundary = merged.join(ends, "key", "left").join(up, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_IDS)))
    whole = made.where("kind = 0")
    inner = whole.where("parent_edge = 0")
    outer = whole.where("parent_edge > 0").drop("parent_conv_id").join(above, place).withColumnRenamed("parent", "parent_conv_id")
    return inner.select(*columns).unionByName(outer.select(*columns)).unionByName(boundary.select(*columns))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH t AS (SELECT conv_id AS c, turn, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(digest ORDER BY turn NULLS FIRST, digest) AS path, list(words ORDER BY turn NULLS FIRST, digest) AS words FROM t GROUP BY c),
crc AS (SELECT own.*, c - ((c % 20) + 20) % 20 AS base,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 4 AS h FROM own),
r AS (SELECT crc.c, coalesce(b.path[1:h], []) || crc.path[h + 1:] AS path, coalesce(b.words[1:h], []) || crc.words[h + 1:] AS words FROM crc LEFT JOIN own b ON b.c = crc.base),
p AS (SELECT c, len(path) AS n, unnest(range(0, len(path) + 1)) AS d, path, words FROM r),
k AS (SELECT c, n, d, array_to_string(path[1:d], '') AS key, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w FROM p),
node AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, min(w) AS w, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256 FROM k GROUP BY d, key),
child AS (SELECT d - 1 AS d, left(key, 32 * (d - 1)) AS key, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
up AS (SELECT node.key AS low, unnest(range(0, node.d + 1)) AS d, (n_convs - 1) * w AS own, coalesce(n_children, 0) = 0 AS leaf FROM node LEFT JOIN child ON child.key = node.key),
below AS (SELECT left(low, 32 * d) AS key, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM up GROUP BY 1)
SELECT node.conv_id, node.d::BIGINT AS depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN below ON below.key = node.key LEFT JOIN child ON child.key = node.key LEFT JOIN node above ON node.d > 0 AND above.key = left(node.key, 32 * (node.d - 1))
"""
