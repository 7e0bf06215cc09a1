"""The prefix trie against a plain one built turn by turn."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from casegrid.llm import prefix_trie
from casegrid.llm.prefix_trie import Paths, prefix_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, key binary, shard string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(own)] for c, own in turns.items()}
    nodes = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            node = nodes.setdefault(path[:d], {"members": [], "ends": []})
            node["members"].append(c)
        nodes[path]["ends"].append(c)
    for path, node in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        node |= {"own": (len(node["members"]) - 1) * words, "children": 0, "leaves": 0, "saved": 0}
    for path in nodes:
        if path:
            nodes[path[:-1]]["children"] += 1
    for path, node in nodes.items():
        for d in range(len(path) + 1):
            nodes[path[:d]]["saved"] += node["own"]
            nodes[path[:d]]["leaves"] += not node["children"]
    return sorted(
        (min(n["members"]), len(p), min(nodes[p[:-1]]["members"]) if p else None, len(n["members"]), n["children"], n["leaves"], n["saved"], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest())
        for p, n in nodes.items()
    )


def conversations(rng, n, deep=0):
    """Many that begin alike, copies, null and repeated turns, long ones."""
    texts = ["", None, "a b", "a  b c\n", "x", "\x0b", "é ü"]
    rows = []
    for c in range(-15, n):
        if rng.random() < 0.1:
            continue
        size = rng.choice([1, 1, 2, 3, 4, 5, 8, deep or 6])
        alike = rng.random() < 0.5
        for t in range(size):
            rows.append((c, None if rng.random() < 0.03 else t, "user" if t % 2 else rng.choice(["system", None]), texts[t % 7] if alike and rng.random() < 0.9 else rng.choice(texts)))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    rng.shuffle(rows)
    return [*rows, (None, 1, "user", "lost")]


@pytest.mark.parametrize("seed,n,deep,shard_turns", [(1, 120, 0, 10**6), (2, 300, 60, 40), (3, 400, 0, 15), (4, 60, 300, 100)])
def test_against_brute_force(spark, seed, n, deep, shard_turns):
    rows = conversations(random.Random(seed), n, deep)
    table = spark.createDataFrame([(*r, 1, b"k", "s") for r in rows], SCHEMA).repartition(3)
    got = trie(table, shard_turns=shard_turns)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute(rows), key=str)


def test_sql_gives_the_same_rows():
    rows = conversations(random.Random(6), 150)
    c = duckdb.connect()
    c.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = c.sql(prefix_trie.OP11_SQL)
    assert got.columns == COLUMNS and sorted(got.fetchall(), key=str) == sorted(brute(rows), key=str)


def test_one_conversation_copied_over_many_shards(spark):
    """Copies are split over shards; their ids still come in order, and no leaf or child is counted twice."""
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 4000, 5) for t in range(3)] + [(7001, t, "user", f"turn {t}") for t in range(5)]
    got = sorted((tuple(r) for r in trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), shard_turns=100).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_pieces_of_a_boundary_list(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    rows = [(c, 0, "user", "same") for c in range(0, 2000, 20)]
    got = [tuple(r) for r in trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), shard_turns=30).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_edge_tables(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert trie(spark.createDataFrame([], schema)).count() == 0
    # 3 of crc32("...") % 4 leave short conversations without turns where the base is missing
    rows = [(c, 0, None, None) for c in range(1, 20)]
    assert sorted((tuple(r) for r in trie(spark.createDataFrame(rows, schema)).collect()), key=str) == sorted(brute(rows), key=str)
    gone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    rows = [(c, 0, None, None) for c in gone]
    (root,) = trie(spark.createDataFrame(rows, schema)).collect()
    assert tuple(root) == brute(rows)[0] and root["n_leaves"] == 1 and root["n_convs"] == len(gone)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=9), min_size=1, max_size=40), st.sampled_from([1, 20, 1000]))
def test_tiles_of_any_width_sort_alike(paths, cells):
    data = [b"".join(bytes([t]) * 16 for t in p) for p in paths]
    kept, prefix_trie.TILE_CELLS = prefix_trie.TILE_CELLS, cells
    try:
        order, _ = Paths(np.arange(len(paths)), data, [b"\0" * 8 * len(p) for p in paths]).sort()
    finally:
        prefix_trie.TILE_CELLS = kept
    assert [(paths[i], i) for i in order] == sorted((p, i) for i, p in enumerate(paths))
