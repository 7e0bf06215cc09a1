"""Harmonic packing: the rule on lengths, and a round trip over hard cases."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from casegrid.llm.harmonic_packing import harmonic_bins, pack_harmonic, pack_lot

BPE = public_tokenizers.path("byte_bpe_50k.json")


def power_of_two(n):
    return n > 0 and n & (n - 1) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=120), st.sampled_from([16, 64, 100, 1024]))
def test_every_id_has_one_place(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    doc, start, length, sequence, offset = pack_lot(sizes, capacity)
    assert (length > 0).all()
    for i, n in enumerate(sizes):
        own = sorted(zip(start[doc == i], length[doc == i], strict=True))
        assert own[0][0] == 0 and sum(x[1] for x in own) == n and all(a + k == b for (a, k), (b, _) in zip(own, own[1:]))
    totals = []
    for b in range(sequence.max() + 1):
        own = sorted(zip(offset[sequence == b], length[sequence == b], strict=True))
        assert own[0][0] == 0 and all(a + k == c for (a, k), (c, _) in zip(own, own[1:]))
        totals.append(sum(x[1] for x in own))
    assert all(t == capacity or t < capacity and power_of_two(t) for t in totals)
    assert sum(t < capacity for t in totals) <= capacity.bit_length()


def test_bins_hold_the_count_of_their_class():
    sizes = np.array([512] * 5 + [341] * 7 + [1024, 1025, 100])
    bins, _ = harmonic_bins(sizes, 1024)
    assert sorted(np.bincount(bins[bins >= 0])) == [1, 2, 2, 3, 3]
    assert (bins[[4, 11, 13, 14]] == -1).all()  # half a bin, a third of one, too long, a tenth of one


def test_documents_that_fit_stay_whole():
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(20, 1000, 4000), rng.integers(1025, 20000, 300)])
    doc, *_ = pack_lot(sizes, 1024)
    pieces = np.bincount(doc)
    assert (pieces[:4000] == 1).mean() >= 0.9  # the others are what is left over of their class


@pytest.mark.parametrize("partitions", [1, 5])
def test_round_trip(spark, docs, corpus, partitions):
    from tokenizers import Tokenizer

    ids = {i: e.ids + [0] for i, e in zip(corpus, Tokenizer.from_file(BPE).encode_batch_fast([t or "" for t in corpus.values()], add_special_tokens=False), strict=True)}
    got = pack_harmonic(docs.repartition(partitions), BPE, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *r["ids"])) and len(r["ids"]) == r["length"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {i: [x for _, part in sorted(p) for x in part] for i, p in by_doc.items()} == ids
    for p in by_sequence.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at == 1024 or at < 1024 and power_of_two(at)
    assert len(by_sequence) <= sum(map(len, ids.values())) / 1024 + 11 * partitions


def test_edge_tables(spark):
    schema = "doc_id bigint, text string, length int, ids_crc32 string, sequence_id int"
    assert pack_harmonic(spark.createDataFrame([], schema), BPE).count() == 0
    rows = [(None, "alpha", 1, "x", 2), (None, None, 1, "x", 2), (7, "same text", 1, "x", 2), (7, "same text", 1, "x", 2), (8, "", 1, "x", 2)]
    got = pack_harmonic(spark.createDataFrame(rows, schema).coalesce(1), BPE).collect()
    assert sorted((r["doc_id"] or 0) for r in got if r["start"] == 0) == [0, 0, 7, 7, 8]
    assert sorted(r["doc_tokens"] for r in got if r["start"] == 0)[:2] == [1, 1]
