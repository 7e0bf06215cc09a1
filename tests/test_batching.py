"""WIN4 against the plain loop."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from casegrid.functions import patterns as P
from casegrid.operators import batching

ORDER = ("original_filename", "chunk_index", "chunk_id")


def plain(sizes, most, most_rows):
    out, number, held, rows = [], -1, 0, 0
    for s in sizes:
        if number < 0 or held + s > most or most_rows is not None and rows >= most_rows:
            number, held, rows = number + 1, 0, 0
        held, rows = held + s, rows + 1
        out.append(number)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=80), st.integers(1, 60), st.one_of(st.none(), st.integers(1, 5)), st.integers(0, 90))
def test_pointers(sizes, most, most_rows, entry):
    sizes = np.array(sizes)
    entry = min(entry, len(sizes) - 1)
    want = plain(sizes[entry:], most, most_rows)
    starts = batching.starts_from(sizes, entry, most, most_rows)
    assert list(starts - entry) == [i for i, n in enumerate(want) if not i or want[i - 1] != n]
    count, held, rows = batching.summary(sizes, len(sizes), most, most_rows)[:, entry]
    assert (count, held, rows) == (want[-1] + 1, sizes[starts[-1] :].sum(), len(sizes) - starts[-1])


@pytest.mark.parametrize("most,most_rows,segment", [(48_000, None, 7), (12_000, 3, 5), (3_000, None, 1), (500, None, 4), (60_000, None, 20_000)])
def test_against_the_plain_loop(spark, most, most_rows, segment):
    rng = random.Random(most)
    rows = [(f"r{c}" if c else None, f"f{i // 40:03}.md", i % 40, f"c{c}-{i}", rng.choice([None, "x" * rng.randrange(3000), "y" * rng.randrange(60_000) if rng.random() < 0.05 else "z"])) for c, n in enumerate([90, 1, 400, 2, 130]) for i in range(n)]
    chunks = spark.createDataFrame(rows, "run_id string, original_filename string, chunk_index int, chunk_id string, text string").repartition(3)
    got = {(r["run_id"], r["chunk_id"]): r["batch_no"] for r in batching.greedy_batches(chunks, ORDER, most, most_rows, segment).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1:4])
        want |= {(c, r[3]): n for r, n in zip(own, plain([len(r[4] or "") + P.BATCH_OVERHEAD for r in own], most, most_rows))}
    assert got == want


def test_a_case_of_many_chunks(spark):
    """One case of 400,000 chunks over all partitions, against the loop on the driver."""
    n = 400_000
    chunks = spark.range(n).select(F.lit("r").alias("run_id"), F.lit("f").alias("original_filename"), F.col("id").cast("int").alias("chunk_index"), F.col("id").cast("string").alias("chunk_id"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 97).cast("int")).alias("text"))
    got = batching.greedy_batches(chunks, ("original_filename", "chunk_index", "chunk_id"))
    want = plain([i * 7919 % 97 + P.BATCH_OVERHEAD for i in range(n)], P.BATCH_CHARS, None)
    numbers = dict(got.select(F.col("chunk_id").cast("int"), "batch_no").toPandas().itertuples(index=False))
    assert [numbers[i] for i in range(n)] == want


def test_no_chunks(spark):
    assert batching.greedy_batches(spark.createDataFrame([], "run_id string, original_filename string, chunk_index int, chunk_id string, text string"), ORDER).count() == 0
    with pytest.raises(ValueError):
        batching.greedy_batches(spark.createDataFrame([], "run_id string, original_filename string, chunk_index int, chunk_id string, text string"), ORDER, 0)


def test_segments_are_assigned_one_at_a_time():
    """A batch of many segments gives a batch of rows for each, made before the next one is read."""
    n, sizes = 50, np.full(100, 7, np.int64)
    batch = pa.RecordBatch.from_pydict({"run_id": [None] + ["r"] * (n - 1), "ids": [[f"{i}-{j}" for j in range(100)] for i in range(n)], "sizes": [sizes.tobytes()] * n, "entry": [0] * n, "begun": list(range(n))})

    class Spied:
        num_rows = n

        def column(self, name):
            return batch.column(name)

        def to_pylist(self):
            raise AssertionError("the whole batch became Python objects")

    out = list(batching._assign(70, None)([Spied()]))
    assert len(out) == n and out[0].column("run_id").to_pylist() == [None] * 100
    assert out[3].column("chunk_id").to_pylist() == [f"3-{j}" for j in range(100)] and out[3].column("batch_no").to_pylist() == [3 + j // 10 for j in range(100)]
