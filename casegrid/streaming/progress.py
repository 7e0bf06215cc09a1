"""Progress of workers and of indexing as keyed streams: numbered log lines are folded in their order, however they arrive.

The state of a key is what the fold has so far, the number of the next line,
and the lines that came before their turn. A line that is missing for longer
than a time-out is skipped and counted, so a lost line never stops a key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from casegrid.functions import patterns as P
from casegrid.sources import versions

#: Hash groups of keys that are folded in one call; the lines that are made Python strings at a time.
GROUPS, _SLICE = 1024, 4096
_LINES = pa.schema([("__key", pa.large_string()), ("line_no", pa.int64()), ("line", pa.large_string())])
#: Columns that every progress table has besides its own.
_COUNTS = "lines bigint, waiting bigint, late bigint, skipped bigint"


def _packed(lines: pa.Table) -> bytes:
    """Lines that wait, as a compressed Arrow stream: a few bytes each, where Python objects would take hundreds."""
    if not lines.num_rows:
        return b""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _LINES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(lines)
    return out.getvalue().to_pybytes()


def _unpacked(early: bytes) -> pa.Table:
    return pa.ipc.open_stream(early).read_all()


def fold_in_order(lines: DataFrame, key: str, begin: dict, step: Callable[[dict, str], None], rows: Callable[[dict], list[dict]], schema: str, *, patience: str = "10 minutes", first: int = 1) -> DataFrame:
    """A stream (key, line_no, line and, if it has one, total) -> the rows that ``rows`` makes of a key's state, whenever it changes.

    ``step`` changes the state by one line. Lines of a key are numbered from
    ``first``; a number that was applied or skipped before is late and only
    counted. ``waiting`` counts the lines that still miss one before them.
    Keys are folded in GROUPS hash groups, as a call costs milliseconds whatever it holds.
    """
    wait = int(lines.sparkSession.sql(f"SELECT timestampdiff(MILLISECOND, timestamp '2000-01-01', timestamp '2000-01-01' + interval {patience})").first()[0])
    has_total = "total" in lines.columns

    def run(_, frames, state):
        now = state.getCurrentProcessingTimeMs()
        # of each key: the next number, late and skipped lines, the fold, and when what waits is given up (null: nothing waits)
        told, early = state.get if state.exists else ("{}", b"")
        heads, parts, fresh, totals = json.loads(told), [_unpacked(early)] if early else [], set(), {}
        for frame in [] if state.hasTimedOut else frames:
            parts.append(pa.table([pa.array(frame["__key"], pa.large_string()), pa.array(frame["line_no"], pa.int64()), pa.array(frame["line"].fillna(""), pa.large_string())], schema=_LINES))
            fresh.update(frame["__key"].unique())
            if has_total:
                for k, n in frame.groupby("__key")["total"].max().dropna().items():
                    totals[k] = max(int(n), totals.get(k, int(n)))
        given_up = {k for k, h in heads.items() if k not in fresh and h[4] is not None and h[4] <= now}
        table = pa.concat_tables(parts).sort_by([(c, "ascending") for c in _LINES.names]).combine_chunks() if parts else _LINES.empty_table()
        del parts
        codes, numbers = table["__key"].combine_chunks().dictionary_encode(), table["line_no"].to_numpy()
        names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        bounds = [*np.flatnonzero(np.diff(codes, prepend=-1)).tolist(), len(codes)]
        stays, changed = np.ones(len(codes), bool), []
        for a, b in zip(bounds, bounds[1:]):
            name = names[codes[a]]
            if name not in fresh and name not in given_up:
                continue
            at, late, skipped, held, _ = heads.get(name) or [first, 0, 0, json.loads(json.dumps(begin)), None]
            if has_total and name in fresh:
                held["total"] = totals.get(name, held.get("total", 0))
            i = a
            for start in range(a, b, _SLICE):
                for number, line in zip(numbers[start : min(b, start + _SLICE)].tolist(), table["line"].slice(start, min(b - start, _SLICE)).to_pylist(), strict=True):
                    if number > at and name in fresh:
                        break
                    i += 1
                    if number < at:
                        late += 1
                        continue
                    skipped += number - at
                    at = number + 1
                    held["lines"] = held.get("lines", 0) + 1
                    step(held, line)
                if i < min(b, start + _SLICE):
                    break
            stays[a:i] = False
            heads[name] = [at, late, skipped, held, now + wait if i < b else None]
            counts = {"lines": held.get("lines", 0), "waiting": b - i, "late": late, "skipped": skipped}
            changed.append((name, json.dumps([r | counts for r in rows(held)])))
        state.update((json.dumps(heads), _packed(table.filter(pa.array(stays)))))
        if waits := [h[4] for h in heads.values() if h[4] is not None]:
            state.setTimeoutDuration(max(1, min(waits) - now))
        yield pd.DataFrame(changed, columns=["__key", "made"])

    text = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit(""))  # a null key is a key, too
    dealt = lines.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("__group"), text.alias("__key"), F.col("line_no").cast("bigint").alias("line_no"), "line", *(["total"] if has_total else []))
    made = dealt.groupBy("__group").applyInPandasWithState(run, "__key string, made string", "told string, early binary", "update", GroupStateTimeout.ProcessingTimeTimeout)
    own, rest = schema.split(", ", 1)
    fields = ", ".join(c.replace(" ", ":", 1) for c in f"{rest}, {_COUNTS}".split(", "))
    name = F.when(F.col("__key") != "", F.substring("__key", 2, 1 << 30)).cast(own.split(" ", 1)[1]).alias(key)
    return made.select(name, F.inline(F.from_json("made", f"array<struct<{fields}>>")))


# ---- STR2


def _number(pattern: str, line: str) -> int:
    m = re.search(pattern, line)
    return int(float(m[1].replace(",", ""))) if m and re.fullmatch(r"[\d,]*\.?\d*", m[1]) and m[1].strip(".,") else 0


def ocr_step(held: dict, line: str) -> None:
    """One log line of the workers: a table's head or row, or a total. Totals never fall; completed pages end at the run's pages."""
    cells = [c.strip() for c in line.split("|")]
    if P.WORKER_HEAD in line:
        held["head"] = cells
    elif len(cells) > 1 and all(c.isdigit() for c in cells):
        if len(held["head"]) != len(cells):
            held["head"] = P.WORKER_COLUMNS.get(len(cells), held["head"])
        held["workers"].setdefault(str(int(cells[0])), {}).update((name, int(c)) for name, c in list(zip(held["head"], cells))[1:])
        for what, name in (("completed", "finished"), ("failed", "errored")):
            held[what] = max(held[what], sum(w.get(name, 0) for w in held["workers"].values()))
    for what, patterns in P.PAGE_TOTALS.items():
        held[what] = max(held[what], next((n for p in patterns if (n := _number(p, line))), 0))
    if held.get("total", 0) > 0:
        held["completed"] = min(held["completed"], held["total"])


def ocr_progress(lines: DataFrame, key: str = "run_id", **kw) -> DataFrame:
    """STR2: (key, line_no, line, total pages) -> completed and failed pages of each run, monotone and clamped."""
    begin = {"head": [], "workers": {}, "completed": 0, "failed": 0}
    rows = lambda held: [{"workers": len(held["workers"]), "completed_pages": held["completed"], "failed_pages": held["failed"], "total_pages": held.get("total", 0)}]
    kind = lines.schema[key].dataType.simpleString()
    return fold_in_order(lines, key, begin, ocr_step, rows, f"{key} {kind}, workers bigint, completed_pages bigint, failed_pages bigint, total_pages bigint", **kw)


def file_status(files: DataFrame, outputs: DataFrame, failed: DataFrame) -> DataFrame:
    """STR2: files (run_id, file_no, filename, pages) with their status. A file is completed once its Markdown (run_id, output: a name that begins with the file's number) is there; one in ``failed`` (run_id, file_no) has failed in any case."""
    done = outputs.select("run_id", F.regexp_extract("output", r"^(\d+)_.*\.md$", 1).try_cast("bigint").alias("file_no")).where("file_no IS NOT NULL").distinct().withColumn("done", F.lit(True))
    bad = failed.select("run_id", F.col("file_no").cast("bigint").alias("file_no")).distinct().withColumn("bad", F.lit(True))
    joined = files.join(done, ["run_id", "file_no"], "left").join(bad, ["run_id", "file_no"], "left")
    return joined.select("run_id", "file_no", "filename", F.coalesce("pages", F.lit(0)).alias("pages"), F.when(F.col("bad"), "failed").when(F.col("done"), "completed").otherwise("pending").alias("status"))


# ---- STR4


def index_step(held: dict, line: str) -> None:
    """One log line of indexing: the stage that it names (the last one named counts), chunks made, counters."""
    for stage, marks in P.STAGE_MARKS:
        if any(m in line for m in marks):
            held["stage"] = stage
    if m := re.search(P.CHUNKS_CREATED, line):
        held["chunks"] += int(m[1])
    if m := re.search(P.CHUNKS_TO_INDEX, line):
        held["embed"][1] = held["index"][1] = int(m[1])
    for stage, name in (("embed", "embedding"), ("index", "indexing")):
        if m := re.search(P.STAGE_COUNTER.format(name), line):
            held[stage] = [int(m[1]), int(m[2])]


def _index_rows(held: dict) -> list[dict]:
    order = [s for s, _ in P.STAGE_MARKS if s != "done"]
    at, out = order.index(held["stage"]) if held["stage"] in order else len(order), []
    for k, stage in enumerate(order):
        done, total = held.get(stage, (0, 0))
        out.append({
            "stage_no": k + 1, "stage": stage, "status": "success" if k < at else "running" if k == at else "pending", "details": f"{done}/{total} chunks" if total else "",
            "percent": done * 100 // total if total and k == at else None, "chunks": held["chunks"],
        })
    return out


def index_progress(lines: DataFrame, key: str = "run_id", **kw) -> DataFrame:
    """STR4: (key, line_no, line) -> a row for each stage of each run: status by order, counters, chunks created so far."""
    kind = lines.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, stage_no int, stage string, status string, details string, percent int, chunks bigint"
    return fold_in_order(lines, key, {"stage": "prepare", "chunks": 0, "embed": [0, 0], "index": [0, 0]}, index_step, _index_rows, schema, **kw)


# ---- sink


#: Without it a run over what is there would never end: a stream with time-outs asks for batches without data for ever.
_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_to_versions(progress: DataFrame, root: str, name: str, checkpoint: str, key: str = "run_id", buckets: int = 16) -> None:
    """Run a progress stream over what is there; each micro-batch replaces its keys' rows in a versioned table, in one commit.

    Time-outs that are due take effect with the next batch that has data.
    """
    spark = progress.sparkSession

    def write(batch: DataFrame, no: int) -> None:
        if versions.snapshot(spark, root).marks.get(name, -1) >= no:
            return
        batch = batch.persist()
        try:
            versions.commit(batch.sparkSession, root, lambda held: versions.replace_keys(batch.sparkSession, root, held, name, batch, batch, key=key, buckets=buckets), mark=(name, no))
        finally:
            batch.unpersist()

    was = spark.conf.get(_NO_DATA)
    spark.conf.set(_NO_DATA, "false")  # a query keeps the settings that it starts with
    try:
        query = progress.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_NO_DATA, was)
    query.awaitTermination()
