"""Versioned tables: data files that are never changed, and a log of numbered commits that says which of them count.

A writer first writes new data files, then tries to create the next commit
file. Only one writer can create a number, and the file appears whole, so a
reader sees the highest number's state and nothing of a write that failed or is
still going on. A table may be cut into buckets by a hash of its key; a change
then writes the buckets of its keys alone, and the commit names those only.
Every tenth commit holds the whole state, so a reader opens ten files at most.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

WHOLE_EVERY = 10
#: The bucket column inside data folders, and the bucket of a table that has none.
_BUCKET, _ALL = "_bucket", "-"
#: While keys are replaced: a part of a bucket, and where a row comes from.
_PART, _SIDE, _OLD, _NEW, _LISTED = "_part", "_side", 0, 1, 2


@dataclass
class Table:
    """What a commit says of a table: its columns, its key and number of buckets, and each bucket's folders below the root."""

    schema: str
    key: str | None = None
    buckets: int = 0
    files: dict[str, list[str]] = field(default_factory=dict)


@dataclass
class Snapshot:
    """All tables at one commit. ``marks`` holds the last batch that each stream has committed."""

    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)

    def files(self, name: str, buckets: Iterable[str] | None = None) -> list[str]:
        held = self.tables[name].files
        return [f for b in (held if buckets is None else buckets) for f in held.get(b, [])]


@dataclass
class Change:
    """Part of a commit: ``whole`` tables replace what there was, ``buckets`` replace those buckets, ``appended`` folders are added.

    ``reads`` are the (table, bucket) that the change was made from; another
    commit that touched one of them makes it outdated.
    """

    whole: dict[str, Table] = field(default_factory=dict)
    buckets: dict[str, Table] = field(default_factory=dict)
    appended: dict[str, Table] = field(default_factory=dict)
    reads: set[tuple[str, str]] = field(default_factory=set)

    def __or__(self, other: Change) -> Change:
        return Change(self.whole | other.whole, self.buckets | other.buckets, self.appended | other.appended, self.reads | other.reads)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its content in one step, unless it is there.

    The content goes to a file of another name first. A local folder then links
    it to its name; other stores rename it, which must not replace a file (as in HDFS).
    """
    store, place = _place(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}.draft")
    out = store.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if store.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), place.toUri().getPath())
            except FileExistsError:
                return False
            return True
        if store.exists(place):
            return False
        try:
            return store.rename(draft, place)
        except Exception as refused:
            if "FileAlreadyExists" in str(refused):
                return False
            raise
    finally:
        store.delete(draft, False)


def _names(spark: SparkSession, path: str) -> dict[str, int]:
    """Names below a folder, with the time of their last change in seconds."""
    store, place = _place(spark, path)
    if not store.exists(place):
        return {}
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in store.listStatus(place)}


def _log(root: str, number: int) -> str:
    return f"{root}/_log/{number:020d}.json"


def _entry(spark: SparkSession, root: str, number: int) -> dict:
    store, place = _place(spark, _log(root, number))
    stream = store.open(place)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _apply(held: Snapshot, number: int, change: dict) -> Snapshot:
    if change["base"]:  # the whole state
        held = Snapshot()
    tables = {n: Table(t.schema, t.key, t.buckets, dict(t.files)) for n, t in held.tables.items()}
    for name, t in change["whole"].items():
        tables[name] = Table(**t)
    for name, t in change["buckets"].items():
        own = tables.setdefault(name, Table(t["schema"], t["key"], t["buckets"]))
        own.schema = t["schema"]
        own.files |= t["files"]
    for name, t in change["appended"].items():
        own = tables.setdefault(name, Table(t["schema"]))
        own.schema = t["schema"]
        own.files[_ALL] = own.files.get(_ALL, []) + t["files"][_ALL]
    return Snapshot(number, tables, held.marks | change["marks"])


def history(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all commits, ascending."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{root}/_log") if n.endswith(".json"))


def snapshot(spark: SparkSession, root: str, number: int | None = None) -> Snapshot:
    """The tables at a commit, by default the highest; without any commit there are no tables."""
    numbers = history(spark, root)
    if number is not None:
        if number not in numbers:
            raise ValueError(f"{root} has no version {number}")
        numbers = [n for n in numbers if n <= number]
    entries = []
    for at in reversed(numbers):
        entries.append((at, _entry(spark, root, at)))
        if entries[-1][1]["base"]:
            break
    if entries and numbers[-len(entries) :] != list(range(entries[-1][0], numbers[-1] + 1)):
        raise RuntimeError(f"the log of {root} has a gap")
    held = Snapshot()
    for at, entry in reversed(entries):
        held = _apply(held, at, entry)
    return held


def commit(spark: SparkSession, root: str, make: Callable[[Snapshot], Change], *, mark: tuple[str, int] | None = None, attempts: int = 100) -> int:
    """Make a change from the latest state and commit it under the next number; the number.

    If another writer takes the number, the change stands as it is as long as
    nothing that it was made from has changed; else it is made again. ``mark``
    (stream, batch): a batch that the log already holds is left out.
    """
    change, base = None, Snapshot()
    for _ in range(attempts):
        held = snapshot(spark, root)
        if mark and held.marks.get(mark[0], -1) >= mark[1]:
            return held.number
        state = lambda at, name, bucket: (at.tables[name].schema, at.files(name) if bucket == _ALL else at.files(name, [bucket])) if name in at.tables else None
        if change is None or any(state(base, *r) != state(held, *r) for r in change.reads):
            change, base = make(held), held
        entry = {"base": False, "whole": {n: vars(t) for n, t in change.whole.items()}, "buckets": {n: vars(t) for n, t in change.buckets.items()}, "appended": {n: vars(t) for n, t in change.appended.items()}, "marks": dict([mark] if mark else [])}
        if (held.number + 1) % WHOLE_EVERY == 0:
            after = _apply(held, held.number + 1, entry)
            entry = {"base": True, "whole": {n: vars(t) for n, t in after.tables.items()}, "buckets": {}, "appended": {}, "marks": after.marks}
        if put_if_absent(spark, _log(root, held.number + 1), json.dumps(entry)):
            return held.number + 1
    raise RuntimeError(f"other writers took {attempts} numbers in a row")


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def write_whole(df: DataFrame, root: str, key: str | None = None, buckets: int = 0, *, dealt: bool = False) -> Table:
    """New data files with all rows of ``df``; ``dealt``: it has the bucket column and lies by it."""
    spark, folder = df.sparkSession, f"data/{uuid.uuid4().hex}"
    if not key:
        df.write.parquet(f"{root}/{folder}")
        return Table(df.schema.json(), files={_ALL: [folder]})
    # rebalanced: a bucket with much more than its share is split over tasks, small ones share a task
    placed = df if dealt else df.withColumn(_BUCKET, bucket_of(key, buckets)).hint("rebalance", F.col(_BUCKET))
    placed.write.partitionBy(_BUCKET).parquet(f"{root}/{folder}")
    made = [n for n in _names(spark, f"{root}/{folder}") if n.startswith(f"{_BUCKET}=")]
    return Table(df.drop(_BUCKET).schema.json(), key, buckets, {n.split("=")[1]: [f"{folder}/{n}"] for n in made})


def read(spark: SparkSession, root: str, name: str, *, at: Snapshot | int | None = None, buckets: Iterable[str] | None = None) -> DataFrame:
    """A table at a version, or some of its buckets; columns that older files lack are null."""
    held = at if isinstance(at, Snapshot) else snapshot(spark, root, at)
    if name not in held.tables:
        raise LookupError(f"{root} has no table {name}")
    schema = StructType.fromJson(json.loads(held.tables[name].schema))
    files = [f"{root}/{f}" for f in held.files(name, buckets)]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def buckets_of(table: Table, keys: DataFrame) -> list[str]:
    """The buckets that hold the keys of ``keys``: as many as the table has, at most."""
    return [str(r[0]) for r in keys.select(bucket_of(table.key, table.buckets)).distinct().collect()]


def read_keys(spark: SparkSession, root: str, name: str, keys: DataFrame, *, at: Snapshot | int | None = None) -> DataFrame:
    """The rows of the given keys; files of other buckets are not read."""
    held = at if isinstance(at, Snapshot) else snapshot(spark, root, at)
    table = held.tables[name]
    asked = keys.select(table.key).distinct()
    return read(spark, root, name, at=held, buckets=buckets_of(table, asked)).join(asked, table.key, "left_semi")


def replace_keys(spark: SparkSession, root: str, held: Snapshot, name: str, keys: DataFrame, new: DataFrame, *, key: str, buckets: int) -> Change:
    """All rows of the given keys go, then ``new`` comes (whose keys are among them): only their buckets are read and written.

    Old and new rows are dealt out once, by the bucket that they are written to, and meet by key there.
    """
    table = held.tables.get(name, Table(new.schema.json(), key, buckets))
    if table.key != key:
        raise ValueError(f"{name} has the key {table.key}")
    touched = buckets_of(table, keys)
    if name in held.tables:
        made = write_whole(_replaced(read(spark, root, name, at=held, buckets=touched), keys, new, key, table.buckets), root, key, table.buckets, dealt=True)
    else:
        made = write_whole(new, root, key, table.buckets)
    return Change(buckets={name: Table(made.schema, key, table.buckets, {b: made.files.get(b, []) for b in touched})}, reads={(name, b) for b in touched})


def _replaced(old: DataFrame, keys: DataFrame, new: DataFrame, key: str, buckets: int) -> DataFrame:
    """Old rows whose key isn't listed, and the new rows, with their bucket; a bucket is cut in parts if there are fewer buckets than shuffle partitions."""
    side = lambda t, s: t.withColumn(_SIDE, F.lit(s))
    rows = side(old, _OLD).unionByName(side(new, _NEW), allowMissingColumns=True)
    if keys is not new:
        rows = rows.unionByName(side(keys.select(key), _LISTED), allowMissingColumns=True)
    parts = -(-int(old.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    rows = rows.withColumns({_BUCKET: bucket_of(key, buckets), _PART: F.pmod(F.shiftright(F.xxhash64(F.col(key)), 32), F.lit(parts))})
    last = F.max(_SIDE).over(W.partitionBy(_BUCKET, _PART, key))
    kept = rows.repartition(_BUCKET, _PART).withColumn("_last", last)
    # a row without a key is like no other
    return kept.where((F.col(_SIDE) == _NEW) | ((F.col(_SIDE) == _OLD) & ((F.col("_last") == _OLD) | F.col(key).isNull()))).drop(_SIDE, _PART, "_last")


def append(df: DataFrame, root: str, name: str) -> Change:
    return Change(appended={name: write_whole(df, root)})


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Several tables as a whole, in one commit; tables that aren't named stay as they are."""
    made = Change(whole={name: write_whole(t, root) for name, t in tables.items()})
    return commit(spark, root, lambda held: made)


def rewrite(spark: SparkSession, root: str, make: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> int:
    """Tables made from the tables that are there; made again if another commit changes one of these meanwhile."""

    def change(held: Snapshot) -> Change:
        old = {name: read(spark, root, name, at=held) for name in held.tables}
        made = make(old)
        return Change(whole={name: write_whole(t, root) for name, t in made.items()}, reads={(name, _ALL) for name in {*old, *made}})

    return commit(spark, root, change)


def vacuum(spark: SparkSession, root: str, *, keep: int = 2, least_age: float = 7 * 86_400) -> list[str]:
    """Delete data folders that none of the last ``keep`` versions names and that are older than ``least_age`` seconds: what failed or outdated writes left behind. Returns them."""
    numbers = history(spark, root)[-keep:]
    used = {f.split("/")[1] for n in numbers for name, t in snapshot(spark, root, n).tables.items() for f in sum(t.files.values(), [])}
    gone = [n for n, changed in _names(spark, f"{root}/data").items() if n not in used and changed <= time.time() - least_age]
    for name in gone:
        store, place = _place(spark, f"{root}/data/{name}")
        store.delete(place, True)
    return gone
