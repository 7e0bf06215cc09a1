"""Small helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Fixed value: the white space of the contracts, `[\x20\x09-\x0D]`.
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def partitions_for(spark, rows: int, rows_each: int) -> int:
    """Partitions of about ``rows_each`` rows; never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each), 1)


#: Rows of one number of a table that may be sent to all executors.
SENT_ROWS = 1_000_000


def sent_if_small(table: DataFrame) -> DataFrame:
    """``table``, which is written and narrow, as a broadcast side of a join if it has at most SENT_ROWS rows; else both sides are shuffled."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table
