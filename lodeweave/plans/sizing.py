"""Decisions that depend on measured sizes: what may be broadcast, which keys are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of (long, long) up to which a side is broadcast; about 15 MB as a hash table.
BROADCAST_ROWS = 250_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else unchanged (a shuffle join with
    adaptive skew splitting). The count is a distributed one; for a table that ``cut`` wrote it reads the footers only."""
    return F.broadcast(df) if df.count() <= limit else df


def hot_values(df: DataFrame, *cols: str, share: int = 1000, tracked: int = 16_384) -> dict[str, list]:
    """For each of ``cols`` the values that may hold more than 1/``share`` of the rows: at most ``share`` of them.

    Frequent-items sketches in one pass over all rows, merged across partitions. The counts are only used to choose
    a path for a value, never as results.
    """
    sketches = [F.struct(F.count(c).alias("n"), F.expr(f"approx_top_k(`{c}`, {share}, {tracked})").alias("top")).alias(c) for c in cols]
    row = df.agg(*sketches).first()
    return {c: [x["item"] for x in row[c]["top"] or [] if x["item"] is not None and x["count"] * share > row[c]["n"]] for c in cols}
