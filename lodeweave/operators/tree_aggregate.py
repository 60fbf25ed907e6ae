"""Aggregation by key where a few keys hold most rows: combine chunks of a heavy key, then merge states level by level."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.plans.lineage import cut

CHUNK_ROWS = 262_144
FAN_IN = 32
#: Rows of the table of measured loads, whatever the number of keys; what makes it fit a broadcast.
LOAD_BUCKETS = 65_536


def heavy_loads(df: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """(``_b``, ``_chunks``): hash buckets of keys with more than ``chunk_rows`` rows, and the chunks their keys are cut into.

    A bucket has at least the rows of each of its keys, so that no key outside of these buckets is heavy.
    """
    n = df.groupBy(_bucket(keys).alias("_b")).agg(F.count("*").alias("n"))
    return cut(n.where(F.col("n") > chunk_rows).select("_b", F.ceil(F.col("n") / chunk_rows).cast("int").alias("_chunks")), "loads")


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(LOAD_BUCKETS)).cast("int")


def tree_aggregate(
    df: DataFrame, keys: list[str], init: Mapping[str, Column], merge: Mapping[str, Column], spread: list[str], within: Mapping[str, Column] | None = None, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN
) -> DataFrame:
    """One row per key with the states of ``init``, merged by ``merge`` (name to aggregate over that name).

    The rows of heavy keys, by measured counts, fall into chunks of about ``chunk_rows`` by a hash of ``spread``; each chunk is
    combined on its own, then ``fan_in`` chunks at a time are merged until one is left. No task receives
    more than a chunk, or ``fan_in`` states, of one key. All other keys are combined in one step and take no part in the
    rounds. The chunk of a row depends on its values only, so that a stage computed again after a lost executor gives
    the same states.

    ``within`` first aggregates the rows of equal ``spread`` in a key (to count them once, say). They share a chunk, so
    that this needs no shuffle of its own.

    Null keys form a group of their own; an empty input gives no row.
    """
    if fan_in < 2 or chunk_rows < 1:
        raise ValueError("fan_in must be at least 2, chunk_rows at least 1")
    loads = heavy_loads(df, keys, chunk_rows)
    most = loads.agg(F.max("_chunks")).first()[0] or 1

    def combined(rows: DataFrame, group: list[str]) -> DataFrame:
        if within:
            rows = rows.repartition(*group).groupBy(*group, *spread).agg(*[c.alias(n) for n, c in within.items()])
        return rows.groupBy(*group).agg(*[c.alias(n) for n, c in init.items()])

    if most == 1:
        return combined(df, keys)
    marked = df.withColumn("_b", _bucket(keys)).join(F.broadcast(loads), "_b", "left").drop("_b")  # at most LOAD_BUCKETS rows
    light = combined(marked.where("_chunks is null"), keys)
    heavy = marked.where("_chunks is not null").withColumn("_chunk", F.pmod(F.xxhash64(*spread), F.col("_chunks").cast("long")))
    level = combined(heavy, [*keys, "_chunk"])
    while most > 1:
        most = math.ceil(most / fan_in)
        level = level.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in)).groupBy(*keys, "_chunk").agg(*[c.alias(n) for n, c in merge.items()])
    return light.unionByName(level.drop("_chunk"))


def predicate_figures(quads: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """For each predicate of complete quads: ``n_quads``, ``n_triples`` (distinct), ``n_objects``, and the
    object that occurs with the most distinct subjects (``top_object``, the smallest id among equals)
    with their number (``top_subjects``).

    Repeated quads count in ``n_quads`` only. Rows with a null in ``s``, ``p`` or ``o`` don't count;
    further columns are ignored; no rows give no rows.
    """
    q = quads.select("s", "p", "o").where("s is not null and p is not null and o is not null")
    pairs = tree_aggregate(
        q, ["p", "o"],
        {"quads": F.sum("n"), "subjects": F.count("*")},
        {"quads": F.sum("quads"), "subjects": F.sum("subjects")},
        ["s"], {"n": F.count("*")}, chunk_rows, fan_in,
    )
    # Counts as a struct: the larger count, then the smaller object.
    top = F.struct(F.col("subjects").alias("subjects"), (-F.col("o")).alias("neg_o"))
    out = tree_aggregate(
        cut(pairs, "pairs"), ["p"],
        {"n_quads": F.sum("quads"), "n_triples": F.sum("subjects"), "n_objects": F.count("*"), "top": F.max(top)},
        {"n_quads": F.sum("n_quads"), "n_triples": F.sum("n_triples"), "n_objects": F.sum("n_objects"), "top": F.max("top")},
        ["o"], None, chunk_rows, fan_in,
    )
    return out.select("p", "n_quads", "n_triples", "n_objects", (-F.col("top.neg_o")).alias("top_object"), F.col("top.subjects").alias("top_subjects"))
