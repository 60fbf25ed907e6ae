"""Problem 1: the best N candidates of every prediction task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.session import table


def comparable(confs: Column) -> Column:
    """An array that compares as ``confs`` padded with zeros: null, NaN and negative entries count as 0,
    trailing zeros go, one zero ends it."""
    clean = F.transform(F.coalesce(confs, F.array().cast("array<double>")), lambda x: F.when((x > 0) & ~F.isnan(x), x).otherwise(F.lit(0.0)))
    last = F.aggregate(
        F.transform(clean, lambda x, i: F.when(x > 0, i + 1).otherwise(F.lit(0))), F.lit(0), lambda a, b: F.greatest(a, b)
    )
    return F.concat(F.slice(clean, F.lit(1), last), F.array(F.lit(0.0)))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in ``order`` (a total order), with their ``rank`` from 1.

    The rank filter lets the optimiser put a group limit before and after the shuffle, so that a task
    sends at most ``n`` rows of a group however many it holds. Null keys are a group.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def top_candidates(tasks: DataFrame, n: int = 10) -> DataFrame:
    """``p``, ``fixed_side``, ``fixed_value``, ``rank``, ``candidate``, ``score`` of the ``n`` best candidates.

    Higher score first, then the larger ``confs`` entry by entry (missing entries are 0), then the smaller
    candidate. Rows without candidate or score (null, NaN) don't count; a candidate listed several times
    counts by its best row; a side counts by its name without case and blanks. Extra columns (a stale
    ``rank`` too) are ignored; no rows give no rows.
    """
    side = F.lower(F.regexp_replace("fixed_side", r"[\s\p{Z}]+", ""))
    rows = tasks.where("candidate is not null and score is not null and not isnan(score)").select(
        "p", side.alias("fixed_side"), "fixed_value", "candidate", (F.col("score") + F.lit(0.0)).alias("score"), comparable(F.col("confs")).alias("confs")
    )
    keys = ["p", "fixed_side", "fixed_value"]
    best = top_per_group(rows, [*keys, "candidate"], [F.desc("score"), F.desc("confs")], 1, "_best").drop("_best")
    out = top_per_group(best, keys, [F.desc("score"), F.desc("confs"), F.asc("candidate")], n)
    return out.select(*keys, "rank", "candidate", "score")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of each task."""
    return top_candidates(table(spark, sf_dir, "tasks")).select("p", "fixed_side", "fixed_value", "candidate")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with rank and score."""
    return top_candidates(table(spark, sf_dir, "tasks"))


_SQL = """WITH r AS (
  SELECT p, lower(regexp_replace(fixed_side, '\\s+', '', 'g')) AS fixed_side, fixed_value, candidate, score,
    coalesce(confs[1], 0) AS c1, coalesce(confs[2], 0) AS c2, coalesce(confs[3], 0) AS c3
  FROM tasks WHERE candidate IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
b AS (SELECT *, row_number() OVER (PARTITION BY p, fixed_side, fixed_value, candidate ORDER BY score DESC, c1 DESC, c2 DESC, c3 DESC) AS n FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY p, fixed_side, fixed_value ORDER BY score DESC, c1 DESC, c2 DESC, c3 DESC, candidate) AS rank FROM b WHERE n = 1)
SELECT {} FROM t WHERE rank <= 10"""
QUERIES = {"p1_found": p1_found, "p1_ranked": p1_ranked}
ORACLE = {
    "p1_found": _SQL.format("p, fixed_side, fixed_value, candidate"),
    "p1_ranked": _SQL.format("p, fixed_side, fixed_value, CAST(rank AS INT) AS rank, candidate, score"),
}
