"""Problem 6: percentiles with bounded relative error from log-bucket counts that add up."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.operators.skewed_keys import TERM_SQL
from lodeweave.operators.terms import complete_quads, dictionary, resolve_ids, term_aliases

ALPHA = 0.01
QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def bucket_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """(``keys``, ``sign``, ``bucket``, ``n``): how many values lie in each signed logarithmic bucket.

    Bucket i holds magnitudes in (g^(i-1), g^i], g = (1 + alpha) / (1 - alpha); zero has sign 0. Null, NaN
    and infinite values don't count. A key has at most about 142,000 / (200 alpha) buckets of doubles, whatever
    its number of values.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    v, g = F.col(value), (1 + alpha) / (1 - alpha)
    sign = F.when(v > 0, 1).when(v < 0, -1).otherwise(0)
    bucket = F.when(v != 0, F.ceil(F.log(F.abs(v)) / F.lit(math.log(g)))).otherwise(F.lit(0)).cast("long")
    finite = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    n = F.sum(weight) if weight else F.count("*")
    return finite.groupBy(*keys, sign.alias("sign"), bucket.alias("bucket")).agg(n.alias("n"))


def merge_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket counts of coarser ``keys``: those of partitions, days or runs, added up."""
    return counts.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES, alpha: float = ALPHA) -> DataFrame:
    """(``keys``, ``quantile``, ``estimate``, ``n_values``) from bucket counts of ``keys``.

    The q-quantile is the value of rank ceil(q n), 1 at least; its estimate differs by at most ``alpha`` of
    its magnitude. Only buckets are sorted, of which a key has a bounded number. Keys without counts have
    no rows.
    """
    g = (1 + alpha) / (1 - alpha)
    mid = F.col("sign") * F.pow(F.lit(g), F.col("bucket")) * F.lit(2 / (g + 1))
    w = Window.partitionBy(*keys)
    ordered = w.orderBy("sign", F.col("sign") * F.col("bucket"))
    cum = counts.withColumn("_hi", F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n_values", F.sum("n").over(w))
    q = F.explode(F.array(*[F.lit(float(x)) for x in quantiles]))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("quantile") * F.col("n_values"), 6)))
    hit = cum.select("*", q.alias("quantile")).where((F.col("_hi") >= rank) & (F.col("_hi") - F.col("n") < rank))
    return hit.select(*keys, "quantile", mid.alias("estimate"), "n_values")


def numeric_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``p``, ``batch_day``, ``num``, ``n``) of complete quads with a finite number, ``p`` as term id.

    Quads are first counted by predicate, day and object, so that no object is hot in the join with the dictionary, which
    grows with the data and is shuffled like them.
    """
    quads = complete_quads(spark, sf_dir, "batch_day").groupBy("p", "batch_day", "o").agg(F.count("*").alias("n"))
    numbers = dictionary(spark, sf_dir).where("kind = 'number' and num is not null and not isnan(num) and abs(num) < double('infinity')").select(F.col("id").alias("o"), "num")
    joined = quads.join(numbers.hint("merge"), "o").select("p", "batch_day", "num", "n")
    return resolve_ids(joined, term_aliases(spark, sf_dir), ["p"])


def p6_daily_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket counts per predicate and day: the partial results that can be kept and added."""
    return bucket_counts(numeric_objects(spark, sf_dir), ["p", "batch_day"], "num", "n")


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven percentiles per predicate, from the daily counts."""
    out = percentiles(merge_counts(p6_daily_sketch(spark, sf_dir), ["p"]), ["p"])
    return out.select("p", "quantile", F.round("estimate", 6).alias("estimate"), "n_values")


_G = f"ln({1 + ALPHA!r}::DOUBLE / {1 - ALPHA!r}::DOUBLE)"
_SQL = f"""WITH {TERM_SQL},
v AS (SELECT coalesce(b.t, q.p) AS p, q.batch_day, c.num FROM quads q LEFT JOIN tid b ON b.id = q.p JOIN tid c ON c.id = q.o
  WHERE q.s IS NOT NULL AND q.p IS NOT NULL AND c.kind = 'number' AND isfinite(c.num)),
k AS (SELECT p, batch_day, CAST(sign(num) AS INT) AS sign, CASE WHEN num = 0 THEN 0 ELSE CAST(ceil(ln(abs(num)) / {_G}) AS BIGINT) END AS bucket, count(*) AS n FROM v GROUP BY ALL),
"""
QUERIES = {"p6_percentiles": p6_percentiles, "p6_daily_sketch": p6_daily_sketch}
ORACLE = {
    "p6_daily_sketch": _SQL[:-2] + " SELECT p, batch_day, sign, bucket, n FROM k",
    "p6_percentiles": _SQL
    + f"""m AS (SELECT p, sign, bucket, sum(n) AS n FROM k GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY p ORDER BY sign, sign * bucket) AS hi, sum(n) OVER (PARTITION BY p) AS n_values FROM m),
q AS (SELECT unnest({list(QUANTILES)!r}::DOUBLE[]) AS quantile)
SELECT p, quantile, round(sign * pow({(1 + ALPHA) / (1 - ALPHA)!r}::DOUBLE, bucket) * {2 / ((1 + ALPHA) / (1 - ALPHA) + 1)!r}::DOUBLE, 6) AS estimate, CAST(n_values AS BIGINT) AS n_values
FROM c, q WHERE hi >= greatest(1, ceil(round(quantile * n_values, 6))) AND hi - n < greatest(1, ceil(round(quantile * n_values, 6)))""",
}
