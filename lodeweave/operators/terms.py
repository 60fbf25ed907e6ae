"""Dictionary terms: long forms of URIs, equality of terms, and replacing ids by term ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.plans.lineage import cut
from lodeweave.plans.sizing import BROADCAST_ROWS, broadcast_if_small
from lodeweave.session import table


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``terms`` and ``vocab`` together, rows without id left out."""
    return table(spark, sf_dir, "terms").unionByName(table(spark, sf_dir, "vocab")).where("id is not null")


def with_long_form(terms: DataFrame, prefixes: DataFrame, value: str = "value", kind: str = "kind") -> DataFrame:
    """Adds ``long``: the URI with its prefix replaced by the namespace, other values unchanged."""
    ns = prefixes.where("prefix is not null and ns is not null").groupBy("prefix").agg(F.min("ns").alias("_ns"))
    head = F.when((F.col(kind) == "uri") & F.col(value).contains(":"), F.substring_index(F.col(value), ":", 1))
    out = terms.withColumn("_prefix", head).join(ns.withColumnRenamed("prefix", "_prefix"), "_prefix", "left")
    rest = F.expr(f"substring({value}, length(_prefix) + 2)")
    long = F.when(F.col("_ns").isNotNull(), F.concat("_ns", rest)).otherwise(F.col(value))
    return out.withColumn("long", long).drop("_prefix", "_ns")


def term_key(kind: str = "kind", num: str = "num", long: str = "long") -> Column:
    """Equal terms have equal keys: URIs the long form, numbers ``num``, others kind and value.
    A number without ``num`` counts by its value; -0.0 is 0.0; NaN equals NaN."""
    by_num = F.concat(F.lit("number\t"), (F.col(num) + F.lit(0.0)).cast("string"))
    by_value = F.concat(F.coalesce(F.col(kind), F.lit("")), F.lit("\t\t"), F.coalesce(F.col(long), F.lit("")))
    return F.when((F.col(kind) == "number") & F.col(num).isNotNull(), by_num).otherwise(by_value)


def term_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``id``, ``term_id``) of every id that isn't the smallest among its equal terms."""
    keyed = with_long_form(dictionary(spark, sf_dir).select("id", "kind", "value", "num"), table(spark, sf_dir, "prefixes"))
    keyed = keyed.select("id", term_key().alias("key"))
    several = keyed.groupBy("key").agg(F.min("id").alias("term_id"), F.max("id").alias("_max")).where("_max > term_id")
    return cut(keyed.join(several, "key").where("id > term_id").select("id", "term_id").distinct(), "aliases")


def resolve_ids(df: DataFrame, aliases: DataFrame, cols: list[str], limit: int = BROADCAST_ROWS, few: tuple[str, ...] = ("p",)) -> DataFrame:
    """``df`` with the ids in ``cols`` replaced by their term ids; ids without alias, and nulls, stay.

    A small alias table is broadcast. A larger one is joined by shuffle, where adaptive execution splits
    hot ids; columns in ``few`` (predicates) first reduce it to the ids that occur there.
    """
    hinted = broadcast_if_small(aliases, limit)
    for col in cols:
        side = hinted
        if side is aliases and col in few:
            side = broadcast_if_small(aliases.join(df.select(F.col(col).alias("id")).distinct(), "id", "left_semi"), limit)
        side = side.select(F.col("id").alias("_from"), F.col("term_id").alias("_to"))
        df = df.join(side, df[col] == side["_from"], "left").withColumn(col, F.coalesce("_to", col)).drop("_from", "_to")
    return df


def complete_quads(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Quads with subject, predicate and object; ``cols`` besides ``s``, ``p``, ``o``."""
    return table(spark, sf_dir, "quads").select("s", "p", "o", *cols).where("s is not null and p is not null and o is not null")
