"""Cardinalities of predicates: sizes, sides, averages, modes, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def property_cardinalities(facts: DataFrame) -> DataFrame:
    """Per predicate: ``size``, ``domain``, ``range``, ``lower_side`` and ``higher_side`` (a tie makes the object
    the lower side), ``average`` values per term of the higher side (halves up), and whether it is a function
    or an inverse function."""
    per_s = facts.groupBy("p", "s").agg(F.count("*").alias("n")).groupBy("p").agg(F.sum("n").alias("size"), F.count("*").alias("domain"))
    per_o = facts.groupBy("p", "o").agg(F.count("*").alias("n")).groupBy("p").agg(F.count("*").alias("range"))
    low_object = F.col("domain") >= F.col("range")
    average = F.floor(F.col("size") / F.when(low_object, F.col("domain")).otherwise(F.col("range")) + 0.5)
    return per_s.join(per_o, "p").select(
        "p", "size", "domain", "range",
        F.when(low_object, "object").otherwise("subject").alias("lower_side"), F.when(low_object, "subject").otherwise("object").alias("higher_side"),
        average.cast("long").alias("average"), (F.col("size") == F.col("domain")).alias("is_function"), (F.col("size") == F.col("range")).alias("is_inverse_function"),
    )


def side_values(facts: DataFrame, cards: DataFrame, which: str) -> DataFrame:
    """(``p``, ``v``, ``n``): values at the ``which`` (higher_side, lower_side) side of each predicate and their triples."""
    sides = cards.select("p", which)
    v = F.when(F.col(which) == "subject", F.col("s")).otherwise(F.col("o"))
    return facts.join(F.broadcast(sides), "p").groupBy("p", v.alias("v")).agg(F.count("*").alias("n"))


def mode_probabilities(facts: DataFrame, cards: DataFrame) -> DataFrame:
    """(``p``, ``mode``, ``mode_count``, ``mode_probability``): the most frequent value of the lower side, among equals the
    smallest id."""
    best = side_values(facts, cards, "lower_side").groupBy("p").agg(F.max(F.struct("n", (-F.col("v")).alias("m"))).alias("b"), F.sum("n").alias("size"))
    return best.select("p", (-F.col("b.m")).alias("mode"), F.col("b.n").alias("mode_count"), (F.col("b.n") / F.col("size")).alias("mode_probability"))


def constant_probabilities(facts: DataFrame, cards: DataFrame) -> DataFrame:
    """(``p``, ``v``, ``probability``) of every value of the lower side."""
    sizes = cards.select("p", "size")
    return side_values(facts, cards, "lower_side").join(F.broadcast(sizes), "p").select("p", "v", (F.col("n") / F.col("size")).alias("probability"))


def pca_negatives(facts: DataFrame, cards: DataFrame) -> DataFrame:
    """(``p``, ``pca_negatives``): for each value of the higher side, the distinct values of the other side it hasn't."""
    other = F.when(F.col("higher_side") == "subject", F.col("range")).otherwise(F.col("domain"))
    own = side_values(facts, cards, "higher_side").join(F.broadcast(cards.select("p", "higher_side", "domain", "range")), "p")
    return own.groupBy("p").agg(F.sum(other - F.col("n")).alias("pca_negatives"))


def neighbours(facts: DataFrame, left: str, right: str) -> DataFrame:
    """(``p1``, ``p2``, ``n``): pairs of triples of two predicates whose ``left`` and ``right`` sides (s, o) are the
    same term; a triple isn't paired with itself. Computed from counts per predicate and term."""
    a = facts.groupBy(F.col("p").alias("p1"), F.col(left).alias("t")).agg(F.count("*").alias("n1"))
    b = facts.groupBy(F.col("p").alias("p2"), F.col(right).alias("t")).agg(F.count("*").alias("n2"))
    pairs = a.join(b, "t").groupBy("p1", "p2").agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))
    own = facts if left == right else facts.where("s = o")
    selfs = own.groupBy("p").agg(F.count("*").alias("self"))
    n = F.col("n") - F.when(F.col("p1") == F.col("p2"), F.coalesce("self", F.lit(0))).otherwise(0)
    return pairs.join(F.broadcast(selfs), F.col("p1") == F.col("p"), "left").select("p1", "p2", n.alias("n")).where("n > 0")


def same_as_resolved(facts: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct facts with the object of a sameAs link replaced by its subject wherever it stands, predicates too. One step,
    not followed further; of several subjects the smallest id holds."""
    to = links.where("s is not null and o is not null and s <> o").groupBy(F.col("o").alias("_o")).agg(F.min("s").alias("_s"))
    out = facts.select("s", "p", "o")
    for c in ("s", "p", "o"):
        out = out.join(to, out[c] == to["_o"], "left").withColumn(c, F.coalesce("_s", c)).drop("_o", "_s")
    return out.distinct()


def test_minus_train(test: DataFrame, train: DataFrame) -> DataFrame:
    """Distinct test triples that aren't in the training part."""
    return test.select("s", "p", "o").distinct().join(train.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def merged(train: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct triples of both parts."""
    return train.select("s", "p", "o").unionByName(test.select("s", "p", "o")).distinct()
