"""An index: dictionary and distinct facts of a dataset, and the way back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.plans.lineage import cut

SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"


@dataclass
class Index:
    """``terms`` (id and term columns), ``facts`` (``s``, ``p``, ``o``), ``fact_graphs`` (with ``g``, an id), ``test`` facts or None."""

    terms: DataFrame
    facts: DataFrame
    fact_graphs: DataFrame
    test: DataFrame | None = None

    def evaluated(self) -> DataFrame:
        """The test part; an index without one is its own test."""
        return self.facts if self.test is None else self.test


def _resource(c: Column) -> Column:
    none = F.lit(None).cast("double")
    flag = F.lit(None).cast("boolean")
    return F.struct(F.when(c.startswith("_:"), "bnode").otherwise("uri").alias("kind"), c.alias("value"), none.alias("num"), none.alias("lo"), none.alias("hi"), flag.alias("lo_open"), flag.alias("hi_open"))


def _key(t: Column) -> Column:
    return F.when((t["kind"] == "number") & t["num"].isNotNull(), F.concat(F.lit("number\t"), (t["num"] + F.lit(0.0)).cast("string"))).when(
        t["kind"] == "interval", F.concat_ws("\t", F.lit("interval"), t["lo"].cast("string"), t["hi"].cast("string"), t["lo_open"].cast("string"), t["hi_open"].cast("string"))
    ).otherwise(F.concat(t["kind"], F.lit("\t\t"), t["value"]))


def term_id(t: Column) -> Column:
    """A stable id of a term struct: equal terms have equal ids."""
    return F.xxhash64(_key(t))


def build_index(quads: DataFrame, test_graphs: list[str] | None = None, resolve_same_as: bool = True) -> Index:
    """Encodes quads. Ids are hashes; that no two terms share one is checked. sameAs triples are consumed and replace their
    object by their subject everywhere. Quads of ``test_graphs`` make the test part, without triples of the training part."""
    from lodeweave.operators.cardinalities import same_as_resolved, test_minus_train

    struct = {c: F.col("o") if c == "o" else _resource(F.col(c)) for c in ("s", "p", "o", "g")}
    terms = quads.select(F.explode(F.array(*struct.values())).alias("t")).select(term_id(F.col("t")).alias("id"), _key(F.col("t")).alias("key"), "t")
    terms = cut(terms.groupBy("id").agg(F.min("t").alias("t"), F.count_distinct("key").alias("n")), "terms")
    if terms.where("n > 1").limit(1).count():
        raise ValueError("two terms have the same id")
    ids = cut(quads.select(*[term_id(t).alias(c) for c, t in struct.items()]).distinct(), "ids")
    if resolve_same_as:
        same = ids.sparkSession.range(1).select(term_id(_resource(F.lit(SAME_AS))).alias("x")).first()["x"]
        links = ids.where(F.col("p") == same).select("s", "o").distinct()
        if links.limit(1).count():
            rest = ids.where(F.col("p") != same)
            plain = same_as_resolved(rest, links)
            m = links.where("s <> o").groupBy(F.col("o").alias("_o")).agg(F.min("s").alias("_s"))
            for c in ("s", "p", "o"):
                rest = rest.join(m, rest[c] == m["_o"], "left").withColumn(c, F.coalesce("_s", c)).drop("_o", "_s")
            ids = cut(rest.distinct().join(plain, ["s", "p", "o"], "left_semi").select("s", "p", "o", "g"), "ids")
    test = None
    if test_graphs:
        wanted = ids.sparkSession.createDataFrame([(g,) for g in test_graphs], "g string").select(term_id(_resource(F.col("g"))).alias("g"))
        in_test = ids.join(F.broadcast(wanted), "g", "left_semi")  # as many rows as graphs were named
        ids = cut(ids.join(F.broadcast(wanted), "g", "left_anti"), "train-ids")
        test = cut(test_minus_train(in_test, ids), "test")
    facts = cut(ids.select("s", "p", "o").distinct(), "facts")
    return Index(terms.select("id", "t.*"), facts, ids, test)


def printed_terms(index: Index) -> DataFrame:
    """(``id``, ``name``) of all terms in printed form."""
    name = F.when(F.col("kind") == "uri", F.concat(F.lit("<"), "value", F.lit(">"))).when(F.col("kind") == "text", F.concat(F.lit('"'), "value", F.lit('"'))).otherwise(F.col("value"))
    return index.terms.select("id", name.alias("name"))


def to_dataset(index: Index, ids: DataFrame | None = None) -> DataFrame:
    """Quads of the index, or of given id triples (``s``, ``p``, ``o``, perhaps ``g``)."""
    rows = index.fact_graphs if ids is None else ids
    if "g" not in rows.columns:
        rows = rows.withColumn("g", F.lit(None).cast("long"))
    for c in ("s", "p", "g"):
        side = index.terms.select(F.col("id").alias("_i"), F.col("value").alias("_v"))
        rows = rows.join(side, rows[c] == side["_i"], "left").drop(c, "_i").withColumnRenamed("_v", c)
    o = index.terms.select(F.col("id").alias("_i"), F.struct(*[c for c in index.terms.columns if c != "id"]).alias("_t"))
    rows = rows.join(o, rows["o"] == o["_i"]).drop("o", "_i").withColumnRenamed("_t", "o")
    return rows.select("s", "p", "o", F.coalesce("g", F.lit("")).alias("g"))


