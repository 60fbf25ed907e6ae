"""Datasets of quads: views, limits, sampling, counting, prefixes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions.matching import printed
from lodeweave.operators.terms import dictionary, with_long_form
from lodeweave.session import table


def decoded_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete quads with terms in place of ids: URIs in long form, the object as a struct, no graph as empty text."""
    terms = with_long_form(dictionary(spark, sf_dir), table(spark, sf_dir, "prefixes"))
    uris = terms.select("id", "long")
    out = table(spark, sf_dir, "quads").where("s is not null and p is not null and o is not null").select("s", "p", "o", "g")
    for c in ("s", "p", "g"):
        side = uris.select(F.col("id").alias(f"_{c}"), F.col("long").alias(f"_l{c}"))
        out = out.join(side, out[c] == side[f"_{c}"], "left").drop(c, f"_{c}").withColumnRenamed(f"_l{c}", c)
    o = F.struct("kind", F.col("long").alias("value"), "num", "lo", "hi", "lo_open", "hi_open")
    objects = terms.select(F.col("id").alias("_o"), o.alias("_t"))
    out = out.join(objects, out["o"] == objects["_o"]).drop("o", "_o").withColumnRenamed("_t", "o")
    return out.select("s", "p", "o", F.coalesce("g", F.lit("")).alias("g"))


def encounter(*cols: str) -> list[Column]:
    """An explicit order of quads: rows of a DataFrame have none of their own."""
    return [F.col(c) for c in cols or ("s", "p")] + ([printed(F.col("o")), F.col("g")] if not cols else [])


def with_index(df: DataFrame, order: Sequence[Column], name: str = "index") -> DataFrame:
    """Rows with their 0-based position in ``order``, without bringing them into one partition.

    Rows are range-partitioned; positions in a partition are added to the sizes of those before it, of which only
    one number for each partition goes to the driver.
    """
    from lodeweave.plans.lineage import cut

    names = [f"_k{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order)))
    parts = cut(keyed.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_part"], r["n"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*names)) - 1
    return parts.withColumn("_i", local).join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_i") + F.col("_start")).alias(name))


def take(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def drop(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return with_index(df, order, "_ix").where(F.col("_ix") >= n).drop("_ix")


def slice_rows(df: DataFrame, start: int, end: int, order: Sequence[Column]) -> DataFrame:
    """Rows ``start`` to ``end`` (exclusive) in ``order``."""
    return df.orderBy(*order).limit(max(0, end)).offset(max(0, start))


def filter_indices(df: DataFrame, wanted: Sequence[int], order: Sequence[Column]) -> DataFrame:
    return with_index(df, order, "_ix").where(F.col("_ix").isin(list(wanted))).drop("_ix")


def take_while(df: DataFrame, condition: Column, order: Sequence[Column]) -> DataFrame:
    """Rows before the first one that fails ``condition``."""
    ranked = with_index(df.withColumn("_ok", F.coalesce(condition, F.lit(False))), order, "_ix")
    first = ranked.where(~F.col("_ok")).agg(F.min("_ix").alias("_first"))
    return ranked.crossJoin(F.broadcast(first)).where(F.col("_first").isNull() | (F.col("_ix") < F.col("_first"))).drop("_ok", "_ix", "_first")


def top_k(df: DataFrame, k: int, order: Sequence[Column], ties: bool = False) -> DataFrame:
    """The first ``k`` rows; with ``ties`` all that equal the k-th (the optimiser's group limit keeps few
    rows of each partition before they meet)."""
    ranked = df.withColumn("_r", F.rank().over(Window.orderBy(*order))) if ties else None
    return df.orderBy(*order).limit(k) if ranked is None else ranked.where(F.col("_r") <= k).drop("_r")


def distinct_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def concat(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def running(df: DataFrame, value: Column, order: Sequence[Column], partition: Sequence[str], name: str = "running") -> DataFrame:
    """Running sum within a partition."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def histogram(quads: DataFrame, *places: str) -> DataFrame:
    """Quads per combination of the given places (s, p, o); none gives one row."""
    cols = [printed(F.col("o")).alias("o") if c == "o" and dict(quads.dtypes)["o"].startswith("struct") else F.col(c) for c in places]
    return quads.groupBy(*cols).agg(F.count("*").alias("n"))


def properties(quads: DataFrame) -> DataFrame:
    """Per predicate: quads by kind of object (bnodes count as resources), and in all."""
    kind = F.col("o.kind")
    names = {"resources": ("uri", "bnode"), "texts": ("text",), "numbers": ("number",), "booleans": ("boolean",), "intervals": ("interval",)}
    return quads.groupBy("p").agg(*[F.count_if(kind.isin(*k)).alias(n) for n, k in names.items()], F.count("*").alias("total"))


#: Bits of a hash that cut a stratum into pieces to be ordered on their own.
_PIECE_BITS = 12


def with_turn(df: DataFrame, keys: Sequence[str], by: Column, name: str = "turn") -> DataFrame:
    """Rows with their place, from 1, in the order of the hash ``by`` within their key. A key's rows are ordered in pieces by the leading bits
    of the hash, to whose places the sizes of the pieces before are added, so that no task holds all rows of a key."""
    piece = F.shiftright(F.col("_h"), 64 - _PIECE_BITS)
    rows = df.withColumn("_h", by).withColumn("_piece", piece)
    sizes = rows.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy("_h"))
    placed = rows.withColumn("_w", within).join(offsets, [*keys, "_piece"])
    return placed.select(*df.columns, (F.col("_w") + F.col("_before")).alias(name))


def split(triples: DataFrame, parts: Sequence[float], stratum: str = "p", seed: int = 42, absolute: bool = False) -> list[DataFrame]:
    """Parts without replacement, stratified: rows are ordered by their turn within a shuffled stratum (then by stratum), and each part takes the
    next rows of that order until it has its ratio, or its number of rows if ``absolute``. One part returns only itself, parts
    of all ratios together the whole. Rows with a null stratum are left out."""
    order = F.xxhash64(*[c for c in triples.columns], F.lit(seed))
    turned = with_turn(triples.where(F.col(stratum).isNotNull()), [stratum], order, "_turn")
    ranked = with_index(turned, [F.col("_turn"), F.col(stratum)], "_ix")
    total = None if absolute else triples.where(F.col(stratum).isNotNull()).count()
    out, start = [], 0
    for x in parts:
        n = int(x) if absolute else int(round(sum(parts[: len(out) + 1]) * total)) - start
        out.append(ranked.where((F.col("_ix") >= start) & (F.col("_ix") < start + n)).drop("_ix", "_turn"))
        start += n
    return out


def bootstrap(triples: DataFrame, ratios: Sequence[float], stratum: str = "p", seed: int = 42) -> list[DataFrame]:
    """Samples with replacement, one for each ratio: of each stratum exactly its size times the ratio, rounded. Draw i of a stratum is
    row 1 + hash(i) mod size, so that the same seed gives the same sample. Rows with a null stratum are left out."""
    from lodeweave.plans.lineage import cut

    order = F.xxhash64(*triples.columns, F.lit(seed))
    rows = cut(with_turn(triples.where(F.col(stratum).isNotNull()), [stratum], order, "_turn"), "turns")
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_size"))
    out = []
    for k, ratio in enumerate(ratios):
        each = F.sequence(F.lit(0), F.lit(max(0, math.ceil(ratio) - 1)))  # draws are spread over the rows themselves
        draws = rows.select(stratum, "_turn").join(sizes, stratum).withColumn("_i", F.explode(F.transform(each, lambda j: F.col("_turn") + j * F.col("_size"))))
        draws = draws.where(F.col("_i") <= F.round(F.col("_size") * ratio))
        drawn = draws.select(stratum, (F.pmod(F.xxhash64(stratum, "_i", F.lit(seed), F.lit(k)), F.col("_size")) + 1).alias("_turn"))
        out.append(rows.join(drawn, [stratum, "_turn"]).select(*triples.columns))
    return out


def grouped_by(df: DataFrame, keys: Sequence[str], most: int, order: Sequence[Column]) -> DataFrame:
    """At most ``most`` rows of each group, the first in ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def head(df: DataFrame, order: Sequence[Column]):
    """The first row in ``order``, or None."""
    return df.orderBy(*order).first()


def last(df: DataFrame, order: Sequence[Column]):
    """The last row in ``order``, or None."""
    indexed = with_index(df, order, "_ix")
    return indexed.where(F.col("_ix") == df.count() - 1).drop("_ix").first()


def find(df: DataFrame, condition: Column, order: Sequence[Column]):
    """The first row in ``order`` that fulfils ``condition``, or None."""
    return df.where(condition).orderBy(*order).first()


def exists(df: DataFrame, condition: Column) -> bool:
    return not df.where(condition).isEmpty()


def forall(df: DataFrame, condition: Column) -> bool:
    """Whether no row fails ``condition``; null fails it."""
    return df.where(~F.coalesce(condition, F.lit(False))).isEmpty()


def graph_names(quads: DataFrame) -> DataFrame:
    """(``g``, ``n``): the graphs of quads and their sizes; the default graph is the empty name."""
    return quads.groupBy(F.coalesce("g", F.lit("")).alias("g")).agg(F.count("*").alias("n"))


def graph(quads: DataFrame, name: str) -> DataFrame:
    """The quads of one graph."""
    return quads.where(F.coalesce("g", F.lit("")) == name)


def namespace(uri: Column) -> Column:
    """The part up to the last slash or hash."""
    return F.regexp_extract(uri, r"^(.+[/#])(.+)$", 1)


def local_name(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^(.+[/#])(.+)$", 2)


def with_prefixes(quads: DataFrame, prefixes: DataFrame, places: Sequence[str] = ("s", "p")) -> DataFrame:
    """Adds ``<place>_display``: prefix and local name where the namespace has a prefix, else the URI; identity stays."""
    ns = prefixes.groupBy("ns").agg(F.min("prefix").alias("_prefix"))
    for c in places:
        side = ns.select(F.col("ns").alias(f"_n{c}"), F.col("_prefix").alias(f"_p{c}"))
        quads = quads.join(F.broadcast(side), namespace(F.col(c)) == F.col(f"_n{c}"), "left")
        quads = quads.withColumn(f"{c}_display", F.when(F.col(f"_p{c}").isNotNull(), F.concat(f"_p{c}", F.lit(":"), local_name(F.col(c)))).otherwise(F.col(c))).drop(f"_n{c}", f"_p{c}")
    return quads


def used_namespaces(quads: DataFrame) -> DataFrame:
    """Distinct namespaces of subjects, predicates and resource objects."""
    uris = quads.select(F.explode(F.array("s", "p", F.when(F.col("o.kind") == "uri", F.col("o.value")))).alias("u")).where("u is not null")
    return uris.select(namespace(F.col("u")).alias("ns")).where("ns <> ''").distinct()


def used_prefixes(quads: DataFrame, prefixes: DataFrame) -> DataFrame:
    return prefixes.join(used_namespaces(quads), "ns", "left_semi")
