"""Cutting numeric objects into intervals."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeweave.functions.matching import interval_term, printed
from lodeweave.plans.lineage import cut

INTERVALS = "p string, bin int, lo double, hi double, lo_open boolean, hi_open boolean, n long"


def equidistance(values: DataFrame, keys: list[str], bins: int, value: str = "num") -> DataFrame:
    """(``keys``, ``bin``, ``lo``, ``hi``): ``bins`` intervals of equal width from least to greatest value;
    all are open at the end but the last."""
    ends = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    out = ends.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))).withColumn("w", (F.col("b") - F.col("a")) / bins)
    lo = F.when(F.col("bin") == 1, F.col("a")).otherwise(F.col("a") + F.col("w") * (F.col("bin") - 1))
    hi = F.when(F.col("bin") == bins, F.col("b")).otherwise(F.col("a") + F.col("w") * F.col("bin"))
    out = out.select(*keys, "bin", lo.alias("lo"), hi.alias("hi")).where((F.col("lo") < F.col("hi")) | (F.col("bin") == bins))
    return _flags(out, keys)


def equifrequency(values: DataFrame, keys: list[str], bins: int, value: str = "num") -> DataFrame:
    """Intervals of about equal counts. Equal values stay together: a value belongs to the bin in which the middle
    of its rows falls; borders lie halfway between neighbouring values of different bins."""
    counted = _value_counts(values, keys, value)
    middle = (F.col("_cum") - F.col("n") / 2) / F.col("_total")
    binned = counted.withColumn("bin", F.least(F.floor(middle * bins).cast("int") + 1, F.lit(bins)))
    return _borders(binned, keys)


def equisize(values: DataFrame, keys: list[str], support: float | str, value: str = "num") -> DataFrame:
    """Intervals of at least ``support`` rows (a share if below 1; or the key column that has it): a bin closes with the value that reaches it; too few
    at the end join the last bin. Only distinct values and their counts of a key meet in a task."""
    counted = _value_counts(values, keys, value)
    types = dict(counted.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", v double, n long, bin int"

    def filled(pdf):
        pdf = pdf.sort_values("v")
        wanted = float(pdf[support].iloc[0]) if isinstance(support, str) else support
        least = max(1.0, wanted * pdf["n"].sum() if wanted < 1 else wanted)
        out, bin_, have = [], 1, 0
        for n in pdf["n"]:
            out.append(bin_)
            have += n
            if have >= least:
                bin_, have = bin_ + 1, 0
        if have and bin_ > 1:
            out = [min(b, bin_ - 1) for b in out]
        return pdf.assign(bin=out)[[*keys, "v", "n", "bin"]]

    return _borders(counted.select(*keys, "v", "n").groupBy(*keys).applyInPandas(filled, schema), keys)


def equisize_tree(values: DataFrame, keys: list[str], support: float | str, arity: int = 2, value: str = "num") -> DataFrame:
    """Levels of intervals: level 1 are the equisize bins, each further level joins ``arity`` neighbours, up to one interval
    for all. (``keys``, ``level``, ``bin``, ``lo``, ``hi``, flags, ``n``.)"""
    out = level = equisize(values, keys, support, value).withColumn("level", F.lit(1))
    deepest = level.agg(F.max("bin")).first()[0] or 1
    for k in range(2, 2 + max(0, math.ceil(math.log(deepest, arity)))):
        up = level.withColumn("bin", F.floor((F.col("bin") - 1) / arity).cast("int") + 1)
        level = up.groupBy(*keys, "bin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("lo_open", "lo").alias("lo_open"), F.max_by("hi_open", "hi").alias("hi_open"), F.sum("n").alias("n")).withColumn("level", F.lit(k))
        out = out.unionByName(level)
    return out


def _value_counts(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    counted = values.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, (F.col(value) + F.lit(0.0)).alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    cum = F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("_cum", cum).withColumn("_total", F.sum("n").over(w))


def _borders(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals from values with bins: borders halfway between neighbours."""
    bins = binned.groupBy(*keys, "bin").agg(F.min("v").alias("_min"), F.max("v").alias("_max"), F.sum("n").alias("n"))
    w = Window.partitionBy(*keys).orderBy("_min")
    before, after = F.lag("_max").over(w), F.lead("_min").over(w)
    lo = F.coalesce((before + F.col("_min")) / 2, F.col("_min"))
    hi = F.coalesce((F.col("_max") + after) / 2, F.col("_max"))
    out = bins.select(*keys, F.row_number().over(w).alias("bin"), lo.alias("lo"), hi.alias("hi"), "n")
    return _flags(out, keys)


def _flags(out: DataFrame, keys: list[str]) -> DataFrame:
    last = F.max("bin").over(Window.partitionBy(*keys))
    return out.withColumn("lo_open", F.lit(False)).withColumn("hi_open", F.col("bin") < last)


def replace_by_intervals(quads: DataFrame, intervals: DataFrame, keys: tuple[str, ...] = ("p",)) -> DataFrame:
    """Quads with each numeric object replaced by its key's first interval that holds it; others stay.

    The intervals of a key, a bounded list, are joined by key and searched in the row.
    """
    own = F.struct("bin", "lo", "hi", "lo_open", "hi_open")
    lists = intervals.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("_iv"))
    num = F.col("o.num")
    holds = lambda i: ((num > i["lo"]) | (~i["lo_open"] & (num == i["lo"]))) & ((num < i["hi"]) | (~i["hi_open"] & (num == i["hi"])))
    hit = F.get(F.filter("_iv", holds), F.lit(0))
    joined = quads.join(F.broadcast(lists), list(keys), "left").withColumn("_hit", F.when((F.col("o.kind") == "number") & ~F.isnan(num), hit))
    new = F.when(F.col("_hit").isNotNull(), interval_term(F.col("_hit.lo"), F.col("_hit.hi"), F.col("_hit.lo_open"), F.col("_hit.hi_open"))).otherwise(F.col("o"))
    return joined.withColumn("o", new).select(*quads.columns)


@dataclass(frozen=True)
class AutoTask:
    """Bounds of automatic discretization; ``predicates`` are those to cut, all numeric ones if empty."""

    lower_bound: bool = True
    upper_bound: bool = True
    min_head_size: int = 100
    min_head_coverage: float = 0.01
    max_length: int = 3
    arity: int = 2
    predicates: tuple[str, ...] = ()


def _bounds(quads: DataFrame, task: AutoTask) -> DataFrame:
    """(``p``, ``least``, ``most``): bounds of the support of each predicate that has one to reach."""
    node = F.when(F.col("o.kind").isin("uri", "bnode"), F.col("o.value"))
    ends = quads.select("p", F.explode(F.array("s", node)).alias("t")).where("t is not null").distinct()
    links = cut(ends.join(ends.withColumnRenamed("p", "q"), "t").select("p", "q").distinct(), "links")
    sizes = quads.select("s", "p", printed(F.col("o")).alias("o")).distinct().groupBy(F.col("p").alias("q")).agg(F.count("*").alias("n"))
    reach = links.select("p", F.col("p").alias("q")).distinct()
    for _ in range(task.max_length - 1):
        step = reach.join(links.select(F.col("p").alias("q"), F.col("q").alias("to")), "q").select("p", F.col("to").alias("q"))
        reach = cut(reach.unionByName(step).distinct(), "reach")
    support = F.ceil(F.col("n") * task.min_head_coverage)
    found = reach.join(sizes.where(F.col("n") >= task.min_head_size), "q").groupBy("p").agg(F.min(support).alias("a"), F.max(support).alias("b"))
    least = F.greatest(F.lit(2), "a") if task.lower_bound else F.lit(2)
    return found.select("p", least.cast("double").alias("least"), (F.col("b").cast("double") if task.upper_bound else F.lit(math.inf)).alias("most"))


def auto_discretize(quads: DataFrame, task: AutoTask = AutoTask()) -> DataFrame:
    """Quads of the added predicates ``<p>#discretized_level_N``, whose objects are intervals.

    For each numeric predicate the least support is the smallest ceil(head size * head coverage) over predicates
    reachable within ``max_length`` - 1 steps of shared terms, the greatest the largest; levels all of whose intervals
    exceed the greatest support are cut. One plan for all predicates, whose bounds are columns.
    """
    own = quads.where("o.kind = 'number' and not isnan(o.num)")
    if task.predicates:
        own = own.where(F.col("p").isin(list(task.predicates)))
    bounds = cut(_bounds(quads, task), "bounds")
    values = own.join(bounds.select("p", "least"), "p").select("p", "least", F.col("o.num").alias("num"))
    tree = cut(equisize_tree(values, ["p", "least"], "least", task.arity), "tree")
    depth = tree.where("level = 1").groupBy("p").agg(F.greatest(F.lit(1), 1 + F.ceil(F.round(F.log(F.max("bin").cast("double")) / math.log(task.arity), 9))).alias("depth"))
    kept = tree.groupBy("p", "level").agg(F.min("n").alias("n")).join(depth, "p").join(bounds, "p").where("n <= most and level <= depth").select("p", "level")
    kept = cut(kept, "levels")
    name = F.concat("p", F.lit("#discretized_level_"), F.col("level").cast("string"))
    bins = tree.join(kept, ["p", "level"]).withColumn("p", name).drop("level", "least")
    return replace_by_intervals(own.join(kept, "p").withColumn("p", name).select(*quads.columns), bins)


def interval_families(predicates: list[str]) -> dict[str, str]:
    """Discretized predicate to its parent."""
    return {p: p.rsplit("#discretized_level_", 1)[0] for p in predicates if "#discretized_level_" in p}
