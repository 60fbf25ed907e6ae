"""Rule measures: confidences under closed world and partial completeness, lift."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.cardinalities import constant_probabilities, mode_probabilities, property_cardinalities
from lodeweave.operators.unions import entries, union_sizes
from lodeweave.plans.lineage import cut
from lodeweave.plans.shapes import CONST, Shape, add_atom, body_order, differs_from_head, key_columns, keys, parse_shape, shape_text, side
from lodeweave.plans.sizing import broadcast_if_small

MIN_CONFIDENCE = 0.001


def by_shape(rules: DataFrame) -> Iterator[tuple[Shape, DataFrame]]:
    """(shape, ``rule_id`` and key columns of its rules); only the shapes, which are few, go to the driver."""
    rules = rules.withColumn("_shape", shape_text())
    for r in sorted(r["_shape"] for r in rules.select("_shape").distinct().collect()):
        shape = parse_shape(r)
        yield shape, rules.where(F.col("_shape") == r).select("rule_id", *key_columns(shape))


def instances(own: DataFrame, facts: DataFrame, shape: Shape, injective: bool, head: bool = False) -> DataFrame:
    """Ground instances of the bodies (and heads) of the rows ``own`` of key columns of a shape: p<j>, v<i>, k<j>, ``rule_id`` if there.

    The rules are the left side of the first join, so that only facts of their predicates take part.
    """
    out = broadcast_if_small(own, 100_000)
    out = out.withColumnsRenamed({c: f"_r{c}" for c in own.columns if c != "rule_id"})
    order, bound = [0, *body_order(shape, set(shape[0]) - {CONST})] if head else _body_first(shape), set()
    for j in order:
        out = add_atom(out, facts.hint("shuffle_hash") if bound and set(shape[j]) <= bound else facts, shape, j, injective)
        bound |= set(shape[j])
    if not head:
        out = out.withColumns({c: F.col(f"_r{c}") for c in keys(shape) if f"_r{c}" in out.columns and c in ("p0", "k0")})
    return out.drop(*[c for c in out.columns if c.startswith("_r")])


def _start(shape: Shape) -> int:
    return min(range(1, len(shape)), key=lambda j: (CONST not in shape[j], j))


def _body_first(shape: Shape) -> list[int]:
    first = _start(shape)
    order, bound = [first], set(shape[first]) - {CONST}
    left = [j for j in range(1, len(shape)) if j != first]
    while left:
        j = min(left, key=lambda j: (-sum(x in bound for x in shape[j]), CONST not in shape[j], j))
        order.append(j)
        left.remove(j)
        bound |= set(shape[j]) - {CONST}
    return order


def predicted_pairs(rules: DataFrame, facts: DataFrame, injective: bool = False) -> DataFrame:
    """(``rule_id``, ``s``, ``p``, ``o``): the distinct heads that each rule's body gives.

    A head variable that the body lacks can't occur in a closed rule. Injective: variables take different
    values, and the head isn't one of the body's instances.
    """
    out = None
    for shape, own in by_shape(rules):
        body = [c for c in keys(shape) if c not in ("p0", "k0")]
        everything = injective and CONST in shape[0]  # a variable of the body may then take the head's constant
        values = sorted({f"v{x}" for atom in (shape if everything else shape[:1]) for x in atom if x != CONST})
        found = instances(own.select(*body).distinct(), facts, shape, injective).select(*body, *values).distinct()
        found = found.join(broadcast_if_small(own, 100_000), body)
        if injective:
            known = set(found.columns) | {f"v{CONST}"}
            for j in range(1, len(shape)):
                if {f"v{x}" for x in shape[j]} <= known:
                    found = found.where(differs_from_head(shape, j))
            if CONST not in shape[0]:
                found = found.where(side(shape, 0, 0) != side(shape, 0, 1))
        pairs = found.select("rule_id", side(shape, 0, 0).alias("s"), F.col("p0").alias("p"), side(shape, 0, 1).alias("o"))
        pairs = pairs.distinct() if everything else pairs
        out = pairs if out is None else out.unionByName(pairs)
    if out is None:
        return rules.sparkSession.createDataFrame([], "rule_id long, s long, p long, o long")
    return out


def is_hop(shape: Shape) -> bool:
    """Whether the body leads from one head variable to the other through one further variable."""
    return len(shape) == 3 and shape[0] == (0, 1) and {frozenset(a) for a in shape[1:]} == {frozenset((0, 2)), frozenset((1, 2))}


def hop_places(shape: Shape) -> list[tuple[int, int]]:
    """For each head variable of a hop shape its body atom and its place there (0 subject, 1 object)."""
    return [next((j, shape[j].index(x)) for j in (1, 2) if x in shape[j]) for x in (0, 1)]


def hop_bodies(own: DataFrame, shape: Shape, sides: DataFrame) -> DataFrame:
    """(``rule_id``, ``p``, ``higher_side``, ``average``, ``pa``, ``ka``, ``pb``, ``kb``): rules of a hop shape, the place of the head variable on the higher
    side in the body, then that of the other one."""
    (i, x), (j, y) = hop_places(shape)
    first = F.col("higher_side") == "subject"
    turned = lambda a, b: F.when(first, a).otherwise(b)
    ends = [turned(F.col(f"p{i}"), F.col(f"p{j}")).alias("pa"), turned(F.lit(x), F.lit(y)).alias("ka"), turned(F.col(f"p{j}"), F.col(f"p{i}")).alias("pb"), turned(F.lit(y), F.lit(x)).alias("kb")]
    return own.join(sides.withColumnRenamed("p", "p0"), "p0").select("rule_id", F.col("p0").alias("p"), "higher_side", "average", *ends)


def partner_groups(values: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the ``entries`` at ``places`` (``p``, ``k``): groups of values with equal sets of partners (``p``, ``k``, ``rep``, ``w`` values, ``zs``), and the group of
    each value (``p``, ``k``, ``v``, ``rep``)."""
    sets = cut(values.join(F.broadcast(places), ["p", "k"], "left_semi").groupBy("p", "k", "v").agg(F.array_sort(F.collect_list("z")).alias("zs")), "partners")
    groups = cut(sets.groupBy("p", "k", "zs").agg(F.min("v").alias("rep"), F.count("*").alias("w")), "groups")
    return groups, sets.join(groups.drop("w"), ["p", "k", "zs"]).select("p", "k", "v", "rep")


def _hop_counts(own: dict[Shape, DataFrame], facts: DataFrame, sides: DataFrame, values: DataFrame) -> DataFrame:
    """The sums of ``_pair_counts`` for rules of hop shapes without listing their pairs: of each value on the head's higher side the body has as many
    pairs as the union of its partners' values has members."""
    rules = cut(reduce(DataFrame.unionByName, [hop_bodies(x, shape, sides) for shape, x in own.items()]), "hops")
    rules = broadcast_if_small(rules, 100_000)
    at = [F.col("pa").alias("p"), F.col("ka").alias("k")]
    ends = entries(facts)
    groups, members = partner_groups(ends, rules.select(*at).distinct())
    counts = cut(union_sizes(groups, ends, rules.select("pa", "ka", "pb", "kb").distinct()), "unions")
    sized = counts.join(groups.select(F.col("p").alias("pa"), F.col("k").alias("ka"), "rep", "w"), ["pa", "ka", "rep"])
    beyond = F.greatest(F.lit(0), F.col("n") - F.greatest(F.lit(0), F.col("average")))
    body = ["pa", "ka", "pb", "kb"]
    base = sized.join(rules, body).groupBy("rule_id").agg(F.sum(F.col("n") * F.col("w")).alias("body_size"), F.sum(F.col("w") * beyond).alias("_unseen"))
    v = F.when(F.col("higher_side") == "subject", F.col("v0")).otherwise(F.col("v1"))
    known = [instances(x, facts, shape, False, head=True).select("rule_id", "v0", "v1").distinct() for shape, x in own.items()]
    known = reduce(DataFrame.unionByName, known).join(rules.select("rule_id", "higher_side"), "rule_id").groupBy("rule_id", v.alias("v")).agg(F.count("*").alias("pos"))
    seen = values.join(rules, ["p", "higher_side"]).join(members.select(*[F.col(a).alias(b) for a, b in (("p", "pa"), ("k", "ka"))], "v", "rep"), ["pa", "ka", "v"])
    seen = seen.select("rule_id", *body, "average", "v", "c", "rep").join(counts, [*body, "rep"]).join(known, ["rule_id", "v"], "left")
    pos = F.coalesce("pos", F.lit(0))
    counted = pos + F.greatest(F.lit(0), F.col("n") - pos - F.greatest(F.lit(0), F.col("average") - F.col("c")))
    seen = seen.groupBy("rule_id").agg(F.sum("n").alias("_pca"), F.sum(counted - beyond).alias("_more"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return base.join(seen, "rule_id", "left").select("rule_id", "body_size", zero("_pca").alias("pca_body_size"), (F.col("_unseen") + zero("_more")).alias("qpca_body_size"))


def path_counts(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """(``rule_id``, ``paths``): how many instances each rule's body has (not injective). Two-hop bodies are counted by the values in their middle,
    not listed."""
    out = None
    for shape, own in by_shape(rules):
        if is_hop(shape):
            ends = [facts.groupBy(F.col("p").alias(f"p{j}"), F.col("s" if shape[j][0] == 2 else "o").alias("z")).agg(F.count("*").alias(f"n{j}")) for j in (1, 2)]
            part = broadcast_if_small(own).join(ends[0], "p1").join(ends[1], ["p2", "z"]).groupBy("rule_id").agg(F.sum(F.col("n1") * F.col("n2")).alias("paths"))
        else:
            part = instances(own, facts, shape, False).groupBy("rule_id").agg(F.count("*").alias("paths"))
        out = part if out is None else out.unionByName(part)
    return rules.sparkSession.createDataFrame([], "rule_id long, paths long") if out is None else out


def _pair_counts(rules: DataFrame, facts: DataFrame, pairs: DataFrame, sides: DataFrame, values: DataFrame) -> DataFrame:
    """(``rule_id``, ``body_size``, ``pca_body_size``, ``qpca_body_size``) from the listed pairs."""
    known = facts.select("s", "p", "o", F.lit(True).alias("known"))
    heads = rules.select("rule_id", F.when(F.col("head.s.is_var"), F.lit(True)).otherwise(False).alias("_sv"), F.col("head.o.is_var").alias("_ov"))
    tagged = pairs.join(known, ["s", "p", "o"], "left").join(sides, "p").join(broadcast_if_small(heads, 100_000), "rule_id")
    v = F.when(F.col("higher_side") == "subject", F.col("s")).otherwise(F.col("o"))
    per_value = tagged.groupBy("rule_id", "p", "higher_side", "average", "_sv", "_ov", v.alias("v")).agg(F.count("*").alias("n"), F.count("known").alias("pos"))
    per_value = per_value.join(values, ["p", "v", "higher_side"], "left")
    constant = ~F.when(F.col("higher_side") == "subject", F.col("_sv")).otherwise(F.col("_ov"))
    neg = F.col("n") - F.col("pos")
    free = F.greatest(F.lit(0), F.col("average") - F.coalesce("c", F.lit(0)))
    return per_value.groupBy("rule_id").agg(
        F.sum("n").alias("body_size"),
        F.sum(F.when(F.col("c").isNotNull() | constant, F.col("n")).otherwise(0)).alias("pca_body_size"),
        F.sum(F.col("pos") + F.greatest(F.lit(0), neg - free)).alias("qpca_body_size"),
    )


def with_confidences(rules: DataFrame, facts: DataFrame, injective: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """Rules with ``body_size``, ``cwa_confidence``, ``pca_body_size``, ``pca_confidence``, ``qpca_body_size``
    and ``qpca_confidence``.

    PCA counts the pairs whose value at the head predicate's higher-cardinality side occurs there; if that side is a
    constant, all. QPCA counts each known pair, and of the unknown pairs of a value those beyond the average
    number that the value lacks. Pairs of two-hop bodies are counted by unions of lists, unless injective or given.
    """
    cards = cut(property_cardinalities(facts), "cards")
    sides = broadcast_if_small(cards.select("p", "higher_side", "average"))
    values = [facts.groupBy("p", F.col(c).alias("v")).agg(F.count("*").alias("c")).withColumn("higher_side", F.lit(name)) for name, c in (("subject", "s"), ("object", "o"))]
    values = values[0].unionByName(values[1])
    listed, sums = rules, None
    if pairs is None and not injective:
        hops = {shape: cut(own, "hop-rules") for shape, own in by_shape(rules) if is_hop(shape)}
        sums = cut(_hop_counts(hops, facts, sides, values), "hop-counts") if hops else None
        listed = rules.join(sums.select("rule_id"), "rule_id", "left_anti") if hops else rules
    pairs = cut(predicted_pairs(listed, facts, injective), "pairs") if pairs is None else pairs
    counted = _pair_counts(listed, facts, pairs, sides, values)
    sums = counted if sums is None else counted.unionByName(sums)
    base = rules.drop("body_size", "cwa_confidence", "pca_body_size", "pca_confidence", "qpca_body_size", "qpca_confidence")
    ratio = lambda c: F.when(F.col(c) > 0, F.col("support") / F.col(c))
    return base.join(sums, "rule_id", "left").withColumns({"cwa_confidence": ratio("body_size"), "pca_confidence": ratio("pca_body_size"), "qpca_confidence": ratio("qpca_body_size")})


def default_confidence():
    """The first present of QPCA, PCA and CWA confidence."""
    return F.coalesce("qpca_confidence", "pca_confidence", "cwa_confidence")


def compute_confidence(rules: DataFrame, facts: DataFrame, kind: str = "pca", minimum: float = 0.1, injective: bool = False, top_k: int = 0) -> DataFrame:
    """Rules whose ``kind`` (cwa, pca, qpca) confidence reaches ``minimum`` (0.001 at least); ``top_k``: the best by confidence,
    head coverage and ``canon``."""
    c = F.col(f"{kind}_confidence")
    out = with_confidences(rules, facts, injective).where(c >= max(minimum, MIN_CONFIDENCE))
    return out.orderBy(c.desc(), F.desc("head_coverage"), "canon").limit(top_k) if top_k else out


def with_lift(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """Rules with ``lift``: the default confidence over the probability of the head's constant if it stands on the lower side, else
    over the mode probability of that side. No confidence, no lift."""
    cards = cut(property_cardinalities(facts), "cards")
    const = F.when(F.col("lower_side") == "subject", F.col("head.s.const")).otherwise(F.col("head.o.const"))
    out = rules.drop("lift").withColumn("_p", F.col("head.p"))
    out = out.join(F.broadcast(cards.select(F.col("p").alias("_p"), "lower_side")), "_p", "left").withColumn("_v", const)
    modes = mode_probabilities(facts, cards).select(F.col("p").alias("_p"), "mode_probability")
    probs = constant_probabilities(facts, cards).select(F.col("p").alias("_p"), F.col("v").alias("_v"), "probability")
    out = out.join(F.broadcast(modes), "_p", "left").join(probs, ["_p", "_v"], "left")
    chance = F.when(F.col("_v").isNotNull(), F.col("probability")).otherwise(F.col("mode_probability"))
    return out.withColumn("lift", default_confidence() / chance).drop("_p", "_v", "lower_side", "mode_probability", "probability")


def recount_support(rules: DataFrame, facts: DataFrame, min_support: int = 1, min_head_coverage: float = 0.0, injective: bool = False) -> DataFrame:
    """Support, head size, head support and head coverage counted again on ``facts``, and rules below the thresholds
    left out."""
    from lodeweave.operators.mining import head_sizes

    pairs = predicted_pairs(rules, facts, injective)
    n = pairs.join(facts.select("s", "p", "o"), ["s", "p", "o"], "left_semi").groupBy("rule_id").agg(F.count("*").alias("support"))
    sizes = head_sizes(facts, injective).withColumnRenamed("p", "_p")
    rows = facts.where("s <> o") if injective else facts
    by = {c: rows.groupBy(F.col("p").alias("_p"), F.col(c).alias("_c")).agg(F.count("*").alias(f"_n{c}")) for c in ("s", "o")}
    base = rules.drop("support", "head_size", "head_support", "head_coverage").withColumn("_p", F.col("head.p"))
    out = base.join(n, "rule_id").join(F.broadcast(sizes), "_p")
    for c in ("s", "o"):
        out = out.withColumn("_c", F.col(f"head.{c}.const")).join(by[c], ["_p", "_c"], "left").drop("_c")
    out = out.withColumn("head_support", F.coalesce("_ns", "_no", "head_size")).withColumn("head_coverage", F.col("support") / F.col("head_size")).drop("_p", "_ns", "_no")
    return out.where((F.col("support") >= min_support) & (F.col("support") >= F.floor(F.col("head_size") * min_head_coverage + 0.5)))
