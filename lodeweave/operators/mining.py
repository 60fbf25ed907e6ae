"""Mining closed Horn rules: supports of all rules of a shape in one job, pruned by what shorter rules support."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.cardinalities import property_cardinalities
from lodeweave.operators.patterns import RulePattern, matches
from lodeweave.plans.lineage import cut, drop_shuffles
from lodeweave.plans.shapes import CONST, Shape, add_atom, body_order, closed_shapes, differs_from_head, distinct_atoms, head_values, key_columns, keys, renamed, rule_columns
from lodeweave.plans.sizing import broadcast_if_small

CONSTANTS = ("nowhere", "anywhere", "subject", "object", "lower", "lower_head")


@dataclass(frozen=True)
class MiningTask:
    """Thresholds, constraints and patterns. Thresholds below their least value are raised to it."""

    min_head_size: int = 100
    min_support: int = 1
    min_head_coverage: float = 0.0
    min_atom_size: int = 0
    max_length: int = 3
    constants: str = "nowhere"
    constants_for: dict[int, str] = field(default_factory=dict)
    injective: bool = False
    only_predicates: tuple[int, ...] | None = None
    without_predicates: tuple[int, ...] = ()
    without_duplicate_predicates: bool = False
    families: tuple[tuple[int, ...], ...] = ()
    patterns: tuple[RulePattern, ...] = ()
    top_k: int = 0
    allow_top_k_overflow: bool = False
    timeout_minutes: float = 0.0
    sample: float = 0.0
    margin: float = 0.0
    dynamic_margin: bool = False
    seed: int = 42

    def __post_init__(self):
        if self.constants not in CONSTANTS:
            raise ValueError(f"constants must be one of {CONSTANTS}")
        clamp = {"min_head_size": max(1, self.min_head_size), "min_support": max(1, self.min_support), "max_length": max(2, self.max_length)}
        if self.min_head_coverage:
            clamp["min_head_coverage"] = min(1.0, max(0.001, self.min_head_coverage))
        if self.timeout_minutes:
            clamp["timeout_minutes"] = max(1.0, self.timeout_minutes)
        for k, v in clamp.items():
            object.__setattr__(self, k, v)

    @property
    def sampled(self) -> bool:
        """Whether supports are estimated from a part of the head triples: a fixed share, or what the margin of error asks for."""
        return 0 < self.sample < 1 or self.margin > 0

    @property
    def with_constants(self) -> bool:
        return self.constants != "nowhere" or bool(self.constants_for)


def head_sizes(facts: DataFrame, injective: bool = False) -> DataFrame:
    """(``p``, ``head_size``): triples of a predicate, without reflexive ones if injective."""
    return (facts.where("s <> o") if injective else facts).groupBy("p").agg(F.count("*").alias("head_size"))


def heads(facts: DataFrame, task: MiningTask = MiningTask()) -> DataFrame:
    """Heads that reach the thresholds: (``p``, ``side`` of the constant or null, ``const``, ``head_size``, ``head_support``)."""
    facts = _allowed(facts, task)
    sizes = head_sizes(facts, task.injective).where(F.col("head_size") >= task.min_head_size)
    out = sizes.select("p", F.lit(None).cast("string").alias("side"), F.lit(None).cast("bigint").alias("const"), "head_size", F.col("head_size").alias("head_support"))
    if task.with_constants:
        lower = _lower_sides(facts, task)
        rows = facts.where("s <> o") if task.injective else facts
        for side, col, k in (("subject", "s", 0), ("object", "o", 1)):
            n = _constants_allowed(rows, task, "p", k, True, lower).groupBy("p", F.col(col).alias("const")).agg(F.count("*").alias("head_support"))
            out = out.unionByName(n.join(sizes, "p").select("p", F.lit(side).alias("side"), "const", "head_size", "head_support"))
    return out.where(F.col("head_support") >= _least(task))


def _least(task: MiningTask):
    return F.greatest(F.lit(task.min_support), F.ceil(F.round(F.col("head_size") * task.min_head_coverage, 6)))


def _allowed(facts: DataFrame, task: MiningTask) -> DataFrame:
    facts = facts.select("s", "p", "o")
    if task.only_predicates is not None:
        facts = facts.where(F.col("p").isin(list(task.only_predicates)))
    if task.without_predicates:
        facts = facts.where(~F.col("p").isin(list(task.without_predicates)))
    return facts


def _lower_sides(facts: DataFrame, task: MiningTask) -> DataFrame | None:
    """(``_lp``, ``_lside``): the lower-cardinality side of each predicate, where the task asks for it."""
    if not any(w and w.startswith("lower") for w in [task.constants, *task.constants_for.values()]):
        return None
    return broadcast_if_small(cut(property_cardinalities(facts).select(F.col("p").alias("_lp"), F.col("lower_side").alias("_lside")), "sides"))


def _constants_allowed(df: DataFrame, task: MiningTask, p: str, k: int, head: bool, lower: DataFrame | None) -> DataFrame:
    """Rows whose predicate ``p`` may have a constant at place ``k`` (0 subject, 1 object)."""
    place = ("subject", "object")[k]
    if lower is not None:
        df = df.join(lower, df[p] == F.col("_lp"), "left")

    def keep(where: str):
        if where.startswith("lower"):
            return F.lit(True) if where == "lower_head" and not head else F.col("_lside") == place
        return F.lit(where in ("anywhere", place))

    cond = F.when(F.lit(False), False)
    for predicate, where in task.constants_for.items():
        cond = cond.when(F.col(p) == predicate, keep(where))
    return df.where(cond.otherwise(keep(task.constants))).drop("_lp", "_lside")


def mine(facts: DataFrame, task: MiningTask = MiningTask()) -> DataFrame:
    """Closed rules with ``support``, ``head_size``, ``head_support`` and ``head_coverage``.

    ``facts`` (``s``, ``p``, ``o``) are distinct triples. Rules equal up to variable names and body order
    come once. Shapes are evaluated by length; the joins of a longer rule only keep combinations of head and body predicates
    that reach the support on their own. The rules go from shape to shape as tables, never to the driver; with
    ``top_k`` the k-th best head coverage so far becomes the threshold of the next length. Ties at the k-th
    place go by ``canon`` unless overflow is allowed. After ``timeout_minutes`` the lengths done so far are
    returned.
    """
    facts = _allowed(facts, task)
    if task.min_atom_size:
        least = task.min_support if task.min_atom_size < 0 else task.min_atom_size
        big = head_sizes(facts).where(F.col("head_size") >= least).select("p")
        facts = facts.join(F.broadcast(big), "p", "left_semi")
    facts = _marked(facts)
    lower = _lower_sides(facts, task)
    sizes = cut(head_sizes(facts, task.injective).where(F.col("head_size") >= task.min_head_size).withColumnRenamed("p", "p0"), "heads")
    wanted = head_predicates(task.patterns)
    sizes = broadcast_if_small(sizes if wanted is None else sizes.where(F.col("p0").isin(sorted(wanted))))
    source = facts
    if task.sampled:
        sizes = sizes.withColumn("rate", _rate(task))
        draw = F.pmod(F.xxhash64("s", "p", "o", F.lit(task.seed)), F.lit(1 << 30)) / (1 << 30)  # by value: the same whenever a stage is run again
        source = facts.join(sizes.select(F.col("p0").alias("p"), "rate"), "p").where(draw < F.col("rate")).select(facts.columns)
    near = _neighbours(facts, sizes, task)
    began, out, threshold = time.time(), None, task
    shapes = closed_shapes(task.max_length, task.with_constants)
    frontier: dict[Shape, DataFrame] = {}
    pairs: dict[Shape, DataFrame] = {}
    if task.max_length > 2 and task.with_constants:
        for pair in _pairs_with_constants(shapes):
            pairs[pair] = cut(_of_shape(facts, source, pair, sizes, near, lower, task), "pair")
            frontier[pair] = broadcast_if_small(pairs[pair].select(*key_columns(pair)))
    for length in range(2, task.max_length + 1):
        if task.patterns and all(p.exact and len(p.body) + 1 != length for p in task.patterns) and (length > 2 or task.max_length == 2):
            continue
        if task.timeout_minutes and time.time() - began > task.timeout_minutes * 60:
            break
        found = []
        for s in (s for s in shapes if len(s) == length):
            own = pairs[s] if s in pairs else _of_shape(facts, source, s, sizes, near, lower, threshold, frontier)
            if len(s) > 2 and s not in pairs and CONST not in {x for a in s for x in a}:
                own = cut(own, "shape")  # one after the other, so that their shuffles aren't on disk together
                drop_shuffles(facts.sparkSession)
            found.append(own)
        level = reduce(DataFrame.unionByName, found).dropDuplicates(["canon"])
        if length == 2 and task.max_length > 2:
            level = cut(level, "frontier")
            frontier |= _frontier(level)
        if task.patterns:
            level = level.where(reduce(lambda a, b: a | b, [matches(p) for p in task.patterns]))
        level = cut(level, f"rules-{length}")
        out = level if out is None else out.unionByName(level)
        if task.top_k:
            out = top_rules(out, task.top_k, task.allow_top_k_overflow)
            worst = out.agg(F.count("*").alias("n"), F.min("head_coverage").alias("hc")).first()
            if worst["n"] >= task.top_k:
                threshold = replace(task, min_head_coverage=max(worst["hc"], task.min_head_coverage))
    if out is None:
        out = _of_shape(facts.limit(0), source.limit(0), shapes[0], sizes, near, lower, task)
    return out.withColumn("rule_id", F.xxhash64("canon")).select("rule_id", *out.columns)


def _marked(facts: DataFrame) -> DataFrame:
    """Facts with ``s_is_object`` and ``o_is_subject``: whether a value occurs at the other place too."""
    s, o = (facts.select(F.col(c).alias(x), F.lit(True).alias(m)).distinct() for c, x, m in (("s", "o", "o_is_subject"), ("o", "s", "s_is_object")))
    return cut(facts.join(s, "o", "left").join(o, "s", "left").select("s", "p", "o", *[F.coalesce(m, F.lit(False)).alias(m) for m in ("s_is_object", "o_is_subject")]), "marked")


def _linked(facts: DataFrame, shape: Shape, j: int) -> DataFrame:
    """The marked facts that atom ``j`` may be: values of its variables occur at the places where other atoms have them."""
    s, o = shape[j]
    others = [a for i, a in enumerate(shape) if i != j]
    if s != CONST and any(a[1] == s for a in others):
        facts = facts.where("s_is_object")
    if o != CONST and any(a[0] == o for a in others):
        facts = facts.where("o_is_subject")
    return facts


def head_predicates(patterns: tuple[RulePattern, ...]) -> set[int] | None:
    """The head predicates that patterns leave, so that other heads are never joined; None if one of them leaves all."""
    out: set[int] = set()
    for p in patterns:
        item = p.head.p if p.head else None
        if item is None or item.kind not in ("constant", "one_of"):
            return None
        out |= {item.value} if item.kind == "constant" else set(item.value)
    return out if patterns else None


def top_rules(rules: DataFrame, k: int, overflow: bool = False) -> DataFrame:
    """The ``k`` rules of largest head coverage; with ``overflow`` all that tie with the last."""
    if not overflow:
        return rules.orderBy(F.desc("head_coverage"), "canon").limit(k)
    worst = rules.orderBy(F.desc("head_coverage")).limit(k).agg(F.min("head_coverage").alias("_w"))
    return rules.crossJoin(F.broadcast(worst)).where(F.col("head_coverage") >= F.col("_w")).drop("_w")


def _neighbours(facts: DataFrame, sizes: DataFrame, task: MiningTask) -> DataFrame:
    """(``p0``, ``pn``, ``met``): bit 2 a + b of ``met`` is set if enough triples of the head predicate ``p0`` have at place a (0 subject,
    1 object) a value that the body predicate ``pn`` has at place b. Rules with that link can't support more."""
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in ((0, "s"), (1, "o"))]))
    ends = facts.select("p", places.alias("x")).groupBy("x.v", "p", "x.k").agg(F.count("*").alias("n"))  # a hub's triples are counted before they meet
    # Values that occur with the same predicates at the same places are taken together, so that no pairs of predicates are listed for each value.
    own = ends.groupBy("v").agg(F.collect_list(F.struct("p", "k", "n")).alias("own"))
    kinds = F.array_sort(F.transform("own", lambda x: F.struct(x["p"], x["k"])))
    alike = own.select(F.explode("own").alias("x"), kinds.alias("kinds")).groupBy(F.col("x.p").alias("p0"), F.col("x.k").alias("hv"), "kinds").agg(F.sum("x.n").alias("n"))
    n = alike.join(sizes, "p0").select("p0", "hv", "n", "head_size", F.inline("kinds").alias("pn", "sn")).groupBy("p0", "hv", "pn", "sn").agg(F.sum("n").alias("n"), F.first("head_size").alias("head_size"))
    met = n.where(F.col("n") >= _least(task)).groupBy("p0", "pn").agg(F.sum(F.expr("shiftleft(1, 2 * hv + sn)")).cast("int").alias("met"))
    return broadcast_if_small(cut(met, "neighbours"))


def _frontier(rules: DataFrame) -> dict[Shape, DataFrame]:
    """(``p0``, ``p1``) of the rules of two atoms on the head's pair, by their shape: a longer rule with both atoms can't support more."""
    plain = rules.where("head.s.is_var and head.o.is_var").select(F.col("head.p").alias("p0"), F.col("body")[0].alias("b")).where("b.s.is_var and b.o.is_var")
    return {((0, 1), (x, 1 - x)): broadcast_if_small(plain.where(F.col("b.s.var") == x).select("p0", F.col("b.p").alias("p1"))) for x in (0, 1)}


def _pairs_with_constants(shapes: list[Shape]) -> list[Shape]:
    """The head and one body atom on its variables, closed or not, of all longer shapes, where one of both has a constant."""
    found = {renamed((s[0], atom)) for s in shapes if len(s) > 2 for atom in s[1:] if set(s[0]) & set(atom) - {CONST}}
    return sorted(p for p in found if CONST in p[0] or CONST in p[1])


def _of_shape(facts: DataFrame, source: DataFrame, shape: Shape, sizes: DataFrame, near: DataFrame, lower: DataFrame | None, task: MiningTask, frontier: dict[Shape, DataFrame] = {}) -> DataFrame:
    df = add_atom(None, _linked(source, shape, 0), shape, 0, task.injective).join(sizes.select("p0"), "p0", "left_semi")
    if CONST in shape[0]:
        df = _constants_allowed(df, task, "p0", shape[0].index(CONST), True, lower)
        if not task.sampled:  # a rule can't support more than its head
            held = df.groupBy("p0", "k0").agg(F.count("*").alias("support")).join(sizes, "p0").where(F.col("support") >= _least(task))
            df = df.join(held.select("p0", "k0"), ["p0", "k0"], "left_semi")
    head_vars = {x: k for k, x in enumerate(shape[0]) if x != CONST}
    links = {j: sum(1 << (2 * head_vars[x] + place) for place, x in enumerate(shape[j]) if x in head_vars) for j in range(1, len(shape))}
    for mask in sorted(set(links.values()) - {0}):  # heads that some atom can't be linked to are left out before any join
        df = df.join(F.broadcast(near.where(F.col("met").bitwiseAND(mask) == mask).select("p0").distinct()), "p0", "left_semi")
    before, bound = [0], set(head_vars)
    for j in body_order(shape, set(head_vars)):
        # An atom whose places are all known is looked up in the facts; the many rows found so far aren't sorted for it.
        known = before != [0] and set(shape[j]) <= bound
        pair = renamed((shape[0], shape[j]))
        limit = frontier.get(pair) if len(shape) > 2 else None
        of_atom = _linked(facts, shape, j)
        if limit is not None and CONST in shape[j]:
            c = ("s", "o")[shape[j].index(CONST)]
            of_atom = of_atom.join(broadcast_if_small(limit.select(F.col("p1").alias("p"), F.col("k1").alias(c)).distinct()), ["p", c], "left_semi")
        df = add_atom(df, of_atom.hint("shuffle_hash") if known else of_atom, shape, j, task.injective)
        bound |= set(shape[j])
        mask = links[j]
        if limit is not None:
            own = {"p1": f"p{j}", "k1": f"k{j}"}
            df = df.join(limit.withColumnsRenamed(own), [own.get(c, c) for c in limit.columns], "left_semi")
        elif mask:
            df = df.join(near.withColumnRenamed("pn", f"p{j}"), ["p0", f"p{j}"]).where(F.col("met").bitwiseAND(mask) == mask).drop("met")
        if CONST in shape[j]:
            df = _constants_allowed(df, task, f"p{j}", shape[j].index(CONST), False, lower)
        for i in before:
            if task.without_duplicate_predicates:
                df = df.where(F.col(f"p{i}") != F.col(f"p{j}"))
            for family in task.families:
                df = df.where(~(F.col(f"p{i}").isin(list(family)) & F.col(f"p{j}").isin(list(family)) & (F.col(f"p{i}") != F.col(f"p{j}"))))
        before.append(j)
        if task.injective:
            df = df.where(differs_from_head(shape, j))
    if conditions := distinct_atoms(shape):
        df = df.where(reduce(lambda a, b: a & b, conditions))
    group = keys(shape)
    n = df.select(*group, *head_values(shape)).distinct().groupBy(*group).agg(F.count("*").alias("support")).join(sizes, "p0")
    if task.sampled:
        n = n.withColumn("support", F.round(F.col("support") / F.col("rate")).cast("long"))
    n = n.where(F.col("support") >= _least(task))
    if CONST in shape[0]:
        c = ("s", "o")[shape[0].index(CONST)]
        rows = facts.where("s <> o") if task.injective else facts
        supports = rows.groupBy(F.col("p").alias("p0"), F.col(c).alias("k0")).agg(F.count("*").alias("head_support"))
        n = n.join(supports, ["p0", "k0"])
    else:
        n = n.withColumn("head_support", F.col("head_size"))
    ratio = (1 / F.col("rate")).cast("float") if task.sampled else F.lit(None).cast("float")
    return n.select(*rule_columns(shape), "support", "head_support", "head_size", (F.col("support") / F.col("head_size")).alias("head_coverage"), ratio.alias("support_increase_ratio"))


def _rate(task: MiningTask):
    """The part of each head's triples to look at: ``sample``, or ``sample_fraction`` at the least head coverage."""
    if not task.margin:
        return F.lit(float(task.sample))
    hc, margin = task.min_head_coverage or 0.01, task.margin
    if task.dynamic_margin and 0 < hc < 1:
        margin = min(-margin / math.log10(hc), margin)
    n = max(hc * (1 - hc) / (margin / 1.96) ** 2, 1.0)
    return F.least(F.lit(1.0), F.lit(n) / F.col("head_size"))


def sample_fraction(head_size: int, head_coverage: float, margin: float, dynamic: bool = False) -> float:
    """The part of head triples that estimates ``head_coverage`` within ``margin`` at 95 %."""
    if dynamic and 0 < head_coverage < 1:
        margin = min(-margin / math.log10(head_coverage), margin)
    if margin <= 0 or head_size <= 0:
        return 1.0
    n = head_coverage * (1 - head_coverage) / (margin / 1.96) ** 2
    return min(1.0, max(n, 1.0) / head_size)


def without_quasi_binding(rules: DataFrame, facts: DataFrame, injective: bool = False) -> DataFrame:
    """Rules of which no atom with a constant always has the same instance: its variable takes several values."""
    from lodeweave.operators.measures import by_shape, instances

    bad = None
    for shape, own in by_shape(rules):
        for j, atom in enumerate(shape):
            if CONST not in atom:
                continue
            v = next((f"v{x}" for x in atom if x != CONST), None)
            values = instances(own, facts, shape, injective, head=True).select("rule_id", F.col(v).alias("v")).distinct()
            one = values.groupBy("rule_id").agg(F.count("*").alias("n")).where("n <= 1").select("rule_id")
            bad = one if bad is None else bad.unionByName(one)
    return rules if bad is None else rules.join(bad.distinct(), "rule_id", "left_anti")
