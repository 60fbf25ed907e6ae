"""Operators on rule tables: order, filters, pruning, similarity, text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.operators.cardinalities import property_cardinalities
from lodeweave.operators.measures import by_shape, hop_bodies, instances, is_hop, predicted_pairs
from lodeweave.operators.patterns import RulePattern, matches
from lodeweave.operators.unions import entries
from lodeweave.plans.lineage import cut
from lodeweave.plans.shapes import CONST, canonical, side
from lodeweave.plans.sizing import broadcast_if_small

#: Measures in the order they are printed, and their columns.
MEASURES = {
    "Support": "support", "HeadSupport": "head_support", "HeadCoverage": "head_coverage", "SupportIncreaseRatio": "support_increase_ratio", "HeadSize": "head_size",
    "BodySize": "body_size", "CwaConfidence": "cwa_confidence", "Lift": "lift", "QpcaBodySize": "qpca_body_size", "QpcaConfidence": "qpca_confidence",
    "PcaBodySize": "pca_body_size", "PcaConfidence": "pca_confidence", "Cluster": "cluster",
}
_DEFAULT_ORDER = ("cluster", "qpca_confidence", "pca_confidence", "cwa_confidence", "head_coverage")


def column_of(measure: str) -> str:
    """The column of a measure by its name in either spelling; Confidence is the closed-world one."""
    name = measure[:1].upper() + measure[1:]
    return MEASURES["CwaConfidence" if name == "Confidence" else name]


def default_order(rules: DataFrame) -> list[Column]:
    have = [c for c in _DEFAULT_ORDER if c in rules.columns]
    return [F.asc_nulls_last(c) if c == "cluster" else F.desc_nulls_last(c) for c in have] + [F.asc("canon")]


def sort_rules(rules: DataFrame, by: Sequence[tuple[str, bool]] = ()) -> DataFrame:
    """Rules by the default order, or by (measure or RuleLength, reversed): measures fall, Cluster and RuleLength rise;
    ``canon`` decides ties."""
    order = []
    for name, reverse in by:
        rises = (name.lower() in ("cluster", "rulelength")) != reverse
        c = F.size("body") if name.lower() == "rulelength" else F.col(column_of(name))
        order.append(c.asc_nulls_last() if rises else c.desc_nulls_last())
    return rules.orderBy(*(order + [F.asc("canon")] if by else default_order(rules)))


def filter_rules(rules: DataFrame, measures: Mapping[str, tuple[float, float]] = {}, patterns: Sequence[RulePattern] = (), atoms: Sequence[Column] = ()) -> DataFrame:
    """Rules within all measure ranges (inclusive), matching any pattern, and with an atom for each condition of ``atoms``."""
    for name, (lo, hi) in measures.items():
        c = F.size("body") + 1 if name.lower() == "rulelength" else F.col(column_of(name))
        rules = rules.where(c.between(lo, hi))
    if patterns:
        rules = rules.where(reduce(lambda a, b: a | b, [matches(p) for p in patterns]))
    return reduce(lambda r, cond: r.where(cond), atoms, rules)


def any_atom(test) -> Column:
    """Whether the head or a body atom fulfils ``test`` (a function of the atom column)."""
    return F.exists(F.concat(F.array("head"), F.col("body")), test)


def sub_rules(rules: DataFrame) -> DataFrame:
    """(``rule_id``, ``parent``, ``missing``): canonical text of each rule whose body lacks one or more atoms of this one."""
    out = rules.sparkSession.createDataFrame([], "rule_id long, parent string, missing int")
    for shape, own in by_shape(rules):
        n = len(shape) - 1
        for size in range(1, n):
            for kept in combinations(range(1, n + 1), size):
                sub = tuple(shape[j] for j in (0, *kept))
                cols = {f"_p{i}": F.col(f"p{j}") for i, j in enumerate((0, *kept))} | {f"_k{i}": F.col(f"k{j}") for i, j in enumerate((0, *kept)) if CONST in shape[j]}
                part = own.select("rule_id", *[c.alias(k) for k, c in cols.items()]).withColumnsRenamed({k: k[1:] for k in cols})
                out = out.unionByName(part.select("rule_id", canonical(sub).alias("parent"), F.lit(n - size).alias("missing")))
    return out


def _ancestors(rules: DataFrame) -> DataFrame:
    """(``rule_id``, ``parent_id``, ``missing``) of the sub-rules that are in the table, the nearest of each path only: those
    without another present rule between."""
    ids = rules.select(F.col("canon").alias("parent"), F.col("rule_id").alias("parent_id"))
    edges = cut(sub_rules(rules).join(ids, "parent").select("rule_id", "parent_id", "missing").distinct(), "lattice")
    a, b = edges.alias("a"), edges.alias("b")
    between = a.join(b, F.col("a.parent_id") == F.col("b.rule_id")).select(F.col("a.rule_id").alias("rule_id"), F.col("b.parent_id").alias("parent_id")).distinct()
    return edges.join(between, ["rule_id", "parent_id"], "left_anti")


def prune_maximal(rules: DataFrame) -> DataFrame:
    """Rules that aren't a sub-rule of another rule of the table."""
    parents = _ancestors(rules).select(F.col("parent_id").alias("rule_id")).distinct()
    return rules.join(parents, "rule_id", "left_anti")


def prune_closed(rules: DataFrame, measure: str) -> DataFrame:
    """Rules none of whose direct sub-rules has the same value of ``measure``."""
    v = rules.select(F.col("rule_id").alias("parent_id"), F.col(column_of(measure)).alias("_v"))
    own = rules.select("rule_id", F.col(column_of(measure)).alias("_w"))
    same = _ancestors(rules).where("missing = 1").join(v, "parent_id").join(own, "rule_id").where("_v = _w").select("rule_id").distinct()
    return rules.join(same, "rule_id", "left_anti")


def prune_skyline(rules: DataFrame, measure: str) -> DataFrame:
    """Rules whose ``measure`` is greater than that of all their nearest sub-rules in the table."""
    v = rules.select(F.col("rule_id").alias("parent_id"), F.col(column_of(measure)).alias("_v"))
    own = rules.select("rule_id", F.col(column_of(measure)).alias("_w"))
    beaten = _ancestors(rules).join(v, "parent_id").join(own, "rule_id").where("_v >= _w").select("rule_id").distinct()
    return rules.join(beaten, "rule_id", "left_anti")


def known_pairs(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """(``rule_id``, ``s``, ``p``, ``o``): the facts that each rule predicts (not injective), found from the facts, not among all its predictions."""
    out = rules.sparkSession.createDataFrame([], "rule_id long, s long, p long, o long")
    for shape, own in by_shape(rules):
        found = instances(own, facts.select("s", "p", "o"), shape, False, head=True)
        out = out.unionByName(found.select("rule_id", side(shape, 0, 0).alias("s"), F.col("p0").alias("p"), side(shape, 0, 1).alias("o")).distinct())
    return out


def prune_data_coverage(rules: DataFrame, facts: DataFrame, injective: bool = True, functional: bool = False, existing: bool = True) -> DataFrame:
    """Rules that are the best one (default order) of some fact they predict, or if not ``existing`` of any triple; ``functional``: only
    the best prediction of each higher-side task counts."""
    order = rules.select("rule_id", F.struct(*[F.coalesce(-F.col(c), F.lit(float("inf"))).alias(c) for c in _DEFAULT_ORDER[1:] if c in rules.columns], "canon", "rule_id").alias("_o"))
    if existing and not functional and not injective:
        pairs = known_pairs(rules, facts).join(broadcast_if_small(order, 100_000), "rule_id")
        best = pairs.groupBy("s", "p", "o").agg(F.min("_o").alias("_o"))
        return rules.join(best.select("_o.rule_id").distinct(), "rule_id", "left_semi")
    pairs = predicted_pairs(rules, facts, injective).join(order, "rule_id")
    if functional:
        sides = property_cardinalities(facts).select("p", "higher_side")
        v = F.when(F.col("higher_side") == "subject", F.col("s")).otherwise(F.col("o"))
        best = pairs.join(F.broadcast(sides), "p").groupBy("p", v.alias("v")).agg(F.min("_o").alias("_o"))
    else:
        best = (pairs.join(facts, ["s", "p", "o"], "left_semi") if existing else pairs).groupBy("s", "p", "o").agg(F.min("_o").alias("_o"))
    return rules.join(best.select("_o.rule_id").distinct(), "rule_id", "left_semi")


def graph_aware(rules: DataFrame, fact_graphs: DataFrame) -> DataFrame:
    """Atoms with ``graphs``: the graphs in which their predicate has triples."""
    sets = fact_graphs.groupBy("p").agg(F.array_sort(F.collect_set("g")).alias("graphs"))
    by_p = F.broadcast(sets.agg(F.map_from_entries(F.collect_list(F.struct("p", "graphs"))).alias("_m")))  # one entry for each predicate
    add = lambda a: a.withField("graphs", F.col("_m")[a["p"]])
    return rules.crossJoin(by_p).withColumn("head", add(F.col("head"))).withColumn("body", F.transform("body", add)).drop("_m")


def instantiate(rules: DataFrame, facts: DataFrame, injective: bool = True) -> DataFrame:
    """Ground instances of each rule: (``rule_id``, ``head``, ``body``) with ids for items, ``result``."""
    from lodeweave.operators.prediction import classify

    out = None
    for shape, own in by_shape(rules):
        found = instances(own, facts, shape, injective)
        if injective:
            from lodeweave.plans.shapes import differs_from_head

            for j in range(1, len(shape)):
                found = found.where(differs_from_head(shape, j))
        triple = lambda j: F.struct(side(shape, j, 0).alias("s"), F.col(f"p{j}").alias("p"), side(shape, j, 1).alias("o"))  # noqa: E731, B023
        part = found.select("rule_id", triple(0).alias("head"), F.array(*[triple(j) for j in range(1, len(shape))]).alias("body"))
        out = part if out is None else out.unionByName(part)
    return classify(out.select("*", "head.s", "head.p", "head.o"), facts).select("rule_id", "head", "body", "result")


def instance_counts(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """(``rule_id``, ``result``, ``n``): how many rows ``instantiate`` has (injective). Those of two-hop bodies are counted by the values in their middle,
    not listed; of other shapes they are listed."""
    facts = facts.select("s", "p", "o")
    sides = property_cardinalities(facts).select("p", "higher_side", "average")
    hops, listed, known = [], [], []
    for shape, own in by_shape(rules):
        if is_hop(shape):
            hops.append(hop_bodies(own, shape, sides))
            known.append(instances(own, facts, shape, True, head=True).groupBy("rule_id").agg(F.count("*").alias("known")))
        else:
            listed.append(own.select("rule_id"))
    out = rules.sparkSession.createDataFrame([], "rule_id long, result string, n long")
    if listed:
        others = rules.join(reduce(DataFrame.unionByName, listed), "rule_id", "left_semi")
        out = out.unionByName(instantiate(others, facts).groupBy("rule_id", "result").agg(F.count("*").alias("n")))
    if not hops:
        return out
    hops = broadcast_if_small(cut(reduce(DataFrame.unionByName, hops), "hops"), 100_000)
    ends = entries(facts.where("s <> o"))
    end = lambda x, v: ends.select(F.col("p").alias(f"p{x}"), F.col("k").alias(f"k{x}"), F.col("v").alias(v), "z")
    per_z = ends.groupBy(F.col("p").alias("pb"), F.col("k").alias("kb"), "z").agg(F.count("*").alias("nb"))
    body = ["pa", "ka", "pb", "kb"]
    bodies = F.broadcast(hops.select(body).distinct())
    all_a = end("a", "v").groupBy("pa", "ka", "z").agg(F.count("*").alias("na"))
    total = all_a.join(bodies, ["pa", "ka"]).join(per_z, ["pb", "kb", "z"]).groupBy(body).agg(F.sum(F.col("na") * F.col("nb")).alias("total"))
    met = cut(end("a", "v").join(bodies, ["pa", "ka"]).join(end("b", "v"), ["pb", "kb", "v", "z"]).groupBy(*body, "v").agg(F.count("*").alias("n")), "met-itself")
    looped = met.groupBy(body).agg(F.sum("n").alias("looped"))  # both head variables have one value
    values = facts.select("p", F.lit("subject").alias("higher_side"), F.col("s").alias("v")).unionByName(facts.select("p", F.lit("object").alias("higher_side"), F.col("o").alias("v"))).distinct()
    seen = cut(values.join(hops, ["p", "higher_side"]).select("rule_id", *body, "v"), "seen")
    of_seen = seen.join(end("a", "v"), ["pa", "ka", "v"]).groupBy("rule_id", "pb", "kb", "z").agg(F.count("*").alias("na"))
    of_seen = of_seen.join(per_z, ["pb", "kb", "z"]).groupBy("rule_id").agg(F.sum(F.col("na") * F.col("nb")).alias("seen"))
    loops_seen = seen.join(met, [*body, "v"]).groupBy("rule_id").agg(F.sum("n").alias("loops_seen"))
    counts = hops.select("rule_id", *body).join(total, body, "left").join(looped, body, "left")
    for more in (of_seen, loops_seen, reduce(DataFrame.unionByName, known)):
        counts = counts.join(more, "rule_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("total", "looped", "seen", "loops_seen", "known")}
    there = n["seen"] - n["loops_seen"]
    kinds = {"Positive": n["known"], "Negative": there - n["known"], "PcaPositive": n["total"] - n["looped"] - there}
    each = F.array(*[F.struct(F.lit(k).alias("result"), c.cast("long").alias("n")) for k, c in kinds.items()])
    return out.unionByName(counts.select("rule_id", F.inline(each)).where("n > 0"))


def _item_similarity(x: Column, y: Column) -> Column:
    equal = ~x["is_var"] & ~y["is_var"] & (x["const"] == y["const"])
    return F.when(x["is_var"] & y["is_var"], 1.0).when(x["is_var"] != y["is_var"], 0.5).when(equal, 1.0).otherwise(0.0)


def _atom_similarity(a: Column, b: Column) -> Column:
    constants = lambda c: F.when(~a[c]["is_var"] & ~b[c]["is_var"] & (a[c]["const"] == b[c]["const"]), 1.0).otherwise(0.0)
    same = 1.0 + _item_similarity(a["s"], b["s"]) + _item_similarity(a["o"], b["o"])
    return F.when(a["p"] == b["p"], same).otherwise(constants("s") + constants("o"))


#: Bodies up to this length are assigned by an expression over all permutations, longer ones by ``_best_assignment``.
_PERMUTED = 3


def _best_assignment(a: Column, b: Column) -> Column:
    """The greatest sum of similarities of the atoms of the shorter body with different atoms of the longer one: atom by atom of the
    longer, the best sum for each subset (bits of ``k``) of the shorter."""
    n = F.least(F.size(a), F.size(b))
    few, many = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    bit = lambda i: F.call_function("shiftleft", F.lit(1), i)
    subsets = F.sequence(F.lit(0), bit(n) - 1)
    score = lambda i, y: F.coalesce(_atom_similarity(F.get(few, i), y), F.lit(0.0))
    with_y = lambda sums, k, y: F.array_max(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(k.bitwiseAND(bit(i)) != 0, F.get(sums, k - bit(i)) + score(i, y))))
    none = F.transform(subsets, lambda k: F.when(k == 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))))
    sums = F.aggregate(many, none, lambda sums, y: F.transform(subsets, lambda k: F.greatest(F.get(sums, k), with_y(sums, k, y))))
    return F.get(sums, bit(n) - 1)


def longest_body(*tables: DataFrame) -> int:
    """The number of body atoms of the longest rule."""
    return max(t.agg(F.max(F.size("body"))).first()[0] or 1 for t in tables)


def atoms_similarity(max_body: int = 2, left: str = "a", right: str = "b") -> Column:
    """Similarity of two rules (columns <left>_head, <left>_body, ...): the best assignment of body atoms plus the heads, over
    three times the shorter rule's length."""
    n, m = F.size(f"{left}_body"), F.size(f"{right}_body")
    options = []
    for i in range(1, min(max_body, _PERMUTED) + 1):
        for j in range(1, min(max_body, _PERMUTED) + 1):
            k = min(i, j)
            sums = []
            for order in permutations(range(max(i, j)), k):
                pairs = zip(range(k), order) if i <= j else zip(order, range(k))
                sums.append(reduce(lambda x, y: x + y, [F.coalesce(_atom_similarity(F.get(f"{left}_body", F.lit(x)), F.get(f"{right}_body", F.lit(y))), F.lit(0.0)) for x, y in pairs]))
            best = F.greatest(*sums) if len(sums) > 1 else sums[0]
            options.append(((n == i) & (m == j), best))
    total = reduce(lambda c, o: c.when(*o), options[1:], F.when(*options[0]))
    if max_body > _PERMUTED:
        total = total.otherwise(_best_assignment(F.col(f"{left}_body"), F.col(f"{right}_body")))
    return (total + _atom_similarity(F.col(f"{left}_head"), F.col(f"{right}_head"))) / (3 * (F.least(n, m) + 1))


def measure_similarity(name: str, left: str = "a", right: str = "b") -> Column:
    """1 - |difference| of a share (Support means head coverage), (max - |difference|) / max for lift and length."""
    if name in ("lift", "length"):
        x, y = (F.size(f"{p}_body") + 1 if name == "length" else F.col(f"{p}_lift") for p in (left, right))
        return (F.greatest(x, y) - F.abs(x - y)) / F.greatest(x, y)
    c = {"support": "head_coverage", "confidence": "cwa_confidence", "pca": "pca_confidence", "qpca": "qpca_confidence"}[name]
    return 1 - F.abs(F.col(f"{left}_{c}") - F.col(f"{right}_{c}"))


def combined_similarity(parts: Sequence[tuple[float, Column]]) -> Column:
    """The weighted sum if the weights sum to 1, else the plain mean."""
    if abs(sum(w for w, _ in parts) - 1) < 1e-12:
        return reduce(lambda a, b: a + b, [w * c for w, c in parts])
    return reduce(lambda a, b: a + b, [c for _, c in parts]) / len(parts)


def similar_pairs(rules: DataFrame, against: DataFrame, similarity: Column | None = None, max_body: int | None = None, same_head: bool = False) -> DataFrame:
    """(``rule_id``, ``other_id``, ``similarity``) of each rule of ``rules`` with each of ``against`` but itself (a given set of
    rules against all). ``same_head``: only of equal head predicates. ``max_body``: of the longest rule unless given."""
    if similarity is None:
        similarity = atoms_similarity(max_body or longest_body(rules, against))
    a = rules.select(*[F.col(c).alias(f"a_{c}") for c in rules.columns])
    b = against.select(*[F.col(c).alias(f"b_{c}") for c in against.columns])
    on = (F.col("a_rule_id") != F.col("b_rule_id")) & ((F.col("a_head.p") == F.col("b_head.p")) if same_head else F.lit(True))
    return a.join(b, on).select(F.col("a_rule_id").alias("rule_id"), F.col("b_rule_id").alias("other_id"), similarity.alias("similarity"))


def find_similar(rules: DataFrame, rule: int | DataFrame, k: int, dissimilar: bool = False, max_body: int | None = None, similarity: Column | None = None) -> DataFrame:
    """The ``k`` rules most (or least) like one rule, given by its id or as a table of one row."""
    one = rules.where(F.col("rule_id") == rule) if isinstance(rule, int) else rule
    s = similar_pairs(one, rules, similarity, max_body=max_body)
    order = F.asc("similarity") if dissimilar else F.desc("similarity")
    return s.orderBy(order, "other_id").limit(k)


def cluster_rules(rules: DataFrame, min_neighbours: int = 5, min_similarity: float = 0.9, max_body: int | None = None, by_head: bool = True, similarity: Column | None = None) -> DataFrame:
    """Rules with ``cluster``: density clusters in the order of ``canon`` without noise, within equal head predicates or over all.

    A rule starts a cluster; the rules like it that are still free join, and if there are ``min_neighbours`` of them at
    least (the rule itself counted), each is expanded in its turn. Only links of similar rules go to a task.
    """
    from lodeweave.plans.lineage import cut as write

    group = F.col("head.p") if by_head else F.lit(0).cast("long")
    keyed = write(rules.select("*", group.alias("grp")), "to-cluster")
    links = similar_pairs(keyed, keyed, similarity, max_body=max_body, same_head=by_head).where(F.col("similarity") >= min_similarity)
    near = links.groupBy("rule_id").agg(F.collect_list("other_id").alias("near"))
    nodes = keyed.select("rule_id", "canon", "grp").join(near, "rule_id", "left")

    def clusters(pdf):
        pdf = pdf.sort_values("canon")
        near = {r: list(n) if n is not None else [] for r, n in zip(pdf["rule_id"], pdf["near"])}
        place = {r: i for i, r in enumerate(pdf["rule_id"])}
        label: dict[int, int] = {}
        k = 0
        for r in pdf["rule_id"]:
            if r in label:
                continue
            label[r] = k
            queue = [r]
            while queue:
                x = queue.pop(0)
                free = sorted((y for y in near[x] if y not in label), key=place.get)
                if len(free) + 1 >= min_neighbours:
                    for y in free:
                        label[y] = k
                        queue.append(y)
            k += 1
        return pdf.assign(cluster=[label[r] for r in pdf["rule_id"]])[["rule_id", "grp", "cluster"]]

    found = nodes.groupBy("grp").applyInPandas(clusters, "rule_id long, grp long, cluster int")
    sizes = write(found, "clusters")
    starts = sizes.groupBy("grp").agg((F.max("cluster") + 1).alias("n"))
    from pyspark.sql import Window

    offset = F.coalesce(F.sum("n").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.join(F.broadcast(starts.select("grp", offset.alias("_from"))), "grp")
    return rules.drop("cluster").join(sizes.select("rule_id", (F.col("cluster") + F.col("_from")).cast("int").alias("cluster")), "rule_id")


def rule_text(rules: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(``rule_id``, ``text``): ``( ?a <p> ?b ) ^ ... -> ( ... ) | measure: value, ...``; ``names`` (``id``, ``name``) replaces ids."""
    flat = rules.select("rule_id", F.posexplode(F.concat("body", F.array("head"))).alias("n", "a"), F.size("body").alias("size"))
    ids = {c: F.col(f"a.{c}.const") for c in ("s", "o")} | {"p": F.col("a.p")}
    for c, v in ids.items():
        if names is None:
            flat = flat.withColumn(f"_{c}", v.cast("string"))
        else:
            side_names = names.select(F.col("id").alias(f"_i{c}"), F.col("name").alias(f"_{c}"))
            flat = flat.join(side_names, v == F.col(f"_i{c}"), "left").drop(f"_i{c}")
    item = lambda c: F.when(F.col(f"a.{c}.is_var"), F.concat(F.lit("?"), F.expr(f"char(97 + a.{c}.var)"))).otherwise(F.col(f"_{c}"))
    atom = F.concat(F.lit("( "), item("s"), F.lit(" "), F.col("_p"), F.lit(" "), item("o"), F.lit(" )"))
    atoms = flat.select("rule_id", "size", F.struct("n", atom.alias("t")).alias("x")).groupBy("rule_id", "size").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    body = F.array_join(F.transform(F.slice("xs", F.lit(1), F.col("size")), lambda x: x["t"]), " ^ ")
    head = F.get("xs", F.col("size"))["t"]
    have = [(m, c) for m, c in MEASURES.items() if c in rules.columns]
    values = F.concat_ws(", ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{m[0].lower()}{m[1:]}: "), F.col(c).cast("string"))) for m, c in have])
    return atoms.join(rules.select("rule_id", values.alias("_m")), "rule_id").select("rule_id", F.concat(body, F.lit(" -> "), head, F.lit(" | "), "_m").alias("text"))

