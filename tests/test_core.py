import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import cardinalities as C
from lodeweave.operators import dataset as D
from lodeweave.operators import discretize as Z
from lodeweave.operators import prediction as P
from lodeweave.operators import ruleset as R
from lodeweave.operators import tasks as T
from lodeweave.operators.measures import recount_support, with_confidences, with_lift
from lodeweave.operators.mining import MiningTask, mine, sample_fraction
from lodeweave.operators.patterns import AtomPattern, Item, RulePattern, matches
from lodeweave.operators.tree_aggregate import predicate_figures
from lodeweave.plans.shapes import CONST, closed_shapes, is_closed, normal_form

SPO = "s long, p long, o long"


@pytest.fixture(scope="module")
def family():
    rnd = random.Random(11)
    out = {(rnd.randrange(8), p, rnd.randrange(8)) for p in (1, 2, 3) for _ in range(14)}
    return sorted(out | {(s, 2, o) for s, p, o in out if p == 1 and s % 2} | {(5, 1, 5)})


@pytest.fixture(scope="module")
def facts(spark, family):
    return spark.createDataFrame(family, SPO).persist()


def test_shapes_are_closed_and_unique():
    shapes = closed_shapes(3, True)
    assert all(is_closed(s) and normal_form(s) == s for s in shapes)
    assert len(set(shapes)) == len(shapes)
    assert [s for s in closed_shapes(3) if len(s) == 2] == [((0, 1), (0, 1)), ((0, 1), (1, 0))]


def bindings(shape, ps, ks, facts, injective):
    """All assignments of variables for a body (brute force)."""
    out = [{}]
    for j, (x, y) in enumerate(shape[1:], 1):
        new = []
        for b in out:
            for s, p, o in facts:
                if p != ps[j]:
                    continue
                c = dict(b)
                ok = True
                for item, v in ((x, s), (y, o)):
                    if item == CONST:
                        ok = ok and v == ks[j]
                    else:
                        ok = ok and c.setdefault(item, v) == v
                if ok and (not injective or len(set(c.values())) == len(c)):
                    new.append(c)
        out = new
    return out


def canonical(shape, ps):
    forms = []
    for order in permutations(range(1, len(shape))):
        names = {}
        text = ""
        for j in (0, *order):
            x, y = (names.setdefault(v, len(names)) for v in shape[j])
            text += f"?{x} {ps[j]} ?{y};"
        forms.append(text)
    return min(forms)


@pytest.mark.parametrize("injective", [False, True])
def test_mining_against_brute_force(facts, family, injective):
    want = {}
    heads = {p: {(s, o) for s, q, o in family if q == p and not (injective and s == o)} for p in (1, 2, 3)}
    for shape in closed_shapes(3):
        for ps in __import__("itertools").product((1, 2, 3), repeat=len(shape)):
            atoms = [(shape[j], ps[j]) for j in range(len(shape))]
            if len(set(atoms)) < len(atoms):
                continue
            pairs = {(b[0], b[1]) for b in bindings(shape, ps, {}, family, injective)}
            support = len(pairs & heads[ps[0]])
            if support >= 2:
                size = len(heads[ps[0]])
                want[canonical(shape, ps)] = (support, size, len(pairs))
    rules = mine(facts, MiningTask(min_head_size=1, min_support=2, injective=injective))
    got = with_confidences(rules, facts, injective).collect()
    assert {r["canon"]: (r["support"], r["head_size"], r["body_size"]) for r in got} == want
    for r in got:
        assert r["pca_body_size"] <= r["body_size"] and r["support"] <= r["qpca_body_size"] <= r["body_size"]


def test_partial_completeness(facts, family, spark):
    rules = mine(facts, MiningTask(min_head_size=1, min_support=2))
    cards = {r["p"]: r for r in C.property_cardinalities(facts).collect()}
    for r in with_confidences(rules, facts).where("size(body) = 1").collect():
        hp, bp = r["head"]["p"], r["body"][0]["p"]
        turned = r["body"][0]["s"]["var"] == 1
        pairs = {(o, s) if turned else (s, o) for s, p, o in family if p == bp}
        k = 0 if cards[hp]["higher_side"] == "subject" else 1
        known = {(s, o) for s, p, o in family if p == hp}
        n = {}
        for x in known:
            n[x[k]] = n.get(x[k], 0) + 1
        assert r["pca_body_size"] == sum(x[k] in n for x in pairs)
        total = 0
        for v in {x[k] for x in pairs}:
            free = max(0, cards[hp]["average"] - n.get(v, 0))
            unknown = [x for x in pairs if x[k] == v and x not in known]
            total += sum(x[k] == v and x in known for x in pairs) + max(0, len(unknown) - free)
        assert r["qpca_body_size"] == total


def test_constants_against_brute_force(facts, family):
    rules = mine(facts, MiningTask(min_head_size=1, min_support=2, max_length=2, constants="object")).where("canon like '%#%'")
    want = {}
    for a in {(p, o) for _, p, o in family}:
        for b in {(p, o) for _, p, o in family}:
            xs = {s for s, p, o in family if (p, o) == a} & {s for s, p, o in family if (p, o) == b}
            if a != b and len(xs) >= 2:
                want[f"?0 {a[0]} #{a[1]};?0 {b[0]} #{b[1]};"] = len(xs)
    assert {r["canon"]: r["support"] for r in rules.collect()} == want


def test_constraints(facts):
    base = {"min_head_size": 1, "min_support": 2}
    rules = mine(facts, MiningTask(**base, without_duplicate_predicates=True)).collect()
    assert rules and all(len({r["head"]["p"], *(a["p"] for a in r["body"])}) == 1 + len(r["body"]) for r in rules)
    top = mine(facts, MiningTask(**base, top_k=5)).collect()
    every = sorted((r["head_coverage"] for r in mine(facts, MiningTask(**base)).collect()), reverse=True)
    assert sorted((r["head_coverage"] for r in top), reverse=True) == every[:5]
    task = MiningTask(min_head_size=0, min_support=-3, min_head_coverage=1e-9, max_length=1)
    assert (task.min_head_size, task.min_support, task.min_head_coverage, task.max_length) == (1, 1, 0.001, 2)
    with pytest.raises(ValueError):
        MiningTask(constants="somewhere")
    assert 0 < sample_fraction(10_000, 0.1, 0.05) < 1 and sample_fraction(0, 0.1, 0.05) == 1.0


def test_patterns(facts):
    rules = mine(facts, MiningTask(min_head_size=1, min_support=2)).persist()
    n = lambda **kw: rules.where(matches(RulePattern(**kw))).count()
    assert n() == rules.count()
    assert n(head=AtomPattern(p=Item("constant", 1))) == rules.where("head.p = 1").count()
    assert n(body=(AtomPattern(p=Item("one_of", (2, 3))),), exact=True) == rules.where("size(body) = 1 and body[0].p in (2, 3)").count()
    x, y = Item("variable", "x"), Item("variable", "y")
    assert n(head=AtomPattern(s=x, o=y), body=(AtomPattern(s=x, o=y),), exact=True) == rules.where("size(body) = 1 and body[0].s.var = 0").count()
    assert n(body=(AtomPattern(s=Item("any_constant")),)) == 0


def test_recount_and_lift(facts):
    rules = mine(facts, MiningTask(min_head_size=1, min_support=2))
    again = {r["canon"]: (r["support"], r["head_size"], r["head_support"]) for r in recount_support(rules, facts).collect()}
    assert again == {r["canon"]: (r["support"], r["head_size"], r["head_support"]) for r in rules.collect()}
    modes = {r["p"]: r["mode_probability"] for r in C.mode_probabilities(facts, C.property_cardinalities(facts)).collect()}
    for r in with_lift(with_confidences(rules, facts), facts).collect():
        conf = next(c for c in (r["qpca_confidence"], r["pca_confidence"], r["cwa_confidence"]) if c is not None)
        assert r["lift"] == pytest.approx(conf / modes[r["head"]["p"]])


def rule(spark, spec):
    """Rules from (canon, head p, [body p], measure) over the same pair of variables."""
    item = lambda v: {"is_var": True, "var": v, "const": None}
    atom = lambda p: {"s": item(0), "p": p, "o": item(1)}
    from lodeweave.plans.shapes import ATOM

    rows = [(i, "".join(f"?0 {p} ?1;" for p in (h, *sorted(b))), atom(h), [atom(p) for p in b], m) for i, (h, b, m) in enumerate(spec)]
    return spark.createDataFrame(rows, f"rule_id long, canon string, head {ATOM}, body array<{ATOM}>, head_coverage double")


def test_pruning_of_a_lattice(spark):
    rules = rule(spark, [(1, [2], 0.5), (1, [3], 0.5), (1, [2, 3], 0.5), (1, [2, 4], 0.6), (1, [2, 3, 4], 0.7), (5, [2], 0.4)])
    ids = lambda df: sorted(r["rule_id"] for r in df.collect())
    assert ids(R.prune_maximal(rules)) == [4, 5]
    assert ids(R.prune_closed(rules, "headCoverage")) == [0, 1, 3, 4, 5]
    assert ids(R.prune_skyline(rules, "HeadCoverage")) == [0, 1, 3, 4, 5]


def test_similarity_and_clusters(spark):
    rules = rule(spark, [(1, [2], 0.5), (1, [2, 3], 0.5), (1, [9, 8], 0.1), (7, [2], 0.4)])
    pairs = {(r["rule_id"], r["other_id"]): r["similarity"] for r in R.similar_pairs(rules, rules).collect()}
    assert pairs[0, 1] == pytest.approx(6 / 6) and pairs[0, 2] == pytest.approx(3 / 6) and pairs[0, 3] == pytest.approx(3 / 6)
    assert [r["other_id"] for r in R.find_similar(rules, 0, 1).collect()] == [1]
    clusters = {r["rule_id"]: r["cluster"] for r in R.cluster_rules(rules, 2, 0.9).collect()}
    assert clusters[0] == clusters[1] and len(set(clusters.values())) == 3
    assert R.rule_text(rules).where("rule_id = 1").first()["text"] == "( ?a 2 ?b ) ^ ( ?a 3 ?b ) -> ( ?a 1 ?b ) | headCoverage: 0.5"


def test_prediction_and_scores(spark, facts, family):
    rules = with_confidences(mine(facts, MiningTask(min_head_size=1, min_support=2, max_length=2)), facts).persist()
    found = P.predict(rules, facts, injective=False)
    known = set(family)
    cards = {r["p"]: r["higher_side"] for r in C.property_cardinalities(facts).collect()}
    for r in found.collect():
        k = 0 if cards[r["p"]] == "subject" else 2
        t = (r["s"], r["p"], r["o"])
        seen = any(f[1] == t[1] and f[k] == t[k] for f in family)
        assert r["result"] == ("Positive" if t in known else "Negative" if seen else "PcaPositive")
    scored = P.with_confidence(found, rules).persist()
    top = {(r["s"], r["p"], r["o"]): r for r in P.group_predictions(scored).collect()}
    noisy = {(r["s"], r["p"], r["o"]): r for r in P.group_predictions(scored, "noisy_or", top_rules=1).collect()}
    for key, r in top.items():
        assert r["score"] == pytest.approx(max(r["confs"])) and r["confs"] == sorted(r["confs"], reverse=True)
        assert noisy[key]["score"] == pytest.approx(r["score"])
    assert P.distinct_predictions(scored).count() == len(top)


TASK = "p long, fixed_side string, fixed_value long, rank int, candidate long, result string, score double"


def test_ranking_and_completeness(spark):
    data = [(1, "subject", 1, r, 10 + r, "Positive" if r in (2, 3) else "Negative", 1.0 / r) for r in (1, 2, 3)]
    data += [(1, "subject", 2, 1, 20, "Positive", 0.5), (1, "subject", 3, None, None, None, None)]
    tasks = spark.createDataFrame(data, TASK)
    ranks = sorted((r["fixed_value"], r["rank"]) for r in T.filtered_ranks(tasks).collect())
    assert ranks == [(1, 2), (1, 2), (2, 1), (3, 0)]
    m = T.ranking_metrics(T.filtered_ranks(tasks), (1, 3)).first()
    assert (m["hits_1"], m["hits_3"], m["mr"], m["mrr"], m["total"], m["total_correct"]) == (0.25, 0.75, pytest.approx(5 / 3), pytest.approx(0.5), 4, 3)
    truth = spark.createDataFrame([(1, "subject", 1, 12), (1, "subject", 3, 99)], "p long, fixed_side string, fixed_value long, answer long")
    assert sorted(r["rank"] for r in T.filtered_ranks(tasks, truth).collect()) == [0, 2]
    c = T.completeness_metrics(tasks, truth).first()
    assert (c["tp"], c["fp"], c["fn"], c["precision"], c["recall"]) == (1, 3, 1, 0.25, 0.5)
    empty = T.ranking_metrics(T.filtered_ranks(tasks.limit(0))).first()
    assert (empty["mrr"], empty["total"]) == (0.0, 0)
    assert T.non_empty(tasks).count() == 4 and T.task_count(tasks).first()[0] == 3


def test_modes_come_last(spark):
    tasks = spark.createDataFrame([(1, "subject", 1, 1, 10, "Negative", 0.5), (1, "subject", 2, 1, 7, "Negative", 0.5)], TASK)
    train = spark.createDataFrame([(5, 1, 7), (6, 1, 7), (5, 1, 8)], SPO)
    out = sorted((r["fixed_value"], r["rank"], r["candidate"]) for r in T.with_modes(tasks, train).collect())
    assert out == [(1, 1, 10), (1, 2, 7), (2, 1, 7)]


def test_predicate_figures_at_any_chunk_size(spark, rows):
    rnd = random.Random(4)
    data = [(rnd.choice([*range(20), None]), rnd.choice([1] * 8 + [2, 3, None]), rnd.choice([7] * 5 + list(range(12)) + [None]), 0) for _ in range(800)]
    quads = spark.createDataFrame(data, SPO + ", n_quads int")
    want = []
    for p in (1, 2, 3):
        own = [(s, o) for s, q, o, _ in data if q == p and s is not None and o is not None]
        by = {o: len({s for s, x in own if x == o}) for _, o in own}
        best = min(by, key=lambda o: (-by[o], o))
        want.append((p, len(own), len(set(own)), len(by), best, by[best]))
    for chunk, fan in ((1_000_000, 32), (50, 2), (7, 3)):
        assert rows(predicate_figures(quads, chunk, fan)) == sorted(want, key=repr)
    assert predicate_figures(quads.limit(0)).count() == 0


def test_positions_and_limits(spark, rows):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k int, v int")
    order = [F.col("k")]
    assert rows(D.with_index(df, order), "k", "index") == sorted(((k, k) for k in range(50)), key=repr)
    assert rows(D.drop(df, 47, order), "k") == [(47,), (48,), (49,)]
    assert rows(D.slice_rows(df, 3, 5, order), "k") == [(3,), (4,)]
    assert rows(D.filter_indices(df, [1, 9], order), "k") == [(1,), (9,)]
    assert rows(D.take_while(df, F.col("k") < 4, order), "k") == [(0,), (1,), (2,), (3,)]
    tied = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    assert D.top_k(tied, 2, order).count() == 2 and D.top_k(tied, 2, order, ties=True).count() == 3


def test_split_parts_make_the_whole(spark, family):
    df = spark.createDataFrame(family, SPO)
    parts = [{tuple(r) for r in x.collect()} for x in D.split(df, (0.5, 0.3, 0.2))]
    assert sum(map(len, parts)) == len(family) and set.union(*parts) == set(family)
    assert [x.count() for x in D.split(df, (5, 3), absolute=True)] == [5, 3]


def test_discretization(spark):
    values = spark.createDataFrame([("p", float(x)) for x in [7] + [1981] * 12 + list(range(1900, 1990)) + [20010]] + [("p", None), ("p", float("nan"))], "p string, num double")
    last = Z.equidistance(values, ["p"], 5).orderBy(F.desc("bin")).first()
    assert (last["lo"], last["hi"], last["hi_open"]) == (pytest.approx(16009.4), 20010.0, False)
    for bins in (Z.equifrequency(values, ["p"], 4), Z.equisize(values, ["p"], 0.2), Z.equisize(values, ["p"], 15)):
        got = bins.orderBy("bin").collect()
        assert sum(r["n"] for r in got) == 104 and got[0]["lo"] == 7 and got[-1]["hi"] == 20010
        assert all(a["hi"] == b["lo"] for a, b in zip(got, got[1:]))
    tree = Z.equisize_tree(values, ["p"], 0.1).groupBy("level").agg(F.sum("n").alias("n"), F.count("*").alias("k")).orderBy("level").collect()
    assert all(r["n"] == 104 for r in tree) and tree[-1]["k"] == 1


def test_cardinality_ties_and_averages(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (1, 2, 1), (1, 2, 2), (1, 2, 3), (2, 2, 1), (1, 2, 4)], SPO)
    got = {r["p"]: r for r in C.property_cardinalities(df).collect()}
    assert got[1]["lower_side"] == "object" and got[1]["is_function"] and got[1]["is_inverse_function"]
    assert got[2]["lower_side"] == "subject" and got[2]["average"] == 1
