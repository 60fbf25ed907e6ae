"""Queries do their whole job: no predicate or rule is left out."""

from itertools import permutations

import pytest

from lodeweave.operators import ruleset as R
from lodeweave.operators.measures import predicted_pairs, with_confidences
from lodeweave.operators.mining import MiningTask, mine
from lodeweave.operators.patterns import AtomPattern, Item, RulePattern, matches
from lodeweave.queries import predictions, rules

SPO = "s long, p long, o long"
CLASS, NEAR, OWNER = 100, 7, 114


@pytest.fixture(scope="module")
def hub(spark):
    """120 things of two classes, most of them of one; NEAR leads on by 1, OWNER repeats every other link of NEAR."""
    rows = {(s, CLASS, 900 if s % 10 else 901) for s in range(120)} | {(s, CLASS, 901) for s in range(0, 120, 15)}
    rows |= {(s, NEAR, (s + 1) % 120) for s in range(120)} | {(s, OWNER, (s + 1) % 120) for s in range(0, 120, 2)} | {(s, OWNER, (s + 7) % 120) for s in range(0, 120, 3)}
    return spark.createDataFrame(sorted(rows), SPO).persist()


@pytest.fixture
def on_hub(monkeypatch, hub):
    monkeypatch.setattr(predictions, "facts", lambda spark, d: hub)
    return hub


def test_pairs_in_a_hub_are_counted_as_listed(hub):
    mined = mine(hub, MiningTask(min_head_size=50)).persist()
    cols = ["canon", "body_size", "pca_body_size", "qpca_body_size"]
    listed = with_confidences(mined, hub, pairs=predicted_pairs(mined, hub)).select(cols).collect()
    assert any(r["body_size"] > 5000 for r in listed)
    assert sorted(with_confidences(mined, hub).select(cols).collect()) == sorted(listed)


def test_predictions_take_all_predicates(spark, on_hub):
    found = {}
    for r in predictions.QUERIES["predict_classes"](spark, "").collect():
        found.setdefault(r["canon"], {})[r["result"]] = r["n"]
    same_class = {(a, b) for a, p, x in on_hub.collect() if p == CLASS for b, q, y in on_hub.collect() if q == CLASS and x == y}
    near = {(s, o) for s, p, o in on_hub.collect() if p == NEAR}
    want = {"Positive": len(near & same_class), "Negative": len(same_class - near)}
    assert found[f"?0 {NEAR} ?1;?0 {CLASS} ?2;?1 {CLASS} ?2;"] == want


def test_tasks_of_all_predicates(spark, on_hub):
    got = {r["p"] for r in predictions.QUERIES["tasks_from_predictions"](spark, "").collect()}
    assert {NEAR, OWNER} <= got


@pytest.mark.parametrize("name", ["prune_maximal", "prune_closed", "prune_skyline"])
def test_pruning_meets_sub_rules(spark, monkeypatch, name):
    rows = {(s, p, s + 1000) for p in (104, 108, 7) for s in range(100)}
    monkeypatch.setattr(predictions, "facts", lambda spark, d: spark.createDataFrame(sorted(rows), SPO))
    heads = {104: (7, 108), 108: (7, 104), 7: (104, 108)}
    short = {f"?0 {h} ?1;?0 {b} ?1;" for h, bs in heads.items() for b in bs}
    long = {f"?0 {h} ?1;" + "".join(sorted(f"?0 {b} ?1;" for b in bs)) for h, bs in heads.items()}
    got = {r["canon"] for r in predictions.QUERIES[name](spark, "").collect()}
    if name == "prune_maximal":
        assert long <= got and not short & got
    else:
        assert short <= got and not long & got


def test_confidences_of_all_predicates(spark, monkeypatch, hub):
    monkeypatch.setattr(rules, "facts", lambda spark, d: hub)
    got = {r["canon"]: r["body_size"] for r in rules.QUERIES["cwa_confidence"](spark, "").collect()}
    classes = {}
    for s, p, o in hub.collect():
        if p == CLASS:
            classes.setdefault(s, set()).add(o)
    want = sum(bool(a & b) for a in classes.values() for b in classes.values())
    assert got[f"?0 {NEAR} ?1;?0 {CLASS} ?2;?1 {CLASS} ?2;"] == want


def test_bodies_of_two_atoms_on_one_pair(spark, monkeypatch):
    rows = {(s, p, s + 1000) for p in (102, 106, 114) for s in range(150)}
    for m in (predictions, rules):
        monkeypatch.setattr(m, "facts", lambda spark, d: spark.createDataFrame(sorted(rows), SPO))
    rule = "?0 102 ?1;?0 106 ?1;?0 114 ?1;"
    got = {r["canon"]: tuple(r)[1:] for r in rules.QUERIES["cwa_confidence"](spark, "").collect()}
    assert got[rule] == (150, 150, 1.0)
    assert rule in {r["canon"] for r in predictions.QUERIES["rules_sorted"](spark, "").collect()}


def test_similarity_of_longer_bodies(spark):
    from tests.test_core import rule

    spec = [(1, [2, 3, 4], 0.5), (1, [4, 2, 3], 0.5), (1, [2, 3, 4, 5, 6], 0.5), (1, [6, 5, 4, 3, 2], 0.5), (1, [2, 9], 0.5)]
    long = rule(spark, spec)
    got = {(r["rule_id"], r["other_id"]): r["similarity"] for r in R.similar_pairs(long, long).collect()}
    for (i, (_, a, _)), (j, (_, b, _)) in permutations(enumerate(spec), 2):
        n = min(len(a), len(b))
        assert got[i, j] == pytest.approx((3 * len(set(a) & set(b)) + 3) / (3 * (n + 1))), (i, j)
    clusters = {r["rule_id"]: r["cluster"] for r in R.cluster_rules(long, 2, 0.95).collect()}
    assert clusters[0] == clusters[1] == clusters[2] == clusters[3] != clusters[4]


def test_patterns_of_longer_bodies(spark):
    from tests.test_core import rule

    long = rule(spark, [(1, [2, 3, 4, 5, 6], 0.5), (1, [6, 5, 4, 3, 2, 7], 0.5), (8, [2, 3], 0.5)])
    p = lambda x: AtomPattern(p=Item("constant", x))
    ids = lambda **kw: [r["rule_id"] for r in long.where(matches(RulePattern(**kw))).orderBy("rule_id").collect()]
    assert ids() == [0, 1, 2]
    assert ids(head=p(1)) == [0, 1]
    assert ids(body=(p(6), p(2))) == [0, 1]
    assert ids(body=(p(2), p(2))) == []
    assert ids(body=(p(5), p(6)), orderless=False) == [0]
    assert ids(body=(p(6), p(5), p(4), p(3), p(2)), exact=True) == [0]


def shuffled_rows(spark, f):
    """The result of ``f`` and how many rows its stages shuffled."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        jvm = spark.sparkContext._jvm
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    out = f()
    return out, sum(n for k, n in written().items() if k not in before)


def test_distinct_predictions_of_a_hub_are_not_shuffled(spark, monkeypatch):
    n, heads = 150, (NEAR, OWNER, 21, 22, 23, 24)
    links = {(s, p, (s + k) % n) for k, p in enumerate(heads, 1) for s in range(n)}
    f = spark.createDataFrame(sorted(links | {(s, CLASS, 900) for s in range(n)}), SPO).persist()
    measured = with_confidences(mine(f, MiningTask(min_head_coverage=0.01)), f).persist()
    assert {f"?0 {p} ?1;?0 {CLASS} ?2;?1 {CLASS} ?2;" for p in heads} <= {r["canon"] for r in measured.collect()}
    monkeypatch.setattr(predictions, "_base", lambda spark, d: (f, measured))
    got, shuffled = shuffled_rows(spark, lambda: predictions.QUERIES["predict_distinct"](spark, "").collect())
    of_links = sorted(tuple(r) for r in got if r["p"] in heads)
    assert of_links == sorted(x for p in heads for x in ((p, "Positive", n), (p, "Negative", n * n - n)))
    assert shuffled < len(heads) * n * n


@pytest.mark.parametrize("bits, constants", [(2, ""), (63, ""), (63, "object")])
def test_best_rules_as_chosen_from_all_predictions(hub, rows, monkeypatch, bits, constants):
    from lodeweave.operators import prediction as P

    monkeypatch.setattr(P, "_BITS", bits, raising=False)
    task = MiningTask(min_head_size=50, **({"constants": constants, "min_head_coverage": 0.03, "max_length": 2} if constants else {}))
    measured = with_confidences(mine(hub, task), hub).persist()
    cols = ["rule_id", "s", "p", "o", "result", "conf", "head_coverage", "cluster"]
    listed = P.distinct_predictions(P.with_confidence(P.predict(measured, hub, injective=False), measured))
    want = rows(listed, *cols)
    assert len({r[0] for r in want}) > 1 and {r[4] for r in want} >= ({"Positive", "Negative"} if constants else {"Positive", "Negative", "PcaPositive"})
    assert ("#" in {r["canon"].split(";")[0].split(" ")[2][0] for r in measured.collect()}) == bool(constants)
    assert rows(P.best_predictions(measured, hub), *cols) == want
    none = P.best_predictions(measured.where("false"), hub)
    assert none.columns == cols and none.isEmpty()
