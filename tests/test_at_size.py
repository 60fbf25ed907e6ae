"""Queries do their job without work that grows with the square of a hub."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from lodeweave.operators import measures, prediction, rule_sets, ruleset, tasks, unions
from lodeweave.operators.mining import MiningTask, mine
from lodeweave.queries import predictions

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


def _unused(*args, **kw):
    raise AssertionError("not needed for this query")


@pytest.mark.parametrize("name", ["rule_texts", "rule_similarity", "dbscan_clusters"])
def test_rules_alone_need_no_confidences(spark, on_hub, monkeypatch, name):
    monkeypatch.setattr(predictions, "with_confidences", _unused)
    assert predictions.QUERIES[name](spark, "").collect()


def _constants_need_frequent_pairs(spark):
    """Each thing has 60 marks of its own and one that all share: 60 x 60 pairs of marks for each thing, if no pair is left out before the third atom."""
    rows = {(s, p, 100_000 * s + p) for s in range(60) for p in range(200, 260)} | {(s, p, p) for s in range(60) for p in (1, 2, 3)}
    return spark.createDataFrame(sorted(rows), SPO)


@pytest.fixture
def third_atoms(monkeypatch):
    """Rows that rules of three constants have before their third atom."""
    from lodeweave.operators import mining

    met, kept = [], mining.add_atom

    def counted(df, facts, shape, j, injective):
        if df is not None and shape == ((0, -1), (0, -1), (0, -1)) and j == 2:
            met.append(df.count())
        return kept(df, facts, shape, j, injective)

    monkeypatch.setattr(mining, "add_atom", counted)
    return met


def test_rare_constants_are_left_out_before_the_third_atom(spark, third_atoms):
    found = mine(_constants_need_frequent_pairs(spark), MiningTask(min_head_size=50, min_head_coverage=0.5, constants="object"))
    long = {r["canon"] for r in found.where("size(body) = 2 and head.o.const is not null").collect()}
    assert {f"?0 {a} #{a};?0 {b} #{b};?0 {c} #{c};" for a, b, c in ((1, 2, 3), (2, 1, 3), (3, 1, 2))} <= long
    assert third_atoms and max(third_atoms) <= 60 * 3 * 3


@pytest.mark.parametrize("name", ["prune_maximal", "prune_closed", "prune_skyline"])
def test_pruning_mines_without_rare_constants(spark, monkeypatch, third_atoms, name):
    rows = _constants_need_frequent_pairs(spark)
    monkeypatch.setattr(predictions, "facts", lambda spark, d: rows.unionByName(rows.selectExpr("s + 60 as s", "p", "if(p < 10, o, o + 10000000) as o")))
    got = {r["canon"] for r in predictions.QUERIES[name](spark, "").collect()}
    assert ("?0 1 #1;?0 2 #2;?0 3 #3;" in got) == (name == "prune_maximal") and ("?0 1 #1;?0 2 #2;" in got) == (name != "prune_maximal")
    assert third_atoms and max(third_atoms) <= 120 * 3 * 3


@pytest.fixture(scope="module")
def wide(spark):
    """300 things of one class and each of one more, so that no two have equal classes; NEAR leads on by 1."""
    rows = {(s, CLASS, 900) for s in range(300)} | {(s, CLASS, 1000 + s) for s in range(300)} | {(s, NEAR, (s + 1) % 300) for s in range(300)}
    return spark.createDataFrame(sorted(rows), SPO).persist()


@pytest.fixture
def written(monkeypatch):
    """The most rows of a table that measures write between steps."""
    most, write = [0], measures.cut

    def counted(df, label):
        out = write(df, label)
        most[0] = max(most[0], out.count())
        return out

    monkeypatch.setattr(measures, "cut", counted)
    return most


@pytest.mark.parametrize("name", ["predict_classes", "rules_sorted", "lift"])
def test_confidences_of_a_hub_write_no_pairs(spark, monkeypatch, wide, written, name):
    monkeypatch.setattr(predictions, "facts", lambda spark, d: wide)
    assert predictions.QUERIES[name](spark, "").where(f"canon = '?0 {NEAR} ?1;?0 {CLASS} ?2;?1 {CLASS} ?2;'").count()
    assert 0 < written[0] < 10_000  # it has 90,000 pairs, and as many of groups


def test_unions_by_sorting_and_by_bits(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(unions, "BLOCK", 500)
    z, v = np.append(rng.integers(0, 40, 6000), np.repeat(99, 3000)), np.append(rng.integers(0, 9000, 6000), np.arange(3000))
    z, v = np.unique(np.column_stack([z, v]), axis=0).T
    lists = unions.Lists(z, v)
    sets = [np.unique(rng.choice(np.append(np.arange(60), 99), rng.integers(0, 9))) for _ in range(200)]
    have, of = lists.find(np.concatenate(sets))
    rows = np.repeat(np.arange(200), [len(x) for x in sets])[have]
    want = [len(set(v[np.isin(z, x)])) for x in sets]
    assert unions.sizes_of_unions(lists, rows, of, 200).tolist() == want
    assert max(want) > 3000 and min(want) == 0


@pytest.mark.parametrize("dense", [10, 100_000_000])
def test_rule_sets_of_a_hub_are_counted_as_listed(hub, dense):
    """Bodies joined as bits (``dense`` 10: NEAR, OWNER and CLASS) and bodies whose pairs are listed in blocks give the listed predictions."""
    rules = measures.with_confidences(mine(hub, MiningTask(min_head_size=50)), hub).persist()
    listed = prediction.with_confidence(prediction.predict(rules, hub, injective=False), rules)
    for scorer in ("maximum", "noisy_or"):
        n = prediction.group_predictions(listed, scorer).groupBy("p", "result", F.round("score", 6).alias("score"), F.size("rules").alias("n_rules")).count()
        got = rule_sets.score_counts(rules, hub, scorer, dense=dense).groupBy("p", "result", F.round("score", 6).alias("score"), "n_rules").agg(F.sum("n"))
        want = sorted(map(tuple, n.collect()))
        assert sorted(map(tuple, got.collect())) == want
        assert {r[1] for r in want} >= {"Positive", "Negative"} and max(r[3] for r in want) > 3


def test_facts_are_covered_without_listing_predictions(hub, monkeypatch):
    rules = measures.with_confidences(mine(hub, MiningTask(min_head_size=50)), hub).persist()
    known = set(map(tuple, hub.select("s", "p", "o").collect()))
    place = {r["rule_id"]: i for i, r in enumerate(ruleset.sort_rules(rules).collect())}
    best = {}
    for r, *fact in measures.predicted_pairs(rules, hub).select("rule_id", "s", "p", "o").collect():
        if tuple(fact) in known:
            best[tuple(fact)] = min(best.get(tuple(fact), r), r, key=place.get)
    monkeypatch.setattr(ruleset, "predicted_pairs", _unused)
    got = {r["rule_id"] for r in ruleset.prune_data_coverage(rules, hub, injective=False).select("rule_id").collect()}
    assert got == set(best.values()) and 1 < len(got) < len(place)


def test_instances_of_hops_are_counted_as_listed(spark, hub, monkeypatch):
    loops = spark.createDataFrame([(s, NEAR, s) for s in range(0, 120, 9)] + [(s, OWNER, s) for s in range(0, 120, 6)], SPO)
    facts = hub.unionByName(loops).persist()
    rules = mine(facts, MiningTask(min_head_size=50)).persist()
    want = sorted(map(tuple, ruleset.instantiate(rules, facts).groupBy("rule_id", "result").count().collect()))
    listed, list_rows = [], ruleset.instantiate
    monkeypatch.setattr(ruleset, "instantiate", lambda r, f: listed.append(r) or list_rows(r, f))
    assert sorted(map(tuple, ruleset.instance_counts(rules, facts).select("rule_id", "result", "n").collect())) == want
    assert not any(r.where("exists(body, a -> a.s.var = 2 or a.o.var = 2)").count() for r in listed)


@pytest.mark.parametrize("side", ["subject", "object"])
def test_best_candidates_are_those_of_all_predictions(hub, side):
    rules = measures.with_confidences(mine(hub, MiningTask(min_head_size=50)), hub).persist()
    wanted = tasks.test_tasks(hub, side)
    listed = prediction.with_confidence(prediction.predict(rules, hub, injective=False), rules)
    want = tasks.prediction_tasks(prediction.group_predictions(listed, top_rules=3, non_redundant=True), side, wanted, 3)
    got = tasks.best_candidates(rules, hub, side, wanted, 3)
    flat = lambda df: sorted(map(repr, df.select(*tasks.KEY, "rank", "candidate", F.round("score", 9)).collect()))
    assert flat(got) == flat(want) and len(flat(got)) > 300
