import random

import pytest

from lodeweave.llm.components import connected_components
from lodeweave.llm.log_sketch import bucket_counts, merge_counts, percentiles
from lodeweave.llm.term_frequency import term_counts, term_frequencies
from lodeweave.llm.top_candidates import top_candidates

TASK = "p long, fixed_side string, fixed_value long, rank int, candidate long, score double, confs array<double>, extra string"
NO_ALIAS = "id long, term_id long"


def best(rows, n):
    groups = {}
    for p, side, v, _, c, score, confs, _ in rows:
        if c is None or score is None or score != score:
            continue
        side = "".join((side or "").split()).lower() if side is not None else None
        padded = [x if x is not None and x > 0 else 0.0 for x in confs or []]
        padded += [0.0] * (5 - len(padded))
        g = groups.setdefault((p, side, v), {})
        key = (-score, [-x for x in padded], c)
        if c not in g or key < g[c]:
            g[c] = key
    return sorted(((*g, r + 1, c) for g, cs in groups.items() for r, c in enumerate(sorted(cs, key=cs.get)[:n])), key=repr)


def test_top_candidates_against_brute_force(spark, rows):
    rnd = random.Random(7)
    sides = ["subject", " Subject", "OBJECT\t", "object"]
    data = [
        (rnd.choice([1, 2, None]), rnd.choice(sides), rnd.choice([5, 6, None]), None, rnd.choice([*range(8), None]), rnd.choice([0.5, 0.5, 0.25, None, float("nan"), -0.0, 0.0]),
         rnd.choice([None, [], [0.5], [0.5, 0.0], [0.5, None], [0.5, 0.1], [0.0, 0.9]]), "x")
        for _ in range(400)
    ]
    out = top_candidates(spark.createDataFrame(data, TASK), 3)
    assert rows(out, "p", "fixed_side", "fixed_value", "rank", "candidate") == best(data, 3)


def test_top_candidates_limits_groups_before_the_shuffle(spark):
    plan = top_candidates(spark.createDataFrame([], TASK))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_top_candidates_of_nothing(spark):
    assert top_candidates(spark.createDataFrame([], TASK)).count() == 0


def test_term_frequencies(spark, rows):
    data = [(1, 10, 100), (1, 10, 100), (2, 10, 100), (3, 11, 100), (4, 11, 101), (None, 10, 100), (5, 12, None), (9, 11, 102)]
    quads = spark.createDataFrame([(*d, "g") for d in data], "s long, p long, o long, place string")
    aliases = spark.createDataFrame([(9, 4), (102, 101)], NO_ALIAS)
    out = term_frequencies(quads, aliases, common_above=0.7)
    assert rows(out, "place", "term_id", "n_quads", "n_subjects", "mark") == sorted(
        [("predicate", 10, 3, 2, "rare"), ("predicate", 11, 3, 2, "rare"), ("object", 100, 4, 3, "common"), ("object", 101, 2, 1, "rare")], key=repr
    )


@pytest.mark.parametrize("heavy", [{}, {1: [1], 2: [7, 8]}, {1: [1, 2, 3], 2: list(range(20))}])
def test_heavy_terms_change_nothing(spark, rows, heavy):
    rnd = random.Random(3)
    data = [(rnd.randrange(30), rnd.choice([1, 1, 1, 2, 3]), rnd.choice([7] * 5 + list(range(20)))) for _ in range(500)]
    quads = spark.createDataFrame(data, "s long, p long, o long")
    want = {}
    for s, p, o in data:
        for key in ((0, 0), (1, p), (2, o)):
            n, subjects = want.setdefault(key, [0, set()])
            want[key][0] = n + 1
            subjects.add(s)
    assert rows(term_counts(quads, heavy), "place", "term_id", "n_quads", "n_subjects") == sorted(((*k, n, len(x)) for k, (n, x) in want.items()), key=repr)


def test_term_frequencies_of_nothing(spark):
    assert term_frequencies(spark.createDataFrame([], "s long, p long, o long"), spark.createDataFrame([], NO_ALIAS)).count() == 0


def groups_of(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return sorted(((find(x), x) for x in parent), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, rows, seed):
    rnd = random.Random(seed)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(200, x) for x in range(201, 260)] + [(7, 7), (8, 9), (9, 8), (8, 9), (None, 3), (4, None)]
    pairs += [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)]
    rnd.shuffle(pairs)
    links = spark.createDataFrame([(*p, 1) for p in pairs], "s long, o long, u long")
    assert rows(connected_components(links), "group_id", "term_id") == groups_of(pairs)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "s long, o long")).count() == 0


def test_percentiles_are_within_their_bound(spark):
    rnd = random.Random(5)
    values = [rnd.lognormvariate(0, 3) * rnd.choice([1, -1]) for _ in range(3000)] + [0.0] * 50 + [1e-300, -1e300, 5e-324]
    data = [(1, d % 7, v, 1) for d, v in enumerate(values)] + [(1, 0, None, 1), (1, 0, float("nan"), 1), (1, 0, float("inf"), 1), (2, 3, 4.0, 1)]
    counts = bucket_counts(spark.createDataFrame(data, "k int, day int, v double, bucket int"), ["k", "day"], "v", alpha=0.02)
    out = percentiles(merge_counts(counts, ["k"]), ["k"], (0.0, 0.01, 0.5, 0.99, 1.0), alpha=0.02).collect()
    ordered = sorted(values)
    for r in out:
        if r["k"] == 2:
            assert abs(r["estimate"] - 4) <= 0.08
            continue
        import math

        true = ordered[max(1, math.ceil(round(r["quantile"] * len(values), 6))) - 1]
        assert abs(r["estimate"] - true) <= 0.02 * abs(true) * 1.000001 + 1e-320
        assert r["n_values"] == len(values)
    assert len(out) == 10


def test_percentiles_of_nothing(spark):
    assert percentiles(bucket_counts(spark.createDataFrame([], "k int, v double"), ["k"], "v"), ["k"]).count() == 0


@pytest.mark.parametrize("hot", [[], [0], list(range(30))])
def test_hot_subjects_change_nothing(spark, rows, hot):
    rnd = random.Random(5)
    data = [(rnd.choice([0] * 10 + list(range(30))), rnd.choice([1, 2]), rnd.choice([7] * 5 + list(range(20)))) for _ in range(400)]
    quads = spark.createDataFrame(data, "s long, p long, o long")
    want = rows(term_counts(quads, {1: [1]}), "place", "term_id", "n_quads", "n_subjects")
    assert rows(term_counts(quads, {1: [1]}, hot), "place", "term_id", "n_quads", "n_subjects") == want


def test_term_rows_are_shuffled_once_by_subject(spark):
    quads = spark.createDataFrame([(1, 2, 3)], "s long, p long, o long")
    plan = term_counts(quads, {1: [2]})._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "hashpartitioning(place" in plan
    assert not [x for x in plan.split("\n") if "hashpartitioning(place" in x and ", s#" in x]
