"""Every task of the JSON pipelines with the parameters its documents use."""

import pytest

from lodeweave.operators.pipeline import TASKS, Pipeline, run_pipeline

X = "http://x/"


@pytest.fixture(scope="module")
def graph(tmp_path_factory):
    lines = []
    for i in range(24):
        lines += [f"<{X}s{i}> <{X}knows> <{X}s{(i * 3 + 1) % 24}> .", f"<{X}s{i}> <{X}livesIn> <{X}c{i % 3}> ."]
        if i % 2:
            lines.append(f"<{X}s{i}> <{X}likes> <{X}s{(i * 3 + 1) % 24}> .")
        lines.append(f'<{X}s{i}> <{X}age> "{20 + i % 12}"^^<http://www.w3.org/2001/XMLSchema#integer> .')
    path = tmp_path_factory.mktemp("g") / "k.nt"
    path.write_text("\n".join(lines))
    return str(path)


@pytest.fixture(scope="module")
def base(spark, graph):
    """A pipeline with its dataset, index, rules and predictions, each made once."""
    p = Pipeline(spark)
    index = p.run([{"name": "LoadGraph", "parameters": {"path": graph}}, {"name": "Index", "parameters": {"train": [], "test": []}}, {"name": "CacheIndex", "parameters": {"path": "ix", "inMemory": True, "revalidate": False}}])
    thresholds = [{"name": "MinHeadSize", "value": 1}, {"name": "MinSupport", "value": 3}, {"name": "MaxRuleLength", "value": 2}, {"name": "Timeout", "value": 5}]
    rules = p.mine(index, thresholds=thresholds, constraints=[{"name": "WithoutConstants"}], parallelism=2)
    rules = p.cache(p.compute_confidence(rules, name="StandardConfidence", min=0.1), path="rules", inMemory=True)
    found = p.cache(p.predict(rules, predictedResults=["positive", "negative", "pcaPositive"], headVariablePreMapping={"type": "noMapping"}), path="found", inMemory=True)
    return p, index, rules, found


def names(state):
    return sorted(r["canon"] for r in state.df.collect())


def test_caches_of_different_kinds_do_not_meet(spark, base, tmp_path):
    p, index, rules, found = base
    assert (p.cache(rules, inMemory=True).kind, p.cache(found, inMemory=True).kind) == ("ruleset", "prediction")
    path = str(tmp_path / "kept")
    kept = p.cache(rules, path=path).df.count()
    again = Pipeline(spark)
    assert again.cache(p._rules(rules, rules.df.limit(0)), path=path).df.count() == kept > 0  # read, not made again
    assert again.cache(p._rules(rules, rules.df.limit(1)), path=path, revalidate=True).df.count() == 1


def test_unknown_parameters_and_names_are_refused(spark, graph, base):
    p, index, rules, _ = base
    load = {"name": "LoadGraph", "parameters": {"path": graph}}
    for step in ({"name": "DatasetSize", "parameters": {"x": 1}}, {"name": "FilterQuads", "parameters": {"subjekt": "a"}}, {"name": "Nothing"}):
        with pytest.raises(ValueError):
            run_pipeline(spark, [load, step])
    for bad in ({"thresholds": [{"name": "Min", "value": 1}]}, {"constraints": [{"name": "None"}]}, {"ruleConsumers": [{"name": "tape"}]}):
        with pytest.raises(ValueError):
            p.mine(index, **bad)
    assert all(hasattr(p, method) for _, method in TASKS.values())


def test_loading(spark, graph, tmp_path):
    url = [{"name": "LoadDataset", "parameters": {"url": f"file://{graph}"}}, {"name": "DatasetSize"}]
    assert run_pipeline(spark, url) == 84
    path = tmp_path / "a.tsv"
    path.write_text("<a>\t<p>\t5\n")
    steps = [{"name": "LoadGraph", "parameters": {"path": str(path), "settings": "tsvParsedLiterals", "graphName": "<g>"}}, {"name": "GetQuads"}]
    assert [tuple(r) for r in run_pipeline(spark, steps)] == [("a", "p", "5", "g")]


def test_quads(spark, graph):
    load = {"name": "LoadGraph", "parameters": {"path": graph}}
    size = lambda *steps: run_pipeline(spark, [load, *steps, {"name": "DatasetSize"}])
    assert size({"name": "FilterQuads", "parameters": {"or": [{"predicate": f"<{X}likes>"}, {"predicate": f"<{X}age>", "object": ">= 30"}]}}) == 12 + 4
    assert [size({"name": "ShrinkQuads", "parameters": x}) for x in ({"take": 5}, {"drop": 80}, {"start": 3, "end": 9})] == [5, 4, 6]
    parts = {"train": {"uri": "<http://x/train>", "part": {"ratio": 0.5}}, "test": {"uri": "<http://x/test>", "part": {"max": 20}}}
    got = run_pipeline(spark, [load, {"name": "Split", "parameters": parts}])
    graphs = {r["g"]: r["count"] for r in got.df.groupBy("g").count().collect()}
    assert set(graphs) == {"http://x/train", "http://x/test"} and abs(graphs["http://x/train"] - 42) <= 4 and abs(graphs["http://x/test"] - 20) <= 4
    index = Pipeline(spark).index(got, train=["<http://x/train>"], test=["<http://x/test>"])
    assert index.index.facts.count() == graphs["http://x/train"] and index.index.test.count() == graphs["http://x/test"]


def test_mining_parameters(spark, base, tmp_path):
    p, index, rules, _ = base
    least = [{"name": "MinHeadSize", "value": 1}, {"name": "MinSupport", "value": 3}, {"name": "MaxRuleLength", "value": 2}]
    mined = lambda **kw: p.mine(index, thresholds=least, **kw)
    every = names(mined(constraints=[{"name": "WithoutConstants"}]))
    assert len(every) >= 2
    only = [{"name": "ConstantsForPredicates", "values": [{"predicate": f"<{X}livesIn>", "position": "Object"}]}, {"name": "WithoutConstants"}]
    some = names(mined(constraints=only))
    assert set(every) <= set(some) and all(f" {p._id(X + 'livesIn')} #" in x for x in set(some) - set(every))
    assert names(mined(constraints=[{"name": "WithoutDuplicitPredicates"}, {"name": "WithoutConstants"}])) == [x for x in every if len({a.split()[1] for a in x.split(";") if a}) == 2]
    path = str(tmp_path / "rules")
    top = mined(constraints=[{"name": "WithoutConstants"}], ruleConsumers=[{"name": "topK", "k": 1, "allowOverflow": False}, {"name": "onDisk", "file": path, "format": "ndjson"}])
    assert len(names(top)) == 1 and names(p.load_rules(index, path=path, format="ndjson")) == names(top)
    sampled = p.mine(index, thresholds=[*least, {"name": "LocalTimeout", "value": 1000, "me": 0.9, "dme": True}], constraints=[{"name": "WithoutConstants"}])
    assert "support_increase_ratio" in sampled.df.columns and sampled.df.where("support_increase_ratio < 1").count() == 0


def test_filtering_rules(base):
    p, _, rules, _ = base
    df = rules.df
    likes, knows = p._id(X + "likes"), p._id(X + "knows")
    assert p.filter_rules(rules, measures=[{"name": "Support", "value": ">= 12"}, {"name": "RuleLength", "value": "2"}]).df.count() == df.where("support >= 12").count() > 0
    assert p.filter_rules(rules, measures=[{"name": "Support", "value": "> 1000"}]).df.count() == 0
    assert p.filter_rules(rules, measures=[{"name": "HeadCoverage", "value": "[0.9;1]"}]).df.count() == df.where("head_coverage >= 0.9").count()
    assert names(p.filter_rules(rules, indices=[0])) == names(rules)[:1]
    with_likes = [c for c in names(rules) if f" {likes} " in c]
    assert names(p.filter_rules(rules, tripleMatchers=[{"predicate": f"<{X}likes>"}])) == with_likes
    assert names(p.filter_rules(rules, tripleMatchers=[{"subject": "\\?b", "predicate": "<.*>"}])) == [c for c in names(rules) if ";?1 " in c]
    assert names(p.filter_rules(rules, patterns=[{"head": {"predicate": {"name": "Constant", "value": f"<{X}knows>"}}}])) == [c for c in names(rules) if c.startswith(f"?0 {knows} ")]
    assert p.compute_support(rules, name="Support", min=12).df.count() == df.where("support >= 12").count()


def test_similar_rules_and_clusters(base):
    p, _, rules, _ = base
    rule = {"head": {"subject": "?a", "predicate": f"<{X}knows>", "object": "?b"}, "body": [{"subject": {"type": "variable", "value": "?a"}, "predicate": f"<{X}likes>", "object": "?b"}]}
    assert set(p.find_similar(rules, rule=rule, take=1, dissimilar=False).df.columns) == set(rules.df.columns)
    assert p._one_rule(rule).first()["canon"] in names(rules)
    assert p.load_rules(None, rules=[rule, rule]).df.count() == 2
    assert p.find_similar(rules, rule=rule, take=1, features=[{"name": "Atoms", "weight": 0.5}, {"name": "Confidence", "weight": 0.5}]).df.count() == 1
    assert p.make_clusters(rules, features=[{"name": "Length", "weight": 1.0}], minSimilarity=1.0).df.select("cluster").distinct().count() == rules.df.select("head.p").distinct().count()


def test_pruning_and_instances(base):
    p, _, rules, _ = base
    for par in ({"strategy": "Maximal"}, {"strategy": "Closed", "measure": "HeadCoverage"}, {"strategy": "SkylinePruning", "measure": "HeadCoverage"}, {"strategy": "WithoutQuasiBinding", "injectiveMapping": True},
                {"strategy": "DataCoveragePruning", "onlyFunctionalProperties": False, "onlyExistingTriples": False, "injectiveMapping": True}):
        assert 0 < p.prune(rules, **par).df.count() <= rules.df.count()
    assert {r["result"] for r in p.instantiate(rules, predictedResults=["positive"], injectiveMapping=True).df.collect()} == {"Positive"}


def test_predictions_and_tasks(base):
    p, index, rules, found = base
    likes = found.df.where(f"p = {p._id(X + 'likes')}").count()
    assert p.filter_prediction(found, predictedResults=["positive"]).df.count() == found.df.where("result = 'Positive'").count() > 0
    assert p.filter_prediction(found, tripleMatchers=[{"predicate": f"<{X}likes>"}]).df.count() == likes > 0
    assert p.filter_prediction(found, tripleMatchers=[{"predicate": f"<{X}likes>", "inverse": True}]).df.count() == found.df.count() - likes
    assert p.filter_prediction(found, measures=[{"name": "Support", "value": "> 1000"}]).df.count() == 0
    grouped = p.group(found, scorer={"type": "noisyOr", "confidence": "cwa", "scoreAfterAggregation": False}, consumer={"type": "nonRedundantTopK", "topK": 2, "confidence": "cwa"})
    assert p.filter_prediction(grouped, measures=[{"name": "RuleLength", "value": "2"}]).df.count() == grouped.df.count()
    assert p.group(found, scorer={"type": "maximum"}, limit=3).df.count() == 3
    pattern = {"type": "predictionPatterns", "patterns": [{"p": f"<{X}likes>", "targetVariable": "object"}]}
    tasks = p.to_tasks(grouped, generator=pattern, confidence="cwa", topK=2)
    assert {(r["p"], r["fixed_side"]) for r in tasks.df.collect()} == {(p._id(X + "likes"), "subject")} and tasks.df.agg({"rank": "max"}).first()[0] <= 2
    custom = p.to_tasks(grouped, generator={"type": "testCustom", "tasks": [{"p": f"<{X}knows>", "s": f"<{X}s1>"}]})
    assert {(r["fixed_side"], r["fixed_value"]) for r in custom.df.collect()} == {("subject", p._id(X + "s1"))}
    every = p.to_tasks(grouped, generator={"type": "testAll"})
    assert p.filter_tasks(every, tripleMatchers=[{"subject": f"<{X}s1>"}], nonEmptyPredictions=True).df.select("fixed_value").distinct().count() == 1
    assert p.filter_tasks(every, predictedResults=["positive"]).df.count() <= every.df.count()
    assert p.select(every, strategy={"type": "topK", "k": 1}, minScore=0.1, predictedResults=["positive"]).df.where("rank > 1").count() == 0
    assert {"mrr", "precision"} <= set(p.evaluate(every, ranking="test")) and p.evaluate(every, ranking="prediction")["total"] > 0


def test_discretization_tasks(spark, base):
    p, index, _, _ = base
    cut = p.auto_discretization(index, minHeadSize=1, minHeadCoverage=0.2, maxRuleLength=3, predicates=[f"<{X}age>"])
    levels = cut.index.terms.where("value like '%#discretized_level_%'").select("value").collect()
    assert levels and all(r["value"].startswith(X + "age#") for r in levels)
    rules = p.mine(cut, thresholds=[{"name": "MinHeadSize", "value": 1}, {"name": "MinSupport", "value": 2}, {"name": "MaxRuleLength", "value": 2}], constraints=[{"name": "OnlyObjectConstants"}])
    ids = {r["id"] for r in cut.index.terms.where("value like '%#discretized_level_%'").collect()}
    used = [{int(a.split()[1]) for a in c.split(";") if a} & ids for c in names(rules)]
    assert any(used) and all(len(x) < 2 for x in used)
    with_values = p.with_intervals(rules)
    assert with_values.df.where("p like '%#discretized%' and o.kind = 'interval'").count() > 0
