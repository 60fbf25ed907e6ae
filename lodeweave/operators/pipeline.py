"""Pipelines of named tasks: a list of {"name", "parameters"} run on datasets, indexes, rule sets and predictions."""

from __future__ import annotations

import inspect
import urllib.request
import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.matching import QuadMatcher, filter_quads, map_quads, number_matcher, printed
from lodeweave.operators import cardinalities, dataset, discretize, prediction, ruleset, tasks
from lodeweave.operators.index import Index, build_index, printed_terms, term_id, to_dataset
from lodeweave.operators.index import _resource as resource_struct
from lodeweave.operators.measures import recount_support, with_confidences, with_lift
from lodeweave.operators.mining import MiningTask, mine, without_quasi_binding
from lodeweave.operators.patterns import AtomPattern, Item, RulePattern
from lodeweave.plans.lineage import cut, shared_dir
from lodeweave.plans.shapes import ATOM
from lodeweave.sources import rdf, results

GET_LIMIT = 10_000


@dataclass
class State:
    """What a pipeline carries: the current object's kind and table, and what it came from."""

    kind: str
    df: DataFrame | None
    index: Index | None = None
    rules: DataFrame | None = None
    prefixes: DataFrame | None = None


def _quad_order():
    return [F.col("s"), F.col("p"), printed(F.col("o")), F.col("g")]


def _order(kind: str):
    return {"dataset": _quad_order(), "ruleset": [F.col("canon")], "prediction": [F.col("s"), F.col("p"), F.col("o")], "tasks": [F.col(c) for c in (*tasks.KEY, "rank", "candidate")]}[kind]


class Pipeline:
    """Runs tasks one after another. Every method is a task of the name in TASKS for the kinds listed there."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.cached: dict[str, State] = {}

    def run(self, steps: list[dict]) -> object:
        """The last task's result: a State, or rows for tasks that give some."""
        state: object = None
        loaded: list[State] = []
        for step in steps:
            name, par = step["name"], step.get("parameters") or {}
            if name in ("LoadGraph", "LoadDataset") and isinstance(state, State):
                loaded.append(state)
            if name == "MergeDatasets":
                state = self.merge([*loaded, state])
                loaded = []
                continue
            kinds, method = TASKS[name] if name in TASKS else (None, None)
            if method is None:
                raise ValueError(f"unknown task {name}")
            have = state.kind if isinstance(state, State) else None
            if kinds and have not in kinds:
                raise ValueError(f"{name} follows {' or '.join(kinds)}, not {have}")
            call = getattr(self, method)
            try:
                inspect.signature(call).bind(state, **par)
            except TypeError as e:
                raise ValueError(f"{name}: {e}") from None
            state = call(state, **par)
        return state

    # Datasets
    def _fetched(self, path: str | None, url: str | None) -> str:
        """The path, or that of a copy of what the URL names, in the shared folder."""
        if path or not url:
            return path
        to = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}-{url.split('?')[0].rstrip('/').rsplit('/', 1)[-1]}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(to)
        out = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(where)
        try:
            with urllib.request.urlopen(url) as f:
                while part := f.read(1 << 20):
                    out.write(bytearray(part))
        finally:
            out.close()
        return to

    def load(self, state, path: str | None = None, url: str | None = None, graphName: str | None = None, settings: str | None = None, tsvParsingMode: str = "raw"):
        mode = {"tsvRaw": "raw", "tsvParsedUris": "parsed_uris", "tsvParsedLiterals": "parsed_literals"}.get(settings, tsvParsingMode)
        graph = graphName[1:-1] if graphName and graphName.startswith("<") else graphName
        return State("dataset", rdf.read_quads(self.spark, self._fetched(path, url), graph=graph, tsv_mode=mode))

    def merge(self, states):
        return State("dataset", reduce(DataFrame.unionByName, [s.df for s in states]))

    def add_prefixes(self, state, path: str | None = None, url: str | None = None, prefixes: list[dict] = ()):
        new = rdf.read_prefixes(self.spark, self._fetched(path, url)) if path or url else self.spark.createDataFrame([(p["prefix"], p["nameSpace"]) for p in prefixes], "prefix string, ns string")
        return State("dataset", state.df, prefixes=new if state.prefixes is None else state.prefixes.unionByName(new))

    def prefixes(self, state):
        used = dataset.used_namespaces(state.df)
        return used.collect() if state.prefixes is None else used.join(state.prefixes, "ns", "left").limit(GET_LIMIT).collect()

    @staticmethod
    def _matcher(par: dict) -> QuadMatcher:
        if unknown := set(par) - {"subject", "predicate", "object", "graph", "inverse"}:
            raise ValueError(f"unknown parts of a matcher: {sorted(unknown)}")
        return QuadMatcher(par.get("subject"), par.get("predicate"), par.get("object"), par.get("graph"), bool(par.get("inverse", False)))

    def filter_quads(self, state, **par):
        alternatives = par["or"] if set(par) == {"or"} else [par]
        return State("dataset", filter_quads(state.df, [self._matcher(m) for m in alternatives]), prefixes=state.prefixes)

    def map_quads(self, state, search: dict, replacement: dict):
        return State("dataset", map_quads(state.df, self._matcher(search), **{k: replacement.get(k) for k in ("subject", "predicate", "object", "graph")}), prefixes=state.prefixes)

    def shrink(self, state, strategy: str = "", max: int = 0, take: int | None = None, drop: int | None = None, start: int = 0, end: int = 0):  # noqa: A002
        order = _order(state.kind)
        if not strategy:
            strategy, max = ("Take", take) if take is not None else ("Drop", drop) if drop is not None else ("Slice", 0)
        df = state.df.orderBy(*order).limit(max) if strategy == "Take" else dataset.drop(state.df, max, order) if strategy == "Drop" else dataset.slice_rows(state.df, start, end, order)
        return State(state.kind, df, state.index, state.rules, state.prefixes)

    def histogram(self, state, subject: bool = False, predicate: bool = False, object: bool = False):  # noqa: A002
        places = [c for c, on in (("s", subject), ("p", predicate), ("o", object)) if on]
        return dataset.histogram(state.df, *places).orderBy(F.desc("n"), *places).limit(GET_LIMIT).collect()

    def properties(self, state):
        return dataset.properties(state.df).orderBy("p").limit(GET_LIMIT).collect()

    def size(self, state):
        return tasks.task_count(state.df).first()[0] if state.kind == "tasks" else state.df.count()

    def get(self, state):
        if state.kind == "dataset":
            return state.df.select("s", "p", printed(F.col("o")).alias("o"), "g").limit(GET_LIMIT).collect()
        df = prediction.within_rules(state.df, GET_LIMIT) if state.kind == "prediction" and "rules" in state.df.columns else state.df.limit(GET_LIMIT)
        return df.collect()

    def split(self, state, train=0.8, test=0.2):
        rows = cut(state.df.withColumn("_o", printed(F.col("o"))), "to-split")
        total = rows.select("s", "p", "_o", "g").distinct().count()
        share = lambda x: x if not isinstance(x, dict) else x["part"]["ratio"] if "ratio" in x["part"] else min(1.0, x["part"]["max"] / max(1, total))
        name = lambda x, default: x["uri"].strip("<>") if isinstance(x, dict) else default
        parts = dataset.split(rows.select("s", "p", "_o", "g").distinct(), (share(train), share(test)))
        out = [rows.join(x, ["s", "p", "_o", "g"], "left_semi").drop("_o").withColumn("g", F.lit(n)) for x, n in zip(parts, (name(train, "train"), name(test, "test")))]
        return State("dataset", dataset.concat(*out), prefixes=state.prefixes)

    def _intervals(self, values: DataFrame, task: dict) -> DataFrame:
        kind = task["name"].replace("DiscretizationTask", "")
        if kind.startswith("Equidistance"):
            return discretize.equidistance(values, ["p"], task["bins"])
        if kind.startswith("Equifrequency"):
            return discretize.equifrequency(values, ["p"], task["bins"])
        return discretize.equisize(values, ["p"], task["support"])

    def discretize(self, state, task: dict, **par):
        hit = filter_quads(state.df, [self._matcher(par)])
        rest = filter_quads(state.df, [QuadMatcher(par.get("subject"), par.get("predicate"), par.get("object"), par.get("graph"), not par.get("inverse", False))])
        one = hit.withColumn("_p", F.col("p")).withColumn("p", F.lit("all"))
        values = one.where("o.kind = 'number'").select("p", F.col("o.num").alias("num"))
        done = discretize.replace_by_intervals(one, self._intervals(values, task)).withColumn("p", F.col("_p")).drop("_p")
        return State("dataset", dataset.concat(rest, done.select(*rest.columns)), prefixes=state.prefixes)

    def discretize_in_bulk(self, state, task: dict, predicates: list[str] = ()):
        values = state.df.where("o.kind = 'number'").select("p", F.col("o.num").alias("num"))
        if predicates:
            values = values.where(F.col("p").isin([p.strip("<>") for p in predicates]))
        return State("dataset", discretize.replace_by_intervals(state.df, self._intervals(values, task)), prefixes=state.prefixes)

    def index(self, state, train: list[str] = (), test: list[str] = ()):
        train, test = ([g.strip("<>") for g in x] for x in (train, test))
        df = state.df.where(F.coalesce("g", F.lit("")).isin([*train, *test])) if train else state.df
        return State("index", None, build_index(df, test or None), prefixes=state.prefixes)

    def export_quads(self, state, path: str):
        kind, packed = rdf.format_of(path)
        rdf.write_quads(state.df, path, kind, packed)
        return state

    def cache(self, state, path: str | None = None, inMemory: bool = False, revalidate: bool = False):
        """In memory (here: the shared folder) under the kind and id, or at ``path``, from which later runs read unless ``revalidate``."""
        key = (state.kind, path or "")
        if key in self.cached and not revalidate:
            return self.cached[key]
        index, df, kept = state.index, state.df, path and not inMemory
        if state.kind == "index":
            if kept and (revalidate or not results.exists(self.spark, f"{path}/facts")):
                results.write_index(index.fact_graphs, index.terms, path, index.test)
            index = self._read_index(path) if kept else index
        elif kept:
            if revalidate or not results.exists(self.spark, path):
                df.write.mode("overwrite").parquet(path)
            df = self.spark.read.parquet(path)
        else:
            df = cut(df, "cache")
        self.cached[key] = State(state.kind, df, index, state.rules, state.prefixes)
        return self.cached[key]

    def _read_index(self, path: str) -> Index:
        graphs = results.read_index(self.spark, path, "facts")
        test = results.read_index(self.spark, path, "test") if results.exists(self.spark, f"{path}/test") else None
        return Index(results.read_index(self.spark, path, "terms"), graphs.select("s", "p", "o").distinct(), graphs, test)

    # Index
    def _id(self, name: str) -> int:
        bare = name[1:-1] if name.startswith("<") else name
        return self.spark.range(1).select(term_id(resource_struct(F.lit(bare))).alias("x")).first()["x"]

    def _item(self, x) -> Item:
        if x is None or x.get("name") in (None, "Any"):
            return Item()
        name, value = x["name"], x.get("value")
        kinds = {"AnyVariable": "any_variable", "AnyConstant": "any_constant", "Variable": "variable", "Constant": "constant", "OneOf": "one_of", "NoneOf": "none_of"}
        ids = value if name == "Variable" else tuple(self._id(v) for v in value) if isinstance(value, list) else self._id(value) if value else None
        return Item(kinds[name], ids)

    def _pattern(self, x: dict) -> RulePattern:
        atom = lambda a: AtomPattern(*[self._item(a.get(c)) for c in ("subject", "predicate", "object", "graph")])
        return RulePattern(tuple(atom(a) for a in x.get("body", ())), atom(x["head"]) if x.get("head") else None, bool(x.get("exact", False)), bool(x.get("orderless", True)))

    def mine(self, state, thresholds: list[dict] = (), constraints: list[dict] = (), patterns: list[dict] = (), ruleConsumers: list[dict] = (), parallelism: int = 0, topK: int = 0, allowOverflow: bool = False):
        """``parallelism`` is the cluster's affair. A LocalTimeout with a margin of error samples head triples for it; its time isn't used."""
        names = {"MinHeadSize": "min_head_size", "MinSupport": "min_support", "MinHeadCoverage": "min_head_coverage", "MinAtomSize": "min_atom_size", "MaxRuleLength": "max_length", "Timeout": "timeout_minutes", "TopK": "top_k"}
        par: dict = {"injective": True, "patterns": tuple(self._pattern(p) for p in patterns), "constants": "anywhere", "top_k": topK, "allow_top_k_overflow": allowOverflow}
        for t in thresholds:
            if t["name"] == "LocalTimeout":
                par |= {"margin": t["me"], "dynamic_margin": bool(t.get("dme", False))}
            elif t["name"] in names:
                par[names[t["name"]]] = t["value"]
            else:
                raise ValueError(f"unknown threshold {t['name']}")
        places = {"WithoutConstants": "nowhere", "OnlyObjectConstants": "object", "OnlySubjectConstants": "subject", "OnlyLowerCardinalitySideConstants": "lower", "OnlyLowerCardinalitySideAtHeadConstants": "lower_head"}
        positions = {"Subject": "subject", "Object": "object", "LowerCardinalitySide": "lower", "Both": "anywhere"}
        for c in constraints:
            name, values = c["name"], c.get("values", ())
            if name in places:
                par["constants"] = places[name]
            elif name in ("WithoutDuplicitPredicates", "WithoutDuplicatePredicates"):
                par["without_duplicate_predicates"] = True
            elif name in ("OnlyPredicates", "WithoutPredicates"):
                par["only_predicates" if name[0] == "O" else "without_predicates"] = tuple(self._id(v) for v in values)
            elif name == "ConstantsForPredicates":
                par["constants_for"] = {self._id(v["predicate"]): positions[v["position"]] for v in values}
            elif name != "InjectiveMapping":
                raise ValueError(f"unknown constraint {name}")
        for c in ruleConsumers:
            if c["name"] == "topK":
                par |= {"top_k": c["k"], "allow_top_k_overflow": bool(c.get("allowOverflow", False))}
            elif c["name"] not in ("inMemory", "onDisk"):
                raise ValueError(f"unknown rule consumer {c['name']}")
        leveled = state.index.terms.where(F.col("value").contains("#discretized_level_")).select("id", F.substring_index("value", "#discretized_level_", 1).alias("value"))
        family = leveled.unionByName(leveled.join(state.index.terms.where("kind = 'uri'").select(F.col("id").alias("parent"), "value"), "value").select(F.col("parent").alias("id"), "value").distinct())
        par["families"] = tuple(tuple(sorted(r["ids"])) for r in family.groupBy("value").agg(F.collect_set("id").alias("ids")).collect())  # levels of predicates, which are few
        rules = mine(state.index.facts, MiningTask(**par))
        for c in ruleConsumers:
            if c["name"] == "onDisk":
                rules = cut(rules, "mined")
                results.write_rules(rules, c["file"], c["format"], printed_terms(state.index))
        return State("ruleset", rules, state.index)

    def auto_discretization(self, state, minSupportLowerBoundOn: bool = True, minSupportUpperBoundOn: bool = True, minHeadSize: int = 100, minHeadCoverage: float = 0.01, maxRuleLength: int = 3, predicates: list[str] = ()):
        quads = to_dataset(state.index)
        task = discretize.AutoTask(min_head_size=minHeadSize, min_head_coverage=minHeadCoverage, max_length=maxRuleLength, lower_bound=minSupportLowerBoundOn, upper_bound=minSupportUpperBoundOn, predicates=tuple(p.strip("<>") for p in predicates))
        return State("index", None, build_index(dataset.concat(quads, discretize.auto_discretize(quads, task))))

    def index_to_dataset(self, state):
        return State("dataset", to_dataset(state.index))

    def properties_cardinalities(self, state, filter: list[str] = ()):  # noqa: A002
        cards = cardinalities.property_cardinalities(state.index.facts)
        names = printed_terms(state.index).select(F.col("id").alias("p"), "name")
        out = cards.join(names, "p")
        return (out.where(F.col("name").isin(list(filter))) if filter else out).orderBy("name").collect()

    def export_index(self, state, path: str):
        results.write_index(state.index.fact_graphs, state.index.terms, path, state.index.test)
        return state

    def load_index(self, state, path: str, partially: bool = False):
        """Tables are read when something asks for them, so that ``partially`` changes nothing."""
        return State("index", None, self._read_index(path))

    def load_rules(self, state, path: str | None = None, format: str = "ndjson", rules: list[dict] = (), parallelism: int = 0):  # noqa: A002
        df = reduce(DataFrame.unionByName, [self._one_rule(r) for r in rules]) if rules else results.read_rules(self.spark, path, format.lower())
        return State("ruleset", df, state.index if state else None)

    def load_prediction(self, state, path: str, format: str = "cache"):  # noqa: A002
        schema = "s long, p long, o long, result string, score double, rules array<long>, confs array<double>"
        return State("prediction", results.read_predictions(self.spark, path, schema, format.lower()), state.index if state else None)

    # Rule sets
    def _rules(self, state, df):
        return State("ruleset", df, state.index)

    def compute_confidence(self, state, name: str = "PcaConfidence", min: float = 0.1, topk: int = 0):  # noqa: A002
        c = ruleset.column_of({"StandardConfidence": "CwaConfidence"}.get(name, name))
        out = cut(with_confidences(state.df, state.index.facts, True), "confident")
        out = out.where(F.col(c) >= max(min, 0.001)) if name != "Lift" else with_lift(out, state.index.facts)
        return self._rules(state, out.orderBy(F.desc(c), F.desc("head_coverage"), "canon").limit(topk) if topk else out)

    def compute_support(self, state, name: str | None = None, min: float = 0, minSupport: int = 1, minHeadCoverage: float = 0.0):  # noqa: A002
        if name not in (None, "Support", "HeadCoverage"):
            raise ValueError(f"unknown support {name}")
        least = {"Support": (min, 0.0), "HeadCoverage": (1, min), None: (minSupport, minHeadCoverage)}[name]
        return self._rules(state, recount_support(state.df, state.index.facts, *least, True))

    def export_rules(self, state, path: str, format: str = "ndjson"):  # noqa: A002
        results.write_rules(state.df, path, format.lower(), printed_terms(state.index) if state.index else None)
        return state

    @staticmethod
    def _measured(rules: DataFrame, measures: list[dict]) -> DataFrame:
        """Rules of which each named measure fulfils its condition: a number, a comparison or a range; a missing measure fulfils none."""
        for m in measures:
            if "value" in m:
                c = F.size("body") + 1 if m["name"].lower() == "rulelength" else F.col(ruleset.column_of(m["name"]))
                rules = rules.where(number_matcher(m["value"], c.cast("double")))
            else:
                rules = ruleset.filter_rules(rules, {m["name"]: (m.get("min", float("-inf")), m.get("max", float("inf")))})
        return rules

    def _named(self, df: DataFrame, index: Index) -> DataFrame:
        """(``row``, ``s``, ``p``, ``o``, ``g``): rows with ids ``s``, ``p``, ``o`` and the terms they stand for."""
        out = df.select(F.struct(*df.columns).alias("row"), F.col("s").alias("_s"), F.col("p").alias("_p"), F.col("o").alias("_o"))
        t = index.terms
        for c in "sp":
            out = out.join(t.select(F.col("id").alias(f"_{c}"), F.col("value").alias(c)), f"_{c}", "left")
        out = out.join(t.select(F.col("id").alias("_o"), F.struct(*[c for c in t.columns if c != "id"]).alias("o")), "_o", "left")
        return out.select("row", "s", "p", "o", F.lit("").alias("g"))

    def _with_atoms(self, state, df: DataFrame, matchers: list[dict]) -> DataFrame:
        """Rules that have, for each matcher, an atom it accepts by names; a variable has the name ?a, ?b, ..."""
        flat = df.select("rule_id", F.explode(F.concat(F.array("head"), "body")).alias("a"))
        item = lambda c: F.when(F.col(f"a.{c}.is_var"), F.concat(F.lit("?"), F.expr(f"char(97 + a.{c}.var)")))
        flat = flat.select("rule_id", item("s").alias("vs"), item("o").alias("vo"), F.col("a.s.const").alias("s"), F.col("a.p").alias("p"), F.col("a.o.const").alias("o"))
        named = self._named(flat, state.index).select("row.rule_id", F.coalesce("row.vs", "s").alias("s"), "p", F.when(F.col("row.vo").isNotNull(), resource_struct(F.col("row.vo"))).otherwise(F.col("o")).alias("o"), "g")
        for m in matchers:
            df = df.join(filter_quads(named, [self._matcher(m)]).select("rule_id").distinct(), "rule_id", "left_semi")
        return df

    def filter_rules(self, state, measures: list[dict] = (), patterns: list[dict] = (), tripleMatchers: list[dict] = (), indices: list[int] = ()):
        df = dataset.filter_indices(state.df, list(indices), _order("ruleset")) if indices else state.df
        df = ruleset.filter_rules(self._measured(df, measures), {}, [self._pattern(p) for p in patterns])
        return self._rules(state, self._with_atoms(state, df, tripleMatchers) if tripleMatchers else df)

    def _one_rule(self, x: dict) -> DataFrame:
        """A rule given by names: {"head": atom, "body": [atom, ...]}; an item is "?a", a name, or {"type": variable or constant, "value": ...}."""
        names: dict[str, int] = {}

        def item(v):
            v = v["value"] if isinstance(v, dict) and v.get("type") in ("variable", "constant") else v
            return (True, names.setdefault(v, len(names)), None) if isinstance(v, str) and v.startswith("?") else (False, None, self._id(v))

        head, *body = [(item(a["subject"]), self._id(a["predicate"]), item(a["object"])) for a in (x["head"], *x["body"])]
        texts = []
        for order in permutations(body):
            seen: dict[int, int] = {}
            part = lambda i: f"?{seen.setdefault(i[1], len(seen))}" if i[0] else f"#{i[2]}"  # noqa: E731, B023
            texts.append("".join(f"{part(s)} {p} {part(o)};" for s, p, o in (head, *order)))
        rows = self.spark.createDataFrame([(min(texts), head, body)], f"canon string, head {ATOM}, body array<{ATOM}>")
        return rows.select(F.xxhash64("canon").alias("rule_id"), "canon", "head", "body")

    @staticmethod
    def _similarity(features: list[dict], *tables: DataFrame):
        if not features:
            return None
        names = {"Support": "support", "Confidence": "confidence", "PcaConfidence": "pca", "QpcaConfidence": "qpca", "Lift": "lift", "Length": "length"}
        of = lambda n: ruleset.atoms_similarity(ruleset.longest_body(*tables)) if n == "Atoms" else ruleset.measure_similarity(names[n])
        return ruleset.combined_similarity([(f["weight"], of(f["name"])) for f in features])

    def find_similar(self, state, rule, take: int = 10, dissimilar: bool = False, features: list[dict] = ()):
        one = state.df.where(F.col("rule_id") == rule) if isinstance(rule, int) else self._one_rule(rule)
        if not isinstance(rule, int) and features:
            one = one.select("rule_id").join(state.df, "rule_id")  # measures are those of the table's rule
        near = ruleset.find_similar(state.df, one, take, dissimilar, similarity=self._similarity(features, state.df, one))
        return self._rules(state, state.df.join(near.select(F.col("other_id").alias("rule_id")), "rule_id", "left_semi"))

    def graph_aware(self, state):
        return self._rules(state, ruleset.graph_aware(state.df, state.index.fact_graphs))

    def make_clusters(self, state, minNeighbours: int = 2, minSimilarity: float = 0.85, features: list[dict] = ()):
        return self._rules(state, ruleset.cluster_rules(state.df, minNeighbours, minSimilarity, similarity=self._similarity(features, state.df)))

    def sort_rules(self, state, by: list[dict] = ()):
        return self._rules(state, ruleset.sort_rules(state.df, [(x["measure"], bool(x.get("reversed", False))) for x in by]))

    @staticmethod
    def _results(names: list[str]) -> tuple[str, ...]:
        known = {x.lower(): x for x in (prediction.POSITIVE, prediction.NEGATIVE, prediction.PCA_POSITIVE)}
        return tuple(known[n.lower()] for n in names)

    def predict(self, state, testPath: str | None = None, mergeTestAndTrainForPrediction: bool = True, onlyTestCoveredPredictions: bool = True, predictedResults: list[str] = (), injectiveMapping: bool = True, headVariablePreMapping: dict | None = None):
        ix = state.index
        test = ix.test
        if testPath:
            added = build_index(rdf.read_quads(self.spark, testPath))
            test = cut(cardinalities.test_minus_train(added.facts, ix.facts), "test")
            ix = Index(ix.terms.unionByName(added.terms).dropDuplicates(["id"]), ix.facts, ix.fact_graphs, test)
        way = headVariablePreMapping or {"type": "noMapping"}
        side = {"noMapping": None, "fromTestSetAtHigherCardinalitySite": "higher", "fromTestSetAtCustomPosition": str(way.get("target", "")).lower()}[way["type"]]
        covered = onlyTestCoveredPredictions and test is not None
        found = prediction.predict(state.df, ix.facts, test, mergeTestAndTrainForPrediction, covered, self._results(predictedResults), injectiveMapping, side)
        return State("prediction", cut(found, "predicted"), ix, state.df)

    def with_intervals(self, state):
        """Quads of the index with, for each interval constant of a rule, the numbers of its predicate's parent in that interval."""
        atoms = state.df.select(F.explode(F.concat(F.array("head"), "body")).alias("a")).where("not a.o.is_var").select("a.p", F.col("a.o.const").alias("id")).distinct()
        terms = state.index.terms
        used = atoms.join(terms.where("kind = 'interval'"), "id").join(terms.select(F.col("id").alias("p"), F.col("value").alias("name")), "p")
        base = F.substring_index("name", "#discretized_level_", 1)
        bins = used.select(base.alias("p"), F.col("name"), F.xxhash64("id").alias("bin"), "lo", "hi", "lo_open", "hi_open").distinct()
        bins = cut(bins, "bins")
        quads = to_dataset(state.index)
        own = quads.where("o.kind = 'number'").join(bins.select("p", "name").distinct(), "p").withColumn("p", F.col("name")).select(*quads.columns)
        new = discretize.replace_by_intervals(own, bins.drop("p").withColumnRenamed("name", "p")).where("o.kind = 'interval'")
        return State("dataset", quads.unionByName(new))

    def prune(self, state, strategy: str = "DataCoveragePruning", measure: str = "HeadCoverage", onlyFunctionalProperties: bool = False, onlyExistingTriples: bool = True, injectiveMapping: bool = True):
        out = {
            "DataCoveragePruning": lambda: ruleset.prune_data_coverage(state.df, state.index.facts, injectiveMapping, onlyFunctionalProperties, onlyExistingTriples),
            "Maximal": lambda: ruleset.prune_maximal(state.df),
            "Closed": lambda: ruleset.prune_closed(state.df, measure),
            "SkylinePruning": lambda: ruleset.prune_skyline(state.df, measure),
            "WithoutQuasiBinding": lambda: without_quasi_binding(state.df, state.index.facts, injectiveMapping),
        }[strategy]()
        return self._rules(state, out)

    def instantiate(self, state, predictedResults: list[str] = (), injectiveMapping: bool = True):
        out = ruleset.instantiate(state.df, state.index.facts, injectiveMapping)
        return State("instances", out.where(F.col("result").isin(list(self._results(predictedResults)))) if predictedResults else out, state.index, state.df)

    # Predictions
    def _predicted(self, state, df):
        return State("prediction", df, state.index, state.rules)

    @staticmethod
    def _by_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
        """Predictions of which at least one rule is among ``rules``."""
        if "rule_id" in df.columns:
            return df.join(rules.select("rule_id"), "rule_id", "left_semi")
        hit = df.select("s", "p", "o", F.explode("rules").alias("rule_id")).join(rules.select("rule_id"), "rule_id", "left_semi")
        return df.join(hit.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_semi")

    def filter_prediction(
        self, state, predictedResults: list[str] = (), tripleMatchers: list[dict] = (), measures: list[dict] = (), patterns: list[dict] = (), distinctPredictions: bool = False, withoutTrainTriples: bool = False,
        onlyCoveredTestPredictionTasks: bool = False, indices: list[int] = (),
    ):
        df = dataset.filter_indices(state.df, list(indices), _order("prediction")) if indices else state.df
        if predictedResults:
            df = df.where(F.col("result").isin(list(self._results(predictedResults))))
        if tripleMatchers:
            df = filter_quads(self._named(df, state.index), [self._matcher(m) for m in tripleMatchers]).select("row.*")
        for m in measures:
            df = self._by_rules(df, self._measured(state.rules, [m]))
        if patterns:
            df = self._by_rules(df, ruleset.filter_rules(state.rules, {}, [self._pattern(p) for p in patterns]))
        if withoutTrainTriples:
            df = prediction.without_train(df, state.index.facts)
        if onlyCoveredTestPredictionTasks:
            known = state.index.evaluated()
            parts = [df.join(known.select("p", c).distinct(), ["p", c], "left_semi") for c in ("s", "o")]
            df = parts[0].unionByName(parts[1]).distinct()
        if distinctPredictions and "rule_id" in df.columns:
            df = prediction.distinct_predictions(prediction.with_confidence(df, state.rules)).select(*df.columns)
        return self._predicted(state, df)

    def group(self, state, scorer=None, consumer: dict | None = None, limit: int = -1, topRules: int = 0, nonRedundant: bool = False):
        """``scorer`` {"type", "confidence", "scoreAfterAggregation"} or its type; ``consumer`` {"type": topK or nonRedundantTopK, "topK", "confidence"}."""
        score = scorer if isinstance(scorer, dict) else {"type": scorer or "maximum"}
        keep = consumer or {"type": "nonRedundantTopK" if nonRedundant else "topK", "topK": topRules}
        kind = {"maximum": "maximum", "noisyOr": "noisy_or", "noisy_or": "noisy_or"}[score["type"]]
        if keep["type"] not in ("topK", "nonRedundantTopK"):
            raise ValueError(f"unknown consumer {keep['type']}")
        rows = prediction.with_confidence(state.df, state.rules, score.get("confidence") or keep.get("confidence"))
        out = prediction.group_predictions(rows, kind, max(0, keep["topK"]), keep["type"] == "nonRedundantTopK", not score.get("scoreAfterAggregation", True))
        return self._predicted(state, prediction.sort_predictions(out).limit(limit) if limit > 0 else out)

    def prediction_to_dataset(self, state):
        return State("dataset", to_dataset(state.index, prediction.predicted_triples(state.df)))

    def export_prediction(self, state, path: str, format: str = "ndjson"):  # noqa: A002
        results.write_predictions(state.df, path, format.lower())
        return state

    def sort_prediction(self, state):
        return self._predicted(state, prediction.sort_predictions(state.df))

    def to_tasks(self, state, generator="predictionCardinalities", confidence: str | None = None, limit: int = -1, topK: int = -1, fromTest: bool = False):
        """``generator``: {"type": testAll, testCardinalities, testPatterns, testCustom, predictionCardinalities or predictionPatterns, "patterns": [{"p",
        "targetVariable"}], "tasks": [{"p", "s" or "o"}]}; or Subject, Object, All, PredicateCardinalities. ``confidence`` was applied when grouping."""
        ix = state.index
        how = generator if isinstance(generator, dict) else {"type": generator}
        kind = {"PredicateCardinalities": "testCardinalities" if fromTest else "predictionCardinalities"}.get(how["type"], how["type"])
        sides = {"Subject": "subject", "Object": "object", "All": "both"}
        rows = prediction.sort_predictions(state.df).limit(limit) if limit > 0 else state.df
        wanted, patterns = None, None
        if kind in sides:
            side = sides[kind]
            wanted = tasks.test_tasks(ix.evaluated(), side) if fromTest else None
        elif kind in ("testCardinalities", "predictionCardinalities"):
            side = cardinalities.property_cardinalities(ix.facts)
            wanted = tasks.test_tasks(ix.evaluated(), side) if kind[0] == "t" else None
        elif kind in ("testAll", "testPatterns", "testCustom", "predictionPatterns"):
            side = "both"
            if kind.endswith("Patterns"):
                patterns = [(self._id(x["p"]) if x.get("p") else None, (x.get("targetVariable") or "").lower() or None) for x in how.get("patterns", ())]
            if kind == "testCustom":
                given = [(self._id(x["p"]), "subject" if "s" in x else "object", self._id(x.get("s", x.get("o")))) for x in how.get("tasks", ())]
                wanted = self.spark.createDataFrame(given, "p long, fixed_side string, fixed_value long").distinct()
            elif kind[0] == "t":
                wanted = tasks.test_tasks(ix.evaluated(), side)
                wanted = wanted if patterns is None else tasks.matching(wanted, patterns)
        else:
            raise ValueError(f"unknown generator {kind}")
        out = tasks.prediction_tasks(rows, side, wanted, max(0, topK))
        return State("tasks", cut(out if patterns is None else tasks.matching(out, patterns), "tasks"), ix, state.rules)

    # Prediction tasks
    def _tasks(self, state, df):
        return State("tasks", df, state.index, state.rules)

    def filter_tasks(self, state, predictedResults: list[str] = (), tripleMatchers: list[dict] = (), nonEmptyPredictions: bool = False, nonEmptyTest: bool = False):
        """Whole tasks: with a candidate of one of the results, and matched by (fixed side, predicate, fixed side) with the other side left open."""
        df = state.df
        if predictedResults:
            df = df.join(df.where(F.col("result").isin(list(self._results(predictedResults)))).select(*tasks.KEY).distinct(), tasks.KEY, "left_semi")
        if tripleMatchers:
            fixed = lambda side: F.when(F.col("fixed_side") == side, F.col("fixed_value"))
            keys = df.select(*tasks.KEY).distinct().withColumn("s", fixed("subject")).withColumn("o", fixed("object"))
            named = self._named(keys, state.index).withColumn("s", F.coalesce("s", F.lit("?"))).withColumn("o", F.coalesce("o", resource_struct(F.lit("?"))))
            df = df.join(filter_quads(named, [self._matcher(m) for m in tripleMatchers]).select("row.*").select(*tasks.KEY), tasks.KEY, "left_semi")
        df = tasks.non_empty(df) if nonEmptyPredictions else df
        return self._tasks(state, tasks.non_empty_test(df, state.index.evaluated()) if nonEmptyTest else df)

    def select(self, state, strategy=None, k: int = 10, minScore: float = 0.0, predictedResults: list[str] = ()):
        """``strategy``: {"type": topK, pca or qpca, "k"} or its type; none keeps all candidates."""
        df = state.df.where(F.col("score") >= minScore) if minScore else state.df
        df = df.where(F.col("result").isin(list(self._results(predictedResults)))) if predictedResults else df
        way = strategy if isinstance(strategy, dict) else {"type": strategy, "k": k}
        ways = {None: lambda: df, "topk": lambda: tasks.top_predictions(df, way["k"]), "pca": lambda: tasks.select_by_pca(df, state.index.facts), "qpca": lambda: tasks.select_by_qpca(df, state.index.facts)}
        return self._tasks(state, ways[way["type"] and way["type"].lower()]())

    def with_modes(self, state):
        return self._tasks(state, tasks.with_modes(state.df, state.index.facts))

    def evaluate(self, state, ranking: str = "test", k: list[int] = (1, 3, 10, 100)):
        if ranking not in ("test", "prediction"):
            raise ValueError(f"unknown ranking {ranking}")
        keys = state.df.select(*tasks.KEY).distinct()
        truth = tasks._sided(state.index.evaluated(), "both").select(*tasks.KEY, F.col("candidate").alias("answer")).join(keys, tasks.KEY, "left_semi")
        ranks = tasks.filtered_ranks(state.df, truth if ranking == "test" else None)
        return tasks.ranking_metrics(ranks, tuple(k)).first().asDict() | tasks.completeness_metrics(state.df, truth).first().asDict() | tasks.task_count(state.df).first().asDict()

    def tasks_to_predictions(self, state):
        return self._predicted(state, tasks.to_triples(state.df))

    def tasks_to_dataset(self, state):
        return State("dataset", to_dataset(state.index, tasks.to_triples(state.df)))


#: Task names, the kinds of object they follow, and their methods.
TASKS: dict[str, tuple[tuple[str, ...], str]] = {
    "LoadGraph": ((), "load"), "LoadDataset": ((), "load"), "LoadIndex": ((), "load_index"), "LoadRulesetWithoutIndex": ((), "load_rules"), "LoadPredictionWithoutIndex": ((), "load_prediction"),
    "AddPrefixes": (("dataset",), "add_prefixes"), "CacheDataset": (("dataset",), "cache"), "Discretize": (("dataset",), "discretize"), "DiscretizeInBulk": (("dataset",), "discretize_in_bulk"),
    "ExportQuads": (("dataset",), "export_quads"), "FilterQuads": (("dataset",), "filter_quads"), "GetQuads": (("dataset",), "get"), "Histogram": (("dataset",), "histogram"),
    "MapQuads": (("dataset",), "map_quads"), "Prefixes": (("dataset",), "prefixes"), "DatasetSize": (("dataset",), "size"), "ShrinkQuads": (("dataset",), "shrink"), "Split": (("dataset",), "split"),
    "Properties": (("dataset",), "properties"), "Index": (("dataset",), "index"),
    "CachePrediction": (("prediction",), "cache"), "FilterPrediction": (("prediction",), "filter_prediction"), "GroupPredictions": (("prediction",), "group"), "GetPrediction": (("prediction",), "get"),
    "PredictionToDataset": (("prediction",), "prediction_to_dataset"), "PredictionSize": (("prediction",), "size"), "ExportPrediction": (("prediction",), "export_prediction"),
    "ShrinkPrediction": (("prediction",), "shrink"), "SortPrediction": (("prediction",), "sort_prediction"), "ToPredictionTasks": (("prediction",), "to_tasks"),
    "CachePredictionTasks": (("tasks",), "cache"), "FilterPredictionTasks": (("tasks",), "filter_tasks"), "SelectCandidates": (("tasks",), "select"), "WithModes": (("tasks",), "with_modes"),
    "Evaluate": (("tasks",), "evaluate"), "GetPredictionTasks": (("tasks",), "get"), "PredictionTasksToDataset": (("tasks",), "tasks_to_dataset"), "PredictionTasksToPredictions": (("tasks",), "tasks_to_predictions"),
    "PredictionTasksSize": (("tasks",), "size"), "ShrinkPredictionTasks": (("tasks",), "shrink"),
    "CacheIndex": (("index",), "cache"), "Mine": (("index",), "mine"), "AutoDiscretization": (("index",), "auto_discretization"), "IndexToDataset": (("index",), "index_to_dataset"),
    "PropertiesCardinalities": (("index",), "properties_cardinalities"), "ExportIndex": (("index",), "export_index"), "LoadRuleset": (("index",), "load_rules"), "LoadPrediction": (("index",), "load_prediction"),
    "CacheRuleset": (("ruleset",), "cache"), "ComputeConfidence": (("ruleset",), "compute_confidence"), "ComputeSupport": (("ruleset",), "compute_support"), "ExportRules": (("ruleset",), "export_rules"),
    "FilterRules": (("ruleset",), "filter_rules"), "FindSimilar": (("ruleset",), "find_similar"), "GetRules": (("ruleset",), "get"), "GraphAwareRules": (("ruleset",), "graph_aware"),
    "MakeClusters": (("ruleset",), "make_clusters"), "RulesetSize": (("ruleset",), "size"), "ShrinkRuleset": (("ruleset",), "shrink"), "SortRuleset": (("ruleset",), "sort_rules"),
    "Predict": (("ruleset",), "predict"), "ToDatasetWithIntervals": (("ruleset",), "with_intervals"), "Prune": (("ruleset",), "prune"), "Instantiate": (("ruleset",), "instantiate"),
}


def run_pipeline(spark: SparkSession, steps: list[dict]) -> object:
    """Runs a list of {"name": task, "parameters": {...}}."""
    return Pipeline(spark).run(steps)
