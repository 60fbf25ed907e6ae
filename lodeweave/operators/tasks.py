"""Prediction tasks (predicate, fixed side, fixed value), their candidates, and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["p", "fixed_side", "fixed_value"]


def _sided(df: DataFrame, side: str | DataFrame) -> DataFrame:
    """``df`` of triples with ``fixed_side``, ``fixed_value`` and ``candidate``; ``side``: subject, object, both, or a table of
    cardinalities, whose higher side is fixed (subject for an unknown predicate)."""
    if isinstance(side, str):
        fixed = F.explode(F.array(*[F.lit(x) for x in (("subject", "object") if side == "both" else (side,))]))
        out = df.withColumn("fixed_side", fixed)
    else:
        out = df.join(F.broadcast(side.select("p", F.col("higher_side").alias("fixed_side"))), "p", "left").withColumn("fixed_side", F.coalesce("fixed_side", F.lit("subject")))
    subject = F.col("fixed_side") == "subject"
    return out.withColumn("fixed_value", F.when(subject, F.col("s")).otherwise(F.col("o"))).withColumn("candidate", F.when(subject, F.col("o")).otherwise(F.col("s")))


def test_tasks(test: DataFrame, side: str | DataFrame = "both") -> DataFrame:
    """Distinct tasks of the test triples."""
    return _sided(test.select("s", "p", "o"), side).select(*KEY).distinct()


def matching(tasks: DataFrame, patterns: list[tuple[int | None, str | None]]) -> DataFrame:
    """Tasks that fit one of the (predicate, open side) patterns; None fits all."""
    fit = F.lit(False)
    for p, target in patterns:
        one = F.lit(True) if p is None else F.col("p") == p
        fit = fit | (one if target is None else one & (F.col("fixed_side") == {"subject": "object", "object": "subject"}[target]))
    return tasks.where(fit)


def prediction_tasks(grouped: DataFrame, side: str | DataFrame, wanted: DataFrame | None = None, top_k: int = 0) -> DataFrame:
    """Candidates by task with ``rank`` from 1 (score, confidences, candidate). Tasks in ``wanted`` without a candidate
    have one row with nulls. ``top_k`` keeps the best of each task."""
    rows = _sided(grouped.select("s", "p", "o", "result", "score", "confs"), side)
    if wanted is not None:
        rows = rows.join(wanted, KEY, "left_semi")
    order = [F.desc("score"), F.concat("confs", F.array(F.lit(0.0))).desc(), F.asc("candidate")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))
    if top_k:
        rows = rows.where(F.col("rank") <= top_k)
    rows = rows.select(*KEY, "rank", "candidate", "result", "score")
    return rows if wanted is None else wanted.join(rows, KEY, "left")


def top_predictions(tasks: DataFrame, k: int) -> DataFrame:
    return tasks.where(F.col("rank") <= k)


def _known(train: DataFrame, tasks: DataFrame) -> DataFrame:
    """(``KEY``, ``known``): answers that ``train`` has for each task."""
    n = None
    for side, c in (("subject", "s"), ("object", "o")):
        part = train.groupBy("p", F.col(c).alias("fixed_value")).agg(F.count("*").alias("known")).withColumn("fixed_side", F.lit(side))
        n = part if n is None else n.unionByName(part)
    return tasks.join(n, KEY, "left").withColumn("known", F.coalesce("known", F.lit(0)))


def select_by_pca(tasks: DataFrame, train: DataFrame) -> DataFrame:
    """The best candidate of tasks to which ``train`` has no answer."""
    return _known(train, tasks).where("known = 0 and rank <= 1").drop("known")


def select_by_qpca(tasks: DataFrame, train: DataFrame) -> DataFrame:
    """As many best candidates of each task as its known answers fall short of the average of the predicate and side."""
    avg = None
    for side, c in (("subject", "s"), ("object", "o")):
        a = train.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct(c).alias("d")).select("p", F.lit(side).alias("fixed_side"), F.floor(F.col("n") / F.col("d") + 0.5).alias("average"))
        avg = a if avg is None else avg.unionByName(a)
    out = _known(train, tasks).join(F.broadcast(avg), ["p", "fixed_side"])
    return out.where(F.col("rank") <= F.col("average") - F.col("known")).drop("known", "average")


def with_modes(tasks: DataFrame, train: DataFrame) -> DataFrame:
    """Tasks with the most frequent value of the target side (smallest id among equals) as last candidate, if absent."""
    modes = None
    for side, c in (("subject", "o"), ("object", "s")):
        n = train.groupBy("p", F.col(c).alias("v")).agg(F.count("*").alias("n"))
        m = n.groupBy("p").agg(F.max(F.struct("n", (-F.col("v")).alias("m"))).alias("b")).select("p", F.lit(side).alias("fixed_side"), (-F.col("b.m")).alias("candidate"))
        modes = m if modes is None else modes.unionByName(m)
    last = tasks.groupBy(*KEY).agg(F.coalesce(F.max("rank"), F.lit(0)).alias("_last"))
    new = last.join(F.broadcast(modes), ["p", "fixed_side"]).join(tasks.select(*KEY, "candidate"), [*KEY, "candidate"], "left_anti")
    new = new.select(*KEY, (F.col("_last") + 1).alias("rank"), "candidate", F.lit(None).cast("string").alias("result"), F.lit(0.0).alias("score"))
    return tasks.where("candidate is not null").select(*new.columns).unionByName(new)


def non_empty(tasks: DataFrame) -> DataFrame:
    """Candidates only: tasks without any go."""
    return tasks.where("candidate is not null")


def non_empty_test(tasks: DataFrame, test: DataFrame) -> DataFrame:
    """Tasks to which ``test`` has an answer."""
    return tasks.join(test_tasks(test), KEY, "left_semi")


def to_triples(tasks: DataFrame) -> DataFrame:
    subject = F.col("fixed_side") == "subject"
    return non_empty(tasks).select(F.when(subject, F.col("fixed_value")).otherwise(F.col("candidate")).alias("s"), "p", F.when(subject, F.col("candidate")).otherwise(F.col("fixed_value")).alias("o")).distinct()


def filtered_ranks(tasks: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(``KEY``, ``answer``, ``rank``): rank of each answer among its task's candidates without the other Positive ones.

    With ``truth`` (``KEY``, ``answer``) one row for each answer, rank 0 if absent; otherwise one for each Positive
    candidate, and one with rank 0 for tasks without.
    """
    w = Window.partitionBy(*KEY).orderBy("rank")
    good = F.coalesce((F.col("result") == "Positive").cast("int"), F.lit(0))
    before = F.coalesce(F.sum(good).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = tasks.where("candidate is not null").withColumn("_r", F.row_number().over(w) - before)
    if truth is not None:
        found = own.select(*KEY, F.col("candidate").alias("answer"), "_r")
        return truth.join(found, [*KEY, "answer"], "left").select(*KEY, "answer", F.coalesce("_r", F.lit(0)).alias("rank"))
    hits = own.where("result = 'Positive'").select(*KEY, F.col("candidate").alias("answer"), F.col("_r").alias("rank"))
    missing = tasks.select(*KEY).distinct().join(hits.select(*KEY), KEY, "left_anti")
    return hits.unionByName(missing.select(*KEY, F.lit(None).cast("long").alias("answer"), F.lit(0).alias("rank")))


def ranking_metrics(ranks: DataFrame, hits: tuple[int, ...] = (1, 3, 10, 100)) -> DataFrame:
    """One row: hits_<k> and mrr over all ranks, mr over the found ones."""
    found = F.col("rank") > 0
    n = F.count("*")
    share = lambda c: F.when(n > 0, F.sum(c) / n).otherwise(0.0)
    cols = [share(F.when(found & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hits_{k}") for k in hits]
    mr = F.coalesce(F.avg(F.when(found, F.col("rank"))), F.lit(0.0))
    return ranks.agg(*cols, mr.alias("mr"), share(F.when(found, 1 / F.col("rank")).otherwise(0)).alias("mrr"), n.alias("total"), F.coalesce(F.sum(found.cast("long")), F.lit(0)).alias("total_correct"))


def completeness_metrics(tasks: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn and precision, recall, f_measure, accuracy of the candidates against ``truth``."""
    candidates = tasks.where("candidate is not null").select(*KEY, "candidate").distinct()
    answers = truth.select(*KEY, F.col("answer").alias("candidate")).distinct()
    both = candidates.withColumn("_c", F.lit(1)).join(answers.withColumn("_a", F.lit(1)), [*KEY, "candidate"], "full")
    n = both.agg(F.count_if(F.col("_c").isNotNull() & F.col("_a").isNotNull()).alias("tp"), F.count_if(F.col("_a").isNull()).alias("fp"), F.count_if(F.col("_c").isNull()).alias("fn")).withColumn("tn", F.lit(0).cast("long"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = n.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})
    p, r = F.col("precision"), F.col("recall")
    return n.withColumn("f_measure", ratio(2 * p * r, p + r))


def task_count(tasks: DataFrame) -> DataFrame:
    return tasks.select(*KEY).distinct().agg(F.count("*").alias("n_tasks"))


def best_candidates(rules: DataFrame, facts: DataFrame, side: str, wanted: DataFrame, k: int) -> DataFrame:
    """The ``prediction_tasks`` of the best ``k`` candidates (largest confidence of a rule, then smallest id) of all rules with confidences (not injective),
    without listing all predictions.

    A rule's candidates of a task all have its confidence, so that a rule gives at most its ``k`` smallest; of a two-hop body they are among the ``k`` smallest of
    each partner. Tasks in ``wanted`` without a candidate have one row with nulls; ``side`` is subject or object.
    """
    from lodeweave.operators.measures import by_shape, default_confidence, hop_places, is_hop, predicted_pairs
    from lodeweave.operators.unions import entries
    from lodeweave.plans.lineage import cut
    from lodeweave.plans.sizing import broadcast_if_small

    if side not in ("subject", "object"):
        raise ValueError("side must be subject or object")
    facts = facts.select("s", "p", "o")
    conf = rules.select("rule_id", F.coalesce(default_confidence(), F.lit(0.0)).alias("score"))
    tasks = wanted.where(F.col("fixed_side") == side).select("p", F.col("fixed_value").alias("v")).distinct()
    hops, listed = [], []
    for shape, own in by_shape(rules):
        if is_hop(shape):
            (i, x), (j, y) = hop_places(shape) if side == "subject" else hop_places(shape)[::-1]
            hops.append(own.select("rule_id", F.col("p0").alias("p"), F.col(f"p{i}").alias("pa"), F.lit(x).alias("ka"), F.col(f"p{j}").alias("pb"), F.lit(y).alias("kb")))
        else:
            listed.append(own.select("rule_id"))
    parts = []
    if listed:
        pairs = predicted_pairs(rules.join(reduce(DataFrame.unionByName, listed), "rule_id", "left_semi"), facts)
        ends = ("s", "o") if side == "subject" else ("o", "s")
        parts.append(pairs.select("rule_id", "p", F.col(ends[0]).alias("v"), F.col(ends[1]).alias("candidate")).join(tasks, ["p", "v"], "left_semi"))
    if hops:
        hops = broadcast_if_small(cut(reduce(DataFrame.unionByName, hops), "hops"), 100_000)
        ends = entries(facts)
        of_rules = ends.join(F.broadcast(hops.select(F.col("pb").alias("p"), F.col("kb").alias("k")).distinct()), ["p", "k"], "left_semi")
        first = of_rules.withColumn("_n", F.row_number().over(Window.partitionBy("p", "k", "z").orderBy("v"))).where(F.col("_n") <= k)
        first = cut(first.select(F.col("p").alias("pb"), F.col("k").alias("kb"), "z", F.col("v").alias("candidate")), "first-values")
        asked = tasks.join(hops, "p").join(ends.select(F.col("p").alias("pa"), F.col("k").alias("ka"), "v", "z"), ["pa", "ka", "v"])
        parts.append(asked.join(first, ["pb", "kb", "z"]).select("rule_id", "p", "v", "candidate"))
    best = rules.sparkSession.createDataFrame([], "p long, v long, candidate long, score double")
    for part in parts:
        best = best.unionByName(part.join(broadcast_if_small(conf, 100_000), "rule_id").select("p", "v", "candidate", "score"))
    best = best.groupBy("p", "v", "candidate").agg(F.max("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("p", "v").orderBy(F.desc("score"), "candidate"))).where(F.col("rank") <= k)
    best = best.select("p", F.lit(side).alias("fixed_side"), F.col("v").alias("fixed_value"), "rank", "candidate", "score")
    return wanted.join(best, KEY, "left")
