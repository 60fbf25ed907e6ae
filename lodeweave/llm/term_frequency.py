"""Problem 2: how often every term occurs in a place, in how many subjects, and which are of no use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.skewed_keys import TERM_SQL
from lodeweave.operators.terms import complete_quads, resolve_ids, term_aliases
from lodeweave.plans.lineage import cut
from lodeweave.plans.sizing import hot_values

RARE_BELOW = 3
COMMON_ABOVE = 0.05
_ALL, _PREDICATE, _OBJECT = 0, 1, 2


def _tall(quads: DataFrame) -> DataFrame:
    """One row per place, term and quad; place 0 stands for all quads."""
    places = ((_ALL, F.lit(0).cast("long")), (_PREDICATE, F.col("p")), (_OBJECT, F.col("o")))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), c.alias("term_id")) for k, c in places]))
    return quads.select("s", cells.alias("t")).select("t.place", "t.term_id", "s").where("term_id is not null")  # also what lets both tables below read one shuffle


def term_counts(quads: DataFrame, heavy: dict[int, list[int]], hot_subjects: list[int] = []) -> DataFrame:
    """(``place``, ``term_id``, ``n_quads``, ``n_subjects``) of the terms in predicate (1) and object (2)
    place, and of the term 0 in place 0, which stands for all quads.

    Distinct subjects are exact because the quads of a subject meet once, before any counting: one shuffle of the quads by
    subject, in which no term decides where a row goes. From there the rows of the terms in ``heavy`` (by place, at most a
    fixed number) are counted where they are, in counters local to the task, and are not shuffled: a task sends one counter of each term. The rows of all other terms
    are shuffled by term, as partial counts. Both tables are united. The quads of ``hot_subjects``, which one task should not
    hold, are spread by term instead. Neither list changes a result.
    """
    spark = quads.sparkSession
    by_subject = lambda q, *first: q.groupBy(*first, *[c for c in ("place", "term_id", "s") if c not in first]).agg(F.count("*").alias("n")).select("place", "term_id", "s", "n")
    if hot_subjects:
        is_hot = F.col("s").isin(sorted(set(hot_subjects)))
        per_subject = by_subject(_tall(quads.where(~is_hot).repartition("s")), "s").unionByName(by_subject(_tall(quads.where(is_hot))))
    else:
        per_subject = by_subject(_tall(quads.repartition("s")), "s")
    slots = [(_ALL, 0)] + [(place, t) for place, terms in heavy.items() for t in sorted(set(terms))]
    slots = spark.createDataFrame([(i, *x) for i, x in enumerate(slots)], "slot int, place int, term_id long")
    marked = per_subject.join(F.broadcast(slots), ["place", "term_id"], "left")
    totals = [F.sum("n").alias("n_quads"), F.count("*").alias("n_subjects")]
    local = marked.where("slot is not null").groupBy("slot").agg(F.first("place").alias("place"), F.first("term_id").alias("term_id"), *totals)
    light = marked.where("slot is null").groupBy("place", "term_id").agg(*totals)
    return local.drop("slot").unionByName(light)


def term_frequencies(quads: DataFrame, aliases: DataFrame, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """``place`` (predicate, object), ``term_id``, ``n_quads``, ``n_subjects``, ``mark``.

    ``mark`` is rare below ``rare_below`` distinct subjects, else common above the share ``common_above`` of
    all distinct subjects, else null. Quads with a null in ``s``, ``p`` or ``o`` don't count, repeated quads
    count in ``n_quads`` only, extra columns are ignored, no quads give no rows. The caller's ids are
    replaced by term ids.
    """
    q = quads.select("s", "p", "o").where("s is not null and p is not null and o is not null")
    raw = hot_values(q, "p", "o", "s")
    hot = sorted({x for v in raw.values() for x in v})
    to = {r["id"]: r["term_id"] for r in aliases.where(F.col("id").isin(hot)).collect()} if hot else {}  # at most a fixed number of hot ids
    p, o, s = ([to.get(x, x) for x in raw[c]] for c in ("p", "o", "s"))
    counts = cut(term_counts(resolve_ids(q, aliases, ["p", "s", "o"]), {_PREDICATE: p, _OBJECT: o}, s), "term-counts")
    total = counts.where(F.col("place") == _ALL).agg(F.max("n_subjects").alias("_total"))
    mark = F.when(F.col("n_subjects") < rare_below, "rare").when(F.col("n_subjects") > F.col("_total") * common_above, "common")
    out = counts.where(F.col("place") != _ALL).crossJoin(F.broadcast(total))  # one row
    place = F.when(F.col("place") == _PREDICATE, "predicate").otherwise("object")
    return out.select(place.alias("place"), "term_id", "n_quads", "n_subjects", mark.alias("mark"))


def p2_term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mark of every term in predicate and object place."""
    return term_frequencies(complete_quads(spark, sf_dir), term_aliases(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that are too rare or too common."""
    return p2_term_frequencies(spark, sf_dir).where("mark is not null").select("place", "term_id", "mark")


_SQL = f"""WITH {TERM_SQL},
f AS (SELECT 'predicate' AS place, p AS term_id, s FROM cq UNION ALL SELECT 'object', o, s FROM cq),
c AS (SELECT place, term_id, count(*) AS n_quads, count(DISTINCT s) AS n_subjects FROM f GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN n_subjects < 3 THEN 'rare' WHEN n_subjects > 0.05 * (SELECT count(DISTINCT s) FROM cq) THEN 'common' END AS mark FROM c)
SELECT """
QUERIES = {"p2_found": p2_found, "p2_term_frequencies": p2_term_frequencies}
ORACLE = {"p2_found": _SQL + "place, term_id, mark FROM m WHERE mark IS NOT NULL", "p2_term_frequencies": _SQL + "* FROM m"}
