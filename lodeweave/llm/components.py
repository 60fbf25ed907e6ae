"""Problem 3: one group identifier for all records linked directly or indirectly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.terms import complete_quads, dictionary, with_long_form
from lodeweave.plans.lineage import cut, release
from lodeweave.plans.sizing import broadcast_if_small
from lodeweave.session import table

SAME_AS = "http://kg.example/ont#sameAs"


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; edges have ``u`` > ``v``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, left: str = "s", right: str = "o", max_rounds: int = 100) -> DataFrame:
    """(``group_id``, ``term_id``): each id of a link, and the smallest id linked to it.

    Alternates large-star and small-star rewrites, both joins and aggregates over distributed edges, until
    neither changes them; every edge then leads to the component's smallest id. Minima are aggregated on the
    map side and joined back, so that a hub's edges are never in one place. Each round is written to the shared
    folder. Links with a null side don't count; reflexive links give a group of their own; repeated and
    turned links, extra columns and no links at all are fine.
    """
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null")
    ends = cut(pairs.distinct(), "links")
    edges = cut(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _fingerprint(edges)
    for _ in range(max_rounds):
        after_edges = cut(_small_star(_large_star(edges)), "edges")
        after = _fingerprint(after_edges)
        release(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    nodes = ends.select(F.explode(F.array("a", "b")).alias("term_id")).distinct()
    out = nodes.join(edges.select(F.col("u").alias("term_id"), F.col("v").alias("_g")), "term_id", "left")
    return out.select(F.coalesce("_g", "term_id").alias("group_id"), "term_id")


def same_as_links(spark: SparkSession, sf_dir: str, uri: str = SAME_AS) -> DataFrame:
    """Complete quads of the predicate ``uri`` in long or prefixed form whose sides are uri or bnode."""
    terms = dictionary(spark, sf_dir)
    forms = with_long_form(terms.where("kind = 'uri'").select("id", "kind", "value"), table(spark, sf_dir, "prefixes"))
    forms = forms.where(F.col("long") == uri).select(F.col("id").alias("p")).distinct()
    links = complete_quads(spark, sf_dir).join(broadcast_if_small(forms), "p", "left_semi").select("s", "o").distinct()
    nodes = terms.where("kind in ('uri', 'bnode')").select("id")
    for col in ("s", "o"):
        links = links.join(nodes.withColumnRenamed("id", col), col, "left_semi")
    return links.select("s", "o")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each id in a sameAs link."""
    return connected_components(same_as_links(spark, sf_dir))


def p3_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of groups of each size."""
    sizes = p3_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("n_ids"))
    return sizes.groupBy("n_ids").agg(F.count("*").alias("n_groups"))


_SQL = f"""WITH RECURSIVE d AS (SELECT * FROM terms UNION ALL SELECT * FROM vocab),
pred AS (SELECT id FROM d LEFT JOIN prefixes x ON starts_with(d.value, x.prefix || ':') WHERE kind = 'uri'
  AND CASE WHEN x.ns IS NOT NULL THEN x.ns || substr(value, length(x.prefix) + 2) ELSE value END = '{SAME_AS}'),
l AS (SELECT DISTINCT s, o FROM quads WHERE p IN (SELECT id FROM pred)
  AND s IN (SELECT id FROM d WHERE kind IN ('uri', 'bnode')) AND o IN (SELECT id FROM d WHERE kind IN ('uri', 'bnode'))),
e AS (SELECT s AS a, o AS b FROM l UNION SELECT o, s FROM l),
r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
g AS (SELECT min(seen) AS group_id, node AS term_id FROM r GROUP BY node)
"""
QUERIES = {"p3_found": p3_found, "p3_group_sizes": p3_group_sizes}
ORACLE = {
    "p3_found": _SQL + "SELECT group_id, term_id FROM g",
    "p3_group_sizes": _SQL + "SELECT n_ids, count(*) AS n_groups FROM (SELECT count(*) AS n_ids FROM g GROUP BY group_id) GROUP BY n_ids",
}
