"""Queries of problem 4: figures per predicate although a few predicates hold most quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.terms import complete_quads, resolve_ids, term_aliases
from lodeweave.operators.tree_aggregate import predicate_figures


def p4_key_figures(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """Figures of each predicate, by term ids."""
    return predicate_figures(resolve_ids(complete_quads(spark, sf_dir), term_aliases(spark, sf_dir), ["p", "o", "s"]), **kw)


def p4_many_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with chunks so small that heavy keys go through several rounds at any size."""
    return p4_key_figures(spark, sf_dir, chunk_rows=200, fan_in=3)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object of each predicate that occurs with it for the most distinct subjects."""
    return p4_key_figures(spark, sf_dir).select("p", F.col("top_object").alias("o"))


#: Term ids in SQL, shared by the checks of the queries over quads.
TERM_SQL = """
keyed AS (
  SELECT d.id, d.kind, d.num, CASE WHEN d.kind = 'number' AND d.num IS NOT NULL THEN 'number' || CAST(d.num AS VARCHAR)
    ELSE coalesce(d.kind, '') || ':' || CASE WHEN d.kind = 'uri' AND x.ns IS NOT NULL THEN x.ns || substr(d.value, length(x.prefix) + 2) ELSE coalesce(d.value, '') END END AS k
  FROM (SELECT * FROM terms UNION ALL SELECT * FROM vocab) d LEFT JOIN prefixes x ON d.kind = 'uri' AND starts_with(d.value, x.prefix || ':')),
tid AS (SELECT id, kind, num, min(id) OVER (PARTITION BY k) AS t FROM keyed),
cq AS (SELECT coalesce(a.t, q.s) AS s, coalesce(b.t, q.p) AS p, coalesce(c.t, q.o) AS o FROM quads q
  LEFT JOIN tid a ON a.id = q.s LEFT JOIN tid b ON b.id = q.p LEFT JOIN tid c ON c.id = q.o
  WHERE q.s IS NOT NULL AND q.p IS NOT NULL AND q.o IS NOT NULL)"""

ORACLE = {
    "p4_key_figures": f"""WITH {TERM_SQL},
po AS (SELECT p, o, count(*) AS quads, count(DISTINCT s) AS subjects FROM cq GROUP BY p, o),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY subjects DESC, o) AS rn FROM po)
SELECT p, CAST(sum(quads) AS BIGINT) AS n_quads, CAST(sum(subjects) AS BIGINT) AS n_triples, count(*) AS n_objects,
  max(CASE WHEN rn = 1 THEN o END) AS top_object, max(CASE WHEN rn = 1 THEN subjects END) AS top_subjects FROM r GROUP BY p""",
    "p4_found": f"""WITH {TERM_SQL},
po AS (SELECT p, o, count(DISTINCT s) AS subjects FROM cq GROUP BY p, o)
SELECT p, o FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY subjects DESC, o) AS rn FROM po) WHERE rn = 1""",
}
ORACLE["p4_many_chunks"] = ORACLE["p4_key_figures"]
QUERIES = {"p4_found": p4_found, "p4_key_figures": p4_key_figures, "p4_many_chunks": p4_many_chunks}
