"""The knowledge graph of the test tables as distinct triples, in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeweave.operators.skewed_keys import TERM_SQL
from lodeweave.operators.terms import complete_quads, resolve_ids, term_aliases
from lodeweave.plans.lineage import cut

#: Predicates by term id: isOfClass, relatedTo, locatedAt, hasOwner, hasKeeper.
IS_OF_CLASS, RELATED_TO, LOCATED_AT, HAS_OWNER, HAS_KEEPER = 100, 102, 106, 114, 120

FACTS_SQL = f"{TERM_SQL}, facts AS MATERIALIZED (SELECT DISTINCT s, p, o FROM cq)"


_ENCODED: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of change of the tables behind the facts."""
    out = []
    for name in ("quads", "terms", "vocab", "prefixes"):
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out.append((fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()))
    return tuple(out)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct triples of complete quads by term ids: the index that mining, measures and predictions share. It is written once in a session and
    made again when a table has changed."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir))
    if key not in _ENCODED:
        quads = resolve_ids(complete_quads(spark, sf_dir), term_aliases(spark, sf_dir), ["p", "s", "o"])
        _ENCODED[key] = cut(quads.distinct(), "facts")
    return _ENCODED[key]
