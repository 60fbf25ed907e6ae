"""Queries of rule mining and rule measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.measures import with_confidences, with_lift
from lodeweave.operators.mining import MiningTask, heads, mine, without_quasi_binding
from lodeweave.operators.patterns import AtomPattern, Item, RulePattern
from lodeweave.queries.common import FACTS_SQL, IS_OF_CLASS, LOCATED_AT, RELATED_TO, facts
from lodeweave.queries.rule_sql import INV2, LEN2, measured, three

_HC = 0.01
QUERIES = {}
ORACLE = {}


def _flat(rules: DataFrame, *cols: str) -> DataFrame:
    item = lambda a, c: F.when(F.col(a)[c]["is_var"], F.concat(F.lit("?"), F.col(a)[c]["var"].cast("string"))).otherwise(F.col(a)[c]["const"].cast("string"))
    atom = F.concat(item("head", "s"), F.lit(" "), F.col("head.p").cast("string"), F.lit(" "), item("head", "o"))
    return rules.select(F.col("canon"), atom.alias("head_atom"), *cols)


def _measured(rules: DataFrame) -> DataFrame:
    return rules.select("canon", "support", "head_size", F.round("head_coverage", 6).alias("head_coverage"))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    return heads(facts(spark, d), MiningTask(min_head_coverage=_HC)).select("p", "head_size", "head_support")


def _heads_constants(spark: SparkSession, d: str) -> DataFrame:
    return heads(facts(spark, d), MiningTask(min_head_coverage=0.05, constants="anywhere")).select("p", "side", "const", "head_size", "head_support")


def _mined(**kw):
    return lambda spark, d: _measured(mine(facts(spark, d), MiningTask(**{"min_head_coverage": _HC, "min_head_size": 50, **kw})))


QUERIES["heads"] = _heads
ORACLE["heads"] = f"WITH {FACTS_SQL} SELECT p, count(*) AS head_size, count(*) AS head_support FROM facts GROUP BY p HAVING count(*) >= 100"
QUERIES["heads_with_constants"] = _heads_constants
ORACLE["heads_with_constants"] = f"""WITH {FACTS_SQL}, z AS (SELECT p, count(*) AS n FROM facts GROUP BY p HAVING count(*) >= 100),
a AS (SELECT p, NULL AS side, NULL::BIGINT AS const, n AS head_size, n AS head_support FROM z UNION ALL
SELECT p, 'subject', s, any_value(n), count(*) FROM facts JOIN z USING (p) GROUP BY p, s UNION ALL
SELECT p, 'object', o, any_value(n), count(*) FROM facts JOIN z USING (p) GROUP BY p, o)
SELECT * FROM a WHERE head_support >= greatest(1, ceil(round(head_size * 0.05, 6)))"""

_Z = "z AS (SELECT p, count(*) AS n FROM facts GROUP BY p HAVING count(*) >= 50)"
_TAIL = f"""SELECT canon, support, n AS head_size, round(support / n, 6) AS head_coverage FROM (SELECT canon, any_value(hp) AS hp, any_value(support) AS support FROM r GROUP BY canon) JOIN z ON z.p = hp
WHERE support >= greatest(1, ceil(round(n * {_HC}, 6)))"""
def _sql(union: str, tail: str = _TAIL, facts_sql: str = FACTS_SQL) -> str:
    return f"WITH {facts_sql}, {_Z}, r AS ({union}) {tail}"


QUERIES["rules_len2"] = _mined(max_length=2)
ORACLE["rules_len2"] = _sql(f"({LEN2.format(w='')}) UNION ALL ({INV2.format(w='')})")
QUERIES["rules_len3"] = _mined()
ORACLE["rules_len3"] = _sql(three(False))
QUERIES["rules_injective"] = _mined(injective=True)
ORACLE["rules_injective"] = _sql(three(True)).replace("z AS (SELECT p, count(*) AS n FROM facts GROUP", "z AS (SELECT p, count(*) AS n FROM facts WHERE s <> o GROUP")
ONLY = (IS_OF_CLASS, RELATED_TO, LOCATED_AT)
QUERIES["rules_only_predicates"] = _mined(only_predicates=ONLY)
ORACLE["rules_only_predicates"] = _sql(three(False), facts_sql=FACTS_SQL.replace("FROM cq)", f"FROM cq WHERE p IN {ONLY})"))
QUERIES["rules_without_predicates"] = _mined(without_predicates=(IS_OF_CLASS,))
ORACLE["rules_without_predicates"] = _sql(three(False), facts_sql=FACTS_SQL.replace("FROM cq)", f"FROM cq WHERE p <> {IS_OF_CLASS})"))
QUERIES["rules_topk"] = _mined(top_k=20)
ORACLE["rules_topk"] = _sql(three(False), f"SELECT * FROM ({_TAIL}) ORDER BY support / head_size DESC, canon LIMIT 20")
QUERIES["rules_pattern"] = _mined(patterns=(RulePattern(head=AtomPattern(p=Item("constant", RELATED_TO))), RulePattern(body=(AtomPattern(p=Item("one_of", (LOCATED_AT,))),))))
ORACLE["rules_pattern"] = _sql(three(False), f"SELECT * FROM ({_TAIL}) WHERE canon LIKE '?0 {RELATED_TO} ?1;%' OR regexp_matches(canon, ';.. {LOCATED_AT} ..;')")
_CONST = """SELECT h.p AS hp, h.o AS hc, b.p AS bp, b.o AS bc, count(*) AS support FROM facts h JOIN facts b ON h.s = b.s AND (h.p <> b.p OR h.o <> b.o) GROUP BY ALL"""
QUERIES["rules_len2_constants"] = lambda spark, d: _measured(mine(facts(spark, d), MiningTask(min_head_coverage=0.05, max_length=2, constants="object"))).where("canon like '%#%'")
ORACLE["rules_len2_constants"] = f"""WITH {FACTS_SQL}, z AS (SELECT p, count(*) AS n FROM facts GROUP BY p HAVING count(*) >= 100), r AS ({_CONST})
SELECT '?0 ' || hp || ' #' || hc || ';?0 ' || bp || ' #' || bc || ';' AS canon, support, n AS head_size, round(support / n, 6) AS head_coverage FROM r JOIN z ON z.p = hp
WHERE support >= ceil(round(n * 0.05, 6))"""

_TASK = MiningTask(min_head_coverage=0.05, min_head_size=50)


def _confident(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    return with_confidences(mine(f, _TASK), f)


def _confidence(kind: str):
    return lambda spark, d: _confident(spark, d).select("canon", "support", f"{kind}body_size", F.round(f"{kind or 'cwa_'}confidence", 6).alias("confidence"))


for _k in ("", "pca_", "qpca_"):
    _n = f"{_k or 'cwa_'}confidence"
    QUERIES[_n] = _confidence(_k)
    ORACLE[_n] = f"{measured(50, 0.05)} SELECT canon, support, {_k}body_size, round({_k[:-1] or 'cwa'}, 6) AS confidence FROM rt"
