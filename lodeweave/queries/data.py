"""Queries over datasets, indexes and discretization."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions.matching import QuadMatcher, filter_quads, map_quads, printed
from lodeweave.operators import cardinalities as C
from lodeweave.operators import dataset as D
from lodeweave.operators import discretize as Z
from lodeweave.operators.terms import complete_quads, dictionary
from lodeweave.plans.lineage import cut, delete, shared_dir
from lodeweave.queries.common import FACTS_SQL, facts
from lodeweave.session import table
from lodeweave.sources import rdf
from lodeweave.sources.tables import table_triples

QUERIES = {}
ORACLE = {}
_DEC = """lk AS (SELECT d.*, CASE WHEN d.kind = 'uri' AND x.ns IS NOT NULL THEN x.ns || substr(d.value, length(x.prefix) + 2) ELSE d.value END AS long
  FROM (SELECT * FROM terms UNION ALL SELECT * FROM vocab) d LEFT JOIN prefixes x ON d.kind = 'uri' AND starts_with(d.value, x.prefix || ':')),
dq AS (SELECT a.long AS s, b.long AS p, c.kind, c.long AS v, c.num, coalesce(e.long, '') AS g,
  CASE WHEN c.kind = 'uri' THEN '<' || c.long || '>' WHEN c.kind = 'text' THEN '"' || c.long || '"' ELSE c.long END AS o
  FROM quads q LEFT JOIN lk a ON a.id = q.s LEFT JOIN lk b ON b.id = q.p JOIN lk c ON c.id = q.o LEFT JOIN lk e ON e.id = q.g
  WHERE q.s IS NOT NULL AND q.p IS NOT NULL AND q.o IS NOT NULL)"""
ONT = "http://kg.example/ont#"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _show(quads: DataFrame) -> DataFrame:
    return quads.select("s", "p", printed(F.col("o")).alias("o"), "g")


@query(
    "triples_from_tables",
    """SELECT 'orders/o_orderkey/' || o_orderkey AS s, 'o_custkey' AS p, 'uri' AS kind, 'customer/c_custkey/' || o_custkey AS o FROM orders
UNION ALL SELECT 'orders/o_orderkey/' || o_orderkey, 'o_orderstatus', 'text', o_orderstatus FROM orders
UNION ALL SELECT 'orders/o_orderkey/' || o_orderkey, 'o_orderpriority', 'text', o_orderpriority FROM orders
UNION ALL SELECT 'customer/c_custkey/' || c_custkey, 'c_nationkey', 'uri', 'nation/n_nationkey/' || c_nationkey FROM customer
UNION ALL SELECT 'customer/c_custkey/' || c_custkey, 'c_mktsegment', 'text', c_mktsegment FROM customer""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = table_triples(table(spark, d, "orders"), "orders", ["o_orderkey"], {"o_custkey": ("customer", "c_custkey")}, ["o_custkey", "o_orderstatus", "o_orderpriority"])
    customers = table_triples(table(spark, d, "customer"), "customer", ["c_custkey"], {"c_nationkey": ("nation", "n_nationkey")}, ["c_nationkey", "c_mktsegment"])
    return D.concat(orders, customers).select("s", "p", F.col("o.kind").alias("kind"), F.col("o.value").alias("o"))


@query("nquads_written_and_read", f"WITH {_DEC} SELECT p, kind, g, count(*) AS n, count(DISTINCT s) AS n_subjects, CAST(sum(length(v)) AS BIGINT) AS n_chars FROM dq GROUP BY ALL")
def _(spark, d):
    path = f"{shared_dir(spark)}/nquads-{uuid.uuid4().hex}"
    rdf.write_quads(D.decoded_quads(spark, d), path, "nq", "gzip")
    back = cut(rdf.read_quads(spark, path, "nq"), "read-back")
    delete(spark, path)
    return back.groupBy("p", F.col("o.kind").alias("kind"), "g").agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_subjects"), F.sum(F.length("o.value")).alias("n_chars"))


@query("decoded_quads", f"WITH {_DEC} SELECT s, p, o, g, count(*) AS n FROM dq GROUP BY ALL")
def _(spark, d):
    return _show(D.decoded_quads(spark, d)).groupBy("s", "p", "o", "g").agg(F.count("*").alias("n"))


@query("quads_union", "SELECT g, count(*) AS n FROM (SELECT g FROM quads UNION ALL SELECT g FROM quads WHERE g = 900) GROUP BY g")
def _(spark, d):
    q = table(spark, d, "quads").select("s", "p", "o", "g")
    return D.concat(q, q.where("g = 900")).groupBy("g").agg(F.count("*").alias("n"))


@query("distinct_quads", "SELECT DISTINCT s, p, o, g FROM quads")
def _(spark, d):
    return table(spark, d, "quads").select("s", "p", "o", "g").distinct()


@query("filter_quads_regex", f"WITH {_DEC} SELECT s, p, o, g FROM dq WHERE p = '{ONT}locatedAt' AND regexp_matches(s, '.*_1[0-9]+') OR kind = 'boolean' AND v = 'true'")
def _(spark, d):
    return _show(filter_quads(D.decoded_quads(spark, d), [QuadMatcher(predicate=f"<{ONT}locatedAt>", subject=".*_1[0-9]+.*"), QuadMatcher(object="true")]))


@query("numeric_filter_range", f"WITH {_DEC} SELECT s, p, o, g FROM dq WHERE kind = 'number' AND num >= 1800 AND num < 1900")
def _(spark, d):
    return _show(filter_quads(D.decoded_quads(spark, d), [QuadMatcher(object="[1800 ; 1900)")]))


@query(
    "map_quads_replace",
    f"""WITH {_DEC} SELECT CASE WHEN p LIKE '{ONT}has%' AND s LIKE '%/res/%' THEN replace(s, '/res/', '/thing/') ELSE s END AS s,
CASE WHEN p LIKE '{ONT}has%' AND s LIKE '%/res/%' THEN replace(p, '{ONT}has', 'http://new.example/') ELSE p END AS p, o, g FROM dq""",
)
def _(spark, d):
    m = QuadMatcher(subject="(.*)/res/(.*)", predicate=f"{ONT}has(.*)")
    return _show(map_quads(D.decoded_quads(spark, d), m, subject="$s1/thing/$2", predicate="<http://new.example/$1>"))


@query("map_quads_arithmetic", f"WITH {_DEC} SELECT p, count(*) AS n, round(sum(CASE WHEN abs(num) < 1e300 THEN (num + 1) * 2 / 4 - 3 END), 4) AS total FROM dq WHERE kind = 'number' AND NOT isnan(num) GROUP BY p")
def _(spark, d):
    q = map_quads(D.decoded_quads(spark, d).where("o.kind = 'number' and not isnan(o.num)"), QuadMatcher(), object="($o0 + 1) * 2 / 4 - 3")
    return q.groupBy("p").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.abs("o.num") < 1e300, F.col("o.num"))), 4).alias("total"))


@query("prefix_split", f"WITH {_DEC} SELECT coalesce(x.prefix || ':' || substr(p, length(x.ns) + 1), p) AS p_display, count(*) AS n FROM dq LEFT JOIN prefixes x ON starts_with(p, x.ns) GROUP BY ALL")
def _(spark, d):
    return D.with_prefixes(D.decoded_quads(spark, d), table(spark, d, "prefixes"), ["p"]).groupBy("p_display").agg(F.count("*").alias("n"))


@query("used_prefixes", f"WITH {_DEC} SELECT prefix, ns FROM prefixes x WHERE EXISTS (SELECT 1 FROM dq WHERE starts_with(s, x.ns) OR starts_with(p, x.ns) OR kind = 'uri' AND starts_with(v, x.ns))")
def _(spark, d):
    return D.used_prefixes(D.decoded_quads(spark, d), table(spark, d, "prefixes")).select("prefix", "ns")


@query("histogram_p", "SELECT p, count(*) AS n FROM quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL GROUP BY p")
def _(spark, d):
    return D.histogram(complete_quads(spark, d), "p")


@query("histogram_po", "SELECT p, o, count(*) AS n FROM quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL GROUP BY p, o")
def _(spark, d):
    return D.histogram(complete_quads(spark, d), "p", "o")


@query(
    "property_types",
    f"""WITH {_DEC} SELECT p, count(*) FILTER (kind IN ('uri', 'bnode')) AS resources, count(*) FILTER (kind = 'text') AS texts, count(*) FILTER (kind = 'number') AS numbers,
count(*) FILTER (kind = 'boolean') AS booleans, count(*) FILTER (kind = 'interval') AS intervals, count(*) AS total FROM dq GROUP BY p""",
)
def _(spark, d):
    return D.properties(D.decoded_quads(spark, d))


_ORD = "ORDER BY s NULLS FIRST, p NULLS FIRST, o NULLS FIRST, g NULLS FIRST, loaded_at, batch_day"


@query("shrink_slice", f"SELECT s, p, o, g FROM quads {_ORD} LIMIT 900 OFFSET 100")
def _(spark, d):
    return D.slice_rows(table(spark, d, "quads"), 100, 1000, [F.col(c) for c in ("s", "p", "o", "g", "loaded_at", "batch_day")]).select("s", "p", "o", "g")


@query("shrink_drop", f"SELECT s, p, o, g FROM (SELECT *, row_number() OVER ({_ORD}) AS n FROM quads) WHERE n > 1000")
def _(spark, d):
    return D.drop(table(spark, d, "quads"), 1000, [F.col(c) for c in ("s", "p", "o", "g", "loaded_at", "batch_day")]).select("s", "p", "o", "g")


@query("distinct_by_subject", "SELECT s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, o) AS n FROM quads WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL) WHERE n = 1")
def _(spark, d):
    return D.distinct_by(complete_quads(spark, d), ["s"], [F.col("p"), F.col("o")])


@query(
    "split_shuffle",
    f"""WITH {FACTS_SQL}, t AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY s, o) AS turn, count(*) OVER () AS total FROM facts), i AS (SELECT p, total, row_number() OVER (ORDER BY turn, p) - 1 AS ix FROM t)
SELECT p, CAST(CASE WHEN ix < round(0.8 * total) THEN 0 WHEN ix < round(0.9 * total) THEN 1 ELSE 2 END AS INT) AS part, count(*) AS n FROM i GROUP BY ALL""",
)
def _(spark, d):
    parts = D.split(facts(spark, d), (0.8, 0.1, 0.1))
    return D.concat(*[x.groupBy("p").agg(F.count("*").alias("n")).withColumn("part", F.lit(i)) for i, x in enumerate(parts)])


@query("bootstrap", f"WITH {FACTS_SQL}, n AS (SELECT p, count(*) AS n FROM facts GROUP BY p) SELECT part, p, CAST(round(n * ratio) AS BIGINT) AS n FROM n, (VALUES (0, 0.5), (1, 1.25)) AS r(part, ratio) WHERE round(n * ratio) > 0")
def _(spark, d):
    parts = D.bootstrap(facts(spark, d), (0.5, 1.25))
    return D.concat(*[x.groupBy("p").agg(F.count("*").alias("n")).withColumn("part", F.lit(i)) for i, x in enumerate(parts)])


@query("grouped_by", f"WITH {FACTS_SQL} SELECT s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s, o) AS r FROM facts) WHERE r <= 3")
def _(spark, d):
    return D.grouped_by(facts(spark, d), ["p"], 3, [F.col("s"), F.col("o")])


@query("graph_sizes", f"WITH {_DEC} SELECT g, count(*) AS n FROM dq GROUP BY g")
def _(spark, d):
    return D.graph_names(D.decoded_quads(spark, d))


_CARD = """card AS (SELECT p, count(*) AS size, count(DISTINCT s) AS domain, count(DISTINCT o) AS range FROM facts GROUP BY p),
side AS (SELECT *, CASE WHEN domain >= range THEN 'object' ELSE 'subject' END AS lower_side, CASE WHEN domain >= range THEN 'subject' ELSE 'object' END AS higher_side FROM card)"""


@query(
    "property_cardinalities",
    f"""WITH {FACTS_SQL}, {_CARD} SELECT p, size, domain, range, lower_side, higher_side,
CAST(floor(size / CASE WHEN domain >= range THEN domain ELSE range END + 0.5) AS BIGINT) AS average, size = domain AS is_function, size = range AS is_inverse_function FROM side""",
)
def _(spark, d):
    return C.property_cardinalities(facts(spark, d))


_LOW = "low AS (SELECT f.p, CASE WHEN lower_side = 'subject' THEN s ELSE o END AS v, count(*) AS n FROM facts f JOIN side USING (p) GROUP BY ALL)"


@query(
    "mode_probability",
    f"""WITH {FACTS_SQL}, {_CARD}, {_LOW} SELECT p, v AS mode, n AS mode_count, round(n / size, 6) AS mode_probability
FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, v) AS k FROM low) JOIN card USING (p) WHERE k = 1""",
)
def _(spark, d):
    f = facts(spark, d)
    out = C.mode_probabilities(f, C.property_cardinalities(f))
    return out.withColumn("mode_probability", F.round("mode_probability", 6))


@query(
    "pca_negatives",
    f"""WITH {FACTS_SQL}, {_CARD}, hi AS (SELECT f.p, CASE WHEN higher_side = 'subject' THEN s ELSE o END AS v, any_value(CASE WHEN higher_side = 'subject' THEN range ELSE domain END) AS other, count(*) AS n
FROM facts f JOIN side USING (p) GROUP BY ALL) SELECT p, CAST(sum(other - n) AS BIGINT) AS pca_negatives FROM hi GROUP BY p""",
)
def _(spark, d):
    f = facts(spark, d)
    return C.pca_negatives(f, C.property_cardinalities(f))


for _a in "so":
    for _b in "so":

        @query(
            f"neighbours_{_a}{_b}",
            f"""WITH {FACTS_SQL}, a AS (SELECT p AS p1, {_a} AS t, count(*) AS n1 FROM facts GROUP BY ALL), b AS (SELECT p AS p2, {_b} AS t, count(*) AS n2 FROM facts GROUP BY ALL),
j AS (SELECT p1, p2, sum(n1 * n2) AS n FROM a JOIN b USING (t) GROUP BY ALL), w AS (SELECT p, count(*) AS k FROM facts WHERE {"true" if _a == _b else "s = o"} GROUP BY p)
SELECT * FROM (SELECT p1, p2, CAST(n - CASE WHEN p1 = p2 THEN coalesce(k, 0) ELSE 0 END AS BIGINT) AS n FROM j LEFT JOIN w ON w.p = p1) WHERE n > 0""",
        )
        def _(spark, d, a=_a, b=_b):
            return C.neighbours(facts(spark, d), a, b)


@query(
    "train_test_minus",
    "SELECT DISTINCT s, p, o FROM quads q WHERE g IN (905, 906) AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND NOT EXISTS (SELECT 1 FROM quads t WHERE coalesce(t.g, 0) NOT IN (905, 906) AND t.s = q.s AND t.p = q.p AND t.o = q.o)",
)
def _(spark, d):
    q = complete_quads(spark, d, "g")
    return C.test_minus_train(q.where("g in (905, 906)"), q.where("g is null or g not in (905, 906)"))


@query(
    "same_as_resolved",
    f"""WITH {FACTS_SQL}, m AS (SELECT o AS a, min(s) AS b FROM facts WHERE p = 110 AND s <> o GROUP BY o)
SELECT DISTINCT coalesce(x.b, s) AS s, coalesce(y.b, p) AS p, coalesce(z.b, o) AS o FROM (SELECT * FROM facts WHERE p <> 110)
LEFT JOIN m x ON x.a = s LEFT JOIN m y ON y.a = p LEFT JOIN m z ON z.a = o""",
)
def _(spark, d):
    f = facts(spark, d)
    return C.same_as_resolved(f.where("p <> 110"), f.where("p = 110"))


_NUM = f"{FACTS_SQL}, v AS (SELECT f.p, t.num FROM facts f JOIN tid t ON t.id = f.o WHERE t.kind = 'number' AND isfinite(t.num))"


def _numbers(spark, d):
    numbers = dictionary(spark, d).where("kind = 'number' and num is not null and not isnan(num) and abs(num) < double('infinity')").select(F.col("id").alias("o"), "num")
    return facts(spark, d).join(numbers, "o").select("p", "num")


@query(
    "equidistance_bins",
    f"""WITH {_NUM}, e AS (SELECT p, min(num) AS a, max(num) AS b FROM v GROUP BY p), k AS (SELECT *, unnest(range(1, 6)) AS bin, (b - a) / 5 AS w FROM e),
i AS (SELECT p, CAST(bin AS INT) AS bin, CASE WHEN bin = 1 THEN a ELSE a + w * (bin - 1) END AS lo, CASE WHEN bin = 5 THEN b ELSE a + w * bin END AS hi FROM k)
SELECT p, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, bin < 5 AS hi_open FROM i WHERE lo < hi OR bin = 5""",
)
def _(spark, d):
    return Z.equidistance(_numbers(spark, d), ["p"], 5).select("p", "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "hi_open")


_EF = f"""{_NUM}, c AS (SELECT p, num AS v, count(*) AS n FROM v GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY p ORDER BY v) AS cum, sum(n) OVER (PARTITION BY p) AS total FROM c),
b AS (SELECT p, least(CAST(floor((cum - n / 2) / total * 5) AS INT) + 1, 5) AS bin, min(v) AS lo0, max(v) AS hi0, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL),
i AS (SELECT p, CAST(row_number() OVER w AS INT) AS bin, coalesce((lag(hi0) OVER w + lo0) / 2, lo0) AS lo, coalesce((hi0 + lead(lo0) OVER w) / 2, hi0) AS hi, n, lead(lo0) OVER w IS NOT NULL AS hi_open
FROM b WINDOW w AS (PARTITION BY p ORDER BY lo0))"""


@query("equifrequency_bins", f"WITH {_EF} SELECT p, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n, hi_open FROM i")
def _(spark, d):
    return Z.equifrequency(_numbers(spark, d), ["p"], 5).select("p", "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n", "hi_open")


def _equisize_sql(support: float) -> str:
    """Greedy filling value by value, as a recursion over the values of all predicates at once."""
    return f"""WITH RECURSIVE {_NUM}, c AS (SELECT p, num + 0.0 AS v, count(*) AS n FROM v GROUP BY ALL),
u AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY p ORDER BY v) AS k, greatest(1.0, {support} * sum(n) OVER (PARTITION BY p)) AS least FROM c),
r(p, k, bin, have, least) AS (SELECT p, k, 1, n, least FROM u WHERE k = 1 UNION ALL
  SELECT u.p, u.k, CASE WHEN r.have >= r.least THEN r.bin + 1 ELSE r.bin END, CASE WHEN r.have >= r.least THEN u.n ELSE r.have + u.n END, u.least FROM r JOIN u ON u.p = r.p AND u.k = r.k + 1),
l AS (SELECT p, max(bin) AS bin, arg_max(have, k) >= any_value(least) AS closed FROM r GROUP BY p),
w AS (SELECT u.p, u.v, u.n, CASE WHEN NOT l.closed AND l.bin > 1 THEN least(r.bin, l.bin - 1) ELSE r.bin END AS bin FROM u JOIN r USING (p, k) JOIN l ON l.p = u.p),
b AS (SELECT p, bin, min(v) AS lo0, max(v) AS hi0, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY ALL),
i AS (SELECT p, CAST(row_number() OVER w AS INT) AS bin, coalesce((lag(hi0) OVER w + lo0) / 2, lo0) AS lo, coalesce((hi0 + lead(lo0) OVER w) / 2, hi0) AS hi, n, lead(lo0) OVER w IS NOT NULL AS hi_open
FROM b WINDOW w AS (PARTITION BY p ORDER BY lo0))"""


def _rounded(bins: DataFrame, *more: str) -> DataFrame:
    return bins.select("p", *more, "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n", "hi_open")


@query("equisize_bins", _equisize_sql(0.2) + " SELECT p, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n, hi_open FROM i")
def _(spark, d):
    return _rounded(Z.equisize(_numbers(spark, d), ["p"], 0.2))


@query(
    "equisize_tree_bins",
    _equisize_sql(0.1)
    + """, deep AS (SELECT greatest(0, CAST(ceil(log2(max(bin))) AS INT)) AS d FROM i), lv AS (SELECT unnest(range(1, d + 2)) AS level FROM deep)
SELECT p, CAST(level AS INT) AS level, CAST((bin - 1) // (1 << (level - 1)) + 1 AS INT) AS bin, round(min(lo), 6) AS lo, round(max(hi), 6) AS hi, CAST(sum(n) AS BIGINT) AS n, arg_max(hi_open, hi) AS hi_open FROM i, lv GROUP BY p, level, (bin - 1) // (1 << (level - 1))""",
)
def _(spark, d):
    return _rounded(Z.equisize_tree(_numbers(spark, d), ["p"], 0.1), "level")


@query("interval_replace", f"WITH {_EF} SELECT v.p, i.bin, count(*) AS n FROM v JOIN i ON i.p = v.p AND v.num >= i.lo AND (v.num < i.hi OR NOT i.hi_open AND v.num = i.hi) GROUP BY ALL")
def _(spark, d):
    num = _numbers(spark, d)
    bins = Z.equifrequency(num, ["p"], 5)
    o = F.struct(F.lit("number").alias("kind"), F.col("num").cast("string").alias("value"), F.col("num").alias("num"), *[F.lit(None).cast(t).alias(c) for c, t in (("lo", "double"), ("hi", "double"), ("lo_open", "boolean"), ("hi_open", "boolean"))])
    cut = Z.replace_by_intervals(num.select("p", o.alias("o")), bins)
    return cut.join(F.broadcast(bins.select("p", "bin", F.col("lo").alias("_lo"))), "p").where(F.col("o.lo") == F.col("_lo")).groupBy("p", "bin").agg(F.count("*").alias("n"))
