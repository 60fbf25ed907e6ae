"""Rules of up to three atoms, their pairs and measures in SQL, listed pair by pair."""

from __future__ import annotations

from lodeweave.queries.common import FACTS_SQL

LEN2 = """SELECT h.p AS hp, '?0 ' || h.p || ' ?1;?0 ' || b.p || ' ?1;' AS canon, count(*) AS support FROM facts h JOIN facts b ON h.s = b.s AND h.o = b.o AND h.p <> b.p {w} GROUP BY ALL"""
INV2 = """SELECT h.p AS hp, '?0 ' || h.p || ' ?1;?1 ' || b.p || ' ?0;' AS canon, count(*) AS support FROM facts h JOIN facts b ON h.s = b.o AND h.o = b.s {w} GROUP BY ALL"""


def three(injective: bool) -> str:
    """All closed rules of up to three atoms in SQL: one select for each shape."""
    w = "AND h.s <> h.o" if injective else ""
    out = [LEN2.format(w=w), INV2.format(w=w)]
    at = {"0": "h.s", "1": "h.o"}
    for a in ("01", "10"):
        for b in ("01", "10"):
            if a > b:
                continue
            cond = "AND b1.p < b2.p" if a == b else ""
            head = "AND b1.p <> h.p" if a == "01" else ""
            head += " AND b2.p <> h.p" if b == "01" else ""
            on = lambda n, x: f"{n}.s = {at[x[0]]} AND {n}.o = {at[x[1]]}"
            f = lambda n, x: f"'?{x[0]} ' || {n}.p || ' ?{x[1]};'"
            canon = f"least({f('b1', a)} || {f('b2', b)}, {f('b2', b)} || {f('b1', a)})"
            out.append(f"SELECT h.p AS hp, '?0 ' || h.p || ' ?1;' || {canon} AS canon, count(DISTINCT (h.s, h.o)) AS support FROM facts h JOIN facts b1 ON {on('b1', a)} JOIN facts b2 ON {on('b2', b)} WHERE true {cond} {head} {w} GROUP BY ALL")
    for a in ("02", "20"):
        for b in ("21", "12"):
            c1, c2 = ("b1.o", "b2.s") if (a, b) == ("02", "21") else ("b1.o", "b2.o") if a == "02" else ("b1.s", "b2.s") if b == "21" else ("b1.s", "b2.o")
            e1, e2 = ("b1.s" if a == "02" else "b1.o"), ("b2.o" if b == "21" else "b2.s")
            inj = f"AND h.s <> h.o AND {c1} <> h.s AND {c1} <> h.o" if injective else ""
            f1, f2 = f"'?{a[0]} ' || b1.p || ' ?{a[1]};'", f"'?{b[0]} ' || b2.p || ' ?{b[1]};'"
            canon = f"least({f1} || {f2}, {f2} || {f1})"
            out.append(f"SELECT h.p AS hp, '?0 ' || h.p || ' ?1;' || {canon} AS canon, count(DISTINCT (h.s, h.o)) AS support FROM facts h JOIN facts b1 ON {e1} = h.s JOIN facts b2 ON {c2} = {c1} AND {e2} = h.o WHERE true {inj} GROUP BY ALL")
    return " UNION ALL ".join(f"({x})" for x in out)


def _bodies(distinct: bool, injective: bool = False) -> str:
    """(``bid``, ``a``, ``b``): values of the head's variables that each body of ``bods`` joins, distinct or one row for each instance."""
    col = lambda n, atom, x: f"f{n}.{'s' if atom[0] == x else 'o'}"
    out = []
    for first in ("01", "10"):
        inj = "AND f1.s <> f1.o" if injective else ""
        out.append(f"SELECT bid, {col(1, first, '0')} AS a, {col(1, first, '1')} AS b FROM bods JOIN facts f1 ON f1.p = p1 WHERE x1 = '{first}' AND x2 = '' {inj}")
    ends = {"0": ("02", "20"), "1": ("12", "21")}
    pairs = [(x, y) for x in ("01", "10") for y in ("01", "10")] + [(x, y) for i, j in (("0", "1"), ("1", "0")) for x in ends[i] for y in ends[j]]
    for x, y in pairs:
        where = lambda v: col(1, x, v) if v in x else col(2, y, v)  # noqa: E731, B023
        shared = " AND ".join(f"{col(1, x, v)} = {col(2, y, v)}" for v in "012" if v in x and v in y)
        inj = f"AND {where('0')} <> {where('1')}" + (f" AND {where('2')} <> {where('0')} AND {where('2')} <> {where('1')}" if "2" in x else "") if injective else ""
        out.append(f"SELECT {'DISTINCT' if distinct else ''} bid, {where('0')} AS a, {where('1')} AS b FROM bods JOIN facts f1 ON f1.p = p1 JOIN facts f2 ON f2.p = p2 AND {shared} WHERE x1 = '{x}' AND x2 = '{y}' {inj}")
    return " UNION ALL ".join(f"({x})" for x in out)


def rules(min_head: int, coverage: float) -> str:
    """q: the rules (number, canonical text, head predicate, support, head size and coverage, body number)."""
    part = lambda i, j: f"split_part(split_part(canon, ';', {i}), ' ', {j})"
    items = lambda i: f"CASE WHEN {part(i, 2)} = '' THEN '' ELSE substr({part(i, 1)}, 2) || substr({part(i, 3)}, 2) END"
    return f"""WITH {FACTS_SQL}, z AS (SELECT p, count(*) AS n FROM facts GROUP BY p HAVING count(*) >= {min_head}),
r AS ({three(False)}),
q0 AS (SELECT canon, any_value(hp) AS hp, any_value(support) AS support FROM r GROUP BY canon),
q AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY canon) AS INT) AS id, canon, hp, support, n AS head_size, support / n AS hc, CAST(dense_rank() OVER (ORDER BY substr(canon, strpos(canon, ';') + 1)) AS INT) AS bid,
  {items(2)} AS x1, TRY_CAST({part(2, 2)} AS BIGINT) AS p1, {items(3)} AS x2, TRY_CAST({part(3, 2)} AS BIGINT) AS p2
  FROM q0 JOIN z ON z.p = hp WHERE support >= greatest(1, ceil(round(n * {coverage}, 6)))),
bods AS MATERIALIZED (SELECT DISTINCT bid, x1, p1, x2, p2 FROM q)"""


def measured(min_head: int, coverage: float) -> str:
    """``rules``, the pairs of each body, and rt: the rules with body sizes and confidences."""
    return f"""{rules(min_head, coverage)},
bp AS MATERIALIZED ({_bodies(True)}),
card AS (SELECT p, count(*) AS size, count(DISTINCT s) AS dom, count(DISTINCT o) AS ran FROM facts GROUP BY p),
side AS (SELECT *, dom >= ran AS by_s, floor(size / (CASE WHEN dom >= ran THEN dom ELSE ran END) + 0.5) AS av FROM card),
c AS (SELECT f.p, CASE WHEN by_s THEN s ELSE o END AS v, count(*) AS c FROM facts f JOIN side ON side.p = f.p GROUP BY ALL),
k AS (SELECT id, hp, any_value(av) AS av, CASE WHEN by_s THEN a ELSE b END AS v, count(*) AS n, count(f.p) AS pos FROM bp JOIN q USING (bid) JOIN side ON side.p = hp LEFT JOIN facts f ON f.p = hp AND f.s = a AND f.o = b GROUP BY id, hp, CASE WHEN by_s THEN a ELSE b END),
m AS (SELECT id, sum(n)::BIGINT AS body_size, sum(CASE WHEN c IS NOT NULL THEN n ELSE 0 END)::BIGINT AS pca_body_size,
  sum(pos + greatest(0, n - pos - greatest(0, av - coalesce(c, 0))))::BIGINT AS qpca_body_size FROM k LEFT JOIN c ON c.p = hp AND c.v = k.v GROUP BY id),
rt AS MATERIALIZED (SELECT *, support / body_size AS cwa, CASE WHEN pca_body_size > 0 THEN support / pca_body_size END AS pca, CASE WHEN qpca_body_size > 0 THEN support / qpca_body_size END AS qpca FROM q JOIN m USING (id))"""


#: How a predicted triple (hp, a, b) of x is classified.
RESULT = "CASE WHEN f.p IS NOT NULL THEN 'Positive' WHEN c.c IS NULL THEN 'PcaPositive' ELSE 'Negative' END"
KNOWN = "JOIN side ON side.p = x.hp LEFT JOIN facts f ON f.p = x.hp AND f.s = x.a AND f.o = x.b LEFT JOIN c ON c.p = x.hp AND c.v = CASE WHEN by_s THEN x.a ELSE x.b END"


def instances(injective: bool) -> str:
    """``inst``: every instance of every body with its rule, those whose head is one of its body atoms left out if injective."""
    return f"inst AS (SELECT id, hp, a, b FROM ({_bodies(False, injective)}) JOIN q USING (bid))"


def with_object_constants(min_head: int, coverage: float) -> str:
    """q: the rules of up to three atoms whose objects may be constants (canonical text, head predicate, support, head coverage, and the
    texts of the rules that lack one of two body atoms)."""
    out = []
    for head in ("01", "0C"):
        atoms = [x + y for x in "012" for y in "012C" if x != y and not (head == "0C" and "2" in x + y)]
        for body in [(a,) for a in atoms] + [(a, b) for i, a in enumerate(atoms) for b in atoms[i:]]:
            items = [x for a in (head, *body) for x in a if x != "C"]
            linked = set(head) - {"C"}
            for _ in body:
                linked |= {x for a in body if set(a) & linked for x in a if x != "C"}
            if any(items.count(x) < 2 for x in items) or not all(set(a) & linked for a in body):
                continue
            at: dict[str, str] = {}
            joins, text, keys = [], [], []
            for j, a in enumerate((head, *body)):
                on = []
                for x, c in zip(a, "so"):
                    if x != "C" and at.setdefault(x, f"f{j}.{c}") != f"f{j}.{c}":
                        on.append(f"f{j}.{c} = {at[x]}")
                for i, b in enumerate((head, *body)[:j]):
                    if a == b:
                        differ = f"f{i}.p <> f{j}.p" if "C" not in a else f"(f{i}.p <> f{j}.p OR f{i}.o <> f{j}.o)"
                        on.append(differ)
                joins.append(f"facts f{j}" + (f" ON {' AND '.join(on)}" if j else ""))
                item = lambda x, j=j: f"'#' || f{j}.o" if x == "C" else f"'?{x}'"
                text.append(f"({item(a[0])} || ' ' || f{j}.p || ' ' || {item(a[1])} || ';')")
                keys += [f"f{j}.p"] + ([f"f{j}.o"] if "C" in a else [])
            n = "f0.s" if head == "0C" else "(f0.s, f0.o)"
            canon = f"{text[0]} || {text[1]}" if len(body) == 1 else f"{text[0]} || least({text[1]} || {text[2]}, {text[2]} || {text[1]})"
            parents = f"{text[0]} || {text[1]} AS a, {text[0]} || {text[2]} AS b" if len(body) == 2 else "NULL AS a, NULL AS b"
            group = ", ".join(dict.fromkeys(keys))
            out.append(f"(SELECT f0.p AS hp, {canon} AS canon, {parents}, count(DISTINCT {n}) AS support FROM {' JOIN '.join(joins)} GROUP BY {group} HAVING count(DISTINCT {n}) >= {max(1, int(min_head * coverage))})")
    return f"""WITH {FACTS_SQL}, z AS (SELECT p, count(*) AS n FROM facts GROUP BY p HAVING count(*) >= {min_head}),
r AS ({" UNION ALL ".join(out)}),
q AS MATERIALIZED (SELECT canon, any_value(a) AS a, any_value(b) AS b, any_value(support) AS support, any_value(support / n) AS hc FROM r JOIN z ON z.p = hp WHERE support >= greatest(1, ceil(round(n * {coverage}, 6))) GROUP BY canon),
e AS MATERIALIZED (SELECT q.canon, q.hc, x.canon AS parent, x.hc AS parent_hc FROM q JOIN q x ON x.canon IN (q.a, q.b))"""
