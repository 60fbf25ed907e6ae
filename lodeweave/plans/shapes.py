"""Rule shapes: the variable skeletons of rules. One join plan evaluates all rules of a shape, with predicates and
constants as data."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An item of a shape that stands for a constant.
CONST = -1
Atom = tuple[int, int]
Shape = tuple[Atom, ...]

ITEM = "struct<is_var:boolean,var:int,const:bigint>"
ATOM = f"struct<s:{ITEM},p:bigint,o:{ITEM}>"


def renamed(shape: Shape) -> Shape:
    """Variables numbered by first occurrence."""
    names: dict[int, int] = {}
    return tuple(tuple(x if x == CONST else names.setdefault(x, len(names)) for x in atom) for atom in shape)  # type: ignore[misc]


def normal_form(shape: Shape) -> Shape:
    """The smallest renamed shape over all orders of the body."""
    return min(renamed((shape[0], *body)) for body in permutations(shape[1:]))


def is_closed(shape: Shape) -> bool:
    """Whether every variable occurs at least twice."""
    items = [x for atom in shape for x in atom if x != CONST]
    return all(items.count(x) > 1 for x in items)


def closed_shapes(max_length: int, constants: bool = False) -> list[Shape]:
    """All closed, connected shapes of 2 to ``max_length`` atoms, head first; reflexive atoms aside."""
    if max_length < 2:
        raise ValueError("a rule has at least 2 atoms")
    level: set[Shape] = {((0, 1),)} | ({((0, CONST),), ((CONST, 0),)} if constants else set())
    out: set[Shape] = set()
    for left in range(max_length - 2, -1, -1):
        grown: set[Shape] = set()
        for shape in level:
            known = sorted({x for atom in shape for x in atom if x != CONST})
            fresh = len(known)
            ends = [*known, fresh, *([CONST] if constants else [])]
            for x in ends:
                for y in ends:
                    if x != y and (x in known or y in known):
                        new = (*shape, (x, y))
                        items = [i for a in new for i in a if i != CONST]
                        if sum(items.count(i) == 1 for i in set(items)) <= 2 * left:
                            grown.add(normal_form(new))
        out |= {s for s in grown if is_closed(s)}
        level = grown
    return sorted(out, key=lambda s: (len(s), s))


def body_order(shape: Shape, bound: set[int]) -> list[int]:
    """Body atoms in an order in which each shares as many bound variables as possible with those before."""
    left, out = list(range(1, len(shape))), []
    while left:
        score = lambda j: (-sum(x in bound for x in shape[j]), CONST not in shape[j], j)
        j = min(left, key=score)
        out.append(j)
        left.remove(j)
        bound = bound | {x for x in shape[j] if x != CONST}
    return out


def add_atom(df: DataFrame | None, facts: DataFrame, shape: Shape, j: int, injective: bool) -> DataFrame:
    """``df`` joined with the facts of atom ``j``: columns p<j>, v<variable>, k<j> for a constant.

    Where ``df`` has rule columns (_rp<j>, _rk<j>) the atom's predicate and constant are those of the rule.
    """
    items = {"s": shape[j][0], "o": shape[j][1]}
    have = set(df.columns) if df is not None else set()
    ruled = f"_rp{j}" in have
    names, on = {}, [F.col(f"p{j}") == F.col(f"_rp{j}")] if ruled else []
    for c, x in items.items():
        name = f"k{j}" if x == CONST else f"v{x}"
        names[c] = f"_{c}{j}" if name in have else name
        if name in have:
            on.append(F.col(names[c]) == F.col(name))
        elif x == CONST and ruled:
            on.append(F.col(name) == F.col(f"_rk{j}"))
    fresh = [n for n in names.values() if n.startswith("v")]
    if injective:
        on += [F.col(n) != F.col(v) for n in fresh for v in sorted(have) if v.startswith("v")]
    right = facts.select(F.col("p").alias(f"p{j}"), F.col("s").alias(names["s"]), F.col("o").alias(names["o"]))
    if injective and len(fresh) == 2:
        right = right.where(F.col(fresh[0]) != F.col(fresh[1]))
    if df is None:
        return right
    if not any(n.startswith("_") for n in names.values()) and not ruled:
        raise ValueError("atoms of a rule must be connected")
    known = [n for n in names.values() if n.startswith("_")]
    out = df.join(right, on, "inner")
    return out.drop(*known) if known else out


def side(shape: Shape, j: int, k: int) -> Column:
    """The value at place ``k`` (0 subject, 1 object) of atom ``j``."""
    x = shape[j][k]
    return F.col(f"k{j}") if x == CONST else F.col(f"v{x}")


def differs_from_head(shape: Shape, j: int) -> Column:
    """Whether an instance of atom ``j`` isn't the instance of the head."""
    return (F.col(f"p{j}") != F.col("p0")) | (side(shape, j, 0) != side(shape, 0, 0)) | (side(shape, j, 1) != side(shape, 0, 1))


def distinct_atoms(shape: Shape) -> list[Column]:
    """Conditions that no atom is written twice; of atoms with equal items the first has the smaller predicate."""
    out = []
    for i, j in combinations(range(len(shape)), 2):
        if shape[i] == shape[j]:
            a, b = ([F.col(f"p{n}"), *([F.col(f"k{n}")] if CONST in shape[n] else [])] for n in (i, j))
            same = a[0] == b[0] if len(a) == 1 else (a[0] == b[0]) & (a[1] == b[1])
            out.append(~same if i == 0 else F.struct(*[x.alias(f"c{n}") for n, x in enumerate(a)]) < F.struct(*[x.alias(f"c{n}") for n, x in enumerate(b)]))
    return out


def keys(shape: Shape) -> list[str]:
    """Columns that make a rule of the shape: predicates and constants."""
    return [c for j, atom in enumerate(shape) for c in ([f"p{j}", f"k{j}"] if CONST in atom else [f"p{j}"])]


def head_values(shape: Shape) -> list[str]:
    return [f"v{x}" for x in shape[0] if x != CONST]


def _item(shape: Shape, j: int, k: int) -> Column:
    x = shape[j][k]
    return F.struct(F.lit(x != CONST).alias("is_var"), F.lit(None if x == CONST else x).cast("int").alias("var"), (F.col(f"k{j}") if x == CONST else F.lit(None)).cast("bigint").alias("const"))


def _atom(shape: Shape, j: int) -> Column:
    return F.struct(_item(shape, j, 0).alias("s"), F.col(f"p{j}").alias("p"), _item(shape, j, 1).alias("o"))


def rule_columns(shape: Shape) -> list[Column]:
    """``canon``, ``head`` and ``body`` of the rules of a shape from its key columns."""
    body = F.array(*[_atom(shape, j) for j in range(1, len(shape))])
    return [canonical(shape).alias("canon"), _atom(shape, 0).alias("head"), body.cast(f"array<{ATOM}>").alias("body")]


def canonical(shape: Shape) -> Column:
    """A text that equal rules share, whatever the order of the body and the names of variables."""
    forms = []
    for order in permutations(range(1, len(shape))):
        atoms = (0, *order)
        named = renamed(tuple(shape[j] for j in atoms))
        parts: list[Column] = []
        for (x, y), j in zip(named, atoms):
            text = lambda i, j=j: F.concat(F.lit("#"), F.col(f"k{j}").cast("string")) if i == CONST else F.lit(f"?{i}")
            parts += [text(x), F.lit(" "), F.col(f"p{j}").cast("string"), F.lit(" "), text(y), F.lit(";")]
        forms.append(F.concat(*parts))
    return F.least(*forms) if len(forms) > 1 else forms[0]


def shape_text() -> Column:
    """The shape of a row of the rule table, as text."""
    item = lambda c: F.when(c["is_var"], c["var"].cast("string")).otherwise(F.lit(str(CONST)))
    atom = lambda a: F.concat(item(a["s"]), F.lit(","), item(a["o"]))
    return F.concat_ws(";", atom(F.col("head")), F.concat_ws(";", F.transform("body", atom)))


def parse_shape(text: str) -> Shape:
    return tuple(tuple(int(x) for x in atom.split(",")) for atom in text.split(";"))  # type: ignore[misc]


def key_columns(shape: Shape) -> list[Column]:
    """The key columns of a shape from ``head`` and ``body`` of the rule table."""
    out = []
    for j, atom in enumerate(shape):
        a = F.col("head") if j == 0 else F.get("body", F.lit(j - 1))
        out.append(a["p"].alias(f"p{j}"))
        if CONST in atom:
            out.append((a["s"] if atom[0] == CONST else a["o"])["const"].alias(f"k{j}"))
    return out
