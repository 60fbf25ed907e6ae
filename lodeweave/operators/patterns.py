"""Patterns on rules as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BODY = 4


@dataclass(frozen=True)
class Item:
    """``kind``: any, any_variable, any_constant, variable (name), constant (id), one_of, none_of (ids)."""

    kind: str = "any"
    value: object = None


ANY = Item()


@dataclass(frozen=True)
class AtomPattern:
    s: Item = ANY
    p: Item = ANY
    o: Item = ANY
    g: Item = ANY


@dataclass(frozen=True)
class RulePattern:
    """A list of body atom patterns and perhaps a head pattern. ``exact``: as many atoms as patterns. Unless
    ``orderless``, patterns are aligned from the last body atom."""

    body: tuple[AtomPattern, ...] = ()
    head: AtomPattern | None = None
    exact: bool = False
    orderless: bool = True


def _constant(pattern: Item, const: Column) -> Column:
    ids = [pattern.value] if pattern.kind == "constant" else list(pattern.value)
    return ~const.isin(ids) if pattern.kind == "none_of" else const.isin(ids)


def _item(pattern: Item, item: Column) -> Column:
    if pattern.kind == "any":
        return F.lit(True)
    if pattern.kind in ("any_variable", "variable"):
        return item["is_var"]
    if pattern.kind == "any_constant":
        return ~item["is_var"]
    return ~item["is_var"] & _constant(pattern, item["const"])


def _predicate(pattern: Item, p: Column) -> Column:
    return _constant(pattern, p) if pattern.kind in ("constant", "one_of", "none_of") else F.lit(pattern.kind not in ("variable", "any_variable"))


def _graph(pattern: Item, atom: Column, graphs: bool) -> Column:
    if pattern.kind == "any" or not graphs:
        return F.lit(True)
    ids = F.array(*[F.lit(x).cast("bigint") for x in ([pattern.value] if pattern.kind == "constant" else pattern.value)])
    overlap = F.arrays_overlap(atom["graphs"], ids)
    return ~overlap if pattern.kind == "none_of" else overlap


def _atom(pattern: AtomPattern, atom: Column, graphs: bool) -> Column:
    return _item(pattern.s, atom["s"]) & _predicate(pattern.p, atom["p"]) & _item(pattern.o, atom["o"]) & _graph(pattern.g, atom, graphs)


def _aliases(pairs: list[tuple[AtomPattern, Column]]) -> Column:
    """Variables of the pattern and of the rule correspond one to one."""
    named = [(i.value, atom[c]["var"]) for pattern, atom in pairs for i, c in ((pattern.s, "s"), (pattern.o, "o")) if i.kind == "variable"]
    out = F.lit(True)
    for k, (a, x) in enumerate(named):
        for b, y in named[:k]:
            out = out & ((x == y) if a == b else (x != y))
    return out


def _longer(pattern: RulePattern, head: list[tuple[AtomPattern, Column]], graphs: bool) -> Column:
    """Whether the patterns fit a body of any length: nested searches for the place of each."""
    n, size = len(pattern.body), F.size("body")
    at = lambda k: F.get("body", k)
    fits = lambda pairs: reduce(lambda a, b: a & b, [_atom(p, a, graphs) for p, a in pairs], F.lit(True)) & _aliases(pairs)
    if not pattern.orderless:
        return fits(head + [(p, at(size - n + k)) for k, p in enumerate(pattern.body)])

    def place(taken: list[Column]) -> Column:
        if len(taken) == n:
            return fits(head + [(p, at(k)) for p, k in zip(pattern.body, taken)])
        free = lambda k: reduce(lambda a, b: a & b, [k != x for x in taken], F.lit(True))
        return F.exists(F.sequence(F.lit(0), size - 1), lambda k: free(k) & place([*taken, k]))

    return place([])


def matches(pattern: RulePattern, graphs: bool = False) -> Column:
    """Whether a row with ``head`` and ``body`` matches; ``graphs``: atoms have graph sets."""
    n, size = len(pattern.body), F.size("body")
    head = [(pattern.head, F.col("head"))] if pattern.head else []
    options = []
    for length in range(n, MAX_BODY + 1):
        if pattern.exact and length != n:
            continue
        orders = permutations(range(length), n) if pattern.orderless else [tuple(range(length - n, length))]
        for order in orders:
            pairs = head + [(p, F.get("body", F.lit(k))) for p, k in zip(pattern.body, order)]
            options.append((size == length) & reduce(lambda a, b: a & b, [_atom(p, a, graphs) for p, a in pairs], F.lit(True)) & _aliases(pairs))
    if not pattern.exact:
        options.append((size > max(MAX_BODY, n - 1)) & _longer(pattern, head, graphs))
    elif n > MAX_BODY:
        options.append((size == n) & _longer(pattern, head, graphs))
    return F.coalesce(reduce(lambda a, b: a | b, options), F.lit(False))
