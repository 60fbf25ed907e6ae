"""Sizes of unions of value lists, counted without listing the pairs that they make."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.plans.lineage import cut
from lodeweave.plans.sizing import broadcast_if_small

#: Values that a block of lists joined by sorting has at most (one list may have more), and entries of a place from which it is cut into chunks.
BLOCK, CHUNKED, CHUNKS = 2_000_000, 50_000, 6


def entries(facts: DataFrame) -> DataFrame:
    """(``p``, ``k``, ``v``, ``z``): the value at place ``k`` (0 subject, 1 object) of each triple and its partner at the other place."""
    ends = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v"), F.col(z).alias("z")) for k, c, z in ((0, "s", "o"), (1, "o", "s"))])
    return facts.select("p", F.inline(ends))


class Lists:
    """The values of each partner at one place, as numbers below ``n``; long lists also as bits."""

    def __init__(self, z: np.ndarray, v: np.ndarray, values: np.ndarray | None = None):
        values = np.unique(v) if values is None else values
        order = np.argsort(z, kind="stable")
        self.z, at = np.unique(z[order], return_index=True)
        self.of, self.at, self.n = np.searchsorted(values, v[order]), np.append(at, len(z)), len(values)
        self.size = np.diff(self.at)
        self.bits: dict[int, np.ndarray] = {}

    def find(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``z`` have a list, and the lists of those."""
        if not len(self.z):
            return np.zeros(len(z), bool), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.z, z), len(self.z) - 1)
        have = self.z[at] == z
        return have, at[have]

    def joined(self, lists: np.ndarray) -> np.ndarray:
        """The values of ``lists`` one after the other."""
        size = self.size[lists]
        ends = np.cumsum(size)
        return self.of[np.repeat(self.at[lists] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def union(self, lists: np.ndarray) -> np.ndarray:
        """The union of ``lists`` as 64-bit words."""
        out = np.zeros(-(-self.n // 64) * 8, np.uint8)
        long = self.size[lists] * 64 >= self.n
        for i in lists[long]:
            if i not in self.bits:
                self.bits[i] = self._packed(self.of[self.at[i] : self.at[i + 1]])
            out |= self.bits[i]
        if not long.all():
            out |= self._packed(self.joined(lists[~long]))
        return out.view(np.uint64)

    def _packed(self, values: np.ndarray) -> np.ndarray:
        flags = np.zeros(-(-self.n // 64) * 64, bool)
        flags[values] = True
        return np.packbits(flags, bitorder="little")


def blocks(total: np.ndarray) -> Iterator[slice]:
    """Runs of rows whose ``total`` is at most ``BLOCK`` together."""
    ends, i = np.cumsum(total), 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, "right")))
        yield slice(i, j)
        i = j


def sizes_of_unions(lists: Lists, rows: np.ndarray, of: np.ndarray, n_rows: int) -> np.ndarray:
    """For each of ``n_rows`` rows the size of the union of its lists; ``rows`` (rising) and ``of`` name a row and a list."""
    out = np.zeros(n_rows, np.int64)
    count = np.bincount(rows, minlength=n_rows)
    total = np.bincount(rows, lists.size[of], n_rows).astype(np.int64)
    out[count == 1] = total[count == 1]
    first = np.cumsum(count) - count
    heavy = (count > 1) & (total * 16 >= lists.n) & (total > 1000)
    seen: dict[bytes, int] = {}
    for r in np.flatnonzero(heavy):
        own = np.sort(of[first[r] : first[r] + count[r]])
        key = own.tobytes()
        if key not in seen:
            seen[key] = int(np.bitwise_count(lists.union(own)).sum())
        out[r] = seen[key]
    light = np.flatnonzero((count > 1) & ~heavy)
    for part in blocks(total[light]):
        mine = light[part]
        own = of[np.repeat(first[mine] - np.cumsum(count[mine]) + count[mine], count[mine]) + np.arange(count[mine].sum())]
        key = np.sort(np.repeat(np.arange(len(mine)), total[mine]) * lists.n + lists.joined(own))
        key = key[np.append(True, key[1:] != key[:-1])]
        out[mine] = np.bincount(key // lists.n, minlength=len(mine))
    return out


def flattened(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of a list column, and the row of each."""
    size = np.concatenate([c.value_lengths().to_numpy() for c in lists.chunks])
    return np.repeat(np.arange(len(lists)), size), np.concatenate([c.flatten().to_numpy() for c in lists.chunks])


def union_sizes(groups: DataFrame, values: DataFrame, places: DataFrame) -> DataFrame:
    """(``pa``, ``ka``, ``pb``, ``kb``, ``rep``, ``n``): for each group of values of place (``pa``, ``ka``) with equal partners, how many values of place
    (``pb``, ``kb``) share a partner with it.

    ``groups``: ``p``, ``k``, ``rep`` and partners ``zs``. ``values``: ``entries``. ``places``: the pairs of places, which are few. The work of a group is
    one union of lists, not its pairs.
    """
    places = F.broadcast(places)
    outer = groups.select(F.col("p").alias("pa"), F.col("k").alias("ka"), "rep", "zs").join(places.select("pa", "ka").distinct(), ["pa", "ka"], "left_semi")
    met = outer.select("pa", "ka", F.explode("zs").alias("z")).groupBy("pa", "ka", "z").agg(F.lit(True).alias("_met")).drop("_met").join(places, ["pa", "ka"])
    inner = met.join(values.select(F.col("p").alias("pb"), F.col("k").alias("kb"), "z", "v"), ["pb", "kb", "z"])
    many = broadcast_if_small(cut(outer.groupBy("pa", "ka").agg(F.when(F.sum(F.size("zs")) > CHUNKED, CHUNKS).otherwise(1).alias("_chunks")), "chunks"))
    left = outer.join(many, ["pa", "ka"]).withColumn("_chunk", F.expr("pmod(hash(rep), _chunks)")).drop("_chunks")
    right = inner.join(many, ["pa", "ka"]).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
    schema = pa.schema([(c, pa.int32() if c[0] == "k" else pa.int64()) for c in ("pa", "ka", "pb", "kb", "rep", "n")])

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [np.empty((0, 6), np.int64)]
        if len(a) and len(b):
            rows, z = flattened(a["zs"])
            rep, at = a["rep"].to_numpy(), [a["pa"][0].as_py(), a["ka"][0].as_py()]
            place, bz, bv = b["pb"].to_numpy() * 2 + b["kb"].to_numpy(), b["z"].to_numpy(), b["v"].to_numpy()
            for x in np.unique(place):
                own = place == x
                lists = Lists(bz[own], bv[own])
                have, of = lists.find(z)
                n = sizes_of_unions(lists, rows[have], of, len(a))
                there = np.flatnonzero(n)
                fixed = np.tile([*at, x // 2, x % 2], (len(there), 1))
                out.append(np.column_stack([fixed, rep[there], n[there]]))
        found = np.concatenate(out)
        return pa.table({c: found[:, i] for i, c in enumerate(("pa", "ka", "pb", "kb", "rep", "n"))}).cast(schema)

    key = ["pa", "ka", "_chunk"]
    right = right.select(*[F.col(c).alias(f"_of{c}") for c in key], "pb", "kb", "z", "v")  # both sides come from the same tables
    return left.groupBy(key).cogroup(right.groupBy(*[f"_of{c}" for c in key])).applyInArrow(count, "pa long, ka int, pb long, kb int, rep long, n long")
