"""Problem 7: packing texts into containers of fixed capacity by minimum bin slack."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.plans.lineage import cut
from lodeweave.session import table

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match of the pattern goes from a non-space to a space, so that the pieces between count on their own.
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_KNOWN_PIECES = 200_000
_BUCKET_ROWS = 100_000


class TokenCounter:
    """Number of tokens of a text under a byte-level vocabulary; pieces seen before are looked up."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for piece in _PIECE.findall(text):
            n = known.get(piece)
            if n is None:
                n = len(self.encode(piece))
                if len(known) >= _KNOWN_PIECES:
                    known.clear()
                known[piece] = n
            total += n
        return total


@lru_cache(maxsize=2)
def _counter(vocabulary: str) -> TokenCounter:
    return TokenCounter(vocabulary)


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``doc_id``, ``n_tokens``) of whole texts; a null or empty text has 0 tokens."""

    def count(batches) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_tokens long")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The items (length to number) that fill ``room`` best: subset sums as bits of one integer, one step
    for each item; the first combination without slack ends the search. ``lengths`` are descending."""
    full = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            grown = (sums | sums << length) & full
            if grown == sums:
                break
            steps.append((length, sums))
            sums = grown
            if sums >> room:
                break
        if sums >> room:
            break
    at, used = sums.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + 1
            at -= length
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Containers as (number of equal ones, {length: items in each}).

    Each container starts with the longest item left and takes the combination of the others that leaves
    the least room. A combination is removed as often as the counts allow, so that the work depends on
    the number of different lengths, at most ``capacity``, and not on the number of items.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = fullest(sorted((k for k, n in rest.items() if n), reverse=True), rest, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        out.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _slots(bins: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the rank at which each run of containers begins, its first container, and items in each."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 1
    for times, used in bins:
        for length, n in used.items():
            slots.setdefault(length, []).append((taken.get(length, 0), first, n))
            taken[length] = taken.get(length, 0) + n * times
        first += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in slots.items()}


def pack(items: DataFrame, capacity: int = CAPACITY, bucket_rows: int = _BUCKET_ROWS) -> DataFrame:
    """(``doc_id``, ``piece``, ``n_tokens``, ``container_id``): which items lie in which container.

    ``items`` has ``doc_id`` and ``n_tokens``. An item longer than ``capacity`` is split into full pieces and
    the rest; no other is. The counts of each length, at most ``capacity`` of them, go to the driver, where
    minimum bin slack finds the containers; items take their places by rank among those of equal length.
    Ranks come from counts of hash buckets and the order within a bucket, so that no task holds all items
    of a length. Items without tokens are spread over the containers (one container if all are such).
    Null lengths count as 0; a null ``doc_id`` is an item; repeated rows are items of their own; extra
    columns are ignored; no items give no rows.
    """
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0))
    rest = F.pmod("n", F.lit(capacity))
    pieces = F.when(F.col("n") <= capacity, F.array("n")).otherwise(
        F.concat(F.array_repeat(F.lit(capacity).cast("long"), F.floor(F.col("n") / capacity).cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    )
    cutup = items.select("doc_id", n.cast("long").alias("n")).select("doc_id", F.posexplode(pieces).alias("piece", "n_tokens"))
    sized = cut(cutup, "sized")
    buckets = max(1, -(-sized.count() // bucket_rows))
    sized = sized.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    per = sized.groupBy("n_tokens", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("n_tokens").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per.select("n_tokens", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    counts = {r["n_tokens"]: r["n"] for r in per.groupBy("n_tokens").agg(F.sum("_n").alias("n")).collect()}
    bins = minimum_bin_slack({k: v for k, v in counts.items() if k > 0}, capacity)
    total = max(1, sum(times for times, _ in bins))
    slots = _slots(bins)
    rank = F.row_number().over(Window.partitionBy("n_tokens", "_b").orderBy("doc_id", "piece")) - 1
    ranked = sized.withColumn("_r", rank).join(offsets, ["n_tokens", "_b"]).select("doc_id", "piece", "n_tokens", (F.col("_r") + F.col("_before")).alias("rank"))

    def place(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, ranks = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            where = 1 + ranks % total  # of items without tokens
            for length in np.unique(size):
                if length:
                    own = np.flatnonzero(size == length)
                    begin, first, each = slots[int(length)]
                    at = np.searchsorted(begin, ranks[own], "right") - 1
                    where[own] = first[at] + (ranks[own] - begin[at]) // each[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(where, pa.int64())], ["doc_id", "piece", "n_tokens", "container_id"])

    return ranked.mapInArrow(place, "doc_id long, piece int, n_tokens long, container_id long")


def p7_containers(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every post, or piece of a post, and its container."""
    return pack(token_counts(table(spark, sf_dir, "documents"), vocabulary))


def p7_fill(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Number of containers by tokens of room left in them."""
    fill = p7_containers(spark, sf_dir, vocabulary).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return fill.groupBy((F.lit(CAPACITY) - F.col("used")).alias("room_left")).agg(F.count("*").alias("n_containers"))


def p7_totals(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """What must hold of any filling: every post once, no container above its capacity, no post split that would have fitted, and how many
    containers more there are than the tokens need at least."""
    rows = cut(p7_containers(spark, sf_dir, vocabulary), "containers")
    fill = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    posts = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.count("*").alias("pieces"))
    a = fill.agg(F.count_if(F.col("used") > CAPACITY).alias("n_overfull"), (F.count("*") - F.ceil(F.sum("used") / CAPACITY)).alias("n_beyond_least"))
    b = posts.agg(F.count("*").alias("n_posts"), F.count_if((F.col("size") <= CAPACITY) & (F.col("pieces") > 1)).alias("n_split_needlessly"))
    return a.crossJoin(b).select(*[F.col(c).cast("long").alias(c) for c in ("n_posts", "n_overfull", "n_split_needlessly", "n_beyond_least")])  # one row each


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill, "p7_totals": p7_totals}
ORACLE = {"p7_totals": "SELECT count(*) AS n_posts, 0::BIGINT AS n_overfull, 0::BIGINT AS n_split_needlessly, 0::BIGINT AS n_beyond_least FROM documents"}
