"""Problem 8: passages of evaluation items inside documents, by a stored positional inverted index."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.text import plain_words
from lodeweave.plans.lineage import cut
from lodeweave.plans.sizing import broadcast_if_small
from lodeweave.session import table

RUN_WORDS = 5
COVERED = 0.5
SHARED_BY = 5
ITEMS_PER_BLOCK = 5_000
SHARD_TOKENS = 1_000_000
#: Places left empty between two texts of a shard, so that no phrase reaches from one into the other.
_GAP = 16
_SENTENCE = re.compile(r"\s*([^.!?]+[.!?])\s")
_INDEX = "shard long, term string, positions binary, doc_ids binary, starts binary"
_ROWS = 20_000


def build_index(documents: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(``shard``, ``term``, ``positions``): for each shard of documents the sorted positions (32-bit integers) of every word in it, and one row
    without term that has the shard's ``doc_ids`` (64 bits) and the position at which each begins.

    A shard takes documents of one task, whole texts, until it has ``shard_tokens`` words; a longer text is a shard
    of its own. Documents aren't shuffled. The table is written: a shard's number is that of the task that made it. Null ids and texts without words have no place in the index.
    """

    def build(batches) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        tokens: list[np.ndarray] = []
        size = 0
        vocabulary: defaultdict[str, int] = defaultdict()
        vocabulary.default_factory = vocabulary.__len__

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = plain_words(text.as_py())
                if doc is None or not words:
                    continue
                ids.append(doc)
                tokens.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                size += len(words) + _GAP
                if size >= shard_tokens:
                    yield from _shard_rows(part + n, ids, tokens, list(vocabulary))
                    ids, tokens, size, n = [], [], 0, n + 1
                    vocabulary.clear()
        if ids:
            yield from _shard_rows(part + n, ids, tokens, list(vocabulary))

    return cut(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, _INDEX), "postings")


def _shard_rows(shard: int, ids: list[int], tokens: list[np.ndarray], words: list[str]) -> Iterator[pa.RecordBatch]:
    lengths = np.array([len(t) for t in tokens], np.int64)
    starts = np.cumsum(lengths + _GAP) - (lengths + _GAP)
    term = np.concatenate(tokens)
    place = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(term))
    order = np.argsort(term, kind="stable")
    positions = place[order].astype("<i4")
    ends = np.cumsum(np.bincount(term, minlength=len(words))) * 4
    head = [pa.array([shard], pa.int64()), pa.array([None], pa.string()), *[pa.array([x], pa.binary()) for x in (None, np.array(ids, "<i8").tobytes(), starts.astype("<i4").tobytes())]]
    names = [c.split()[0] for c in _INDEX.split(", ")]
    yield pa.RecordBatch.from_arrays(head, names)
    for a in range(0, len(words), _ROWS):
        b = min(a + _ROWS, len(words))
        low = int(ends[a - 1]) if a else 0
        offsets = np.concatenate(([0], ends[a:b] - low)).astype(np.int32)
        lists = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(positions[low // 4 : int(ends[b - 1]) // 4])])
        nothing = pa.nulls(b - a, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, shard), pa.int64()), pa.array(words[a:b], pa.string()), lists, nothing, nothing], names)


class Shard:
    """The posting lists that a block of items needs, of one shard. The lists are laid out by position (a position has one word), so that
    whether a list has a position is one look."""

    def __init__(self, doc_ids: np.ndarray, starts: np.ndarray, lists: list[tuple[int, np.ndarray]], n_terms: int):
        self.doc_ids, self.starts = doc_ids, starts
        self.lists: list[np.ndarray] = [np.empty(0, np.int32)] * (n_terms + 1)
        last = int(starts[-1]) if len(starts) else 0
        for term, positions in lists:
            self.lists[term] = positions
            last = max(last, int(positions[-1]))
        self.size = last + 1
        self.term_at = np.zeros(self.size + 2 * _GAP, np.int32)  # shifted by _GAP: looks before the first and after the last position find nothing
        for term, positions in lists:
            self.term_at[positions + _GAP] = term
        self.df = np.array([len(x) for x in self.lists], np.int64)

    def has(self, terms: np.ndarray, positions: np.ndarray, slop: int) -> np.ndarray:
        """Whether each term's list has a position at most ``slop`` away."""
        hit = self.term_at[positions + _GAP] == terms
        for d in range(1, slop + 1):
            hit |= (self.term_at[positions + (_GAP - d)] == terms) | (self.term_at[positions + (_GAP + d)] == terms)
        return hit

    def phrases(self, terms: np.ndarray, slop: int = 0, at_once: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence of the phrases in the rows of ``terms``, all of one length. With ``slop``
        each word may stand that far from its place.

        A phrase starts from the list of its rarest term, moved by its offset, which is intersected with the
        lists of the other terms, moved by theirs, from the rarer to the more frequent.
        """
        size = terms.shape[1]
        df = self.df[terms]
        order = np.argsort(df, axis=1, kind="stable")
        rows = np.flatnonzero(df.min(axis=1, initial=np.iinfo(np.int64).max) > 0)
        lengths = np.take_along_axis(df, order[:, :1], 1)[:, 0]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ends = np.cumsum(lengths[rows])
        done = 0
        while done < len(rows):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + at_once, "right")))
            part = rows[done:upto]
            done = upto
            start = np.concatenate([self.lists[terms[r, order[r, 0]]] for r in part]).astype(np.int64) - np.repeat(order[part, 0], lengths[part])
            every = np.repeat(part, lengths[part])
            for d in range(-slop, slop + 1):
                which, pos = every, start + d
                keep = (pos >= -slop) & (pos + size <= self.size + slop)
                which, pos = which[keep], pos[keep]
                for k in range(1, size):
                    offset = order[which, k]
                    keep = self.has(terms[which, offset], pos + offset, slop)
                    which, pos = which[keep], pos[keep]
                found.append((which, pos))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def text(self, d: int) -> np.ndarray:
        """The terms of text ``d``, 0 where a word is none of the block's."""
        end = self.starts[d + 1] - _GAP if d + 1 < len(self.starts) else self.size
        return self.term_at[int(self.starts[d]) + _GAP : int(end) + _GAP]


def covered_words(passage: np.ndarray, text: np.ndarray, run: int = RUN_WORDS, slop: int = 0) -> int:
    """Words of ``passage`` that stand in ``text`` in stretches of at least ``run`` consecutive words of it; with ``slop`` each
    word at most that far from its place in the stretch."""
    if len(passage) < run or len(text) < (run if not slop else 1):
        return 0
    hit = np.zeros(len(passage), bool)
    if not slop:
        there = {w.tobytes() for w in np.lib.stride_tricks.sliding_window_view(text, run)}
        for i, w in enumerate(np.lib.stride_tricks.sliding_window_view(passage, run)):
            if w.tobytes() in there:
                hit[i : i + run] = True
        return int(hit.sum())
    padded = np.concatenate((np.zeros(run + slop, text.dtype), text, np.zeros(run + slop, text.dtype)))
    near = passage[:, None] == padded[None, :]
    wide = near.copy()
    for d in range(1, slop + 1):
        wide[:, d:] |= near[:, :-d]
        wide[:, :-d] |= near[:, d:]
    starts = wide[: len(passage) - run + 1, : len(padded) - run + 1].copy()
    for k in range(1, run):
        starts &= wide[k : k + starts.shape[0], k : k + starts.shape[1]]
    for i in np.flatnonzero(starts.any(axis=1)):
        hit[i : i + run] = True
    return int(hit.sum())


class Passages:
    """A block of query passages: their terms, and the short phrases any long enough stretch contains."""

    def __init__(self, passages: list[tuple[int, list[str]]], run: int = RUN_WORDS, covered: float = COVERED, slop: int = 0):
        self.run, self.covered, self.slop = run, covered, slop
        self.items = [i for i, w in passages if len(w) >= run]
        words = [w for _, w in passages if len(w) >= run]
        self.ids: dict[str, int] = {}
        self.texts = [np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], np.int32) for w in words]
        # run consecutive words hold a phrase of (run + 1) // 2 words that starts at a multiple of that length.
        size = (run + 1) // 2
        at = [(k, t[j : j + size].tobytes()) for k, t in enumerate(self.texts) for j in range(0, len(t) - size + 1, size)]
        distinct = {b: i for i, b in enumerate(dict.fromkeys(b for _, b in at))}
        self.phrases = np.array([np.frombuffer(b, np.int32) for b in distinct]).reshape(-1, size)
        owner = sorted((distinct[b], k) for k, b in at)
        self.owner_phrase = np.array([p for p, _ in owner], np.int64)
        self.owner_text = np.array([k for _, k in owner], np.int64)
        # A stretch of n words holds at least (n - size + 1) // size phrases, one in 2 * size + run - size - 1 words at worst.
        need = [max(1, -(-int(np.ceil(len(t) * covered)) // (2 * size + 1))) for t in self.texts]
        self.need = np.array(need, np.int64)
        self.left_out = self.need // 2

    def _kept(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Places of owners, and numbers of phrases, that are searched. A text that has ``need`` phrases of a passage has ``need`` -
        ``left_out`` of those that remain without the ``left_out`` with the longest lists."""
        cost = shard.df[self.phrases].min(axis=1)[self.owner_phrase]
        order = np.lexsort((-cost, self.owner_text))
        text = self.owner_text[order]
        nth = np.arange(len(text)) - np.searchsorted(text, text, "left")
        kept = np.zeros(len(order), bool)
        kept[order] = nth >= self.left_out[text]
        return kept, np.unique(self.owner_phrase[kept])

    def search(self, shard: Shard) -> Iterator[tuple[int, int]]:
        """(item, document id) of the texts that hold enough of the item's passage."""
        if not len(self.phrases) or not len(shard.starts):
            return
        kept, phrases = self._kept(shard)
        which, pos = shard.phrases(self.phrases[phrases], self.slop)
        if not len(which):
            return
        text = np.searchsorted(shard.starts, pos + self.slop, "right") - 1  # a stretch may begin before its text by its slop
        both = np.unique(np.stack((phrases[which], text), 1), axis=0)
        owner_phrase, owner_text = self.owner_phrase[kept], self.owner_text[kept]
        lo = np.searchsorted(owner_phrase, both[:, 0], "left")
        n = np.searchsorted(owner_phrase, both[:, 0], "right") - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs, hits = np.unique(np.stack((owner_text[at], np.repeat(both[:, 1], n)), 1), axis=0, return_counts=True)
        least = self.need - self.left_out
        for k, d in pairs[hits >= least[pairs[:, 0]]]:
            passage = self.texts[k]
            if covered_words(passage, shard.text(d), self.run, self.slop) >= self.covered * len(passage):
                yield self.items[k], int(shard.doc_ids[d])


def shared_openings(items: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """First sentences, of any length, that at least ``shared_by`` items have: instructions, not part of a passage."""
    first = items.where("text is not null").select(F.lower(F.regexp_extract("text", "^" + _SENTENCE.pattern, 1)).alias("opening"))
    return first.where("opening <> ''").groupBy("opening").agg(F.count("*").alias("n")).where(F.col("n") >= shared_by).select("opening")


def find_leaks(documents: DataFrame, items: DataFrame, run: int = RUN_WORDS, covered: float = COVERED, shared_by: int = SHARED_BY, block: int = ITEMS_PER_BLOCK, slop: int = 0, index: DataFrame | None = None) -> DataFrame:
    """(``item_id``, ``doc_id``): documents that hold at least the share ``covered`` of the words of an
    item's passage in stretches of at least ``run`` consecutive words; with ``slop`` (at most 3) also where
    each word of a stretch is at most that many words from its place (proximity matches).

    The index is built and stored once, or given (``build_index``); each block of ``block`` items, which bounds what the driver and
    a task hold, then reads the posting lists of its own terms only, and a shard's lists meet in one task. Passages of
    fewer than ``run`` words, and null or empty texts, are never found. Repeated item ids give a row once per document.
    """
    if not 0 <= slop <= 3:
        raise ValueError("slop must lie between 0 and 3")
    spark = documents.sparkSession
    index = index if index is not None else build_index(documents)
    openings = {r["opening"] for r in shared_openings(items, shared_by).collect()}
    asked = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    parts = max(1, -(-asked.count() // block))
    found = []
    for k in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()
        passages = Passages([(r["item_id"], plain_words(_without_opening(r["text"], openings))) for r in rows], run, covered, slop)
        terms = broadcast_if_small(spark.createDataFrame(list(passages.ids.items()), "term string, number int"))
        lists = index.join(terms, "term").select("shard", "number", "positions", "doc_ids", "starts")
        lists = lists.unionByName(index.where("term is null").select("shard", F.lit(0).alias("number"), "positions", "doc_ids", "starts"))
        hits = lists.repartition("shard").sortWithinPartitions("shard", "number").mapInArrow(_searcher(passages), "item_id long, doc_id long")
        found.append(hits if parts == 1 else cut(hits, "leaks"))  # a block's passages are let go before the next
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _without_opening(text: str, openings: set[str]) -> str:
    m = _SENTENCE.match(text)
    return text[m.end() :] if m and m.group(1).lower() in openings else text


def _searcher(passages: Passages):
    def search(batches):
        shard, docs, lists = None, None, []

        def found():
            if docs is None:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["item_id", "doc_id"])
            pairs = sorted(set(passages.search(Shard(*docs, lists, len(passages.ids)))))
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([d for _, d in pairs], pa.int64())], ["item_id", "doc_id"])

        for batch in batches:
            for s, number, positions, doc_ids, starts in zip(*(c if i > 1 else c.to_pylist() for i, c in enumerate(batch.columns))):
                if s != shard:
                    if shard is not None:
                        yield found()
                    shard, docs, lists = s, None, []
                if number == 0:
                    docs = np.frombuffer(doc_ids.as_py(), "<i8"), np.frombuffer(starts.as_py(), "<i4").astype(np.int64)
                else:
                    lists.append((number, np.frombuffer(positions.as_py(), "<i4")))
        if shard is not None:
            yield found()

    return search


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that leak them."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_leaks_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of leaking documents and of boards they stand on, per item."""
    docs = table(spark, sf_dir, "documents")
    where = p8_found(spark, sf_dir).join(docs.select("doc_id", "source"), "doc_id")
    return where.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("source").alias("n_boards"))


def p8_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and documents that hold the passage with words out of place by one: exact matches and others, marked."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    index = build_index(docs)
    exact = find_leaks(docs, items, index=index).distinct().withColumn("exact", F.lit(True))
    near = find_leaks(docs, items, slop=1, index=index).distinct()
    return near.join(exact, ["item_id", "doc_id"], "left").select("item_id", "doc_id", F.coalesce("exact", F.lit(False)).alias("exact"))


QUERIES = {"p8_found": p8_found, "p8_leaks_by_item": p8_leaks_by_item, "p8_proximity": p8_proximity}
ORACLE: dict[str, str] = {}
