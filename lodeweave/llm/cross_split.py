"""Problem 5: lines of evaluation files that a training file also has, the same or with nearly the same subject."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm.fm_index import LineIndex, matched
from lodeweave.llm.names import plain_name, plain_path
from lodeweave.plans.lineage import cut
from lodeweave.plans.sizing import broadcast_if_small
from lodeweave.session import table

EDITS = 2
SHARD_LINES = 8_192
STREAM_LINES = 524_288


def plain_lines(lines: DataFrame) -> DataFrame:
    """(``line_id``, ``path``, ``s``, ``p``, ``o``) in plain form; lines lacking an id, path or name are left out."""

    def plain(batches) -> Iterator[pa.RecordBatch]:
        paths: dict = {}
        names: dict = {}
        for batch in batches:
            ids, path, *spo = (c.to_pylist() for c in batch.columns)
            path = [paths[x] if x in paths else paths.setdefault(x, plain_path(x)) for x in path]
            cols = [[plain_name(x) for x in spo[0]]]
            for col in spo[1:]:
                if len(names) > 100_000:
                    names.clear()
                cols.append([names[x] if x in names else names.setdefault(x, plain_name(x)) for x in col])
            keep = [i for i, row in enumerate(zip(ids, path, *cols)) if row[0] is not None and all(row[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in keep], pa.int64())] + [pa.array([c[i] for i in keep], pa.string()) for c in (path, *cols)], ["line_id", "path", "s", "p", "o"]
            )

    return lines.select(F.col("line_id").cast("long").alias("line_id"), "path", "s", "p", "o").mapInArrow(plain, "line_id long, path string, s string, p string, o string")


def file_pairs(settings: DataFrame) -> DataFrame:
    """Distinct (``eval_path``, ``train_path``) of the settings, in plain form."""

    def plain(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([plain_path(x) for x in c.to_pylist()] for c in batch.columns)
            pairs = [(x, y) for x, y in zip(a, b) if x and y]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.string())], ["eval_path", "train_path"])

    named = settings.select(F.explode(F.array("path_valid", "path_test")).alias("e"), F.col("path_train").alias("t"))
    return named.mapInArrow(plain, "eval_path string, train_path string").distinct()


class Overlaps:
    """Overlaps of evaluation and training lines.

    ``members``: (``file`` hash of the training path, ``rep``, ``line_id``, ``path``) of evaluation lines, where equal lines of one
    training file share ``rep``, their smallest id.
    ``pairs``: (``file``, ``rep_e``, ``line_t``, ``matched``, ``length``), one for each training line and each different evaluation text that
    it matches; ``matched`` of the ``length`` letters of the evaluation subject lie in the maximal matches at its two ends.
    """

    def __init__(self, lines: DataFrame, settings: DataFrame, edits: int = EDITS, shard_lines: int = SHARD_LINES, stream_lines: int = STREAM_LINES):
        self.files = cut(file_pairs(settings), "file-pairs")
        plain = cut(plain_lines(lines), "plain-lines")
        evals = plain.join(broadcast_if_small(self.files), plain["path"] == self.files["eval_path"]).select(F.xxhash64("train_path").alias("file"), "s", "p", "o", "line_id", "path")
        trains = plain.join(broadcast_if_small(self.files.select(F.col("train_path").alias("path")).distinct()), "path", "left_semi")
        trains = trains.select(F.xxhash64("path").alias("file"), "s", "p", "o", "line_id")
        texts = cut(evals.groupBy("file", "s", "p", "o").agg(F.min("line_id").alias("rep"), F.count("*").alias("n")), "texts")
        several = texts.where("n > 1").select("file", "s", "p", "o", "rep")
        self.members = evals.join(several, ["file", "s", "p", "o"], "left").select("file", F.coalesce("rep", "line_id").alias("rep"), "line_id", "path")
        self.pairs = cut(_search(texts, trains, edits, shard_lines, stream_lines), "matches")


_INDEX = "a int, b int, data binary, reps array<long>"
_UNIT = ["a", "b", "c", "side"]


def _search(texts: DataFrame, trains: DataFrame, edits: int, shard_lines: int, stream_lines: int) -> DataFrame:
    """Lines that can match have the same file, predicate, object and digits, whose hash names the shard.

    Both sides of each shard are counted. Its evaluation lines (about ``shard_lines``; where more have one key, in several
    parts) are indexed once, and the index is stored. Its training lines are cut into parts of about ``stream_lines``, so that
    tasks grow in number with the training data whatever the evaluation data; each part is streamed past a copy of the index of each
    part of the evaluation lines. Training lines are shuffled once.
    """
    shards = max(1, -(-texts.count() // shard_lines))
    key = F.xxhash64("file", "p", "o", F.regexp_replace("s", r"\P{Nd}", ""))
    shard = F.pmod(key, F.lit(shards)).cast("int").alias("a")
    texts, trains = texts.select(shard, "file", "s", "p", "o", "rep"), trains.select(shard, "file", "s", "p", "o", "line_id")
    loads = texts.groupBy("a").agg(F.count("*").alias("e")).join(trains.groupBy("a").agg(F.count("*").alias("t")), "a")
    parts = lambda n, size: F.greatest(F.lit(1), F.round(F.col(n) / size)).cast("int")
    loads = cut(loads.select("a", parts("e", shard_lines).alias("nb"), parts("t", stream_lines).alias("nc")), "loads")
    units = loads.agg(F.sum(F.col("nb") * F.col("nc"))).first()[0] or 1
    loads = broadcast_if_small(loads)
    own = texts.join(loads, "a").withColumn("b", F.pmod(F.xxhash64("s"), F.col("nb")).cast("int"))
    built = own.select("a", "b", "file", "s", "p", "o", "rep").repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(lambda x: _build(x, edits), _INDEX)
    index = cut(built, "line-index").join(loads, "a").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
    index = index.select("a", "b", "c", F.lit(0).alias("side"), "data", "reps", *[F.lit(None).cast(t).alias(n) for n, t in (("file", "long"), ("s", "string"), ("p", "string"), ("o", "string"), ("line_id", "long"))])
    stream = trains.join(loads, "a").withColumn("c", F.pmod(F.xxhash64("line_id"), F.col("nc")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    stream = stream.select("a", "b", "c", F.lit(1).alias("side"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("array<long>").alias("reps"), "file", "s", "p", "o", "line_id")
    ordered = index.unionByName(stream).repartition(units, "a", "b", "c").sortWithinPartitions(*_UNIT)
    return ordered.mapInArrow(_stream, "file long, rep_e long, line_t long, matched int, length int")


def _runs(batches, n: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Consecutive rows with equal values in the first ``n`` columns, as (values, part of a batch)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)]
        changes = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
        for begin, end in zip([0, *changes], [*changes, batch.num_rows]):
            yield tuple(int(k[begin]) for k in keys), batch.slice(begin, end - begin)


def _build(batches, edits: int) -> Iterator[pa.RecordBatch]:
    """The index of each part of a shard, as one row."""
    unit, lines, reps = None, [], []

    def built():
        data = LineIndex(lines, edits).to_bytes()
        cols = [pa.array([x], t) for x, t in zip((*unit, data, reps), (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "data", "reps"])

    for key, part in _runs(batches, 2):
        if key != unit and unit is not None:
            yield built()
            lines, reps = [], []
        unit = key
        file, s, p, o, rep = (part.column(i).to_pylist() for i in range(2, 7))
        lines += zip(file, s, p, o)
        reps += rep
    if unit is not None:
        yield built()


def _stream(batches) -> Iterator[pa.RecordBatch]:
    """Training lines of each unit through the index that comes before them; equal lines of a batch are searched once."""
    index, reps = None, []
    for (*_, side), part in _runs(batches, len(_UNIT)):
        if side == 0:
            index, reps = LineIndex.from_bytes(part.column(4)[0].as_py()), part.column(5)[0].as_py()
            continue
        where: dict[tuple, list[int]] = {}
        for *text, line in zip(*(part.column(i).to_pylist() for i in range(6, 11))):
            where.setdefault(tuple(text), []).append(line)
        asked = list(where)
        found = [(asked[q], m) for q, m in index.search(*map(list, zip(*asked)))]
        rows = [(text[0], reps[m], line, matched(text[1], index.subjects[m]), len(index.subjects[m])) for text, m in found for line in where[text]]
        cols = list(zip(*rows)) if rows else [()] * 5
        types = [pa.int64()] * 3 + [pa.int32()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["file", "rep_e", "line_t", "matched", "length"])


def cross_split_pairs(lines: DataFrame, settings: DataFrame, edits: int = EDITS) -> DataFrame:
    """(``line_a``, ``line_b``), ``line_a`` < ``line_b``: one line of a file named as ``path_valid`` or
    ``path_test``, one of the file the same row names as ``path_train``, with the same predicate and object
    and subjects at most ``edits`` letters apart.

    The spelling of names and paths doesn't matter. Equal evaluation lines are indexed once and joined back. Settings without train or evaluation path, files without lines, and lines with
    a null or blank id, path or name give nothing; extra columns are ignored.
    """
    found = Overlaps(lines, settings, edits)
    evals = found.members.select("file", F.col("rep").alias("rep_e"), F.col("line_id").alias("x"))
    out = found.pairs.join(evals, ["file", "rep_e"]).where("x <> line_t")
    return out.select(F.least("x", "line_t").alias("line_a"), F.greatest("x", "line_t").alias("line_b")).distinct()


def overlap_counts(lines: DataFrame, settings: DataFrame, edits: int = EDITS) -> DataFrame:
    """(``eval_path``, ``train_path``, ``n_pairs``, ``n_eval_lines``, ``n_same``, ``covered``): pairs, evaluation lines with a partner, pairs with the
    same subject, and the share of the subjects' letters in the merged maximal matches.

    Pairs are counted from the sizes of the groups of equal evaluation lines, without listing them.
    """
    found = Overlaps(lines, settings, edits)
    own = found.members.groupBy("file", F.col("rep").alias("rep_e"), F.col("path").alias("eval_path")).agg(F.count("*").alias("n_e"))
    same = F.count_if((F.col("matched") == F.col("length")))
    by_text = found.pairs.groupBy("file", "rep_e").agg(F.count("*").alias("n_t"), same.alias("n_same"), F.sum("matched").alias("m"), F.sum("length").alias("l"))
    names = found.files.select("train_path", F.xxhash64("train_path").alias("file")).distinct()
    n = lambda c: F.sum(F.col("n_e") * F.col(c))
    per = by_text.join(own, ["file", "rep_e"]).join(broadcast_if_small(names), "file").groupBy("eval_path", "train_path")
    return per.agg(n("n_t").alias("n_pairs"), F.sum("n_e").alias("n_eval_lines"), n("n_same").alias("n_same"), F.round(n("m") / n("l"), 6).alias("covered"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of overlapping lines."""
    return cross_split_pairs(table(spark, sf_dir, "split_lines"), table(spark, sf_dir, "settings"))


def p5_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation file and training file."""
    return overlap_counts(table(spark, sf_dir, "split_lines"), table(spark, sf_dir, "settings"))


QUERIES = {"p5_found": p5_found, "p5_overlap_counts": p5_overlap_counts}
ORACLE: dict[str, str] = {}
