"""Problem 9: the reading level of documents, from surprisal under interpolated n-gram models."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm.text import prose_words
from lodeweave.session import table

MIN_WORDS = 40
MAX_SAMPLES = 20_000
FOLDS = 4
_START = "\n"


class Bigrams:
    """A bigram model interpolated with unigrams and a uniform floor (Witten-Bell weights)."""

    def __init__(self, texts: Iterable[list[str]], n_words: int):
        self.uni: Counter[str] = Counter()
        self.bi: Counter[tuple[str, str]] = Counter()
        self.seen: Counter[str] = Counter()
        for words in texts:
            self.uni.update(words)
            before = [_START, *words[:-1]] if words else []
            self.bi.update(zip(before, words))
            self.seen.update(before)
        self.after = Counter(a for a, _ in self.bi)
        self.total, self.n_words = sum(self.uni.values()), n_words
        self.unseen = len(self.uni) / (self.total + len(self.uni)) if self.total else 1.0

    def unigram(self, w: str) -> float:
        return (1 - self.unseen) * self.uni[w] / max(1, self.total) + self.unseen / self.n_words

    def backoff(self, a: str) -> float:
        n = self.seen[a]
        return self.after[a] / (n + self.after[a]) if n else 1.0

    def bigram(self, a: str, w: str) -> float:
        back = self.backoff(a)
        n = self.seen[a]
        return ((1 - back) * self.bi[a, w] / n if n else 0.0) + back * self.unigram(w)


class Contrast:
    """A weighted sum of surprisals (bits) under several models as one table: for a bigram that no model has seen the sum
    falls into a part of the first word and a part of the second; a seen bigram has its own value."""

    def __init__(self, models: list[tuple[float, Bigrams]], ids: dict[str, int]):
        n = len(ids) + 1  # 0: a word that no sample has
        self.first, self.second, self.width = np.zeros(n), np.zeros(n), n
        words = [("", 0), *ids.items()]
        for weight, m in models:
            self.first += [-weight * math.log2(m.backoff(w)) for w, _ in words]
            self.second += [-weight * math.log2(m.unigram(w)) for w, _ in words]
        own = {b for _, m in models for b in m.bi}
        table = sorted((ids[a] * n + ids[w], sum(-k * math.log2(m.bigram(a, w)) for k, m in models)) for a, w in own)
        self.keys = np.array([k for k, _ in table], np.int64)
        self.values = np.array([v for _, v in table])

    def of(self, words: np.ndarray, start: int) -> np.ndarray:
        """The value of each word after the one before it; the first word of a text follows ``start``."""
        before = np.concatenate(([start], words[:-1]))
        out = self.first[before] + self.second[words]
        if len(self.keys):
            key = before.astype(np.int64) * self.width + words
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            own = self.keys[at] == key
            out[own] = self.values[at[own]]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function of ``x`` nearest to ``y`` (pool adjacent violators)."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        pools.append([float(b), 1.0, float(a), float(a)])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            m, n, _, hi = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * n) / (p[1] + n), p[1] + n, hi
    return np.array([v for p in pools for v in p[2:4]]), np.array([p[0] for p in pools for _ in (0, 1)])


class LanguageLevels:
    """Levels of one language: for each step between bands a model of the samples up to it and one of those
    above. The mean over a text of the summed surprisal differences grows with its difficulty; isotonic regression
    on held-out parts of the samples maps it to bands."""

    def __init__(self, samples: list[tuple[list[str], int]], ids: dict[str, int], start: int, folds: int = FOLDS):
        self.bands = sorted({b for _, b in samples})
        n_words = len(ids) + 1000
        self.plain = Contrast([(1.0, Bigrams([w for w, _ in samples], n_words))], ids)
        self.contrast = self._contrast(samples, ids, n_words)
        x, y = [], []
        for k in range(folds):
            held, rest = samples[k::folds], [s for i, s in enumerate(samples) if i % folds != k]
            part = self._contrast(rest, ids, n_words) if rest else self.contrast
            for words, band in held:
                if words:
                    x.append(part.of(np.array([ids[w] for w in words]), start).mean())
                    y.append(band)
        self.knots, self.levels = isotonic(np.array(x), np.array(y, float))

    def _contrast(self, samples, ids, n_words) -> Contrast:
        models = []
        for cutoff in self.bands[:-1]:
            models.append((1.0, Bigrams([w for w, b in samples if b <= cutoff], n_words)))
            models.append((-1.0, Bigrams([w for w, b in samples if b > cutoff], n_words)))
        return Contrast(models, ids)

    def band(self, mean: float) -> int:
        return int(min(max(math.floor(np.interp(mean, self.knots, self.levels) + 0.5), self.bands[0]), self.bands[-1]))


class ReadingLevels:
    """Models of all languages, trained on (language, text, band) samples."""

    def __init__(self, samples: list[tuple[str, str, int]]):
        by: dict[str, list[tuple[list[str], int]]] = defaultdict(list)
        for lang, text, band in samples:
            if words := prose_words(text):
                by[lang].append((words, band))
        self.ids: dict[str, int] = {_START: 1}
        for texts in by.values():
            for words, _ in texts:
                for w in words:
                    self.ids.setdefault(w, len(self.ids) + 1)
        self.languages = {lang: LanguageLevels(texts, self.ids, 1) for lang, texts in sorted(by.items())}

    def level(self, words: list[str]) -> tuple[str, int, np.ndarray, float] | None:
        """Language (least mean surprisal), band, surprisal of each word, and mean contrast of a text."""
        if not words or not self.languages:
            return None
        at = np.fromiter((self.ids.get(w, 0) for w in words), np.int64, len(words))
        bits = {lang: m.plain.of(at, 1) for lang, m in self.languages.items()}
        lang = min(bits, key=lambda x: (bits[x].mean(), x))
        mean = float(self.languages[lang].contrast.of(at, 1).mean())
        return lang, self.languages[lang].band(mean), bits[lang], mean


_SCHEMA = "doc_id long, language string, n_words int, bits_mean double, bits_p10 double, bits_p50 double, bits_p90 double, contrast double, band int"


def reading_levels(documents: DataFrame, samples: DataFrame, min_words: int = MIN_WORDS, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """Language, number of words, surprisal distribution and band of each document with at least
    ``min_words`` words of its own prose.

    The models are trained on the driver on at most ``max_samples`` labelled rows, the smallest ids
    (a documented bound); all documents are then read whole in one pass without shuffle. Samples
    without text, language or band are left out; documents with null text or too little prose have no row.
    """
    rows = samples.where("text is not null and lang is not null and band is not null").orderBy("sample_id").limit(max_samples).collect()
    models = ReadingLevels([(r["lang"], r["text"], r["band"]) for r in rows])

    def levels(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = prose_words(text.as_py())
                if len(words) < min_words or not (found := models.level(words)):
                    continue
                lang, band, bits, mean = found
                n = len(bits)
                low, mid, high = np.partition(bits, [n // 10, n // 2, n * 9 // 10])[[n // 10, n // 2, n * 9 // 10]]
                out.append((doc, lang, n, float(bits.mean()), float(low), float(mid), float(high), mean, band))
            types = [pa.int64(), pa.string(), pa.int32(), *[pa.float64()] * 5, pa.int32()]
            cols = list(zip(*out)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], [c.split()[0] for c in _SCHEMA.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(levels, _SCHEMA)


def p9_reading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of all documents with enough prose of their own."""
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "graded_texts"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their bands."""
    return p9_reading_levels(spark, sf_dir).select("doc_id", "band")


QUERIES = {"p9_found": p9_found, "p9_reading_levels": p9_reading_levels}
ORACLE: dict[str, str] = {}
