"""A compressed full-text index (runs of the Burrows-Wheeler transform, sampled positions) of evaluation lines, and
backward search of training lines in it: exact in predicate and object, up to some letters apart in the subject."""

from __future__ import annotations

import pickle

import numpy as np

_START, _SEP = "\x01", "\x02"
_PATHS = 0xF0000  # private code points: one for each training file of a shard
_SMALL = 4
_AT_ONCE = 4_000
#: Every so many-th position of the text has its line stored.
_SAMPLED = 4


def near(a: str, b: str, k: int) -> bool:
    """Whether at most ``k`` letters must be added, removed or replaced to make ``a`` into ``b``; digits stay."""
    if abs(len(a) - len(b)) > k:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return len(a) + len(b) <= k and not any(c.isdigit() for c in a + b)
    if k == 0:
        return False
    x, y = not a[0].isdigit(), not b[0].isdigit()
    return (x and y and near(a[1:], b[1:], k - 1)) or (x and near(a[1:], b, k - 1)) or (y and near(a, b[1:], k - 1))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the joined texts, and where each text begins (and the end)."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def _letter_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Length of each text, and the set of its letters as bits (by code modulo 64). An edit changes two bits at most."""
    points, starts = _codes([t + "\0" for t in texts])
    bits = np.uint64(1) << (points % 64).astype(np.uint64)
    return np.diff(starts), np.bitwise_or.reduceat(bits, starts[:-1]) if len(texts) else np.empty(0, np.uint64)


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; the first sort takes as many symbols as fit 62 bits."""
    n = len(codes)
    bits = max(1, int(codes.max(initial=0) + 1).bit_length())
    width = max(1, 62 // bits)
    padded = np.concatenate((codes.astype(np.int64) + 1, np.zeros(width, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | padded[k : k + n]
    step = width
    while True:
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if n == 0 or new[order[-1]] == n - 1:
            return order.astype(np.int32)
        after = np.zeros(n, np.int64)
        if step < n:
            after[: n - step] = new[step:] + 1
        key = new * (n + 1) + after
        step *= 2


def matched(a: str, b: str) -> int:
    """Letters of the shorter name that the common beginning and end cover: the outer maximal matches, merged where they overlap."""
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    j = next((k for k in range(n - i) if a[-1 - k] != b[-1 - k]), n - i)
    return i + j


class LineIndex:
    """Lines (file number, subject, predicate, object), all different, as one searchable text.

    The transform is kept as its runs of equal symbols: for each symbol where its runs begin, and how often it occurs before each. Ranks are
    found by binary search in them; lines that share files, predicates and objects have long runs. A position's line is
    stored for every ``_SAMPLED``-th one and for the beginning of each line; others walk back to one of these.
    """

    def __init__(self, lines: list[tuple[int, str, str, str]], edits: int = 2):
        self.edits = edits
        self.subjects = [s for _, s, _, _ in lines]
        self.letter_sets = _letter_sets(self.subjects)
        self.paths = {f: chr(_PATHS + i) for i, f in enumerate(dict.fromkeys(f for f, *_ in lines))}
        points, starts = _codes([f"{_START}{s}{_SEP}{p}{_SEP}{o}{self.paths[f]}" for f, s, p, o in lines])
        self.alphabet, codes = np.unique(points, return_inverse=True)
        sa = suffix_array(codes)
        bwt = codes[sa - 1]
        self.size = n = len(codes)
        sigma = len(self.alphabet)
        self.run_start = np.flatnonzero(np.concatenate(([True], np.diff(bwt) != 0))).astype(np.int32)
        self.run_symbol = bwt[self.run_start].astype(np.uint16 if sigma < 65_536 else np.uint32)
        lengths = np.diff(np.concatenate((self.run_start, [n])))
        order = np.argsort(self.run_symbol, kind="stable")
        self.runs = self.run_symbol[order].astype(np.int64) * (n + 1) + self.run_start[order]  # by symbol, then place
        self.counts = np.concatenate(([0], np.cumsum(lengths[order]))).astype(np.int32)  # rows of the first column before each run
        self.first_run = np.searchsorted(self.runs, np.arange(sigma + 1) * (n + 1))
        self.start = int(np.searchsorted(self.alphabet, ord(_START)))
        marked = (sa % _SAMPLED == 0) | (codes[sa] == self.start)
        self.marked = np.flatnonzero(marked).astype(np.int32)
        self.line_of = (np.searchsorted(starts, sa[marked], "right") - 1).astype(np.int32)
        self.letters = np.array([i for i, c in enumerate(self.alphabet) if chr(c) not in (_START, _SEP) and c < _PATHS and not chr(c).isdigit()], np.int64)
        self.is_letter = np.zeros(sigma + 1, bool)  # the last stands for symbols that the text lacks
        self.is_letter[self.letters] = True

    def to_bytes(self) -> bytes:
        return pickle.dumps(self.__dict__, 5)

    @classmethod
    def from_bytes(cls, data: bytes) -> LineIndex:
        out = cls.__new__(cls)
        out.__dict__ = pickle.loads(data)
        return out

    def _rank(self, c: np.ndarray | int, at: np.ndarray) -> np.ndarray:
        """Row at which the suffixes that begin with ``c`` and stand behind the first ``at`` rows end."""
        c, at = np.broadcast_arrays(c, at)
        run = np.searchsorted(self.runs, c * (self.size + 1) + at) - 1
        first = self.first_run[c]
        none = run < first
        run = np.where(none, first, run)
        inside = np.minimum(at - (self.runs[run] - c * (self.size + 1)), self.counts[run + 1] - self.counts[run])
        return self.counts[run] + np.where(none, 0, inside)

    def lines_at(self, rows: np.ndarray) -> np.ndarray:
        """The line of each row: back through the text, symbol by symbol, to a position whose line is stored."""
        out, rows, left = np.empty(len(rows), np.int64), rows.astype(np.int64), np.arange(len(rows))
        while len(left):
            k = np.minimum(np.searchsorted(self.marked, rows), len(self.marked) - 1)
            there = self.marked[k] == rows
            out[left[there]] = self.line_of[k[there]]
            rows, left = rows[~there], left[~there]
            rows = self._rank(self.run_symbol[np.searchsorted(self.run_start, rows, "right") - 1].astype(np.int64), rows)
        return out

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, starts = _codes(texts)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, -1), starts

    def search(self, files: list[int], subjects: list[str], predicates: list[str], objects: list[str]) -> list[tuple[int, int]]:
        """(query, line) of all lines of the same file, predicate and object whose subject is near enough.

        Queries are read from their end. What all of a line must match, up to the subject, is searched without edits; from that
        match on the search goes on through the subject and branches where letters may differ."""
        asked = [i for i, f in enumerate(files) if f in self.paths]
        if not asked:
            return []
        codes, starts = self._encode([f"{_SEP}{predicates[i]}{_SEP}{objects[i]}{self.paths[files[i]]}" for i in asked])
        lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), self.size, np.int64)
        alive = np.arange(len(asked))
        left = np.diff(starts)
        while True:
            going = alive[left[alive] > 0]
            if not len(going):
                break
            left[going] -= 1
            c = codes[starts[going] + left[going]]
            known = c >= 0
            hi[going[~known]] = 0
            going, c = going[known], c[known]
            lo[going], hi[going] = self._rank(c, lo[going]), self._rank(c, hi[going])
            alive = alive[lo[alive] < hi[alive]]
        queries, lines = [], []
        wide = hi[alive] - lo[alive] > _SMALL
        self._take(alive[~wide], lo[alive[~wide]], hi[alive[~wide]], queries, lines)
        many = alive[wide]
        for k in range(0, len(many), _AT_ONCE):
            part = many[k : k + _AT_ONCE]
            q, m = self._branch([subjects[asked[i]] for i in part], lo[part], hi[part])
            queries.append(part[q])
            lines.append(m)
        if not queries:
            return []
        both = np.stack((np.concatenate(queries), np.concatenate(lines)), 1)
        own, asking = self.letter_sets, _letter_sets([subjects[i] for i in asked])
        likely = np.abs(asking[0][both[:, 0]] - own[0][both[:, 1]]) <= self.edits
        likely &= np.bitwise_count(asking[1][both[:, 0]] ^ own[1][both[:, 1]]) <= 2 * self.edits
        both = np.unique(both[likely], axis=0)
        return [(asked[q], m) for q, m in both.tolist() if near(subjects[asked[q]], self.subjects[m], self.edits)]

    def _take(self, q, lo, hi, queries: list, lines: list) -> None:
        n = hi - lo
        rows = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        queries.append(np.repeat(q, n))
        lines.append(self.lines_at(rows))

    def _branch(self, subjects: list[str], lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search through the subjects that follows every way of few enough letter edits. A range of a few lines is
        left to the comparison of the strings."""
        codes, starts = self._encode(subjects)
        q = np.arange(len(subjects))
        i, e = np.diff(starts), np.zeros(len(subjects), np.int64)
        lo, hi = lo.copy(), hi.copy()
        queries: list[np.ndarray] = []
        lines: list[np.ndarray] = []
        letters = self.letters[:, None]
        while len(q):
            small = hi - lo <= _SMALL
            self._take(q[small], lo[small], hi[small], queries, lines)
            q, i, lo, hi, e = (x[~small] for x in (q, i, lo, hi, e))
            done = i == 0
            if done.any():
                a, b = self._rank(self.start, lo[done]).astype(np.int64), self._rank(self.start, hi[done]).astype(np.int64)
                self._take(q[done], a, np.maximum(a, b), queries, lines)
            c = np.where(done, -1, codes[np.minimum(starts[q] + i, len(codes)) - 1])
            steps = []
            m = c >= 0
            steps.append((q[m], i[m] - 1, self._rank(c[m], lo[m]), self._rank(c[m], hi[m]), e[m]))
            free = (e < self.edits) & (done | (c < 0) | self.is_letter[c])
            drop = free & ~done  # a letter of the query that the line lacks
            steps.append((q[drop], i[drop] - 1, lo[drop], hi[drop], e[drop] + 1))
            more = np.flatnonzero(e < self.edits)
            if len(more) and len(letters):
                a, b = self._rank(letters, lo[more]), self._rank(letters, hi[more])
                x, at = np.nonzero(a < b)
                a, b, at = a[x, at], b[x, at], more[at]
                steps.append((q[at], i[at], a, b, e[at] + 1))  # a letter of the line that the query lacks
                put = drop[at] & (self.letters[x] != c[at])
                steps.append((q[at][put], i[at][put] - 1, a[put], b[put], e[at][put] + 1))
            q, i, lo, hi, e = (np.concatenate([s[k] for s in steps]).astype(np.int64) for k in range(5))
            keep = lo < hi
            if not keep.any():
                break
            q, i, lo, hi, e = (x[keep] for x in (q, i, lo, hi, e))
            order = np.lexsort((e, hi, lo, i, q))
            q, i, lo, hi, e = (x[order] for x in (q, i, lo, hi, e))
            same = np.concatenate(([False], (np.diff(q) == 0) & (np.diff(i) == 0) & (np.diff(lo) == 0) & (np.diff(hi) == 0)))
            q, i, lo, hi, e = (x[~same] for x in (q, i, lo, hi, e))
        if not queries:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(queries), np.concatenate(lines)
