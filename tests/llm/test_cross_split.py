import random

import numpy as np
import pytest

from lodeweave.llm.cross_split import Overlaps, _search, cross_split_pairs, overlap_counts
from lodeweave.llm.fm_index import LineIndex, matched, near, suffix_array
from lodeweave.llm.names import plain_name, plain_path

LINE = "line_id long, path string, s string, p string, o string, side int"
SETTING = "path_train string, path_valid string, path_test string, rep int"


@pytest.mark.parametrize(
    "written",
    ["<http://kg.example/res/Graíxrear_Bo_(mill)>", "kgr:Graíxrear_Bo_(mill)", "graixrear bo (mill)", "GRAÍXREAR-BO_(MILL) .", '"Graíxrear\xa0Bo\xa0(mill)"', "Graíx​rear__Bo__(mill)", "Graíxrear_Bo_(mill)", "Gra%C3%ADxrear_Bo_(mill)", "Gra\\u00edxrear_Bo_(mill)"],
)
def test_spellings_of_one_name(written):
    assert plain_name(written) == "graixrearbomill"


def test_paths():
    assert {plain_path(x) for x in ("a/b/t.tsv", "./a/b/t.tsv", "a//b/t.tsv", "file:a/b/t.tsv", "a/c/../b/t.tsv", "a\\b\\t.tsv")} == {"a/b/t.tsv"}
    assert plain_path(" ") is None and plain_path(None) is None


def distance(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            best = 0 if i == j == 0 else 99
            if i and not a[i - 1].isdigit():
                best = min(best, d[i - 1, j] + 1)
            if j and not b[j - 1].isdigit():
                best = min(best, d[i, j - 1] + 1)
            if i and j and a[i - 1] == b[j - 1]:
                best = min(best, d[i - 1, j - 1])
            elif i and j and not a[i - 1].isdigit() and not b[j - 1].isdigit():
                best = min(best, d[i - 1, j - 1] + 1)
            d[i, j] = best
    return d[len(a), len(b)]


WORDS = ["abba", "abc", "cab", "dad", "fee", "ab", "1", "22"]


def name(rnd):
    return "".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4)))


def changed(rnd, s):
    s = list(s)
    for _ in range(rnd.randint(0, 3)):
        k = rnd.randrange(len(s) + 1)
        r = rnd.random()
        if r < 0.4 and k < len(s):
            s[k] = rnd.choice("abcdx")
        elif r < 0.7:
            s.insert(k, rnd.choice("abcdx"))
        elif k < len(s):
            del s[k]
    return "".join(s) or "a"


def test_near_is_the_edit_distance_of_letters():
    rnd = random.Random(2)
    for _ in range(3000):
        b = name(rnd)
        a = changed(rnd, b)
        assert near(a, b, 2) == (distance(a, b) <= 2)


def test_suffix_array():
    rnd = random.Random(4)
    codes = np.array([rnd.randrange(3) for _ in range(300)])
    want = sorted(range(300), key=lambda i: list(codes[i:]))
    assert suffix_array(codes).tolist() == want


def texts_of(lines):
    paths = {f: chr(0xF0000 + i) for i, f in enumerate(dict.fromkeys(f for f, *_ in lines))}
    return [f"\x01{s}\x02{p}\x02{o}{paths[f]}" for f, s, p, o in lines]


def starts_of(lines):
    return np.cumsum([0, *map(len, texts_of(lines))])[:-1]


def index_order(lines):
    text = "".join(texts_of(lines))
    return np.array(sorted(range(len(text)), key=lambda i: text[i:]))


def test_matched():
    assert [matched(*x) for x in (("abc", "abc"), ("abc", "axc"), ("aba", "ababa"), ("", "a"), ("ab", "cd"))] == [3, 2, 3, 0, 0]


def test_index_against_brute_force():
    rnd = random.Random(1)
    lines = list({(rnd.randint(1, 2), name(rnd), rnd.choice(["p", "pq"]), rnd.choice(["o", "q"])) for _ in range(700)})
    asked = [(f, changed(rnd, s), p, o) for f, s, p, o in rnd.choices(lines, k=200)] + [(9, "a", "p", "o"), (1, "zz", "p", "zz")]
    index = LineIndex.from_bytes(LineIndex(lines).to_bytes())
    assert index.lines_at(np.arange(index.size)).tolist() == (np.searchsorted(starts_of(lines), index_order(lines), "right") - 1).tolist()
    got = set(index.search(*[list(c) for c in zip(*asked)]))
    want = {(i, j) for i, (f, s, p, o) in enumerate(asked) for j, (g, t, q, r) in enumerate(lines) if (f, p, o) == (g, q, r) and near(s, t, 2)}
    assert got == want


def made(rnd, n):
    paths = ["d/train.tsv", "d/train.tsv", "d/valid.tsv", "d/test.tsv", "d/other.tsv", None]
    return [(i, rnd.choice(paths), rnd.choice([name(rnd), name(rnd).upper(), " kgr:" + name(rnd), None, ""]), rnd.choice(["p", "P "]), rnd.choice(["o", "q"]), 1) for i in range(n)]


SETTINGS = [("./d/train.tsv", "d//valid.tsv", "d/test.tsv", 1), ("d/train.tsv", None, "d/test.tsv", 1), ("d/none.tsv", "d/valid.tsv", "", 1), (None, "d/valid.tsv", "d/test.tsv", 1)]


def wanted(data):
    rows = [(i, plain_path(p), *map(plain_name, x)) for i, p, *x, _ in data]
    rows = [r for r in rows if r[1] and all(r[2:])]
    out = set()
    for a in rows:
        for b in rows:
            if a[1] in ("d/valid.tsv", "d/test.tsv") and b[1] == "d/train.tsv" and a[3:] == b[3:] and near(a[2], b[2], 2):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_pairs_against_brute_force(spark, rows):
    data = made(random.Random(6), 250)
    lines, settings = spark.createDataFrame(data, LINE), spark.createDataFrame(SETTINGS, SETTING)
    want = wanted(data)
    assert set(rows(cross_split_pairs(lines, settings))) == want
    assert sum(r["n_pairs"] for r in overlap_counts(lines, settings).collect()) == len(want)


def test_hot_keys_are_spread_without_loss(spark, rows):
    rnd = random.Random(8)
    data = [(i, rnd.choice(["d/train.tsv", "d/valid.tsv"]), rnd.choice(["ab", "ba"]) + name(rnd), "p", "o", 1) for i in range(250)]
    found = Overlaps(spark.createDataFrame(data, LINE), spark.createDataFrame(SETTINGS, SETTING), shard_lines=10, stream_lines=15)
    per = {}
    for r in found.members.collect():
        per.setdefault(r["rep"], []).append(r["line_id"])
    got = {(min(x, r["line_t"]), max(x, r["line_t"])) for r in found.pairs.collect() for x in per[r["rep_e"]]}
    assert got == wanted(data)


def test_no_lines(spark):
    assert cross_split_pairs(spark.createDataFrame([], LINE), spark.createDataFrame(SETTINGS, SETTING)).count() == 0
    assert cross_split_pairs(spark.createDataFrame(made(random.Random(1), 5), LINE), spark.createDataFrame([], SETTING)).count() == 0
    assert callable(_search)
