import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lodeweave.llm.containers import VOCABULARY, TokenCounter, fullest, minimum_bin_slack, pack, token_counts
from lodeweave.llm.leakage import build_index, covered_words, find_leaks
from lodeweave.llm.reading_level import ReadingLevels, isotonic, reading_levels
from lodeweave.llm.text import own_prose, plain_words, prose_words

DOC = "doc_id long, text string, item_id long, band int"
ITEM = "item_id long, text string, doc_id long"
needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary file")


def test_plain_words():
    assert plain_words("> The <b>Gate</b>&nbsp;sees\r\n> this[url=http://x.y/z] ro​ad[/url]!<br>\n| My &amp; key") == ["the", "gate", "sees", "this", "road", "my", "key"]
    assert plain_words(None) == plain_words("") == plain_words(" \n> ") == []


@pytest.mark.parametrize(
    "text",
    [
        "> quoted words here\nMine only.", "| quoted\n| words\nMine only.", "bob.kg wrote:\n>old text\n\nMine only.", "[quote=a]\n[quote=b]deep[/quote] mid\n[/quote]\nMine only.",
        "<blockquote>old\nlines\n</blockquote>\nMine only.", "Mine only.\n\n-- \nbob\nA signature.", "Mine only.\n____________\nbob | A signature.", "Mine only.\n[sig]A signature.[/sig]",
        "Mine only.\n<hr><small>A signature.</small>", "Mine only.\nSent from my Phone 9", "```\ncode here\n```\nMine only.", "[code]<a> <b> \"c\" .[/code]\nMine only.",
        "Mine only.\n\n--\n~bob~ A signature.\n\n> later quote", "<p>Mine <i>only</i>.</p>", "Mine only.\n\n(reposted, the first one got no answer)",
    ],
)
def test_own_prose(text):
    assert prose_words(text) == ["mine", "only"]


def test_own_prose_of_nothing():
    assert own_prose(None) == "" and prose_words("[quote=a] never closed") == []


def test_leaks_against_brute_force(spark, rows):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    passage = lambda n: [rnd.choice(words) for _ in range(n)]
    intro = "Read this and answer now. "
    items = [(i, passage(rnd.randint(3, 30))) for i in range(12)]
    docs = []
    for i in range(80):
        text = passage(rnd.randint(0, 60))
        for _, w in rnd.choices(items, k=2):
            a = rnd.randrange(len(w))
            text += w[a : a + rnd.randint(1, 30)]
        docs.append((i, "\n> ".join(text).upper() if i % 2 else " ".join(text)))
    docs += [(90, None), (91, ""), (92, "x" * 50_000)]
    want = set()
    for i, w in items:
        for d, t in docs:
            text = plain_words(t)
            grams = {tuple(text[j : j + 5]) for j in range(len(text) - 4)}
            hit = {k for j in range(len(w) - 4) if tuple(w[j : j + 5]) in grams for k in range(j, j + 5)}
            if len(w) >= 5 and 2 * len(hit) >= len(w):
                want.add((i, d))
    rows_i = [(i, intro + " ".join(w) + ".", 5) for i, w in items] + [(50, None, 1), (51, "", 1)]
    found = find_leaks(spark.createDataFrame([(*d, 1, 2) for d in docs], DOC), spark.createDataFrame(rows_i, ITEM), block=5)
    assert want and set(rows(found)) == want
    assert find_leaks(spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)).count() == 0


def _near(w, text, slop, run=5):
    hit = set()
    for i in range(len(w) - run + 1):
        if any(all(w[i + k] in text[max(0, b + k - slop) : max(0, b + k + slop + 1)] for k in range(run)) for b in range(-slop, len(text))):
            hit |= set(range(i, i + run))
    return len(hit)


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_proximity_matches_against_brute_force(spark, rows, slop):
    rnd = random.Random(9)
    items = [(i, [f"w{rnd.randrange(9)}" for _ in range(rnd.randint(5, 14))]) for i in range(10)]
    docs = []
    for i in range(60):
        w = list(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(w) - 1)
            w[k : k + 2] = rnd.choice([[w[k + 1], w[k]], [w[k], "zz", w[k + 1]], [w[k + 1]]])
        docs.append((i, " ".join(w)))
    index = build_index(spark.createDataFrame([(*d, 1, 2) for d in docs], DOC), shard_tokens=40)
    found = find_leaks(spark.createDataFrame([], DOC), spark.createDataFrame([(i, " ".join(w), 1) for i, w in items], ITEM), slop=slop, index=index)
    want = {(i, d) for i, w in items for d, t in docs if 2 * _near(w, t.split(), slop) >= len(w)}
    assert want and set(rows(found)) == want


def test_index_holds_every_word_once(spark):
    docs = [(1, "a b a"), (2, None), (3, ""), (None, "x"), (4, "b " * 70)]
    index = build_index(spark.createDataFrame([(*d, 1, 2) for d in docs], DOC).coalesce(1), shard_tokens=50).collect()
    places = {(r["shard"], int(x)): r["term"] for r in index if r["term"] for x in np.frombuffer(r["positions"], "<i4")}
    heads = {r["shard"]: (np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["starts"], "<i4")) for r in index if r["term"] is None}
    texts = {}
    for (s, x), t in sorted(places.items()):
        ids, starts = heads[s]
        texts.setdefault(int(ids[np.searchsorted(starts, x, "right") - 1]), []).append(t)
    assert texts == {1: ["a", "b", "a"], 4: ["b"] * 70}


def test_shared_openings_have_any_length(spark, rows):
    opening = "Read " + "very " * 200 + "well. "
    items = [(i, f"{opening}one{i} two{i} three{i} four{i} five{i} six{i}", 1) for i in range(5)]
    docs = [(i, f"one{i} two{i} three{i} four{i} five{i} six{i}", 1, 1) for i in range(5)]
    assert rows(find_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))) == [(i, i) for i in range(5)]


def test_covered_words():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8], np.int32)
    assert covered_words(a, np.array([9, 1, 2, 3, 4, 5, 9], np.int32)) == 5
    assert covered_words(a, np.array([1, 2, 3, 4], np.int32)) == 0


def test_isotonic():
    x, y = isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert np.interp([1, 2, 3, 4], x, y).tolist() == [1, 2.5, 2.5, 4]


def graded(rnd, lang, band, n):
    easy, hard = [f"{lang}e{chr(97 + i)}" for i in range(12)], [f"{lang}h{chr(97 + i)}" for i in range(12)]
    return " ".join(rnd.choice(hard if rnd.random() < (band - 1) / 4 else easy) for _ in range(n))


def test_levels_of_held_out_texts(spark):
    rnd = random.Random(2)
    train = [(lang, graded(rnd, lang, b, 150), b) for lang in ("aa", "bb") for b in range(1, 6) for _ in range(12)]
    models = ReadingLevels(train)
    test = [(lang, b, graded(rnd, lang, b, 150)) for lang in ("aa", "bb") for b in range(1, 6) for _ in range(10)]
    got = [(models.level(prose_words(t)), lang, b) for lang, b, t in test]
    assert all(g[0] == lang for g, lang, _ in got)
    assert sum(g[1] == b for g, _, b in got) >= 0.8 * len(got)
    docs = spark.createDataFrame([(1, test[0][2], 1, 9), (2, None, 1, 9), (3, "short text", 1, 9), (4, "", 1, 9)], DOC)
    samples = spark.createDataFrame([(i, *t) for i, t in enumerate(train)], "sample_id long, lang string, text string, band int")
    out = reading_levels(docs, samples).collect()
    assert [(r["doc_id"], r["language"], r["n_words"]) for r in out] == [(1, "aa", 150)]
    assert reading_levels(docs, samples.limit(0)).count() == 0


def test_fullest_is_a_best_subset():
    rnd = random.Random(5)
    for _ in range(200):
        items = [rnd.randint(1, 30) for _ in range(8)]
        room = rnd.randint(1, 80)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        counts = Counter(items)
        used = fullest(sorted(counts, reverse=True), counts, room)
        assert all(used[k] <= counts[k] for k in used)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_containers_hold_every_item_once():
    rnd = random.Random(6)
    counts = Counter(rnd.choice([rnd.randint(1, 100), 7]) for _ in range(5000))
    bins = minimum_bin_slack(counts, 100)
    packed = Counter()
    for times, used in bins:
        assert sum(k * n for k, n in used.items()) <= 100
        for k, n in used.items():
            packed[k] += n * times
    assert packed == counts
    assert sum(t for t, _ in bins) <= sum(k * n for k, n in counts.items()) / 100 * 1.01 + 1


def test_pack(spark):
    rnd = random.Random(9)
    data = [(i, rnd.choice([0, None, 5, 5, rnd.randint(1, 90), 250, 100, 200]), "c") for i in range(400)] + [(None, 5, "c"), (3, 5, "c")]
    out = pack(spark.createDataFrame(data, "doc_id long, n_tokens long, container_id string"), 100, bucket_rows=50).collect()
    used, pieces = Counter(), {}
    for r in out:
        used[r["container_id"]] += r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append(r["n_tokens"])
    assert max(used.values()) <= 100 and min(used) == 1
    total = Counter()
    for d, n, _ in data:
        total[d] += n or 0
    assert {d: sum(p) for d, p in pieces.items()} == dict(total)
    assert all(len(pieces[d]) == 1 for d, n, _ in data if (n or 0) <= 100 and d not in (None, 3))
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
    assert {r["container_id"] for r in pack(spark.createDataFrame([(1, 0), (2, None)], "doc_id long, n_tokens long")).collect()} == {1}


@needs_vocabulary
def test_counts_are_those_of_the_tokenizer(spark):
    counter = TokenCounter()
    rnd = random.Random(1)
    for _ in range(3000):
        t = "".join(rnd.choice("ab 1.\n\t\xa0é​'s\x1c  ") for _ in range(rnd.randint(0, 14)))
        assert counter.count(t) == len(counter.encode(t)), repr(t)
    out = token_counts(spark.createDataFrame([(1, "A gate sees. "), (2, None), (3, ""), (4, "ab " * 20_000)], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {i: len(counter.encode(t or "")) for i, t in ((1, "A gate sees. "), (2, None), (3, ""), (4, "ab " * 20_000))}
