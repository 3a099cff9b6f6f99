import random
from collections import Counter
from math import comb

import numpy as np
import pytest

from taxolyte.llm import near_dedup as nd
from taxolyte.llm.components import connected, relink
from taxolyte.llm.decontamination import RADIUS, Index, find_leaks, without_leaks
from taxolyte.llm.words import PUNCTUATION, Words, shingles

KIND = "doc_id long, text string"


def shingle_set(text, k):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            common = len(sets[a] & sets[b])
            if None not in (i, j) and common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return sorted(((i, len(s), None if i is None else top(i), i is None or top(i) == i) for (i, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rows = corpus(3, 160)
    got = nd.near_duplicates(spark, spark.createDataFrame(rows, KIND), k, percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, percent)


def test_pairs_across_components(spark, monkeypatch):
    monkeypatch.setattr(nd, "STARS", 0)
    monkeypatch.setattr(nd, "BLOCK", 7)
    rows = corpus(4, 120)
    got = nd.near_duplicates(spark, spark.createDataFrame(rows, KIND), 3, 85).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 85)


def test_near_duplicates_on_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = nd.near_duplicates(spark, odd_docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 5, 80)
    out = nd.one_of_each(spark, odd_docs)
    assert out.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, None]))
    assert nd.near_duplicates(spark, no_docs).count() == 0


def test_one_id_with_two_texts(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(5, a), (5, b), (7, a), (9, b)]
    got = {(r["doc_id"], r["component_id"]) for r in nd.near_duplicates(spark, spark.createDataFrame(rows, KIND)).collect()}
    assert got == {(5, 5), (7, 5), (9, 5)}


def test_least_matches():
    # One posterior level for all batches.
    below, above = [], []
    for n, m in nd.least_matches(0.85):
        tail = lambda k: sum(comb(n + 1, i) * 0.85**i * 0.15 ** (n + 1 - i) for i in range(k + 1))  # noqa: B023, E731
        below.append(tail(m - 1))
        above.append(tail(m))
    assert max(below) < min(above) < nd.MISS


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    common, rest = rng.integers(0, 2**63, 900, np.int64).astype(np.uint64), rng.integers(0, 2**63, 100, np.int64).astype(np.uint64)
    a, b = nd.signature([np.concatenate([common, rest[:50]]), np.concatenate([common, rest[50:]])])
    assert abs((a == b).mean() - 0.9) < 0.1


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 70)] + [(100, 101)], "a long, b long")
    comps = connected(spark, links)
    assert {r["id"]: r["comp"] for r in comps.collect()} == dict.fromkeys(range(71), 0) | {100: 100, 101: 100}
    more = relink(spark, comps, spark.createDataFrame([(101, 50), (200, 201)], "a long, b long"))
    assert {r["id"]: r["comp"] for r in more.collect()} == dict.fromkeys([*range(71), 100, 101], 0) | {200: 200, 201: 200}


def test_shingles():
    texts = ["a b c d", "", "x", "a B c", "q r"]
    words = Words(texts)
    h, begins = shingles(words.hashes(), words.offsets, 3)
    assert np.diff(begins).tolist() == [2, 0, 1, 1, 1] and h[0] == h[3] and len(set(h.tolist())) == 4


ITEM = " ".join(f"word{i}" for i in range(40))


def leaks_of(spark, docs, items):
    got = find_leaks(spark, spark.createDataFrame(docs, KIND), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r["doc_id"], r["item_id"]): (round(r["similarity"], 4), r["first_word"]) for r in got}


def test_leaks(spark):
    noise = [f"n{i}" for i in range(300)]
    put = lambda x, at: " ".join([*noise[:at], x, *noise[at:]])
    one_off = ITEM.split()
    one_off[-1] = "other"
    docs = [
        (1, put(ITEM, 17)),
        (2, put(ITEM.upper().replace(" ", "!! "), 100)),
        (3, put(" ".join(one_off), 5)),
        (4, " ".join(noise)),
        (5, put(" ".join(ITEM.split()[:20]), 9)),
        (6, ITEM),
        (7, None),
        (8, "short tiny item"),
    ]
    got = leaks_of(spark, docs, [(10, ITEM), (11, None), (12, "Short tiny, item."), (13, "...")])
    assert got == {(1, 10): (1.0, 17), (2, 10): (1.0, 100), (3, 10): (round(35 / 37, 4), 4), (6, 10): (1.0, 0), (8, 12): (1.0, 0)}


def test_several_passes(spark, monkeypatch):
    import taxolyte.llm.decontamination as d

    items = [(i, " ".join(f"i{i}x{j}" for j in range(12))) for i in range(5)]
    docs = [(i, f"before {t} after") for i, t in items]
    once = leaks_of(spark, docs, items)
    monkeypatch.setattr(d, "INDEX_ITEMS", 2)
    assert leaks_of(spark, docs, items) == once == {(i, i): (1.0, 1) for i in range(5)}


def test_index_finds_all_within_radius(monkeypatch):
    import taxolyte.llm.decontamination as d

    rng = np.random.default_rng(6)
    rows = rng.integers(0, 1 << 63, (8000, 5), dtype=np.uint64)
    own = d.Items(list(range(8000)), rows)
    assert len(own.ids) > len(d._NEAR)
    prints = own.prints[:60].copy()
    for i in range(60):
        for bit in rng.choice(64, i % (RADIUS + 3), replace=False).tolist():
            prints[i] ^= np.uint64(1 << bit)
    want = {i: set(np.flatnonzero(np.bitwise_count(own.prints ^ p) <= RADIUS).tolist()) for i, p in enumerate(prints)}
    got = {w: set(items.tolist()) for w, items in own.near(prints)}
    assert got == {i: w for i, w in want.items() if w} and all(i in got[i] for i in range(60) if i % (RADIUS + 3) <= RADIUS)
    few = d.Items(list(range(100)), rows[:100])
    monkeypatch.setattr(d, "CELLS", 300)
    few_want = {i: {j for j in w if j < 100} for i, w in want.items()}
    assert {w: set(items.tolist()) for w, items in few.near(prints)} == {i: w for i, w in few_want.items() if w}


def brute_leaks(docs, items, similarity=0.8):
    """Every window of every text against every item."""
    split = lambda t: [w for w in (x.strip(PUNCTUATION) for x in (t or "").lower().split()) if w]
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    out = {}
    for doc, text in docs:
        words = split(text)
        for item, passage in items:
            want = split(passage)
            n, theirs = len(want), grams(want)
            for at in range(max(1, len(words) - n + 1)) if want and words else ():
                own = grams(words[at : at + n])
                common = sum((own & theirs).values())
                value = common / (sum(own.values()) + sum(theirs.values()) - common)
                if value >= similarity and value > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = (value, at)
    return {k: (round(v, 4), at) for k, (v, at) in out.items()}


def test_leaks_by_brute_force(spark):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([6, 15, 15, 30])))) for i in range(40)]
    docs = []
    for d in range(120):
        words = rng.choices(pool, k=rng.randrange(80))
        for _ in range(rng.randrange(3)):
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(4)):  # changed words at the ends and in the middle
                passage[rng.choice([0, -1, len(passage) // 2])] = rng.choice(pool)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage * rng.choice([1, 1, 2])
        docs.append((d, " ".join(words)))
    got = leaks_of(spark, docs, items)
    want = brute_leaks(docs, items)
    assert got == want and 50 < len(want) and any(v < 1 for v, _ in want.values())


def test_items_that_share_an_id_count_once(spark, monkeypatch):
    import taxolyte.llm.decontamination as d

    monkeypatch.setattr(d, "INDEX_ITEMS", 1)
    items = [(1, ITEM), (1, ITEM), (1, ITEM + " more"), (2, "something else that is long enough to be an item here")]
    rows = find_leaks(spark, spark.createDataFrame([(5, ITEM), (5, ITEM), (6, None), (None, ITEM)], KIND), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["similarity"]) for r in rows) == [("5", 1, 1.0), ("5", 1, 1.0), ("None", 1, 1.0)]


def test_repetitive_long_texts():
    item = " ".join(["la"] * 3000)
    index = Index([(1, item), (2, "la " * 40), (3, ITEM)])
    words = Words(["la " * 60_000], strip=True)
    own = words.hashes()
    hashes, _ = shingles(own, words.offsets, 5)
    assert index.match(own, index.hits(hashes), hashes, 0.9) == {1: (1.0, 0, 3000), 2: (1.0, 0, 40)}


def test_without_leaks(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the old river bank")], "item_id long, text string")
    out = without_leaks(spark, odd_docs, items)
    assert out.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == sorted(map(str, [2, 3, 4, 5, 7, None]))
    assert find_leaks(spark, no_docs, items).count() == 0
    assert find_leaks(spark, odd_docs, items.limit(0)).count() == 0


def test_short_items_are_found_in_longer_texts(spark):
    items = spark.createDataFrame([(1, "Hello, world"), (2, "one"), (3, "a b c d"), (4, "world hello")], "item_id long, text string")
    docs = [(10, "they said hello world. and hello world again then"), (11, "a b c"), (12, "x a b c d"), (13, "one")]
    got = find_leaks(spark, spark.createDataFrame(docs, KIND), items).collect()
    assert sorted(map(tuple, got)) == [(10, 1, 1.0, 2, 2), (12, 3, 1.0, 1, 4), (13, 2, 1.0, 0, 1)]


def test_items_longer_than_a_table_of_windows():
    rng = np.random.default_rng(3)
    item = " ".join(map(str, rng.integers(0, 10**6, 70_000)))
    index = Index([(1, item)])
    words = Words([f"before it {item} after it"], strip=True)
    own = words.hashes()
    hashes, _ = shingles(own, words.offsets, 5)
    assert index.match(own, index.hits(hashes), hashes, 0.9) == {1: (1.0, 2, 70_000)}


def test_chance_of_a_lost_link_is_the_one_stated():
    for threshold in (0.8, 0.85):
        steps = nd.least_matches(threshold)
        assert nd.lost(threshold, steps) <= nd.MISS < 3 * nd.lost(threshold, steps)
        rng = np.random.default_rng(2)
        batches = rng.binomial(nd.BATCH, threshold, (400_000, len(steps))).cumsum(1)
        seen = (batches < np.array([m for _, m in steps])).any(1).mean()
        assert abs(seen - nd.lost(threshold, steps)) < 3e-4


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    import taxolyte.llm.common as common

    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i % 7}") for i in range(300)], "i long, key string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k4", 3), ("other", 4)], "key string, x int")
    want = sorted(map(str, left.join(right, "key", "left").select("i", "key", "x").collect()))
    for rows, few in ((4096, 10), (50, 10), (0, 1)):
        monkeypatch.setattr(common, "HOT_ROWS", rows)
        monkeypatch.setattr(common, "FEW_HOT", few)
        got = common.join_unique(spark, left, right, "key", common.hot_keys(left, "key")).select("i", "key", "x").collect()
        assert sorted(map(str, got)) == want
        inner = common.join_unique(spark, left, right, "key", common.hot_keys(left, "key"), "inner").select("i", "key", "x").collect()
        assert sorted(map(str, inner)) == sorted(x for x in want if "x=None" not in x)


def test_recall_on_a_larger_corpus(spark):
    rows = corpus(7, 1500)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark, spark.createDataFrame(rows, KIND), 3, 85).collect()}
    want = {i: c for i, _, c, _ in brute(rows, 3, 85)}
    assert sum(got[i] != c for i, c in want.items()) <= 2


def test_index_of_few_items_is_small():
    import pickle

    items = [(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate(range(3, 60))]
    index = Index(items)
    assert len(pickle.dumps(index)) < 3_000_000  # tables that nothing looks up would take 1 MB for each length
