import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from taxolyte.llm import lm_score as lm
from taxolyte.llm.tokens import default_tokenizer


@pytest.fixture(autouse=True)
def quick(monkeypatch):
    monkeypatch.setattr(lm, "LEAST_IDS", 500_000)
    monkeypatch.setattr(lm, "HEAD", 30)


def pairs_of(windows):
    pairs, n = np.unique(windows[:, :-1].ravel() << 16 | windows[:, 1:].ravel(), return_counts=True)
    return pairs >> 16, pairs & 0xFFFF, n


def model_of(rng, n=400, ids=500):
    windows = rng.integers(0, 300, (n, 81))
    windows[:, 1::2] = (windows[:, ::2][:, : windows[:, 1::2].shape[1]] * 7 + 1) % 300
    last, own, times = pairs_of(windows)
    counts = np.bincount(own, times, ids)
    rank = np.argsort(np.argsort(-counts, kind="stable"))
    width, context = lm.CONTEXTS + 1, np.minimum(rank, lm.CONTEXTS)
    place = np.concatenate([last * 2 * width + context[own], own * 2 * width + width + context[last]])
    cells, which = np.unique(place, return_inverse=True)
    row, klass, embedding = lm.structure(counts, (cells, np.bincount(which, np.tile(times, 2))))
    follow = np.bincount(last * lm.CLASSES + klass[own], times, ids * lm.CLASSES).reshape(-1, lm.CLASSES)
    model = lm.untrained(row, klass, embedding, follow)
    model.learn(iter([list(windows)]))
    return windows, model, rank, follow


def test_next_ids_are_a_distribution():
    rng = np.random.default_rng(1)
    windows, model, rank, follow = model_of(rng)
    last_, own, times = pairs_of(windows)
    counts = np.bincount(own, times, 500)
    dense = np.zeros((40, 60), np.float32)
    inside = (rank[last_] < 40) & (rank[own] < 60)
    dense[rank[last_[inside]], rank[own[inside]]] = times[inside]
    keys, n = (last_ << 16 | own)[~inside], times[~inside]
    within = lm.Within.of(model.klass, counts, rank, follow, dense, keys, n, True)
    ids = rng.integers(0, 300, 40)
    for at in (39, 17):
        total = 0
        for last in range(500):  # every id as the one that follows
            stream = ids.copy()
            stream[at] = last
            cells, filled, text = lm._blocks([stream])
            before, first = lm._before(cells, text)
            more, missing = within.log(before, cells)
            place = divmod(at, lm.BLOCK)
            assert not len(missing)
            total += np.exp(model.class_log(model.row[before], first, model.klass[cells])[place] + more[place])
        assert abs(total - 1) < 1e-3
    # Counts that are left out are named, and a join that adds them gives the same.
    some = lm.Within.of(model.klass, counts, rank, follow, np.zeros_like(dense), keys[::2], n[::2], False)
    cells, _, text = lm._blocks(list(windows[:5]))
    before, _ = lm._before(cells, text)
    whole, part, missing = within.log(before, cells)[0], *some.log(before, cells)
    share = np.exp(within.share.astype(float))
    table = dict(zip(keys.tolist(), n.tolist()))
    part = part.ravel()
    for i in missing.tolist():
        b, x = before.ravel()[i], cells.ravel()[i]
        part[i] += np.log1p(table.get(int(b << 16 | x), 0) / (lm.MU * share[x]))
    head = ((rank[before] < 40) & (rank[cells] < 60)).ravel()
    assert np.allclose(part[~head], whole.ravel()[~head], atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(5)
    _, model, _, _ = model_of(rng, 60)
    cells, filled, text = lm._blocks([rng.integers(0, 300, n) for n in (5, 70, 33)])
    before, first = lm._before(cells, text)
    rows, target = model.row[before], model.klass[cells]
    for a, b in ((0, len(cells)), (2, 6)):
        used = np.zeros_like(filled)
        used[a:b] = filled[a:b]
        got = model.gradients(rows, first, target, filled, a, b)
        base = {k: x.copy() for k, x in model.weights.items()}
        for name in base:
            for place in [tuple(rng.integers(0, n) for n in base[name].shape) for _ in range(4)]:
                losses = []
                for step in (3e-3, -3e-3):
                    changed = {k: x.copy() for k, x in base.items()}
                    changed[name][place] += step
                    model.set_weights(changed)
                    losses.append(-model.class_log(rows, first, target)[used].astype(float).mean())
                assert abs((losses[0] - losses[1]) / 6e-3 - got[name][place]) < 2e-3 + 0.05 * abs(got[name][place])
        model.set_weights(base)


def test_a_step_is_the_plain_gradient_in_small_tables():
    rng = np.random.default_rng(11)
    _, model, _, _ = model_of(rng, 60)
    cells, filled, text = lm._blocks([rng.integers(0, 300, n) for n in (5, 4000, 1, 33, 4200)])
    before, first = lm._before(cells, text)
    rows, target = model.row[before], model.klass[cells]
    a, b = 1, len(cells)
    assert b - a > lm.STEP_BLOCKS
    w = {k: x.astype(float) for k, x in model.weights.items()}
    want = {k: np.zeros_like(x) for k, x in w.items()}
    for i in range(a, b):  # block by block, each projection written out
        e = np.concatenate([model.embedding[rows[i - 1]], model.embedding[rows[i]]]).astype(float)
        own = e[lm.BLOCK :]
        q, k, v = own @ w["q"] / np.sqrt(lm.WIDTH), e @ w["k"], e @ w["v"]
        p = np.exp(q @ k.T + w["near"][lm._NEAR] + lm._CAUSAL)
        if first[i]:
            p[:, : lm.BLOCK] = 0
        p /= p.sum(1, keepdims=True)
        z = np.exp(p @ v @ w["out"] + model.direct[rows[i]])
        z /= z.sum(1, keepdims=True)
        z[np.arange(lm.BLOCK), target[i]] -= 1
        z *= filled[i][:, None] / filled[a:b].sum()
        dp = z @ w["out"].T @ v.T
        ds = p * (dp - (p * dp).sum(1, keepdims=True))
        want["out"] += (p @ v).T @ z
        want["v"] += e.T @ p.T @ z @ w["out"].T
        want["q"] += own.T @ ds @ k / np.sqrt(lm.WIDTH)
        want["k"] += e.T @ ds.T @ q
        np.add.at(want["near"], lm._NEAR, ds)
    tracemalloc.start()
    got = model.gradients(rows, first, target, filled, a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.keys() == want.keys()
    for name, x in want.items():
        assert np.allclose(got[name], x, atol=1e-5 + 1e-3 * np.abs(x).max()), name
    assert most < 3 << 20  # near the cache of a core; a step's tables took 12 MB


def test_attention_learns_what_pairs_cannot_tell():
    # The id after a 7 is the one that came two before it; pairs alone can't say which.
    rng = np.random.default_rng(6)
    first = rng.integers(10, 14, (600, 20))
    windows = np.stack([first, np.full_like(first, 7), first + 10, np.full_like(first, 8)], 2).reshape(600, -1)
    last, own, times = pairs_of(windows)
    counts = np.bincount(own, times, 30)
    klass = np.arange(30)
    row = np.arange(30)
    embedding = np.random.default_rng(0).normal(0, 1, (lm.ROWS + lm.CLASSES, lm.WIDTH)).astype(np.float32)
    follow = np.zeros((30, lm.CLASSES))
    np.add.at(follow, (last, klass[own]), times)
    model = lm.untrained(row, klass, embedding, follow)

    def loss():
        cells, filled, text = lm._blocks(list(windows[500:]))
        before, begins = lm._before(cells, text)
        return -model.class_log(model.row[before], begins, model.klass[cells])[filled].mean()

    start = loss()
    model.learn(iter([list(windows[:500])] * 40))
    assert loss() < start - 0.2


def test_every_training_text_counts(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(80)]
    train_ids = [i for i, _ in docs if not lm.held_out(i)]

    def weights(rows):
        seen = lm.materialize(spark, lm._count(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), default_tokenizer()), "seen")
        model, within, _ = lm.fit(spark, seen, 49152)
        return model.weights["q"], float(within.share.sum())

    base = weights(docs)
    for i in (train_ids[0], train_ids[-1]):
        changed = weights([(j, t if j != i else "entirely different things are said here " * 9) for j, t in docs])
        assert not np.array_equal(base[0], changed[0]) and base[1] != changed[1]
    held = next(i for i, _ in docs if lm.held_out(i))
    same = weights([(j, t if j != held else "entirely different things") for j, t in docs])
    assert np.array_equal(base[0], same[0]) and base[1] == same[1]


def test_pairs_beyond_the_broadcast_are_joined(spark, monkeypatch):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=60))) for i in range(60)] + [(70, ""), (71, None)], "doc_id long, text string")
    scores = lambda: {r["doc_id"]: r["score"] for r in lm.score_texts(spark, docs.coalesce(1), default_tokenizer()).collect()}
    want = scores()
    monkeypatch.setattr(lm, "COLUMNS", 20)
    monkeypatch.setattr(lm, "PAIRS", 30)
    got = scores()
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 + 1e-4 * abs(want[i]) for i in want)


def test_odd_rows(spark, odd_docs):
    out = lm.score_texts(spark, odd_docs, default_tokenizer()).collect()
    assert len(out) == odd_docs.count() and all(math.isfinite(r["score"]) for r in out)


def test_blocks_are_causal_and_windows_overlap():
    rng = np.random.default_rng(2)
    _, model, _, _ = model_of(rng)
    ids = rng.integers(0, 300, 200)

    def logs(stream):
        cells, filled, text = lm._blocks([stream])
        before, first = lm._before(cells, text)
        return model.class_log(model.row[before], first, model.klass[cells])[filled]

    base = logs(ids)
    changed = ids.copy()
    changed[100] = (changed[100] + 1) % 300
    other = logs(changed)
    assert np.allclose(base[:100], other[:100], atol=1e-5) and not np.allclose(base[101:112], other[101:112], atol=1e-6)
    assert np.allclose(base[100 + 2 * lm.BLOCK + 1 :], other[100 + 2 * lm.BLOCK + 1 :], atol=1e-5)
    many = [ids[:5], ids, ids[:17], ids[:0]]
    cells, filled, text = lm._blocks([np.append(x, 1) for x in many])
    before, first = lm._before(cells, text)
    together = model.class_log(model.row[before], first, model.klass[cells])
    for i, x in enumerate(many):
        assert np.allclose(together[text == i][filled[text == i]], logs(np.append(x, 1)), atol=1e-4)


def test_scores(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(80)]
    docs = [(i, " ".join(rng.choices(words, weights=range(80, 0, -1), k=rng.randint(0, 120))).title() if i % 5 else None) for i in range(150)]
    docs += [(3, "repeated row"), (3, "repeated row"), (None, "no id x"), (200, "word " * 9000)]
    out = lm.score_texts(spark, spark.createDataFrame(docs, "doc_id long, text string"), default_tokenizer()).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0 if i is not None else True
    c = Counter(w for i, t in docs if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        ((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for i, t in docs for w in [split(t)]), key=str
    )
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out), key=str)
    assert got == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    same = {r["score"] for r in out if r["doc_id"] == 3 and r["n_tokens"] == 3}
    assert len(same) == 1


def test_model_learns(spark):
    rng = random.Random(4)
    docs = []
    for i in range(400):
        w = [rng.randrange(40)]
        for _ in range(80):
            w.append((w[-1] * 3 + rng.choice([1, 1, 1, 7])) % 40)
        docs.append((i, " ".join(f"tok{'abcdefghij'[x % 10]}{'klmn'[x // 10]}" for x in w)))
    out = lm.score_texts(spark, spark.createDataFrame(docs, "doc_id long, text string"), default_tokenizer()).collect()
    unseen = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in unseen) > 0.8 * sum(r["base_score"] for r in unseen)


def test_empty(spark, no_docs):
    assert lm.score_texts(spark, no_docs, default_tokenizer()).count() == 0


def test_texts_are_split_once_for_words_and_ids(monkeypatch):
    from taxolyte.llm.tokens import TextEncoder, chunked
    from taxolyte.llm.words import Words

    encoder = TextEncoder(default_tokenizer())
    for texts in (["The the THE  cat's é É\n\nà\u00a0b x", "", "\n \n", " end "], ["a\tB c\fd", "e\rf\x0bg h"], []):
        chunks = chunked(texts)
        got, want = Words.of_chunks(texts, *chunks), Words(texts)
        assert got.hashes().tolist() == want.hashes().tolist() and got.offsets.tolist() == want.offsets.tolist()
        assert list(encoder.encode_chunks(*chunks)) == list(encoder.encode_many(texts))


def test_counting_remembers_many_pieces(monkeypatch):
    import pyarrow as pa

    from taxolyte.llm import lm_score, tokens

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    asked = []
    real = tokens.TextEncoder.of_worker
    monkeypatch.setattr(lm_score.TextEncoder, "of_worker", lambda path, most=tokens.MAX_ENTRIES: asked.append(most) or real(path, most))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two", None])], ["doc_id", "text"])
    assert sum(x.num_rows for x in lm_score._count(Docs(), tokens.default_tokenizer())([batch])) > 2
    assert asked[0] > tokens.MAX_ENTRIES
