import random
import re
from collections import Counter
from math import comb

import numpy as np
from pyspark.sql import functions as F

from taxolyte.llm import quality_classifier as qc
from taxolyte.llm import quality_rules as qr


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(tri), set()
    for i, t in enumerate(tri):
        if n[t] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_base_metrics(spark, odd_docs):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 90))).replace("a b", "a\nb") + rng.choice(["", "#|", "é\x0b\n\n"]) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").unionByName(odd_docs.select("doc_id", "text", "lang"))
    got = qr.base_metrics(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = [(r["doc_id"], *(b := brute(r["text"])), b[0] < 50 or 100 * b[4] > 50 * b[0]) for r in docs.collect()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_binomial_tail(spark):
    cases = [(x, n) for n in (5, 9, 10, 40, 300) for x in (0, 1, 3, 7) if x <= n]
    df = spark.createDataFrame(cases, "x long, n long").select("x", "n", qr.binomial_tail(F.col("x"), F.col("n"), 0.1).alias("p"))
    for r in df.collect():
        exact = sum(comb(r["n"], i) * 0.1**i * 0.9 ** (r["n"] - i) for i in range(r["x"] + 1))
        assert r["p"] >= exact - 1e-9
        assert r["x"] >= r["n"] * 0.1 or abs(r["p"] - exact) < 1e-9


def labelled(spark, n=2400):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(4000)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(60, 120))]
        bad, toxic = i % 6 == 0, i % 11 == 5
        if bad:
            w = [x + "###" for x in w]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "nasty", "rotten"])
        rows.append((i, " ".join(w), "en" if i % 2 else "de", f"s{i % 5}"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_keep_good_and_reject_bad(spark):
    docs, labels = labelled(spark)
    m = qr.base_metrics(docs)
    out = {r["doc_id"]: r["kept"] for r in qr.judge(m, qr.fit_cutoffs(m, labels)).collect()}
    assert all(out[i] == (i % 6 != 0) for i in out)


def test_rules_reject_only_what_the_stratum_certifies(spark):
    docs, labels = labelled(spark)
    text = " ".join(f"word{i}###" for i in range(90))
    few = [(9000 + i, text.replace("word", f"x{i}"), "xx", "s1") for i in range(6)]  # a small language with good texts alone
    docs = docs.unionByName(spark.createDataFrame([*few, (9100, few[0][1], "en", "s1"), (9101, few[0][1], "zz", "s1")], docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(i, 1, 0) for i, *_ in few], labels.schema))
    m = qr.base_metrics(docs)
    out = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in qr.judge(m, qr.fit_cutoffs(m, labels)).collect()}
    assert not any(out[i][0] for i in range(9000, 9006)) and not out[9100][0]
    assert all(out[i][1] for i in range(9000, 9006)) and out[9101][1]
    # en has no bad labels, but enough good ones to certify the cutoff of all texts.
    assert not out[9100][1] and not any(out[i][1] for i in range(0, 2400, 6))


def test_rules_without_labels_or_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    m = qr.base_metrics(odd_docs)
    out = qr.judge(m, qr.fit_cutoffs(m, none)).collect()
    assert len(out) == odd_docs.count() and all(r["kept"] == (not r["base_failed"]) for r in out)
    m = qr.base_metrics(no_docs)
    assert qr.judge(m, qr.fit_cutoffs(m, none)).count() == 0


def test_classifier(spark):
    docs, labels = labelled(spark)
    out = {r["doc_id"]: r["kept"] for r in qc.classify(spark, docs, labels).collect()}
    unseen = [i for i in out if not (i % 2 == 0 or i % 3 == 0)]
    good = [i for i in out if i % 6 and i % 11 != 5]
    assert sum(not out[i] for i in good) <= len(good) * 0.005
    caught = [i for i in unseen if i % 11 == 5]
    assert sum(not out[i] for i in caught) >= len(caught) * 0.9
    kept = {r["doc_id"] for r in qc.keep_good(spark, docs, labels).collect()}
    assert kept == {i for i, k in out.items() if k}


def test_few_toxic_texts_tell_their_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = [(i, " ".join([*rng.choices(words, k=60), *(["scum", "vile"] if i % 15 == 0 else rng.choices(words, k=2))]), "en", "s") for i in range(180)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # 6 of 90 labelled texts are toxic.
    labels = spark.createDataFrame([(i, 1, int(i % 15 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["kept"] for r in qc.classify(spark, docs, labels).collect()}
    unseen = range(90, 180)
    assert not any(out[i] for i in unseen if i % 15 == 0)
    assert sum(out[i] for i in unseen if i % 15) >= 82
    found = qc._tails(np.array([5, 1, 8, 40]), np.array([5, 1, 2, 0]), 87, 11)
    exact = [comb(11, 5) / comb(87, 5), 11 / 87, sum(comb(11, j) * comb(76, 8 - j) for j in range(2, 9)) / comb(87, 8), comb(76, 40) / comb(87, 40)]
    assert np.allclose(found, 2 * np.array(exact))


def test_sites_shrink(spark):
    rows = [("big", "x", 0.5)] * 400 + [("low", "x", 0.1)] * 400 + [("one", "x", 1.0)]
    r = {x["host"]: x["path_rate"] for x in qc.site_rates(spark.createDataFrame(rows, "host string, path string, p_document double")).collect()}
    assert abs(r["big"] - 0.5) < 0.02 and abs(r["low"] - 0.1) < 0.02 and 0.3 < r["one"] < 0.95


def brute_rates(rows):
    """Posterior rates by the formulas, in plain loops."""
    paths = {}
    for host, path, p in rows:
        n, s = paths.get((host, path), (0, 0.0))
        paths[host, path] = (n + 1, s + p)
    hosts = {}
    for (host, _), (n, s) in paths.items():
        a, b = hosts.get(host, (0, 0.0))
        hosts[host] = (a + n, b + s)
    total = sum(n for n, _ in hosts.values())
    rate = sum(s for _, s in hosts.values()) / total
    spread = sum(n * (s / n - rate) ** 2 for n, s in hosts.values()) / total - len(hosts) / total * rate * (1 - rate)
    k = max(1.0, min(1e6, rate * (1 - rate) / max(spread, 1e-9)))
    host_rate = {h: (k * rate + s) / (k + n) for h, (n, s) in hosts.items()}
    noise = {h: r * (1 - r) for h, r in host_rate.items()}
    spread = sum(n * (s / n - host_rate[h]) ** 2 for (h, _), (n, s) in paths.items()) / total - sum(noise[h] for h, _ in paths) / total
    k = max(1.0, min(1e6, sum(noise[h] for h, _ in paths) / len(paths) / max(spread, 1e-9)))
    return {(h, p): (host_rate[h], (k * host_rate[h] + s) / (k + n)) for (h, p), (n, s) in paths.items()}


def site_rows():
    rng = random.Random(12)
    level = {(h, p): rng.random() * (0.6 if h < 3 else 0.1) for h in range(9) for p in range(4)}
    return [(f"h{h}", f"p{p}", min(0.99, max(0.01, rng.gauss(level[h, p], 0.1)))) for h, p in rng.choices(list(level), weights=[1 + 30 * (h == 0) for h, _ in level], k=900)]


def test_site_rates_by_brute_force(spark):
    rows = site_rows()
    want = brute_rates(rows)
    got = qc.site_rates(spark.createDataFrame(rows, "host string, path string, p_document double")).collect()
    assert {(r["host"], r["path"]) for r in got} == set(want)
    for r in got:
        assert np.allclose((r["host_rate"], r["path_rate"]), want[r["host"], r["path"]], rtol=1e-9)


def test_verdicts_by_brute_force(spark, monkeypatch):
    docs, labels = labelled(spark, 600)
    out = qc.classify(spark, docs, labels).collect()
    rates = brute_rates([(r["host"], r["path"], r["p_document"]) for r in out])
    base = qc.fit(spark, docs, labels).base
    logit = lambda p: np.log(min(max(p, 1e-9), 1 - 1e-9) / (1 - min(max(p, 1e-9), 1 - 1e-9)))
    for r in out:
        odds = logit(r["p_document"]) - logit(base) + logit(rates[r["host"], r["path"]][1])
        assert abs(r["p_bad"] - 1 / (1 + np.exp(-odds))) < 1e-6 and r["kept"] == (r["p_bad"] < qc.REJECT)
    monkeypatch.setattr(qc, "FEW_SITES", 0)  # the other way to join
    again = {r["doc_id"]: (r["p_bad"], r["kept"]) for r in qc.classify(spark, docs, labels).collect()}
    assert all(abs(again[r["doc_id"]][0] - r["p_bad"]) < 1e-9 and again[r["doc_id"]][1] == r["kept"] for r in out)


def test_classifier_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert qc.classify(spark, odd_docs, labels).count() == odd_docs.count()
    kept = qc.keep_good(spark, odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert qc.classify(spark, no_docs, labels).count() == 0
