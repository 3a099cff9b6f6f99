import math
from collections import Counter
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taxolyte.operators import agreement, fragment, graph, recovery, resample, retrieval, sampling, stats, vectors


def test_kruskal(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3)] + [("b", x) for x in (4, 5, 6)], "g string, v int")
    r = stats.kruskal(df, "g", "v").first()
    assert math.isclose(r["h"], 3.857142857, rel_tol=1e-8) and math.isclose(r["eps2"], 0.7142857143, rel_tol=1e-8)
    assert math.isclose(stats.kruskal_p(r), 0.0495346134, rel_tol=1e-7)
    ties = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 3), ("b", 4), ("c", 5), ("c", 5), ("c", 6)], "g string, v int")
    r = stats.kruskal(ties, "g", "v").first()
    assert math.isclose(r["h"], 6.7710144928, rel_tol=1e-8) and math.isclose(r["eps2"], 0.7951690821, rel_tol=1e-8)
    assert stats.kruskal(df.filter("g = 'a'"), "g", "v").first()["h"] is None


def test_spearman(spark):
    df = spark.createDataFrame(list(zip(range(1, 9), (1, 2, 2, 4, 5, 6, 8, 7), strict=True)), "x int, y int")
    assert math.isclose(stats.spearman(df, "x", "y").first()["rho"], 0.9700772721, rel_tol=1e-8)
    assert stats.spearman(df.limit(7), "x", "y").first()["rho"] is None


def test_gini_and_bh(spark):
    df = spark.createDataFrame([(2015,), (2016,), (2020,)], "y int")
    assert math.isclose(stats.gini(df, "y").first()["gini"], 0.5555555553, rel_tol=1e-6)
    p = spark.createDataFrame([(0.001,), (0.02,), (0.03,), (0.2,), (None,)], "p double")
    rows = sorted(stats.benjamini_hochberg(p, "p").collect(), key=lambda r: r["p"])
    assert [round(r["crit"], 4) for r in rows] == [0.0125, 0.025, 0.0375, 0.05] and [r["reject"] for r in rows] == [True, True, True, False]


def test_chi_square(spark):
    cells = [[10, 20, 30], [6, 9, 17]]
    df = spark.createDataFrame([(i, j) for i in range(2) for j in range(3) for _ in range(cells[i][j])], "a int, b int")
    r = stats.chi_square(df, "a", "b").first()
    assert math.isclose(r["chi2"], 0.2715746515, rel_tol=1e-8) and math.isclose(r["cramers_v"], 0.0543313757, rel_tol=1e-8) and r["dof"] == 2


def test_kendall_w(spark):
    df = spark.createDataFrame([(1, 1, 2, 1), (2, 2, 1, 3), (3, 3, 3, 2), (4, 4, 4, 4)], "u int, a int, b int, c int")
    r = stats.kendall_w(df, "u", "a", "b", "c").first()
    assert math.isclose(r["w"], 0.7777777778, rel_tol=1e-8) and math.isclose(r["chi2"], 7.0, rel_tol=1e-8)


def test_linear_fit(spark):
    df = spark.createDataFrame([(float(x), float(z), 1 + 2.0 * x - 3.0 * z) for x in range(4) for z in range(3)] + [(float("nan"), 1.0, 1.0)], "x double, z double, y double")
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(stats.linear_fit(df, "y", "x", "z"), (1, 2, -3), strict=True))


def test_k50(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("d", 1)], "u string, n int")
    assert stats.smallest_half(df, "u", "n").first()["k50"] == 1


@pytest.fixture
def keyed(spark):
    keys = {"k1": "ab", "k2": "abc", "k3": "bc", "k4": "d", "k5": "cd"}
    return spark.createDataFrame([(j, k) for k, js in keys.items() for j in js], "job string, key string")


def test_jaccard(keyed):
    got = {(r["u"], r["v"]): round(r["w"], 6) for r in graph.jaccard_edges(keyed, "job", "key").collect()}
    assert got == {("a", "b"): 0.666667, ("a", "c"): 0.25, ("b", "c"): 0.5, ("c", "d"): 0.333333}
    got = {(r["u"], r["v"]): round(r["w"], 6) for r in graph.jaccard_edges(keyed, "job", "key", least=1).collect()}
    assert got["c", "d"] == 0.25
    assert not graph.jaccard_edges(keyed, "job", "key", drop_share=0.5).filter("u = 'a' AND v = 'c'").collect()


def test_tfidf(keyed):
    got = {(r["u"], r["v"]): round(r["w"], 6) for r in graph.tfidf_edges(keyed, "job", "key").collect()}
    assert got == {("a", "b"): 0.734608, ("a", "c"): 0.107946, ("b", "c"): 0.539649, ("c", "d"): 0.678492}


def test_components_and_louvain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node int")
    links = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 0.1), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0)]
    edges = spark.createDataFrame(links, "u int, v int, w double")
    comps = {r["node"]: r["comp"] for r in graph.components(spark, nodes, edges).collect()}
    assert comps == dict.fromkeys(range(6), 0) | {6: 6, 7: 7}
    for order in (links, links[::-1]):
        c = graph.louvain(spark, nodes, spark.createDataFrame(order, "u int, v int, w double"))
        assert {r["node"]: r["community"] for r in c.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7}
    q = graph.modularity(edges, c).first()["q"]
    assert math.isclose(q, 6 / 6.1 - 2 * (6.1 / 12.2) ** 2, rel_tol=1e-9)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u int, v int")
    comps = graph.components(spark, edges.select(F.col("u").alias("node")), edges)
    assert {r["comp"] for r in comps.collect()} == {0}


@pytest.mark.parametrize(
    ("true", "pred", "nmi", "ari", "ami"),
    [((0, 0, 1, 1), (0, 0, 0, 1), 0.3437110185, 0, 0), ((0, 0, 0, 1, 1, 1, 2, 2), (0, 0, 1, 1, 1, 2, 2, 2), 0.5588730382, 0.2380952381, 0.3196725707)],
)
def test_partition_scores(spark, true, pred, nmi, ari, ami):
    df = spark.createDataFrame(list(zip(true, pred, strict=True)), "t int, p int")
    r = agreement.partition_scores(df, "t", "p").first()
    assert math.isclose(r["nmi"], nmi, rel_tol=1e-8) and math.isclose(r["ari"], ari, abs_tol=1e-9)
    assert math.isclose(agreement.ami(df, "t", "p"), ami, abs_tol=1e-6)


def ratings(spark, items):
    return spark.createDataFrame([(i, f"r{j}", v) for i, vs in enumerate(items) for j, v in enumerate(vs)], "item int, rater string, verdict string")


def test_raters(spark):
    j = ratings(spark, [["same", "same", "related"], ["same", "same"], ["related", "related", "unsure"], ["hierarchy", "same"], ["unsure"]])
    assert math.isclose(agreement.krippendorff(j).first()["alpha"], 0.15625)
    m = {r["item"]: r["majority"] for r in agreement.majority(j).collect()}
    assert m == {0: "same", 1: "same", 2: "related", 3: None, 4: "unsure"}
    k = spark.createDataFrame(list(zip("ssnnsn", "snnnss", strict=True)), "a string, b string")
    assert math.isclose(agreement.cohen_kappa(k, "a", "b").first()["kappa"], 1 / 3)
    c = {r["item"]: r["consensus"] for r in agreement.consensus(j).collect()}
    assert c[1] == "unanimous" and c[0] == "3-1"


def test_resampling_is_repeatable(spark):
    df = spark.createDataFrame([(float(i % 3), 2.0) for i in range(40)], "a double, b double")
    first, again = (resample.bootstrap_ratio(spark, x, "a", "b", n=200).first() for x in (df, df.orderBy(F.desc("a"))))
    assert first == again and first["lo"] <= first["estimate"] <= first["hi"]
    labels = spark.createDataFrame([(i % 4, i % 4) for i in range(40)], "t int, p int")
    assert resample.permutation_null(spark, labels, "t", "p", n=50).first()["p"] == 1 / 51


def test_resampling_takes_more_rows_than_fit_the_driver(spark, monkeypatch):
    # 3,000,000 rows of three values: the interval of the mean is about 1.96 deviations wide on each side.
    df = spark.range(3_000_000).select(F.pmod("id", F.lit(3)).cast("double").alias("x"), F.pmod("id", F.lit(2)).alias("t"))
    r = resample.bootstrap_difference(spark, df, "x", n=400).first()
    half = 1.96 * math.sqrt(2 / 3 / 3_000_000)
    assert math.isclose(r["mean"], 1) and abs(1 - r["lo"] - half) < half / 4 and abs(r["hi"] - 1 - half) < half / 4
    p = resample.permutation_null(spark, df, "t", "x", n=50).first()
    # 2 * rows * mutual information is about chi-square with 2 degrees of freedom; the entropies are ln 2 and ln 3.
    assert 0.5 < p["null_mean"] * 6_000_000 * (math.log(2) + math.log(3)) / 2 / 2 < 1.5
    # Several buckets draw as one.
    some = spark.range(900).select((F.col("id") / 900).alias("x"))
    one = resample.bootstrap_difference(spark, some, "x", n=400).first()
    monkeypatch.setattr(resample, "BUCKET", 100)
    many = resample.bootstrap_difference(spark, some, "x", n=400).first()
    assert math.isclose(one["mean"], many["mean"]) and abs((one["hi"] - one["lo"]) / (many["hi"] - many["lo"]) - 1) < 0.25


def test_vectors(spark):
    rows = [(i, [math.cos(i / 3), math.sin(i / 3)]) for i in range(12)] + [(99, [0.0, 0.0]), (100, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    for block in (3, 100):
        got = {(r["i"], r["j"]) for r in vectors.cosine_pairs(df, "k", "v", 0.9, block).collect()}
        assert got == {(i, j) for i in range(12) for j in range(i + 1, 12) if math.cos((j - i) / 3) >= 0.9}
    sims = spark.createDataFrame([(0, 1, 0.99), (0, 2, 0.95), (1, 2, 0.95), (1, 3, 0.9)], "i int, j int, sim double")
    assert tuple(vectors.matched_threshold(sims, 2).first()) == (0.95, 3)
    assert vectors.check_unit(df, "v").first().asDict() == {"n_not_finite": 1, "n_not_unit": 1, "n": 14}


def test_single_linkage_and_recovery(spark):
    pairs = spark.createDataFrame([(0, 1, 0.95), (1, 2, 0.90), (3, 4, 0.86)], "i int, j int, sim double")
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node int")
    edges = pairs.filter("sim >= 0.9")
    c = graph.components(spark, nodes, edges.select(F.col("i").alias("u"), F.col("j").alias("v")))
    assert sorted(r["comp"] for r in c.collect()) == [0, 0, 0, 3, 4, 5]
    truth = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, "d")], "node int, concept string")
    r = recovery.cluster_truth(c, edges, truth).first()
    assert (r["n_clusters"], r["absorbed"], r["verified"], r["n_transitive"]) == (1, 2, 1, 1)
    layer = {r["node"]: r["concept"] for r in recovery.concept_layer(nodes, c, cap=2).collect()}
    assert layer == {i: f"k:{i}" for i in range(6)}


def test_fragmentation(spark):
    tok = spark.createDataFrame([("j1", "a", "Ab", "ab"), ("j2", "b", "ab", "ab"), ("j1", "a", "c", "c"), ("j1", "a", "-", "")], "job string, major string, surface string, key string")
    r = fragment.index(tok).first()
    assert (r["n_surfaces"], r["n_keys"], r["n_merged"], r["type_mismatch"]) == (4, 2, 1, 0.5)
    assert fragment.aliases(tok).first()["surfaces"] == "Ab|ab"


def test_sampling(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "s int, u int")
    halves = sampling.split_half(df, "s", "u")
    assert {(r["s"], r["half"]): r["n"] for r in halves.groupBy("s", "half").agg(F.count("*").alias("n")).collect()} == {(s, h): 5 for s in range(3) for h in "AB"}
    assert sorted(halves.collect()) == sorted(sampling.split_half(df.orderBy(F.desc("u")), "s", "u").collect())
    assert sampling.stratified(df, "s", ["u"], 4).count() == 12
    assert sampling.split_half_exact({"x": ["b", "a", "c"]}) == sampling.split_half_exact({"x": ["c", "b", "a"]})


def test_transitive_sample_leaves_no_cluster_out(spark):
    # Chains of three, cliques of six less one edge, and cliques, which have no pair to offer.
    clusters, edges, free = [], [], {}
    for c in range(30):
        n = (3, 6, 5)[c % 3]
        nodes = list(range(10 * c, 10 * c + n))
        gap = ((nodes[0], nodes[2]), (nodes[1], nodes[-2]), None)[c % 3]
        clusters += [(c, x) for x in nodes]
        edges += [(a, b) for a in nodes for b in nodes if a < b and (a, b) != gap]
        free |= {c: gap} if gap else {}
    clusters, edges = spark.createDataFrame(clusters, "comp int, node int"), spark.createDataFrame(edges, "i int, j int")
    assert {r["comp"]: (r["i"], r["j"]) for r in sampling.transitive_sample(clusters, edges, 100).collect()} == free
    assert sampling.transitive_sample(clusters, edges, 7).count() == 7
    # Uniform in a cluster: a path of four has three pairs without an edge.
    many = spark.createDataFrame([(c, 4 * c + x) for c in range(600) for x in range(4)], "comp int, node int")
    path = spark.createDataFrame([(4 * c + x, 4 * c + x + 1) for c in range(600) for x in range(3)], "i int, j int")
    n = Counter((r["i"] % 4, r["j"] % 4) for r in sampling.transitive_sample(many, path, 600).collect())
    assert set(n) == {(0, 2), (0, 3), (1, 3)} and all(150 < x < 250 for x in n.values())


def test_retrieval(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "q int")
    answers, truth = (spark.createDataFrame(x, "q int, item string") for x in ([(1, "a"), (1, "b"), (2, "z")], [(1, "a"), (2, "a"), (3, "a")]))
    r = retrieval.precision_recall(q, answers, truth).first()
    assert math.isclose(r["precision"], 0.5 / 3) and math.isclose(r["recall"], 1 / 3) and math.isclose(r["precision_answered"], 0.25)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "job string, key string")
    assert graph.jaccard_edges(e, "job", "key").count() == 0
    assert stats.kruskal(e, "job", "key").first()["h"] is None
    assert vectors.cosine_pairs(spark.createDataFrame([], "k int, v array<double>"), "k", "v", 0.5).count() == 0


def test_pairwise_agreement_makes_no_row_for_a_shared_item(spark, monkeypatch):
    def brute(rows):
        out = {}
        for a, x, v in rows:
            for b, y, w in rows:
                if None not in (a, b, x, y) and x == y and a < b:
                    n, same, seen = out.get((a, b), (0, 0, 0))
                    out[a, b] = n + 1, same + (None not in (v, w) and v == w), seen + (None not in (v, w))
        return {k: (n, same / seen if seen else None) for k, (n, same, seen) in out.items()}

    dense = [(f"r{r:02}", r * 7 % 3 + x, (None, "a", "b")[(r * x + r // 3) % 3]) for r in range(30) for x in range(8) if (r + x) % 4] + [("r00", 3, "a"), ("r00", 3, "a"), (None, 1, "a"), ("r01", None, "a")]
    sparse = [(f"r{r:02}", r // 3, (None, "a", "b")[r % 3]) for r in range(30)] + [("r00", 0, "a"), ("r01", 0, "a")]
    monkeypatch.setattr(agreement, "STRIPE", 5)
    monkeypatch.setattr(agreement, "WIDTH", 3)
    monkeypatch.setattr(agreement, "OUT", 2)
    for rows, joined in ((dense, False), (sparse, True), ([], False)):
        for block in (7, 100):
            df = agreement.pairwise(spark.createDataFrame(rows, "rater string, item long, verdict string"), block=block)
            got = {(r["r1"], r["r2"]): (r["n"], r["agreement"]) for r in df.collect()}
            assert got == brute(rows)
            assert ("Join" in df._jdf.queryExecution().toString()) == joined


def rows_from_python(plan):
    """Rows that workers returned to the last such node of an executed plan."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    if plan.nodeName() == "ResultQueryStage":
        plan = plan.plan()
    if "InArrow" in plan.nodeName():
        return plan.metrics().apply("pythonNumRowsReceived").value()
    children = plan.children()
    return sum(rows_from_python(children.apply(i)) for i in range(children.size()))


def test_pairwise_agreement_makes_its_rows_outside_of_python(spark, monkeypatch):
    rows = [(r, x, (None, "a", "b", "c")[(r * x + r // 3) % 4]) for r in range(40) for x in range(7) if (r + x) % 5]
    df = agreement.pairwise(spark.createDataFrame(rows, "rater long, item string, verdict string"))
    got = sorted(df.collect())
    assert len(got) == 780 and rows_from_python(df._jdf.queryExecution().executedPlan()) == 1
    day = lambda r: date(2020, 1, 1) + timedelta(r)
    monkeypatch.setattr(agreement, "OUT", 7)
    days = agreement.pairwise(spark.createDataFrame([(day(r), x, v) for r, x, v in rows], "rater date, item string, verdict string"), block=11, digits=2)
    want = [(day(a), day(b), n, None if s is None else float(Decimal(repr(s)).quantize(Decimal("0.01"), ROUND_HALF_UP))) for a, b, n, s in got]
    assert sorted(map(tuple, days.collect())) == want


def test_figures_of_blocks(monkeypatch):
    draw = np.random.default_rng(5)
    figures = [draw.integers(0, top, 500).astype(np.float32) for top in (9, 3, 4000)]
    for codes in (2, 20, 9 * 3, 1 << 20):  # those too many for a table are sorted
        monkeypatch.setattr(agreement, "CODES", codes)
        first, code = agreement._coded(figures)
        assert len(first) == len(set(zip(*figures, strict=True))) and all((f[first][code] == f).all() for f in figures)
    left, right = (pa.table({"row": pa.array(draw.integers(0, 12, 90)), "x": pa.array(draw.integers(0, 8, 90)), "c": pa.array(draw.integers(1, 4, 90))}) for _ in range(2))
    want = np.zeros((2, 12, 8))
    for m, t in zip(want, (left, right), strict=True):
        np.add.at(m, (t["row"].to_numpy(), t["x"].to_numpy()), t["c"].to_numpy())
    for width in (3, 100):
        monkeypatch.setattr(agreement, "WIDTH", width)
        product = agreement._Product(agreement._matrices(left, right, ["x"]), 12)
        assert (np.vstack([product.rows(0, 5), product.rows(5, 12)]) == want[0] @ want[1].T).all()


def test_counts_of_pairs_without_pairs(spark):
    n = 60
    vec = [[math.cos(i * i / 9), math.sin(i * i / 9), (i % 4) / 3] for i in range(n)] + [[0.0, 0.0, 0.0], None]
    label = [(None, "a", "b", "c")[i * i % 7 % 4] for i in range(n + 2)]
    df = spark.createDataFrame([(i, v, x) for i, (v, x) in enumerate(zip(vec, label, strict=True))], "k int, v array<double>, x string")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.hypot(*a) / math.hypot(*b)
    near = {i: [j for j in range(n) if j != i and cosine(vec[i], vec[j]) >= 0.7] for i in range(n)}
    want = {i: (len(m), sum(label[i] is not None and label[i] == label[j] for j in m)) for i, m in near.items() if m}
    for block in (16, 100):
        assert {r["k"]: (r["n"], r["same"]) for r in vectors.similar_counts(df, "k", "v", "x", 0.7, block).collect()} == want
    group = [i % 5 if i < 20 else i for i in range(n)]
    nodes = spark.createDataFrame(list(zip(range(n), group, label, strict=False)), "node int, grp int, concept string")
    others = lambda by: lambda i, j: i != j and by[i] is not None and by[i] == by[j]
    truth, queries = [(i, j) for i in range(n) for j in range(n) if others(label)(i, j)], spark.createDataFrame([(i,) for i in range(n)], "q int")
    got = {r["layer"]: r for r in retrieval.by_partitions(nodes.groupBy("grp", "concept").agg(F.count("*").alias("m")), {"le3": 3, "all": None}).collect()}
    for layer, answers in (("le3", [(-1, -1)]), ("all", [(i, j) for i in range(n) for j in range(n) if others(group)(i, j)])):
        one = retrieval.precision_recall(queries, *(spark.createDataFrame(x, "q int, item int") for x in (answers, truth))).first()
        assert all(one[c] == got[layer][c] or math.isclose(one[c], got[layer][c]) for c in one.asDict())
    assert recovery.n_true_pairs(nodes).first()["n"] == len(truth) // 2
