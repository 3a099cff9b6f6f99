import json
from pathlib import Path

from pyspark.sql import functions as F

from taxolyte.functions import text as X
from taxolyte.operators import agreement, graph, recovery, resample, vectors
from taxolyte.sources import labels, reports, warehouse


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "x", y\nz', [1, 2], None), (1, "", None, 0.5)], "a long, t string, l array<int>, v double")
    reports.write_csv(df, str(tmp_path / "t"), ["a"])
    got = reports.read_csv(spark, str(tmp_path / "t"), "a long, t string, l string, v double").orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, None, None, 0.5), (2, 'say "x", y\nz', "1|2", None)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.25, None), ("c", float("nan"), 3)], "name string, x double, n int")
    found = reports.write_report(spark, {"rates": df, "none": df.limit(0)}, str(tmp_path / "r"))
    assert json.loads(Path(tmp_path / "r.json").read_text()) == found == {"rates": [{"name": "a|b", "x": 0.25, "n": None}, {"name": "c", "x": None, "n": 3}], "none": []}
    assert "| a\\|b | 0.2500 |  |" in Path(tmp_path / "r.md").read_text() and "no rows" in Path(tmp_path / "r.md").read_text()


def test_candidates(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.5, False), (2, 4, 0.7, True)], "comp long, size long, expected double, recommended boolean")
    meta = reports.write_candidates(spark, df, str(tmp_path / "c"), {"threshold": 0.9})
    assert meta == {"threshold": 0.9, "n_candidates": 2, "n_recommended": 1, "keys_absorbed": 4, "columns": df.columns} == json.loads(Path(tmp_path / "c.meta.json").read_text())
    assert [r["comp"] for r in reports.read_csv(spark, str(tmp_path / "c"), "comp long, size long, expected double, recommended boolean").collect()] == [2, 1]


def test_cache_is_kept_while_the_keys_are_the_same(spark, tmp_path):
    calls = []

    def make(df):
        calls.append(1)
        return df.withColumn("y", F.lit(len(calls)))

    df = spark.createDataFrame([("a",), ("b",)], "k string")
    one = reports.cached(spark, df, "k", str(tmp_path / "c"), make)
    two = reports.cached(spark, df.orderBy(F.desc("k")), "k", str(tmp_path / "c"), make)
    other = reports.cached(spark, df.union(df.limit(1)), "k", str(tmp_path / "c"), make)
    assert len(calls) == 2 and {r["y"] for r in one.collect()} == {r["y"] for r in two.collect()} == {1} and {r["y"] for r in other.collect()} == {2}


def test_landing_batches_and_audit(spark, tmp_path):
    rows = spark.createDataFrame([{c: (" 3 " if c in warehouse.LEVELS else f" {c} {i} ") for c in warehouse.LANDING} for i in range(4)])
    path, log = str(tmp_path / "landing"), str(tmp_path / "audit")
    load = lambda df, batch: warehouse.audited(spark, log, batch, "book.xlsx", lambda: warehouse.write_landing(df, path, batch))
    load(rows, "b1")
    load(rows.limit(1), "b2")
    out = load(rows.limit(3), "b1")  # replaces the first
    assert out.count() == 3 and spark.read.parquet(path).count() == 4 and out.first()["unit_level"] == 3
    assert {r["batch_id"]: r["n_rows"] for r in warehouse.audit(spark, log).collect()} == {"b1": 3, "b2": 1}


def test_upsert_takes_the_latest_batch(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "code long, name string")
    new = spark.createDataFrame([(2, "x", 1), (2, "c", 2), (3, "y", 1), (3, "z", 1)], "code long, name string, batch long")
    assert sorted(map(tuple, warehouse.upsert(old, new, ["code"], "batch").collect())) == [(1, "a"), (2, "c"), (3, "z")]


def test_deep_closure(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(70, 3)], "parent long, child long")
    assert labels.closure(spark, spark.createDataFrame([(0,)], "node long"), chain).count() == 71


def test_rater_codes(spark):
    codes = {"EV-1": "phd", "ev-4": "staff", "EV-5B": "student", "EV-9": "external", "AU-1": "author", "X": None}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r[0]: r[1] for r in df.select("c", X.rater_group(F.col("c"))).collect()} == codes
    assert {r[0] for r in df.filter(X.counts_in_first_round(F.col("c"))).collect()} == {"EV-1", "ev-4", "EV-5B", "AU-1", "X"}


def test_communities_of_pairs(spark):
    nodes = spark.createDataFrame([(i,) for i in range(9)], "node long")
    links = [(0, 1, 0.9), (0, 2, 0.8), (1, 2, 0.95), (3, 4, 0.9), (3, 5, 0.9), (4, 5, 0.7), (2, 3, 0.61), (6, 7, 0.5)]
    out = graph.louvain_pairs(spark, nodes, spark.createDataFrame(links, "i long, j long, sim double"), 0.6).collect()
    assert {r["node"]: r["community"] for r in out} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8}
    assert {r["community"]: r["min_sim"] for r in out} == {0: 0.8, 3: 0.7, 6: None, 7: None, 8: None}


def test_joint_recovery(spark):
    sample = spark.createDataFrame([("2", 1, 1)] * 30 + [("2", 0, 1)] * 10 + [("3-5", 1, 1)] * 5 + [("3-5", 0, 1)] * 5, "bucket string, num int, den int")
    buckets = spark.createDataFrame([("2", 100), ("3-5", 40), ("6-20", 10)], "bucket string, keys_absorbed long")
    out = {r["policy"]: r for r in resample.joint_recovery(spark, sample, buckets, {"size2": ["2"], "size<=5": ["2", "3-5"]}, 1000, 0.1, n=500).collect()}
    assert abs(out["size2"]["recovery"] - 0.175) < 1e-9 and abs(out["size<=5"]["verified"] - 95) < 1e-9
    assert 0.145 < out["size2"]["lo"] < 0.168 < 0.18 < out["size2"]["hi"] < 0.2
    groups = {r["bucket"]: r for r in resample.bootstrap_by_group(spark, sample, "bucket", "num", "den", n=300).collect()}
    assert groups["2"]["estimate"] == 0.75 and groups["3-5"]["lo"] < 0.4 < 0.6 < groups["3-5"]["hi"]


def test_rule_pairs_by_brute_force(spark):
    rows = [("Ab", "x"), ("ab", "y"), ("ab", "x"), ("a-b", "z"), ("AB", "y"), ("cd", "x"), ("c d", "x"), ("e", "x")]
    out = recovery.rule_pairs(spark.createDataFrame(rows, "surface string, concept string"), {"r0": X.label_key(F.col("surface"))}).first()
    sets, keys = {}, {}
    for s, c in rows:
        sets.setdefault(s, set()).add(c)
        keys.setdefault("".join(x for x in s.lower() if x.isalnum()), set()).add(s)
    pairs = [(a, b) for k in keys.values() for a in k for b in k if a < b]
    assert (out["n_surfaces"], out["ambiguous"], out["n_keys"], out["merged_pairs"]) == (len(sets), 1, len(keys), len(pairs))
    assert abs(out["pair_precision"] - sum(bool(sets[a] & sets[b]) for a, b in pairs) / len(pairs)) < 1e-9


def test_parts_by_rank_are_ntiles(spark):
    for n in (0, 2, 7, 9, 10):
        df = spark.createDataFrame([(i, i + 1, round((i * 7 % 5) / 5, 1)) for i in range(n)], "i long, j long, sim double")
        want = {r["i"]: r["t"] for r in df.selectExpr("i", "ntile(3) OVER (ORDER BY sim DESC, i, j) AS t").collect()}
        assert {r["i"]: r["part"] for r in vectors.parts_by_rank(df, 3).collect()} == want


def test_matched_judgments(spark):
    j = spark.createDataFrame([(1, "a"), (9, "b"), (None, "c")], "item long, v string")
    rows, n = agreement.matched_judgments(j, spark.createDataFrame([(1, "x"), (2, "y")], "item long, g string"), "item")
    assert [tuple(r) for r in rows.collect()] == [(1, "a", "x")] and tuple(n.first()) == (3, 2)
