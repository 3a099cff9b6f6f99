"""Every registered query against its SQL on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from taxolyte.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES + ["labels"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def same(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(same(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"hypotheses"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).columns


@pytest.mark.parametrize("name", ["layer_retrieval", "label_retrieval_f1", "pair_set_algebra"])
def test_no_join_of_a_label_with_itself(spark, monkeypatch, name):
    from taxolyte.operators import recovery

    def pairs_made(*_):
        raise AssertionError("pairs of one label were made")

    monkeypatch.setattr(recovery, "true_pairs", pairs_made)
    assert QUERIES[name](spark, DATA).columns


@pytest.fixture(scope="module")
def edge(tmp_path_factory):
    """Three pairs of vectors, one of them with a cosine that only reaches 0.4 when rounded to six places."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    vec = []
    for k, c in enumerate((0.3999997, 0.5, 0.7)):
        a, b = [0.0] * 64, [0.0] * 64
        a[2 * k], b[2 * k], b[2 * k + 1] = 1.0, c, math.sqrt(1 - c * c)
        vec += [a, b]
    d = tmp_path_factory.mktemp("edge")
    pq.write_table(pa.table({"vec_id": pa.array(range(6), pa.int64()), "embedding": pa.array(vec, pa.list_(pa.float32())), "label": pa.array([0, 7, 7, 7, 8, 9], pa.int32())}), d / "embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    return str(d), c


@pytest.mark.parametrize("name", ["cluster_size_buckets", "cluster_truth_metrics", "encoder_rescoring", "path_precision"])
def test_rounded_similarity_is_cut(spark, edge, name):
    d, c = edge
    df, want = QUERIES[name](spark, d), c.sql(ORACLE_SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
