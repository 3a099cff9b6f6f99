import math

import pytest
from pyspark.sql import functions as F

from taxolyte.functions import special
from taxolyte.functions import text as X


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_normalize_key(spark):
    texts = ["통계 분석 기법", "품질 관리 기법에 관한 지식", "보고서 작성 능력.", "능력", "ＡＢＣ 분석", " - ", "• SNS 활용 능력", "안전·보건", "지식 기술", None]
    want = ["통계분석", "품질관리", "보고서작성능력", "능력", "abc분석", "", "sns활용", "안전보건", "지식", ""]
    assert column(spark, texts, X.normalize_key) == want


def test_strip_inflection(spark):
    words = "policies ties uses managing databases used planned boxes bus using".split()
    assert column(spark, words, X.strip_inflection) == "policy ties uses manag databas used plann boxe bus using".split()


def test_label_keys(spark):
    assert column(spark, ["Data-bases & Policies"], X.label_key) == ["databasespolicies"]
    assert column(spark, ["Managing  data-bases"], X.inflected_key) == ["managdatabase"]


def test_clean_and_numbers(spark):
    assert column(spark, ["　a ", "", " ", None], X.clean) == ["a", None, None, None]
    assert column(spark, ["5.0", " 5", "", "x", "5.9"], X.clean_int) == [5, 5, None, None, 5]


def test_codes(spark):
    assert column(spark, ["0801010102_20v2", "ABC"], X.code_year) == [2020, None]
    assert column(spark, ["0801010102_20v2", "ABC"], X.code_version) == [2, None]
    assert column(spark, ["a b c", "c"], X.last_word) == ["c", "c"]


def test_templates(spark):
    texts = ["할 수 있다.", "할 수있다 . ", "할 수 있다\n", "할 수 있음"]
    assert column(spark, texts, lambda c: c.rlike(X.TEMPLATE)) == [True, True, True, False]
    assert column(spark, texts, lambda c: c.rlike(X.TEMPLATE_STRICT)) == [True, False, False, False]
    assert column(spark, ["", "이것은 한다.", "작성하기", "할 수 있음!", "abc"], X.deviant_type) == ["empty", "plain", "nominal", "template inside", "other"]


def test_codebooks(spark):
    texts = ["안전 규정과 책임", "팀", "none"]
    assert column(spark, texts, X.first_match) == ["준수·안전", "대인·소통", X.OTHER]
    assert column(spark, texts, X.all_matches) == [["준수·안전", "윤리·책임"], ["대인·소통"], []]
    order = [n for n, _ in X.ATTITUDES][::-1]
    assert column(spark, texts, lambda c: X.by_order(X.all_matches(c), order)) == ["윤리·책임", "대인·소통", X.OTHER]


def test_buckets(spark):
    assert column(spark, [2, 3, 5, 6, 20, 21, 100, 101], X.size_bucket, "int") == ["2", "3-5", "3-5", "6-20", "6-20", "21-100", "21-100", "100+"]
    assert column(spark, [0, 1, 2, 3, 9, 10], X.stratum, "int") == ["0", "1", "2", "3-9", "3-9", "10+"]
    assert column(spark, [0.85, 0.9, 0.95, 1.0, 0.5], lambda c: X.band(c, [0.85, 0.9, 0.95, 1.01]), "double") == [0, 1, 2, 2, None]


def test_labels(spark):
    assert column(spark, ["a\n b|c||", None], X.split_labels) == [["a", "b", "c"], []]
    assert column(spark, [None, "", "Released", "x"], X.is_released) == [True, True, True, False]
    assert column(spark, ["Essential for", "optional"], X.relation) == ["essential", "optional"]


@pytest.mark.parametrize(("x", "dof", "p"), [(42.1138, 23, 0.0088052), (77.8136, 23, 7.148e-08), (229.855, 23, 4.8717e-36)])
def test_chi2_tail(x, dof, p):
    assert math.isclose(special.chi2_tail(x, dof), p, rel_tol=1e-3)


def test_binomial_tails():
    assert math.isclose(special.binomial_lower(3, 10, 0.5), 0.171875)
    assert math.isclose(special.binomial_upper(4, 10, 0.5), 1 - 0.171875)
    assert special.binomial_upper(0, 10, 0.5) == 1
