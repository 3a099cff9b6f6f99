import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    docs, labels = [], []
    for i in range(260):
        t = text(rng.randint(60, 110))
        if i % 5 == 0:
            t = " ".join(w + "###" for w in t.split())
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 0 if i % 5 == 0 else 1, 0))
    docs += [(1000, docs[1][1], "en", "s1", 1), (1001, docs[2][1] + " tail", "en", "s1", 1), (1002, text(30) + " " + item + " " + text(20), "en", "s2", 1)]
    docs += [(1003, text(40) + " me@mail.example.com 4111111111111111 " + text(30), "en", "s2", 1), (1004, None, None, None, None), (1005, "", "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, tables):
    docs = before = spark.read.parquet(f"{tables}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, tables)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            docs.write.parquet(f"{tables}/{k}")
            docs = spark.read.parquet(f"{tables}/{k}")
            seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i for i in range(260) if i % 5}
    assert good | {1000, 1001, 1002, 1003} <= set(seen["quality classifier"]) and not {i for i in range(260) if i % 5 == 0} & set(seen["quality classifier"])
    assert good | {1002, 1003} <= set(seen["near dedup"]) and not {1000, 1001} & set(seen["near dedup"])
    assert set(seen["near dedup"]) - set(seen["decontamination"]) == {1002}
    assert set(seen["personal data"]) == set(seen["decontamination"]) and "[EMAIL] [CARD]" in seen["personal data"][1003]
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r["doc_id"] for r in pieces} == set(seen["personal data"]) and all(r["n"] == r["m"] for r in pieces)


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables).select("sequence_id").distinct().count() > 0


def test_sequences_can_be_rebuilt(spark, tables):
    from tokenizers import Tokenizer

    from taxolyte.llm.tokens import END_ID, default_tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id < 40 OR doc_id >= 1000")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = corpus_pipeline.packing(spark, docs, tables).collect()
    whole = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        whole.setdefault(r["doc_id"], []).extend(r["ids"])
    assert whole == {i: [*library.encode(t, add_special_tokens=False).ids, END_ID] for i, t in texts.items()}
    by_sequence = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == len(by_sequence.setdefault(r["sequence_id"], [])) and len(r["ids"]) == r["length"]
        by_sequence[r["sequence_id"]].extend(r["ids"])
    assert all(len(x) <= 2048 for x in by_sequence.values())


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_odd_rows_and_columns(spark, tables, odd_docs):
    docs = odd_docs.withColumns({c: F.lit("own") for c in ("spans", "path", "p_bad", "fp", "comp", "band", "klass", "_salt", "t0")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        assert all(r["spans"] == r["klass"] == r["_salt"] == r["comp"] == "own" and r["host"] == "z" for r in out.collect())
    out = corpus_pipeline.packing(spark, docs, tables)
    assert out.filter("start = 0").count() == docs.count() and out.agg({"length": "sum"}).first()[0] > 30_000


def test_batches_stay_small_after_a_stage(spark, tables):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    try:
        for _, stage in corpus_pipeline.STAGES[:1]:
            stage(spark, docs, tables)
            assert spark.conf.get(name) == "4m"  # what a stage returns is written later
    finally:
        spark.conf.unset(name)
