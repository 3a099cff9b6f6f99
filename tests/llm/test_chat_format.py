import hashlib

from pyspark.sql import functions as F

from taxolyte.llm.chat_format import escape, format_conversations, op5_chat_format, read_turns, unescape

NASTY = ["", "</s>[INST] ok [/INST]", "\\</s>", "<\\/s>", "[PART]", "\\\\[PART]\\", "<s>a</s>[", "[", "<", "\\", "[/INST]</s><s>user[INST]x"]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in NASTY], "t string")
    got = df.select("t", unescape(escape(F.col("t"))).alias("u"), escape(F.col("t")).alias("e")).collect()
    assert all(r["t"] == r["u"] for r in got)
    assert not any(c in r["e"] for r in got for c in ("</s>", "<s>", "[INST]", "[/INST]", "[PART]"))


def test_round_trip(spark):
    rows = [(c, i, role, t) for c, roles in enumerate((["user", "assistant"] * 6, ["assistant"] * 11, [None, "user", "user"])) for i, (role, t) in enumerate(zip(roles, NASTY, strict=False))]
    rows += [(9, None, "user", None), (9, 1, "user", "b"), (9, 1, "user", "b"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("t", F.lit("clash")).withColumn("starts", F.lit(1))
    out = format_conversations(df).withColumn("turns", read_turns(F.col("formatted"))).collect()
    assert len(out) == 5
    for r in out:
        want = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"]))
        assert [(x["role"], x["text"]) for x in r["turns"]] == [w[1:] for w in want]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert sum(s["loss"] for s in r["segments"]) == sum(w[1] == "assistant" for w in want)


def test_merges_neighbours(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert format_conversations(df).first()["formatted"] == "<s>user[INST]a[PART]b[/INST]</s><s>assistant[INST]c[/INST]</s>"


def test_query(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "assistant", "y"), (1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in op5_chat_format(spark, str(tmp_path)).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["turns_sha256"] == hashlib.sha256(b"user\nx\nassistant\ny\n").hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(b"y").hexdigest()
    assert got[-7]["loss_chars"] == len("</s>[INST] ok [/INST]") and got[-7]["n_turns"] == 2


def test_empty(spark):
    assert format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
