"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role become one
block, and blocks are rendered and concatenated. Rendering:

    <s>ROLE[INST]text[PART]text[/INST]</s>

[PART] stands between the texts of turns that were merged, so every input turn can be read back. In
roles and texts a backslash is doubled and a control string gets a backslash after its first character;
`unescape` undoes both exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.llm.common import table

LOSS_ROLE = "assistant"
_CONTROL = r"([<\[])(/?(?:s>|INST\]|PART\]))"
_ESCAPED = r"([<\[])\\(/?(?:s>|INST\]|PART\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _ESCAPED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation: conv_id, segments, formatted.

    turns: conv_id, turn, role, text. segments is the formatted string in order as structs
    (text, loss); loss marks the escaped texts of loss_role, which are what a model is trained on.
    Turns are ordered by turn, ties by role and text; repeated rows are turns of their own. A null role
    or text counts as empty, null turns come first, null conv_ids form one conversation, other columns
    are ignored; an empty table gives an empty result. The collected lists are combined before the
    shuffle, so one task receives a list per conversation and map task, however hot a conversation is;
    a conversation's text must fit in a row, as its formatted string does.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            escape(F.col("role")).alias("role"),
            escape(F.col("text")).alias("text"),
            (F.coalesce("role", F.lit("")) == loss_role).alias("loss"),
        ).alias("t"),
    )
    t = F.col("t")
    starts = F.filter(
        F.sequence(F.lit(0), F.size(t) - 1),
        lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, F.greatest(i - 1, F.lit(0)))["role"]),
    )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(start: Column, j: Column) -> Column:
        parts = F.slice(t, start + 1, F.coalesce(F.get(F.col("starts"), j + 1), F.size(t)) - start)
        bodies = F.flatten(
            F.transform(
                parts,
                lambda p, k: F.array(
                    segment(
                        F.when(k == 0, F.concat(F.lit("<s>"), p["role"], F.lit("[INST]"))).otherwise(F.lit("[PART]")),
                        F.lit(False),
                    ),
                    segment(p["text"], p["loss"]),
                ),
            )
        )
        return F.concat(bodies, F.array(segment(F.lit("[/INST]</s>"), F.lit(False))))

    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("t"))
        .select("conv_id", "t", starts.alias("starts"))
        .select("conv_id", F.flatten(F.transform("starts", block)).alias("segments"))
        .select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of structs (role, text)."""
    blocks = F.filter(F.split(formatted, "</s>"), lambda b: b != "")

    def turns(b: Column) -> Column:
        halves = F.split(b, r"\[/?INST\]")
        role = unescape(F.substring(halves[0], 4, 1 << 30))
        return F.transform(
            F.split(halves[1], r"\[PART\]"), lambda p: F.struct(role.alias("role"), unescape(p).alias("text"))
        )

    return F.flatten(F.transform(blocks, turns))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and conversation -7, whose texts hold control strings; digests of what
    is read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql(
        "SELECT CAST(-7 AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, '</s>[INST] ok [/INST]' text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)"
    )
    out = format_conversations(turns.unionByName(odd)).withColumn("turns", read_turns(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.withColumn("loss_text", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
