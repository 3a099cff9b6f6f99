"""A second corpus of labelled skills and occupations: CSV sets, JSON arrays, surfaces and version checks."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.functions.text import is_released, nfkc, relation, split_labels, strip

SKILL = "uri string, preferredLabel string, altLabels array<string>, description string, status string, skillType array<string>, reuseLevel array<string>, broader array<string>, essentialFor array<string>"
OCCUPATION = (
    "uri string, code string, iscoGroup string, preferredLabel string, altLabels array<string>, description string, status string, essentialSkills array<string>, optionalSkills array<string>, broaderOccupation array<string>"
)


def csv_set(source: str, into: str | None = None) -> dict[str, str]:
    """Paths of the CSV files of a folder, or of a zip that is unpacked into a folder, by file name.

    The folder (into, or one beside the zip) must be one that executors see too.
    """
    folder = Path(source)
    if folder.suffix == ".zip":
        folder = Path(into or folder.with_suffix(""))
        with zipfile.ZipFile(source) as z:
            z.extractall(folder)
    return {p.name: str(p) for p in sorted(folder.rglob("*.csv"))}


def pick(files: dict[str, str], *needles: str) -> str:
    """The first file whose name has all needles, in any case."""
    for name, path in files.items():
        if all(n.lower() in name.lower() for n in needles):
            return path
    raise FileNotFoundError(f"no file for {needles} among {sorted(files)}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A UTF-8 CSV with a header, quoted line feeds and an optional byte order mark; all columns are text."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def column(df: DataFrame, *candidates: str) -> str:
    """The first candidate among the columns, whatever case and spaces."""
    bare = lambda c: "".join(c.lower().split())
    found = {bare(c): c for c in df.columns}
    for c in candidates:
        if bare(c) in found:
            return found[bare(c)]
    raise KeyError(f"none of {candidates} among {df.columns}")


def skills(df: DataFrame) -> DataFrame:
    """Released skills of a CSV as uri, preferredLabel, altLabels, skillType, reuseLevel, description."""
    c = lambda *names: F.col(f"`{column(df, *names)}`")
    rows = df.filter(is_released(c("status")))
    return rows.select(
        strip(c("conceptUri", "uri")).alias("uri"), strip(c("preferredLabel")).alias("preferredLabel"), split_labels(c("altLabels")).alias("altLabels"), c("skillType").alias("skillType"), c("reuseLevel").alias("reuseLevel"), c("description").alias("description")
    )


def occupations(df: DataFrame) -> DataFrame:
    """Released occupations; the code falls back to the ISCO group."""
    c = lambda *names: F.col(f"`{column(df, *names)}`")
    code = F.coalesce(F.nullif(strip(c("code")), F.lit("")), strip(c("iscoGroup")))
    return df.filter(is_released(c("status"))).select(
        strip(c("conceptUri", "uri")).alias("uri"), code.alias("code"), strip(c("iscoGroup")).alias("iscoGroup"), strip(c("preferredLabel")).alias("preferredLabel"), split_labels(c("altLabels")).alias("altLabels")
    )


def relations(df: DataFrame, occupations_: DataFrame, skills_: DataFrame) -> DataFrame:
    """occupation, skill, kind (essential or optional) between known ones."""
    c = lambda *names: F.col(f"`{column(df, *names)}`")
    rows = df.select(strip(c("occupationUri")).alias("occupation"), strip(c("skillUri")).alias("skill"), relation(c("relationType")).alias("kind"))
    rows = rows.join(occupations_.select(F.col("uri").alias("occupation")), "occupation", "left_semi")
    return rows.join(skills_.select(F.col("uri").alias("skill")), "skill", "left_semi").select("occupation", "skill", "kind").distinct()


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def surfaces(skills_: DataFrame) -> DataFrame:
    """Distinct surface (NFKC label), uri of all preferred and alternative labels."""
    labels = F.array_append(F.coalesce("altLabels", F.array().cast("array<string>")), F.col("preferredLabel"))
    rows = skills_.select("uri", F.explode(labels).alias("label")).filter("label IS NOT NULL")
    return rows.select(strip(nfkc(F.col("label"))).alias("surface"), "uri").filter("surface <> ''").distinct()


def version_verdict(delta: DataFrame, present: DataFrame, language: str = "en") -> DataFrame:
    """Which version a label table (uri, label) is, from a change list: added, removed, their shares that are
    present, and new, old or undecided.

    delta: field, language, uri, action, value; only alternative labels of the language count.
    """
    rows = delta.filter((F.lower("field") == "altlabels") & (F.lower("language") == language)).select("uri", F.lower("action").alias("action"), F.col("value").alias("label")).distinct()
    there = rows.join(present.select("uri", "label").distinct().withColumn("there", F.lit(1)), ["uri", "label"], "left").na.fill(0, ["there"])
    added, removed = (F.avg(F.when(F.col("action").startswith(a), F.col("there"))) for a in ("add", "remove"))
    out = there.agg(F.count_if(F.col("action").startswith("add")).alias("n_added"), F.count_if(F.col("action").startswith("remove")).alias("n_removed"), added.alias("added"), removed.alias("removed"))
    verdict = F.when((F.col("added") > 0.9) & (F.coalesce("removed", F.lit(0.0)) < 0.1), "new").when(F.col("added") < 0.1, "old").otherwise("undecided")
    return out.withColumn("verdict", verdict)


def closure(spark: SparkSession, roots: DataFrame, narrower: DataFrame) -> DataFrame:
    """node: all that is reachable from roots (node) over narrower (parent, child), a frontier join a round until nothing is new."""
    from taxolyte.session import materialize

    seen = front = materialize(spark, roots.select("node").distinct(), "closure")
    while True:
        step = narrower.join(front, narrower.parent == front.node).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti")
        front = materialize(spark, step, "closure")
        if front.isEmpty():
            return seen
        seen = materialize(spark, seen.unionByName(front), "closure")  # as many files however deep it goes
