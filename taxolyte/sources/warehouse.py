"""From denormalized landing rows to the normalized tables, and back to paths and triples.

Parquet has no merge, so tables are replaced: `upsert` and `insert_if_absent` give the new content. Ids
are hashes of natural keys, so a rerun gives equal tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.functions.text import clean, clean_int, last_word

#: Landing columns in sheet order; the levels may be empty.
LANDING = (
    "major_code", "major_name", "middle_code", "middle_name", "minor_code", "minor_name", "detail_code", "detail_name", "unit_code", "unit_name", "unit_level",
    "element_code", "element_name", "element_level", "criterion_no", "criterion", "type_code", "type_name", "item_no", "item",
)
LEVELS = ("unit_level", "element_level")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], batch: str | None = None) -> DataFrame:
    """One row of new for each key, and the rows of old whose key new lacks.

    Of rows of new that share a key the one with the greatest batch (a column of new) counts, of those the greatest one.
    """
    rest = [c for c in old.columns if c not in keys]
    rank = F.struct(*([F.col(batch)] if batch else []), *rest) if rest else F.lit(1)
    new = new.groupBy(*keys).agg(F.max(rank).alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old, and those of new whose key old lacks (one for each key)."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def landing(rows: DataFrame) -> DataFrame:
    """Rows of text columns as landing rows: cleaned, levels as whole numbers, blank rows left out."""
    cleaned = rows.select(*[c for c in rows.columns if c not in LANDING], *((clean_int if c in LEVELS else clean)(F.col(c)).alias(c) for c in LANDING))
    return cleaned.filter(F.coalesce(*(F.col(c).cast("string") for c in LANDING)).isNotNull())


def violations(rows: DataFrame) -> DataFrame:
    """Landing rows that lack a required value."""
    lacking = [F.col(c).isNull() for c in LANDING if c not in LEVELS]
    return rows.filter(reduce(lambda a, b: a | b, lacking))


def write_landing(rows: DataFrame, path: str, batch_id: str) -> DataFrame:
    """Adds landing rows to a folder as one batch and returns what the folder holds of it; a batch that is written again replaces itself."""
    out = landing(rows).withColumn("batch_id", F.lit(batch_id))
    out.write.partitionBy("batch_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(out.schema).parquet(path).filter(F.col("batch_id") == batch_id)


def audited(spark: SparkSession, path: str, batch_id: str, source: str, load: Callable[[], DataFrame]) -> DataFrame:
    """Runs a load and adds its audit rows to a folder: one when it starts, one with its time and count when it ends. Returns what it loaded."""
    kind = "batch_id string, source string, state string, at timestamp, n_rows long"

    def note(state: str, n: int | None) -> None:
        spark.range(1).select(*(F.lit(v).cast(t).alias(c) for c, t, v in zip(("batch_id", "source", "state"), ("string",) * 3, (batch_id, source, state), strict=True)), F.current_timestamp().alias("at"), F.lit(n).cast("long").alias("n_rows")).write.mode("append").parquet(path)

    note("started", None)
    out = load()
    note("finished", out.count())
    return out


def audit(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, source, started_at, finished_at, n_rows: the last run of each batch."""
    rows = spark.read.parquet(path)
    at = lambda state: F.max(F.when(F.col("state") == state, F.col("at")))
    return rows.groupBy("batch_id", "source").agg(at("started").alias("started_at"), at("finished").alias("finished_at"), F.max_by("n_rows", F.when(F.col("state") == "finished", F.col("at"))).alias("n_rows"))


def _id(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _full(*columns: str) -> Column:
    return F.concat(*columns)


def normalize(raw: DataFrame) -> dict[str, DataFrame]:
    """The nine tables from landing rows; of several names for a code the greatest in binary order counts."""
    raw = raw.withColumns(
        {
            "middle_full": _full("major_code", "middle_code"),
            "minor_full": _full("major_code", "middle_code", "minor_code"),
            "detail_full": _full("major_code", "middle_code", "minor_code", "detail_code"),
            "criterion_id": _id("element_code", "criterion_no", "criterion"),
        }
    )
    one = lambda keys, **values: raw.groupBy(*keys).agg(*(F.max(c).alias(n) for n, c in values.items()))
    named = lambda df, **names: df.withColumnsRenamed(names)
    items = raw.select("criterion_id", "type_code", "item_no", "item").distinct()
    return {
        "major_categories": named(one(["major_code"], name="major_name"), major_code="code"),
        "middle_categories": named(one(["middle_full"], major_category_code="major_code", code="middle_code", name="middle_name"), middle_full="full_code"),
        "minor_categories": named(one(["minor_full"], middle_category_full_code="middle_full", code="minor_code", name="minor_name"), minor_full="full_code"),
        "detail_categories": named(one(["detail_full"], minor_category_full_code="minor_full", code="detail_code", name="detail_name"), detail_full="full_code"),
        "competency_units": named(one(["unit_code"], detail_category_full_code="detail_full", name="unit_name", level="unit_level"), unit_code="code"),
        "competency_unit_elements": named(
            one(["element_code"], competency_unit_code="unit_code", name="element_name", level="element_level"), element_code="code"
        ).withColumn("element_no", last_word(F.col("code"))),
        "performance_criteria": raw.select(
            F.col("criterion_id").alias("id"), F.col("element_code").alias("competency_unit_element_code"), "criterion_no", F.col("criterion").alias("description")
        ).distinct(),
        "kta_types": named(one(["type_code"], name="type_name"), type_code="code"),
        "kta_items": items.select(
            _id("criterion_id", "type_code", "item_no", "item").alias("id"), F.col("criterion_id").alias("performance_criterion_id"), F.col("type_code").alias("kta_type_code"), "item_no", F.col("item").alias("description")
        ),
    }


#: Parent table, child table, the child's column that names its parent, predicate.
RELATIONS = (
    ("major_categories", "middle_categories", "major_category_code", "hasMiddleCategory"),
    ("middle_categories", "minor_categories", "middle_category_full_code", "hasMinorCategory"),
    ("minor_categories", "detail_categories", "minor_category_full_code", "hasDetailCategory"),
    ("detail_categories", "competency_units", "detail_category_full_code", "hasCompetencyUnit"),
    ("competency_units", "competency_unit_elements", "competency_unit_code", "hasElement"),
    ("competency_unit_elements", "performance_criteria", "competency_unit_element_code", "hasPerformanceCriterion"),
    ("performance_criteria", "kta_items", "performance_criterion_id", "requiresKnowledgeSkillAttitude"),
)


def _key(df: DataFrame) -> str:
    return next(c for c in ("full_code", "code", "id") if c in df.columns)


def edges(tables: dict[str, DataFrame]) -> DataFrame:
    """All relations as triples of texts; children without their parent are left out."""
    parts = []
    for parent, child, link, predicate in RELATIONS:
        p, c = tables[parent], tables[child]
        keyed = c.join(p.select(F.col(_key(p)).alias("_p")), F.col(link) == F.col("_p"), "left_semi")
        parts.append(keyed.select(F.col(link).cast("string").alias("subject_code"), F.lit(predicate).alias("predicate"), F.col(_key(c)).cast("string").alias("object_code")))
    return reduce(DataFrame.unionByName, parts)


def paths(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per detail category with all its ancestors; the three upper levels are dimensions of the standard."""
    major, middle, minor, detail = (tables[f"{x}_categories"] for x in ("major", "middle", "minor", "detail"))
    named = lambda df, x: df.select(*(F.col(c).alias(c if c.endswith("_full_code") and c != "full_code" or c == "major_category_code" else f"{x}_{c}") for c in df.columns))
    return (
        named(detail, "detail")
        .join(named(minor, "minor"), F.col("minor_category_full_code") == F.col("minor_full_code"))
        .join(named(middle, "middle"), F.col("middle_category_full_code") == F.col("middle_full_code"))
        .join(named(major, "major"), F.col("major_category_code") == F.col("major_code"))
        .select("major_code", "major_name", "middle_code", "middle_name", "minor_code", "minor_name", "detail_code", "detail_name", "detail_full_code")
    )
