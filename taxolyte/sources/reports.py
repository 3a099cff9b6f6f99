"""Result files: tables as CSV, bounded results as JSON and markdown, merge candidates with their description."""

from __future__ import annotations

import datetime
import decimal
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a JSON or markdown report may hold; a larger result is a table, not a report.
REPORT_ROWS = 100_000


def write_csv(df: DataFrame, path: str, order: list | None = None) -> None:
    """df as CSV files with a header, nulls empty, arrays joined by bars; with order, rows are sorted through all files."""
    flat = [F.array_join(F.transform(f.name, lambda x: x.cast("string")), "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema.fields]
    rows = df.orderBy(*order) if order else df
    rows.select(*flat).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that `write_csv` wrote; empty cells are null."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("nullValue", "").option("escape", '"').csv(path)


def _plain(value):
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        return None
    return value


def report(results: Mapping[str, DataFrame]) -> dict[str, list[dict]]:
    """Rows of bounded results by name, as JSON can hold them. Raises if one has more than REPORT_ROWS."""
    out = {}
    for name, df in results.items():
        rows = df.limit(REPORT_ROWS + 1).collect()
        if len(rows) > REPORT_ROWS:
            raise ValueError(f"{name} has more than {REPORT_ROWS} rows; write it as a table")
        out[name] = [{k: _plain(v) for k, v in r.asDict(recursive=True).items()} for r in rows]
    return out


def markdown(found: Mapping[str, list[dict]], digits: int = 4) -> str:
    """A heading and a table for each result of `report`."""
    shown = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    parts = []
    for name, rows in found.items():
        parts.append(f"## {name}\n")
        if rows:
            names = list(rows[0])
            parts += [f"| {' | '.join(names)} |", f"|{'---|' * len(names)}"]
            parts += [f"| {' | '.join(shown(r[c]) for c in names)} |" for r in rows]
        else:
            parts.append("no rows")
        parts.append("")
    return "\n".join(parts)


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_report(spark: SparkSession, results: Mapping[str, DataFrame], path: str) -> dict[str, list[dict]]:
    """path.json and path.md with the rows of all results."""
    found = report(results)
    _write_text(spark, json.dumps(found, ensure_ascii=False, indent=1), path + ".json")
    _write_text(spark, markdown(found), path + ".md")
    return found


def write_candidates(spark: SparkSession, candidates: DataFrame, path: str, about: Mapping[str, object]) -> dict[str, object]:
    """Merge candidates as CSV, best first, and beside it a JSON with their number, that of recommended ones and what about says."""
    write_csv(candidates, path, [F.desc("expected"), F.desc("size"), "comp"])
    n = candidates.agg(F.count("*").alias("n_candidates"), F.count_if("recommended").alias("n_recommended"), F.sum(F.col("size") - 1).alias("keys_absorbed")).first()
    meta = {**about, **{k: v or 0 for k, v in n.asDict().items()}, "columns": candidates.columns}
    _write_text(spark, json.dumps(meta, ensure_ascii=False, indent=1), path.rstrip("/") + ".meta.json")
    return meta


def key_digest(df: DataFrame, key: str) -> str:
    """A digest of a table's keys that doesn't depend on their order."""
    h = F.xxhash64(F.col(key).cast("string"))
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).alias("s")).first()
    return f"{r['n']}-{(r['x'] or 0) & (1 << 64) - 1:016x}-{r['s'] or 0}"


def cached(spark: SparkSession, df: DataFrame, key: str, path: str, make) -> DataFrame:
    """make(df), kept as a table under path by the digest of df's keys, and read from there while these are the same."""
    where = f"{path.rstrip('/')}/{key_digest(df, key)}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make(df).write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)
