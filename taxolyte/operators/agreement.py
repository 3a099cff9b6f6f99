"""Agreement of partitions and of raters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolyte.functions.special import log_factorials
from taxolyte.session import materialize

#: Raters and ratings of a block; rows and columns multiplied at once, raters returned in one row, and figures told apart by a table.
BLOCK, RATINGS, STRIPE, WIDTH, OUT, CODES = 4096, 2_000_000, 1024, 2048, 64, 1 << 20


def _choose2(c: Column) -> Column:
    return c * (c - 1) / 2


def partition_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """nmi (arithmetic mean), ari, n of two labelings of the rows, from their contingency counts."""
    cells = df.groupBy(truth, pred).agg(F.count("*").cast("double").alias("c"))
    n = cells.agg(F.sum("c").alias("n"))
    rows, cols = (cells.groupBy(x).agg(F.sum("c").alias(s)) for x, s in ((truth, "_a"), (pred, "_b")))

    def entropy(part: DataFrame, c: str, name: str) -> DataFrame:
        p = F.col(c) / F.col("n")
        return part.join(F.broadcast(n)).agg(F.sum(-p * F.ln(p)).alias(f"h{name}"), F.sum(_choose2(F.col(c))).alias(f"s{name}"))

    full = cells.join(rows, truth).join(cols, pred).join(F.broadcast(n))
    mi = F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") * F.col("n") / (F.col("_a") * F.col("_b"))))
    one = full.agg(mi.alias("mi"), F.sum(_choose2(F.col("c"))).alias("s"), F.first("n").alias("n"))
    one = one.join(F.broadcast(entropy(rows, "_a", "a"))).join(F.broadcast(entropy(cols, "_b", "b")))
    mean = (F.col("ha") + F.col("hb")) / 2
    expected = F.col("sa") * F.col("sb") / _choose2(F.col("n"))
    top = (F.col("sa") + F.col("sb")) / 2 - expected
    return one.select(
        F.when(mean > 0, F.col("mi") / F.nullif(mean, F.lit(0.0))).otherwise(1.0).alias("nmi"),
        F.when(top != 0, (F.col("s") - expected) / F.nullif(top, F.lit(0.0))).otherwise(1.0).alias("ari"),
        F.col("n").cast("long").alias("n"),
    )


def adjusted_mutual_information(cells: list[tuple[int, int, int]]) -> float:
    """AMI (arithmetic mean) from contingency cells (row, column, count), by exact expected information."""
    a: dict[int, int] = {}
    b: dict[int, int] = {}
    for i, j, c in cells:
        a[i], b[j] = a.get(i, 0) + c, b.get(j, 0) + c
    n = sum(a.values())
    ha, hb = (-sum(x / n * math.log(x / n) for x in m.values()) for m in (a, b))
    mi = sum(c / n * math.log(n * c / (a[i] * b[j])) for i, j, c in cells if c)
    f = log_factorials(n)
    emi = 0.0
    for x in a.values():
        for y in b.values():
            for c in range(max(1, x + y - n), min(x, y) + 1):
                log_p = f[x] + f[y] + f[n - x] + f[n - y] - f[n] - f[c] - f[x - c] - f[y - c] - f[n - x - y + c]
                emi += c / n * math.log(n * c / (x * y)) * math.exp(log_p)
    top = (ha + hb) / 2 - emi
    return 1.0 if abs(top) < 1e-15 else (mi - emi) / top


def ami(df: DataFrame, truth: str, pred: str) -> float:
    """AMI of two labelings; only contingency cells come to the driver."""
    cells = df.groupBy(truth, pred).agg(F.count("*").alias("c")).collect()
    rows, cols = ({x: i for i, x in enumerate(sorted({r[k] for r in cells}, key=str))} for k in (truth, pred))
    return adjusted_mutual_information([(rows[r[truth]], cols[r[pred]], r["c"]) for r in cells])


def mode(df: DataFrame, by: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value of each group, ties to the smallest value."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.min(F.struct(-F.col("_n"), F.col(value).alias("v")))["v"].alias(name), F.max("_n").alias(f"{name}_n"))


def matched_judgments(judgments: DataFrame, items: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """Judgments with the columns of their item, and one row with n and n_unmatched, judgments of no item."""
    rows = judgments.join(items.withColumn("_there", F.lit(True)), item, "left")
    return rows.filter("_there").drop("_there"), rows.agg(F.count("*").alias("n"), F.count_if(F.col("_there").isNull()).alias("n_unmatched"))


def calibration(judgments: DataFrame, strict, lenient) -> DataFrame:
    """One row that compares two panels of raters on the same items (panel, rater, item, verdict; panel is new or old): n, strict and
    lenient rates of each, n_common items that both decide by majority, and how often these majorities agree, as verdicts and on merging."""
    v = F.col("verdict")
    rates = [f(F.when(F.col("panel") == p, c)).alias(f"{name}_{p}") for p in ("new", "old") for name, f, c in (("n", F.count, F.lit(1)), ("strict", F.avg, strict(v).cast("int")), ("lenient", F.avg, lenient(v).cast("int")))]
    a, b = (majority(judgments.filter(F.col("panel") == p)).select("item", F.col("majority").alias(p)).filter(F.col(p).isNotNull()) for p in ("new", "old"))
    both = a.join(b, "item").agg(
        F.count("*").alias("n_common"), F.avg((F.col("new") == F.col("old")).cast("int")).alias("agreement"), F.avg((strict(F.col("new")) == strict(F.col("old"))).cast("int")).alias("agreement_merge")
    )
    return judgments.agg(*rates).join(F.broadcast(both))


def mismatched(df: DataFrame, unit: str, group: str, cluster: str) -> DataFrame:
    """unit, group, cluster, cluster_group, mismatch: whether a unit's group is not its cluster's most frequent."""
    return df.join(mode(df, [cluster], group, "cluster_group"), cluster).select(unit, group, cluster, "cluster_group", (F.col(group) != F.col("cluster_group")).alias("mismatch"))


def majority(judgments: DataFrame, item: str = "item", verdict: str = "verdict") -> DataFrame:
    """item, n, verdict with most votes, null in a tie."""
    counts = judgments.groupBy(item, verdict).agg(F.count("*").alias("c"))
    w = Window.partitionBy(item).orderBy(F.desc("c"), verdict)
    ranked = counts.withColumn("r", F.row_number().over(w))
    top = ranked.groupBy(item).agg(
        F.sum("c").alias("n"), F.max(F.when(F.col("r") == 1, F.struct("c", verdict))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("c"))).alias("second")
    )
    return top.select(item, "n", F.when(F.col("a.c") > F.coalesce("second", F.lit(0)), F.col(f"a.{verdict}")).alias("majority"))


def krippendorff(ratings: DataFrame, item: str = "item", value: str = "verdict") -> DataFrame:
    """Nominal alpha, the items and ratings it rests on; null values are missing, items with one rating drop out."""
    counts = ratings.filter(F.col(value).isNotNull()).groupBy(item, value).agg(F.count("*").cast("double").alias("c"))
    m = counts.groupBy(item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("cc")).filter("m >= 2")
    observed = m.agg(F.sum((F.col("m") * F.col("m") - F.col("cc")) / (F.col("m") - 1)).alias("do"), F.sum("m").alias("n"), F.count("*").alias("n_items"))
    by_value = counts.join(m.select(item), item, "left_semi").groupBy(value).agg(F.sum("c").alias("v"))
    expected = by_value.agg((F.sum("v") * F.sum("v") - F.sum(F.col("v") * F.col("v"))).alias("de"))
    one = observed.join(F.broadcast(expected))
    ratio = F.col("do") / F.col("n") / F.nullif(F.col("de") / (F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    return one.select(F.when(F.col("n_items") >= 2, 1 - ratio).alias("alpha"), "n_items", F.col("n").cast("long").alias("n_ratings"))


def pairwise(ratings: DataFrame, rater: str = "rater", item: str = "item", value: str = "verdict", block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """r1 < r2, items both rated, and the share on which they agree, rounded to digits, null if no such item has a value of both.

    Raters are dealt into blocks by hash, and each task multiplies two blocks as matrices, so packed ratings are sent once for each
    block and no row is made for an item that two raters share. A task's worker returns a row for every OUT raters: a number for each
    of their pairs, and what the numbers stand for, so that rows of pairs are made, and shares rounded, outside of Python. Where few
    raters share an item, such rows are fewer than pairs of raters and are joined instead.
    """
    rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    rows = ratings.select(F.col(rater).alias("r"), F.col(item).alias("x"), F.col(value).alias("v")).filter("r IS NOT NULL AND x IS NOT NULL")
    rows = materialize(ratings.sparkSession, rows.groupBy("r", "x", "v").agg(F.count("*").alias("c")), "ratings")
    shared = rows.groupBy("x").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("met")).first()
    total = rows.agg(F.count_distinct("r").alias("n"), F.count("*").alias("size")).first()
    if shared["most"] <= block and shared["met"] < total["n"] * (total["n"] - 1) / 8:
        a, b = rows.toDF("r1", "x", "v1", "c1"), rows.toDF("r2", "x", "v2", "c2")
        n, same = F.col("c1") * F.col("c2"), F.col("v1") == F.col("v2")
        met = a.join(b, "x").filter("r1 < r2").groupBy("r1", "r2")
        return met.agg(F.sum(n).alias("n"), rounded(F.try_divide(F.sum(F.when(same, n).when(~same, 0)), F.sum(F.when(same.isNotNull(), n)))).alias("agreement"))

    blocks = max(1, -(-total["n"] // block), -(-total["size"] // RATINGS), min(8, total["n"] // 256))
    types = {name: rows.schema[name].dataType for name in "rx"}
    kind = types["r"].simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        yield pa.RecordBatch.from_arrays([table.column("b")[:1].combine_chunks(), pa.array([_packed(table.select(list("rxvc")))], pa.binary())], names=["b", "has"])

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("b")
        sides = [_unpacked(x.as_py()) for x in table.column("has")]
        (k, left), (l, right) = sides[0], sides[-1]
        by_item = _matrices(left, right, ["x"])
        by_value = _matrices(*(t.filter(pc.is_valid(t.column("v"))) for t in (left, right)), ["x", "v"])
        valued = _matrices(*(t.filter(pc.is_valid(t.column("v"))) for t in (left, right)), ["x"]) if left.column("v").null_count + right.column("v").null_count else None
        products = [_Product(x, len(l)) for x in (by_item, by_value, valued) if x]
        for at in range(0, len(k), STRIPE):
            to = min(at + STRIPE, len(k))
            figures = [p.rows(at, to) for p in products]
            if len(sides) == 1:
                figures[0][np.arange(len(l)) <= np.arange(at, to)[:, None]] = 0  # each pair once
            for part in range(0, to - at, OUT):
                some = [x[part : part + OUT] for x in figures]
                first, code = _coded([x.ravel() for x in some])
                n, same, both = (some[j].ravel()[first] for j in (0, 1, -1 if valued else 0))
                share = np.divide(same, both, out=np.zeros(len(first)), where=both > 0, dtype=np.float64)
                code = np.where(n > 0, np.arange(len(first), dtype=np.int32), np.int32(-1))[code]
                raters = pa.StructArray.from_arrays([k[at + part : at + part + len(some[0])], _lists(pa.array(code), len(l))], ["k", "code"])
                yield pa.RecordBatch.from_arrays(
                    [_lists(x, len(x)) for x in (raters, l, pa.array(n.astype(np.int64)), pa.array(share, mask=both == 0))], names=["per", "l", "n", "agreement"]
                )

    by_block = rows.withColumn("b", F.pmod(F.xxhash64("r"), F.lit(blocks)).cast("int")).repartition(blocks, "b")
    packed = by_block.groupBy("b").applyInArrow(pack, "b int, has binary")
    cells = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("b", o).alias("lo"), F.greatest("b", o).alias("hi")))
    spread = packed.select("b", "has", F.explode(F.array_distinct(cells)).alias("cell")).select("b", "has", "cell.lo", "cell.hi").repartition(blocks * (blocks + 1) // 2, "lo", "hi")
    found = spread.groupBy("lo", "hi").applyInArrow(cell, f"per array<struct<k: {kind}, code: array<int>>>, l array<{kind}>, n array<long>, agreement array<double>")
    found = found.withColumn("agreement", F.transform("agreement", rounded)) if digits is not None else found
    # exists has no generated code: that keeps the loops over raters and over pairs apart, or the pairs of OUT raters are held at once.
    some = found.select("l", "n", "agreement", F.explode("per").alias("per")).filter(F.exists("per.code", lambda c: c >= 0))
    found = some.select("l", "n", "agreement", F.col("per.k").alias("k"), F.posexplode("per.code").alias("at", "code"))
    other = F.get("l", "at")
    return found.filter("code >= 0").select(F.least("k", other).alias("r1"), F.greatest("k", other).alias("r2"), F.get("n", "code").alias("n"), F.get("agreement", "code").alias("agreement"))


def _lists(values: pa.Array, size: int) -> pa.ListArray:
    """The values as lists of one size."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, max(1, size), np.int32)), values)


def _packed(ratings: pa.Table) -> bytes:
    """The ratings r, x, v, c, compressed, in order of r."""
    ratings = ratings.sort_by("r").combine_chunks()
    ratings = pa.table({name: c if name == "c" else c.dictionary_encode() for name, c in zip(ratings.column_names, ratings.columns, strict=True)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ratings.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(ratings)
    return sink.getvalue().to_pybytes()


def _unpacked(ratings: bytes) -> tuple[pa.Array, pa.Table]:
    """Raters in order, and their ratings: row (place of the rater), x, v, c."""
    ratings = pa.ipc.open_stream(ratings).read_all().combine_chunks()
    raters = ratings.column("r").combine_chunks()
    plain = {name: ratings.column(name).cast(ratings.schema.field(name).type.value_type) for name in "xv"}
    return raters.dictionary, pa.table({"row": raters.indices.cast(pa.int64()), **plain, "c": ratings.column("c")})


def _coded(figures: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equally long arrays of whole numbers as rows: a place of each distinct row, and for every row which of them it is."""
    code, size = np.zeros(len(figures[0]), np.int32), 1
    for f in figures:
        top = int(f.max(initial=0)) + 1
        if size * top > CODES:
            (firsts, code), (values, f) = np.unique(code, return_inverse=True), np.unique(f, return_inverse=True)
            size, top = len(firsts), len(values)
        wide = np.int32 if size * top <= CODES else np.int64
        code, size = code.astype(wide, copy=False) * wide(top) + f.astype(wide), size * top
    if size > CODES:
        return np.unique(code, return_index=True, return_inverse=True)[1:]
    at = np.full(size, -1, np.int32)
    at[code] = np.arange(len(code), dtype=np.int32)
    used = np.flatnonzero(at >= 0)
    which = np.empty(size, np.int32)
    which[used] = np.arange(len(used), dtype=np.int32)
    return at[used], which[code]


def _matrices(left: pa.Table, right: pa.Table, by: list[str]) -> tuple:
    """Two sparse matrices of counts with a column for each combination on both sides: (row, column, count) by column, columns, number type."""
    sides, codes = (left, right), np.zeros(len(left) + len(right), np.int64)
    for name in by:
        c = pa.chunked_array([x for t in sides for x in t.column(name).chunks], left.column(name).type).combine_chunks().dictionary_encode()
        codes = np.unique(codes * (len(c.dictionary) + 1) + c.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    halves = codes[: len(left)], codes[len(left) :]
    common = np.intersect1d(*halves)
    out = []
    for t, code in zip(sides, halves, strict=True):
        at = np.flatnonzero(np.isin(code, common))
        row = t.column("row").to_numpy()[at]
        n = row.max(initial=0) + 1
        cells, which = np.unique(np.searchsorted(common, code[at]) * n + row, return_inverse=True)  # a rater may have several rows of an item
        out.append((cells % n, cells // n, np.bincount(which, t.column("c").to_numpy()[at], len(cells))))
    (row, _, c), (_, _, d) = out
    largest = np.bincount(row, c).max(initial=0) * d.max(initial=0)
    return out[0], out[1], len(common), np.float32 if largest < 2**24 else np.float64  # whole numbers stay exact


class _Product:
    """The product of two such matrices, by rows of the left one and WIDTH columns at a time; the right one has n rows."""

    def __init__(self, matrices: tuple, n: int):
        self.left, self.right, self.width, self.kind = matrices
        self.n, self.start, self.dense = n, None, None

    def _part(self, side: tuple, start: int, first: int, last: int) -> np.ndarray:
        row, column, c = (x[slice(*np.searchsorted(side[1], (start, start + WIDTH)))] for x in side)
        here = (row >= first) & (row < last)
        m = np.zeros((last - first, min(WIDTH, self.width - start)), self.kind)
        m[row[here] - first, column[here] - start] = c[here]
        return m

    def rows(self, at: int, to: int) -> np.ndarray:
        out = np.zeros((to - at, self.n), self.kind)
        for start in range(0, self.width, WIDTH):
            if start != self.start:  # a single part is made once
                self.start, self.dense = start, self._part(self.right, start, 0, self.n)
            out += self._part(self.left, start, at, to) @ self.dense.T
        return out


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """kappa, agreement and n of two columns; rows with a null are left out."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").cast("double").alias("c"))
    same = cells.agg(F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0.0)).alias("same"), F.sum("c").alias("n"))
    rows, cols = (cells.groupBy(F.col(x).alias("v")).agg(F.sum("c").alias(s)) for x, s in ((a, "x"), (b, "y")))
    chance = rows.join(cols, "v").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return same.join(F.broadcast(chance)).select(((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"), po.alias("agreement"), F.col("n").cast("long").alias("n"))


def consensus(judgments: DataFrame, item: str = "item", verdict: str = "verdict", raters: int = 4) -> DataFrame:
    """item and whether its raters are unanimous, all but one agree, or neither."""
    top = judgments.groupBy(item, verdict).agg(F.count("*").alias("c")).groupBy(item).agg(F.max("c").alias("top"), F.sum("c").alias("n"))
    kind = F.when(F.col("top") == F.col("n"), "unanimous").when(F.col("top") == F.col("n") - 1, f"{raters - 1}-1").otherwise("other")
    return top.select(item, kind.alias("consensus"))
