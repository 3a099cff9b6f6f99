"""Personal data in texts, in DataFrame functions only.

Base kinds are regular expressions with a check (BASE); their matches always count. High-recall
generators (EXTRA) propose further spans on the text with base spans blanked out; proposals of different
generators may overlap. Gradient-boosted trees of depth two score each proposal from format and context
features. Scores are calibrated for each generator on documents that the trees have not seen, and a proposal is
selected if its calibrated probability is at least CERTAIN.

There are no labels of personal data, so they are made (`labelled`): values of known sorts are planted among the words of
real texts, at most TRAIN_DOCS of them, and the generators run over what results; a proposal that meets the
planted value has its label. Sums per feature pattern are all that the driver fits to.

Everything happens within a row, so nothing is shuffled and no key can be hot. Start positions are
two-level prefix sums over a row's matches, so texts with very many matches stay near linear.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolyte.llm.common import table

_LOCAL = r"A-Za-z0-9._%+\-"
#: Kind, what a text must contain, pattern. A match can only begin where its run of characters begins or
#: where the last match ended (\G), which keeps long runs linear; possessive quantifiers keep Java's
#: matcher from recursing. Both leave the matches as they are.
BASE = (
    ("email", "@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"),
    ("ip", "[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", "[0-9]", r"[0-9](?:[\x20\-]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9\-]+[0-9]"),
)
EXTRA = (
    ("account", "[0-9]", r"(?<![0-9A-Za-z.])(?:[0-9]{9,19}+(?![0-9A-Za-z])|[0-9](?:[\x20\-]?[0-9]){8,18}+(?![0-9A-Za-z]))"),
    ("phone_like", "[0-9]", r"(?<![0-9+A-Za-z]|[0-9][\x20.\-])\(?[0-9]{2,4}\)?[\x20.\-][0-9]{3,4}[\x20.\-][0-9]{3,4}(?![0-9A-Za-z]|[\x20.\-][0-9])"),
    ("national_id", "[0-9]", r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"),
    ("iban", "[0-9]", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    ("secret", "[0-9]", r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+"),
    (
        "written_email",
        r"(?i)[\[(]at[\])]",
        rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]++\x20?[\[(]at[\])]\x20?[a-z0-9\-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[a-z0-9\-]++)++",
    ),
)
KINDS = tuple(k for k, _, _ in BASE + EXTRA)
CONTEXT = 32
#: Texts of the table, those with the smallest hash, and places in each where a value is planted; places in built-in prose.
TRAIN_DOCS, PLACES, PROSE_PLACES = 2000, 4, 4000
#: Documents are dealt to so many folds: the last is for tests, the one before for calibration, the others for trees.
FOLDS, CALIBRATION, TEST = 5, 3, 4
ROUNDS, RATE, CERTAIN = 40, 0.3, 0.8
_BLOCK = 64
_FOUND = "array<struct<kind:int,start:bigint,end:bigint,s:string,before:string,after:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut(text: Column, pattern: str) -> Column:
    """What lies between the matches of a pattern, and the matches."""
    return F.struct(F.split(text, pattern).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))


def _proposal(z: Column, m: Column, i: Column) -> tuple[Column, Column, Column]:
    return m, F.right(F.get(z["p"], i), F.lit(CONTEXT)), F.left(F.get(z["p"], i + 1), F.lit(CONTEXT))


def find(text: Column, kind: str) -> Column:
    """All matches of a kind's pattern, unchecked: kind number, start, end (code points), s, before, after."""
    at = KINDS.index(kind)
    _, needs, pattern = (BASE + EXTRA)[at]
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)

    def placed(z: Column, u: Column, blocks: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            before = F.get(blocks, b) + total(F.slice(u, b * _BLOCK + 1, i % _BLOCK)) + F.length(F.get(z["p"], i))
            s, left, right = _proposal(z, m, i)
            return F.struct(
                F.lit(at).alias("kind"), before.alias("start"), (before + F.length(m)).alias("end"), s.alias("s"), left.alias("before"), right.alias("after")
            )

        return F.transform(z["m"], one)

    def sums(u: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(u) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(u, b * _BLOCK + 1, F.lit(_BLOCK)))
        )
        return F.aggregate(each, F.array(zero), lambda a, x: F.array_append(a, F.get(a, F.size(a) - 1) + x))

    def of(z: Column) -> Column:
        units = F.transform(z["m"], lambda m, i: (F.length(F.get(z["p"], i)) + F.length(m)).cast("long"))
        return F.when(F.size(z["m"]) > 0, _let(units, lambda u: _let(sums(u), lambda blocks: placed(z, u, blocks)))).otherwise(
            F.array().cast(_FOUND)
        )

    return F.when(text.rlike(needs), _let(_cut(text, pattern), of)).otherwise(F.array().cast(_FOUND))


def replace(text: Column, kind: str, use: Callable[[Column, Column, Column], Column], by: Callable[[Column], Column]) -> Column:
    """text with those matches of a kind replaced for which use(s, before, after) holds."""
    _, needs, pattern = (BASE + EXTRA)[KINDS.index(kind)]

    def of(z: Column) -> Column:
        parts = F.transform(z["m"], lambda m, i: F.concat(F.get(z["p"], i), F.when(use(*_proposal(z, m, i)), by(m)).otherwise(m)))
        return F.concat(F.array_join(parts, ""), F.element_at(z["p"], -1))

    # Bound once, because calls of this function are nested.
    return _let(text, lambda t: F.when(t.rlike(needs), _let(_cut(t, pattern), of)).otherwise(t))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def passes(kind: str, s: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda x: x.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return _let(_digits(s), lambda d: F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _passing(kind: str) -> Callable[[Column], Column]:
    return lambda c: passes(kind, c["s"])


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda c: c["kind"] == KINDS.index(kind)


def _word_before(words: str) -> str:
    return rf"(?i)(?:{words})[^A-Za-z]{{0,8}}(?:(?:no|nr|number|id|is)[^A-Za-z]{{0,4}})?$"


#: Fixed words for what is counted or measured.
_COUNTED = "items?|units?|pieces?|times|people|views|copies|rows|words|users|euros?|dollars?|stück|mal|euro|personas|veces|unidades|fois|personnes|pièces"


def features(kind: Column, s: Column, before: Column, after: Column) -> Column:
    """Format and context of a proposal as bits of a whole number."""
    n = F.length(_digits(s))
    bits = [
        F.when(n > 0, _luhn(_digits(s))).otherwise(False),
        n.between(9, 12),
        n.between(13, 15),
        n == 16,
        n >= 17,
        s.rlike(r"[\x20.\-]"),
        s.rlike(r"^[0-9]{4}(?:[\x20\-][0-9]{4})+$"),
        s.contains("("),
        s.rlike("[A-Za-z]"),
        s.rlike("^[0-9a-fA-F]+$"),
        F.length(s) >= 32,
        s.contains("_"),
        s.rlike("[A-Z]") & s.rlike("[a-z]") & (n > 0),
        F.size(F.array_distinct(F.split(s, ""))) >= 8,
        s.rlike(r"^([0-9A-Za-z])\1+$"),
        n * 5 >= F.length(s),
        before.rlike("[\"'=:]\\x20?$"),
        before.rlike(_word_before("token|key|secret|passw\\w*|pwd|auth\\w*|bearer|credential")),
        before.rlike(_word_before("card|account|iban|konto|cuenta|compte|ssn|social|security|passport|tax")),
        before.rlike(_word_before("tel|phone|call|fax|mobile|cell|handy|telefon\\w*")),
        before.rlike(_word_before("order|invoice|version|isbn|issn|page|part|item|build|sku|serial|model|doi|article")),
        before.rlike(_word_before("commit|sha1|sha256|md5|checksum|hash|revision|digest")),
        after.rlike("^\\x20?(?:%(?!%)|\\$(?!\\$)|€|(?:km|cm|mm|kg|mg|kB|MB|GB|ms|h|m|s|g|l)\\b|[./][0-9])"),
        after.rlike(rf"(?i)^\x20(?:{_COUNTED})\b"),
        s.rlike("^(?:19|20)[0-9]{2}[\\x20\\-][01][0-9]"),
        s.rlike("^97[89]"),
        *(kind == KINDS.index(k) for k, _, _ in EXTRA),
    ]
    mask = F.lit(0).cast("long")
    for i, bit in enumerate(bits):
        mask = mask + F.when(bit, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return mask


N_FEATURES = 26 + len(EXTRA)


#: Prose for tables without texts.
_PROSE = (
    "the old bridge was closed for repairs and then opened once more in the spring of that year",
    "she said that the meeting would begin late because of the rain and asked all to wait inside",
    "der alte Turm steht noch immer am Fluss und wird im Sommer von vielen Leuten besucht",
    "los libros de la casa grande fueron vendidos en el mercado cerca de la plaza mayor",
    "avec le temps les maisons du village ont été rendues aux familles qui les avaient bâties",
    "results were better than in the years before, which nobody in the office had expected (see above)",
)


def _templates() -> list[tuple[int, list[str], str, list[str]]]:
    """Label, texts before, SQL for a value from a column id, texts after."""

    def part(alphabet: str, length: int, salt: int) -> str:
        return f"array_join(transform(sequence(1, {length}), j -> substr('{alphabet}', 1 + cast(pmod(xxhash64(id, {salt}, j), {len(alphabet)}) as int), 1)), '')"

    d = lambda n, salt=1: part("0123456789", n, salt)
    hexa = lambda n: part("0123456789abcdef", n, 2)
    mixed = lambda n: part("ABCDEFGHJKMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789", n, 3)
    upper = lambda n: part("ABCDEFGHJKLMNPQRSTUVWXYZ0123456789", n, 4)
    letters = lambda n: part("abcdefghijklmnopqrstuvwxyz", n, 5)
    plain = [" ", " ", ", ", " (", ": ", "\n"]
    ends = [" ", ". ", ", ", "\n", ") "]
    accounts = [" account ", " account no. ", " card number: ", " passport ", " konto ", " tax id ", " cuenta ", " compte "]
    numbers = [" order ", " invoice no. ", " isbn ", " item ", " serial: ", " part number ", " model ", " version ", " build ", " article "]
    phones = [" call ", " phone: ", " tel. ", " fax ", " mobile ", " handy "]
    secrets = [' token = "', " api_key=", " password: ", " secret = '", " Authorization: Bearer ", ' key: "']
    hashes = [" commit ", " sha1 ", " md5: ", " checksum ", " revision ", " digest "]
    counted = [f" {w} " for w in ("items", "units", "times", "people", "views", "rows", "km", "euros", "Stück", "veces", "fois")]
    four = [d(4, k) for k in (11, 12, 13, 14)]
    grouped = "concat_ws(' ', " + ", ".join(four) + ")"
    three = lambda a, b, c: f"concat({d(3)}, '{a}', {d(3, 6)}, '{b}', {d(4, 7)}{c})"
    return [
        (1, plain + accounts, d(16), ends),
        (1, plain + accounts, grouped, ends),
        (1, accounts, d(10), ends),
        (1, accounts, d(12), ends),
        (0, numbers, d(10), ends),
        (0, numbers, d(13), ends),
        (0, numbers, d(16), ends),
        (0, plain, d(9), counted),
        (0, plain, d(10), counted),
        (0, plain, d(13), ends),
        (0, plain, f"concat('978-', {d(1)}, '-', {d(2, 6)}, '-', {d(6, 7)}, '-', {d(1, 8)})", ends),
        (0, plain, f"concat('20', {d(2)}, '-0', {d(1, 6)}, '-1', {d(1, 7)}, ' ', '1', {d(1, 8)})", [":30 ", " "]),
        (0, plain, "repeat('0', 16)", ends),
        (0, plain, f"concat_ws(' ', {d(3)}, {d(3, 6)}, {d(3, 7)}, {d(3, 8)})", counted),
        (0, plain, three(" ", " ", ""), counted),
        (1, plain + phones, f"concat('(', {d(3)}, ') ', {d(3, 6)}, '-', {d(4, 7)})", ends),
        (1, plain + phones, three("-", "-", ""), ends),
        (1, phones, three(".", ".", ""), ends),
        (1, phones, three(" ", " ", ""), ends),
        (0, numbers, three(".", ".", ""), ends),
        (0, numbers, three("-", "-", ""), ends),
        (0, numbers, f"concat({d(4)}, '-', {d(4, 6)}, '-', {d(3, 7)})", ends),
        (0, plain, f"concat({d(2)}, ' ', {d(3, 6)}, ' ', {d(3, 7)})", counted),
        (1, [*plain, " ssn ", " social security number "], f"concat({d(3)}, '-', {d(2, 6)}, '-', {d(4, 7)})", ends),
        (0, numbers, f"concat({d(3)}, '-', {d(2, 6)}, '-', {d(4, 7)})", ends),
        (1, [*plain, " iban ", *accounts], f"concat('DE', {d(2)}, ' ', {four[0]}, ' ', {four[1]}, ' ', {four[2]}, ' ', {four[3]}, ' ', {d(2, 8)})", ends),
        (1, [" iban ", *accounts], f"concat('FR', {d(2)}, {upper(20)})", ends),
        (0, numbers, f"concat('AB', {d(2)}, {upper(8)})", ends),
        (1, secrets, hexa(40), ['" ', "' ", " "]),
        (1, secrets, f"upper({hexa(40)})", ['" ', "' ", " "]),
        (1, secrets, mixed(32), ['" ', " "]),
        (1, secrets, mixed(24), ['" ', " "]),
        (1, plain, mixed(40), ends),
        (0, hashes, hexa(40), ends),
        (0, hashes, hexa(32), ends),
        (0, plain, letters(24), ends),
        (0, plain, f"concat({letters(9)}, '_', {letters(12)}, '_', {d(2)})", [*ends, "("]),
        (0, plain, f"concat({letters(22)}, {d(2)})", ends),
        (0, numbers, upper(20), ends),
        (1, plain, f"concat({letters(6)}, ' (at) ', {letters(7)}, '.', {letters(3)})", ends),
        (1, plain, f"concat({letters(5)}, '[at]', {letters(8)}, ' [dot] com')", ends),
        (0, plain, f"concat({letters(6)}, ' (at) ', {letters(7)})", ends),
    ]


def labelled(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Labelled proposals: kind, s, before, after, label, fold. docs: doc_id, text.

    A place is a few words of a text to either side; one value is planted there, by a template that the place's hash names, and
    the generators run over the result as they do over texts. Proposals that don't meet the value have no
    label and are left out. All places of a text are in one fold.
    """
    filled = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text <> ''")
    chosen = filled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    real = filled.join(F.broadcast(chosen), "doc_id")  # TRAIN_DOCS ids
    real = real.select(F.xxhash64("doc_id").alias("unit"), F.split("text", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.lit(PLACES))).alias("place"))
    prose = F.array(*map(F.lit, _PROSE))
    made = spark.range(0, PROSE_PLACES, 1, 1).select(
        F.xxhash64(F.lit("prose"), F.col("id")).alias("unit"), F.split(F.get(prose, F.pmod("id", F.lit(len(_PROSE))).cast("int")), " ").alias("w"), F.lit(0).alias("place")
    )
    at = F.pmod(F.xxhash64("unit", "place", F.lit(3)), F.size("w") + 1).cast("int")
    templates = _templates()
    cut = real.unionByName(made).select("unit", F.xxhash64("unit", "place").alias("id"), "w", at.alias("at"))
    cut = cut.select(
        "unit",
        "id",
        F.array_join(F.slice("w", F.greatest(F.col("at") - 11, F.lit(1)), F.least("at", F.lit(12))), " ").alias("left"),
        F.array_join(F.slice("w", F.col("at") + 1, F.lit(12)), " ").alias("right"),
    )
    cut = cut.groupBy("unit", "id").agg(F.min(F.struct("left", "right")).alias("x"))  # rows that share a doc_id are one text
    cut = cut.select("unit", "id", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(len(templates))).cast("int").alias("t"), "x.left", "x.right")
    any_of = lambda texts, salt: F.get(F.array(*map(F.lit, texts)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(texts))).cast("int"))
    of = lambda use: F.coalesce(*(F.when(F.col("t") == i, use(x)) for i, x in enumerate(templates)))
    planted = cut.select(
        F.pmod(F.xxhash64("unit", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"),
        of(lambda x: F.lit(x[0])).alias("label"),
        F.concat("left", of(lambda x: any_of(x[1], 6))).alias("head"),
        of(lambda x: F.expr(x[2])).alias("value"),
        F.concat(of(lambda x: any_of(x[3], 7)), "right").alias("rest"),
    )
    text = F.concat("head", "value", "rest")
    base = F.flatten(F.array(*(F.filter(find(F.col("text"), k), _passing(k)) for k, _, _ in BASE)))
    rows = planted.withColumn("text", text).withColumn("clean", _let(base, lambda spans: F.when(F.size(spans) == 0, F.col("text")).otherwise(_blanked(F.col("text")))))
    found = rows.select("fold", "label", "head", "value", F.explode(F.flatten(F.array(*(find(F.col("clean"), k) for k, _, _ in EXTRA)))).alias("c"))
    meets = (F.col("c.start") < F.length("head") + F.length("value")) & (F.col("c.end") > F.length("head"))
    return found.filter(meets).select("c.kind", "c.s", "c.before", "c.after", "label", "fold")


def boost(patterns: list[tuple[int, float, float]], rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Depth-two trees (feature, (feature, value, value), (feature, value, value)) on rows (mask, positives, all)."""
    scores = [0.0] * len(patterns)
    bits = [[f for f in range(N_FEATURES) if mask >> f & 1] for mask, _, _ in patterns]
    trees = []

    def leaf(g: float, h: float) -> tuple[float, float]:
        return g / (h + 1.0) * rate, g * g / (h + 1.0)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        g = [pos - n * q for (_, pos, n), q in zip(patterns, p, strict=True)]
        h = [n * q * (1 - q) for (_, _, n), q in zip(patterns, p, strict=True)]

        def split(rows: list[int]) -> tuple[float, int, float, float]:
            all_g, all_h = sum(g[i] for i in rows), sum(h[i] for i in rows)  # noqa: B023
            on_g, on_h = [0.0] * N_FEATURES, [0.0] * N_FEATURES
            for i in rows:
                for f in bits[i]:
                    on_g[f] += g[i]  # noqa: B023
                    on_h[f] += h[i]  # noqa: B023
            best = (-1.0, 0, 0.0, 0.0)
            for f, (a, b) in enumerate(zip(on_g, on_h, strict=True)):
                (no, x), (yes, y) = leaf(all_g - a, all_h - b), leaf(a, b)
                if x + y > best[0] + 1e-9:
                    best = (x + y, f, no, yes)
            return best

        rows = list(range(len(patterns)))
        root = split(rows)[1]
        sides = []
        for value in (0, 1):
            mine = [i for i in rows if (patterns[i][0] >> root & 1) == value]
            _, f, no, yes = split(mine)
            sides.append((f, no, yes))
            for i in mine:
                scores[i] += yes if patterns[i][0] >> f & 1 else no
        trees.append((root, *sides))
    return trees


def tree_score(trees: list[tuple], mask: int) -> float:
    total = 0.0
    for root, no, yes in trees:
        f, a, b = yes if mask >> root & 1 else no
        total += b if mask >> f & 1 else a
    return total


def calibrate(rows: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """(least score, probability), from the highest score down, of rows (score, positives, all): the rates that fall with the score
    and fit best (neighbours that don't fall are pooled), each with half a row of either label added."""
    pools: list[list[float]] = []
    for score, pos, n in sorted(rows, reverse=True):
        if pools and pools[-1][0] == score:
            pools[-1][1] += pos
            pools[-1][2] += n
        else:
            pools.append([score, pos, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] <= pools[-1][1] * pools[-2][2]:
            score, pos, n = pools.pop()
            pools[-1] = [score, pools[-1][1] + pos, pools[-1][2] + n]
    return [(score, (pos + 0.5) / (n + 1)) for score, pos, n in pools]


def fit(rows: DataFrame) -> tuple[list[tuple], dict[int, float]]:
    """Trees, and per kind the lowest score whose calibrated probability is at least CERTAIN (none: never selected).

    rows: as from `labelled`. Only sums per feature pattern come to the driver, at most one per row of
    the bounded training table.
    """
    sums = (
        rows.filter(F.col("fold") != TEST)
        .select(features(F.col("kind"), F.col("s"), F.col("before"), F.col("after")).alias("mask"), "kind", "label", (F.col("fold") == CALIBRATION).alias("held"))
        .groupBy("mask", "kind", "held")
        .agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
        .collect()
    )
    sums.sort(key=lambda r: (r.mask, r.kind, r.held))
    trees = boost([(r["mask"], float(r["pos"]), float(r["n"])) for r in sums if not r["held"]])
    limits = {}
    for kind in {r["kind"] for r in sums}:
        steps = calibrate([(tree_score(trees, r["mask"]), float(r["pos"]), float(r["n"])) for r in sums if r["held"] and r["kind"] == kind])
        certain = [score for score, p in steps if p >= CERTAIN]
        if certain:
            limits[kind] = min(certain) - 1e-9
    return trees, limits


class Selector:
    """Trained trees and thresholds as column expressions."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        self.trees, self.limits = fit(labelled(spark, docs))

    def score(self, mask: Column) -> Column:
        def bit(f: int) -> Column:
            return mask.bitwiseAND(1 << f) != 0

        total = F.lit(0.0)
        for root, no, yes in self.trees:
            low, high = (F.when(bit(f), b).otherwise(a) for f, a, b in (no, yes))
            total = total + F.when(bit(root), high).otherwise(low)
        return total

    def selects(self, kind: str, s: Column, before: Column, after: Column) -> Column:
        at = KINDS.index(kind)
        if at not in self.limits:
            return F.lit(False)
        return _let(features(F.lit(at), s, before, after), lambda m: self.score(m) >= self.limits[at])

    def selecting(self, kind: str) -> Callable[[Column], Column]:
        return lambda c: self.selects(kind, c["s"], c["before"], c["after"])


def _blanked(text: Column) -> Column:
    """text with its base spans blanked out."""
    for k, _, _ in BASE:
        text = replace(text, k, lambda s, _b, _a, k=k: passes(k, s), lambda m: F.repeat(F.lit("\u0001"), F.length(m)))
    return text


def find_spans(docs: DataFrame, selector: Selector) -> DataFrame:
    """docs with base_spans and more_spans: arrays of structs (start, kind, end), sorted; kind is a number in KINDS.

    docs needs a text column; a null or empty text has no spans. Of selected proposals that overlap, the
    one that starts first stays, the longer of two. All other columns stay as they are, but that columns named
    base_spans and more_spans are replaced.
    """
    own = "t"
    while any(own in c.lower() for c in docs.columns):  # names that no column has
        own += "_t"
    text, base, masked, more = (f"{own}{i}" for i in range(4))
    names = [c for c in docs.columns if c.lower() not in ("base_spans", "more_spans")]
    out = docs.withColumn(text, F.coalesce("text", F.lit("")))
    out = out.withColumn(base, F.flatten(F.array(*(F.filter(find(F.col(text), k), _passing(k)) for k, _, _ in BASE))))
    out = out.withColumn(masked, F.when(F.size(base) == 0, F.col(text)))
    out = out.withColumn(masked, F.coalesce(masked, _blanked(F.col(text))))
    found = F.flatten(F.array(*(F.filter(find(F.col(masked), k), selector.selecting(k)) for k, _, _ in EXTRA)))
    out = out.withColumn(more, F.sort_array(F.transform(found, lambda c: F.struct(c["start"], (-c["end"]).alias("end"), c["kind"]))))
    # Matches of one generator don't overlap, so an overlap is with one of the few before it in order.
    near = len(EXTRA)
    alone = F.filter(
        more,
        lambda c, i: ~F.exists(
            F.slice(more, F.greatest(i - near, F.lit(0)) + 1, F.least(i, F.lit(near))), lambda o: -o["end"] > c["start"]
        ),
    )
    span = lambda start, kind, end: F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"))
    return out.select(
        *(F.col(f"`{c}`") for c in names),
        F.sort_array(F.transform(base, lambda c: span(c["start"], c["kind"], c["end"]))).alias("base_spans"),
        F.transform(alone, lambda c: span(c["start"], c["kind"], -c["end"])).alias("more_spans"),
    )


def _without(text: Column, spans: Column) -> Column:
    """text with spans (sorted by start) replaced by their kind in brackets; a span that begins within one before it has no
    mark of its own, and what it adds goes too."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    zero = F.lit(0).cast("long")
    # Blocks keep the cost of cutting near linear, and greatest ends by blocks of spans that of overlaps.
    size = 4096
    blocks = F.transform(F.sequence(zero, F.floor(F.length(text) / size)), lambda b: F.substring(text, (b * size + 1).cast("int"), F.lit(size)))
    furthest = lambda xs: F.aggregate(xs, zero, lambda a, x: F.greatest(a, x["end"]))

    def between(cut: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / size).cast("int")
        joined = F.array_join(F.slice(cut, first + 1, F.floor(end / size).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(joined, (start - first * size + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    def whole(cut: Column, ends: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            b = F.floor(i / _BLOCK).cast("int")
            before = F.greatest(F.get(ends, b), furthest(F.slice(spans, b * _BLOCK + 1, i % _BLOCK)))
            return _let(before, lambda e: F.when(c["start"] >= e, F.concat(between(cut, e, c["start"]), F.get(names, c["kind"]))).otherwise(""))

        last = F.get(ends, F.size(ends) - 1)
        return F.concat(F.array_join(F.transform(spans, one), ""), between(cut, last, F.length(text).cast("long")))

    def over(cut: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _BLOCK).cast("int")), lambda b: furthest(F.slice(spans, b * _BLOCK + 1, F.lit(_BLOCK))))
        ends = F.aggregate(each, F.array(zero), lambda a, x: F.array_append(a, F.greatest(F.get(a, F.size(a) - 1), x)))
        return _let(ends, lambda e: whole(cut, e))

    return F.when(F.size(spans) == 0, text).otherwise(_let(blocks, over))


def redact(docs: DataFrame, selector: Selector) -> DataFrame:
    """docs with each span of `find_spans` in text replaced by its kind in brackets; null texts stay null, other columns as they are."""
    own = "spans"
    while any(own in c.lower() for c in docs.columns):
        own += "_s"
    found = find_spans(docs.select("*", F.struct("*").alias(own)), selector)
    found = found.select(own, F.sort_array(F.concat("base_spans", "more_spans")).alias(f"{own}_s"))
    columns = [F.col(f"{own}.`{c}`") if c != "text" else F.when(F.col(f"{own}.text").isNotNull(), _without(F.col(f"{own}.text"), F.col(f"{own}_s"))).alias(c) for c in docs.columns]
    return found.select(*columns)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, Selector(spark, docs))
    counts = [F.size(F.filter("base_spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k, _, _ in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_written(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _written(F.sort_array(F.concat("base_spans", "more_spans"))).alias("spans"),
    )
