"""Text keys and coding rules as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Role suffixes by variant, stripped in order, and the punctuation that keys drop.
ROLE_SUFFIXES = (
    r"에\s*(?:대한|관한)\s*(?:지식|이해|기술|능력|태도|방법)$",
    r"(?:지식|이해|기술|능력|태도|방법|역량|스킬|기법|노하우)$",
)
VARIANTS = {
    "none": (),
    "phrase_only": ROLE_SUFFIXES[:1],
    "base": ROLE_SUFFIXES,
    "plus": (
        *ROLE_SUFFIXES,
        r"에\s*(?:대한|관한)\s*(?:이해도|숙지|파악|활용|적용|고려)$",
        r"(?:관련\s*)?(?:이해도|숙지|파악|활용\s*능력|적용\s*능력|관련\s*지식|관련\s*기술|관련\s*법규)$",
    ),
    "attitude": (
        *ROLE_SUFFIXES,
        r"(?:하려는|하고자\s*하는|하는|려는|는)\s*(?:자세|의지|노력|마음가짐|마음|태도)$",
        r"(?:자세|의지|노력|마음가짐|마음)$",
    ),
}
KEY_PUNCTUATION = r"[\s·•·\-–—_/\\(){}\[\]<>,.:;!?'\"“”‘’`~^*+=|]+"
LABEL_PUNCTUATION = r"[\s\-–—_/\\(){}\[\]<>,.:;!?'\"“”‘’`~^*+=|&]+"
# Sentence template, its strict form, code suffix, vocabularies and codebook.
TEMPLATE = r"수\s*있다\s*\.?\s*\z"
TEMPLATE_STRICT = r"수 있다\.?\z"
CODE_SUFFIX = r"_(\d{2})v(\d+)\z"
DIGITAL_A = ("디지털", "데이터", "인공지능", "AI", "소프트웨어", "자동화", "프로그램", "전산")
DIGITAL_B = (*DIGITAL_A, "IoT", "빅데이터", "클라우드", "정보시스템", "온라인", "스마트")
DIGITAL_C = ("디지털", "데이터", "인공지능", "AI", "소프트웨어", "자동화")
ATTITUDES = (
    ("준수·안전", ("준수", "안전", "규정", "법규", "지침", "매뉴얼", "규격", "기준")),
    ("윤리·책임", ("윤리", "책임", "청렴", "공정", "보안", "비밀", "정직", "신뢰")),
    ("대인·소통", ("소통", "커뮤니케이션", "협력", "협업", "친절", "고객", "배려", "존중", "팀")),
    ("인지·분석", ("분석", "전략", "논리", "판단", "관찰", "탐구", "창의", "통찰", "사고")),
    ("품질·정확", ("정확", "품질", "꼼꼼", "세밀", "철저", "정밀", "완벽", "치밀")),
    ("의지·노력", ("의지", "노력", "적극", "능동", "성실", "열정", "자세", "마음", "태도")),
)
OTHER = "기타"
_EDGE_SPACE = r"(?U)^\s+|\s+\z"


@F.udf(StringType(), useArrow=True)
def _nfkc(text):
    return None if text is None else unicodedata.normalize("NFKC", text)


def nfkc(text: Column) -> Column:
    """NFKC form; ASCII text, which is its own, does not leave the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def strip(text: Column) -> Column:
    """text without Unicode white space at both ends."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def clean(text: Column) -> Column:
    """Stripped text, null if empty."""
    return F.nullif(strip(text.cast("string")), F.lit(""))


def clean_int(text: Column) -> Column:
    """The whole part of a number in a text, null if there is none."""
    return clean(text).try_cast("double").try_cast("int")


def matches_any(text: Column, terms: Sequence[str], ignore_case: bool = False) -> Column:
    """Whether a text contains one of the terms."""
    return text.rlike(("(?i)" if ignore_case else "") + "|".join(map(re.escape, terms)))


def code_year(code: Column, pattern: str = CODE_SUFFIX) -> Column:
    """Year of a code with a _YYvN suffix, else null."""
    return F.lit(2000) + F.nullif(F.regexp_extract(code, pattern, 1), F.lit("")).cast("int")


def code_version(code: Column, pattern: str = CODE_SUFFIX) -> Column:
    return F.nullif(F.regexp_extract(code, pattern, 2), F.lit("")).cast("int")


def last_word(code: Column) -> Column:
    """What follows the last space."""
    return F.regexp_replace(code, "^.* ", "")


def strip_suffixes(text: Column, patterns: Sequence[str] = ROLE_SUFFIXES) -> Column:
    """text without the suffixes, in order; a step that would leave nothing is not taken."""
    out = strip(text)
    for pattern in patterns:
        shorter = strip(F.regexp_replace(out, pattern.replace("$", r"\z"), ""))
        out = F.when(shorter != "", shorter).otherwise(out)
    return out


def key_of(normal: Column, patterns: Sequence[str] = ROLE_SUFFIXES, punctuation: str = KEY_PUNCTUATION) -> Column:
    """The key of a text in NFKC form: suffixes, punctuation and case removed; of the whole text if that is
    empty; '' for null."""
    bare = lambda x: F.lower(F.regexp_replace(x, "(?U)" + punctuation, ""))
    text = F.coalesce(normal, F.lit(""))
    core = bare(strip_suffixes(text, patterns))
    return F.when(core != "", core).otherwise(bare(text))


def normalize_key(text: Column, patterns: Sequence[str] = ROLE_SUFFIXES) -> Column:
    return key_of(strip(nfkc(text)), patterns)


def normalize_space(text: Column) -> Column:
    """NFKC form without any white space."""
    return F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), r"(?U)\s+", "")


def label_key(text: Column) -> Column:
    """Lower-cased NFKC form without punctuation."""
    return F.regexp_replace(F.lower(nfkc(text)), "(?U)" + LABEL_PUNCTUATION, "")


def strip_inflection(word: Column) -> Column:
    """An English word without a plural or verb ending, if enough of it is left."""
    n = F.length(word)
    out = F.when((n >= 5) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y")))
    for suffix in ("ing", "ed", "es", "s"):
        k = len(suffix)
        out = out.when((n >= 4 + k) & word.endswith(suffix), F.substring(word, F.lit(1), n - k))
    return out.otherwise(word)


def inflected_key(text: Column) -> Column:
    """label_key after strip_inflection of each word."""
    words = F.filter(F.split(F.lower(nfkc(text)), r"(?U)[\s\-–—_/]+"), lambda w: w != "")
    return F.regexp_replace(F.array_join(F.transform(words, strip_inflection), " "), "(?U)" + LABEL_PUNCTUATION, "")


def split_labels(cell: Column) -> Column:
    """Labels of a cell that are separated by line feeds or bars."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"\n+|\|"), strip), lambda x: x != "")


def is_released(status: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(strip(status), F.lit("")), F.lit("released"))) == "released"


def relation(kind: Column) -> Column:
    return F.when(F.lower(strip(kind)).startswith("essential"), "essential").otherwise("optional")


def stratum(n: Column) -> Column:
    """Reuse stratum by the number of jobs."""
    return F.when(n >= 10, "10+").when(n >= 3, "3-9").when(n == 2, "2").when(n == 1, "1").otherwise("0")


def size_bucket(n: Column) -> Column:
    return F.when(n <= 2, "2").when(n <= 5, "3-5").when(n <= 20, "6-20").when(n <= 100, "21-100").otherwise("100+")


def band(value: Column, edges: Sequence[float]) -> Column:
    """Number of the half-open band [edge, next edge) from 0; null outside."""
    out = F.lit(None).cast("int")
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        out = F.when((value >= low) & (value < high), i).otherwise(out)
    return out


def first_match(text: Column, codebook=ATTITUDES, other: str = OTHER) -> Column:
    """The first category with a term in the text; order is priority."""
    return F.coalesce(*(F.when(_contains(text, terms), F.lit(name)) for name, terms in codebook), F.lit(other))


def all_matches(text: Column, codebook=ATTITUDES) -> Column:
    """All categories with a term in the text, in order."""
    return F.filter(F.array(*(F.when(_contains(text, terms), F.lit(name)) for name, terms in codebook)), lambda x: x.isNotNull())


def by_order(hits: Column, order: Sequence[str], other: str = OTHER) -> Column:
    """The first category of an order among those matched."""
    return F.coalesce(F.get(F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains(hits, x)), F.lit(0)), F.lit(other))


def random_order(order: Sequence[str], draw: Column, seed: int = 20260909) -> Column:
    """A codebook's categories in a pseudo-random order that the number of the draw names."""
    keyed = F.array(*(F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), F.lit(c)).cast("binary")).alias("h"), F.lit(c).alias("c")) for c in order))
    return F.transform(F.sort_array(keyed), lambda x: x["c"])


def _contains(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def deviant_type(text: Column) -> Column:
    """How a sentence off the template ends: empty, plain, nominal, template inside, other."""
    t = strip(F.coalesce(text, F.lit("")))
    nominal = t.rlike(r"[가-힣]기\s*\.?\z|[가-힣]{2,}(?<!다)\s*\.?\z") & ~t.endswith(".")
    return (
        F.when(t == "", "empty")
        .when(t.rlike(r"(한다|된다|이다)\s*\.?\z"), "plain")
        .when(nominal, "nominal")
        .when(t.rlike(r"수\s*있(다|음)"), "template inside")
        .otherwise("other")
    )


def is_strict(verdict: Column) -> Column:
    return verdict == "same"


def is_lenient(verdict: Column) -> Column:
    return verdict.isin("same", "hierarchy")


def pair_id(left: Column, right: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("||", left, right)), 1, 12)


# Codes of the raters of the first round, and of their groups.
FIRST_ROUND = ("EV-1", "EV-2", "EV-3", "EV-4", "EV-5", "EV-3B", "EV-4B", "EV-5B")
RATER_GROUPS = (("phd", ("EV-1", "EV-2")), ("staff", ("EV-3", "EV-4", "EV-5")), ("student", ("EV-3B", "EV-4B", "EV-5B")))


def rater_group(code: Column) -> Column:
    """A rater's group by code: author by prefix, others by the table, external beyond it; null for any other code."""
    c = F.upper(code)
    out = F.when(c.startswith("AU-"), "author")
    for name, codes in RATER_GROUPS:
        out = out.when(c.isin(*codes), name)
    return out.when(c.startswith("EV-"), "external")


def counts_in_first_round(code: Column) -> Column:
    """Whether a rater's judgments belong to the first round: external raters only if they are on its list."""
    c = F.upper(code)
    return ~c.startswith("EV-") | c.isin(*FIRST_ROUND)


def alpha_value(verdict: Column, scale: str) -> Column:
    """A verdict as a value for alpha: 5 as it is, merge and lenient yes or no, 3 same, hierarchy or other with unsure missing."""
    if scale == "5":
        return verdict
    if scale == "merge":
        return F.when(is_strict(verdict), "yes").when(verdict.isNotNull(), "no")
    if scale == "lenient":
        return F.when(is_lenient(verdict), "yes").when(verdict.isNotNull(), "no")
    return F.when(verdict != "unsure", F.when(verdict.isin("same", "hierarchy"), verdict).otherwise("other"))
