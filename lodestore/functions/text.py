"""Text expressions over columns; all stay in the JVM unless said otherwise.

Lower case here is Spark's ``lower``; the full case folding and NFKC of ``normalize`` need Python and are in
``functions.unicode``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a keyword query leaves out.
STOP_WORDS = ("的", "了", "是", "吗", "呢", "多少", "什么", "可以", "这个", "这种", "我", "帮", "请", "公司", "能", "多高")
IDENTIFIER = r"[a-z0-9]+(?:[-_.][a-z0-9]+)+"
WORD_RUN = r"[\p{L}\p{N}]+"
UNSAFE = r"[/\\:\x00-\x1f<>|?*]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold(text: Column) -> Column:
    """Letters and digits only, lower case: the key by which names are compared (STR04)."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def squash(text: Column) -> Column:
    """Without white space (STR05)."""
    return F.regexp_replace(text, r"\s+", "")


def squash_lower(text: Column) -> Column:
    return F.lower(squash(text))


def field(text: Column, most: int = 90) -> Column:
    """A title part: unsafe characters to spaces, underscores to hyphens, trimmed and cut (STR06)."""
    cleaned = F.replace(F.regexp_replace(text, UNSAFE, " "), F.lit("_"), F.lit("-"))
    return F.left(F.btrim(F.regexp_replace(cleaned, r"\s+", " "), F.lit(" .-_")), F.lit(most))


def code_field(text: Column, most: int = 120) -> Column:
    """Empty where unsafe characters occur (STR06)."""
    return F.when(text.isNull() | text.rlike(UNSAFE), F.lit("")).otherwise(F.left(F.btrim(text), F.lit(most)))


def opening_excerpt(text: Column, budget: int = 780, tail: int = 280) -> Column:
    """Non-blank lines with single spaces; if longer than ``budget``, its head, a line break and the last ``tail`` (STR07)."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    compact = F.array_join(lines, "\n")
    return F.when(F.length(compact) <= budget, compact).otherwise(F.concat(F.left(compact, F.lit(budget - tail - 1)), F.lit("\n"), F.right(compact, F.lit(tail))))


def without_nul(text: Column) -> Column:
    """NUL to space (STR10)."""
    return F.replace(text, F.lit("\0"), F.lit(" "))


def identifiers(text: Column) -> Column:
    """Product identifiers as wholes (STR02)."""
    return F.regexp_extract_all(F.lower(text), F.lit(IDENTIFIER), F.lit(0))


def segmented(text: Column) -> Column:
    """Lower-case word runs followed by whole identifiers, which therefore count twice (STR02).

    Runs of Chinese characters have no blanks between words and there is no dictionary here, so a run of more than two is
    all its pairs of neighbours: a word of the query is found wherever it stands in a sentence.
    """
    low = F.lower(text)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
    mixed = F.regexp_extract_all(low, F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))
    runs = F.flatten(F.transform(mixed, lambda r: F.when(r.rlike(r"^\p{IsHan}{3,}"), pairs(r)).otherwise(F.array(r))))
    return F.concat(F.when(low.rlike(r"\p{IsHan}"), runs).otherwise(F.regexp_extract_all(low, F.lit(WORD_RUN), F.lit(0))), identifiers(text))


def keywords(text: Column) -> Column:
    """Distinct tokens of a query, in order, without stop words (STR03, ORD11)."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    return F.array_distinct(F.filter(segmented(text), lambda t: ~F.array_contains(stop, t)))


def quoted_query(text: Column) -> Column:
    """The keywords as an OR of quoted terms."""
    return F.array_join(F.transform(keywords(text), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit("")), F.lit('"'))), " OR ")


def email(text: Column) -> Column:
    """Trimmed lower case; null for what has not the shape of an address (STR09)."""
    clean = F.lower(F.btrim(text))
    return F.when(clean.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), clean)


def renamed(title: Column, previous: Column, official: Column) -> Column:
    """A title whose first part ``previous`` becomes ``official`` (STR11)."""
    return F.when(F.startswith(title, F.concat(previous, F.lit("_"))), F.concat(official, F.substring(title, F.length(previous) + 1, F.length(title)))).otherwise(title)


def opportunity_code(year: Column, serial: Column) -> Column:
    return F.format_string("OPP-%d-%06d", year, serial)


def is_opportunity_code(text: Column) -> Column:
    """STR13: such a query looks up files."""
    return F.btrim(text).rlike(r"(?i)^OPP-[0-9]{4}-[0-9]{6}$")


def parse_timeout(size: Column) -> Column:
    """Seconds by file size: 120 and one for each 512 KiB, at most 600 (STR15)."""
    return F.least(F.lit(120) + F.floor(size / F.lit(512 * 1024)), F.lit(600)).cast("long")


# Fixed value: the grammar of a reading, with its diameter or radius mark, sign and degree mark.
NUMBER = r"(?<![A-Za-z0-9_.])(?:[φRr]\s*)?(?:[+±-]\s*)?\p{Nd}+(?:[.,]\p{Nd}+)*(?:\s*°)?"


@cache
def _compatible() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """By rule from the Unicode tables: characters whose NFKC form is one other character that matters to readings, these
    forms, and those whose form has several characters."""
    one, several = {}, []
    for code in range(0x80, 0x10000):
        form = unicodedata.normalize("NFKC", chr(code))
        if form != chr(code) and re.search(r"[\dA-Za-z_.,+±°φΦØøρ\s−-]", form) and not 0xD800 <= code < 0xE000:
            if len(form) == 1:
                one[chr(code)] = form
            elif re.search(r"[\d°±+−-]", form):
                several.append((chr(code), form))
    return "".join(one), "".join(one.values()), tuple(several)


def _one_of(characters: str) -> str:
    """A character class in ranges of neighbours."""
    codes, ranges = sorted(map(ord, set(characters))), []
    for code in codes:
        if ranges and code == ranges[-1][1] + 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ranges) + "]"


def compatible(text: Column) -> Column:
    """NFKC, as far as readings are concerned: full-width and raised forms become plain ones. Stays in the JVM; ASCII
    texts are left alone, and the few forms of several characters are replaced only in texts that have one."""
    from_, to, several = _compatible()
    plain = F.translate(text, from_, to)
    spelled = plain
    for mark, form in several:
        spelled = F.replace(spelled, F.lit(mark), F.lit(form))
    marks = _one_of("".join(m for m, _ in several))
    return F.when(F.octet_length(text) == F.char_length(text), text).when(text.rlike(marks), spelled).otherwise(plain)


def numeric_tokens(text: Column) -> Column:
    """Distinct readings of a text (STR14): compatibility forms and marks unified, white space removed, in order of appearance."""
    unified = F.translate(compatible(text), "ΦØø⌀−", "φφφφ-")
    return F.array_distinct(F.transform(F.regexp_extract_all(unified, F.lit(NUMBER), F.lit(0)), lambda t: F.translate(t, "r \t\n\x0b\f\r", "R")))


def equivalent_number(token: Column) -> Column:
    """Plain decimals without the zeros that do not count; codes and commas stay as they are."""
    return F.regexp_replace(token, r"^([φR]?[+±-]?)0*([0-9]+?)(?:\.0*|(\.[0-9]*?[1-9])0*)?(°?)$", "$1$2$3$4")


def with_numeric_gaps(df: DataFrame, evidence: str, summary: str, gaps: str = "gaps", readings: str = "readings") -> DataFrame:
    """``df`` with the readings of the evidence and, sorted, those without an equivalent in the summary (AGG13, SET03).

    The readings are a column that two expressions use, so it is computed once a row; the keys of the summary are bound,
    or the optimizer would move them into the lambda and compute them for every reading.
    """
    known = F.transform(numeric_tokens(F.col(summary)), equivalent_number)
    missing = bind(known, lambda keys: F.array_sort(F.filter(readings, lambda t: ~F.array_contains(keys, equivalent_number(t)))))
    return df.withColumn(readings, numeric_tokens(F.col(evidence))).withColumn(gaps, missing)


def numeric_gaps(evidence: Column, summary: Column) -> Column:
    """The same as one expression, for rows that are few."""
    actual = F.transform(numeric_tokens(summary), equivalent_number)
    return bind(actual, lambda known: F.array_sort(F.filter(numeric_tokens(evidence), lambda t: ~F.array_contains(known, equivalent_number(t)))))


# The characters of a bare dimension. They must be these for the same texts to count as drawing text (FLT15).
DIMENSION_MARKS = {
    "digits and separators": "0123456789.,",
    "signs": "+-−–—±=*/xX×",
    "brackets": "()[]<>",
    "degrees and diameters": "°ºφΦØø⌀",
    "letters of radii, fits and threads": "RrHhMmKkFfGgJjSsPp",
}


def meaningful(text: Column) -> Column:
    """Drawing text worth finding (FLT15): a code (three numbers or more, joined by dots, underscores, slashes or hyphens,
    and perhaps a word), or what has two letters and other characters than a bare dimension."""
    clean = F.btrim(text)
    code = clean.rlike(r"^[0-9]+([._/-][0-9]+){2,}([._/-][A-Za-z0-9_]+)?$")
    beyond = F.translate(F.regexp_replace(clean, r"\s", ""), "".join(DIMENSION_MARKS.values()), "") != ""
    return (clean != "") & (code | (beyond & (F.regexp_count(clean, F.lit(r"\p{L}")) >= 2)))


def broken_mapping(text: Column) -> Column:
    """Glyphs of a corrupt font mapping (FLT16)."""
    n = F.length(squash(text)).cast("double")
    controls = F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    odd, lost = F.regexp_count(text, F.lit(r"[ƀ-ɏ]")), F.regexp_count(text, F.lit(r"�"))
    return (n > 0) & (((lost >= 3) & (lost / n >= 0.05)) | ((odd >= 5) & (odd / n >= 0.5)) | ((controls >= 2) & (odd >= 5) & (odd / n >= 0.15)))


def safe_filename(name: Column) -> Column:
    """FLT18."""
    return ~(name.isin(".", "..", "") | name.rlike(r"[/\\:\x00-\x1f]") | name.rlike(r"^(~\$|\.~)"))


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^./]+$", "")


#: Title parts that are no business type of their own.
GENERIC_PARTS = r"(?:技术文件章节|方案文档|项目资料|技术资料|资料|文档|文件|章节|其他|未知)"


def generic_title_stored(title: Column) -> Column:
    """As the review queue sees it: a generic part before an underscore or a dot (FLT07)."""
    return title.rlike(f"_{GENERIC_PARTS}(_|\\.)")


def generic_title_named(title: Column) -> Column:
    """As naming sees it: any part but the first ends generically, also without an extension (FLT07)."""
    parts = F.split(stem(title), "_")
    return F.exists(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.btrim(p).rlike(f"^{GENERIC_PARTS}$"))


def shared_identifiers(left: Column, right: Column) -> Column:
    """Tokens of four characters with a digit that both have, sorted (SET06)."""
    of = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9-]{4,}"), F.lit(0)), lambda t: t.rlike("[0-9]")))
    return F.array_sort(F.array_intersect(of(left), of(right)))


def masked(secret: Column) -> Column:
    """First three characters, twelve stars, last four; stars alone for what is shorter than twelve (OPS02)."""
    stars = F.repeat(F.lit("*"), F.lit(12))
    return F.when(F.length(secret) < 12, stars).otherwise(F.concat(F.left(secret, F.lit(3)), stars, F.right(secret, F.lit(4))))
