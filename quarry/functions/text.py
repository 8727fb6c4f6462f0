"""Text functions, all as expressions over columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLET = "•"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once a row however often the body names it."""
    return F.transform(F.array(value), body)[0]


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space of any kind become one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_extracted(text: Column) -> Column:
    """Line ends, bullets, template leftovers and blank lines of text taken from a page layout."""
    for pattern, put in (
        (r"\r\n?", "\n"), ("\u007f", f"\n{BULLET} "), ("[●▪◦]", BULLET), (r"(?i)\{generate_achievements\([^}]*\)\}", ""),
        (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"),
    ):
        text = F.regexp_replace(text, pattern, put)
    return trim_all(text)


def normalize_match(text: Column) -> Column:
    """Lower case; whatever is none of a-z 0-9 + # . parts words."""
    low = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(low, "[^a-z0-9+#.]+", " "))


def bullets(text: Column) -> Column:
    """The items after each bullet; what stands before the first is no item."""
    items = F.slice(F.split(F.coalesce(text, F.lit("")), BULLET, -1), 2, 1 << 30)
    return F.filter(F.transform(items, collapse), lambda x: x != "")


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1), trim_all), lambda x: x != "")


def title_case(text: Column) -> Column:
    """Every letter after a non-letter is a capital, every other one is small."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}*\P{L}|\p{L}+"), F.lit(0))  # each ends at its first non-letter, so only its head follows one
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, stripped; null if there is none."""
    return F.when(text.rlike(pattern), trim_all(F.regexp_extract(text, pattern, group)))


def labelled(text: Column, label: str) -> Column:
    return found(text, rf"(?i){label}:\s*([^\n]+)")


def years_of_experience(text: Column) -> Column:
    return found(text, r"(?i)(\d+(?:\.\d+)?)\+\s*years").cast("double")


def year(text: Column) -> Column:
    return found(text, r"\b(19\d{2}|20\d{2})\b").cast("int")


def short_number(x: Column) -> Column:
    """A number without a trailing .0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def sections(text: Column, headings: tuple[str, ...]) -> Column:
    """Map from heading to the text under it; a line that is a heading begins a section, of a repeated one the last stays.

    PREAMBLE is what stands above the first heading, the whole text if there is none; absent if blank.
    """
    own = "|".join(sorted(headings, key=len, reverse=True))
    marked = F.regexp_replace(text, rf"(?m)^({own})\s*$", "\u0001$1\u0002")
    entry = lambda p: F.struct(F.substring_index(p, "\u0002", 1).alias("key"), trim_all(F.substring_index(p, "\u0002", -1)).alias("value"))

    def last_of_each(named: Column) -> Column:
        last = F.filter(named, lambda e: F.size(F.filter(named, lambda x: x["key"] == e["key"])) == 1)
        repeated = F.filter(F.transform(F.array_distinct(F.transform(named, lambda e: e["key"])), lambda k: F.element_at(F.filter(named, lambda x: x["key"] == k), -1)), lambda e: F.size(F.filter(named, lambda x: x["key"] == e["key"])) > 1)
        return F.concat(last, repeated)

    def entries(parts: Column) -> Column:
        before = F.array(F.struct(F.lit("PREAMBLE").alias("key"), trim_all(F.get(parts, F.lit(0))).alias("value")))
        head = F.filter(before, lambda e: (e["value"] != "") | (F.size(parts) == 1))
        return F.concat(head, let(F.transform(F.slice(parts, 2, 1 << 30), entry), last_of_each))

    return F.map_from_entries(let(F.split(marked, "\u0001", -1), entries))


def contains_any(text: Column, needles) -> Column:
    """Whether any needle occurs; the text is worked out once a row, however many needles there are. An empty needle occurs nowhere; null for a null text."""
    own = [n for n in needles if n]
    return F.exists(F.array(text), lambda t: reduce(Column.__or__, [t.contains(n) for n in own], F.lit(False)))
