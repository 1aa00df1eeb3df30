"""Dates, numbers and names in questions, and whether a paraphrase keeps them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from augur.functions.text import strip

#: Month names, patterns of dates and numbers, words that open sentences.
_SHORT = "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
_LONG = "January|February|March|April|May|June|July|August|September|October|November|December"
DATES = (
    r"\b(20\d{2}-\d{2}-\d{2})\b",
    r"\b(20\d{2}/\d{2}/\d{2})\b",
    rf"\b({_LONG}|{_SHORT})\s+\d{{1,2}}(?:,\s*20\d{{2}})?\b",
    rf"\b({_LONG})\s+20\d{{2}}\b",
    r"\b(20\d{2})\b",
)
NUMBER = r"(?<![\w$])(\$?\d+(?:[,.]\d+)?(?:\s*%)?(?:[kKmMbB])?)(?![\w])"
PROPER_RUN = r"\b((?:[A-Z][\w'\-]*\s+)*[A-Z][\w'\-]*)"
OPENERS = (
    "Will Does Is By On At After Before What When Which Who If The A An In "
    "How Are As Of For From To And Or But It This That These Those"
).split()


#: What ``\\w``, ``\\d``, ``\\s`` and ``\\b`` mean over all scripts; Java's own are ASCII.
_W = r"\p{L}\p{N}_"
_CLASSES = {r"\w": _W, r"\d": r"\p{Nd}", r"\s": r"\p{Z}\t-\r\x1c-\x1f\x85"}


def all_scripts(pattern: str) -> str:
    """A pattern with those classes and boundaries spelled out."""

    def one(m: re.Match) -> str:
        if m[0].startswith("["):
            return re.sub(r"\\[wds]", lambda c: _CLASSES[c[0]], m[0])
        if m[0] == r"\b":
            return f"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
        return f"[{_CLASSES[m[0]]}]"

    return re.sub(r"\[(?:\\.|[^\]])*\]|\\[wdsb]", one, pattern)


def extract_dates(text: Column) -> Column:
    found = [F.regexp_extract_all(text, F.lit(all_scripts(p)), F.lit(0)) for p in DATES]
    return F.array_distinct(F.transform(F.flatten(F.array(*found)), strip))


def extract_numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(all_scripts(NUMBER)), F.lit(1)))


def extract_proper_nouns(text: Column) -> Column:
    """Runs of capitalised words, without a sentence's opening word if it is a usual one,
    without dates and single letters."""
    openers = F.array(*map(F.lit, OPENERS))

    def runs(sentence: Column) -> Column:
        s = F.regexp_replace(sentence, all_scripts(r"^\s+"), "")
        first = F.split(s, " ", 2)[0]
        rest = F.regexp_replace(F.substring(s, F.length(first) + 1, F.length(s) + 1), all_scripts(r"^\s+"), "")
        s = F.when(F.array_contains(openers, first), rest).otherwise(s)
        return F.regexp_extract_all(s, F.lit(all_scripts(PROPER_RUN)), F.lit(1))

    spans = F.flatten(F.transform(F.split(text, all_scripts(r"(?<=[.!?])\s+")), runs))
    spans = F.array_distinct(F.transform(spans, strip))
    dated = lambda x: F.size(extract_dates(x)) > 0
    return F.filter(spans, lambda x: ~F.array_contains(openers, x) & ~dated(x) & (F.length(x) > 1))


def _but_years(numbers: Column) -> Column:
    return F.filter(numbers, lambda x: ~x.rlike(all_scripts(r"^20\d{2}$")))


def parts_to_keep(original: Column) -> Column:
    """struct(dates, numbers, names) that a paraphrase must have."""
    return F.struct(extract_dates(original).alias("dates"), _but_years(extract_numbers(original)).alias("numbers"), extract_proper_nouns(original).alias("names"))


def validate_paraphrase(original: Column, candidate: Column, parts: Column | None = None) -> Column:
    """struct(ok, reason): the first of dates, numbers, names, empty, identical that fails. ``parts``:
    :func:`parts_to_keep` of the original, where several candidates are held against it."""
    listed = lambda what, xs: F.concat(F.lit(f"missing {what}: ["), F.array_join(F.transform(F.array_sort(xs), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    parts = parts_to_keep(original) if parts is None else parts
    low = F.lower(candidate)
    # What the original has none of is not looked for.
    lacking = lambda xs, found: F.when(F.size(xs) > 0, F.array_except(xs, found)).otherwise(F.array().cast("array<string>"))

    def judge(p: Column) -> Column:
        return (
            F.when(F.size(p["dates"]) > 0, listed("date(s)", p["dates"]))
            .when(F.size(p["numbers"]) > 0, listed("number(s)", p["numbers"]))
            .when(F.size(p["names"]) > 0, listed("proper noun(s)", p["names"]))
            .when(F.length(strip(candidate)) == 0, "empty")
            .when(strip(candidate) == strip(original), "identical to original")
            .otherwise("")
        )

    missing = F.struct(
        lacking(parts["dates"], extract_dates(candidate)).alias("dates"), lacking(parts["numbers"], _but_years(extract_numbers(candidate))).alias("numbers"),
        F.filter(parts["names"], lambda p: ~F.contains(low, F.lower(p))).alias("names"),
    )
    # An array of one binds what is missing to a name, so that it is found once.
    reason = F.transform(F.array(missing), judge)[0]
    return F.transform(F.array(reason), lambda r: F.struct((r == "").alias("ok"), r.alias("reason")))[0]
