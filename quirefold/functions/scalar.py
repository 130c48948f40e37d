"""Scalar functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirefold.lang.dates import LAYOUTS, PATTERNS
from quirefold.plans.column import java_regex


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})\\z"


def parse_datetime(text: Column) -> Column:
    """The moment a text names, as lang.dates.parse_datetime finds it, without leaving the JVM; null if no layout fits."""
    out = None
    for layout, pattern in zip(LAYOUTS, PATTERNS, strict=True):
        names = sorted(pattern.groupindex, key=pattern.groupindex.get)
        java = re.sub(r"\(\?P<\w+>", "(", pattern.pattern)
        part = {n: F.regexp_extract(text, _whole(java), i + 1) for i, n in enumerate(names)}
        number = lambda n, part=part: part[n].try_cast("int")
        year = number("Y") if "Y" in part else number("y") + F.when(number("y") >= 69, 1900).otherwise(2000)
        if "m" in part:
            month = number("m")
        else:
            at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(part["b"], 1, 3)))
            month = ((at + 2) / 3).cast("int")
        hour = number("H") if "H" in part else F.lit(0)
        if "I" in part:
            hour = number("I") % 12 + F.when(part["p"] == "PM", 12).otherwise(0)
        minute = number("M") if "M" in part else F.lit(0)
        second = number("S") if "S" in part else F.lit(0)
        made = F.try_make_timestamp_ntz(year, month, number("d"), hour, minute, second.cast("decimal(8,6)"))
        if "I" in part:
            made = F.when(number("I").between(1, 12), made)
        if "z" in part:
            digits = F.regexp_replace(part["z"], "[^0-9]", "")
            minutes = F.coalesce(F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
            shift = F.when(part["z"].startswith("-"), minutes).otherwise(-minutes)
            made = made + F.make_dt_interval(mins=shift)
        this = F.when(text.rlike(_whole(java)), made)
        out = this if out is None else F.coalesce(out, this)
    return out


def fuzz_seconds(moment: Column) -> Column:
    """How many seconds around a date still count as it."""
    hour = 3600
    return (
        F.when(F.second(moment) != 0, 300)
        .when(F.minute(moment) != 0, 1800)
        .when(F.hour(moment) != 0, 4 * hour)
        .when(F.dayofmonth(moment) != 1, 84 * hour)
        .when(F.month(moment) != 1, 336 * hour)
        .otherwise(4380 * hour)
    )


def fuzz_datetime(moment: Column) -> tuple[Column, Column]:
    """First and last moment a vague date stands for."""
    d = F.make_dt_interval(secs=fuzz_seconds(moment).cast("decimal(18,6)"))
    return moment - d, moment + d


def regexp(text: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere."""
    return text.rlike(java_regex(pattern))


def match(text: Column, phrase: str) -> Column:
    """Whether the phrase is found anywhere, whatever the case; phrases of less than three characters never are."""
    return F.contains(F.lower(text), F.lower(F.lit(phrase))) if len(phrase) >= 3 else text.isNotNull() & F.lit(False)


def contains_sliced(text: Column, phrase: Column, left: int, right: int) -> Column:
    """Whether the characters left to right (not included) of the phrase stand anywhere in the text; places outside the phrase
    are moved to its ends, and an empty slice stands everywhere."""
    first = max(left, 0)
    return F.contains(text, F.substring(phrase, first + 1, max(right - first, 0)))


def nearest(word: Column, words: list[str], ceiling: int) -> Column:
    """The nearest of some words by edit distance (ties: the first), null unless it is nearer than `ceiling`."""
    cases = F.array(*[F.struct(F.levenshtein(word, F.lit(w)).alias("d"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)])
    best = F.array_min(cases)
    return F.when(best["d"] < ceiling, best["w"])


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def rfc3339(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def http_date(moment: Column) -> Column:
    return F.date_format(moment, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def epoch(moment: Column) -> Column:
    """Seconds since 1970 of a moment in UTC without zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), moment)


def from_epoch(seconds: Column) -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
