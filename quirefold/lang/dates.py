"""Dates in queries and documents: the accepted layouts, and the interval a vague date stands for."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

#: The accepted layouts, tried in this order. `_d` is a day padded with blanks or not at all.
LAYOUTS = (
    "%b _d, %Y", "%B _d, %Y", "%B _d %Y", "%b _d %Y", "%Y %B _d",
    "%Y-%m-%d", "%Y-%m-%d %H:%M:%S",
    "%m/%d %I:%M:%S%p '%y %z",
    "%a %b _d %H:%M:%S %Y", "%a %b _d %H:%M:%S %Z %Y", "%a %b %d %H:%M:%S %z %Y",
    "%d %b %y %H:%M %Z", "%d %b %y %H:%M %z", "%A, %d-%b-%y %H:%M:%S %Z",
    "%a, %d %b %Y %H:%M:%S %Z", "%a, %d %b %Y %H:%M:%S %z",
    "%Y-%m-%dT%H:%M:%S%z",
)
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_PARTS = {
    "%Y": r"(?P<Y>\d{4})", "%y": r"(?P<y>\d{2})", "%m": r"(?P<m>\d{2})", "%d": r"(?P<d>\d{2})", "_d": r" ?(?P<d>\d{1,2})",
    "%H": r"(?P<H>\d{2})", "%I": r"(?P<I>\d{2})", "%M": r"(?P<M>\d{2})", "%S": r"(?P<S>\d{2})(?:[.,]\d+)?", "%p": r"(?P<p>AM|PM)",
    "%b": "(?P<b>" + "|".join(m[:3] for m in _MONTHS) + ")", "%B": "(?P<b>" + "|".join(_MONTHS) + ")",
    "%a": "(?:" + "|".join(d[:3] for d in _DAYS) + ")", "%A": "(?:" + "|".join(_DAYS) + ")",
    "%z": r"(?P<z>Z|[+-]\d{2}:?\d{2})", "%Z": r"(?P<Z>[A-Z]{3,4}(?:[+-]\d{1,2})?)",
}


def _compile(layout: str) -> re.Pattern:
    out = "".join(_PARTS.get(x, re.escape(x)) for x in re.findall(r"%.|_d|.", layout))
    return re.compile(f"(?i:{out})" if "%p" not in layout else out.replace("(?P<p>AM|PM)", "(?P<p>AM|PM)"))


PATTERNS = tuple(_compile(x) for x in LAYOUTS)


def parse_datetime(text: str) -> datetime | None:
    """The moment a text names, in UTC without zone; None if no layout fits.

    Without a zone the text is UTC. Zone names other than UTC have offset zero. Two-digit years from 69 are 19xx. Parts of a
    second are dropped.
    """
    for pattern in PATTERNS:
        if (m := pattern.fullmatch(text)) is None:
            continue
        g = m.groupdict()
        year = int(g["Y"]) if g.get("Y") else int(g["y"]) + (1900 if int(g["y"]) >= 69 else 2000)
        month = int(g["m"]) if g.get("m") else next(i for i, n in enumerate(_MONTHS, 1) if n[:3] == g["b"][:3].lower())
        hour = int(g.get("H") or 0)
        if g.get("I"):
            if not 1 <= int(g["I"]) <= 12:
                continue
            hour = int(g["I"]) % 12 + 12 * (g["p"] == "PM")
        try:
            moment = datetime(year, month, int(g["d"]), hour, int(g.get("M") or 0), int(g.get("S") or 0))
            if g.get("z") and g["z"].upper() != "Z":
                sign = -1 if g["z"][0] == "-" else 1
                digits = g["z"][1:].replace(":", "")
                moment -= sign * timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
        except (ValueError, OverflowError):
            continue
        return moment
    return None


def fuzz(t: datetime) -> timedelta:
    """How far around a date still counts as it: the less exact the date, the wider."""
    if t.second:
        return timedelta(minutes=5)
    if t.minute:
        return timedelta(minutes=30)
    if t.hour:
        return timedelta(hours=4)
    if t.day != 1:
        return timedelta(hours=84)
    if t.month != 1:
        return timedelta(hours=336)
    return timedelta(hours=4380)


def interval(t: datetime) -> tuple[datetime, datetime]:
    """The first and last moment a vague date stands for, within the years Python has."""
    d = fuzz(t)
    low = t - d if t - datetime.min >= d else datetime.min
    high = t + d if datetime.max - t >= d else datetime.max.replace(microsecond=0)
    return low, high


def utc(t: datetime) -> datetime:
    """Any moment as UTC without zone."""
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t
