"""Dates in running text: whole and partial, abbreviated, ISO, day or month first, with ordinals, and ranges.

Formats are tried in the order of ``FORMATS`` at each place, the most telling first. What can't be a date in the
calendar is dropped, and so is what stands behind a figure and a point, stroke or hyphen ("7.7.10 may").

Defined results: a null or empty text has no dates. Missing parts come from the parameter ``base`` (its year; the
first of a month): nothing depends on the clock. Two-figure years are taken within 50 years of it, "00" is none.
Of figures alone the first is the month unless it is above 12 or ``day_first`` is set. A month alone counts only
with its full name and a capital, and never "May".
"""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.records import spans
from docloom.functions.text import let

#: Names of months.
MONTHS = (("january", "jan"), ("february", "feb", "febr"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"), ("august", "aug"), ("september", "sep", "sept"), ("october", "oct"), ("november", "nov"), ("december", "dec"))
MONTH_OF = {name: n for n, names in enumerate(MONTHS, 1) for name in names}

_M = "(" + "|".join(sorted(MONTH_OF, key=lambda m: (-len(m), m))) + r")\b\.?"
_D, _Y, _YY, _B = r"([0-3]?[0-9])(?:st|nd|rd|th)?\b", r"([0-9]{4})\b", r"([0-9]{4}|[0-9]{2})\b", r"[ \t\n]"
_DAY = rf"{_D}(?:{_B}+day)?(?:{_B}+of)?"
_TO = rf"{_B}*(?:-|–|\bto\b|\bthrough\b|\buntil\b){_B}*"
#: name -> (pattern, what its groups are: year, month name, month figure, day, the same of a range's end, figures in either order)
FORMATS: dict[str, tuple[str, str]] = {
    "range_of_months": (rf"\b{_M}{_B}*{_D}{_TO}{_M}{_B}*{_D},?{_B}*{_Y}", "M d N e y"),
    "range_of_days": (rf"\b{_M}{_B}*{_D}{_TO}{_D},?{_B}*{_Y}", "M d e y"),
    "iso": (rf"\b([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}})(?:\b|T[0-9:.]+Z?)", "y m d"),
    "year_first": (rf"\b([0-9]{{4}})/([0-9]{{1,2}})/([0-9]{{1,2}})\b", "y m d"),
    "month_day_year": (rf"\b{_M}{_B}*{_D}(?:,{_B}*|{_B}+(?:of{_B}+)?){_Y}", "M d y"),
    "day_month_year": (rf"\b{_DAY}(?:{_B}+|-){_M},?(?:{_B}*|-){_YY}", "d M y"),
    "strokes": (r"\b([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})\b", "a b y"),
    "hyphens": (r"\b([0-9]{1,2})-([0-9]{1,2})-([0-9]{4}|[0-9]{2})\b", "a b y"),
    "points": (r"\b([0-9]{2})\.([0-9]{2})\.([0-9]{4}|[0-9]{2})\b", "a b y"),
    "month_year": (rf"\b{_M},?{_B}+(?:of{_B}+)?{_Y}", "M y"),
    "month_day": (rf"\b{_M}{_B}*{_D}", "M d"),
    "day_month": (rf"\b{_DAY}{_B}+{_M}", "d M"),
    "month": (r"\b(?-i:(" + "|".join(m[0].capitalize() for m in MONTHS if m[0] != "may") + r"))\b", "M"),
}
#: All formats, which begin at a word's edge with a figure or a month: where none can, none is tried.
PATTERN = rf"(?i)(?<![0-9A-Za-z_])(?=[0-9{''.join(sorted({m[0] for m in MONTH_OF}))}])(?:" + "|".join(re.sub(r"\((?!\?)", "(?:", p.removeprefix(r"\b")) for p, _ in FORMATS.values()) + ")"


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.format_string("%04d", year), month, day), "yyyy-M-d")


def _read(name: str, x: Column, base: datetime.date, day_first: bool) -> Column:
    """Struct (date, until) of a match of this format."""
    pattern, roles = FORMATS[name]
    parts = F.array(*(F.regexp_extract(x, "(?i)^(?:" + pattern + ")$", n) for n, _ in enumerate(roles.split(), 1)))
    return let(parts, lambda p: _dated(name, {role: F.get(p, F.lit(n)) for n, role in enumerate(roles.split())}, base, day_first))


def _dated(name: str, at: dict[str, Column], base: datetime.date, day_first: bool) -> Column:
    """Struct (date, until) of the parts by their roles."""
    month = lambda role: F.try_element_at(F.create_map(*(F.lit(v) for kv in MONTH_OF.items() for v in kv)), F.lower(at[role]))
    whole = lambda role: at[role].try_cast("int")
    year = F.lit(base.year)
    if "y" in at:
        near = F.lit(base.year - base.year % 100) + whole("y")
        near = F.when(near >= base.year + 50, near - 100).when(near < base.year - 50, near + 100).otherwise(near)
        year = F.when(F.length(at["y"]) == 4, F.when(whole("y") > 0, whole("y"))).when(whole("y") > 0, near)
    if "a" in at:
        swap = F.lit(day_first) & (whole("b") <= 12) | (whole("a") > 12)
        date, until = _date(year, F.when(swap, whole("b")).otherwise(whole("a")), F.when(swap, whole("a")).otherwise(whole("b"))), F.lit(None).cast("date")
    else:
        first = month("M") if "M" in at else whole("m")
        date = _date(year, first, whole("d") if "d" in at else F.lit(1))
        until = _date(year, month("N") if "N" in at else first, whole("e")) if "e" in at else F.lit(None).cast("date")
        if "e" in at:  # a range over the turn of the year begins in the year before
            date = F.when(date > until, F.add_months(date, -12)).otherwise(date)
    return F.struct(date.alias("date"), until.alias("until"), F.lit(name).alias("format"))


def dates(text: Column, base: datetime.date = datetime.date(2000, 1, 1), day_first: bool = False) -> Column:
    """array<struct<start, end, text, date, until, format>>: ``until`` is a range's last day, else null."""

    def record(s: Column) -> Column:
        found = F.coalesce(*(F.when(s["text"].rlike("(?i)^(?:" + p + ")$"), _read(n, s["text"], base, day_first)) for n, (p, _) in FORMATS.items()))
        return let(found, lambda d: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), d["date"].alias("date"), d["until"].alias("until"), d["format"].alias("format"), s["before"].alias("before")))

    def sound(r: Column) -> Column:
        return r["date"].isNotNull() & (~r["format"].startswith("range") | r["until"].isNotNull()) & ~r["before"].rlike("[0-9][./-]$")

    kept = F.filter(F.transform(spans(text, PATTERN), record), sound)
    return F.transform(kept, lambda r: F.struct(*(r[n].alias(n) for n in ("start", "end", "text", "date", "until", "format"))))
