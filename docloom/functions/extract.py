"""Pattern extractors: arrays of matches as column expressions (ASCII patterns without look-around)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import ascii_edges

#: Fixed patterns of the extractors.
SSN = r"([0-9]{3})-?([0-9]{2})-?([0-9]{4})"
PHONE = r"\(?[0-9]{3}\)?[\s-]+[0-9]{3}[\s-]+[0-9]{4}"
PERCENT = r"[0-9]+(?:\.[0-9]+)?\s*(?:%|percentage points?|percents?|bps|basis points?)"
RATIO = r"[0-9]+(?:\.[0-9]+)?\s*(?: to |:|/)\s*[0-9]+(?:\.[0-9]+)?"
DISTANCE = r"[0-9]+(?:\.[0-9]+)?\s*(?:kilometers?|miles?|km|mi)\b"
URL = r"(?:https?://|www\.)[^\s<>\"]+"
ACT = r"(?:[A-Z][a-z]+ )+Act(?: of [0-9]{4})?"
REGULATION = r"[0-9]+ (?:USC|CFR|U\.S\.C\.|C\.F\.R\.) (?:Sec |§ ?)?[0-9]+"
DURATION = r"[0-9]+(?:\.[0-9]+)?\s*(?:second|minute|hour|day|week|month|quarter|year)s?\b"
MONEY = r"(?:[$€£]\s*[0-9][0-9,]*(?:\.[0-9]+)?|[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:dollars?|USD|EUR|GBP)\b)"
COPYRIGHT = r"(?:\([cC]\)|©|[Cc]opyright)\s+[0-9]{4}(?:\s*-\s*[0-9]{4})?"
TRADEMARK = r"[A-Z0-9][A-Za-z0-9]*(?: [A-Z0-9][A-Za-z0-9]*)*\s?(?:TM|™|\(R\)|®)"
PUBLIC_LAW = r"Pub\. ?L\. No\. [0-9]+-[0-9]+"
SECTION = r"[Ss]ections? [0-9]+[A-Z]*"
#: Days that a unit of duration stands for.
UNIT_DAYS = {"second": 1 / 86400, "minute": 1 / 1440, "hour": 1 / 24, "day": 1, "week": 7, "month": 30, "quarter": 90, "year": 365}
PATTERNS = {"duration": DURATION, "money": MONEY, "copyright": COPYRIGHT, "trademark": TRADEMARK, "public_law": PUBLIC_LAW, "section": SECTION, "ssn": SSN, "phone": PHONE, "percent": PERCENT, "ratio": RATIO, "distance": DISTANCE, "url": URL, "act": ACT, "regulation": REGULATION}


def matches(kind: str, text: Column) -> Column:
    """All leftmost matches of a kind."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ascii_edges(PATTERNS[kind])), F.lit(0))


def ssn(text: Column) -> Column:
    """Social security numbers as ddd-dd-dddd; none with a block of zeros."""
    digits = F.transform(matches("ssn", text), lambda x: F.regexp_replace(x, "-", ""))
    ok = F.filter(digits, lambda d: (d.substr(1, 3) != "000") & (d.substr(4, 2) != "00") & (d.substr(6, 4) != "0000"))
    return F.transform(ok, lambda d: F.concat(d.substr(1, 3), F.lit("-"), d.substr(4, 2), F.lit("-"), d.substr(6, 4)))


def percent_fraction(match: Column) -> Column:
    """The fraction a percent match stands for: basis points count a ten-thousandth."""
    amount = F.regexp_extract(match, r"[0-9]+(?:\.[0-9]+)?", 0).cast("double")
    return F.round(amount * F.when(match.rlike("bps|basis"), 0.0001).otherwise(0.01), 4)
