"""Extractors as records: every match with its place in the text (code points, end exclusive) and its values.

``records(kind, text)`` is an array of structs in order of appearance; everything is a column expression. Patterns
are free of look-around, and word edges are ASCII. The amounts of other kinds are numerals; numbers in words are a kind of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import ascii_edges, let

_NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
#: Fixed patterns: one per kind.
PATTERNS = {
    "ssn": r"([0-9]{3})-?([0-9]{2})-?([0-9]{4})",
    "phone": r"\(?([0-9]{3})\)?[ \t\n-]+([0-9]{3})[ \t\n-]+([0-9]{4})",
    "cusip": r"\b([0-9]{2}[0-9A-Z]{3}[0-9A-Z@#*])([0-9A-Z@#*]{2})([0-9])\b",
    "act": r"(?:[Ss]ections?[ \t\n]+((?:[0-9]+(?:\([0-9A-Za-z]\))*|,[ \t\n]+|,?[ \t\n]+and[ \t\n]+)+)[ \t\n]+of[ \t\n]+the[ \t\n]+)?((?:(?:[A-Z][0-9A-Za-z_]+|[A-Z&]+|and|[0-9]+(?:[a-z]{1,3})?),?[ \t\n]+)+Act)(?:[^0-9A-Za-z_]+|$)(?:of[ \t\n]+([0-9]{4}))?",
    "percent": rf"([+-]?)({_NUMBER})[ \t\n]*(%|percentage points?|percents?|bps|basis points?)",
    "ratio": r"([0-9]+(?:\.[0-9]+)?)[ \t\n]*(?: to |:|/)[ \t\n]*([0-9]+(?:\.[0-9]+)?)([ \t\n]*[AaPp]\.?[Mm]\b)?",
    "distance": rf"({_NUMBER})[ \t\n]*(kilometers?|miles?|km|mi)\b",
    "duration": rf"({_NUMBER})[ \t\n-]*(second|minute|hour|day|week|month|quarter|year)s?\b",
    "money": rf"(\$|€|£|¥)[ \t\n]*({_NUMBER})(?:[ \t\n]*(thousand|million|billion|trillion))?\b|\b({_NUMBER})[ \t\n]*(?:(thousand|million|billion|trillion)[ \t\n]+)?(dollars?|euros?|pounds?|USD|EUR|GBP|JPY|INR)\b",
    "regulation": r"([0-9]+)[ \t\n]+(USC|CFR|U\.S\.C\.|C\.F\.R\.)[ \t\n]+(?:Sec\.?[ \t\n]+|§[ \t\n]*)?([0-9]+[0-9A-Za-z.-]*)|Pub\. ?L\. ?No\. ?([0-9]+-[0-9]+)|([0-9]+) Stat\. ([0-9]+)",
    "copyright": r"(©|\([cC]\)|[Cc]opyright(?:[ \t\n]+(?:©|\([cC]\)))?)[ \t\n]+([0-9]{4}(?:[ \t\n]*-[ \t\n]*[0-9]{4})?),?((?:[ \t\n]+[A-Z][0-9A-Za-z&.-]*,?)*)",
    "trademark": r"[A-Z0-9][0-9A-Za-z]*(?: [A-Z0-9][0-9A-Za-z]*)*[ \t\n]?(?:TM\b|™|\([Rr]\)|®)",
    "url": r"(?:https?://|ftp://|www\.)[0-9A-Za-z_~:/?#@!$&'*+,;=.%()-]*[0-9A-Za-z_/~#=&]",
    "date": r"\b(January|February|March|April|May|June|July|August|September|October|November|December) ([0-9]{1,2}),? ([0-9]{4})\b",
    "reporter_page": r"\b([0-9]+) (U\. ?S\.|S\. ?Ct\.|F\. ?[23]d|F\. ?Supp\.(?: ?2d)?|L\. ?Ed\.(?: ?2d)?) ([0-9]+)(?:, ([0-9]+))?(?: \(([A-Za-z. ]*?) ?([0-9]{4})\))?",
    "public_law": r"Pub\. ?L\. ?No\. ?([0-9]+)-([0-9]+)",
    "section_mention": r"[Ss]ections? ([0-9]+[A-Z]*)",
}
#: Phrases that open a condition, longest first in the pattern.
CONDITION_PHRASES = ("if", "if not", "when", "when not", "where", "where not", "unless and until", "unless", "unless not", "until", "until not", "as soon as", "as soon as not", "provided that", "provided that not", "subject to", "not subject to", "upon the occurrence", "conditioned on", "conditioned upon")
#: Phrases of a constraint.
CONSTRAINT_PHRASES = (
    "after", "at least", "at most", "before", "equal to", "exactly", "first of", "greater", "greater of", "greater than", "greater than or equal to", "greatest of", "last of", "least of",
    "lesser", "lesser of", "lesser than", "less than", "less than or equal to", "maximum of", "maximum", "minimum of", "minimum", "more than", "more than or equal to", "no earlier than",
    "no later than", "no less than", "no more than", "not equal to", "not to exceed", "earlier than", "later than", "within", "exceed", "exceeds", "prior to", "highest", "least",
)
#: Days of a unit of duration, factors of multipliers, currencies of signs and words.
UNIT_DAYS = {"second": 1 / 86400, "minute": 1 / 1440, "hour": 1 / 24, "day": 1, "week": 7, "month": 30, "quarter": 90, "year": 365}
FACTORS = {"": 1, "thousand": 1000, "million": 10**6, "billion": 10**9, "trillion": 10**12}
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "dollar": "USD", "dollars": "USD", "euro": "EUR", "euros": "EUR", "pound": "GBP", "pounds": "GBP"}
#: Numbers in words, and the words that multiply what stands before them.
NUMBER_WORDS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20))) | dict(
    zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10))
)
SCALE_WORDS = {"hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "trillion": 10**12}


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    """A phrase between white space or punctuation, any case, longest first."""
    longest = sorted(set(phrases), key=lambda p: (-len(p), p))
    return r"(?i)[ \t\n.,;](" + "|".join(p.replace(" ", r"[ \t\n]+") for p in longest) + r")[ \t\n.,;]"


PATTERNS["condition"], PATTERNS["constraint"] = phrase_pattern(CONDITION_PHRASES), phrase_pattern(CONSTRAINT_PHRASES)
_ANY_NUMBER_WORD = "(?:" + "|".join(sorted(NUMBER_WORDS | SCALE_WORDS, key=lambda w: (-len(w), w))) + ")"
PATTERNS["number_words"] = rf"(?i)\b{_ANY_NUMBER_WORD}(?:(?: +and)?[ -]+{_ANY_NUMBER_WORD})*\b"
PATTERNS["definition"] = "[\"“]([^\"“”\n]{1,80})[\"”][ \t\n]+(shall mean|means|is defined as|refers to|has the meaning)"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text, before>> of all leftmost matches; ``before`` is what lies between the last match and this one."""
    # what lies before a match and the match alternate, so lengths give places; a split by the pattern would compile it for each text
    body, pattern = F.coalesce(text, F.lit("")), ascii_edges(pattern)
    one = lambda m, p, sums: lambda x, i: let(sums(i) + F.length(F.get(p, i)), lambda s: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), x.alias("text"), F.get(p, i).alias("before")))
    lengths = lambda m, p: F.transform(m, lambda x, i: F.length(x) + F.length(F.get(p, i)))
    return let(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda m: let(F.regexp_extract_all(body, F.lit(rf"\G([\s\S]*?)(?:{pattern})"), F.lit(1)), lambda p: sums_before(lengths(m, p), lambda sums: F.transform(m, one(m, p, sums)))))


#: Values that one step of ``sums_before`` adds.
_STEP = 16


def sums_before(values: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``body(f)`` where ``f(i)`` is the sum of the first i values: sums of 16, of 256 and of 4,096 values are kept, so a place costs few additions."""
    add = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / _STEP).cast("int")), lambda b: add(F.slice(a, b * _STEP + 1, F.lit(_STEP))))
    part = lambda a, i: add(F.slice(a, i - i % _STEP + 1, i % _STEP))
    div = lambda i, n: F.floor(i / n).cast("int")
    whole = lambda a, b, c, d: lambda i: part(a, i) + part(b, div(i, _STEP)) + part(c, div(i, _STEP**2)) + add(F.slice(d, F.lit(1), div(i, _STEP**3)))
    return let(values, lambda a: let(blocks(a), lambda b: let(blocks(b), lambda c: let(blocks(c), lambda d: body(whole(a, b, c, d))))))


def _group(kind: str, n: int) -> Callable[[Column], Column]:
    return lambda x: F.regexp_extract(x, ascii_edges(PATTERNS[kind]), n)


def _number(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit("")).cast("double")


def _lookup(key: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def cusip_checksum(code: Column) -> Column:
    """The check digit of a code's first eight characters: values 0-9, A-Z as 10-35, * @ # as 36-38; every second one doubled, digits summed."""
    letters = F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#")
    each = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.position(F.substr(code, i, F.lit(1)), letters) - 1) * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda s, v: (s + F.floor(v / 10) + v % 10).cast("int"))
    return (10 - total % 10) % 10


def number_value(words: Column) -> Column:
    """What a number in words is worth: a hundred multiplies what stands before it, larger scales close a part of the sum."""
    def step(s: Column, w: Column) -> Column:
        scale, before = _lookup(w, SCALE_WORDS), F.greatest(s["open"], F.lit(1.0))
        closed = F.struct((s["done"] + before * scale).alias("done"), F.lit(0.0).alias("open"))
        hundreds = F.struct(s["done"].alias("done"), (before * 100).alias("open"))
        added = F.struct(s["done"].alias("done"), (s["open"] + F.coalesce(_lookup(w, NUMBER_WORDS), F.lit(0))).alias("open"))
        return F.when(scale >= 1000, closed).when(scale == 100, hundreds).otherwise(added)

    return F.aggregate(F.split(F.lower(words), "[ -]+"), F.struct(F.lit(0.0).alias("done"), F.lit(0.0).alias("open")), step, lambda s: s["done"] + s["open"])


def _fields(kind: str, x: Column) -> dict[str, Column]:
    """The values of a match."""
    g = lambda n: _group(kind, n)(x)
    blank = lambda c: F.nullif(c, F.lit(""))
    if kind == "ssn":
        return {"value": F.concat_ws("-", g(1), g(2), g(3))}
    if kind == "phone":
        return {"area": g(1), "exchange": g(2), "last4": g(3)}
    if kind == "cusip":
        return {"issuer": g(1), "issue": g(2), "checksum": g(3).cast("int"), "valid": cusip_checksum(x) == g(3).cast("int"), "internal": g(1).rlike("^(?:[0-9]{3}99[0-9A-Z]|99[0-9]{3}[0-9A-Z])$"), "private": x.rlike("[@#*]")}
    if kind == "act":
        return {"section": blank(g(1)), "act_name": g(2), "year": F.try_to_number(blank(g(3)), F.lit("9999")).cast("int")}
    if kind == "percent":
        amount = _number(g(2)) * F.when(g(1) == "-", -1).otherwise(1)
        return {"amount": amount, "unit": g(3), "fraction": F.round(amount * F.when(g(3).rlike("bps|basis"), 0.0001).otherwise(0.01), 4)}
    if kind == "ratio":
        a, b = g(1).cast("double"), g(2).cast("double")
        return {"left": a, "right": b, "ratio": F.round(F.try_divide(a, b), 4), "is_time": g(3) != ""}
    if kind == "distance":
        return {"amount": _number(g(1)), "unit": F.when(g(2).startswith("k"), "kilometer").otherwise("mile")}
    if kind == "duration":
        return {"amount": _number(g(1)), "unit": g(2), "days": F.round(_number(g(1)) * _lookup(g(2), UNIT_DAYS), 4)}
    if kind == "money":
        factor, word = _lookup(F.concat(g(3), g(5)), FACTORS), F.concat(g(1), g(6))
        return {"amount": F.round(_number(F.concat(g(2), g(4))) * factor, 4), "currency": F.coalesce(_lookup(word, CURRENCIES), word)}
    if kind == "regulation":
        return {"source": F.when(g(4) != "", "Public Law").when(g(5) != "", "Stat.").otherwise(F.replace(g(2), F.lit("."), F.lit(""))), "name": F.concat(g(3), g(4), g(6)), "volume": blank(F.concat(g(1), g(5)))}
    if kind == "copyright":
        return {"sign": g(1), "date": g(2), "name": F.rtrim(F.trim(F.regexp_replace(g(3), "[ \t\n]+", " ")), F.lit(","))}
    if kind == "date":
        return {"date": F.try_to_date(F.concat_ws(" ", g(1), g(2), g(3)), "MMMM d yyyy")}
    if kind == "reporter_page":
        return {"volume": g(1).cast("int"), "reporter": F.replace(g(2), F.lit(" "), F.lit("")), "page": g(3).cast("int"), "page2": F.try_to_number(blank(g(4)), F.lit("999999")).cast("int"), "court": blank(F.trim(g(5))), "year": F.try_to_number(blank(g(6)), F.lit("9999")).cast("int")}
    if kind == "public_law":
        return {"congress": g(1).cast("int"), "number": g(2).cast("int")}
    if kind == "number_words":
        return {"value": number_value(x)}
    if kind == "definition":
        return {"term": F.trim(g(1)), "verb": g(2)}
    if kind == "section_mention":
        return {"section": g(1)}
    if kind in ("condition", "constraint"):
        return {"phrase": F.lower(F.regexp_replace(g(1), "[ \t\n]+", " "))}
    return {}


def records(kind: str, text: Column) -> Column:
    """Records of a kind: start, end, text and the kind's values. Dropped: numbers with a block of zeros (ssn), times of day (ratio)."""
    def record(s: Column) -> Column:
        fields = {n: c.alias(n) for n, c in _fields(kind, s["text"]).items()}
        if kind in ("condition", "constraint"):
            fields["before"] = s["before"].alias("before")
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), *fields.values())

    found = F.transform(spans(text, PATTERNS[kind]), record)
    if kind == "ssn":
        return F.filter(found, lambda r: ~r["value"].rlike("^000|-00-|0000$"))
    if kind == "ratio":
        return F.filter(found, lambda r: ~r["is_time"])
    return found
