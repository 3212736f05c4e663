"""Amounts in running text, and what is made of them: percentages, money, durations, distances, ratios.

One grammar of amounts serves all kinds: numerals with groups and decimals, numbers in words, ordinals, magnitudes
("2.55 billion", "5k"), dozens, halves and quarters, fractions in figures, signs and words, and their mixtures
("two and a half million", "twenty one and 5/100", "three tenths"). A phrase is found by one pattern, cut into typed
tokens and folded to its value; a kind adds its units around the phrase. Places are kept (code points, end exclusive).

Defined results: a null or empty text has no records; runs like 5.3.1 or 1/1/2010 are no amounts; a ratio with a
zero side and one followed by am or pm are dropped. All in column expressions, in time linear in text and matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.records import spans
from docloom.functions.text import let

#: Cardinal and ordinal words, magnitudes, signs of fractions.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
MAGNITUDES = {"k": 10**3, "thousand": 10**3, "m": 10**6, "mm": 10**6, "million": 10**6, "b": 10**9, "bil": 10**9, "billion": 10**9, "trill": 10**12, "trillion": 10**12}
SIGNS = {"½": 1 / 2, "⅓": 1 / 3, "⅔": 2 / 3, "¼": 1 / 4, "¾": 3 / 4, "⅕": 1 / 5, "⅖": 2 / 5, "⅗": 3 / 5, "⅘": 4 / 5, "⅙": 1 / 6, "⅚": 5 / 6, "⅐": 1 / 7, "⅛": 1 / 8, "⅜": 3 / 8, "⅝": 5 / 8, "⅞": 7 / 8, "⅑": 1 / 9, "⅒": 1 / 10}
#: Units.
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "¥": "JPY", "£": "GBP", "₠": "EUR", "₨": "INR", "₹": "INR", "₺": "TRY", "元": "CNY", "₽": "RUB", "₩": "KRW"}
CURRENCY_CODES = {"chf": "CHF", "rmb": "CNY", "usd": "USD", "eur": "EUR", "gbp": "GBP", "jpy": "JPY", "inr": "INR", "cny": "CNY"}
CURRENCY_WORDS = {"chinese yuans": "CNY", "chinese yuan": "CNY", "dollars": "USD", "dollar": "USD", "euros": "EUR", "euro": "EUR", "pounds": "GBP", "pound": "GBP", "renminbi": "CNY", "yens": "JPY", "yen": "JPY", "yuans": "CNY", "yuan": "CNY"}
PERCENT_UNITS = {"%": 0.01, "percent": 0.01, "percents": 0.01, "percentage point": 0.01, "percentage points": 0.01, "bps": 0.0001, "basis point": 0.0001, "basis points": 0.0001}
DURATION_DAYS = {"second": 1 / 86400, "minute": 1 / 1440, "hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.0, "quarter": 365 / 4, "year": 365.0, "annum": 365.0, "anniversary": 365.0, "anniversaries": 365.0}
DISTANCES = {"km": "kilometer", "mi": "mile", "kilometers": "kilometer", "kilometer": "kilometer", "miles": "mile", "mile": "mile"}


def ordinal(word: str) -> str:
    return IRREGULAR.get(word) or (word[:-1] + "ieth" if word.endswith("y") else word + "th")


CARDINAL = {w: n for n, w in enumerate(ONES)} | {w: 20 + 10 * n for n, w in enumerate(TENS)}
ORDINAL = {ordinal(w): n for w, n in CARDINAL.items()}
#: Denominators: third and beyond, with the plural; hundredths and thousandths.
PARTS = {w + s: n for w, n in (ORDINAL | {"hundredth": 100, "thousandth": 1000}).items() if n > 2 for s in ("", "s")}


def _any(words) -> str:
    return "(?:" + "|".join(sorted((w.replace(".", r"\.").replace("$", r"\$") for w in words), key=lambda w: (-len(w), w))) + ")"


_W = r"[ \t\n-]+"
_NUM = r"(?:[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)"
_RATIO = r"(?:no|[0-9]{1,2})/[0-9]{1,3}"
_SIGN = "[" + "".join(SIGNS) + "]"
_UNDER = _any(ONES[1:])
#: A numerator in words, then its denominator: one third, three tenths, ten ninety-ninths, twenty-one hundredths.
WORD_FRACTION = rf"((?:{_any(TENS)}{_W})?{_UNDER}|{_any(TENS)}){_W}((?:{_any(TENS)}{_W}{_any(w + 's' for w, n in ORDINAL.items() if 0 < n < 10)})|{_any(w for w in PARTS if w.endswith('s'))})|(one){_W}((?:{_any(TENS)}{_W}{_any(w for w, n in ORDINAL.items() if 0 < n < 10)})|{_any(w for w in PARTS if not w.endswith('s'))})"
_QUARTERS = rf"(?:one|two|three){_W}quarters?"
_MAGNITUDE_WORDS = [m for m in MAGNITUDES if len(m) > 2]
_WORDS = _any([*CARDINAL, *ORDINAL, *_MAGNITUDE_WORDS, "hundred", "hundredth", "dozen"])
_ATOM = rf"(?:{_RATIO}|{WORD_FRACTION.replace('((?:', '(?:(?:').replace('|(one)', '|(?:one)')}|{_QUARTERS}|{_WORDS})\b"
#: A phrase that is worth an amount. All groups are open ones, so kinds can number their own.
PHRASE = rf"(?:\b{_RATIO}\b|\b{_NUM}(?:[ \t\n]*(?:mm|bil|trill|[kmb])\b|[ \t\n]{{0,2}}{_SIGN})?|\.[0-9]+|{_SIGN}|\b{_ATOM})(?:{_W}(?:and{_W})?(?:a{_W})?(?:{_ATOM}|half\b|{_SIGN}))*"
#: Where a phrase may begin: patterns that begin with one are tried nowhere else.
_BEGINS = "(?=[0-9." + "".join(SIGNS) + "]|(?<![0-9A-Za-z_])[" + "".join(sorted({w[0] for w in (*CARDINAL, *ORDINAL, *PARTS, *_MAGNITUDE_WORDS, "hundred", "dozen", "no")})) + "])"
_TOKEN = rf"(?i){_RATIO}|{_NUM}|{_SIGN}|{_ATOM}|half|mm|bil|trill|[kmb]\b"


def _worth(word: Column, values: dict) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v if isinstance(v, str) else float(v))]
    return F.try_element_at(F.create_map(*pairs), word)


def _sum_of(words: Column) -> Column:
    """Cardinals, ordinals and denominators added: ``twenty-one`` 21, ``ninety-ninths`` 99."""
    known = CARDINAL | ORDINAL | PARTS | {w + "s": n for w, n in ORDINAL.items()}
    return F.aggregate(F.split(words, _W), F.lit(0.0), lambda s, w: s + F.coalesce(_worth(w, known), F.lit(0.0)))


def value(phrase: Column) -> Column:
    """What a phrase is worth: a hundred or dozen multiplies what is open, a magnitude closes it, fractions are added."""
    open_or_one = lambda s: F.when(s["open"] == 0, F.lit(1.0)).otherwise(s["open"])

    def step(s: Column, t: Column) -> Column:
        new = lambda done, open_, last=None: F.struct(done.alias("done"), open_.alias("open"), (s["last"] if last is None else last).alias("last"))
        add = lambda x: new(s["done"], s["open"] + x)
        magnitude, part = _worth(t, MAGNITUDES), lambda n: F.regexp_extract(t, "^(?:" + WORD_FRACTION + ")$", n)
        top, bottom = F.split_part(t, F.lit("/"), F.lit(1)), F.split_part(t, F.lit("/"), F.lit(2)).try_cast("double")
        return (
            F.when(t.rlike("^[.0-9][0-9,.]*$"), add(F.replace(t, F.lit(","), F.lit("")).try_cast("double")))
            .when(t.contains("/"), add(F.coalesce(F.try_divide(top.try_cast("double"), bottom), F.lit(0.0))))
            .when(F.length(t) == 1, F.when(magnitude.isNotNull(), new(s["done"] + open_or_one(s) * magnitude, F.lit(0.0), magnitude)).otherwise(add(F.coalesce(_worth(t, SIGNS), F.lit(0.0)))))
            .when(magnitude.isNotNull(), new(s["done"] + open_or_one(s) * magnitude, F.lit(0.0), magnitude))
            .when(t == "half", add(F.lit(0.5) * s["last"]))
            .when(t.startswith("hundred") & ~t.endswith("s"), new(s["done"], open_or_one(s) * 100))
            .when(t == "dozen", new(s["done"], open_or_one(s) * 12))
            .when(t.rlike("quarters?$"), add(_sum_of(F.regexp_replace(t, "quarters?$", "")) / 4))
            .when(t.rlike("^(?:" + WORD_FRACTION + ")$"), add(F.try_divide(_sum_of(F.concat(part(1), part(3))), _sum_of(F.concat(part(2), part(4))))))
            .otherwise(add(F.coalesce(_worth(t, CARDINAL | ORDINAL), F.lit(0.0))))
        )

    tokens = F.regexp_extract_all(F.lower(phrase), F.lit(_TOKEN), F.lit(0))
    start = F.struct(F.lit(0.0).alias("done"), F.lit(0.0).alias("open"), F.lit(1.0).alias("last"))
    return F.aggregate(tokens, start, step, lambda s: s["done"] + s["open"])


_UNIT = _any([r"percentage[ \t\n]+points?", "percents?", "bps", r"basis[ \t\n]+points?"])
_DAYS = _any(DURATION_DAYS)
_DURATION = rf"{PHRASE}(?:[ \t\n]*(?:calendar|business|actual))?[ \t\n-]*{_DAYS}s?\b"
_MONEY_WORD = _any(CURRENCY_WORDS)
_MONEY_SIGN = "[" + "".join(CURRENCY_SIGNS) + "]"
#: Runs of numerals that are no amounts come first and are dropped.
_NO_AMOUNT = r"\b[0-9]+(?:[./][0-9]+){2,}\.?"
PATTERNS = {
    "amount": rf"(?i){_NO_AMOUNT}|{PHRASE}",
    "percent": rf"(?i)[+-]?{PHRASE}[ \t\n)]*(?:%|{_UNIT}\b)",
    "money": rf"(?i)(?:{_MONEY_SIGN}|\b{_any(CURRENCY_CODES)}\b)[ \t\n]*{PHRASE}|{PHRASE}[ \t\n]*(?:(?:U\.?S\.?[ \t\n]+)?{_MONEY_WORD}\b|{_any(CURRENCY_CODES)}\b)",
    "duration": rf"(?i){_DURATION}(?:(?:[ \t\n,]|\band\b|\bplus\b)+{_DURATION})*",
    "distance": rf"(?i){PHRASE}[ \t\n]*{_any(DISTANCES)}\b",
    "ratio": rf"(?i){PHRASE}[ \t\n]*(?:\bto\b|:|/)[ \t\n]*{PHRASE}(?:[ \t\n]*[ap]\.?m\b)?",
}


def _unit(x: Column, pattern: str) -> Column:
    """The unit at the end of a match, lower case, blanks as one."""
    return F.regexp_replace(F.regexp_extract(F.lower(x), f"({pattern})[^0-9a-z%]*$", 1), "[ \t\n]+", " ")


def _single(x: Column) -> Column:
    """Struct (unit, amount, days) of one duration."""
    return let(_unit(x, f"{_DAYS}s?"), lambda u: let(F.when(u.isin(*DURATION_DAYS), u).otherwise(F.rtrim(u, F.lit("s"))), lambda name: let(value(F.regexp_replace(F.lower(x), rf"{_DAYS}s?[^0-9a-z]*$", "")), lambda v: F.struct(F.when(name == "anniversaries", "anniversary").otherwise(name).alias("unit"), v.alias("amount"), (v * _worth(name, DURATION_DAYS)).alias("days")))))


def _durations(text: Column) -> Column:
    """Durations that follow each other from longer to shorter units, with nothing but blanks, commas, and, plus between, are one."""
    each = lambda c: F.transform(spans(c["text"], "(?i)" + _DURATION), lambda s: let(_single(s["text"]), lambda d: F.struct((c["start"] + s["start"]).alias("start"), (c["start"] + s["end"]).alias("end"), s["text"].alias("text"), *(d[n].alias(n) for n in ("unit", "amount", "days")))))

    def grouped(chain: Column, ds: Column) -> Column:
        opens = F.filter(F.sequence(F.lit(0), F.size(ds) - 1), lambda i: (i == 0) | (_worth(F.get(ds, i)["unit"], DURATION_DAYS) >= _worth(F.get(ds, i - 1)["unit"], DURATION_DAYS)))

        def one(opens: Column, i: Column, n: Column) -> Column:
            stop = F.coalesce(F.get(opens, n + 1), F.size(ds))
            own = F.slice(ds, i + 1, stop - i)
            first, last = F.get(own, F.lit(0)), F.get(own, stop - i - 1)
            days = F.aggregate(own, F.lit(0.0), lambda s, d: s + d["days"])
            body = F.substr(chain["text"], first["start"] - chain["start"] + 1, last["end"] - first["start"])
            return F.struct(first["start"].alias("start"), last["end"].alias("end"), body.alias("text"), last["unit"].alias("unit"), F.when(stop - i > 1, days).otherwise(first["amount"]).alias("amount"), F.round(days, 4).alias("days"), F.transform(own, lambda d: F.struct(d["unit"], d["amount"])).alias("parts"))

        return let(opens, lambda o: F.transform(o, lambda i, n: one(o, i, n)))

    return F.flatten(F.transform(spans(text, PATTERNS["duration"]), lambda c: let(each(c), lambda ds: grouped(c, ds))))


def records(kind: str, text: Column) -> Column:
    """Records (start, end, text and the kind's values) of ``amount``, ``percent``, ``money``, ``duration``, ``distance`` or ``ratio``."""
    if kind == "duration":
        return _durations(text)

    def fields(x: Column) -> list[Column]:
        low = F.lower(x)
        if kind == "amount":
            return [value(x).alias("value")]
        if kind == "percent":
            amount = value(F.regexp_replace(low, rf"(?:%|{_UNIT})$", "")) * F.when(x.startswith("-"), -1).otherwise(1)
            unit = F.coalesce(F.nullif(_unit(x, _UNIT), F.lit("")), F.lit("%"))
            return [unit.alias("unit"), amount.alias("amount"), F.round(amount * _worth(unit, PERCENT_UNITS), 6).alias("fraction")]
        if kind == "money":
            before, behind = F.regexp_extract(low, f"^({_MONEY_SIGN}|{_any(CURRENCY_CODES)})", 1), _unit(x, f"{_MONEY_WORD}|{_any(CURRENCY_CODES)}")
            known = CURRENCY_SIGNS | CURRENCY_CODES | CURRENCY_WORDS
            number = F.regexp_replace(F.regexp_replace(low, f"^(?:{_MONEY_SIGN}|{_any(CURRENCY_CODES)})", ""), rf"(?:u\.?s\.?[ \t\n]+)?(?:{_MONEY_WORD}|{_any(CURRENCY_CODES)})$", "")
            return [value(number).alias("amount"), F.coalesce(_worth(before, known), _worth(behind, known)).alias("currency")]
        if kind == "distance":
            return [value(F.regexp_replace(low, f"{_any(DISTANCES)}$", "")).alias("amount"), F.when(_unit(x, _any(DISTANCES)).startswith("k"), "kilometer").otherwise("mile").alias("unit")]

    def sides_of(x: Column) -> Column:
        sides = rf"(?i)^({PHRASE})[ \t\n]*(?:\bto\b|:|/)[ \t\n]*({PHRASE})"
        # the phrase holds groups of its own in no place, so the second side is what the first one and its sign leave
        right = lambda left: F.regexp_replace(F.substr(x, F.length(left) + 1), r"(?i)^[ \t\n]*(?:to\b|:|/)[ \t\n]*", "")
        both = let(F.regexp_extract(x, sides, 1), lambda left: F.struct(value(left).alias("left"), value(right(left)).alias("right")))
        return let(both, lambda b: F.struct(b["left"].alias("left"), b["right"].alias("right"), F.round(F.try_divide(b["left"], b["right"]), 6).alias("ratio")))

    pattern = f"(?i){_BEGINS}(?:{PATTERNS[kind]})" if kind in ("amount", "distance", "ratio") else PATTERNS[kind]
    found = F.filter(spans(text, pattern), lambda s: ~s["text"].rlike(f"^(?:{_NO_AMOUNT})$" if kind == "amount" else r"(?i)[ \t\n]*[ap]\.?m$" if kind == "ratio" else "^$"))
    record = lambda s, own: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), *own)
    if kind == "ratio":
        out = F.transform(found, lambda s: let(sides_of(s["text"]), lambda b: record(s, [b[n].alias(n) for n in ("left", "right", "ratio")])))
        return F.filter(out, lambda r: (r["left"] != 0) & (r["right"] != 0))
    return F.transform(found, lambda s: record(s, fields(s["text"])))
