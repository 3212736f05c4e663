"""References to law in running text: reporter citations, statutes, legal concepts, co-cited pairs, sections of a judgment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import CITATION, let

#: Fixed patterns: citations of law reports.
REPORTERS = (
    r"(?i)AIR\s+[0-9]{4}\s+S\.?\s*C\.?\s+[0-9]+",
    r"(?i)\(\s*[0-9]{4}\s*\)\s*[0-9]+\s+SCC\s+[0-9]+",
    r"(?i)[0-9]{4}\s*\(\s*[0-9]+\s*\)\s*SCC\s+[0-9]+",
    r"(?i)\[\s*[0-9]{4}\s*\]\s*[0-9]+\s+SCR\s+[0-9]+",
    r"(?i)MANU/SC/[0-9]+/[0-9]{4}",
)
#: Fixed patterns: acts and their short names, the first match wins.
ACTS = (
    ("indian penal code|i\\.p\\.c", "IPC"),
    ("code of criminal procedure|cr\\.?p\\.?c", "CrPC"),
    ("code of civil procedure|c\\.p\\.c", "CPC"),
    ("income.?tax act", "ITA"),
    ("constitution of india|constitution", "Const"),
    ("companies act", "CoAct"),
    ("arbitration.{0,20}act", "ArbAct"),
    ("contract act", "ContAct"),
    ("evidence act", "EvidAct"),
    ("limitation act", "LimAct"),
    ("transfer of property act|t\\.p\\. act", "TPA"),
    ("civil procedure|civil rules", "CPC"),
    ("criminal procedure|criminal rules", "CrPC"),
    ("customs act", "CustomsAct"),
    ("excise act", "ExciseAct"),
    ("service act", "ServiceAct"),
    ("land acquisition", "LandAcq"),
    ("motor vehicles act", "MVAct"),
)
#: Fixed patterns: statutes with the act they belong to, orders with their rule, short names behind a section.
SECTION_OF = r"(?i)(?:section|sec\.?|s\.)\s*([0-9]+[A-Za-z]?(?:\s*\([0-9]+\))?)(?:\s*(?:and|or|,|\s+)\s*(?:section|sec\.?)?\s*[0-9]+[A-Za-z]?)*(?:\s+(?:of\s+the\s+|of\s+))?([A-Z][A-Za-z\s.,]{3,50})"
ARTICLE_OF = r"(?i)(?:article|art\.?)\s*([0-9]+[A-Za-z]?)(?:\s+(?:of\s+the\s+|of\s+))?([A-Z][A-Za-z\s.,]{3,50})"
ORDER_RULE = r"(?i)order\s*((?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))\s+(?:rule|r\.?)\s*([0-9]+)"
SECTION_SHORT = r"(?i)(?:section|sec\.?|s\.)\s*([0-9]+[A-Za-z]?)\s+(?:of\s+(?:the\s+)?)?(IPC|CrPC|CPC|ITA)"
#: What repeats in it, and the same without two ways to take a run of blanks.
_REPEAT, _REPEAT_ONCE = r"(?:\s*(?:and|or|,|\s+)\s*(?:section|sec\.?)?\s*[0-9]+[A-Za-z]?)*", r"(?:(?:\s*(?:and|or|,)\s*|\s+)(?:section|sec\.?)?\s*[0-9]+[A-Za-z]?)*"
#: Fixed patterns: concepts in lower-case text.
CONCEPTS = (
    r"\b[0-9]{4}\s+(?:scc|air|scr|ilr|scale|jt)\s+(?:sc|hc)?\s*[0-9]+\b",
    r"\b(?:section|sec\.|article|art\.|rule|order)\s+[a-z0-9]+\b",
    r"\b(?:indian penal code|ipc|crpc|cpc|evidence act|constitution(?:\s+of\s+india)?|income tax act)\b",
)
ENTITIES = (*CONCEPTS[:2], r"\b(?:indian penal code|ipc|crpc|cpc|evidence act|constitution.*?india|income tax act)\b")
#: Fixed pattern: what opens a numbered paragraph.
PARAGRAPH = r"\n[0-9]+\.\s+"
#: Fixed pattern: heads of a judgment's sections.
SECTION_HEAD = r"(?i)\b(PETITIONER|RESPONDENT|DATE OF JUDGMENT|BENCH|CITATION|CITATOR INFO|ACT|HEADNOTE|JUDGMENT)\s*:"


def linear(pattern: str) -> str:
    """The same matches, but a run of blanks is never given back: what follows one in these patterns can't begin with a blank."""
    return pattern.replace(_REPEAT, _REPEAT_ONCE).replace(r"\s+", r"\s++").replace(r"\s*", r"\s*+")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(linear(pattern)), F.lit(group))


def reporter_citations(text: Column) -> Column:
    """Distinct law-report citations, upper case, blanks as ``_``, in order of pattern and place."""
    return F.array_distinct(F.transform(F.concat(*(_all(text, p) for p in REPORTERS)), lambda x: F.regexp_replace(F.upper(F.trim(x)), r"\s+", "_")))


def act_name(fragment: Column, words: int = 3) -> Column:
    """The short name of an act; else its first ``words`` capitalised words; else ``UnknownAct``."""
    low, out = F.lower(F.trim(fragment)), None
    for pattern, name in ACTS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    capital = F.slice(F.filter(F.split(fragment, r"\s+"), lambda w: w.rlike("^[A-Z]")), 1, words)
    return out.otherwise(F.when(F.size(capital) > 0, F.array_join(capital, "_")).otherwise("UnknownAct"))


def statutes(text: Column, words: int = 3) -> Column:
    """Distinct statutes: ``S147_ITA`` for sections and articles with their act, ``OXXXIX_R1_CPC`` for an order's rule; tags are blanks."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")

    def zipped(p: str) -> Column:
        return F.arrays_zip(_all(bare, p, 1).alias("a"), _all(bare, p, 2).alias("b"))

    named = F.filter(F.concat(zipped(SECTION_OF), zipped(ARTICLE_OF)), lambda x: (x["a"] != "") & (F.length(F.trim(x["b"])) > 3))
    named = F.transform(named, lambda x: F.concat(F.lit("S"), F.upper(F.regexp_replace(x["a"], r"\s+", "")), F.lit("_"), act_name(x["b"], words)))
    rules = F.transform(zipped(ORDER_RULE), lambda x: F.concat(F.lit("O"), F.upper(x["a"]), F.lit("_R"), x["b"], F.lit("_CPC")))
    short = F.transform(zipped(SECTION_SHORT), lambda x: F.concat(F.lit("S"), F.upper(x["a"]), F.lit("_"), F.upper(x["b"])))
    return F.array_distinct(F.concat(named, rules, short))


def concepts(text: Column, patterns: tuple[str, ...] = CONCEPTS) -> Column:
    """Citations, statutes and acts of lower-case text, blanks as ``_``, with repeats; ``patterns=ENTITIES`` for entities."""
    return F.transform(F.concat(*(_all(F.lower(text), p) for p in patterns)), lambda x: F.replace(x, F.lit(" "), F.lit("_")))


def co_cited_pairs(text: Column) -> Column:
    """Struct (a, b) of every two ids that a numbered paragraph cites together, a < b, once per paragraph."""
    own = F.transform(F.split(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(p, F.lit(CITATION), F.lit(1)))))
    pairs = lambda c: F.flatten(F.transform(c, lambda a, i: F.transform(F.slice(c, i + 2, F.greatest(F.size(c) - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.flatten(F.transform(own, pairs))


def sections(text: Column) -> Column:
    """Map of a judgment's sections by their upper-case head; the text before the first is ``PREAMBLE``; of equal heads the last counts."""
    body = F.coalesce(text, F.lit(""))
    heads = F.transform(_all(body, SECTION_HEAD, 1), F.upper)

    def keyed(parts: Column) -> Column:
        named = let(heads, lambda h: F.transform(F.sequence(F.lit(0), F.size(h)), lambda i: F.struct(F.when(i == 0, "PREAMBLE").otherwise(F.get(h, i - 1)).alias("k"), F.when(i == 0, F.get(parts, i)).otherwise(F.btrim(F.get(parts, i), F.lit(" \t\n\x0b\x0c\r"))).alias("v"))))
        return let(named, lambda n: F.map_from_entries(F.filter(n, lambda x, i: ~F.exists(F.slice(n, i + 2, F.size(n)), lambda later: later["k"] == x["k"]))))

    return let(F.split(body, SECTION_HEAD, -1), keyed)


def fact_and_issue(text: Column) -> Column:
    """Struct (fact, issue): the judgment, and head note with act; one stands in for the other, halves of the text for both. Whole texts, never cut."""
    body = F.coalesce(text, F.lit(""))

    def of(s: Column) -> Column:
        part = lambda k: F.coalesce(F.element_at(s, k), F.lit(""))
        fact, issue, half = part("JUDGMENT"), F.trim(F.concat_ws(" ", F.element_at(s, "HEADNOTE"), F.element_at(s, "ACT"))), F.floor(F.length(body) / 2).cast("int")
        none = (fact == "") & (issue == "")
        return F.struct(
            F.when(none, F.substr(body, F.lit(1), half)).when(fact == "", issue).otherwise(fact).alias("fact"),
            F.when(none, F.substr(body, half + 1)).when(issue == "", fact).otherwise(issue).alias("issue"),
        )

    return let(sections(text), of)
