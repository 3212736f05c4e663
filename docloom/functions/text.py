"""Text normalisation, tokens, sentences and windows as column expressions.

Where an expression uses an array several times, the array is bound to a lambda variable (``let``):
Catalyst would otherwise copy the expression that makes it into each use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words.
STOPWORDS = tuple(
    """
    a an the and or but if in on at to for of with by from as is was are were be been being have has had do does did
    will would could should may might shall can not no nor so yet both either neither each few more most other some
    such than too very just that this these those it its he she they we you i me him her us them my your his our
    their what which who whom when where why how all any every one also into about up out then there here over under
    again further once only own same s t said upon per re vs v etc ie eg viz mr mrs ms dr ltd inc corp llc co
    """.split()
)
#: Fixed pattern of numbered citations in running text.
CITATION = "<CITATION_([0-9]+)>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A word's edge as RE2 has it: between ASCII word characters and others. Java counts all letters for its ``\b``.
WORD_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def ascii_edges(pattern: str) -> str:
    r"""``pattern`` whose ``\b`` is ``WORD_EDGE``, for Spark; the SQL has the pattern as it stands."""
    return pattern.replace(r"\b", WORD_EDGE)


def _bare(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def clean_tokens(text: Column, min_len: int = 2, stopwords: tuple[str, ...] = ()) -> Column:
    """Tags out, lower case, runs of a-z; short words and stop words dropped (repeats stay)."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(_bare(text), "<[^>]+>", " ")), F.lit(f"[a-z]{{{min_len},}}"), F.lit(0))
    return F.filter(words, lambda x: ~x.isin(*stopwords)) if stopwords else words


def alnum_tokens(text: Column, min_len: int = 3, stopwords: tuple[str, ...] = ()) -> Column:
    """The reranker's tokens: lower case, runs of a-z and 0-9 of at least ``min_len``."""
    words = F.regexp_extract_all(F.lower(_bare(text)), F.lit(f"[a-z0-9]{{{min_len},}}"), F.lit(0))
    return F.filter(words, lambda x: ~x.isin(*stopwords)) if stopwords else words


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two or more ASCII word characters (the vectoriser's default pattern)."""
    return F.regexp_extract_all(F.lower(_bare(text)), F.lit("[a-z0-9_]{2,}"), F.lit(0))


def simple_tokens(text: Column) -> Column:
    """Lower case, split at white space."""
    return F.filter(F.split(F.lower(_bare(text)), r"\s+"), lambda x: x != "")


def ngrams(tokens: Column, n: int, sep: str = "_") -> Column:
    """All n-grams of exactly order n."""
    if n == 1:
        return tokens
    none = F.array().cast("array<string>")
    return let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), sep))).otherwise(none))


def cumulative_ngrams(tokens: Column, n: int) -> Column:
    """Words and all n-grams up to order n."""
    return tokens if n == 1 else let(tokens, lambda t: F.concat(*(ngrams(t, k) for k in range(1, n + 1))))


def sentences(text: Column) -> Column:
    """Text cut behind ``.``, ``!`` or ``?`` and white space; empty sentences dropped."""
    return F.filter(F.split(F.regexp_replace(_bare(text), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def without_citation_sentences(text: Column) -> Column:
    """The sentences that hold no citation tag, joined by blanks."""
    return F.array_join(F.filter(sentences(text), lambda s: ~s.contains("CITATION")), " ")


def windows(items: Column, size: int, stride: int) -> Column:
    """Windows of ``size`` items every ``stride``; the last one is the first that reaches the end."""
    last = lambda t: F.greatest(F.lit(0), F.ceil((F.size(t) - size) / stride)).cast("int")
    return let(items, lambda t: F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), last(t)), lambda k: F.slice(t, k * stride + 1, size))))


def citations(text: Column) -> Column:
    """Distinct cited ids in order of first appearance."""
    return F.array_distinct(citation_mentions(text))


def citation_mentions(text: Column) -> Column:
    """Cited ids with repeats."""
    return F.regexp_extract_all(_bare(text), F.lit(CITATION), F.lit(1))


def citation_context(text: Column, words: int = 30) -> Column:
    """Up to ``words`` words on either side of every mention, citation tags removed."""
    tag = lambda x: x.rlike(CITATION)
    around = lambda t, i: F.filter(F.slice(t, F.greatest(i - words, F.lit(0)) + 1, F.least(i, F.lit(words)) + words + 1), lambda x: ~tag(x))
    at = lambda t: F.filter(F.transform(t, lambda x, i: F.when(tag(x), i)), lambda i: i.isNotNull())
    return let(F.filter(F.split(_bare(text), r"\s+"), lambda x: x != ""), lambda t: F.transform(at(t), lambda i: F.array_join(around(t, i), " ")))


def roles(text: Column) -> Column:
    """(role, line) of the lines ``role TAB sentence``; lines without a tab are dropped."""
    lines = F.filter(F.split(_bare(text), "\n"), lambda x: x.contains("\t"))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "\t", 1)).alias("role"), F.regexp_replace(x, "^[^\t]*\t", "").alias("line")))


def role_text(text: Column, boosts: dict[str, int]) -> Column:
    """The lines of the given roles, each repeated as often as its boost says."""
    times = F.create_map(*(F.lit(x) for kv in boosts.items() for x in kv))
    return F.array_join(F.flatten(F.transform(F.filter(roles(text), lambda r: r["role"].isin(*boosts)), lambda r: F.array_repeat(r["line"], F.element_at(times, r["role"])))), " ")


def nested_ngrams(tokens: Column, inner: int, outer: int) -> Column:
    """N-grams up to ``outer`` of a stream that holds the n-grams up to ``inner`` already (an option; one expansion is the default elsewhere)."""
    return cumulative_ngrams(cumulative_ngrams(tokens, inner), outer)


def glued_lines(text: Column) -> Column:
    """Line breaks taken out without a blank: words at line ends are fused (an option for queries)."""
    return F.regexp_replace(_bare(text), r"\r?\n", "")


def without_special_characters(text: Column, single: tuple[str, ...] = ("a", "i", "A", "I")) -> Column:
    """Only letters, angle brackets, full stops and blanks; words of one character go, but for ``single``."""
    words = F.split(F.regexp_replace(_bare(text), r"[^a-zA-Z<>.\s]", " "), r"\s+")
    return F.array_join(F.filter(words, lambda w: (F.length(w) > 1) | w.isin(*single)), " ")


def han_characters(text: Column) -> Column:
    """Characters of the CJK ranges, one token each."""
    return F.regexp_extract_all(_bare(text), F.lit("[一-鿿㐀-䶿]"), F.lit(0))


def long_sentences(text: Column, least: int = 10) -> Column:
    """Text cut at ``". "``; pieces of more than ``least`` characters, trimmed."""
    return F.filter(F.transform(F.split(_bare(text), r"\. "), lambda s: F.trim(s)), lambda s: F.length(s) > least)


def sentence_number(text: Column) -> Column:
    """Sentences counted by their closing marks."""
    return F.size(F.regexp_extract_all(_bare(text), F.lit("[.!?]+"), F.lit(0)))


def char_ngrams(text: Column, n: int) -> Column:
    """All runs of n characters."""
    t = _bare(text)
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def skipgrams(tokens: Column, skip: int) -> Column:
    """Ordered pairs of tokens with at most ``skip`` others between them, joined by a blank."""
    pair = lambda t: lambda x, i: F.transform(F.slice(t, i + 2, F.lit(skip + 1)), lambda y: F.concat_ws(" ", x, y))
    return let(tokens, lambda t: F.flatten(F.transform(t, pair(t))))
