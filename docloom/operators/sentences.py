"""Sentence boundaries learned from raw text without labels (Kiss and Strunk, "Unsupervised multilingual sentence boundary detection", 2006).

Training counts words once, with the full stop behind them and the one before them. Three tests by log likelihood follow, each
a join or a grouping of that table: words that a full stop belongs to (abbreviations), pairs that a full stop doesn't part
(a number or an initial and its next word), words that mostly begin sentences; and the case in which each word was seen.

A text is cut behind each closing mark inside its row. Only word pairs at the cuts leave the row; what a cut means follows
from its pair, so pairs are judged once each, and the cuts meet the table of pairs that hold together. No text is shuffled
and no table is gathered: the model's tables grow with the vocabulary and are joined.

Defined results: ids are unique. Words end at ASCII blanks; a word's type is lower-cased, without quotes, brackets and marks at its
ends, figures are one type ``#``. ``.`` may be part of an abbreviation, ``!`` and ``?`` and blank lines always end a sentence.
Sentences are trimmed; those with no word of three letters and no digit are dropped, as are null and blank texts. Places
count code points, an end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import let
from docloom.sources.tables import written

BLANK = r"[\x20\x09-\x0D]"
#: What stands before and behind a word, and the marks that end a sentence.
BEFORE, BEHIND, MARKS = "\"'([", "\"')],;:", ".?!"
#: A cut is behind marks and up to three closing signs before a blank, and before a blank line.
CUTS = rf"""(?={BLANK})(?:(?<=[.?!]["')\]]{{0,3}})|(?=\n[\x20\x09]*\n))"""
FIGURE = r"^-?[0-9][0-9.,-]*$"
#: A sentence needs a word of three letters or a digit.
SENSE = r"\p{L}{3}|[0-9]"
#: Thresholds of the published method: abbreviation, collocation, sentence starter.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0


@dataclass(frozen=True)
class SentenceModel:
    """Written tables."""

    abbreviations: DataFrame  # type
    collocations: DataFrame  # type, next
    words: DataFrame  # type, starter, lower, upper, upper_inside, lower_first


def _core(token: Column) -> Column:
    return F.rtrim(F.ltrim(token, F.lit(BEFORE)), F.lit(BEHIND))


def _type(core: Column) -> Column:
    word = F.rtrim(core, F.lit(MARKS))
    return F.when(word.rlike(FIGURE), "#").otherwise(F.lower(word))


def _mark(core: Column) -> Column:
    """``.``, ``!`` (also for ``?``) or nothing."""
    return F.when(core.endswith("."), ".").when(core.endswith("!") | core.endswith("?"), "!").otherwise("")


def _upper(core: Column) -> Column:
    head = F.substring(core, 1, 1)
    return head != F.lower(head)


def _initial(word: Column) -> Column:
    return word.rlike(r"^\p{L}$")


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda x: x != "")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, mark, upper, before, prev, n): ``before`` is the mark of the previous word (null: none), ``prev`` its type if that is a full stop."""
    cores = F.transform(_words(F.col(text_col)), _core)
    pairs = let(cores, lambda t: F.transform(t, lambda x, i: F.struct(x.alias("core"), F.get(t, i - 1).alias("back"))))
    rows = docs.select(F.inline(pairs))
    before = F.when(F.col("back").isNotNull(), _mark(F.col("back")))
    keyed = rows.select(_type(F.col("core")).alias("type"), _mark(F.col("core")).alias("mark"), _upper(F.col("core")).alias("upper"), before.alias("before"), F.when(before == ".", _type(F.col("back"))).alias("prev"))
    return keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))


def _xlog(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.log(y))


def _ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's log likelihood ratio of events ``a`` and ``b`` that meet ``ab`` times among ``n``."""
    split = lambda k, m, p: _xlog(k, p) + _xlog(m - k, 1 - p)
    apart = split(ab, a, b / n) + split(b - ab, n - a, b / n)
    return F.round(-2 * (apart - split(ab, a, ab / a) - split(b - ab, n - a, (b - ab) / (n - a))), 6)


def fit(docs: DataFrame, text_col: str = "text", extra: tuple[str, ...] = ()) -> SentenceModel:
    """Learn from all texts. ``extra``: abbreviations known beforehand, lower-case, without their last full stop."""
    counts = written(word_counts(docs, text_col))
    sums = counts.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("mark") == ".", F.col("n")).otherwise(0)).alias("stops"))  # one row
    types = counts.groupBy("type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("mark") == ".", F.col("n")).otherwise(0)).alias("with_stop"))

    share = F.col("stops") / F.col("total")
    inner = F.length("type") - F.length(F.translate("type", ".", ""))
    size = F.length("type") - inner
    without = F.col("n") - F.col("with_stop")
    likelihood = 2 * (F.col("with_stop") * F.log(0.99 / share) + without * F.log(0.01 / (1 - share)))
    score = F.round(likelihood * F.exp(-size) * (inner + 1) * F.pow(size.cast("double"), -without), 6)
    scored = types.filter((F.col("with_stop") > 0) & F.col("type").rlike(r"\p{L}")).crossJoin(F.broadcast(sums)).filter((F.col("total") > F.col("stops")) & (score >= ABBREVIATION)).select("type")  # one row
    known = docs.sparkSession.createDataFrame([(x,) for x in extra], "type string")
    abbreviations = written(scored.union(known).distinct())

    # what a previous full stop was: the word's own, or the end of a sentence
    own = F.col("own") | (F.col("prev") == "#") | _initial(F.col("prev")) | (F.col("prev") == "")
    after = counts.join(abbreviations.select(F.col("type").alias("prev"), F.lit(True).alias("own")), "prev", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    place = F.when(F.col("before").isNull() | (F.col("before") == "!"), "first").when(F.col("before") == "", "inside").when(own, "unknown").otherwise("first")
    after = written(after.withColumn("place", place))
    some = lambda cond: F.max(F.when(cond, 1).otherwise(0)) == 1
    began = (F.col("place") == "first") & F.col("before").isNotNull()
    seen = after.groupBy("type").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(began, F.col("n")).otherwise(0)).alias("began"),
        some(~F.col("upper")).alias("lower"),
        some(F.col("upper")).alias("upper"),
        some(F.col("upper") & (F.col("place") == "inside")).alias("upper_inside"),
        some(~F.col("upper") & (F.col("place") == "first")).alias("lower_first"),
    )
    breaks = after.agg(F.sum("n").alias("total"), F.sum(F.when(began, F.col("n")).otherwise(0)).alias("breaks"))  # one row
    a, b, ab, n = (F.col(c) for c in ("breaks", "n", "began", "total"))
    starts = F.col("type").rlike(r"\p{L}") & (ab > 0) & (n > a) & (_ratio(a, b, ab, n) >= STARTER) & (n * ab > a * b)
    words = written(seen.crossJoin(F.broadcast(breaks)).select("type", F.coalesce(starts, F.lit(False)).alias("starter"), "lower", "upper", "upper_inside", "lower_first"))

    kept = F.col("prev").rlike(r"^(#|\p{L})$") & ~F.col("own") & F.col("type").rlike(r"\p{L}|^#$")
    met = after.filter(kept).groupBy("prev", "type").agg(F.sum("n").alias("met"))
    ends = types.select(F.col("type").alias("prev"), F.col("n").alias("n_prev"))
    met = met.join(types.select("type", "n"), "type").join(ends, "prev").crossJoin(F.broadcast(sums))
    a, b, ab, n = (F.col(c) for c in ("n_prev", "n", "met", "total"))
    paired = met.filter((ab > 1) & (n > a) & (_ratio(a, b, ab, n) >= COLLOCATION) & (n * ab > a * b))
    return SentenceModel(abbreviations, written(paired.select(F.col("prev").alias("type"), F.col("type").alias("next"))), words)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, i, size, lead, tail, sense, mark, type, next, next_upper) of each piece of a text between cuts; ``next`` is null before a blank line."""
    blanks, run = F.lit(" \t\n\x0b\x0c\r"), r"^[^\x20\x09-\x0D]+"
    last = lambda x: _core(F.reverse(F.regexp_extract(F.reverse(F.rtrim(x, blanks)), run, 0)))
    first = lambda x: _core(F.regexp_extract(F.ltrim(x, blanks), run, 0))
    cut = let(F.split(F.coalesce(text_col, F.lit("")), CUTS), lambda t: F.transform(t, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.get(t, i + 1).alias("y"))))
    rows = docs.select(id_col, F.inline(cut))
    tail = F.length("x") - F.length(F.rtrim("x", blanks))
    lead = F.length("x") - F.length(F.ltrim("x", blanks))
    core = last(F.col("x"))
    hard = F.col("y").isNull() | F.col("y").rlike(r"^\n[\x20\x09]*(\n|$)")
    ahead = F.when(~hard, first(F.col("y")))
    return rows.select(id_col, "i", F.length("x").alias("size"), lead.alias("lead"), tail.alias("tail"), F.col("x").rlike(SENSE).alias("sense"), _mark(core).alias("mark"), _type(core).alias("type"), _type(ahead).alias("next"), _upper(ahead).alias("next_upper"))


def held_pairs(model: SentenceModel, pairs: DataFrame) -> DataFrame:
    """Of ``pairs(type, next, next_upper)`` around a full stop those that stay in one sentence."""
    named = pairs.join(model.abbreviations.withColumn("own", F.lit(True)), "type", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    single, figure = _initial(F.col("type")), F.col("type") == "#"
    open_ = named.filter(F.col("own") | single | figure | (F.col("type") == ""))
    looks = open_.join(model.words.withColumnRenamed("type", "next"), "next", "left").join(model.collocations.withColumn("paired", F.lit(True)), ["type", "next"], "left")
    has = lambda c: F.coalesce(c, F.lit(False))
    word = F.col("next").rlike(r"\p{L}")
    up = F.col("next_upper")
    begins = word & up & has("lower") & ~has("upper_inside")
    goes_on = ~word | (~up & (has("upper") | ~has("lower_first")))
    # the full stop of an abbreviation or of dots ends a sentence only before a word that tells it
    weak = (F.col("own") | (F.col("type") == "")) & ~single
    ends = F.when(has("paired"), False).when(weak, begins | (up & has("starter"))).when(single & ~begins & ~goes_on & up & ~has("lower"), False).otherwise(~goes_on)
    return looks.filter(~ends).select("type", "next", "next_upper")


def sentences(model: SentenceModel, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, nth, start, end) of each sentence."""
    cut = written(pieces(docs, id_col, text_col))
    pairs = cut.filter("mark = '.' AND next IS NOT NULL").select("type", "next", "next_upper").distinct()
    held = held_pairs(model, pairs).withColumnsRenamed({"type": "t", "next": "n", "next_upper": "u"}).withColumn("held", F.lit(True))
    on = (F.col("mark") == ".") & (F.col("type") == F.col("t")) & (F.col("next") == F.col("n")) & (F.col("next_upper") == F.col("u"))
    # blanks between marks and a word without a mark never part: there is no cut but at marks and blank lines
    told = cut.join(held, on, "left").select(id_col, "i", "size", "lead", "tail", "sense", F.coalesce("held", F.lit(False)).alias("held"))
    back = W.partitionBy(id_col).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    placed = told.withColumns({"begun": F.coalesce(F.sum("size").over(back), F.lit(0)), "s": F.coalesce(F.sum(F.when(F.col("held"), 0).otherwise(1)).over(back), F.lit(0))})
    whole = placed.filter("size > lead").groupBy(id_col, "s").agg(F.min(F.expr("begun + lead")).alias("start"), F.max(F.expr("begun + size - tail")).alias("end"), F.max("sense").alias("sense"))
    kept = whole.filter("sense")
    return kept.select(id_col, (F.row_number().over(W.partitionBy(id_col).orderBy("s")) - 1).alias("nth"), F.col("start").cast("int"), F.col("end").cast("int"))
