"""Filter interaction audit: what each filter removes at each place of each order.

A document's failures are a bit mask; documents are counted per part and mask ("cells") with map-side combine, so
all that follows works on at most 2^filters cells a part and label. The orders are visited by adjacent
transpositions (each next order swaps two neighbours, plain changes): a swap leaves what stands before and behind
the two filters as it was, so only their two steps are read from the cells again. Shapley values accumulate along
the same walk: what a filter removes, summed over all orders.

``audit`` takes any Boolean failure conditions over ``docs``; ``duplicates`` names a filter that fails a text which
a smaller doc_id holds as well. For that, the smallest doc_id of each text (SHA-256) is found by a partial
aggregation, and a row keeps its place only if (text, doc_id) meets it: no group of copies is gathered anywhere.

Defined results: a null text is empty, a null part the empty string. A null doc_id is not compared, so it never
fails ``duplicates``; rows that repeat a doc_id and its text aren't smaller than each other. A document without
labels is neither good nor toxic, one with several label rows is good (toxic) if any says so. A condition that is
null doesn't fail. Empty tables give no parts and no rows. Extra columns don't matter; nothing of ``docs`` is renamed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import pinned, words_of

#: Orders grow by the factorial: eight filters have 40,320.
MOST_FILTERS = 8


def plain_changes(n: int) -> Iterator[int]:
    """The place of each swap that leads through all orders of n things (n! - 1 swaps of neighbours)."""
    if n < 2:
        return
    inner, down = plain_changes(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)  # the last thing travels through the others
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # the traveller stands at the front after going down: the others are one place on
        down = not down


def failures(docs: DataFrame, filters: dict[str, Column], duplicates: str | None = None, part: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, doc_id, mask): the bits of the failed filters, in the order of ``filters``; ``duplicates`` takes the next bit."""
    bits = F.lit(0)
    for n, fails in enumerate(filters.values()):
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << n)).otherwise(F.lit(0)))
    own = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("h") if duplicates else F.lit(None).alias("h"), bits.alias("mask"))
    if not duplicates:
        return own.drop("h")
    first = own.groupBy("h").agg(F.min("doc_id").alias("first")).select(F.col("h").alias("fh"), "first")
    met = own.join(first, (F.col("h") == F.col("fh")) & (F.col("doc_id") == F.col("first")), "left")
    later = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return met.select("part", "doc_id", F.when(later, F.col("mask").bitwiseOR(F.lit(1 << len(filters)))).otherwise(F.col("mask")).alias("mask"))


def cells(failed: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents per mask, and how many of them are labelled so."""
    if labels is None:
        failed = failed.withColumns({"g": F.lit(0), "x": F.lit(0)})
    else:
        says = labels.groupBy(F.col(id_col).alias("lid")).agg(F.max((F.col("quality") == 1).cast("int")).alias("g"), F.max((F.col("toxic") == 1).cast("int")).alias("x"))
        failed = failed.join(says, F.col("doc_id") == F.col("lid"), "left")
    return failed.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("g", F.lit(0)).cast("long")).alias("good"), F.sum(F.coalesce("x", F.lit(0)).cast("long")).alias("toxic"))


def walk(names: str, counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part's cells."""
    k, total = len(names), sum(n for n, _, _ in counts.values())
    fails = [sum(n for m, (n, _, _) in counts.items() if m >> f & 1) for f in range(k)]
    alone = [counts.get(1 << f, (0, 0, 0))[0] for f in range(k)]

    def removed(before: int, f: int) -> tuple[int, int, int]:
        """Documents, good and toxic ones that fail f and none of the filters before."""
        hit = [c for m, c in counts.items() if m >> f & 1 and not m & before]
        return tuple(map(sum, zip(*hit))) if hit else (0, 0, 0)

    order, shapley, out = list(range(k)), [0] * k, []
    steps = [removed((1 << f) - 1, f) for f in order]

    def visit() -> None:
        kept, name = total, "".join(names[f] for f in order)
        for place, (f, (n, good, toxic)) in enumerate(zip(order, steps), 1):
            kept -= n
            shapley[f] += n
            out.append((name, place, kept, n, fails[f] - n, alone[f], good, toxic, f))

    visit()
    for i in plain_changes(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        before = sum(1 << f for f in order[:i])
        steps[i], steps[i + 1] = removed(before, order[i]), removed(before | 1 << order[i], order[i + 1])
        visit()
    return [(*r[:-1], shapley[r[-1]]) for r in out]


def audit(docs: DataFrame, filters: dict[str, Column], labels: DataFrame | None = None, duplicates: str | None = None, part: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per part, order of the filters (their one-letter names) and step; see ``walk`` for the columns."""
    names = [*filters, *([duplicates] if duplicates else [])]
    if not 0 < len(names) <= MOST_FILTERS or any(len(n) != 1 for n in names) or len(set(names)) < len(names):
        raise ValueError(f"one to {MOST_FILTERS} filters with different one-letter names are needed")
    found = cells(failures(docs, filters, duplicates, part, id_col, text), labels, id_col)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:  # the cells of one part: at most 2^filters rows
        rows = walk("".join(names), {int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in pdf.itertuples()})
        return pd.DataFrame([(pdf.part.iloc[0], *r) for r in rows], columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return found.groupBy("part").applyInPandas(one, schema)


def audit_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters of the corpus: short (A), repetitive (B), upper case (C), symbols (D), copies (E)."""
    own = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    symbols = F.length("text") - F.length(F.translate("text", "#$%&*|", ""))
    own = own.withColumn("w", words_of(F.col("text")))
    own = pinned(own, n=F.size("w").cast("long"), d=F.size(F.array_distinct("w")).cast("long"), c=capitals.cast("long"), s=symbols.cast("long"), chars=F.length("text").cast("long")).drop("w")
    filters = {"A": F.col("n") < 50, "B": 100 * F.col("d") < 65 * F.col("n"), "C": 100 * F.col("c") > 5 * F.col("chars"), "D": F.col("s") > 0}
    return audit(own, filters, labels, duplicates="E")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source::VARCHAR, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS b FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS g, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id),
c AS (SELECT part, b, count(*) AS n, sum(coalesce(g, 0)) AS g, sum(coalesce(x, 0)) AS x FROM f LEFT JOIN l USING (doc_id) GROUP BY part, b),
o AS (SELECT [a, b, c, d, e] AS o FROM range(1, 6) t1(a), range(1, 6) t2(b), range(1, 6) t3(c), range(1, 6) t4(d), range(1, 6) t5(e) WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT o, s FROM o, range(1, 6) r(s)),
x AS (SELECT part, o, s, o[s] AS f,
  coalesce(sum(n) FILTER (NOT list_contains(list_transform(o[1:s], lambda i: b[i]), true)), 0) AS kept,
  coalesce(sum(n) FILTER (b[o[s]] AND NOT list_contains(list_transform(o[1:s - 1], lambda i: b[i]), true)), 0) AS removed,
  coalesce(sum(n) FILTER (b[o[s]]), 0) AS fails, coalesce(sum(n) FILTER (b[o[s]] AND len(list_filter(b, lambda v: v)) = 1), 0) AS unique_fails,
  coalesce(sum(g) FILTER (b[o[s]] AND NOT list_contains(list_transform(o[1:s - 1], lambda i: b[i]), true)), 0) AS good_lost,
  coalesce(sum(x) FILTER (b[o[s]] AND NOT list_contains(list_transform(o[1:s - 1], lambda i: b[i]), true)), 0) AS toxic_lost
  FROM c, s GROUP BY part, o, s)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, (fails - removed)::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM x
"""
