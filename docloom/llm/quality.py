"""Quality rules as a bitmask ledger [native].

``ledger`` evaluates every rule once per document and stores the failure bits together with the
measurements they came from. Policies are versioned masks over those bits, so a new policy or an
ablation never reads a text again: ``apply_policy`` is one bitwise AND, ``ablations`` one aggregation.

Defined results: a null or empty text has no words, all measurements are 0 and ``few_words`` fails.
Repeated rows are judged alike, each by itself. Extra columns are kept, and one that is named like a
measurement is an error without a prefix; the working columns carry the
prefix ``__q_`` and are dropped. A text's 5-word windows are compared by a 64-bit hash of five 64-bit
word hashes, within that text only. Everything happens inside the scan's stage: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, pinned, words_of

#: name -> condition over the measurements; the position is the bit. Append only: stored ledgers stay valid.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "4 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the bits that reject.
POLICIES = {
    "base-1": BIT["few_words"] | BIT["repeated_windows"],
    "web-1": sum(BIT.values()),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measurements (long) and ``fail_bits`` (long), each named with ``prefix``; raises if ``docs`` has such a column."""
    if clash := {f"{prefix}{m}".lower() for m in (*MEASURES, "fail_bits")} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} exist: name a prefix")
    w, h, s, p, t = (f"`__q_{x}`" for x in "whspt")
    df = docs.withColumn("__q_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns({"__q_w": words_of(F.col("__q_t")), "__q_l": F.filter(F.split("__q_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    df = df.withColumn("__q_h", F.expr(f"IF(size({w}) >= 6, transform(sequence(0, size({w}) - 5), i -> xxhash64({', '.join(f'{w}[i + {k}]' for k in range(5))})), array())"))
    # only texts with a repeated window pay for the sort that finds where the windows are
    df = df.withColumn("__q_s", F.expr(f"IF(size(array_distinct({h})) < size({h}), sort_array(transform({h}, (x, i) -> struct(x AS h, i AS p))), NULL)"))
    df = df.withColumn("__q_p", F.expr(f"sort_array(transform(filter({s}, (x, i) -> coalesce(get({s}, i - 1).h = x.h, false) OR coalesce(get({s}, i + 1).h = x.h, false)), x -> x.p))"))
    covered = F.expr(f"aggregate(transform({p}, (x, i) -> least(5, coalesce(get({p}, i + 1) - x, 5))), 0L, (a, x) -> a + x)")
    bare = F.length(F.translate(F.col("__q_t"), " \t\n\x0b\x0c\r", ""))
    out = {
        "n_words": F.size("__q_w").cast("long"),
        "word_chars": bare.cast("long"),
        "n_symbols": (F.length("__q_t") - F.length(F.translate("__q_t", "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("__q_l").cast("long"),
        "n_dup_lines": (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
    }
    df = pinned(df, **{f"__q_m_{k}": v for k, v in out.items()})
    bits = F.lit(0).cast("long")
    for name, rule in RULES:
        for m in sorted(MEASURES, key=len, reverse=True):
            rule = rule.replace(m, f"@{MEASURES.index(m)}@")
        for i, m in enumerate(MEASURES):
            rule = rule.replace(f"@{i}@", f"`__q_m_{m}`")
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    df = df.withColumns({f"{prefix}{m}": F.col(f"__q_m_{m}") for m in MEASURES} | {f"{prefix}fail_bits": bits})
    return df.drop(*(f"__q_{x}" for x in "wlhspt"), *(f"__q_m_{m}" for m in MEASURES))


def rejects(policy: str, bits: str = "fail_bits"):
    """Column: true where the policy's mask meets a document's failure bits."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def apply_policy(led: DataFrame, policy: str) -> DataFrame:
    """Add ``kept`` to a ledger."""
    return led.withColumn("kept", ~rejects(policy))


def ablations(led: DataFrame, policy: str) -> DataFrame:
    """One row per rule of the policy: documents failing it, failing it alone (kept if it were dropped), kept by all."""
    mask = POLICIES[policy]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    names = [n for n, _ in RULES if BIT[n] & mask]
    aggs = [F.sum((hit == 0).cast("long")).alias("kept"), F.count(F.lit(1)).alias("n_docs")]
    for n in names:
        aggs += [F.sum((hit.bitwiseAND(F.lit(BIT[n]).cast("long")) != 0).cast("long")).alias(f"f_{n}"), F.sum((hit == BIT[n]).cast("long")).alias(f"a_{n}")]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(f"f_{n}", F.lit(0)).alias("n_failed"), F.coalesce(f"a_{n}", F.lit(0)).alias("n_failed_alone")) for n in names)))
    return led.agg(*aggs).select("n_docs", F.coalesce("kept", F.lit(0)).alias("n_kept"), rows.alias("r")).select("r.*", "n_kept", "n_docs")


def keep_good(docs: DataFrame, policy: str = "web-1", text: str = "text") -> DataFrame:
    """The documents that the policy doesn't reject, with their own columns only."""
    led = ledger(docs, text, "__keep_")
    return led.filter(~rejects(policy, "__keep_fail_bits")).select(*(F.col(f"`{c}`") for c in docs.columns))


def quality_query(docs: DataFrame) -> DataFrame:
    led = apply_policy(ledger(docs.select("doc_id", "text")), "web-1")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", rejects("base-1").alias("base_failed"), "kept", "fail_bits")


SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, row_number() OVER () AS r FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 3)) AS p, w FROM w WHERE len(w) >= 5),
k AS (SELECT r, p, array_to_string(w[p:p + 4], ' ') AS s FROM g),
d AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n FROM k) WHERE n > 1),
c AS (SELECT r, sum(least(5, coalesce(q - p, 5)))::BIGINT AS c FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS q FROM d) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, ({' + '.join(f'CASE WHEN {c} THEN {1 << i} ELSE 0 END' for i, (_, c) in enumerate(RULES))})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {POLICIES['base-1']}) <> 0 AS base_failed, (fail_bits & {POLICIES['web-1']}) = 0 AS kept, fail_bits FROM b
"""
