"""Queries of document vectors, texts filtered by shared events, text quality, rankings by statutes and trained segments, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import legal
from docloom.functions import text as X
from docloom.operators import dense, docvectors, overlap, profiles, rank, score, segments, sets, vocabulary
from docloom.plans.catalog import _TOP, _asked, table
from docloom.plans.legal import statutes_sql
from docloom.sources.tables import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("document_vectors_top10")
def _document_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the cosine of their vectors with those inferred for the items, which the training hasn't seen."""
    docs, words = table(spark, d, "documents").select("doc_id", "text"), X.clean_tokens(F.col("text"))
    model = docvectors.fit(docs, words, vocabulary.vocabulary(docs, words, 2, 20_000))
    asked = docvectors.infer(model, _asked(spark, d), words, "query_id")
    return rank.top(dense.best(asked, docvectors.infer(model, docs, words), 10), 10)


_asks = lambda: F.col("doc_id") % 20 == 0
_lines = lambda: F.split(F.coalesce("text", F.lit("")), "\n")


def _word_triples(sentence: Column) -> Column:
    return X.ngrams(X.clean_tokens(sentence), 3)


_EVENTS = """docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
lines AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS line FROM docs),
toks AS (SELECT doc_id, line, regexp_extract_all(lower(regexp_replace(sentence, '<[^>]+>', ' ', 'g')), '[a-z]{2,}') AS t FROM lines),
each_ AS (SELECT doc_id, line, t, unnest(range(1, len(t) - 1)) AS p FROM toks WHERE len(t) >= 3),
e AS (SELECT DISTINCT doc_id, line, t[p] || '_' || t[p + 1] || '_' || t[p + 2] AS event FROM each_),
sided AS (SELECT 'candidate' AS side, * FROM e UNION ALL SELECT 'query', * FROM e WHERE doc_id % 20 = 0),
held AS (SELECT side, event, min(doc_id) AS lo, max(doc_id) AS hi FROM sided GROUP BY ALL),
met AS (SELECT s.* FROM sided s JOIN held h ON s.event = h.event AND s.side <> h.side WHERE lo <> doc_id OR hi <> doc_id)"""


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return docs, overlap.events_of(docs, _lines(), _word_triples, _asks())


@query("event_filtered_texts", f"""WITH {_EVENTS},
kept AS (SELECT side, doc_id, count(*) AS n_lines, string_agg(sentence, chr(10) ORDER BY line) AS text FROM (SELECT DISTINCT side, doc_id, line FROM met) JOIN lines USING (doc_id, line) GROUP BY ALL),
all_ AS (SELECT 'candidate' AS side, doc_id FROM documents UNION ALL SELECT 'query', doc_id FROM documents WHERE doc_id % 20 = 0)
SELECT side, doc_id, coalesce(n_lines, 0) AS n_lines, md5(coalesce(text, '')) AS text_md5 FROM all_ LEFT JOIN kept USING (side, doc_id)""")
def _filtered(spark: SparkSession, d: str) -> DataFrame:
    docs, events = _events(spark, d)
    out = overlap.filtered_texts(docs, _lines(), overlap.shared_lines(events), _asks())
    return out.select("side", "doc_id", "n_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("shared_event_counts", f"WITH {_EVENTS} SELECT side, doc_id, count(DISTINCT event) AS n_shared FROM met GROUP BY ALL")
def _shared(spark: SparkSession, d: str) -> DataFrame:
    return overlap.shared_events(_events(spark, d)[1])


_PAIRS = f"""bare AS (SELECT doc_id, lang, string_split(regexp_replace(coalesce(text, ''), '[^\\t\\n\\x0b\\x0c\\r -~]', '', 'g'), '') AS c FROM (SELECT doc_id, lang, text FROM documents)),
cut AS (SELECT doc_id, lang, list_filter(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), lambda g: regexp_full_match(g, '[A-Za-z0-9]{{2}}')) AS g FROM bare),
n AS (SELECT doc_id, lang, 128 * ascii(pair[1]) + ascii(pair[2]) AS pair, count(*) AS n FROM (SELECT doc_id, lang, unnest(g) AS pair FROM cut) GROUP BY ALL),
total AS (SELECT doc_id, sum(n) AS total FROM n JOIN documents USING (doc_id) WHERE length(text) >= {profiles.LEAST} GROUP BY 1),
size AS (SELECT lang, count(*) AS texts FROM documents JOIN total USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1),
profile AS (SELECT lang, pair, sum(n / total) / any_value(texts) AS share FROM n JOIN total USING (doc_id) JOIN size USING (lang) GROUP BY 1, 2)"""


@query("language_profiles", f"WITH {_PAIRS} SELECT lang, pair::INT AS pair, round(share, 9) AS share FROM profile")
def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return profiles.language_profiles(table(spark, d, "documents")).withColumn("share", F.round("share", 9))


@query("text_quality_ratings", f"""WITH {_PAIRS},
known AS (SELECT lang, sqrt(sum(share * share)) AS z FROM profile GROUP BY 1),
named AS (SELECT doc_id, coalesce(k.lang, 'en') AS lang FROM documents d LEFT JOIN known k ON d.lang = k.lang),
dots AS (SELECT n.doc_id, m.lang, sum(n.n * p.share) AS dot FROM n JOIN named m ON n.doc_id = m.doc_id JOIN profile p ON p.lang = m.lang AND p.pair = n.pair GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM n GROUP BY 1),
c AS (SELECT doc_id, round(dot / (norm * z), 9) AS cosine FROM dots JOIN norms USING (doc_id) JOIN known USING (lang)),
x AS (SELECT doc_id, coalesce(cosine, 0) AS cosine FROM documents LEFT JOIN c USING (doc_id))
SELECT doc_id, cosine, round_even(floor(cosine * 100) / 10, 0) AS rating,
  CASE WHEN cosine * 100 < {profiles.LOWEST} THEN 0 ELSE least(10, round_even({profiles.SQUARE}::DOUBLE * pow(cosine * 100, 2) + ({profiles.LINEAR}::DOUBLE) * cosine * 100 + {profiles.CONSTANT}::DOUBLE, 0)) END AS rating_quadratic FROM x""")
def _ratings(spark: SparkSession, d: str) -> DataFrame:
    return profiles.rated_by_own_language(table(spark, d, "documents"))


#: Acts that the cases of the statute queries name; a line item names one by its part.
_NAMED = ("Income Tax Act", "Companies Act", "Evidence Act", "Customs Act", "Indian Penal Code", "Forest Conservation Act")
_CITING = "'Held under Section ' || l_suppkey || ' of the ' || ({acts})[{at}] || ', as the lessee pleads.'"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, element): statutes that a case, an order, names in a sentence a line item."""
    acts = "array(" + ", ".join(f"'{a}'" for a in _NAMED) + ")"
    texts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.expr(_CITING.format(acts=acts, at=f"cast(l_partkey % {len(_NAMED)} AS int)")).alias("text"))
    return texts.select("doc_id", F.explode(legal.statutes(F.col("text"))).alias("element")).distinct()


_CASES = f"t AS (SELECT l_orderkey AS doc_id, {_CITING.format(acts='[' + ', '.join(repr(a) for a in _NAMED) + ']', at=f'l_partkey % {len(_NAMED)} + 1')} AS text FROM lineitem)"
_SETS = f"""WITH y AS ({statutes_sql(3, _CASES)}), x AS (SELECT doc_id AS query_id, value FROM y WHERE doc_id % 20 = 0),
w AS (SELECT value, pow(ln(((SELECT count(DISTINCT doc_id) FROM y) + 1) / (count(*) + 1)) + 1, 2) AS w FROM y GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n, sum(w) AS z FROM y JOIN w USING (value) GROUP BY 1),
p AS (SELECT query_id, doc_id, count(*) AS overlap, sum(w) AS dot FROM x JOIN y USING (value) JOIN w USING (value) WHERE query_id <> doc_id GROUP BY ALL),
scores AS (SELECT query_id, p.doc_id, overlap, round(overlap / (a.n + b.n - overlap), 6) AS jaccard, round(overlap / sqrt(a.n * b.n), 6) AS coupling, round(dot / sqrt(a.z * b.z), 6) AS idf_cosine
  FROM p JOIN s a ON a.doc_id = query_id JOIN s b ON b.doc_id = p.doc_id)"""


def _by_statutes(spark: SparkSession, d: str) -> DataFrame:
    cases = written(_cases(spark, d))
    return sets.set_scores(cases.filter(_asks()).withColumnRenamed("doc_id", "query_id"), cases).filter("query_id <> doc_id")


for _kind in ("overlap", "jaccard", "coupling", "idf_cosine"):
    QUERIES[f"statutes_{_kind}_top10"] = lambda spark, d, k=_kind: rank.top(_by_statutes(spark, d).select("query_id", "doc_id", F.col(k).cast("double").alias("score")), 10)
    ORACLES[f"statutes_{_kind}_top10"] = f"{_SETS}, run AS (SELECT query_id, doc_id, {_kind}::DOUBLE AS score FROM scores) {_TOP.format(k=10)}"


@query("statutes_boosted_top10", f"{_SETS}, run AS (SELECT query_id, doc_id, round(jaccard * (1 + idf_cosine), 6) AS score FROM scores) {_TOP.format(k=10)}")
def _boosted(spark: SparkSession, d: str) -> DataFrame:
    """The Jaccard run raised by the weighted cosine."""
    both = written(_by_statutes(spark, d))
    run = lambda c: both.select("query_id", "doc_id", F.col(c).alias("score"))
    return rank.top(rank.boost(run("jaccard"), run("idf_cosine"), 1.0), 10)


#: Transcripts: a head line a turn, then its text.
_HEADS = "upper(role) || ' ' || turn"


def _transcripts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as texts (conv_id, text), and the lines where a turn begins (conv_id, line)."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.expr(f"{_HEADS} || '\n' || coalesce(text, '')").alias("t"))
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("x"))  # one conversation
    sizes = F.transform("x", lambda x: F.size(F.split(x["t"], "\n")))
    first = F.transform(F.sequence(F.lit(1), F.size("x")), lambda i: F.aggregate(F.slice(sizes, 1, i - 1), F.lit(0), lambda s, n: s + n))
    return each.select("conv_id", F.array_join(F.col("x.t"), "\n").alias("text")), each.select("conv_id", F.explode(first).alias("line"))


def _segment_model(docs: DataFrame, marked: DataFrame) -> segments.LineModel:
    return segments.fit_lines(docs.filter("conv_id % 2 = 0"), marked.filter("conv_id % 2 = 0"), id_col="conv_id")


_TURNS = f"turns AS (SELECT conv_id, turn, {_HEADS} AS head, {_HEADS} || chr(10) || coalesce(text, '') || chr(10) AS t FROM conversations WHERE conv_id % 2 = 1)"
_STARTS = f"{_TURNS}, placed AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns)"


@query("trained_turn_segments", f"WITH {_STARTS} SELECT conv_id, nth::INT AS nth, begun::INT AS start, (begun + length(t) - (back = 1)::INT)::INT AS \"end\" FROM placed")
def _turn_segments(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts of odd conversations cut into turns by a model that learned from even ones; the SQL knows the turns."""
    docs, marked = _transcripts(spark, d)
    return segments.segments(_segment_model(docs, marked), docs.filter("conv_id % 2 = 1"), id_col="conv_id").drop("text")


@query("trained_titles", f"WITH {_STARTS} SELECT conv_id, nth::INT AS nth, begun::INT AS start, (begun + length(head))::INT AS \"end\", head AS text FROM placed")
def _titles(spark: SparkSession, d: str) -> DataFrame:
    """Their head lines as titles."""
    docs, marked = _transcripts(spark, d)
    return segments.segments(_segment_model(docs, marked), docs.filter("conv_id % 2 = 1"), titles=True, id_col="conv_id")
