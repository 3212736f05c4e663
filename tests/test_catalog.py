"""Every query against its SQL on sf0.001, as the driver compares them."""

import duckdb
import pytest

from docloom.functions import extract
from docloom.operators.index import postings
from docloom.plans import boundaries, catalog, experiments, grammar, learning, legal, matching, ranking, reports, texts
from docloom.plans.catalog import FLAGSHIP

QUERIES, ORACLES = boundaries.QUERIES | catalog.QUERIES | experiments.QUERIES | grammar.QUERIES | learning.QUERIES | legal.QUERIES | matching.QUERIES | ranking.QUERIES | reports.QUERIES | texts.QUERIES, boundaries.ORACLES | catalog.ORACLES | experiments.ORACLES | grammar.ORACLES | learning.ORACLES | legal.ORACLES | matching.ORACLES | ranking.ORACLES | reports.ORACLES | texts.ORACLES
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(data, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(round(float(r[k]), 5) if isinstance(r[k], float) or type(r[k]).__name__ == "Decimal" else r[k] for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    order = sorted(want.columns)
    clean = lambda data, cols: sorted((tuple(round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in (r[cols.index(o)] for o in order)) for r in data), key=key)
    assert clean(df.collect(), df.columns) == clean(want.fetchall(), want.columns)


def test_extractors(spark):
    df = spark.createDataFrame([("x 123-45-6789 000-12-3456 (212) 555-1234 5.5% 25 basis points 3:4 7 km Clean Air Act of 1970, 15 USC 78",), (None,)], "t string")
    r = df.select(extract.ssn(df.t).alias("s"), *(extract.matches(k, df.t).alias(k) for k in ("phone", "percent", "ratio", "distance", "act", "regulation"))).first()
    assert r.s == ["123-45-6789"] and r.phone == ["(212) 555-1234"] and r.percent == ["5.5%", "25 basis points"] and r.ratio == ["3:4"]
    assert r.distance == ["7 km"] and r.act == ["Clean Air Act of 1970"] and r.regulation == ["15 USC 78"]


def test_flagship_plan(spark):
    df = QUERIES[FLAGSHIP](spark, SF)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = postings(docs, "doc_id", unique=True)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
    one, many = (sorted(map(tuple, postings(docs, "doc_id", ngram=2, unique=u).collect())) for u in (True, False))
    assert one == many
    plan = postings(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange") :]  # what moves first is counted already
    assert "partial_sum" in below and below.index("partial_sum") < below.index("Generate")
