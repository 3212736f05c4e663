"""Records and references on literal texts, with the values a reader expects."""

import datetime

import pytest
from pyspark.sql import functions as F

from docloom.functions import legal, records, text as T
from docloom.operators import minhash

WANT = {
    "ssn": [("SSN 123-45-6789, 000-12-3456", ["value"], [("123-45-6789",)])],
    "phone": [("call (212) 555-1234", ["area", "exchange", "last4"], [("212", "555", "1234")])],
    "cusip": [("Apple 037833100, not 037833101", ["issuer", "issue", "checksum", "valid"], [("037833", "10", 0, True), ("037833", "10", 1, False)]), ("Google 38259P508.", ["valid"], [(True,)])],
    "act": [("under Section 7 of the Clean Air Act of 1970.", ["section", "act_name", "year"], [("7", "Clean Air Act", 1970)])],
    "percent": [("5.5%, -2 percent and 25 basis points", ["amount", "fraction"], [(5.5, 0.055), (-2.0, -0.02), (25.0, 0.0025)])],
    "ratio": [("odds of 3:4 at 10:30 AM or 5/0", ["left", "right", "ratio"], [(3.0, 4.0, 0.75), (5.0, 0.0, None)])],
    "distance": [("1,200.5 miles and 7 km", ["amount", "unit"], [(1200.5, "mile"), (7.0, "kilometer")])],
    "duration": [("30 days, a 12-month term, 90 minutes", ["unit", "days"], [("day", 30.0), ("month", 360.0), ("minute", 0.0625)])],
    "money": [("$1,250.50, € 3 million, 2 billion USD", ["amount", "currency"], [(1250.5, "USD"), (3e6, "EUR"), (2e9, "USD")])],
    "regulation": [("15 USC 78, 17 CFR § 240.10b-5, Pub. L. No. 111-203, 124 Stat. 1376", ["source", "name"], [("USC", "78"), ("CFR", "240.10b-5"), ("Public Law", "111-203"), ("Stat.", "1376")])],
    "copyright": [("Copyright (c) 2001-2005 Acme Widgets, Inc. rest", ["sign", "date", "name"], [("Copyright (c)", "2001-2005", "Acme Widgets, Inc.")])],
    "trademark": [("Best Brand(TM) here", ["text"], []), ("the Super Clean® soap", ["text"], [("Super Clean®",)])],
    "url": [("see https://example.org/a?b=1, or www.example.com.", ["text"], [("https://example.org/a?b=1",), ("www.example.com",)])],
    "date": [("on January 5, 2010 or May 40, 2010", ["date"], [(datetime.date(2010, 1, 5),), (None,)])],
    "reporter_page": [("410 U.S. 113, 152 (1973), 12 F.3d 1011 (9th Cir. 1993)", ["volume", "reporter", "page", "page2", "year"], [(410, "U.S.", 113, 152, 1973), (12, "F.3d", 1011, None, None)])],
    "condition": [("Pay now, provided that it works, unless and until cancelled.", ["phrase", "before"], [("provided that", "Pay now,"), ("unless and until", "it works,")])],
    "constraint": [("It lasts no later than June or at least twice.", ["phrase"], [("no later than",), ("at least",)])],
}


@pytest.mark.parametrize("kind", sorted(WANT))
def test_records(spark, kind):
    for text, names, want in WANT[kind]:
        found = spark.createDataFrame([(text,)], "t string").select(F.explode(records.records(kind, F.col("t"))).alias("r")).select("r.*").collect()
        assert [tuple(r[n] for n in names) for r in found] == want
        assert all(text[r.start : r.end] == r.text for r in found)
    assert spark.createDataFrame([(None,), ("",)], "t string").select(F.explode(records.records(kind, F.col("t")))).count() == 0


def test_places_are_code_points(spark):
    t = "\U0001f600 é 5% ü 7 percent"
    r = spark.createDataFrame([(t,)], "t string").select(F.explode(records.records("percent", F.col("t"))).alias("r")).select("r.*").collect()
    assert [t[x.start : x.end] for x in r] == ["5%", "7 percent"]


def test_legal(spark):
    t = "Section 147 of the Income Tax Act, 1961; s. 302 IPC. Order XXXIX Rule 1. AIR 1973 SC  1461 and air 1973 sc 1461"
    df = spark.createDataFrame([(t,), (None,)], "t string")
    r = df.select(legal.statutes(F.col("t")).alias("s"), legal.reporter_citations(F.col("t")).alias("c")).collect()
    assert set(r[0].s) == {"S147_ITA", "S302_IPC", "OXXXIX_R1_CPC"} and r[0].c == ["AIR_1973_SC_1461"] and r[1].s == [] == r[1].c
    t = "<CITATION_2> <CITATION_1>\n1. <CITATION_3> <CITATION_1> <CITATION_3>\n2. none"
    r = spark.createDataFrame([(t,)], "t string").select(legal.co_cited_pairs(F.col("t")).alias("p")).first()
    assert [(x.a, x.b) for x in r.p] == [("1", "2"), ("1", "3")]
    t = "Top PETITIONER: A. ACT: one ACT: two HEADNOTE: H JUDGMENT: J"
    df = spark.createDataFrame([(t,), ("abcdef",), (None,)], "t string")
    r = df.select(legal.sections(F.col("t")).alias("s"), legal.fact_and_issue(F.col("t")).alias("f")).collect()
    assert r[0].s == {"PREAMBLE": "Top ", "PETITIONER": "A.", "ACT": "two", "HEADNOTE": "H", "JUDGMENT": "J"}
    assert tuple(r[0].f) == ("J", "H two") and tuple(r[1].f) == ("abc", "def") and tuple(r[2].f) == ("", "")


def test_text_functions(spark):
    df = spark.createDataFrame([("Ab1 the cd-2xy. A <CITATION_4> here. Fine!",)], "t string")
    r = df.select(T.alnum_tokens(F.col("t"), 3, ("the",)).alias("a"), T.without_citation_sentences(F.col("t")).alias("s"), minhash.shingles(F.col("t"), 4, kind="char").alias("c")).first()
    assert r.a == ["ab1", "2xy", "citation", "here", "fine"] and r.s == "Ab1 the cd-2xy. Fine!"
    assert len(r.c) > 10 and all(len(x) == 4 for x in r.c)


def test_runs_of_blanks_and_many_matches(spark):
    """A million blanks and a hundred thousand matches in one text take seconds, and places stay right."""
    blanks = " " * 1_000_000
    texts = [f"section 5{blanks}of nothing", f"1998 scc{blanks}x", f"art.{blanks}", f"s. 12{blanks}(", f"order xx{blanks}rule", f"PETITIONER: a{blanks}b RESPONDENT: c{blanks}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(6)
    assert len(df.select(legal.statutes(F.col("t")), legal.concepts(F.col("t")), F.size(legal.sections(F.col("t"))), *(F.size(legal._all(F.col("t"), p)) for p in legal.REPORTERS)).collect()) == 6
    assert legal.linear(legal.SECTION_OF) != legal.SECTION_OF
    many = spark.createDataFrame([("pay 12 km, " * 100_000,)], "t string").select(F.explode(records.records("distance", F.col("t"))).alias("r"))
    assert many.agg(F.count("r"), F.max("r.start"), F.sum("r.start")).first()[:] == (100_000, 99_999 * 11 + 4, sum(11 * i + 4 for i in range(100_000)))


def test_linear_patterns_match_alike():
    import random
    import re

    rng = random.Random(7)
    parts = ["section", "sec.", "s.", " ", "  ", "12", "4A", " and ", ",", "or", "of the ", "of ", "Income Tax Act", "(2)", "art.", "Article", "order", "XX", "rule", "IPC", "scc", "1998", "air", "sc"]
    for p in (legal.SECTION_OF, legal.ARTICLE_OF, legal.ORDER_RULE, legal.SECTION_SHORT, *legal.CONCEPTS, *legal.REPORTERS):
        for _ in range(400):
            t = "".join(rng.choice(parts) for _ in range(12))
            assert [m.span() for m in re.finditer(p, t)] == [m.span() for m in re.finditer(legal.linear(p), t)], (p, t)
