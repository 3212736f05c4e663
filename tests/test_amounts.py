"""Amounts and what is made of them, on literal texts with the values a reader expects."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import amounts

AMOUNTS = {
    "25,000.00 and 123,456,000": [25000, 123456000],
    "Seven Hundred Eighty": [780],
    "5 million or 2.55 BILLION or 5k": [5e6, 2.55e9, 5000],
    "twenty-fifth": [25],
    "1/33 and 25/100": [1 / 33 + 25 / 100],
    "twenty one AND 5/100": [21.05],
    "one-third": [1 / 3],
    "three tenths": [0.3],
    "ten ninety-ninths": [10 / 99],
    "twenty AND one-hundredths": [20 + 1 / 100],
    "2 hundred and one-thousandth": [200 + 1 / 1000],
    ".5 million": [5e5],
    "twenty-two DOZEN": [264],
    "Six and a HALF Billion": [6.5e9],
    "two and a half": [2.5],
    "two million and a half": [2.5e6],
    "five and one-quarter, three-quarters": [5.25, 0.75],
    "5 and one-quarter": [5.25],
    "$25,400, 1 million people and 3.5 tons": [25400, 1e6, 3.5],
    "1½ of apple": [1.5],
    "2 ⅗": [2.6],
    "see 5.3.1. and 1/1/2010 for more": [],
    "one hundred and twenty thousand three hundred and six": [120306],
    "hundred twelve": [112],
    "at an annual rate of 7.38%, the fifth anniversary, 200 basis points, five-year": [7.38, 5, 200, 5],
    "none and someone weigh often": [],
    "": [],
}
KINDS = {
    "percent": [("five percent, 5.5%, -2 percent, 25 basis points and one-half; two and a half percentage  points, (6) %", ["amount", "fraction", "unit"], [(5.0, 0.05, "percent"), (5.5, 0.055, "%"), (-2.0, -0.02, "percent"), (25.0, 0.0025, "basis points"), (2.5, 0.025, "percentage points"), (6.0, 0.06, "%")])],
    "money": [
        ("USD 500, 1,000 U.S. dollars, $1,250.50, € 3 million, 2 billion USD, five hundred dollars, CHF 20k, ten thousand chinese yuan", ["amount", "currency"], [(500.0, "USD"), (1000.0, "USD"), (1250.5, "USD"), (3e6, "EUR"), (2e9, "USD"), (500.0, "USD"), (20000.0, "CHF"), (1e4, "CNY")]),
        ("100 bucks, 100 dollars, 100 greens", ["amount", "currency"], [(100.0, "USD")]),
    ],
    "duration": [
        ("ten days, a 12-month term, ninety business days; one second; two quarters and the fifth anniversary", ["unit", "amount", "days"], [("day", 10.0, 10.0), ("month", 12.0, 360.0), ("day", 90.0, 90.0), ("second", 1.0, 0.0), ("quarter", 2.0, 182.5), ("anniversary", 5.0, 1825.0)]),
        ("for 5 years, 6 months and ten days; 2 days, 3 weeks", ["text", "days"], [("5 years, 6 months and ten days", 2015.0), ("2 days", 2.0), ("3 weeks", 21.0)]),
    ],
    "distance": [("seven and a half miles, 1,200.5 km or 3 kilometers", ["amount", "unit"], [(7.5, "mile"), (1200.5, "kilometer"), (3.0, "kilometer")])],
    "ratio": [("odds of three to one, 3:4, at 10:30 AM, 5 : 0, 1.5/2 and 10 to twenty", ["left", "right", "ratio"], [(3.0, 1.0, 3.0), (3.0, 4.0, 0.75), (1.5, 2.0, 0.75), (10.0, 20.0, 0.5)])],
}


def found(spark, kind, text):
    return spark.createDataFrame([(text,)], "t string").select(F.explode(amounts.records(kind, F.col("t"))).alias("r")).select("r.*").collect()


def test_amounts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(AMOUNTS)], "i int, t string").select("i", "t", amounts.records("amount", F.col("t")).alias("r"))
    for r in df.collect():
        assert [x.value for x in r.r] == pytest.approx(list(AMOUNTS.values())[r.i]), (r.t, r.r)
        assert all(r.t[x.start : x.end] == x.text for x in r.r)


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_kinds(spark, kind):
    for text, names, want in KINDS[kind]:
        rows = found(spark, kind, text)
        assert len(rows) == len(want), rows
        for r, w in zip(rows, want):
            for n, x in zip(names, w):
                assert r[n] == (pytest.approx(x, abs=1e-4) if isinstance(x, float) else x), rows
        assert all(text[r.start : r.end] == r.text for r in rows)
    assert found(spark, kind, None) == [] == found(spark, kind, "")
