"""Dates in literal texts, with the days a reader expects."""

import datetime

from pyspark.sql import functions as F

from docloom.functions import dates

D = datetime.date
TEXTS = {
    "No later than 2017-06-01.": [D(2017, 6, 1)],
    "Dated as of June 1, 2017": [D(2017, 6, 1)],
    "Will be completed by June 2017": [D(2017, 6, 1)],
    "Will be completed by June": [D(2000, 6, 1)],
    "Will be completed by the 1st day of June, 2017": [D(2017, 6, 1)],
    "by June 1st 2017, by 1 June 2017 and by 01-Jun-2017": [D(2017, 6, 1)] * 3,
    "Jan. 5, 2010; Sept 7, 2011; dec 24 2012": [D(2010, 1, 5), D(2011, 9, 7), D(2012, 12, 24)],
    "12/31/2018, 31/12/2018, 1/2/18 and 31.12.2018": [D(2018, 12, 31), D(2018, 12, 31), D(2018, 1, 2), D(2018, 12, 31)],
    "2018/06/01 or 2018-06-01T12:30:00Z": [D(2018, 6, 1)] * 2,
    "in the years 3/4/75 and 3/4/45, not 3/4/00": [D(1975, 3, 4), D(2045, 3, 4)],
    "on March 5 and the 7th of April": [D(2000, 3, 5), D(2000, 4, 7)],
    "It may be, we march, Mayor Marchand decided in section 7.7.10 may": [],
    "February 30, 2010, 13/13/2013, 2010-13-01": [],
    "45 of 100, 1 10, 3.14, 5/6, 1998": [],
    "continuing until July 18, 2002, in effect on January 23, 1998": [D(2002, 7, 18), D(1998, 1, 23)],
    "": [],
}


def test_dates(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(-1, None)], "i int, t string")
    for r in df.select("i", "t", dates.dates(F.col("t")).alias("r")).collect():
        assert [x.date for x in r.r] == (list(TEXTS.values())[r.i] if r.i >= 0 else []), (r.t, r.r)
        assert all(r.t[x.start : x.end] == x.text and x.until is None for x in r.r)


def test_ranges_and_parameters(spark):
    text = "from January 5-7, 2010, March 30 to April 2, 2011 and December 30 through January 2, 2012; 1/2/2018"
    r = spark.createDataFrame([(text,)], "t string").select(dates.dates(F.col("t"), day_first=True).alias("r")).first().r
    assert [(x.date, x.until) for x in r] == [(D(2010, 1, 5), D(2010, 1, 7)), (D(2011, 3, 30), D(2011, 4, 2)), (D(2011, 12, 30), D(2012, 1, 2)), (D(2018, 2, 1), None)]
    other = spark.createDataFrame([("by June 3",)], "t string").select(dates.dates(F.col("t"), base=D(2024, 5, 5)).alias("r")).first().r
    assert [x.date for x in other] == [D(2024, 6, 3)]
