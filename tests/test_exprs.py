"""Golden values for the shared expressions (FIXTURES.md section D)."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlight.functions import exprs
from ledgerlight.functions.stats import t_two_sided_p_col
from ledgerlight.operators.ranking import exact_quantiles, nearest_rank_percentiles, rank_in_groups


def test_sunday_week(spark):
    df = spark.createDataFrame([(dt.date(2000, 1, 1),), (dt.date(2000, 1, 2),), (dt.date(2001, 1, 7),)], "d date")
    got = [r[0] for r in df.select(exprs.sunday_week("d")).collect()]
    assert got == [0, 1, 1]


def test_sunday_week_matches_strftime(spark):
    days = spark.range(0, 3000).select(F.date_add(F.lit(dt.date(1999, 1, 1)), F.col("id").cast("int")).alias("d"))
    rows = days.select("d", exprs.sunday_week("d").alias("w")).collect()
    for r in rows:
        assert int(r["d"].strftime("%U")) == r["w"]


def test_rounding_modes(spark):
    r = spark.sql("select round(2.5d, 0) a, bround(2.5d, 0) b, round(0.125d, 2) c, bround(0.125d, 2) d").first()
    assert (r.a, r.b, r.c, r.d) == (3.0, 2.0, 0.13, 0.12)


def test_positional_similarity(spark):
    df = spark.createDataFrame([("abcd", "abxdz"), ("", ""), ("ABC", "abc")], "a string, b string")
    got = [r[0] for r in df.select(exprs.positional_similarity("a", "b")).collect()]
    assert got == [60.0, None, 100.0]


def test_engagement_score_band_arpu(spark):
    df = spark.createDataFrame([(10, 250, 300.0, 9.0)], "f long, e long, d double, days double")
    r = df.select(exprs.engagement_score(F.col("f"), F.col("e"), F.col("d"), F.col("days")).alias("s")) \
        .select("s", exprs.value_band(F.col("s")).alias("band"),
                exprs.potential_arpu(F.col("s"), F.lit(250)).alias("arpu")).first()
    assert r.s == 0.6 and r.band == "Medium" and r.arpu == 80 * 250


def test_nearest_rank(spark):
    df = spark.createDataFrame([("t", float(v)) for v in (1, 2, 3, 10)], "g string, v double")
    r = nearest_rank_percentiles(df, ["g"], "v", {"p25": .25, "p50": .5, "p75": .75}).first()
    assert (r.p25, r.p50, r.p75) == (2.0, 3.0, 10.0)


def test_interpolated_quantile(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "v double")
    r = exact_quantiles(df, [], "v", {"q66": .66, "med": .5}).first()
    assert abs(r.q66 - 2.98) < 1e-9 and r.med == 2.5


def test_percent_rank_three(spark):
    df = spark.createDataFrame([("x", 30.0), ("x", 20.0), ("x", 10.0)], "t string, v double")
    rows = rank_in_groups(df, ["t"], "v", pct_col="pr").orderBy("rank").collect()
    assert [r.pr * 100 for r in rows] == [0.0, 50.0, 100.0]


def test_t_test_p_value(spark):
    # group a 0,0,1,1; b 1,1,1,0: t = -.6547 with 6 degrees of freedom
    want = [(-0.6547, 6.0, 0.5369), (2.447, 6.0, 0.05), (2.228, 10.0, 0.05), (12.706, 1.0, 0.05)]
    got = spark.createDataFrame(want, "t double, df double, p double").select(t_two_sided_p_col(F.col("t"), F.col("df")), "p").collect()
    assert all(abs(found - p) < 1e-3 for found, p in got)
