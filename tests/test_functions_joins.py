import datetime as dt

from pyspark.sql import functions as F

from hydroflow.functions import calendar as cal
from hydroflow.functions import clean
from hydroflow.operators import joins


def test_parse_and_coerce(spark):
    df = spark.createDataFrame([("2019-05-01 13:45:10", "1.5"), ("01/05/2019 13:45:10", "x"),
                                ("01/05/2019 13:45", "NaN"), ("garbage", None)], "t string, v string")
    out = df.select(clean.parse_ts("t").alias("ts"), clean.to_number("v").alias("v")).collect()
    assert [r.ts for r in out] == [dt.datetime(2019, 5, 1, 13, 45, 10), dt.datetime(2019, 5, 1, 13, 45, 10),
                                   dt.datetime(2019, 5, 1, 13, 45), None]
    assert [r.v for r in out] == [1.5, None, None, None]


def test_units_names_lookups(spark):
    df = spark.createDataFrame([("PCD Upper Hutt wet weather flow ABI x", 300.0, "Birch Lane gauge"),
                                ("PCD Stokes Valley wet", 273.0, "nothing")], "name string, k double, g string")
    r = df.select(clean.job_name("name").alias("j"), clean.kelvin_to_celsius("k").alias("c"),
                  clean.per_5min_rate_to_mm(F.lit(12.0)).alias("mm")).collect()
    assert r[0].j == "PCD Upper Hutt ABI" and r[1].j == "PCD Stokes Valley CUR"
    assert r[0].c == 27.0 and r[0].mm == 1.0
    m = clean.lookup(df, "name", {"PCD Stokes Valley wet": "Pinehaven"}, "gauge").collect()
    assert [x.gauge for x in m] == [None, "Pinehaven"]
    tbl = spark.createDataFrame([("Birch Lane",)], "key string")
    assert clean.lookup_by_substring(df, "g", tbl, "key").count() == 1
    many = spark.createDataFrame([(3, "Birch"), (1, "Lane"), (2, "gauge"), (0, "absent"), (0, "")], "rank int, key string")
    got = clean.lookup_by_substring(df, "g", many, "key", "rank").collect()
    assert [(r.g, r.key) for r in got] == [("Birch Lane gauge", "Lane")]
    assert clean.lookup_by_substring(df, "g", many.limit(0), "key").count() == 0
    assert clean.model_matrix(df.withColumn("Time", F.lit(1)), "k") == ["name", "g"]


def test_first_match_and_jobs(spark):
    left = spark.createDataFrame([(1, "k", "abc"), (2, "k", "zzz")], "id int, g string, s string")
    right = spark.createDataFrame([("k", 5, "b", "late"), ("k", 2, "c", "first"), ("k", 1, "q", "no")], "g string, o int, tag string, v string")
    got = {r.id: (r.match_o, r.match_v) for r in joins.first_match(left, right, ["g"], F.col("s").contains(F.col("tag")), "o", "id").collect()}
    assert got == {1: (2, "first"), 2: (None, None)}
    files = spark.createDataFrame([("f1", "A"), ("f2", "B"), ("f3", "none")], "f string, gauge string")
    jobs = joins.scoring_jobs(files, "gauge", {"A": ["x", "y"], "B": ["z"]}, ["1", "2"])
    assert sorted((r.f, r.job) for r in jobs.collect()) == [("f1", "x 1"), ("f1", "x 2"), ("f1", "y 1"), ("f1", "y 2"), ("f2", "z 1"), ("f2", "z 2")]


def test_calendar_and_filters(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 2, 29, 5, 30),), (dt.datetime(2021, 12, 31, 23, 0),)],
                               "ts timestamp_ntz")
    r = df.select(cal.days_in_month("ts").alias("mday"), cal.weekday_mon0("ts").alias("wd"),
                  cal.season("ts").alias("s"), cal.is_leap_day("ts").alias("leap"),
                  cal.trunc_hour("ts").alias("h"), clean.in_years_months("ts", [2020], [2]).alias("keep")).collect()
    assert [x.mday for x in r] == [29, 31] and [x.wd for x in r] == [5, 4]
    assert [x.s for x in r] == ["Summer", "Summer"] and [x.leap for x in r] == [True, False]
    assert r[0].h == dt.datetime(2020, 2, 29, 5) and [x.keep for x in r] == [True, False]
    w = spark.createDataFrame([("a b  a\tc ",)], "t string").select(*[v.alias(k) for k, v in clean.word_stats("t").items()])
    assert tuple(w.first()) == (4, 3)


def test_bind_by_position(spark):
    left = spark.createDataFrame([("s", i * 2) for i in range(30)], "k string, t long")
    right = spark.createDataFrame([("s", 1000 - i) for i in range(30)], "k string, u long")
    b = joins.bind_by_position(left, right, ["k"], "t", "u", F.floor(F.col("t") / 10), F.floor(F.col("u") / 7))
    rows = sorted((r.t, r.u) for r in b.collect())
    assert rows == [(i * 2, 1000 - 29 + i) for i in range(30)]
