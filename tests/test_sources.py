import os
import tempfile

from pyspark.sql import functions as F

from hydroflow.sources import files


def _dir():
    return tempfile.mkdtemp(prefix="hf-src-")


def test_csv_roundtrip_listing_and_metadata(spark):
    d = _dir()
    names = ["Birch Lane_ACCESS-CM2_ssp245_adjusted_2015_2100.csv", "BirchLane_ACCESS-CM2_hist_adjusted_1960_2014.csv",
             "notes.txt"]
    for n in names:
        with open(os.path.join(d, n), "w") as f:
            f.write("time,0\n2020-01-01 00:00:00,1.5\n2020-01-01 00:05:00,bad\n")
    lst = files.list_files(spark, d, glob="*.csv", contains="adjusted").toPandas()
    assert sorted(lst.file_name) == sorted(names[:2])
    df = files.read_csv(spark, os.path.join(d, "*.csv"), "time string, v double", with_path=True)
    meta = df.withColumns(files.climate_file_metadata(F.col("file_path")))
    got = {(r.gauge, r.gcm, r.experiment) for r in meta.select("gauge", "gcm", "experiment").collect()}
    assert got == {("BirchLane", "ACCESS-CM2", "ssp245"), ("BirchLane", "ACCESS-CM2", "historical")}
    assert df.where(F.col("v").isNull()).count() == 2  # "bad" coerced to NULL


def test_temperature_and_ablation_names(spark):
    df = spark.createDataFrame([("/x/tas_ACCESS-CM2_day_Silverstream Stream.csv",), ("/r/ablation_Upper_Hutt_CUR.csv",),
                                ("/r/ablation_solo.csv",)], "p string")
    t = df.select(*[v.alias(k) for k, v in files.temperature_file_metadata(F.col("p")).items()]).first()
    assert (t.gcm, t.kind, t.site) == ("ACCESS-CM2", "day", "silverstream")
    a = df.select(*[v.alias(k) for k, v in files.ablation_file_metadata(F.col("p")).items()]).collect()
    assert (a[1].site, a[1].scenario) == ("Upper_Hutt", "CUR")
    assert (a[2].site, a[2].scenario) == ("solo", "unknown")


def test_ragged_header(spark):
    d = _dir()
    p = os.path.join(d, "flow.csv")
    header = [f"name{i}" for i in range(5)] + ["Site A wet weather", "Site A dry", "Site B wet weather"]
    with open(p, "w") as f:
        for h in header:
            f.write(h + ",,\n")
        f.write("hour,day_num,a,b,c\n")
        for i in range(30):
            f.write(f"{i % 24},{i // 24},{i * 0.5},{i},{i * 2}\n")
    df = files.read_ragged(spark, p, header_rows=8, names_used=3).orderBy("line")
    assert df.columns == ["line", "hour", "day_num", "Site A wet weather", "Site B wet weather"]
    rows = df.collect()
    assert len(rows) == 30 and rows[3]["Site B wet weather"] == 6.0


def test_sinks_and_read_if_exists(spark):
    d = _dir()
    df = spark.range(0, 12000).withColumn("site", (F.col("id") % 3).cast("string"))
    files.write_table(df, os.path.join(d, "t"), ["site"])
    assert spark.read.parquet(os.path.join(d, "t")).count() == 12000
    files.write_chunked(df.repartition(7), os.path.join(d, "c"), "id", 5000)
    back = files.read_csv(spark, os.path.join(d, "c"), "id long, site string, chunk int", header=False)
    got = {r.chunk: (r.n, r.lo, r.hi) for r in back.groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    assert got == {0: (5000, 0, 4999), 1: (5000, 5000, 9999), 2: (2000, 10000, 11999)}
    got = files.read_if_exists(spark, os.path.join(d, "missing"), spark.read.parquet, lambda: spark.range(1))
    assert got.count() == 1


def test_synthetic_generator(spark):
    s = files.synthetic_hourly(spark, days=90)
    pdf = s.toPandas()
    assert len(pdf) == 90 * 24
    share = (pdf.Rainfall > 0).mean()
    assert 0.05 < share < 0.15
    assert abs(pdf.Rainfall[pdf.Rainfall > 0].mean() - 3.0) < 0.8  # gamma(1.5, 2) mean 3
