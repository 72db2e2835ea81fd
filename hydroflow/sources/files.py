"""File sources and sinks of the reference (S1-S10) on Spark's readers and writers.

Object-store clients of the reference become Hadoop file-system paths; listing is a
distributed ``binaryFile`` scan that never reads file contents; metadata parsed from file
names uses the ``_metadata.file_path`` column, so multi-file reads keep their provenance.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocked import attach, dense_position
from ..session import cut_lineage


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
             header: bool = True, with_path: bool = False, infer: bool = False) -> DataFrame:
    """CSV scan with or without header. Types come from ``schema``; without one all columns are
    strings (``clean.to_number`` coerces), or ``infer`` spends a pass over the files on guessing.
    Malformed numbers become NULL (the reference's ``errors='coerce'``)."""
    r = spark.read.option("header", header).option("mode", "PERMISSIVE")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", infer)
    df = r.csv(path if isinstance(path, str) else list(path))
    if with_path:
        df = df.withColumn("file_path", plain_path(F.col("_metadata.file_path")))
    return df


def plain_path(path: Column) -> Column:
    """A file path as it is named: ``_metadata.file_path`` is percent-encoded (a blank is %20). A plus sign stands for itself."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, root: str, glob: str = "*", recursive: bool = True,
               contains: str | None = None, prefix: str | None = None) -> DataFrame:
    """Path, size and modification time of matching files (contents are not read)."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", recursive).load(root).select("path", "length", "modificationTime"))
    name = F.try_element_at(F.split("path", "/"), F.lit(-1))
    if contains:
        df = df.where(name.contains(contains))
    if prefix:
        df = df.where(name.startswith(prefix))
    return df.withColumn("file_name", name)


def climate_file_metadata(path: Column) -> dict[str, Column]:
    """S3: ``<gauge>_<gcm>_<ssp|hist>_adjusted_<from>_<to>.csv`` -> gauge, gcm, experiment;
    ``hist`` is spelled ``historical``, blanks in the gauge are dropped."""
    name = F.try_element_at(F.split(path, "/"), F.lit(-1))
    m = F.regexp_extract(name, r"^([^_]+)_(.+)_adjusted", 2)
    parts = F.split(m, "_")
    exp = F.try_element_at(parts, F.lit(-1))
    return {
        "gauge": F.regexp_replace(F.regexp_extract(name, r"^([^_]+)_", 1), " ", ""),
        "gcm": F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "_"),
        "experiment": F.when(exp == "hist", F.lit("historical")).otherwise(exp),
    }


def temperature_file_metadata(path: Column) -> dict[str, Column]:
    """S3: ``tas_<gcm>_<kind>_<gauge>Stream.csv`` -> gcm, kind, site (``Stream`` and blanks dropped)."""
    name = F.regexp_replace(F.try_element_at(F.split(path, "/"), F.lit(-1)), r"\.csv$", "")
    parts = F.split(name, "_")
    return {
        "gcm": F.try_element_at(parts, F.lit(2)),
        "kind": F.try_element_at(parts, F.lit(3)),
        "site": F.lower(F.trim(F.regexp_replace(F.try_element_at(parts, F.lit(-1)), "Stream", ""))),
    }


def ablation_file_metadata(path: Column) -> dict[str, Column]:
    """``ablation_<site>_<scenario>.csv`` -> site, scenario (``unknown`` when absent)."""
    base = F.regexp_replace(F.regexp_replace(F.try_element_at(F.split(path, "/"), F.lit(-1)), r"\.csv$", ""), "^ablation_", "")
    has = base.contains("_")
    return {"site": F.when(has, F.regexp_extract(base, r"^(.*)_[^_]*$", 1)).otherwise(base),
            "scenario": F.when(has, F.regexp_extract(base, r"_([^_]*)$", 1)).otherwise(F.lit("unknown"))}


def read_ragged(spark: SparkSession, path: str, header_rows: int = 12, names_used: int = 7,
                keep: str = "wet weather") -> DataFrame:
    """The flow export whose first ``header_rows`` lines name the columns. The last
    ``names_used`` header names label the value columns after ``hour`` and ``day_num``; only
    columns whose name contains ``keep`` are returned. Line numbers count the lines before a block of the file
    (one row per block) plus the place in the block; the header lines, all in the first block, are the only
    thing collected to the driver."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_blk"),
                                        F.monotonically_increasing_id().alias("_id"))
    header = [r.value for r in text.where("_blk = 0").orderBy("_id").limit(header_rows).collect()]
    lines = dense_position(text, [], "_id", F.col("_blk"), out="line")
    names = [h.split(",")[0].strip() for h in header][-names_used:]
    body = lines.where(F.col("line") >= header_rows + 1)
    parts = F.split("value", ",")
    cols = [F.try_element_at(parts, F.lit(1)).cast("int").alias("hour"), F.try_element_at(parts, F.lit(2)).cast("int").alias("day_num")]
    for i, n in enumerate(names):
        if keep in n:
            cols.append(F.try_element_at(parts, F.lit(3 + i)).try_cast("double").alias(n))
    return body.select("line", *cols)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                header: bool = True, mode: str = "overwrite") -> None:
    """Partitioned sink (parquet by default, CSV with/without header)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", header).csv(path)
    else:
        w.format(fmt).save(path)


def write_chunked(df: DataFrame, path: str, order: str, rows_per_file: int = 5000, fmt: str = "csv",
                  header: bool = False) -> None:
    """Numbered chunks of exactly ``rows_per_file`` rows in the order of ``order`` (the reference's 5,000 / 1,000-row
    files), each under ``chunk=<number>``. Rows are range-partitioned and sorted, so a row's number is its place in
    its partition plus the sizes of the partitions before (one row per partition)."""
    placed = cut_lineage(df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
                         .withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    row = F.col("_off") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = attach(placed.withColumn("_part", part), sizes, ["_part"]).withColumn("chunk", F.floor(row / F.lit(rows_per_file)))
    out = numbered.repartition("chunk").sortWithinPartitions("chunk", "_id").drop("_id", "_part", "_off")
    out.write.mode("overwrite").partitionBy("chunk").option("header", header).format(fmt).save(path)


def read_if_exists(spark: SparkSession, path: str, reader: Callable[[str], DataFrame],
                   fallback: Callable[[], DataFrame]) -> DataFrame:
    """Read an earlier result; fall back when the path does not exist."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return reader(path) if fs.exists(hpath) else fallback()


def synthetic_hourly(spark: SparkSession, days: int = 90, seed: int = 42, start: str = "2020-01-01 00:00:00",
                     partitions: int = 8) -> DataFrame:
    """Synthetic hourly series (sparse gamma(1.5, 2) rain with probability 0.1, seasonal
    temperature, linear inflow plus noise) for unit tests. The gamma draw is exact: a
    shape-1.5 gamma is the sum of an exponential and half a squared normal (scale 2)."""
    n = days * 24
    r = spark.range(0, n, numPartitions=partitions)
    u = F.rand(seed)
    gamma = (-F.log(F.lit(1.0) - F.rand(seed + 1)) + F.pow(F.randn(seed + 2), 2) / 2) * 2.0
    rain = F.when(u < 0.1, gamma).otherwise(F.lit(0.0))
    ts = F.timestamp_add("HOUR", F.col("id"), F.expr(f"TIMESTAMP_NTZ'{start}'"))
    temp = 15 + 8 * F.sin(F.lit(2 * 3.141592653589793) * F.col("id") / F.lit(24.0 * 365)) + F.randn(seed + 3)
    d = r.select(ts.alias("ts"), rain.alias("Rainfall"), temp.alias("temp"))
    return d.withColumn("inflow", 0.5 + 0.3 * F.col("Rainfall") + 0.02 * F.col("temp") + 0.1 * F.randn(seed + 4))
