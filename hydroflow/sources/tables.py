"""Parquet table sources (the driver's test tables) with explicit column lists for pruning."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def sensor_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a raw rain feed: site = event_type, raw reading = value."""
    return load(spark, sf_dir, "events", ["event_type", "ts", "value"]).withColumnRenamed("event_type", "site")
