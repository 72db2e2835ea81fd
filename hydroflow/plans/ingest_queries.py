"""Queries for ingest and sinks (S1-S9, F13), lookups (P12) and lags on series with gaps.

The file queries write a given table under the session's shared folder through the library's sinks and read it
back through its sources, so the oracle is the table itself."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import clean
from ..operators import features, joins, resample
from ..session import ensure_checkpoint_dir
from ..sources import files
from ..sources.tables import load
from .queries import RAIN_SCALE, D, R, register, rounded


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_ORDERS = ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
_ORDERS_DDL = "o_orderkey long, o_orderpriority string, o_orderstatus string, o_totalprice double"


@register("csv_round_trip", f"SELECT o_orderkey, o_orderpriority, o_orderstatus, {R('o_totalprice', 'o_totalprice')} FROM orders")
def q_csv_round_trip(spark, sf_dir):
    """S1 + S6 + S7: orders to CSV with a header and back with an explicit schema, found by the read-if-exists reader."""
    path = _folder(spark, "csv")
    o = load(spark, sf_dir, "orders", _ORDERS)
    files.write_table(o, path, fmt="csv")
    return rounded(files.read_if_exists(spark, path, lambda p: files.read_csv(spark, p, _ORDERS_DDL), lambda: o.limit(0)))


@register("headerless_chunks", """
WITH c AS (SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders)
SELECT CAST(chunk AS INTEGER) AS chunk, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM c GROUP BY chunk""")
def q_headerless_chunks(spark, sf_dir):
    """S5 + S8: orders in numbered files of 1,000 rows without a header, read back by position."""
    path = _folder(spark, "chunks")
    files.write_chunked(load(spark, sf_dir, "orders", _ORDERS), path, "o_orderkey", 1000)
    back = files.read_csv(spark, path, _ORDERS_DDL + ", chunk int", header=False)
    return back.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@register("union_with_provenance", f"""
SELECT 'o_orderstatus=' || o_orderstatus AS folder, CAST(count(*) AS BIGINT) AS n, {R('sum(o_totalprice * 0.001)', 'total')}, TRUE AS listed
FROM orders GROUP BY 1""")
def q_union_with_provenance(spark, sf_dir):
    """S2 + S7 + S9: a partitioned sink, its files listed, and one scan over all of them that keeps each row's file."""
    path = _folder(spark, "parts")
    files.write_table(load(spark, sf_dir, "orders", _ORDERS), path, ["o_orderstatus"], fmt="csv")
    folder = lambda c: F.try_element_at(F.split(c, "/"), F.lit(-2))
    listed = files.list_files(spark, path, "*.csv", prefix="part-").where("length > 0").select(folder("path").alias("folder")).distinct()
    rows = files.read_csv(spark, f"{path}/*", "o_orderkey long, o_orderpriority string, o_totalprice double", with_path=True)
    per = rows.groupBy(folder("file_path").alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice") * 0.001).alias("total"))
    return rounded(per.join(listed.withColumn("listed", F.lit(True)), "folder", "left"))


_FILE_SQL = """concat(replace(n_name, '_', ' '), ' +', '_', c_mktsegment, '-M1_', CASE WHEN c_acctbal < 0 THEN 'hist' ELSE 'ssp245' END, '_adjusted_1960_2014.csv')"""


@register("file_name_metadata", f"""
SELECT replace(n_name, '_', '') || '+' AS gauge, c_mktsegment || '-M1' AS gcm, CASE WHEN c_acctbal < 0 THEN 'historical' ELSE 'ssp245' END AS experiment,
  CAST(count(*) AS BIGINT) AS n, {R('sum(c_acctbal * 0.001)', 'total')}
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def q_file_name_metadata(spark, sf_dir):
    """S3: customers written under climate file names (with blanks and plus signs), read back, and gauge, model and experiment taken from
    the path of each row's file."""
    c, n = load(spark, sf_dir, "customer", ["c_nationkey", "c_mktsegment", "c_acctbal"]), load(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.expr(_FILE_SQL).alias("name"), "c_acctbal")
    path = _folder(spark, "named")
    files.write_table(rows, path, ["name"], fmt="csv")
    back = files.read_csv(spark, f"{path}/*", "c_acctbal double", with_path=True)
    name = F.regexp_replace(F.regexp_replace("file_path", "/[^/]*$", ""), "/name=", "/")
    got = back.select("c_acctbal", *[c.alias(k) for k, c in files.climate_file_metadata(name).items()])
    return rounded(got.groupBy("gauge", "gcm", "experiment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal") * 0.001).alias("total")))


@register("url_parts", """
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', '') AS path FROM pages""")
def q_url_parts(spark, sf_dir):
    """host and path of every page's address."""
    u = F.col("url")
    return load(spark, sf_dir, "pages", ["page_id", "url"]).select(
        "page_id", F.regexp_extract(u, "^https?://([^/?#]+)", 1).alias("host"),
        F.regexp_replace(F.regexp_replace(u, "^https?://[^/]+", ""), "[?#].*$", "").alias("path"))


@register("lookup_by_substring", """
WITH t AS (SELECT n_nationkey, n_name, CAST(n_nationkey + 1 AS VARCHAR) AS tag FROM nation),
c AS (SELECT s_suppkey, min(n_nationkey) AS k FROM supplier JOIN t ON contains(s_name, tag) GROUP BY s_suppkey)
SELECT c.s_suppkey, t.n_name FROM c JOIN t ON c.k = t.n_nationkey""")
def q_lookup_by_substring(spark, sf_dir):
    """The first listing entry whose tag occurs in the name; names without one are skipped."""
    t = load(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).withColumn("tag", (F.col("n_nationkey") + 1).cast("string"))
    s = load(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
    return clean.lookup_by_substring(s, "s_name", t, "tag", "n_nationkey").select("s_suppkey", "n_name")


_PREFIXES = {"NATION_0": ("PCD A", "PCD B"), "NATION_3": ("PCD C",)}
_SUFFIXES = ("ABI", "CUR")


@register("scoring_jobs", f"""
WITH p(n_name, prefix) AS (VALUES {', '.join(f"('{g}', '{p}')" for g, ps in _PREFIXES.items() for p in ps)}),
s(suffix) AS (VALUES {', '.join(f"('{x}')" for x in _SUFFIXES)})
SELECT c.c_custkey, p.prefix || ' ' || s.suffix AS job
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN p ON p.n_name = n.n_name, s""")
def q_scoring_jobs(spark, sf_dir):
    """Files (customers stand in) x the prefixes of their gauge (nation) x suffixes."""
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    n = load(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    return joins.scoring_jobs(c.join(n, c["c_nationkey"] == n["n_nationkey"]), "n_name", _PREFIXES, _SUFFIXES).select("c_custkey", "job")


def _lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER w"


def _ffbf(x: str) -> str:
    return (f"coalesce({x}, last_value({x} IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({x} IGNORE NULLS) OVER (PARTITION BY site ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")


@register("lags_gapped_series", f"""
WITH g AS (SELECT event_type || ':' || user_id AS site, date_trunc('hour', ts) AS ts, sum(value) * {D(RAIN_SCALE)} AS Rainfall, CAST(count(*) AS DOUBLE) AS temp
  FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
l AS (SELECT site, ts, {_lag('Rainfall', 3)} AS r3, {_lag('temp', 1)} AS t1, {_lag('temp', 24)} AS t24 FROM g WINDOW w AS (PARTITION BY site ORDER BY ts))
SELECT site, ts, {R(_ffbf('r3'), 'Rainlag3')}, {R(_ffbf('t1'), '"temp lag1"')}, {R(_ffbf('t24'), '"temp lag24"')} FROM l""")
def q_lags_gapped_series(spark, sf_dir):
    """W2 on hourly sums without gap fill of every (event type, user), which read in few hours only: lags go by row."""
    e = load(spark, sf_dir, "events", ["event_type", "user_id", "ts", "value"])
    e = e.select(F.concat_ws(":", "event_type", "user_id").alias("site"), "ts", "value")
    g = (resample.hourly_sum_no_gap(e.where(F.col("ts").isNotNull()), ["site"], "ts", ["value"], RAIN_SCALE, "n")
         .withColumnRenamed("value", "Rainfall").withColumn("temp", F.col("n").cast("double")))
    out = features.add_lag_features(g, ["site"], "ts")
    return rounded(out.select("site", "ts", "Rainlag3", "temp lag1", "temp lag24"))
