"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroflow.session import cut_lineage, ensure_checkpoint_dir, ship_package

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: DuckDB expression for the CRC-32 of an ASCII string (reflected polynomial 0xEDB88320).
CRC32_SQL = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda a, b: list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table through Spark's reader (any file system), pruned to ``columns``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have (case-insensitive), for work columns."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> list[Column]:
    """All columns of ``df`` but those named (case-insensitive)."""
    drop = {n.lower() for n in names}
    return [quoted(c) for c in df.columns if c.lower() not in drop]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared checkpoint folder and read it back:
    a lineage cut that survives lost executors, stays compressed, and prunes columns."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_ids(df: DataFrame, rid: str) -> DataFrame:
    """``df`` stored with a unique, stable row number: rows whose ids repeat or are null can be told
    apart, and every later pass sees the same numbers."""
    return stored(df.withColumn(rid, F.monotonically_increasing_id()))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (small tables: links, labels)."""
    return cut_lineage(df)


def remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def own_shuffle(key: str) -> Column:
    """A long key whose value is the same but which Spark takes for a new expression. An aggregate's result
    joined on it gets a shuffle of its own, so that the adaptive skew join can split hot keys of the other
    side (it cannot where the aggregate and the join share one)."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))


def first_rank(id_col: str, rid: str) -> Column:
    """Order of rows for 'smallest id': nulls last, row number breaks ties. Use with ``min``."""
    return F.struct(quoted(id_col).isNull().alias("no_id"), quoted(id_col).alias("id"), quoted(rid).alias("rid"))



def slices(batch, max_rows: int = 500, max_bytes: int = 8 << 20):
    """Cut an Arrow batch into pieces of about ``max_bytes`` so that work arrays stay small."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, min(max_rows, int(n * max_bytes / max(batch.nbytes, 1)) or 1))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package sent to the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def with_fields(schema: T.StructType, *fields: tuple[str, str | T.DataType]) -> T.StructType:
    """A copy of ``schema`` with more fields (name, type as DDL or object)."""
    return T.StructType([*schema.fields, *[T.StructField(n, T.DataType.fromDDL(k) if isinstance(k, str) else k) for n, k in fields]])
