"""Declared schemas, the table reader, and the export and manifest sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

# Column names and types of the given tables
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
EXPORT_DIGITS = 4


def declared(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def read_table(
    spark: SparkSession, folder: str, name: str, fmt: str = "parquet", schema: str | None = None
) -> DataFrame:
    """Read ``folder/name.<fmt>`` with a declared schema, never inferring one."""
    if schema is None and name not in SCHEMAS:
        raise ValueError(f"no declared schema for table {name!r}")
    reader = spark.read.schema(schema or declared(name))
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return reader.format(fmt).load(f"{folder}/{name}.{fmt}")


def canonical(df: DataFrame) -> DataFrame:
    """Fix the precision of floating-point columns for a stable export."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(
        *[F.round(c, EXPORT_DIGITS).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def export_canonical(df: DataFrame, keys: list[str], path: str) -> str:
    """Write CSV in key order.  The sort is a range partitioning, so part files
    are written in parallel and concatenate in order."""
    canonical(df).orderBy(*keys).write.mode("errorifexists").option("header", True).csv(path)
    return path


def manifest(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Row count and one measured total per table, one aggregate each."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(total), 2).alias("measured_total"))
        .select(F.lit(name).alias("table_name"), "rows", "measured_total")
        for name, (df, total) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
