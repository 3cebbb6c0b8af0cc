"""Literal rows as a local relation, so Catalyst knows their exact size."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """DataFrame over literal rows; its size is known to the optimizer."""
    struct = StructType.fromDDL(schema)
    records = [dict(zip(struct.fieldNames(), row, strict=True)) for row in rows]
    table = pa.Table.from_pylist(records, schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, struct)
