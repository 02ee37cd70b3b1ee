"""Text tables whose fields end in `|`, without header, quotes or escapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tbl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the file. A row that doesn't fit the schema is an error, never a null or a 0. An empty string stays one: such tables have no nulls."""
    whole = T.StructType([*schema.fields, T.StructField("_end", T.StringType())])  # what follows the last `|`
    rows = spark.read.schema(whole).option("sep", "|").option("quote", "").option("mode", "FAILFAST").csv(path)
    kept = lambda f: F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
    return rows.select(*map(kept, schema.fields))
