"""Result tables on shared storage.

Metric and statistics bundles are ordinary DataFrames written as JSON or
parquet; a missing path reads as an empty frame with the expected schema, and
unreadable JSON lines are dropped via PERMISSIVE mode's ``_corrupt_record``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def save_table(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a result table (overwrite) as JSON or parquet."""
    df.write.mode("overwrite").format(fmt).save(path)


def load_table(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json") -> DataFrame:
    """Read a saved table; absent -> empty frame; corrupt JSON lines are skipped."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if fmt != "json":
        return spark.read.schema(schema).format(fmt).load(path)
    with_corrupt = StructType(list(schema.fields) + [StructField("_corrupt_record", StringType())])
    df = spark.read.schema(with_corrupt).option("mode", "PERMISSIVE").json(path)
    return df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def export_per_case(cases: DataFrame, path: str, key: str = "case_id") -> None:
    """A10: one JSON document folder per case (``partitionBy``), written in parallel."""
    cases.write.mode("overwrite").partitionBy(key).json(path)


def load_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A10: multi-line JSON documents (an array of records or one per file)."""
    if isinstance(schema, str):
        schema = spark.createDataFrame([], schema).schema
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)
