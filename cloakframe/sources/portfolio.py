"""Reading customer tables and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T



def read_portfolio(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV customer table with headers in row 1; every cell is text, a missing one ''.

    Pass ``columns`` where the headers are known: the read then needs no look at the files.
    """
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(name, T.StringType()) for name in columns]))
    return fill_missing(reader.csv(path))


def fill_missing(df: DataFrame) -> DataFrame:
    """Missing text cells become ''."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.na.fill("", subset=text)


def write_by_tier(df: DataFrame, path: str, order: str, fmt: str = "parquet") -> None:
    """The reorganised table, one folder per tier, in order inside each file."""
    ranged = df.withColumn("Risk Tier", F.col("tier")).repartitionByRange("tier", order)
    writer = ranged.sortWithinPartitions("tier", order).write.partitionBy("tier").mode("overwrite")
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)
