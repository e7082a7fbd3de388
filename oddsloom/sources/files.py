"""Reading observation files and writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom import schemas


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """JSON files, each one array of observations."""
    files = spark.read.option("wholetext", "true").text(path)
    rows = files.select(F.explode(F.from_json("value", schemas.OBSERVATION)).alias("r"))
    return rows.select("r.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns go out as JSON text."""
    flat = [
        F.to_json(name).alias(name) if field.dataType.typeName() in ("struct", "array", "map") else F.col(name)
        for name, field in zip(df.columns, df.schema)
    ]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)
