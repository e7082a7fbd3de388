"""Raw payload archive: exact bytes, content hash, redacted headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Headers that never reach storage.
SECRET_HEADERS = ("set-cookie", "cookie", "authorization", "proxy-authorization")


def redacted(headers: Column) -> Column:
    return F.map_filter(headers, lambda name, _: ~F.lower(name).isin(*SECRET_HEADERS))


def archived(payloads: DataFrame) -> DataFrame:
    """Payload rows ready to append: hash, size, date, no secrets."""
    out = payloads.withColumns(
        {
            "content_sha256": F.sha2("body", 256),
            "size_bytes": F.octet_length("body"),
            "received_date": F.to_date("received_at"),
        }
    )
    if "headers" in payloads.columns:
        out = out.withColumn("headers", redacted(F.col("headers")))
    return out


def append(payloads: DataFrame, path: str) -> None:
    """Append to the archive; a payload is written once and never rewritten."""
    archived(payloads).write.mode("append").partitionBy("provider", "received_date").parquet(path)


def read_files(spark: SparkSession, path: str, provider: str, kind: str) -> DataFrame:
    """Whole files as payloads; the modification time stands for the receipt."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.lit(provider).alias("provider"), F.lit(kind).alias("kind"), F.col("path").alias("url"),
        F.col("modificationTime").alias("received_at"), F.col("content").alias("body"),
    )


def text(body: Column) -> Column:
    return F.decode(body, "UTF-8")


def first_copies(payloads: DataFrame) -> DataFrame:
    """One row per distinct content: the first receipt, and how often it came.

    An aggregate by hash: copies combine on the map side, so any share of
    identical payloads reduces to one row per task before the shuffle.
    """
    hashed = payloads if "content_sha256" in payloads.columns else archived(payloads)
    keep = [name for name in hashed.columns if name not in ("content_sha256", "body")]
    return hashed.groupBy("content_sha256").agg(
        F.min(F.struct("received_at", *[name for name in keep if name != "received_at" and name != "headers"])).alias("f"),
        F.count("*").alias("copies"),
    ).select("content_sha256", "copies", "f.*")
