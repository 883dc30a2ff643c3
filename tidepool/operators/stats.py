"""Storage statistics: logical bytes over objects, physical bytes over distinct blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def totals(objects: DataFrame, *by: str) -> DataFrame:
    """by, objects, logical, blobs, physical: blobs are those that the group's own objects refer to."""
    each = objects.groupBy(*by, "hash", "size").agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("objects"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("logical"),
        F.count("*").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("physical"),
    )


def ratio(logical: Column, physical: Column) -> Column:
    return F.when(physical > 0, logical / physical).otherwise(F.lit(1.0))


def dedup_percent(logical: Column, physical: Column) -> Column:
    """The share saved with one decimal; a dash where nothing is stored."""
    return F.when(logical > 0, F.format_string("%.1f%%", F.lit(100.0) * (logical - physical) / logical)).otherwise("—")


def with_savings(t: DataFrame) -> DataFrame:
    return t.withColumn("ratio", ratio(F.col("logical"), F.col("physical"))).withColumn("saved", F.col("logical") - F.col("physical"))


def by_namespace(namespaces: DataFrame, objects: DataFrame) -> DataFrame:
    """(id, name, objects, logical, namespaces) of every namespace(id, name), empty ones too, over objects(id, size); namespaces: how many there are."""
    own = objects.groupBy("id").agg(F.count("*").alias("objects"), F.sum("size").alias("logical"))
    all_ = namespaces.agg(F.count("*").alias("namespaces"))
    none = F.lit(0).cast("long")
    return namespaces.join(own, "id", "left").join(F.broadcast(all_)).select("id", "name", F.coalesce("objects", none).alias("objects"), F.coalesce("logical", none).alias("logical"), "namespaces")  # one row
