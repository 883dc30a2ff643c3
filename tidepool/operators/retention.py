"""Retention: what may be deleted as of a given time. Times are parameters, so results do not depend on the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _before(as_of: Column, seconds: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def collectable(blobs: DataFrame, as_of: Column, grace: int = 300, limit: int = 1000) -> DataFrame:
    """blobs(hash, refcount, updated_at) without references and untouched for more than the grace, oldest first."""
    return blobs.where((F.col("refcount") == 0) & (F.col("updated_at") < _before(as_of, grace))).orderBy("updated_at", "hash").limit(limit)


def abandoned(uploads: DataFrame, parts: DataFrame, as_of: Column, expiry: int = 86_400) -> DataFrame:
    """Uploads that began before the expiry and got no part within it."""
    recent = parts.where(F.col("created_at") >= _before(as_of, expiry)).select(F.col("upload_id").alias("id"))
    return uploads.where(F.col("created_at") < _before(as_of, expiry)).join(recent, "id", "left_anti")


def orphans(files: DataFrame, parts: DataFrame, as_of: Column, grace: int = 300) -> DataFrame:
    """Staged files(path, modified) that are old enough (equal counts), dated, and in no part(staging_key)."""
    old = files.where(F.col("modified") <= _before(as_of, grace))
    return old.join(parts.select(F.col("staging_key").alias("path")), "path", "left_anti")


def swept(blobs: DataFrame, uploads: DataFrame, parts: DataFrame) -> DataFrame:
    """One row of what a sweep removes: blobs of collectable(), uploads(id) of abandoned(), and their parts(upload_id)."""
    gone = parts.join(uploads.select(F.col("id").alias("upload_id")), "upload_id", "left_semi")
    count = lambda f, name: f.agg(F.count("*").alias(name))
    return count(blobs, "blobs").join(F.broadcast(count(uploads, "uploads"))).join(F.broadcast(count(gone, "parts")))  # a row each


def cascade(deleted: DataFrame, uploads: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads and parts that stay when the namespaces deleted(ns) go."""
    kept = uploads.join(deleted.select("ns"), "ns", "left_anti")
    return kept, parts.join(kept.select(F.col("id").alias("upload_id")), "upload_id", "left_semi")
