"""The store's tables, derived from the driver's test tables, and its paths in a blob backend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blob_path(digest: Column) -> Column:
    """Two levels of fan-out by the digest's first four digits."""
    return F.concat_ws("/", F.lit("blobs"), F.substring(digest, 1, 2), F.substring(digest, 3, 2), digest)


def staging_path(upload: Column) -> Column:
    return F.concat(F.lit("staging/"), upload)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ns, key, hash, size): documents as objects. Real duplicates make deduplication matter."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("ns-"), "source").alias("ns"),
        F.concat_ws("/", "lang", (F.col("doc_id") % 10).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("key"),
        F.sha2("text", 256).alias("hash"),
        F.octet_length("text").cast("long").alias("size"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ns, key, content): the bytes of the same objects."""
    d = load(spark, sf_dir, "documents")
    key = F.concat_ws("/", "lang", (F.col("doc_id") % 10).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select(F.concat(F.lit("ns-"), "source").alias("ns"), key.alias("key"), F.col("text").cast("binary").alias("content"))


def page_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ns, key, hash, size): pages as objects, by host and path."""
    p, parts = load(spark, sf_dir, "pages"), r"^https?://([^/]+)/([^?#]*)"
    return p.select(
        F.regexp_extract("url", parts, 1).alias("ns"), F.regexp_extract("url", parts, 2).alias("key"),
        F.sha2("html", 256).alias("hash"), F.octet_length("html").cast("long").alias("size"),
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts, ns, key, op, hash, size): an ordered log of puts, deletes and reads. Order is by seq, never by client time."""
    e = load(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "read").otherwise("put")
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts"), F.concat(F.lit("ns-"), (F.col("user_id") % 5).cast("string")).alias("ns"),
        F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"), F.lit("/k"), (k % 10).cast("string")).alias("key"), op.alias("op"),
        F.sha2((F.col("event_id") % 997).cast("string"), 256).alias("hash"), ((F.col("event_id") % 997) * 100).alias("size"),
    )


_EPOCH = "timestamp_ntz '2024-01-01 00:00:00'"


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ns, key, created_at): an upload for each conversation, an hour apart."""
    c = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.select(
        F.col("conv_id").alias("id"), F.concat(F.lit("ns-"), (F.col("conv_id") % 5).cast("string")).alias("ns"),
        F.concat(F.lit("up/"), (F.col("conv_id") % 7).cast("string"), F.lit("/"), F.col("conv_id").cast("string")).alias("key"),
        F.expr(f"{_EPOCH} + make_dt_interval(0, cast(conv_id as int))").alias("created_at"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(upload_id, part_number, content, etag, size, created_at): the turns of each conversation."""
    return load(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("upload_id"), (F.col("turn") + 1).cast("int").alias("part_number"), F.col("text").alias("content"),
        F.sha2("text", 256).alias("etag"), F.octet_length("text").cast("long").alias("size"),
        F.expr(f"{_EPOCH} + make_dt_interval(0, cast(conv_id + turn as int))").alias("created_at"),
    )


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))


def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, tenant_id): every seventh is owned by nobody, and so invisible to members."""
    n = load(spark, sf_dir, "nation")
    owner = F.when(F.col("n_nationkey") % 7 != 0, F.col("n_regionkey").cast("long"))
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("name"), owner.alias("tenant_id"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tenant_id, email, role): customers. The last tenant has members only."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    role = F.when((F.col("c_custkey") % 50 == 0) & (F.col("n_regionkey") != 4), "owner").otherwise("member")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").cast("long").alias("tenant_id"), F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit("@example.com")).alias("email"), role.alias("role")
    )


def nation_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(namespace_id, key, hash, size): documents spread over the namespaces by id."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        (F.col("doc_id") % 25).alias("namespace_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("key"),
        F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("size"),
    )


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of the files under a folder, without their bytes. Files that hold none are left out, as Spark's readers pass them by."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


#: Schemes that the blob backends go by; credentials and endpoints are Hadoop settings of the session.
BACKENDS = {"fs": "file://{root}", "s3": "s3a://{bucket}/{root}", "gcs": "gs://{bucket}/{root}", "azblob": "abfss://{container}@{account}.dfs.core.windows.net/{root}"}


def backend_root(kind: str, **names: str) -> str:
    """The root address of a backend. An unknown kind, or a missing name, is an error."""
    if kind not in BACKENDS:
        raise ValueError(f"unknown backend {kind!r}: one of {', '.join(BACKENDS)}")
    try:
        return BACKENDS[kind].format(**{"root": ""} | names).rstrip("/")
    except KeyError as e:
        raise ValueError(f"backend {kind} needs {e.args[0]}") from None


def write_new_blobs(contents: DataFrame, existing: DataFrame, path: str) -> None:
    """contents(hash, content), each hash once and only if it is not in existing(hash), written by first digits of the hash."""
    new = contents.dropDuplicates(["hash"]).join(existing, "hash", "left_anti")
    new.withColumn("prefix", F.substring("hash", 1, 2)).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)
