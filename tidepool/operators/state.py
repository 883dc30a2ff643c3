"""State as a fold over an ordered operation log: objects, references, and what each operation did."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def writes(ops: DataFrame) -> DataFrame:
    return ops.where(F.col("op").isin("put", "delete"))


def current(ops: DataFrame) -> DataFrame:
    """(ns, key, hash, size, seq, created_seq): the last put of each key that no delete follows; sums before the shuffle."""
    last = writes(ops).groupBy("ns", "key").agg(
        F.max_by(F.struct("op", "hash", "size", "seq"), "seq").alias("w"), F.coalesce(F.max(F.when(F.col("op") == "delete", F.col("seq"))), F.lit(-1)).alias("gone")
    )
    live = last.where("w.op = 'put'")
    puts = writes(ops).where("op = 'put'").select("ns", "key", F.col("seq").alias("s"))
    created = puts.join(live.select("ns", "key", "gone"), ["ns", "key"]).where("s > gone").groupBy("ns", "key").agg(F.min("s").alias("created_seq"))
    return live.join(created, ["ns", "key"]).select("ns", "key", "w.hash", "w.size", "w.seq", "created_seq")


def transitions(ops: DataFrame) -> DataFrame:
    """Each write with the hash that its key held before (null: none)."""
    before = F.lag(F.struct("op", "hash")).over(Window.partitionBy("ns", "key").orderBy("seq"))
    return writes(ops).withColumn("b", before).withColumn("released", F.when(F.col("b.op") == "put", F.col("b.hash"))).drop("b")


def refcounts(ops: DataFrame) -> DataFrame:
    """(hash, size, refcount, updated_seq): for every blob ever put, the objects that refer to it now and the last claim or release."""
    return touched(ops).select("hash", "size", "refcount", "updated_seq")


def touched(ops: DataFrame) -> DataFrame:
    """refcounts() with updated_at, where ops have ts. One scan: each write claims its blob, and for good if no write follows; it releases the one before."""
    own = Window.partitionBy("ns", "key").orderBy("seq")
    ts = F.col("ts") if "ts" in ops.columns else F.lit(None).cast("timestamp_ntz")
    w = writes(ops).withColumn("at", ts).withColumn("before", F.lag(F.when(F.col("op") == "put", F.col("hash"))).over(own)).withColumn("last", F.lead("seq").over(own).isNull())
    put = F.col("op") == "put"
    claim = F.when(put, F.struct("hash", "size", F.col("last").cast("long").alias("refs")))
    release = F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("hash"), F.lit(None).cast("long").alias("size"), F.lit(0).cast("long").alias("refs")))
    each = w.select("seq", "at", F.explode(F.array_compact(F.array(claim, release))).alias("c")).select("seq", "at", "c.*")
    out = each.groupBy("hash").agg(F.max("size").alias("size"), F.sum("refs").alias("refcount"), F.max(F.struct("seq", "at")).alias("u"))
    return out.select("hash", "size", "refcount", F.col("u.seq").alias("updated_seq"), F.col("u.at").alias("updated_at"))


def incremental_refcounts(ops: DataFrame) -> DataFrame:
    """(hash, refcount) as a sum of claims and releases: what a store that counts as it goes would hold."""
    t = transitions(ops)
    changes = t.where("op = 'put'").select("hash", F.lit(1).alias("d")).unionByName(t.where("released is not null").select(F.col("released").alias("hash"), F.lit(-1).alias("d")))
    return changes.groupBy("hash").agg(F.greatest(F.sum("d"), F.lit(0)).alias("refcount"))


def put_outcomes(ops: DataFrame) -> DataFrame:
    """(seq, ns, key, is_new): whether a put stored bytes that no earlier one had stored."""
    first = ops.where("op = 'put'").groupBy("hash").agg(F.min("seq").alias("first"))
    return ops.where("op = 'put'").join(first, "hash").select("seq", "ns", "key", (F.col("seq") == F.col("first")).alias("is_new"))


def copies(requests: DataFrame, objects: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """requests(*by, src, dst) over objects(*by, key, hash, size): the same hash under a new key, or NoSuchKey. No bytes move."""
    found = requests.join(objects.select(*by, F.col("key").alias("src"), "hash", "size"), [*by, "src"], "left")
    return found.select(*by, "src", "dst", "hash", "size", F.when(F.col("hash").isNull(), "NoSuchKey").otherwise("copied").alias("status"))


def links(requests: DataFrame, blobs: DataFrame, visible: DataFrame) -> DataFrame:
    """requests(tenant_id, hash): linked with the stored size, or miss; a blob that the tenant cannot see is a miss."""
    seen = blobs.select("hash", "size").join(visible, "hash")
    found = requests.join(seen, ["tenant_id", "hash"], "left")
    return found.select("tenant_id", "hash", "size", F.when(F.col("size").isNull(), "miss").otherwise("linked").alias("status"))


def claims(requests: DataFrame, blobs: DataFrame, swept: DataFrame) -> DataFrame:
    """requests(seq, hash) over blobs(hash, size, refcount) and the hashes that a sweep takes first: claimed with the stored size
    and the references after the request, or miss. A blob without references that no sweep has taken can still be claimed."""
    held = blobs.join(swept.select("hash"), "hash", "left_anti").select("hash", "size", "refcount")
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("seq"))
    out = requests.join(held, "hash", "left").withColumn("nth", nth)
    status = F.when(F.col("size").isNull(), "miss").otherwise("claimed")
    return out.select("seq", "hash", "size", status.alias("status"), F.when(F.col("size").isNotNull(), F.col("refcount") + F.col("nth")).alias("refcount"))


def copies_as_of(requests: DataFrame, ops: DataFrame, kept: DataFrame) -> DataFrame:
    """requests(seq, ns, src, dst) against the log as it stood before each: hash, size and content type of the source then, and
    NoSuchKey where it was not there or its blob is not among kept(hash). The log's writes are (seq, ns, key, op, hash, size, content_type)."""
    log = writes(ops).select("ns", "key", "seq", F.struct("op", "hash", "size", "content_type").alias("w"), F.lit(None).cast("string").alias("dst"))
    none = F.lit(None).cast(log.schema["w"].dataType)
    asked = requests.select("ns", F.col("src").alias("key"), "seq", none.alias("w"), "dst")
    before = F.last("w", ignorenulls=True).over(Window.partitionBy("ns", "key").orderBy("seq", F.col("dst").isNull()).rowsBetween(Window.unboundedPreceding, -1))
    found = log.unionByName(asked).withColumn("was", before).where("dst is not null")
    found = found.select("seq", "ns", F.col("key").alias("src"), "dst", F.when(F.col("was.op") == "put", F.col("was")).alias("was"))
    there = kept.select(F.col("hash").alias("h")).distinct()
    found = found.join(there, F.col("was.hash") == F.col("h"), "left")
    ok = F.col("h").isNotNull()
    fields = [F.when(ok, F.col(f"was.{c}")).alias(c) for c in ("hash", "size", "content_type")]
    return found.select("seq", "ns", "src", "dst", *fields, F.when(ok, "copied").otherwise("NoSuchKey").alias("status"))


def batch_delete(requests: DataFrame, objects: DataFrame, quiet: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """requests(*by, key) over objects(*by, key): missing keys count as deleted; existed tells them apart. Quiet hides successes."""
    known = objects.select(*by, "key").distinct().withColumn("there", F.lit(True))
    out = requests.join(known, [*by, "key"], "left").select(*by, "key", F.lit("deleted").alias("status"), F.coalesce("there", F.lit(False)).alias("existed"))
    return out.where(F.lit(False)) if quiet else out


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """(deleted, failed) of outcomes(status) key by key; what failed is counted, not rolled back."""
    return outcomes.agg(F.count_if(F.col("status") == "deleted").alias("deleted"), F.count_if(F.col("status") != "deleted").alias("failed"))
