"""Multipart uploads: parts, manifests and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_parts(writes: DataFrame) -> DataFrame:
    """writes(upload_id, part_number, seq, staging_key, size, etag): the last write of each part wins."""
    last = F.max_by(F.struct("staging_key", "size", "etag", "seq"), "seq").alias("w")
    return writes.groupBy("upload_id", "part_number").agg(last).select("upload_id", "part_number", "w.*")


def replaced(writes: DataFrame) -> DataFrame:
    """Each write with the staging key that it replaced (null: none)."""
    own = Window.partitionBy("upload_id", "part_number").orderBy("seq")
    return writes.select("upload_id", "part_number", "seq", F.lag("staging_key").over(own).alias("replaced"))


def assembled(parts: DataFrame) -> DataFrame:
    """(upload_id, digest, size, parts): contents joined in order of part number; the digest is of the whole."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_number", "content"))), lambda p: p["content"]), "")
    out = parts.groupBy("upload_id").agg(whole.alias("whole"), F.count("*").alias("parts"))
    return out.select("upload_id", F.sha2("whole", 256).alias("digest"), F.octet_length("whole").cast("long").alias("size"), "parts")


def validated(manifest: DataFrame, parts: DataFrame) -> DataFrame:
    """manifest(upload_id, pos, part_number, etag) -> status of each line: not_ascending, not_uploaded, etag_mismatch or ok."""
    before = F.lag("part_number").over(Window.partitionBy("upload_id").orderBy("pos"))
    lines = manifest.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("said", F.expr("trim(both '\"' from etag)")).drop("etag")
    found = lines.join(parts.select("upload_id", "part_number", "etag"), ["upload_id", "part_number"], "left")
    status = F.when(F.col("part_number") <= F.col("before"), "not_ascending").when(F.col("etag").isNull(), "not_uploaded").when(F.col("etag") != F.col("said"), "etag_mismatch").otherwise("ok")
    return found.select("upload_id", "pos", "part_number", status.alias("status"))


def completed(manifest: DataFrame, parts: DataFrame) -> DataFrame:
    """(upload_id, status, digest, size, dropped): complete if every line is ok. All parts go, also those that the manifest leaves out."""
    checked = validated(manifest, parts)
    first_bad = F.min(F.when(F.col("status") != "ok", F.struct("pos", "status")))
    verdict = checked.groupBy("upload_id").agg(F.coalesce(first_bad["status"], F.lit("complete")).alias("status"))
    made = assembled(manifest.select("upload_id", "part_number").join(parts, ["upload_id", "part_number"]))
    count = parts.groupBy("upload_id").agg(F.count("*").alias("n"))
    ok = F.col("status") == "complete"
    out = verdict.join(made, "upload_id", "left").join(count, "upload_id", "left")
    return out.select("upload_id", "status", F.when(ok, F.col("digest")).alias("digest"), F.when(ok, F.col("size")).alias("size"), F.when(ok, F.col("n")).otherwise(0).alias("dropped"))


def parts_page(parts: DataFrame, upload_id: int, after: int = 0, limit: int = 1000) -> DataFrame:
    """Parts after a number, with whether there are more."""
    k = max(1, min(limit, 1000))
    top = parts.where((F.col("upload_id") == upload_id) & (F.col("part_number") > after)).orderBy("part_number").limit(k + 1)
    more = F.expr("count(*) over ()") > k
    return top.select("part_number", "size", "etag", more.alias("truncated")).orderBy("part_number").limit(k)


def uploads_under(uploads: DataFrame, prefix: str, compat: bool = False, limit: int = 1000, after: tuple[str, int] | None = None) -> DataFrame:
    """(id, key, truncated): a page of the uploads by key prefix, in order of key and id, with whether there are more.

    after: key and id of the last one of the page before. compat: `%` and `_` in the prefix are wildcards.
    """
    match = F.col("key").like(prefix + "%") if compat else F.col("key").startswith(prefix)
    if after is not None:
        match = match & ((F.col("key") > after[0]) | ((F.col("key") == after[0]) & (F.col("id") > after[1])))
    k = max(1, min(limit, 1000))
    top = uploads.where(match).orderBy("key", "id").limit(k + 1)
    return top.select("id", "key", (F.expr("count(*) over ()") > k).alias("truncated")).orderBy("key", "id").limit(k)


def created(requests: DataFrame, namespaces: DataFrame, kind: str = "application/octet-stream") -> DataFrame:
    """requests(seq, ns, key, content_type): an upload with an id of its own each, or NoSuchBucket. Ids hash what was asked for, so a retry makes no second one."""
    known = namespaces.select(F.col("name").alias("ns")).distinct().withColumn("there", F.lit(True))
    made = F.when(F.col("there"), F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "ns", "key"), 256))
    status = F.when(F.col("there"), "created").otherwise("NoSuchBucket")
    return requests.join(known, "ns", "left").select("seq", "ns", "key", F.coalesce("content_type", F.lit(kind)).alias("content_type"), made.alias("id"), status.alias("status"))


def found(requests: DataFrame, uploads: DataFrame) -> DataFrame:
    """requests(id, ns, key): found if the upload is that namespace's and key's own, else NoSuchUpload."""
    known = uploads.select("id", "ns", "key").withColumn("there", F.lit(True))
    return requests.join(known, ["id", "ns", "key"], "left").select("id", "ns", "key", F.when(F.col("there"), "found").otherwise("NoSuchUpload").alias("status"))


def removed(uploads: DataFrame, parts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The uploads left after those of gone(id) are aborted, and the staging keys(upload_id, staging_key) that this frees."""
    freed = parts.join(gone.select(F.col("id").alias("upload_id")).distinct(), "upload_id", "left_semi").select("upload_id", "staging_key")
    return uploads.join(gone, "id", "left_anti"), freed
