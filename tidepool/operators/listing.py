"""Hierarchical listing of keys: prefix, delimiter, marker and page size, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import scalars
from tidepool.functions.documents import document, element, group


def page_size(asked: int | None, default: int = 1000, most: int = 1000) -> int:
    return max(1, min(default if asked is None else asked, most))


def grouped(objects: DataFrame, prefix: str = "", delimiter: str | None = None, marker: str = "", compat: bool = False, inclusive: bool = False) -> DataFrame:
    """(entry, is_prefix): keys under prefix and after marker; those with a delimiter after the prefix roll up to it.

    compat: a key equal to a group's byte successor is left out, as a walk that jumps past the group leaves it out.
    inclusive: the marker itself is listed too, which resumes after a group without that loss.
    """
    key = F.col("key")
    rows = objects.select("key").where(key.startswith(prefix))
    if marker:
        rows = rows.where(key >= marker if inclusive else key > marker)
    if not delimiter:
        return rows.select(key.alias("entry"), F.lit(False).alias("is_prefix"))
    rest = F.substr(key, F.lit(len(prefix) + 1))
    at = F.instr(rest, delimiter)
    group = F.when(at > 0, F.concat(F.lit(prefix), F.substr(rest, F.lit(1), at)))
    rows = rows.select("key", group.alias("g"))
    groups = rows.where("g is not null").select("g").distinct()
    plain = rows.where("g is null").select("key")
    if compat:
        plain = plain.join(groups.select(successor(F.col("g"), delimiter).alias("key")), "key", "left_anti")
    return plain.select(F.col("key").alias("entry"), F.lit(False).alias("is_prefix")).unionByName(groups.select(F.col("g").alias("entry"), F.lit(True).alias("is_prefix")))


def successor(group: Column, delimiter: str) -> Column:
    """The least string above all that start with group: its last character (the delimiter) plus one."""
    return F.concat(F.substr(group, F.lit(1), F.length(group) - 1), F.lit(chr(ord(delimiter) + 1)))


def page(entries: DataFrame, max_keys: int | None = None, default: int = 1000) -> DataFrame:
    """The first max_keys entries in byte order, with whether there are more: a bounded top-k, not a sort of all."""
    k = page_size(max_keys, default)
    top = entries.orderBy("entry").limit(k + 1)
    n = F.expr("count(*) over ()")
    return top.withColumn("truncated", n > k).orderBy("entry").limit(k)


def next_marker(listed: DataFrame, delimiter: str | None) -> DataFrame:
    """(key_count, truncated, next_marker) of a page."""
    last = F.max_by(F.struct("entry", "is_prefix"), "entry")
    out = listed.agg(F.count("*").alias("key_count"), F.coalesce(F.max("truncated"), F.lit(False)).alias("truncated"), last.alias("last"))
    entry = F.col("last.entry")
    after = F.when(F.col("last.is_prefix"), successor(entry, delimiter)).otherwise(entry) if delimiter else entry
    return out.select("key_count", "truncated", F.when(F.col("truncated"), after).alias("next_marker"))


def _answered(objects: DataFrame, prefix: str, delimiter: str | None, marker: str, k: int, entry: Column) -> DataFrame:
    """One row for a page of objects(key, hash, size, updated): key_count, truncated, next_marker, and by name the said entries and the prefixes."""
    listed = page(grouped(objects, prefix, delimiter, marker), k)
    wanted = listed.where("not is_prefix").select(F.col("entry").alias("key"))
    held = objects.join(F.broadcast(wanted), "key", "left_semi").select(F.col("key").alias("entry"), entry.alias("said"))  # of a page: 1000 rows
    own = F.collect_list(F.when(~F.col("is_prefix"), F.struct("entry", "said")))
    groups = F.collect_list(F.when(F.col("is_prefix"), F.col("entry")))
    every = listed.join(F.broadcast(held), "entry", "left").agg(F.array_sort(own).alias("own"), F.array_sort(groups).alias("prefixes"))
    return every.select(F.transform("own", lambda x: x["said"]).alias("entries"), "prefixes").join(F.broadcast(next_marker(listed, delimiter)))  # a row each


def answer_xml(objects: DataFrame, ns: str, prefix: str = "", delimiter: str | None = None, max_keys: int | None = None, marker: str = "", token: str | None = None, v2: bool = False) -> DataFrame:
    """(xml): the answer to a listing of one namespace's objects(key, hash, size, updated).

    v2: a page goes on from `token`, the base64 form of the marker that the page before gave, else after `marker`; the first
    form tells markers as they are.
    """
    fields = element("Key", F.col("key")), element("LastModified", scalars.iso_millis(F.col("updated"))), element("ETag", scalars.etag(F.col("hash"))), element("Size", F.col("size"))
    start = scalars.decoded_marker(token) if v2 and token is not None else marker
    out = _answered(objects, prefix, delimiter, start, page_size(max_keys), group("Contents", *fields, element("StorageClass", F.lit("STANDARD"))))
    after = F.col("next_marker")
    where = (
        (element("ContinuationToken", F.lit(token).cast("string")), element("NextContinuationToken", scalars.marker(after))) if v2 else (element("Marker", F.lit(marker)), element("NextMarker", after))
    )
    most = 1000 if max_keys is None else max(0, min(max_keys, 1000))
    prefixes = F.transform("prefixes", lambda p: group("CommonPrefixes", element("Prefix", p)))
    head = element("Name", F.lit(ns)), element("Prefix", F.lit(prefix)), element("Delimiter", F.lit(delimiter).cast("string")), element("MaxKeys", F.lit(most))
    counts = element("KeyCount", F.col("key_count")), element("IsTruncated", F.col("truncated"))
    return out.select(document("ListBucketResult", *head, *counts, *where, F.array_join("entries", ""), F.array_join(prefixes, "")).alias("xml"))


def answer_json(objects: DataFrame, prefix: str = "", delimiter: str | None = None, limit: int | None = None, token: str | None = None) -> DataFrame:
    """(json): the same for the JSON interface, whose pages hold 500 entries unless asked otherwise; token goes on as in answer_xml()."""
    kind = scalars.content_type(F.lit(None).cast("string"), F.col("key"))
    said = F.struct("key", "size", F.col("hash").alias("etag"), kind.alias("content_type"), scalars.rfc3339(F.col("updated")).alias("last_modified"))
    out = _answered(objects, prefix, delimiter, "" if token is None else scalars.decoded_marker(token), page_size(limit, 500), said)
    fields = F.struct(F.col("entries").alias("objects"), F.col("prefixes").alias("common_prefixes"), scalars.marker(F.col("next_marker")).alias("next_token"))
    return out.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("json"))


def level(objects: DataFrame, prefix: str, delimiter: str = "/") -> DataFrame:
    """A whole level, folders first, with display names."""
    named = grouped(objects, prefix, delimiter).withColumn("name", F.regexp_replace(F.substr("entry", F.lit(len(prefix) + 1)), "/$", ""))
    return named.select("entry", "is_prefix", "name")


def expanded(objects: DataFrame, opened: list[str], delimiter: str = "/") -> DataFrame:
    """(parent, entry, is_prefix): the levels of all opened folders; the opened set is the request's, and so small."""
    out = None
    for prefix in dict.fromkeys(["", *opened]):
        one = grouped(objects, prefix, delimiter).withColumn("parent", F.lit(prefix))
        out = one if out is None else out.unionByName(one)
    return out.select("parent", "entry", "is_prefix")
