"""Document fingerprints: Merkle trees over paragraphs and sections, in SQL functions alone.

A text is cut into paragraphs: lines, long lines at sentence ends, and what is longer still every `longest` characters;
nothing is lost, so the paragraphs joined are the text. A paragraph's hash is a leaf; up to `fan` leaves in a row make a
section, whose hash is that of its leaves; the root is the SHA-256 of the section hashes. The printed fingerprint is
"root:sections:paragraphs". Roots test equality; sections, then paragraphs, that differ locate edits; the
likeness of two fingerprints is the Dice coefficient of their sets of paragraph hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN = 16
LONGEST = 200


def leaves(text: Column, longest: int = LONGEST) -> Column:
    """The hashes of a text's paragraphs, in order. The empty text has none; so has null."""
    lines = F.split(F.coalesce(text, F.lit("")), r"(?<=\n)|(?<=[.!?;] )")
    parts = F.flatten(F.transform(lines, lambda x: F.when(F.length(x) > longest, F.regexp_extract_all(x, F.lit(rf"(?s).{{1,{longest}}}"), F.lit(0))).otherwise(F.array(x))))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.xxhash64(x))


def _hex(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda y: F.lower(F.lpad(F.hex(y), 16, "0"))), "")


def fingerprint(leaf: Column, fan: int = FAN) -> Column:
    """The printed fingerprint of an array of leaves."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(leaf) - 1, F.lit(0)), F.lit(fan))
    sections = F.transform(starts, lambda k: F.xxhash64(F.slice(leaf, k + 1, fan)))
    return F.concat_ws(":", F.sha2(_hex(sections), 256), _hex(sections), _hex(leaf))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of leaves as sets: 1 if both are empty."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def _branches(print_: Column, level: int) -> Column:
    return F.regexp_extract_all(F.split(print_, ":")[level], F.lit("[0-9a-f]{16}"), F.lit(0))


def edited_paragraphs(a: Column, b: Column) -> Column:
    """The numbers (from 0) of the paragraphs in which two printed fingerprints differ. Equal roots give an empty array."""
    x, y = _branches(a, 2), _branches(b, 2)
    last = F.greatest(F.size(x), F.size(y)) - 1
    all_ = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    differing = F.filter(all_, lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))
    return F.when(F.split(a, ":")[0] == F.split(b, ":")[0], F.array().cast("array<int>")).otherwise(differing)


def merkle_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 2000, most_buckets: int = 4096) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document in ascending order of doc_id; after the last comes the first, and a lone document follows itself. Null
    texts count as empty. Rows with the same id follow one another in order of their texts, and null ids come first.
    An empty table gives no rows; extra columns are ignored. Ids must be whole numbers.

    Documents are dealt to buckets by quantiles of the id, and further by the id's place between two of them where
    there are more than most_buckets; each bucket's last document finds the next one's first in its own bucket, and so
    texts are shuffled once and no task holds more than a bucket. Only numbers of each bucket meet in one place.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = rows.select("doc_id").count()
    k = min(most_buckets, n // bucket_rows + 1)
    within = -(-n // (k * bucket_rows)) if k == most_buckets else 1
    cuts = []
    if k > 1:
        found = rows.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)], 20 * k), F.min("doc_id"), F.max("doc_id")).first()  # at most most_buckets numbers
        cuts, ends = sorted(set(found[0] or [])), found[1:]
    bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("doc_id"))), F.lit(0)).cast("long") if cuts else F.lit(0).cast("long")
    if cuts and within > 1:
        low, high = (F.element_at(F.array(*[F.lit(c).cast("double") for c in some]), (bucket + 1).cast("int")) for some in ([ends[0], *cuts], [*cuts, ends[1]]))
        place = F.floor((F.col("doc_id") - low) / F.greatest(high - low, F.lit(1.0)) * within)
        bucket = bucket * within + F.greatest(F.lit(0), F.least(F.lit(within - 1), place))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(bucket))
    # a row for each bucket: its first document, sent to the bucket before, and the very first to the last
    least = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least"))
    around = Window.partitionBy(F.lit(1)).orderBy("b")
    before = F.coalesce(F.lag("b").over(around), F.max("b").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    least = least.select(F.col("bucket").alias("b"), F.col("least.doc_id").alias("d")).select("b", "d", before.alias("before"))
    least = F.broadcast(least) if k * within <= 100_000 else least
    firsts = rows.join(least, F.expr("bucket = b and doc_id <=> d")).groupBy("before").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    firsts = firsts.select("doc_id", "text", F.col("before").alias("bucket"), F.lit(1).alias("guest"))
    both = rows.withColumn("guest", F.lit(0)).unionByName(firsts).withColumn("leaf", leaves(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    both = both.withColumn("next", F.lead(F.struct("text", "leaf")).over(order)).where("guest = 0")
    edited = F.expr("concat(left(text, length(text) - cast(length(text) div 2 as int)), left(next.text, cast(length(text) div 2 as int)))")
    both = both.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    both = both.select("doc_id", "n_chars", "edited", "leaf", F.col("next.leaf").alias("next_leaf")).withColumn("edited_leaf", leaves(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("leaf")).alias("fingerprint"),
        fingerprint(F.col("edited_leaf")).alias("edited_fingerprint"),
        likeness(F.col("leaf"), F.col("edited_leaf")).alias("near_edited"),
        likeness(F.col("leaf"), F.col("next_leaf")).alias("near_next"),
    )
