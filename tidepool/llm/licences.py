"""License scan by diagonal voting, in DataFrame operations alone.

Every pair of neighbouring words of a document is hashed and joined to the places of such pairs in the templates (a
bitmap of the templates' hashes spares pairs that cannot join from becoming rows). A
template laid over a document gives hits on one diagonal (place in the document less place in the template); votes are
counted by diagonal, neighbouring diagonals (a word more or less) are merged, and a span is verified by the share of the
template's pairs that it holds. A base phrase stands where its diagonal has all of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The base phrases, and usual wordings of licence lines.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "licensed under the gnu general public license version": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license version 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution": "cc",
    "this work is dedicated to the public domain": "public-domain",
    "no part of this publication may be reproduced": "reserved",
}
_END = -0x7E57_AB1E  # the mark of the row that counts a document's words


def words(text: Column) -> Column:
    """The words of a text: runs of a-z, 0-9 and all beyond ASCII, after A-Z are lower-cased.

    lower() also folds letters beyond ASCII. That neither joins nor parts words, as no such letter becomes a separator, and
    the only one to become a letter of ASCII, the Kelvin sign, becomes a k, which no base phrase has.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _templates(spark: SparkSession, base: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """(h, template, place, pairs, label, base): a row for each pair of each template, and one for the counting row."""
    rows = []
    for k, (phrase, label, is_base) in enumerate([*((p, x, True) for p, x in base.items()), *((p, x, False) for p, x in templates.items())]):
        w = phrase.split()
        rows += [(a, b, k, j, len(w) - 1, label, is_base) for j, (a, b) in enumerate(zip(w, w[1:]))]
    said = ", ".join(f"('{a}', '{b}', {k}, {j}, {n}, '{label}', {str(is_base).lower()})" for a, b, k, j, n, label, is_base in rows)
    made = spark.sql(f"select xxhash64(a, b) as h, template, place, pairs, label, base from values {said} as v(a, b, template, place, pairs, label, base)")
    return made.unionByName(spark.sql(f"select {_END}L as h, -1 as template, 0 as place, 0 as pairs, '' as label, false as base"))


def _may_join(hashes: list[int], slots: int = 1 << 16) -> Callable[[Column], Column]:
    """A test that no pair of the join below fails, before the pairs become rows: a bitmap of the templates' hashes."""
    bits = [0] * (slots // 32)
    for h in hashes:
        bits[(h % slots) // 32] |= 1 << h % 32
    held = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")
    return lambda pair: F.get(held, F.shiftright(F.pmod(pair["h"], F.lit(slots)), 5).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(pair["h"], F.lit(32)).cast("int"))) != 0


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, verified: float = 0.8, drift: int = 2) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    n_base counts all places of all base phrases; first_word and last_word are the smallest and largest start (null
    without any). labels adds those of the templates of which a span holds at least `verified` of the word pairs. score is
    the largest share that any phrase or template reaches. Null texts count as empty: no words, empty labels, score 0.
    Rows that repeat id and text are returned as often as they occur; null ids stay. An empty table gives no rows;
    extra columns are ignored. Phrases need two words at least.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # rows that repeat id and text meet by partitions of the input, so that no task gets all of very many
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), F.spark_partition_id().alias("origin"), words(F.col("text")).alias("w"))
    pairs = F.transform("w", lambda w, i: F.struct(F.xxhash64(w, F.get(F.col("w"), i + 1)).alias("h"), i.alias("at")))
    known = _templates(spark, base, templates)
    pairs = F.filter(pairs, _may_join([r["h"] for r in known.select("h").distinct().collect()]))  # a row for each pair of the templates
    count = F.array(F.struct(F.lit(_END).cast("long").alias("h"), F.size("w").alias("at")))
    hits = rows.select("doc_id", "t", "origin", F.explode(F.concat(count, pairs)).alias("g")).select("doc_id", "t", "origin", "g.h", "g.at")
    hits = hits.join(F.broadcast(known), "h")  # the templates given, whatever the corpus
    hits = hits.withColumn("diagonal", F.when(F.col("template") >= 0, F.col("at") - F.col("place")).otherwise(F.col("at")))
    # one exchange serves all that follows: every grouping and window below is within (doc_id, t, origin)
    hits = hits.select("doc_id", "t", "origin", "template", "place", "pairs", "label", "base", "diagonal").repartition("doc_id", "t", "origin")
    lines = hits.groupBy("doc_id", "t", "origin", "template", "pairs", "label", "base", "diagonal").agg(
        F.count("*").alias("rows"), F.collect_set("place").alias("places")  # rows: for the counting row, how many documents are alike
    ).withColumn("votes", F.size("places"))
    near = Window.partitionBy("doc_id", "t", "origin", "template").orderBy("diagonal")
    lines = lines.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(near) > drift).cast("int"))
    lines = lines.withColumn("span", F.sum(F.coalesce("new", F.lit(0))).over(near))
    spans = lines.groupBy("doc_id", "t", "origin", "template", "pairs", "label", "base", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"),
        F.count_if(F.expr("base and votes = pairs")).alias("whole"),
        F.min(F.expr("if(base and votes = pairs, diagonal, null)")).alias("first"),
        F.max(F.expr("if(base and votes = pairs, diagonal, null)")).alias("last"),
        F.max("diagonal").alias("n_words"),
        F.max("rows").alias("rows"),
    )
    named = spans.withColumn("share", F.when(F.col("pairs") > 0, F.col("held") / F.col("pairs")))
    out = named.groupBy("doc_id", "t", "origin").agg(
        F.max(F.expr("if(template < 0, n_words, null)")).cast("long").alias("n_words"),
        F.sum("whole").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.expr("if(whole > 0, label, null)"))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.expr(f"if(whole > 0 or (not base and share >= {verified}), label, null)"))), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.max(F.expr("if(template < 0, rows, null)")).alias("rows"),
    )
    out = out.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
