"""A training corpus from raw documents: quality, near-duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; run() writes each as Parquet to
the shared folder and reads it again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import mixing, packing, privacy, quality, simhash
from tidepool.llm.base import saved, table
from tidepool.llm.queries import domains

#: Weights after mixing. What is labelled low went with the quality stage; the classifier misses some of the toxic texts, so
#: that a smaller weight for them would cost good ones.
TARGETS = {"clean": 0.98, "toxic": 0.02}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score at least 0.7; the others go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows but those whose 5-word shingles have a similarity (cosine) of 0.8 or more, held exactly, to a kept row of a smaller id."""
    return simhash.deduplicated(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data and what discloses it replaced by marks; n_chars is recounted."""
    return privacy.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each row as the operator draws for it: the whole part of its rate, and one more for its fraction's share of the rows."""
    labelled = domains(table(spark, sf_dir, "labels")).where(F.col("domain").isin(list(TARGETS)))
    rates = mixing.mixed_rates(docs, labelled, TARGETS, with_rows=True)
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return rates.where("copies > 0").select("row", times.alias("time")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("personal_data", hide_personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned models, hashes and the tokenizer are beyond SQL; tests/llm/ hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
