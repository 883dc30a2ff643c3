"""What the operators share: input tables, tables written to the shared folder, the train/held-out split of ids."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def small_batches(rows: int = 1000) -> None:
    """Texts are long: the session's Arrow batches get `rows` rows at most, so that a worker's memory is bounded by that many."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def mapped(fn: Callable[..., pd.DataFrame | pd.Series], kind: str, *columns: Column) -> Column:
    """The column that fn makes of batches of columns (pandas Series). Only these columns go to Python, so ids keep their type and nulls."""
    small_batches()

    def batches(some: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for given in some:
            yield fn(*given)

    def batches_of_one(some: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for given in some:
            yield fn(given)

    out = pd.DataFrame if kind.startswith("struct") else pd.Series
    f = batches if len(columns) > 1 else batches_of_one
    f.__annotations__ = {"some": Iterator[tuple[pd.Series, ...]] if len(columns) > 1 else Iterator[pd.Series], "return": Iterator[out]}
    # as nondeterministic, so that the optimiser neither copies it, as into a filter on a field of what it makes, nor infers it for another table
    return pandas_udf(f, kind).asNondeterministic()(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidepool-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again. It cuts the lineage: a lost executor costs no earlier stage.
    The files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidepool-{uuid.uuid4().hex}"
    # compressed in Java: no native memory beside the heap; on a local file system without .crc files, for each of which and
    # of its owners Hadoop starts a process to set permissions
    df.write.options(compression="lz4_raw", **({"fs.file.impl.disable.cache": "true", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem"} if path.startswith("file:") else {})).parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def filled_slots(slots: DataFrame, n: int) -> np.ndarray:
    """A bitmap of n slots, in words of 32 bits, with those of slots(s: int) filled. n bounds what reaches the driver."""
    words = slots.groupBy(F.shiftright("s", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, s & 31)")).alias("bits")).toArrow()
    filled = np.zeros(n // 32, np.uint32)
    filled[words["word"].to_numpy()] = words["bits"].to_numpy()
    return filled


def may_be_in(wanted: DataFrame, n: int = 1 << 24) -> Callable[[pd.Series], pd.Series]:
    """A test for mapped() whether keys (long) may be among wanted(key); of those that are, none is denied. A bitmap of n bits goes to every task."""
    shared = wanted.sparkSession.sparkContext.broadcast(filled_slots(wanted.select(F.pmod("key", F.lit(n)).cast("int").alias("s")), n))

    def test(keys: pd.Series) -> pd.Series:
        slot = keys.to_numpy(np.int64) % n
        return pd.Series((shared.value[slot >> 5] >> (slot & 31).astype(np.uint32) & np.uint32(1)).astype(bool))

    return test


def split_of(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts. A null id is in part 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts, F.lit(0))


def bounded_sample(df: DataFrame, key: Column, label: str, per_label: int, id_col: str) -> DataFrame:
    """About per_label rows (at most, up to chance, 1.2 times as many) for each value of label, picked by a hash of the id."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / max(n, 1)))).otherwise(share)
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
