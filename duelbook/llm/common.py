"""What the operators of this subpackage share: inputs, row numbers, batches and scratch tables."""

from __future__ import annotations

import re
import sys
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.session import scratch_path

ROW = "__row"
FILES = 100_000  # paths that are numbered on the driver and broadcast


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash with a result's."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def numbered(docs: DataFrame) -> DataFrame:
    """A number for each row, the same on every read whatever the cores; tells rows of one doc_id apart.

    Rows of a plain Parquet scan are numbered by file, in order of paths, and by place in the file, which no split or
    number of cores changes. Anything else, and a scan of more than ``FILES`` files, is written once to the shared folder
    with its numbers and read back.
    """
    columns = docs.columns
    if plain_scan(docs):
        placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
        files = sorted(row[0] for row in placed.select("__file").distinct().limit(FILES + 1).collect())
        if len(files) <= FILES:
            order = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "__file string, __number long")
            number = F.shiftleft("__number", 36) + F.col("__place")
            return placed.join(F.broadcast(order), "__file").select(*columns, number.alias(ROW))
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def plain_scan(docs: DataFrame) -> bool:
    """Whether the rows are those of Parquet files, each at most once."""
    try:
        plan = docs._jdf.queryExecution().optimizedPlan().toString().splitlines()
        docs.select("_metadata.row_index")
    except (AttributeError, PySparkException):  # no plan to be seen from here, or no file's rows
        return False
    return not {re.match(r"[\s:+|-]*(\w*)", line)[1] for line in plan} - {"Project", "Filter", "Relation"}


def remainder(column: str, n: int) -> Column:
    """crc32 of a number written as text, modulo ``n``; a null counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % n


STORED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: lineage ends here, lost executors cost nothing."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    STORED[back] = path
    return back


def discard(table: DataFrame):
    """Delete what ``stored`` wrote for a table that nothing will read again."""
    context = table.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(STORED[table])
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession):
    """From here on an action's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_store(name: str, make):
    """The one value that a Python worker keeps from task to task; another name's value gives way to it."""
    store = sys.__dict__.setdefault("_duelbook_llm", {})
    if name not in store:
        store.clear()
        store[name] = make()
    return store[name]


def release_store():
    """Frees what earlier tasks of other operators left in this worker."""
    sys.__dict__.get("_duelbook_llm", {}).clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(frames, column: str = "text", size: int = 2_000_000):
    """Smaller frames of about ``size`` characters of ``column``, for steps that need many times a batch's memory.

    A text longer than that is a frame of its own; nothing is cut.
    """
    for frame in frames:
        taken = frame[column].str.len().fillna(0).to_numpy(dtype=np.int64).cumsum() // size
        cuts = [0, *(np.flatnonzero(np.diff(taken)) + 1).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield frame.iloc[a:b].reset_index(drop=True)
