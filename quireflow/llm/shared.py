"""Tables in the folder that the driver and all executors share.

Operators that read an intermediate more than once, or whose intermediate must
not change when a task is run again, write it here as Parquet. The folder is
the session's ``spark.checkpoint.dir``, or the one that was set on its
context; only a local session, as in tests, may do without, in a temporary
folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


#: Keys that are broadcast for being frequent, at most.
FREQUENT = 4096


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quireflow.shared.dir", None)
    if not named and context._jsc.sc().getCheckpointDir().isDefined():
        named = context._jsc.sc().getCheckpointDir().get()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quireflow-")
        spark.conf.set("spark.quireflow.shared.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, which is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/quireflow/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there.

    The lineage ends at the files, so a lost executor costs a reread.
    """
    path = scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended; the folder belongs to it
            return


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: A word: a longest run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; one of fewer partitions than there are cores, such as a file of one row group, is dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def with_key(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``table``, a written table of one row a key, whose column n says how many rows have the key.

    Keys of more than a ``FREQUENT``th of ``total``, the number of rows, are
    ``FREQUENT`` at most; they are broadcast, so that no key's rows have to
    stand in one task. The others are joined as usual.
    """
    often = F.broadcast(table.where(F.col("n") > max(1, total // FREQUENT)))
    rest = rows.join(often.select(*keys), keys, "left_anti").join(table.where(F.col("n") <= max(1, total // FREQUENT)), keys)
    return rows.join(often, keys).unionByName(rest)
