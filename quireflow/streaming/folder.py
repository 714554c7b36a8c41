"""Records of spreads as their token files arrive.

Every spread comes whole in one file, so its ditto marks are filled within a
batch and no state is kept between batches; the checkpoint remembers which
files were taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schema import TOKEN


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, job: Callable[[DataFrame], DataFrame], *, files: int = 64) -> StreamingQuery:
    """Run ``job`` on the tokens of new JSON files and append its records to ``out``, ``files`` at most a batch."""
    schema = f"source_file string, start_page int, side string, {TOKEN}"
    tokens = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)

    def batch(df: DataFrame, number: int) -> None:
        # a batch that runs again writes its own folder again
        job(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return tokens.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
