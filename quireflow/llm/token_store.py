"""Token ids in ORC files."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import scratch, written
from .tokenization import encoder

#: Bytes of a stripe, rows of a row group with its own index and Bloom filter, chance of a false hit.
STRIPE_BYTES, GROUP_ROWS, FALSE_HITS = 16 << 20, 2000, 0.01
#: Documents that one Arrow batch carries back to the JVM.
BATCH_DOCS = 500


def _encoded(path: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, row = encoder(path).encode, TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in (b.slice(at, BATCH_DOCS) for b in batches for at in range(0, b.num_rows, BATCH_DOCS)):
            data = [encode(text or "") + end for text in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in data)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), dtype=np.int32)))
            n = len(data)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(row, row + n, dtype=np.int64)), ids], ["doc_id", "part", "row", "ids"])
            row += n

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0) -> None:
    """Write each text's ids and ``end_id`` to ORC files at ``path``, in ascending order of doc_id.

    Texts are dealt by ranges of doc_id and sorted before they are encoded, so
    that text and not ids moves. A row has doc_id, part (files are in the order
    of part), row (place in the part) and ids. Stripes hold run-length encoded
    integers; their footers and row groups have the least and greatest doc_id
    and a Bloom filter, with which a reader skips them. Null ids come first;
    rows of one id are ordered by a hash of the text; a null text is empty.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = rows.mapInArrow(_encoded(tokenizer, end_id), f"doc_id {id_type}, part int, row long, ids array<int>")
    options = {
        "compression": "zstd",
        "orc.stripe.size": STRIPE_BYTES,
        "orc.row.index.stride": GROUP_ROWS,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": FALSE_HITS,
    }
    rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """doc_id, part, row, ids of all documents, split by stripes; or of some, by statistics and Bloom filters."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "row")), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "row", "n_tokens", "ids_crc32"])


def document_places(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of ``read_tokens``.

    start counts the ids of all documents before it: those of earlier parts
    (one row a part) and those before it in its own.
    """
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    rows = written(tokens.mapInArrow(_sums, f"doc_id {id_type}, part int, row long, n_tokens long, ids_crc32 long"), "token-sums")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("before"))
    rows = rows.withColumn("within", before(Window.partitionBy("part").orderBy("row")))
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def stored_places(docs: DataFrame, tokenizer: str, *, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write the documents' ids to ``path`` (a place in the shared folder that is removed at the end, if none is named) and describe what the files hold."""
    path = path or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id=end_id)
    return document_places(read_tokens(docs.sparkSession, path))
