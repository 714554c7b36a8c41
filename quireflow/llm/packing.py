"""Hierarchical residual best-fit packing of documents into sequences of tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .tokenization import encoder

#: Items that are packed together, at most.
TOGETHER = 100_000
#: Bytes of ids from which on a task packs what it holds, where the ids go along.
HELD_BYTES = 64 << 20


def best_fit(sizes: np.ndarray, limit: int) -> np.ndarray:
    """A bin number for each size, by best fit in descending order of size.

    Open bins stand by the room they have left; a bit for each room that some
    bin has finds the tightest one that takes an item.
    """
    bins = np.empty(len(sizes), dtype=np.int64)
    rooms: list[list[int]] = [[] for _ in range(limit + 1)]
    some, n = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = some >> size
        if fitting and size < limit:
            room = size + (fitting & -fitting).bit_length() - 1
            bin_ = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            room, bin_, n = limit, n, n + 1
        if room > size:
            if not rooms[room - size]:
                some |= 1 << (room - size)
            rooms[room - size].append(bin_)
        bins[i] = bin_
    return bins


def _offsets(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each item starts in its bin, in the order given."""
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    first = np.r_[True, np.diff(bins[order]) != 0]
    out = np.empty(len(sizes), dtype=np.int64)
    out[order] = starts - np.repeat(starts[first], np.diff(np.r_[np.flatnonzero(first), len(order)]))
    return out


def _pieces(path: str, end_id: int, limit: int, with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(path).encode, TaskContext.get().partitionId() << 32
        end = np.asarray([end_id], dtype="<u4").tobytes()
        columns: list[list] = [[] for _ in range(6)]
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal base
            ids, piece, start, length, crc, data = columns
            sizes = np.asarray(length, dtype=np.int64)
            bins = best_fit(sizes, limit)
            out = [pa.array(ids, doc_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(bins + base), pa.array(_offsets(bins, sizes))]
            base += int(bins.max()) + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"]
            if with_ids:
                out, names = [*out, pa.array(data, pa.binary())], [*names, "ids"]
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(data), 4 * limit)):
                    part = data[at : at + 4 * limit]
                    held += len(part) if with_ids else 0
                    for c, value in zip(columns, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        c.append(value)
                if len(columns[0]) >= TOGETHER or held >= HELD_BYTES:
                    yield packed()
                    held = 0
        if columns[0]:
            yield packed()

    return run


def _merged(limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for batch in _batches(batches, TOGETHER):
            sizes = batch.column("used").to_numpy(zero_copy_only=False).astype(np.int64)
            bins = best_fit(sizes, limit)
            yield pa.RecordBatch.from_arrays([batch.column("bin"), pa.array(bins + base), pa.array(_offsets(bins, sizes)), pa.array(sizes)], ["bin", "into", "base", "used"])
            base += int(bins.max()) + 1

    return run


def _batches(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``size`` and a last, smaller one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if sum(b.num_rows for b in held):
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def pack_documents(docs: DataFrame, tokenizer: str, *, limit: int = 2048, end_id: int = 0, slack: int | None = None, with_ids: bool = False) -> DataFrame:
    """Cut documents into pieces of at most ``limit`` tokens and pack these into few sequences.

    A document is the ids of its text (null: empty) by the vocabulary file
    ``tokenizer`` and ``end_id``; only longer ones are cut, every ``limit``
    tokens. Each partition packs its pieces by best fit, ``TOGETHER`` at a
    time (or ``HELD_BYTES`` of ids). Sequences that lack more than ``slack`` tokens (a 128th of the limit)
    become items of the next round, in which fewer tasks pack them together;
    rounds go on until one task has seen all that are left, or a round joins
    none. So a task never holds more than ``TOGETHER`` items.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and
    with ``with_ids`` the ids as little-endian binary; columns of the input
    other than doc_id and text don't return. Rows that repeat are packed as
    often as they stand there; null ids stay null; an empty text is one piece
    of one token; an empty table gives no pieces.
    """
    slack = limit // 128 if slack is None else slack
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, bin long, offset long"
    pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end_id, limit, with_ids), schema + ", ids binary" * with_ids), "pieces")
    used = pieces.groupBy("bin").agg(F.sum("length").alias("used"))
    moves = None
    while True:
        under = written(used.where(F.col("used") < limit - slack).select("bin", "used"), "underfull")
        left = under.count()
        if left < 2:
            break
        tasks = -(-left // TOGETHER)
        joined = written(under.coalesce(tasks).mapInArrow(_merged(limit), "bin long, into long, base long, used long"), "merged")
        # numbers of a round's sequences are negative and distinct from all before
        joined = joined.withColumn("into", -(F.col("into") * 64 + F.lit(0 if moves is None else moves[1])) - 1)
        if moves is None:
            moves = (joined.select("bin", "into", "base"), 1)
        else:
            later = joined.select(F.col("bin").alias("into"), F.col("into").alias("onto"), F.col("base").alias("more"))
            earlier = moves[0].join(later, "into", "left").select("bin", F.coalesce("onto", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
            moves = (written(earlier, "moves"), moves[1] + 1)
        used = joined.groupBy(F.col("into").alias("bin")).agg(F.sum("used").alias("used"))
        if tasks == 1 or joined.select("into").distinct().count() == left:
            break
    if moves is not None:
        pieces = pieces.join(moves[0], "bin", "left")
        place = [F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")]
    else:
        place = [F.col("bin").alias("sequence_id"), F.col("offset")]
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", *place, *["ids"] * with_ids)
