"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

#: Numbers in the matrix, at most; inputs of more partitions than it has rows for are read by fewer, larger tasks.
MATRIX = 1 << 20
#: Rows that one task orders within a shard, about.
RUN_ROWS = 20_000


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among ``drawn`` taken without replacement.

    Inversion from the mode outwards: the probability of the mode comes from
    log-gamma, its neighbours from the ratio of successive terms. Sizes are
    not bounded; the steps grow with the standard deviation.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    u = rng.random() - at_mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while u > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """How many of each partition's rows go to each shard, as a uniform shuffle would send them.

    ``rows`` counts the rows of each partition. Shard sizes differ by one at
    most; each partition's counts are multivariate hypergeometric given what
    the shards still take.
    """
    rng, total = random.Random(seed), sum(rows)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in rows:
        out, rest = [], sum(left)
        for s in range(shards):
            rest -= left[s]
            take = hypergeometric(rng, left[s], rest, n)
            out.append(take)
            left[s] -= take
            n -= take
        matrix.append(out)
    return matrix


def uniform_shards(df: DataFrame, shards: int = 16, *, seed: int = 11) -> DataFrame:
    """Deal rows uniformly to shards whose sizes differ by one at most, each shard in random order.

    Each partition puts its rows in an order drawn from the seed, the partition
    and a row's number in it, without a shuffle, and is written so. Partitions
    draw how many rows they send to each shard (the matrix of counts is the
    only thing that reaches the driver: ``MATRIX`` numbers at most) and cut
    their order at the counts. One exchange moves whole rows;
    within a shard a second draw deals them to runs of bounded size, whose
    counts place them; ``slot`` is a row's place, gapless from 0.

    The draws don't read what a row holds, so equal rows are dealt as any
    others, and nulls and types don't matter. The result has the input's
    columns and shard, slot (an input column of these names is replaced). The
    law depends on how the input is partitioned; the same files and settings
    give the same shards. Fewer rows than shards leave shards empty; an empty
    table gives an empty result.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # a row's number in its partition
    send = F.xxhash64(F.lit(seed), F.lit("send"), F.col("from"), F.col("nth"))
    rows = df.coalesce(max(1, MATRIX // shards)).select(F.struct(*names).alias("row"), F.spark_partition_id().alias("from"), number.alias("nth"))
    rows = rows.sortWithinPartitions(send, "nth").withColumn("at", number)
    rows = written(rows, "shard-rows")
    counts = dict(rows.groupBy("from").count().collect())  # a row for each partition
    parts, total = sorted(counts), sum(counts.values())
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    cuts = [(p, [sum(sent[: s + 1]) for s in range(shards)]) for p, sent in zip(parts, matrix, strict=True)]
    cuts = df.sparkSession.createDataFrame(cuts, T.StructType([T.StructField("from", T.IntegerType()), T.StructField("ends", T.ArrayType(T.LongType()))]))

    bits = max(6, min(16, math.ceil(math.log2(max(1, total / shards / RUN_ROWS)))))
    place = F.xxhash64(F.lit(seed), F.lit("place"), F.col("from"), F.col("nth"))
    sent = rows.join(F.broadcast(cuts), "from").select(  # MATRIX numbers at most
        "row",
        "from",
        "nth",
        F.size(F.filter("ends", lambda end: end <= F.col("at"))).alias("shard"),
        place.alias("place"),
        F.shiftrightunsigned(place, 64 - bits).alias("run"),
    )
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = sent.groupBy("shard", "run").count().select("shard", "run", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "run").orderBy("place", "from", "nth")) - 1
    return (
        sent.withColumn("within", within)
        .join(runs, ["shard", "run"])
        .select("row.*", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"))
    )
