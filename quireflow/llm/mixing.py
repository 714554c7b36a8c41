"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import word_count, written

#: Characters of the hexadecimal draw that deal a source's documents into groups (16 ** 3 groups a source).
GROUP_DIGITS = 3
#: Sources whose targets and cuts are broadcast, at most; with more of them, sources are joined.
BROADCAST_SOURCES = 100_000


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which ``least(cap, level * weight)`` sums to ``total``.

    ``sources`` has columns ``cap`` and ``weight``. Sources over their cap are
    clamped and the excess goes to the others by weight, again and again, until
    none is above. Only two sums a round reach the driver. With nothing left to
    raise, the level of the last round holds.
    """
    level, before = None, -1.0
    capped, free = 0.0, sources.agg(F.sum(F.col("weight").cast("double"))).first()[0] or 0.0
    while free > 0 and level != before:
        before, level = level, (total - capped) / free
        above = F.col("cap") < F.lit(level) * F.col("weight")
        capped, free = (
            float(x or 0.0)
            for x in sources.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight").cast("double")))).first()
        )
    return level or 0.0


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Weights for the distinct ``source`` values by code point, null last: ``cycle``, repeating."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source").distinct().select("source", F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")).alias("weight"))


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    cycle: tuple[int, ...] = (5, 2, 1),
    max_epochs: float = 3.0,
    total: float | None = None,
    seed: str = "mix-1",
) -> DataFrame:
    """Decide how often each document goes into a mix of its sources.

    ``weights`` has ``source`` and ``weight``; without it the sources get
    ``cycle`` by code point. The targets share ``total`` words (the corpus's
    own, if none is given) by weight, at most ``max_epochs`` times a source's
    words each. A source's whole epochs take every document; the rest is drawn
    without replacement: documents in the order of a seeded hash of doc_id, as
    long as they fit, and then the one of the others whose size comes nearest
    to what is still open, if that brings the sum nearer to the target.

    Sizes, sources and draws are written once, without texts. A source's
    documents are dealt to 4096 groups by the hash, and a running sum over
    group totals places each group, so no source, however large, has to stand
    in one task. What is drawn of a source is all up to a cut in the order of
    the hash, and one document more; with a row for each source every document
    then tells for itself whether it is taken, and no text moves.

    Returns the input's columns and size, source_size, target, copies, taken
    (an input column of one of these names is replaced). A null source is a
    source; a null text has size 0; a source without weight gets target 0;
    documents without words take 0. Rows that agree in all columns are drawn
    one by one; of rows of one doc_id and source only the numbers stand in one
    task. Null ids are drawn by the row's hash. An empty table gives an empty
    result.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    maps = [c for c in names if "map<" in docs.schema[c].dataType.simpleString()]
    tie = F.xxhash64(*[F.col(c) for c in names if c not in maps], *[F.to_json(F.struct(c)) for c in maps])
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), tie.cast("string"))))
    rows = docs.select("source", F.struct(*names).alias("doc"), word_count(F.col("text")).alias("size"), F.struct(draw.alias("draw"), tie.alias("tie")).alias("at"))
    slim = written(rows.select("source", "size", "at"), "mix-sizes")
    part = F.substring("at.draw", 1, GROUP_DIGITS).alias("part")
    groups = written(slim.groupBy("source", part).agg(F.sum("size").alias("size")), "mix-groups")
    sources = groups.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = cycled_weights(sources, cycle) if weights is None else weights.select("source", "weight")
    sources = written(
        sources.alias("s")
        .join(weights.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")), "left")
        .select("s.source", "source_size", F.coalesce(F.col("weight"), F.lit(0)).alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")),
        "mix-sources",
    )
    few = (lambda df: F.broadcast(df)) if sources.count() <= BROADCAST_SOURCES else (lambda df: df)
    if total is None:
        total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = water_level(sources, total)

    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.select("source", "source_size", target.alias("target"), whole.alias("whole"), (target - whole * F.col("source_size")).alias("rest"))

    before = F.sum("size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("source", "part", F.coalesce(before, F.lit(0)).alias("before"))
    groups = groups.alias("g").join(few(sources.select("source", "rest")).alias("s"), F.col("g.source").eqNullSafe(F.col("s.source"))).select("g.source", "part", "before", "rest")
    order = Window.partitionBy("source", "part").orderBy("at")
    # nth: a row's place among those that agree in all columns
    nth = F.row_number().over(order) - F.rank().over(order) + 1
    placed = slim.withColumn("part", part).withColumns({"nth": nth, "upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.alias("r").join(groups.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part"))).drop(F.col("p.source"), F.col("p.part"))
    placed = placed.withColumn("upto", F.col("before") + F.col("upto")).select("source", "at", "nth", "size", "upto", "rest", ((F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))).alias("fits"))
    placed = written(placed, "mix-places")
    cuts = placed.groupBy("source").agg(
        F.max("rest").alias("rest"), F.max(F.when(F.col("fits"), F.col("upto")).otherwise(F.lit(0))).alias("filled"), F.max(F.when(F.col("fits"), F.struct("at", "nth"))).alias("cut")
    )
    cuts = written(cuts.select("source", F.col("cut.at").alias("cut"), F.col("cut.nth").alias("cut_nth"), (F.col("rest") - F.col("filled")).alias("gap")), "mix-cuts")
    last = (
        placed.where("not fits").select("source", "at", "nth", "size").alias("r")
        .join(few(cuts.select("source", "gap")).alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
        .where(F.col("size") < 2 * F.col("gap"))
        .groupBy("r.source")
        .agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("miss"), "at", "nth")).alias("last"))
        .select(F.col("source").alias("last_source"), F.col("last.at").alias("one"), F.col("last.nth").alias("one_nth"))
    )
    sources = sources.alias("s").join(cuts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source"))).select("s.source", "source_size", "target", "whole", "cut", "cut_nth")
    sources = sources.join(last, F.col("source").eqNullSafe(F.col("last_source")), "left").drop("last_source")
    sources = written(sources.withColumnRenamed("source", "of_source"), "mix-cuts")

    drawn = rows.join(few(sources), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    at_cut = F.coalesce(F.col("at") == F.col("cut"), F.lit(False)) | F.coalesce(F.col("at") == F.col("one"), F.lit(False))
    repeats = placed.where("nth > 1").join(few(sources.select("of_source", "cut", "one")), F.col("source").eqNullSafe(F.col("of_source"))).where(at_cut)
    if repeats.isEmpty():
        drawn = drawn.withColumn("nth", F.lit(1))
    else:  # of equal rows at the cut the first so many are taken; they can't be told apart, so they are counted and listed anew
        kept = [c for c in drawn.columns if c not in ("source", "at")]
        listed = drawn.where(at_cut).groupBy("source", "at").agg(F.count("*").cast("int").alias("n"), *[F.first(c).alias(c) for c in kept])
        listed = listed.withColumn("nth", F.explode(F.sequence(F.lit(1), "n"))).drop("n")
        drawn = drawn.where(~at_cut).withColumn("nth", F.lit(1)).unionByName(listed)
    taken = (F.col("at") < F.col("cut")) | ((F.col("at") == F.col("cut")) & (F.col("nth") <= F.col("cut_nth")))
    more = (F.col("at") == F.col("one")) & (F.col("nth") == F.col("one_nth"))
    copies = F.col("whole") + F.when(F.coalesce(taken, F.lit(False)) | F.coalesce(more, F.lit(False)), 1).otherwise(0)
    return drawn.select("doc.*", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: ``columns`` of each document, as often as ``copies`` says."""
    rows = mixed.select(F.struct(*columns).alias("doc"), F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))))
    return rows.select("doc.*")
