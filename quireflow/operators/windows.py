"""Order-dependent operators: fills, groups of neighbours, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DITTO, clean_spaces


def fill_dittos(df: DataFrame, fields: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Ditto marks become the last value before them that is neither blank nor a mark, "" if there is none. [WIN1]

    Blanks stay blank and don't end what a mark refers to.
    """
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def filled(field: str) -> Column:
        value = clean_spaces(F.col(field))
        ditto = F.lower(value).isin(DITTO)
        last = F.last(F.when(~ditto & (value != ""), value), ignorenulls=True).over(before)
        return F.when(ditto, F.coalesce(last, F.lit(""))).otherwise(value)

    return df.withColumns({f: filled(f) for f in fields})


def islands(df: DataFrame, keys: list[str], position: str, tolerance: Column | int) -> DataFrame:
    """Numbers the groups of positions that lie within ``tolerance`` of the one before: column island. [WIN2]"""
    order = Window.partitionBy(*keys).orderBy(position)
    gap = F.col(position) - F.lag(position).over(order)
    starts = F.when(gap.isNull() | (gap > tolerance), 1).otherwise(0)
    return df.withColumn("_starts", starts).withColumn("island", F.sum("_starts").over(order)).drop("_starts")


def group_centres(df: DataFrame, keys: list[str], position: str, tolerance: Column | int, *, whole: bool = True) -> DataFrame:
    """The mean position of each island, rounded half to even unless ``whole`` is False. [AGG12]"""
    mean = F.avg(position)
    return islands(df, keys, position, tolerance).groupBy(*keys, "island").agg((F.bround(mean).cast("int") if whole else mean).alias(position))


def intervals(df: DataFrame, keys: list[str], position: str, least: Column | int) -> DataFrame:
    """Neighbouring positions as left and right, those at least ``least`` apart, numbered from 0: column index. [WIN3, WIN6]"""
    order = Window.partitionBy(*keys).orderBy(position)
    pairs = df.select(*keys, F.col(position).alias("left"), F.lead(position).over(order).alias("right")).where(F.col("right") - F.col("left") >= least)
    return pairs.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy("left")) - 1)


def row_bounds(centres: DataFrame, keys: list[str], row_no: str = "row_no", centre: str = "centre", height: str = "height") -> DataFrame:
    """Top and bottom of each row: half-way to its neighbours, half a median gap at the ends, cut to the page. [GEO10]

    A page with one row gets ten pixels on either side.
    """
    order, page = Window.partitionBy(*keys).orderBy(row_no), Window.partitionBy(*keys)
    c = F.col(centre)
    gaps = centres.withColumns({"_above": F.lag(centre).over(order), "_below": F.lead(centre).over(order)})
    gaps = gaps.withColumn("_gap", F.expr("percentile(_below - " + centre + ", 0.5)").over(page))
    alone = F.col("_gap").isNull()
    top = F.when(alone, c.cast("int") - 10).when(F.col("_above").isNull(), F.greatest(F.lit(0.0), c - F.col("_gap") / 2).cast("int")).otherwise(((F.col("_above") + c) / 2).cast("int"))
    bottom = F.when(alone, c.cast("int") + 10).when(F.col("_below").isNull(), F.least(F.col(height).cast("double"), c + F.col("_gap") / 2).cast("int")).otherwise(((c + F.col("_below")) / 2).cast("int"))
    return gaps.select(*keys, row_no, F.greatest(F.lit(0), top).alias("top"), F.least(F.col(height).cast("int"), bottom).alias("bottom"))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. [WIN7]"""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def last_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. [WIN8]"""
    return first_of(df, keys, [F.desc(c) for c in order])


def batched(df: DataFrame, keys: list[str], order: list[str], size: int = 6) -> DataFrame:
    """Numbers batches of ``size`` rows within a key: column batch. [WIN9]"""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("batch", F.floor(place / size).cast("int"))


def opened(df: DataFrame, keys: list[str], position: str, value: str, reach: int) -> DataFrame:
    """One-dimensional opening: the least value within ``reach`` on both sides, then the greatest of those: column opened. [WIN10]"""
    near = Window.partitionBy(*keys).orderBy(position).rowsBetween(-reach, reach)
    return df.withColumn("_low", F.min(value).over(near)).withColumn("opened", F.max("_low").over(near)).drop("_low")


def profile_threshold(df: DataFrame, keys: list[str], value: str, percentile: float, share: float) -> DataFrame:
    """Rows at or above the greater of a percentile and a share of the key's greatest value. [AGG10]"""
    page = Window.partitionBy(*keys)
    least = F.greatest(F.expr(f"percentile({value}, {percentile})").over(page), F.max(value).over(page) * share)
    return df.withColumn("_least", least).where(F.col(value) >= F.col("_least")).drop("_least")
