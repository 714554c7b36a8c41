"""Comparison of records with a golden table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import comparable


def comparable_fields(truth: DataFrame, predicted: DataFrame, key: str = "row_no") -> list[str]:
    """The golden table's columns, in order, that the other has, without the key. [SET4]"""
    for df in (truth, predicted):
        if key not in df.columns:
            raise ValueError(f"both tables must have a column {key}")  # [PRD18]
    return [c for c in truth.columns if c != key and c in predicted.columns]


def joined(truth: DataFrame, predicted: DataFrame, key: str = "row_no") -> DataFrame:
    """Rows of equal key side by side, a struct (expected, actual) for each field. [JN1, TXT16]"""
    fields = comparable_fields(truth, predicted, key)
    rows = truth.alias("t").join(predicted.alias("p"), key)
    return rows.select(key, *[F.struct(comparable(F.col(f"t.{f}")).alias("expected"), comparable(F.col(f"p.{f}")).alias("actual")).alias(f) for f in fields])


def field_matches(truth: DataFrame, predicted: DataFrame, key: str = "row_no") -> DataFrame:
    """For each field how many joined rows agree: field, matches, joined; field * counts rows that agree throughout. [AGG15]"""
    fields = comparable_fields(truth, predicted, key)
    agree = {f: F.col(f"{f}.expected") == F.col(f"{f}.actual") for f in fields}
    everywhere = reduce(lambda a, b: a & b, agree.values(), F.lit(True))
    counts = joined(truth, predicted, key).agg(F.count("*").alias("_n"), *[F.count_if(test).alias(f) for f, test in agree.items()], F.count_if(everywhere).alias("*"))
    return counts.unpivot(["_n"], [F.col(f"`{c}`") for c in (*fields, "*")], "field", "matches").select("field", "matches", F.col("_n").alias("joined"))


def differences(truth: DataFrame, predicted: DataFrame, key: str = "row_no") -> DataFrame:
    """The fields that differ: key, field, expected, actual. [DIF1]"""
    fields = comparable_fields(truth, predicted, key)
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.expected").alias("expected"), F.col(f"{f}.actual").alias("actual")) for f in fields])
    return joined(truth, predicted, key).select(key, F.inline(listed)).where("expected <> actual")
