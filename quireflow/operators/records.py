"""Cleaned and flagged records, their summary and their union."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clean_number
from ..functions.similarity import snap_articles
from ..functions.text import CATEGORIES, clean_text, split_article_and_unit
from ..schema import ANNAS_FIELDS, NUMBER_FIELDS, OUTPUT_COLUMNS, PIES_FIELDS, RATE_FIELDS, TEXT_FIELDS
from .windows import fill_dittos


def issue_flag(issues: list[Column]) -> Column:
    """"ok", or the issues that aren't null: review:, each once, sorted, parted by semicolons. [AGG16]"""
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*issues))))
    return F.when(F.size(found) == 0, "ok").otherwise(F.concat(F.lit("review:"), F.array_join(found, ";")))


def range_issues(max_annas: int = 15, max_pies: int = 3, fields: Iterable[str] = (*ANNAS_FIELDS, *PIES_FIELDS)) -> list[Column]:
    """Issues of amounts beyond their unit. [PRD6]"""
    out = []
    for f in fields:
        annas = f.endswith("_as")
        out.append(F.when(F.col(f) > (max_annas if annas else max_pies), "annas_out_of_range" if annas else "pies_out_of_range"))
    return out


def split_units(records: DataFrame) -> DataFrame:
    """Moves units out of articles. [TXT12]"""
    parts = records.withColumn("_parts", split_article_and_unit(F.col("article"), F.col("unit")))
    return parts.withColumns({"article": F.col("_parts.article"), "unit": F.col("_parts.unit")}).drop("_parts")


def finalize(records: DataFrame, keys: list[str], names: Iterable[str] = (), *, max_pies: int = 3) -> DataFrame:
    """Raw records cleaned and flagged. [FLG1]

    Texts and numbers are cleaned; ditto marks of the rates filled in row
    order; category rows left out; articles snapped to ``names``. Flags: a
    number that can't be read, annas above 15, pies above ``max_pies``, a mean
    confidence below 0.55, and a first row without an article of its own.
    """
    rows = records.withColumns({f: clean_text(F.col(f), f) for f in TEXT_FIELDS} | {f"_{f}": clean_number(F.col(f)) for f in NUMBER_FIELDS})
    rows = rows.withColumns({f: F.col(f"_{f}.value") for f in NUMBER_FIELDS} | {f"_bad_{f}": F.when(F.col(f"_{f}.suspicious"), f"{f}_non_numeric") for f in NUMBER_FIELDS})
    rows = fill_dittos(rows.drop(*[f"_{f}" for f in NUMBER_FIELDS]), RATE_FIELDS, keys, ["row_no"])
    rows = without_categories(rows)
    rows = snap_articles(rows, names)
    first = (F.col("row_no") == 1) & F.lower("article").isin("", "do", "do.")
    issues = [F.col(f"_bad_{f}") for f in NUMBER_FIELDS] + range_issues(max_pies=max_pies)
    issues += [F.when(F.col("mean_confidence") < 0.55, "low_ocr_confidence"), F.when(first, "first_article_unresolved")]
    rows = rows.withColumns({"confidence_flag": issue_flag(issues), "llm_notes": F.lit(None).cast("string")})
    return rows.drop(*[f"_bad_{f}" for f in NUMBER_FIELDS])


def without_categories(records: DataFrame, column: str = "article") -> DataFrame:
    """Rows that aren't headings of a category. [PRD5, JN11]"""
    return records.where(~F.coalesce(F.col(column), F.lit("")).isin(CATEGORIES))


def for_review(records: DataFrame) -> DataFrame:
    """Rows flagged for review. [PRD8]"""
    return records.where(F.coalesce("confidence_flag", F.lit("")).startswith("review:"))


def summary(records: DataFrame) -> DataFrame:
    """metric and value: rows in all, in order, for review. [AGG14]"""
    flag = F.coalesce("confidence_flag", F.lit(""))
    counts = records.agg(F.count("*").alias("rows_total"), F.count_if(flag == "ok").alias("rows_ok"), F.count_if(flag.startswith("review:")).alias("rows_review"))
    return counts.unpivot([], ["rows_total", "rows_ok", "rows_review"], "metric", "value")


def union_all(tables: Iterable[DataFrame]) -> DataFrame:
    """All rows of all tables by column name; columns that a table lacks are null. [SET1, SET2]"""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def output(records: DataFrame) -> DataFrame:
    """The record's columns in order; missing ones are null, others are left out. [SNK1]"""
    return records.select(*[F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in OUTPUT_COLUMNS])
