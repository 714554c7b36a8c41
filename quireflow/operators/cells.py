"""From tokens on a page to cells, and from cells to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NOISE_TOKENS, basic, clean_spaces, is_placeholder, split_article_and_unit
from ..schema import LEFT_FIELDS, RIGHT_FIELDS, is_number

#: Height of the strips that tokens and boxes meet in.
STRIP = 64


def visible_tokens(tokens: DataFrame, least: float = 0.15) -> DataFrame:
    """Tokens with text and enough confidence, their white space cleaned. [PRD2]"""
    return tokens.withColumn("text", clean_spaces(F.col("text"))).where((F.col("text") != "") & (F.col("confidence") >= least))


def tokens_in_boxes(tokens: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Each token with each box of its page that its centre lies in, edges included. [JN2, JN3]

    Boxes are listed under the strips they touch, so that a token meets the
    boxes of its strip and not all of its page; the join is by page and strip.
    """
    strip = lambda y: F.floor(y / STRIP).cast("int")
    centres = tokens.withColumns({"_x": F.col("x") + F.col("width") / 2.0, "_y": F.col("y") + F.col("height") / 2.0})
    centres = centres.withColumn("_strip", strip(F.col("_y")))
    listed = boxes.withColumn("_strip", F.explode(F.sequence(strip(F.col("top")), F.greatest(strip(F.col("bottom")), strip(F.col("top"))))))
    inside = F.col("_x").between(F.col("left"), F.col("right")) & F.col("_y").between(F.col("top"), F.col("bottom"))
    return centres.join(listed, [*keys, "_strip"]).where(inside).drop("_x", "_y", "_strip")


def reading_order(texts: list[str] | None = None) -> Column:
    """A group's tokens by y, then x, then their place on the page, as an array of structs. [AGG2, SRT1]"""
    return F.array_sort(F.collect_list(F.struct("y", "x", "pos", *(texts or ["text"]))))


def joined_tokens(ordered: Column, numeric: Column | bool) -> Column:
    """The text of ordered tokens: numbers run together without tokens that have no digit, other text by spaces without noise. [AGG3]"""
    texts = F.filter(F.transform(ordered, lambda t: clean_spaces(t["text"])), lambda t: (t != "") & ~is_placeholder(t))
    digits = F.array_join(F.filter(texts, lambda t: t.rlike(r"\d")), "")
    plain = basic(F.array_join(F.filter(texts, lambda t: ~F.lower(t).isin(NOISE_TOKENS)), " "))
    return F.when(F.lit(numeric) if isinstance(numeric, bool) else numeric, digits).otherwise(plain)


def cell_texts(tokens: DataFrame, boxes: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """Text and mean confidence of each box that holds tokens. ``boxes`` has the columns of ``cell``, one of them field. [AGG1-3]"""
    inside = tokens_in_boxes(tokens, boxes, keys)
    found = inside.groupBy(*keys, *cell).agg(reading_order().alias("_tokens"), F.avg("confidence").alias("confidence"))
    numeric = F.col("field").isin([f for f in LEFT_FIELDS + RIGHT_FIELDS if is_number(f)])
    return found.withColumn("text", joined_tokens(F.col("_tokens"), numeric)).drop("_tokens")


def split_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row_no, field, text, engine) after units left articles; an article that changed says so in its engine. [TXT12, SCR6]"""
    row = Window.partitionBy(*keys, "row_no")
    text_of = lambda field: F.coalesce(F.max(F.when(F.col("field") == field, F.coalesce("text", F.lit("")))).over(row), F.lit(""))
    cells = cells.withColumns({"_article": text_of("article"), "_unit": text_of("unit")}).withColumn("_parts", split_article_and_unit(F.col("_article"), F.col("_unit")))
    changed = (F.col("field") == "article") & (F.col("_parts.article") != F.col("_article"))
    text = F.when(F.col("field") == "article", F.col("_parts.article")).when(F.col("field") == "unit", F.col("_parts.unit")).otherwise(F.col("text"))
    engine = F.when(changed & (F.col("engine") != ""), F.concat("engine", F.lit("+row_split"))).otherwise(F.col("engine"))
    return cells.withColumns({"engine": engine, "text": text}).drop("_article", "_unit", "_parts")


def row_spine(spreads: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each expected row number of a spread (row_start, expected_rows). [JN4]"""
    last = F.col("row_start") + F.col("expected_rows") - 1
    return spreads.select(*keys, F.explode(F.sequence(F.col("row_start"), last)).alias("row_no"))


def assembled(spine: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """One record a row number: the cells of both pages side by side, blank where none was read. [JN4]

    Also the mean of the fields' confidences and the rows' raw text.
    """
    fields = LEFT_FIELDS + RIGHT_FIELDS
    wide = cells.groupBy(*keys, "row_no").pivot("field", fields).agg(F.first("text"))
    mean = cells.groupBy(*keys, "row_no").agg(F.avg("confidence").alias("mean_confidence"))
    rows = spine.join(wide, [*keys, "row_no"], "left").join(mean, [*keys, "row_no"], "left")
    return raw_text(rows.withColumns({f: F.coalesce(F.col(f), F.lit("")) for f in fields}))


def raw_text(rows: DataFrame) -> DataFrame:
    """Adds raw_ocr_text: every field as it was read, before cleaning. [TXT15]"""
    parts = ["row_no", *LEFT_FIELDS, *RIGHT_FIELDS]
    shown = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in parts]
    return rows.withColumn("raw_ocr_text", F.concat_ws(" | ", *shown, F.lit("llm_notes=")))


def surviving(debug: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``debug`` that have a record. [JN10, PRD13]"""
    return debug.join(records.select(*keys).distinct(), keys, "left_semi")


def debug_tree(cells: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """A row's cells as a map from field to text, confidence, engine, crop_box and the engines' readings, with its anchors. [JSN5, JN12]

    Of an engine's readings the last one counts.
    """
    readings = F.map_from_entries(F.collect_list(F.struct("field", F.struct("text", "confidence", "engine", "crop_box", "all").alias("cell"))))
    tree = cells.groupBy(*keys, "row_no").agg(readings.alias("cells"), F.avg("confidence").alias("mean_confidence"))
    return tree.join(anchors, [*keys, "row_no"], "left")


def readings_by_engine(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Map from engine (its name up to a colon) to the last of its readings: column all. [JSN6]"""
    named = readings.withColumn("engine", F.split_part("engine", F.lit(":"), F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys, "engine").orderBy(F.desc("ord")))
    last = named.withColumn("_n", place).where("_n = 1")
    return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "text")))).alias("all"))
