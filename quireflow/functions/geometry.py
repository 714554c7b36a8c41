"""Boxes on a page. A box is a struct of left, right, top, bottom in whole pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PRIMARY_FIELDS

VARIANTS = ["base", "wider", "taller", "wide_tall", "shift_left", "shift_right"]
#: Fields whose boxes are tried in three forms only.
FEW_VARIANTS = ["foreign_duty_rs", "foreign_duty_as", "foreign_duty_p", "indian_duty_rs", "indian_duty_as", "indian_duty_p"]


def centre(start: Column, size: Column) -> Column:
    """[GEO1]"""
    return start + size / 2.0


def share(size: Column, ratio: Column | float) -> Column:
    """A ratio of a length, cut to whole pixels. [GEO2, GEO5]"""
    return (size * ratio).cast("int")


def box(left: Column, right: Column, top: Column, bottom: Column) -> Column:
    return F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"), top.cast("int").alias("top"), bottom.cast("int").alias("bottom"))


def chosen_table(template: Column, ruled: Column) -> Column:
    """A layout's own table (x, y, width, height), or the one found by rules where that has no area. [GEO3]"""
    return F.when((template["width"] > 0) & (template["height"] > 0), template).otherwise(ruled)


def clipped(left: Column, right: Column, top: Column, bottom: Column, width: Column, height: Column) -> Column:
    """A box inside an image, a pixel wide and high at least. [GEO6]"""
    x0, y0 = F.least(F.greatest(F.lit(0), left), width - 1), F.least(F.greatest(F.lit(0), top), height - 1)
    return box(x0, F.greatest(x0 + 1, F.least(width, right)), y0, F.greatest(y0 + 1, F.least(height, bottom)))


def padded(field: Column, left: Column, right: Column, top: Column, bottom: Column, width: Column, height: Column, wide_article: Column | None = None) -> Column:
    """A cell's box without its borders. [GEO7, GEO8]

    ``wide_article`` marks boxes that span the article and its unit.
    """
    primary = field.isin(PRIMARY_FIELDS)
    x = F.when(primary, 0.02).otherwise(0.03)
    if wide_article is not None:
        x = F.when(wide_article, 0.015).otherwise(x)
    pad_x = F.greatest(F.lit(1), share(right - left, x))
    pad_y = F.greatest(F.lit(1), share(bottom - top, F.when(primary, 0.06).otherwise(0.08)))
    return clipped(left + pad_x, right - pad_x, top + pad_y, bottom - pad_y, width, height)


def variants(field: Column, base: Column, width: Column, height: Column) -> Column:
    """The boxes that a cell is read in: array of ord, variant, box; equal boxes stand once, the first. [GEO9]"""
    left, right, top, bottom = (base[c] for c in ("left", "right", "top", "bottom"))
    dx = F.greatest(F.lit(2), share(right - left, F.when(field == "article", 0.06).otherwise(0.04)))
    dy = F.greatest(F.lit(2), share(bottom - top, F.when(field == "article", 0.18).otherwise(0.12)))
    move = lambda a, b, c, d: clipped(left + a * dx, right + b * dx, top + c * dy, bottom + d * dy, width, height)
    boxes = [base, move(-1, 1, 0, 0), move(0, 0, -1, 1), move(-1, 1, -1, 1), move(-1, -1, 0, 0), move(1, 1, 0, 0)]
    item = lambda i: F.struct(F.lit(i).alias("ord"), F.lit(VARIANTS[i]).alias("variant"), boxes[i].alias("box"))
    tried = F.when(field.isin(FEW_VARIANTS), F.array(*map(item, (0, 1, 5)))).otherwise(F.array(*map(item, range(6))))
    seen = lambda found: F.transform(found, lambda v: v["box"])
    once = lambda found: F.filter(found, lambda v, i: F.array_position(seen(found), v["box"]) == i + 1)
    return F.transform(F.array(tried), once)[0]


def reading_boxes(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The box in which each cell is read by itself: column box. An article's spans the unit's column too. [GEO5, GEO7]

    ``rows`` has width and height of the page and the row's top and bottom;
    ``columns`` is a side's (field, start_ratio, end_ratio).
    """
    unit = columns.where("field = 'unit'").select(F.lit("article").alias("field"), F.col("end_ratio").alias("_unit_end"))
    spans = columns.where("field <> 'row_no'").join(unit, "field", "left")  # the columns of a side: nine
    spans = spans.agg(F.collect_list(F.struct("field", "start_ratio", F.coalesce("_unit_end", "end_ratio").alias("end_ratio"), F.col("_unit_end").isNotNull().alias("spans"))).alias("c")).first()["c"]
    listed = F.array(*[F.struct(F.lit(c["field"]).alias("field"), F.lit(c["start_ratio"]).alias("start_ratio"), F.lit(c["end_ratio"]).alias("end_ratio"), F.lit(c["spans"]).alias("spans")) for c in spans])
    wide = rows.select("*", F.inline(listed))
    left, right = share(F.col("width"), F.col("start_ratio")), share(F.col("width"), F.col("end_ratio"))
    box_ = padded(F.col("field"), left, right, F.col("top"), F.col("bottom"), F.col("width"), F.col("height"), F.col("spans"))
    return wide.withColumn("box", box_).drop("width", "height", "top", "bottom", "start_ratio", "end_ratio", "spans")
