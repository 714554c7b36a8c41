"""From the tokens and rules of single pages to rows of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_kind
from ..operators import grid, windows
from ..operators.records import union_all
from ..sources.layouts import import_starts

KEYS = ["source_file", "page_number"]


def with_starts(pages: DataFrame) -> DataFrame:
    """Pages (stem, page_number) with expected_start, the first row that is known of them, or null. [SRC9, JN13]"""
    return pages.drop("expected_start").join(F.broadcast(import_starts(pages.sparkSession)), ["stem", "page_number"], "left")  # 18 rows


def page_rows(tokens: DataFrame, candidates: DataFrame, columns: DataFrame, pages: DataFrame, peaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (long form) and headers of pages.

    ``candidates`` are the row numbers read in each page's strips (strip names
    the column index), ``columns`` its column intervals with page_width,
    ``peaks`` its horizontal rules, ``pages`` its width, height and
    expected_start (null if unknown). Row numbers come from the best strip; a
    page without a plausible fit falls back to its rules if its first row is
    known, else becomes an error record.
    """
    strips = [*KEYS, "strip"]
    models = grid.refined_models(grid.pair_models(candidates, strips), candidates, strips)
    models = grid.best_strips(models, KEYS)
    fitted = grid.block_centres(models, pages, KEYS, "expected_start")
    missing = pages.where("expected_start is not null").join(fitted.select(*KEYS).distinct(), KEYS, "left_anti")
    ruled = grid.ruled_centres(peaks, missing.withColumnRenamed("expected_start", "row_start"), KEYS)
    centres = union_all([fitted, ruled])
    bounds = windows.row_bounds(centres, KEYS)
    edges = bounds.groupBy(*KEYS).agg(F.min_by("top", "row_no").alias("first_top"), F.min("row_no").alias("row_group_start"), F.max("row_no").alias("row_group_end"))

    row_columns = models.select(*KEYS, F.col("strip").alias("row_index"))
    named = grid.page_columns(tokens, columns, edges, KEYS, row_columns)
    band = pages.join(edges, KEYS).select(*KEYS, F.lit(0).alias("left"), F.col("width").alias("right"), "first_top")
    third = lambda n: F.floor(F.col("first_top") / n).cast("int")
    title = band.select(*KEYS, "left", "right", F.lit(0).alias("top"), F.greatest(F.lit(10), third(2)).alias("bottom"))
    role = band.select(*KEYS, "left", "right", F.greatest(F.lit(0), third(5)).alias("top"), F.greatest(F.lit(15), F.col("first_top") - 5).alias("bottom"))
    said = grid.text_in(tokens, title, KEYS, ["left", "right"], "title").join(grid.text_in(tokens, role, KEYS, ["left", "right"], "role"), [*KEYS, "left", "right"])
    said = said.select(*KEYS, "title", page_kind(F.col("role"), F.col("title")).alias("page_kind"))

    boxes = bounds.join(named.where("field <> 'row_no'"), KEYS).select(*KEYS, "row_no", "index", "field", "left", "right", "top", "bottom")
    values = grid.text_in(tokens, boxes, KEYS, ["row_no", "index", "field"], "value")
    key = F.when(F.col("field").isin("article", "unit"), F.col("field")).otherwise(F.format_string("col_%02d", "index"))
    cells = windows.last_of(values.withColumn("column", key), [*KEYS, "row_no", "column"], ["index"])
    cells = cells.join(said, KEYS).join(edges.drop("first_top"), KEYS)

    listed = F.array_sort(F.collect_list(F.struct("index", "header", "field"))).alias("columns")
    headers = named.groupBy(*KEYS).agg(listed).join(said, KEYS).join(edges.drop("first_top"), KEYS)
    lost = pages.join(edges.select(*KEYS), KEYS, "left_anti").select(*KEYS, F.lit("error").alias("page_kind"), F.lit("").alias("title"), F.lit("no row positions found").alias("error"))
    return cells, union_all([headers.withColumn("error", F.lit(None).cast("string")), lost])


def wide(cells: DataFrame) -> DataFrame:
    """Cells as one row a table row, with a column for every column that some page has. [TXT20, SET2]"""
    names = sorted(r["column"] for r in cells.select("column").distinct().collect())  # two digits number them: 102 at most
    fixed = [*KEYS, "page_kind", "title", "row_group_start", "row_group_end", "row_no"]
    rows = cells.groupBy(*fixed).pivot("column", names).agg(F.first("value"))
    return rows.na.fill("", names)
