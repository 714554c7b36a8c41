"""From the tokens of two-page spreads to flagged records."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import padded, share
from ..operators import cells as C
from ..operators import choose, grid, records, review, windows
from ..sources.layouts import layout_columns

KEYS = ["source_file", "start_page"]


def page_boxes(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """The box of every cell of every page, from the page's own row grid. [GEO5, GEO8]"""
    page = [*KEYS, "side"]
    bounds = windows.row_bounds(grid.row_centres(tokens, pages, page), page)
    columns = layout_columns(pages.sparkSession).where("field <> 'row_no'")
    wide = bounds.join(pages.select(*page, "width", "height"), page).join(F.broadcast(columns), "side")  # 17 fields
    left, right = share(F.col("width"), F.col("start_ratio")), share(F.col("width"), F.col("end_ratio"))
    box = padded(F.col("field"), left, right, F.col("top"), F.col("bottom"), F.col("width"), F.col("height"))
    return wide.select(*page, "row_no", "field", box.alias("box")).select(*page, "row_no", "field", "box.*")


def extract(tokens: DataFrame, pages: DataFrame, names: Iterable[str] = (), client: Callable[[str], str] | None = None, readings: DataFrame | None = None) -> DataFrame:
    """Records of all spreads.

    ``tokens`` are those of each page (source_file, start_page, side and the
    token columns); ``pages`` has each page's size and layout. ``readings``,
    where cells were read again, has row_no, field, cell_text, cell_confidence
    and cell_engine. ``client`` reviews weak records. Everything is keyed by
    spread, so all spreads go through at once.
    """
    page = [*KEYS, "side"]
    tokens = C.visible_tokens(tokens)
    boxes = page_boxes(tokens, pages)
    read = C.cell_texts(tokens, boxes, page, ["row_no", "field"]).select(*KEYS, "row_no", "field", F.col("text").alias("token_text"), F.col("confidence").alias("token_confidence"))
    found = boxes.select(*KEYS, "row_no", "field").join(read, [*KEYS, "row_no", "field"], "left")
    if readings is None:
        found = found.withColumns({"cell_text": F.lit(None).cast("string"), "cell_confidence": F.lit(None).cast("double"), "cell_engine": F.lit(None).cast("string")})
    else:
        found = found.join(readings, [*KEYS, "row_no", "field"], "left")
    spine = C.row_spine(pages.where("side = 'left'").select(*KEYS, "row_start", "expected_rows"), KEYS)
    raw = records.split_units(C.assembled(spine, choose.resolved(found), KEYS))
    raw = raw.withColumns({"page_number": F.concat(F.col("start_page").cast("string"), F.lit("-"), (F.col("start_page") + 1).cast("string"))})
    final = records.finalize(raw, KEYS, names)
    return final if client is None else review.reviewed(final, KEYS, names, client)
