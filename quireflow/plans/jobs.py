"""From page images to records and rows: the operators composed, over all pages of all files at once.

``pages`` has source_file, page_number, height, width, nChannels and data, as
``files.rendered_pages`` gives them. Recognisers are passed in (see
``operators.engines``). What is read more than once, above all what engines
answer, is written under ``work``, a folder that driver and executors share.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import cells, choose, engines, grid, images, records, windows
from ..sources.layouts import FAMILIES, layout_columns, layouts, spread_names
from . import imports, spread

SIDE = [*spread.KEYS, "side"]
_TABLE = "table_x int, table_y int, width int, height int, nChannels int, data binary, binary binary"
Readers = dict[str, Callable[[], Callable]]


def kept(df: DataFrame, work: str, name: str) -> DataFrame:
    """``df`` written under ``work`` and read back."""
    path = f"{work.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    logging.info("wrote %s", path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _by_row(df: DataFrame, names: list[str], made: str, rows_of: Callable[[dict], Iterable[tuple]]) -> DataFrame:
    """The columns ``names`` of each row beside the columns ``made`` of the rows that it gives."""
    columns = [*names, *(part.split()[0] for part in made.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield pd.DataFrame([(*(row[c] for c in names), *new) for new in rows_of(row)], columns=columns)

    return df.mapInPandas(run, f"{_schema(df, names)}, {made}")


def _table_of(row: dict, box_of: Callable[[np.ndarray], tuple | None], denoise: bool) -> Iterator[tuple]:
    """A page's table: its place and its gray and ink images; the whole page where none is found."""
    image = images.decoded(row["height"], row["width"], row["nChannels"], row["data"])
    gray, binary = images.page_images(image, denoise)
    x, y, w, h = box_of(binary) or (0, 0, binary.shape[1], binary.shape[0])
    gray, binary = images.crop(gray, x, y, w, h), images.crop(binary, x, y, w, h)
    yield x, y, gray.shape[1], gray.shape[0], 1, gray.tobytes(), binary.tobytes()


def spread_tables(pages: DataFrame, layout: str = "madras_exports_auto", denoise: bool = True) -> DataFrame:
    """The tables of spreads, left and right, with their layouts. Pages of starts that a family has no layout for are left out. [SRC2, SRC8, JN13, GEO3, GEO4, IMG6, IMG17]"""
    start = F.col("page_number") - F.pmod(F.col("page_number") + 1, F.lit(2))
    sides = pages.withColumns({"start_page": start, "side": F.when(F.col("page_number") % 2 == 1, "left").otherwise("right")})
    meant = F.col("start_page") if layout in FAMILIES else F.lit(spread_names()[layout])
    presets = layouts(pages.sparkSession).withColumnsRenamed({"start": "_start", "side": "_side"})
    placed = sides.join(F.broadcast(presets), (meant == F.col("_start")) & (F.col("side") == F.col("_side")))  # 10 rows

    def rows_of(row: dict) -> Iterator[tuple]:
        def box(binary: np.ndarray) -> tuple | None:
            h, w = binary.shape
            own = int(w * row["bbox_x"]), int(h * row["bbox_y"]), int(w * row["bbox_w"]), int(h * row["bbox_h"])
            return own if own[2] > 0 and own[3] > 0 else images.table_box(binary)

        return _table_of(row, box, denoise)

    names = [*SIDE, "page_number", "body_top", "body_bottom", "strip_start", "strip_end", "expected_rows", "row_start"]
    return _by_row(placed, names, _TABLE, rows_of)


def _crops(tables: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The images in boxes (row_no, field, ord, variant, box) of each table, and whether they look blank. [GEO4, IMG13, PRD11]"""
    listed = boxes.groupBy(*keys).agg(F.collect_list(F.struct("row_no", "field", "ord", "variant", "box.*")).alias("boxes"))  # a page's cells each
    made = "row_no int, field string, at int, variant string, likely_blank boolean, height int, width int, nChannels int, data binary"

    def rows_of(row: dict) -> Iterator[tuple]:
        gray, ink = (images.decoded(row["height"], row["width"], 1, row[c]) for c in ("data", "binary"))
        for b in row["boxes"]:
            at = (slice(b["top"], b["bottom"]), slice(b["left"], b["right"]))
            cut = gray[at]
            yield b["row_no"], b["field"], b["ord"], b["variant"], images.cell_features(ink[at])["likely_blank"], *cut.shape, 1, cut.tobytes()

    return _by_row(tables.join(listed, keys), keys, made, rows_of)


def spread_readings(tables: DataFrame, tokens: DataFrame, work: str, readers: Readers, names: Iterable[str], all_engines: bool = True) -> DataFrame:
    """What doubtful cells read by themselves: row_no, field, cell_text, cell_confidence, cell_engine. [PRD9, PRD10, GEO7, GEO9, UDF3, UDF8, TOP4]

    The first box of each cell is read first; the others only of cells whose
    first reading doesn't end the search.
    """
    bounds = windows.row_bounds(grid.row_centres(tokens, tables, SIDE), SIDE)
    boxes = spread.page_boxes(tokens, tables)
    read = cells.cell_texts(tokens, boxes, SIDE, ["row_no", "field"]).select(*SIDE, "row_no", "field", F.col("text").alias("token_text"), F.col("confidence").alias("token_confidence"))
    asked = choose.cells_to_read(boxes.select(*SIDE, "row_no", "field").join(read, [*SIDE, "row_no", "field"], "left"))
    rows, columns = bounds.join(tables.select(*SIDE, "width", "height"), SIDE), layout_columns(tables.sparkSession)
    own = records.union_all([geometry.reading_boxes(rows.where(F.col("side") == s), columns.where(F.col("side") == s)) for s in ("left", "right")])
    sized = asked.join(own, [*SIDE, "row_no", "field"]).join(tables.select(*SIDE, "width", "height"), SIDE)
    variants = geometry.variants(F.col("field"), F.col("box"), F.col("width"), F.col("height"))
    tried = kept(sized.select(*SIDE, "row_no", "field", F.inline(variants)), work, "cell-boxes")
    cell = [*SIDE, "row_no", "field"]

    def answers(boxes: DataFrame, name: str) -> DataFrame:
        crops = kept(_crops(tables, boxes, SIDE), work, f"{name}-crops")
        candidates = kept(engines.cell_readings(crops.where("not likely_blank"), readers, [*cell, "at"], all_engines), work, f"{name}-candidates")
        chosen = engines.chosen_readings(candidates, crops.select(*cell, "at"), [*cell, "at"], names)
        return crops.select(*cell, "at", "variant", "likely_blank").join(chosen, [*cell, "at"]).select(*cell, F.col("at").alias("ord"), "variant", "likely_blank", F.col("cell_text").alias("text"), F.col("cell_confidence").alias("confidence"), F.col("cell_engine").alias("engine"))

    first = kept(answers(tried.where("ord = 0"), "first"), work, "first-readings")
    again = choose.doubtful_first(first, cell)
    rest = kept(answers(tried.where("ord > 0").join(again, cell, "left_semi"), "more"), work, "more-readings")
    best = choose.best_variant(first.unionByName(rest), cell)
    return best.select(*spread.KEYS, "row_no", "field", F.col("text").alias("cell_text"), F.col("confidence").alias("cell_confidence"), F.col("engine").alias("cell_engine"))


def spread_records(
    pages: DataFrame,
    work: str,
    page_readers: Readers,
    cell_readers: Readers,
    names: Iterable[str] = (),
    client: Callable[[str], str] | None = None,
    *,
    layout: str = "madras_exports_auto",
    backend: str = "auto",
    denoise: bool = True,
) -> DataFrame:
    """Flagged records of all spreads, from their pages' images."""
    tables = kept(spread_tables(pages, layout, denoise), work, "tables")
    found = kept(engines.page_tokens(tables, page_readers, SIDE), work, "tokens")
    tokens = kept(cells.visible_tokens(engines.chosen_tokens(found, SIDE, backend).drop("engine")), work, "chosen-tokens")
    readings = spread_readings(tables, tokens, work, cell_readers, list(names)) if cell_readers else None
    return spread.extract(tokens, tables, names, client, readings)


def import_tables(pages: DataFrame, denoise: bool = True) -> DataFrame:
    """The tables of single pages, by their rules. [IMG6, IMG18, GEO4]"""
    return _by_row(pages, imports.KEYS, _TABLE, lambda row: _table_of(row, images.import_table_box, denoise))


def table_profiles(tables: DataFrame) -> DataFrame:
    """Each table's rule profiles: axis, position, value. [IMG19, IMG20]"""

    def rows_of(row: dict) -> Iterator[tuple]:
        binary = images.decoded(row["height"], row["width"], 1, row["binary"])
        for axis in "xy":
            yield from ((axis, i, v) for i, v in enumerate(images.rule_profile(binary, axis).tolist()))

    return _by_row(tables, imports.KEYS, "axis string, position int, value double", rows_of)


def strip_tokens(tables: DataFrame, columns: DataFrame, readers: Readers) -> DataFrame:
    """What every reader finds in the strips of narrow columns: index, text, confidence, y, height, pos. [IMG21, PRD17]"""
    narrow = grid.narrow_columns(columns).groupBy(*imports.KEYS).agg(F.sort_array(F.collect_list(F.struct("index", "left", "right"))).alias("strips"))

    def rows_of(row: dict) -> Iterator[tuple]:
        gray, asked = images.decoded(row["height"], row["width"], 1, row["data"]), engines.Engines(readers)
        for s in row["strips"]:
            strip, pos = images.number_strip(gray[:, max(0, s["left"] - 4) : s["right"] + 4]), 0
            for name in readers:
                for text, confidence, _, y, _, height in asked.ask(name, strip) or ():
                    yield s["index"], text, float(confidence), float(y), float(height), pos
                    pos += 1

    return _by_row(tables.join(narrow, imports.KEYS), imports.KEYS, "index int, text string, confidence double, y double, height double, pos int", rows_of)


def import_rows(pages: DataFrame, work: str, page_readers: Readers, strip_readers: Readers, *, denoise: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows (a column for each that some page has) and headers of all pages, from their images. [NUM11, TXT20]"""
    tables = kept(import_tables(pages, denoise), work, "tables")
    profiles = kept(table_profiles(tables), work, "profiles")
    sizes = tables.select(*imports.KEYS, F.col("width").alias("page_width"))
    columns = kept(grid.column_intervals(profiles.where("axis = 'x'").drop("axis"), sizes, imports.KEYS), work, "columns")
    peaks = grid.rule_peaks(profiles.where("axis = 'y'").drop("axis"), imports.KEYS)
    candidates = kept(grid.strip_candidates(strip_tokens(tables, columns, strip_readers), columns, imports.KEYS), work, "candidates")
    found = kept(engines.page_tokens(tables, page_readers, imports.KEYS), work, "tokens")
    tokens = cells.visible_tokens(engines.chosen_tokens(found, imports.KEYS, "tesseract").drop("engine"))
    stem = F.regexp_replace(F.regexp_extract("source_file", r"([^/]+)$", 1), r"\.[^.]*$", "")
    known = imports.with_starts(tables.select(*imports.KEYS, "width", "height", stem.alias("stem"))).drop("stem")
    rows, headers = imports.page_rows(tokens, candidates, columns, known, peaks)
    return imports.wide(kept(rows, work, "cells")), headers
