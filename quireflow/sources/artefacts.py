"""What shows how a page was read: lines of its grid as rows, drawn pages, PNG files."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.images import decoded, in_batches, over_images, three_channels

# Blue, green and red of each kind of line.
COLOURS = {"row": (0, 255, 0), "column": (255, 0, 0), "table": (0, 0, 255)}


def png(image: np.ndarray) -> bytes:
    """A gray image, or one of blue, green and red, as a PNG file; an image without pixels is an error. [SNK8]"""
    if not image.size:
        raise ValueError("an image without pixels has no PNG form")
    height, width = image.shape[:2]
    pixels = image if image.ndim == 2 else image[:, :, ::-1]
    # each line of pixels follows a byte that says that it isn't filtered
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)], axis=1)
    header = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    chunks = [(b"IHDR", header), (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data)) for kind, data in chunks)


def as_png(images: DataFrame) -> DataFrame:
    """origin, png and, as requests to vision models carry it, base64 of each image. [IMG16]"""
    return over_images(images, lambda image: [{"png": png(image)}], "png binary").withColumn("base64", F.base64("png"))


def on_page(boxes: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes or bounds within a table, moved to the place of the table (x, y) on its page. [SNK10]"""
    moved = {c: F.col(c) + F.col(by) for c, by in (("left", "_x"), ("right", "_x"), ("top", "_y"), ("bottom", "_y")) if c in boxes.columns}
    return boxes.join(tables.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y")), keys).withColumns(moved).drop("_x", "_y")


def _line(kind: str, label: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    numbers = {"x0": x0, "y0": y0, "x1": x1, "y1": y1}
    return F.struct(F.lit(kind).alias("kind"), label.cast("string").alias("label"), *[c.cast("int").alias(n) for n, c in numbers.items()])


def grid_lines(rows: DataFrame, columns: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of a page's grid: kind, label, x0, y0, x1, y1. [SNK9]

    ``rows`` has row_no, top and bottom, ``columns`` field, left and right,
    ``pages`` width and height. Lines run across the whole page, two for each
    row and two for each column, and are labelled by row_no and field.
    """
    sizes, zero = pages.select(*keys, "width", "height"), F.lit(0)
    across = [_line("row", F.col("row_no"), zero, F.col(c), F.col("width"), F.col(c)) for c in ("top", "bottom")]
    down = [_line("column", F.col("field"), F.col(c), zero, F.col(c), F.col("height")) for c in ("left", "right")]
    return rows.join(sizes, keys).select(*keys, F.inline(F.array(*across))).unionAll(columns.join(sizes, keys).select(*keys, F.inline(F.array(*down))))


def table_lines(tables: DataFrame, keys: list[str]) -> DataFrame:
    """The four sides of each table (x, y, width, height) as lines. [SNK9]"""
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("width"), F.col("y") + F.col("height")
    sides = [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]
    return tables.select(*keys, F.inline(F.array(*[_line("table", F.lit("table"), *side) for side in sides])))


def drawn_over(image: np.ndarray, lines: list) -> np.ndarray:
    """An image in colour with lines across or down over it; what lies outside is cut off. [SNK9]"""
    out = three_channels(image).copy()
    height, width = out.shape[:2]
    for line in lines:
        x, y = sorted((line["x0"], line["x1"])), sorted((line["y0"], line["y1"]))
        if x[1] >= 0 and y[1] >= 0 and x[0] < width and y[0] < height:
            out[max(0, y[0]) : y[1] + 1, max(0, x[0]) : x[1] + 1] = COLOURS[line["kind"]]
    return out


def overlays(images: DataFrame, lines: DataFrame) -> DataFrame:
    """origin and png of each image with its lines (origin and those of ``grid_lines``) over it. Labels stay in the rows. [SNK9]"""
    listed = lines.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("kind", "x0", "y0", "x1", "y1"))).alias("lines"))  # a page's grid each

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = ((row.origin, png(drawn_over(decoded(row.height, row.width, row.nChannels, row.data), [] if row.lines is None else list(row.lines)))) for row in batch.itertuples(index=False))
            yield from in_batches(drawn, ["origin", "png"], 50)

    flat = images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.join(listed, "origin", "left").mapInPandas(run, "origin string, png binary")


def write_pngs(pngs: DataFrame, folder: str) -> None:
    """Each row (name, png) as a file of a shared folder, under folders of its own where the name has slashes. [SNK8]

    Tasks write files under other names first and then move them, so that a
    task that runs again, or twice, leaves each file whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                path = f"{base}/{row.name}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as out:
                    out.write(row.png)
                store.move(part, path)
            yield batch[["name"]]

    pngs.select("name", "png").mapInPandas(run, "name string").write.format("noop").mode("overwrite").save()
