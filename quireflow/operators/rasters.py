"""Small drawn pages, for kernels to run on where no scans are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def raster(number: int, size: int) -> np.ndarray:
    """A white page of 48 x 64 with a rule across, one down, and a block for each bit of ``number``."""
    page = np.full((48, 64), 245, dtype=np.uint8)
    page[10, 4:60] = 20
    page[4:44, 8 + size % 40] = 20
    for bit in range(12):
        if number >> bit & 1:
            page[14 + 8 * (bit // 4) : 18 + 8 * (bit // 4), 12 + 12 * (bit % 4) : 17 + 12 * (bit % 4)] = 30
    return page


def drawn(rows: DataFrame) -> DataFrame:
    """A page for each row (number, size), in the form of Spark's image source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [(f"part-{n}", 48, 64, 1, 0, raster(int(n), int(s)).tobytes()) for n, s in batch.itertuples(index=False)]
            yield pd.DataFrame(pages, columns=["origin", "height", "width", "nChannels", "mode", "data"])

    flat = rows.mapInPandas(run, "origin string, height int, width int, nChannels int, mode int, data binary")
    return flat.selectExpr("struct(*) AS image")
