"""Registered queries over drawn pages, with the same in SQL.

Each supplier is a small page: a rule across, a rule down, and a block of ink
for each bit of its number. The SQL says which pixels these are.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import engines, images
from ..operators.rasters import drawn
from ..schema import is_number
from ..sources import artefacts, files
from .page_queries import _points, _scratch
from .registry import case as _case
from .registry import registered
from .registry import spread_table as _spread
from .registry import table as _t

_BLOCK = "(y - 14) % 8 < 4 AND y BETWEEN 14 AND 33 AND (x - 12) % 12 < 5 AND x BETWEEN 12 AND 52 AND (id >> ((y - 14) // 8 * 4 + (x - 12) // 12)::INT) & 1 = 1"
_PIXELS = f"""p AS (SELECT s_suppkey::INT AS id, 8 + (s_suppkey * 7 % 50)::INT % 40 AS down FROM supplier),
px AS (SELECT id, down, y, x, {_BLOCK} AS block, y BETWEEN 4 AND 43 AND x = down AS on_down, y = 10 AND x BETWEEN 4 AND 59 AS on_across
  FROM p, (SELECT unnest(range(48))::INT AS y), (SELECT unnest(range(64))::INT AS x)),
v AS (SELECT *, CASE WHEN block THEN 30 WHEN on_down OR on_across THEN 20 ELSE 245 END AS v FROM px)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(_spread(spark, sf_dir, "supplier").select(F.col("s_suppkey"), (F.col("s_suppkey") * 7 % 50)))


def _id() -> F.Column:
    return F.substring_index("origin", "-", -1).cast("int").alias("id")


def _pixel_sums(image: np.ndarray) -> Iterator[dict]:
    g = images.gray(images.three_channels(image))
    binary, trimmed = images.otsu(g), images.trimmed(g)
    yield {
        "level": images.otsu_threshold(g),
        "dark": int((binary == 0).sum()),
        "ink": int((images.ink(g) == 255).sum()),
        "trimmed_pixels": trimmed.size,
        "trimmed": int(trimmed.sum()),
        "crop": int(images.crop(g, 5, 6, 20, 30).sum()),
        "blurred": int(images.blurred(g).sum()),
        "text": int((images.without_rules(binary) == 0).sum()),
    }


@registered(
    f"""WITH {_PIXELS},
h AS (SELECT id, v, count(*) AS n FROM v GROUP BY ALL),
c AS (SELECT id, v AS level, sum(n) OVER w AS below, sum(n * v) OVER w AS mass, sum(n) OVER (PARTITION BY id) AS n, sum(n * v) OVER (PARTITION BY id) AS total FROM h WINDOW w AS (PARTITION BY id ORDER BY v)),
o AS (SELECT id, level FROM c WHERE below < n QUALIFY row_number() OVER (PARTITION BY id ORDER BY below * (n - below) * (mass::DOUBLE / below - (total - mass)::DOUBLE / (n - below)) ** 2 DESC, level) = 1),
-- beyond an edge stands what stands as far before it
k AS (SELECT a.id, a.y, a.x, sum(b.v * CASE dy WHEN 0 THEN 0.5::DOUBLE ELSE 0.25 END * CASE dx WHEN 0 THEN 0.5::DOUBLE ELSE 0.25 END) AS m FROM v a, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx), v b
  WHERE b.id = a.id AND b.y = CASE WHEN a.y + dy < 0 THEN 1 WHEN a.y + dy > 47 THEN 46 ELSE a.y + dy END AND b.x = CASE WHEN a.x + dx < 0 THEN 1 WHEN a.x + dx > 63 THEN 62 ELSE a.x + dx END GROUP BY ALL),
s AS (SELECT id, sum(round_even(m, 0))::BIGINT AS blurred FROM k GROUP BY id)
SELECT v.id, o.level::INT AS level, count(*) FILTER (v <= o.level) AS dark, count(*) FILTER (v < 245) AS ink, count(*) FILTER (y BETWEEN 3 AND 44 AND x BETWEEN 2 AND 61) AS trimmed_pixels,
  sum(v) FILTER (y BETWEEN 3 AND 44 AND x BETWEEN 2 AND 61)::BIGINT AS trimmed, sum(v) FILTER (y BETWEEN 6 AND 35 AND x BETWEEN 5 AND 24)::BIGINT AS crop, any_value(s.blurred) AS blurred,
  count(*) FILTER (v <= o.level AND NOT on_down AND NOT on_across) AS text FROM v JOIN o ON v.id = o.id JOIN s ON v.id = s.id GROUP BY v.id, o.level"""
)
def q77_pixel_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, ink, borders, blurs and rules of drawn pages. [IMG1, IMG5, IMG7, IMG8, IMG10, IMG12, IMG15, GEO4, WIN10]"""
    found = images.over_images(_pages(spark, sf_dir), _pixel_sums, "level int, dark long, ink long, trimmed_pixels long, trimmed long, crop long, blurred long, text long")
    return found.select(_id(), *[c for c in found.columns if c != "origin"])


@registered(
    f"""WITH {_PIXELS},
b AS (SELECT id, (y - 14) // 8 * 4 + (x - 12) // 12 AS bit, min(x) AS x0, any_value(down) AS down FROM v WHERE block GROUP BY ALL),
a AS (SELECT id, bit, down BETWEEN x0 - 1 AND x0 + 5 AS joined FROM b),
l AS (SELECT v.id, count(*) FILTER (v < 245) AS ink, count(*) FILTER (on_down OR on_across OR (block AND EXISTS (SELECT 1 FROM a WHERE a.id = v.id AND joined AND bit = (y - 14) // 8 * 4 + (x - 12) // 12))) AS largest FROM v GROUP BY v.id),
n AS (SELECT p.id, down, count(bit) FILTER (NOT joined) AS free FROM p LEFT JOIN a ON a.id = p.id GROUP BY ALL)
SELECT l.id, round(ink / 3072, 9) AS ink_density, (free + 1)::INT AS component_count, round(largest / 3072, 9) AS max_component_ratio, FALSE AS likely_blank, down AS down_at, 10 AS across_at, 40.0::DOUBLE AS down_pixels, 56.0::DOUBLE AS across_pixels FROM l JOIN n ON l.id = n.id"""
)
def q78_page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink, its areas, and where the profiles of the rules are highest. [IMG13, IMG19, IMG20, AGG11, PRD11]"""
    pages = _pages(spark, sf_dir)
    features = images.image_features(pages).select("origin", F.round("ink_density", 9).alias("ink_density"), "component_count", F.round("max_component_ratio", 9).alias("max_component_ratio"), "likely_blank")
    peaks = images.image_profiles(pages).groupBy("origin", "axis").agg(F.max(F.struct("value", "position")).alias("peak")).groupBy("origin").pivot("axis", ["x", "y"]).agg(F.first("peak"))
    found = features.join(peaks, "origin")
    return found.select(_id(), *features.columns[1:], F.col("x.position").alias("down_at"), F.col("y.position").alias("across_at"), F.col("x.value").alias("down_pixels"), F.col("y.value").alias("across_pixels"))


def _boxes(image: np.ndarray) -> Iterator[dict]:
    binary = np.where(image < 128, 255, 0).astype(np.uint8)
    for kind, box in (("table", images.table_box(binary)), ("import", images.import_table_box(binary)), ("none", images.table_box(binary[11:, :9]))):
        yield {"kind": kind} | dict(zip(("x", "y", "width", "height"), box or (-1, -1, -1, -1), strict=True))


@registered(
    """SELECT s_suppkey::INT AS id, kind, x, y, width, height FROM supplier, (VALUES ('table', 4, 4, 56, 40), ('import', 0, 0, 64, 48)) b(kind, x, y, width, height)
UNION ALL SELECT s_suppkey::INT, 'none', CASE WHEN down THEN 8 ELSE -1 END, CASE WHEN down THEN 1 ELSE -1 END, CASE WHEN down THEN 1 ELSE -1 END, CASE WHEN down THEN 32 ELSE -1 END FROM (SELECT s_suppkey, s_suppkey * 7 % 50 % 40 = 0 AS down FROM supplier)"""
)
def q79_table_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ruled area of a page lies, by either rule, and that a corner has none but where the rule down crosses it. [IMG17, IMG18, TOP7]"""
    found = images.over_images(_pages(spark, sf_dir), _boxes, "kind string, x int, y int, width int, height int")
    return found.select(_id(), "kind", "x", "y", "width", "height")


def _ink_reader(image: np.ndarray) -> Iterator[tuple]:
    """Reads a page as one token, the number of its dark pixels, in the polygon around them."""
    ys, xs = np.nonzero(image < 128)
    corners = [(int(xs.min()), int(ys.min())), (int(xs.max()) + 1, int(ys.min())), (int(xs.max()) + 1, int(ys.max()) + 1), (int(xs.min()), int(ys.max()) + 1)]
    yield str(len(xs)), 0.5, *engines.box_of(corners)


def _grey_reader(image: np.ndarray) -> Iterator[tuple]:
    yield f"levels {len(np.unique(image))}", 0.25, 0, 0, image.shape[1], image.shape[0]


def _broken() -> None:
    raise OSError("this engine isn't there")


@registered(
    f"""WITH {_PIXELS}, d AS (SELECT id, count(*) FILTER (v <= CASE WHEN id & 4095 > 0 THEN 30 ELSE 20 END) AS n, count(DISTINCT v) AS levels FROM v GROUP BY id)
SELECT id, 'tesseract' AS engine, 0 AS pos, n::VARCHAR AS text, 0.5 AS confidence, 4 AS x, 4 AS y, 56 AS width, 40 AS height FROM d UNION ALL SELECT id, 'glm', 0, 'levels ' || levels, 0.25, 0, 0, 64, 48 FROM d"""
)
def q80_page_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of pages by three readers, of which one can't be made. [UDF2, UDF5, UDF6, UDF9, IMG8]"""
    flat = _pages(spark, sf_dir).select(F.substring_index("image.origin", "-", -1).cast("int").alias("id"), "image.height", "image.width", "image.nChannels", "image.data")
    return engines.page_tokens(flat, {"tesseract": lambda: _ink_reader, "paddle": _broken, "glm": lambda: _grey_reader}, ["id"])


_FIELDS = ("article", "total_value", "unit", "remarks", "foreign_duty_rate")
_DIGITS = "--psm 7 -c tessedit_char_whitelist=0123456789.,-"
_CANDIDATES = f"""c(field, ord, engine, text, confidence) AS (VALUES ('article', 0, 'tesseract', '--psm 7', 0.141), ('article', 1, 'paddle', 'Red', 0.5), ('total_value', 0, 'tesseract', '{_DIGITS}', 0.141), ('total_value', 1, 'paddle', 'Red', 0.5),
  ('unit', 0, 'tesseract:default_binary', '--psm 7', 0.128), ('unit', 1, 'tesseract:default_gray', '--psm 7', 0.128),
  ('remarks', 0, 'tesseract:text_gray', '--psm 7', 0.128), ('remarks', 1, 'tesseract:text_gray', '--psm 6', 0.128), ('remarks', 2, 'tesseract:text_binary', '--psm 7', 0.128), ('remarks', 3, 'tesseract:text_binary', '--psm 6', 0.128), ('remarks', 4, 'tesseract:text_adaptive', '--psm 7', 0.128), ('remarks', 5, 'tesseract:text_adaptive', '--psm 6', 0.128),
  ('foreign_duty_rate', 0, 'tesseract:rate_gray', '--psm 7', 0.128), ('foreign_duty_rate', 1, 'tesseract:rate_gray', '--psm 6', 0.128), ('foreign_duty_rate', 2, 'tesseract:rate_binary', '--psm 7', 0.128), ('foreign_duty_rate', 3, 'tesseract:rate_binary', '--psm 6', 0.128)),
r AS (SELECT s_suppkey::INT AS id, ['{"', '".join(_FIELDS)}'][(s_suppkey % 5 + 1)::INT] AS field FROM supplier)"""


def _setting_reader(image: np.ndarray, setting: str) -> tuple[str, float]:
    """Reads the setting, as surely as the picture is high."""
    return setting, image.shape[0] / 1000


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir).select(F.substring_index("image.origin", "-", -1).cast("int").alias("id"), "image.height", "image.width", "image.nChannels", "image.data")
    crops = pages.withColumn("field", _case(F.col("id"), *map(F.lit, _FIELDS)))
    return engines.cell_readings(crops, {"tesseract": lambda: _setting_reader, "paddle": lambda: lambda image, setting: ("Red", 0.5), "glm": _broken}, ["id", "field"])


@registered(f"WITH {_CANDIDATES} SELECT id, r.field, ord, engine, text, confidence::DOUBLE AS confidence FROM r JOIN c ON r.field = c.field")
def q81_cell_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of cells in every form and setting that their fields ask for. [UDF3, UDF4, UDF5, UDF8, IMG11, IMG14]"""
    return _candidates(spark, sf_dir)


@registered(
    f"""WITH {_CANDIDATES}, s AS (SELECT id, r.field, ord, engine, text, confidence, greatest(({_points("'article'", 'text', '0')}) / 5, 0) AS points FROM r JOIN c ON r.field = c.field),
a AS (SELECT id, field, text, engine, round(points, 6)::DOUBLE AS confidence FROM s WHERE field = 'article' QUALIFY row_number() OVER (PARTITION BY id ORDER BY points DESC, ord) = 1)
SELECT id, field, text AS cell_text, confidence AS cell_confidence, engine AS cell_engine FROM a UNION ALL SELECT id, field, replace(replace(text, ' ', ''), ',', ''), 1.0, engine FROM s WHERE field = 'total_value' AND ord = 0
UNION ALL SELECT id, field, text, confidence, engine FROM s WHERE field NOT IN ('article', 'total_value') AND ord = 0"""
)
def q82_chosen_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cell's reading: numbers by vote, articles by likeness or score, others by score. [UDF8, SCR4, AGG13, TOP5, TOP6, SCR6]"""
    path, cells = _scratch(spark, "readings"), _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("id"), _case(F.col("s_suppkey"), *map(F.lit, _FIELDS)).alias("field"))
    _candidates(spark, sf_dir).write.parquet(path)
    chosen = engines.chosen_readings(spark.read.parquet(path), cells, ["id", "field"])
    return chosen.select("id", "field", "cell_text", F.round("cell_confidence", 6).alias("cell_confidence"), "cell_engine")


def _three_pages(content: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """A file's pages, as many as its number says; every tenth file breaks off after its first."""
    number = int(content)
    for n in range(number % 3 + 1):
        if n and number % 10 == 9:
            raise ValueError(f"page {n + 1} of {number}")
        yield n + 2, 3, 1, bytes([number % 256] * (3 * (n + 2)))


@registered(
    """WITH f AS (SELECT s_suppkey AS k, s_suppkey % 3 + 1 AS n FROM supplier), p AS (SELECT k, unnest(generate_series(1, n)) AS page FROM f)
SELECT 'file-' || k AS path, page::INT AS page_number, (page + 1)::INT AS height, (3 * (page + 1))::INT AS bytes, '' AS error FROM p WHERE k % 10 <> 9 OR page = 1
UNION ALL SELECT 'file-' || k, 2, 0, 0, 'page 2 of ' || k FROM f WHERE k % 10 = 9 AND n > 1"""
)
def q83_rendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files rendered page by page; one that can't be read becomes a row with its error. [SRC1, SRC4]"""
    key = F.col("s_suppkey").cast("string")
    found = files.rendered_pages(_t(spark, sf_dir, "supplier").select(F.concat(F.lit("file-"), key).alias("path"), key.cast("binary").alias("content")), _three_pages)
    return found.select("path", "page_number", "height", F.octet_length("data").alias("bytes"), F.coalesce("error", F.lit("")).alias("error"))


def _colours(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, and how many pixels of a PNG file (unfiltered, in colour) are green and blue."""
    at, width, height, body = 8, 0, 0, b""
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        if kind == b"IHDR":
            width, height = struct.unpack(">II", data[at + 8 : at + 16])
        if kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    pixels = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + 3 * width)[:, 1:].reshape(height, width, 3)
    return width, height, int((pixels == (0, 255, 0)).all(-1).sum()), int((pixels == (0, 0, 255)).all(-1).sum())


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(int(r.origin.split("-")[-1]), *_colours(r.png)) for r in batch.itertuples(index=False)], columns=["id", "width", "height", "green", "blue"])


@registered(
    """SELECT s_suppkey::INT AS id, 64 AS width, 48 AS height, 64 AS green, CASE WHEN s_suppkey % 3 > 0 THEN 47 ELSE 0 END AS blue FROM supplier"""
)
def q84_overlay_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines drawn over pages, counted in the PNG files: one across in green, over one down in blue on two of three pages. [SNK8, SNK9, IMG15, IMG16]"""
    key = F.col("s_suppkey")
    line = lambda kind, x0, y0, x1, y1: F.struct(F.lit(kind).alias("kind"), F.lit("").alias("label"), *[v.cast("int").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])
    across, down = line("row", F.lit(0), key % 48, F.lit(64), key % 48), line("column", key % 64, F.lit(0), key % 64, F.lit(48))
    lines = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("part-"), key.cast("string")).alias("origin"), F.inline(F.when(key % 3 > 0, F.array(across, down)).otherwise(F.array(across))))
    return artefacts.overlays(_pages(spark, sf_dir), lines).mapInPandas(_counted, "id int, width int, height int, green int, blue int")


assert all(is_number(f) == (f == "total_value") for f in _FIELDS)
