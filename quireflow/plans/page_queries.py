"""Registered queries over layouts, grids, cells, records, review and files, with the same in SQL."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
import zipfile
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, numbers, scoring, similarity, text
from ..operators import cells, choose, engines, grid, records, review, windows
from ..schema import LEFT_FIELDS, OUTPUT_COLUMNS, RIGHT_FIELDS
from ..sources import files, layouts
from ..sources.articles import KNOWN_ARTICLES, known_articles
from . import imports
from .registry import case as _case
from .registry import registered, sql_list
from .registry import table as _t

# layouts

_LAYOUTS = "l(start, side, bx, row_start, n) AS (VALUES " + ", ".join(f"({start}, '{side}', {box[0]}::DOUBLE, {v[1]}, {v[0]})" for start, v in layouts.SPREADS.items() for side, box in (("left", v[3]), ("right", v[4]))) + ")"
_COLUMNS = "k(side, field, a, b) AS (VALUES " + ", ".join(f"('{side}', '{f}', {a}::DOUBLE, {b}::DOUBLE)" for side, c in (("left", layouts.LEFT_COLUMNS), ("right", layouts.RIGHT_COLUMNS)) for f, (a, b) in c.items()) + ")"


@registered(
    f"""WITH {_LAYOUTS}, {_COLUMNS},
p AS (SELECT c_custkey, (c_custkey % 5 * 2 + 1)::INT AS start, (1000 + c_custkey % 7 * 100)::INT AS width FROM customer)
SELECT c_custkey, l.side, field, trunc(width * a)::INT AS "left", trunc(width * b)::INT AS "right", trunc(width * bx)::INT AS x, row_start, n AS expected_rows
FROM p JOIN l ON p.start = l.start JOIN k ON k.side = l.side"""
)
def q43_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's columns in pixels, by its layout. [SRC7, JN13, GEO2, GEO5]"""
    key = F.col("c_custkey")
    pages = _t(spark, sf_dir, "customer").select("c_custkey", (key % 5 * 2 + 1).cast("int").alias("start"), (1000 + key % 7 * 100).cast("int").alias("width"))
    placed = pages.join(F.broadcast(layouts.layouts(spark)), "start").join(F.broadcast(layouts.layout_columns(spark)), "side")  # 10 and 18 rows
    width = F.col("width")
    return placed.select("c_custkey", "side", "field", geometry.share(width, F.col("start_ratio")).alias("left"), geometry.share(width, F.col("end_ratio")).alias("right"), geometry.share(width, F.col("bbox_x")).alias("x"), "row_start", "expected_rows")


_NAMED = [*layouts.FAMILIES, *layouts.spread_names()]


@registered(
    f"""WITH n AS (SELECT unnest({sql_list(_NAMED)}) AS layout), s AS (SELECT unnest([1, 3, 5, 7, 9]) AS start_page)
SELECT layout, start_page, CASE WHEN ends_with(layout, '_auto') THEN start_page WHEN ends_with(layout, '_v1') THEN 1 ELSE regexp_extract(layout, '_p(\\d+)_p\\d+$', 1)::INT END AS resolved FROM n, s"""
)
def q44_layout_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout that each name means on each start page. [SRC8]"""
    return spark.createDataFrame([(n, s, layouts.resolve(n, s)) for n in _NAMED for s in layouts.SPREADS], "layout string, start_page int, resolved int")


@registered(f"SELECT p_partkey, ({sql_list(KNOWN_ARTICLES)})[(p_partkey % 181 + 1)::INT] AS name FROM part")
def q45_known_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up in the dictionary by their place. [SRC10, JN13]"""
    parts = _t(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 181).cast("int").alias("ord"))
    return parts.join(F.broadcast(known_articles(spark)), "ord").select("p_partkey", "name")  # 181 rows


_STARTS = "s(stem, page_number, expected_start) AS (VALUES " + ", ".join(f"('{stem}', {i}, {v})" for stem, starts in layouts.IMPORT_STARTS.items() for i, v in enumerate(starts, 1)) + ")"


@registered(
    f"""WITH {_STARTS}, p AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '186465_TotalImports_1' WHEN 1 THEN '186465_TotalImports_2' ELSE 'other' END AS stem, (o_orderkey % 11 + 1)::INT AS page_number FROM orders)
SELECT o_orderkey, p.stem, p.page_number, coalesce(expected_start, 0) AS expected_start FROM p LEFT JOIN s ON p.stem = s.stem AND p.page_number = s.page_number"""
)
def q46_import_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the first row that is known of them. [SRC9, JN13]"""
    key = F.col("o_orderkey")
    stem = _case(key, *map(F.lit, (*layouts.IMPORT_STARTS, "other")))
    return imports.with_starts(_t(spark, sf_dir, "orders").select("o_orderkey", stem.alias("stem"), (key % 11 + 1).cast("int").alias("page_number"))).na.fill(0, ["expected_start"])


# row grids


@registered(
    """WITH t AS (SELECT l_suppkey AS page, (l_partkey % 60)::VARCHAR || CASE WHEN l_partkey % 4 = 0 THEN '.' WHEN l_partkey % 4 = 1 THEN ' 7' ELSE '' END AS text, l_quantity * 4 + 5 AS xc, l_linenumber * 100 + l_partkey % 50 + 4.0 AS yc,
  l_extendedprice AS confidence, l_orderkey * 8 + l_linenumber AS pos FROM lineitem),
n AS (SELECT *, TRY_CAST(CASE WHEN len(regexp_extract_all(text, '\\d+')) = 1 THEN regexp_extract(text, '\\d+') END AS INT) AS row_no FROM t WHERE xc BETWEEN 0 AND 80 AND yc >= 700 * 0.2::DOUBLE * 0.75)
SELECT page, row_no, yc::DOUBLE AS y FROM n WHERE row_no BETWEEN 1 AND 47 QUALIFY row_number() OVER (PARTITION BY page, row_no ORDER BY confidence DESC, pos) = 1"""
)
def q47_row_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest token for each row number in the strip of a page. [NUM13, NUM3, PRD15, AGG4]"""
    part = F.col("l_partkey")
    ending = F.when(part % 4 == 0, ".").when(part % 4 == 1, " 7").otherwise("")
    tokens = _t(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page"),
        F.concat((part % 60).cast("string"), ending).alias("text"),
        (F.col("l_quantity") * 4).alias("x"),
        (F.col("l_linenumber") * 100 + part % 50).alias("y"),
        F.lit(10).alias("width"),
        F.lit(8).alias("height"),
        F.col("l_extendedprice").alias("confidence"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
    )
    page = {"width": 200, "height": 700, "strip_start": 0.0, "strip_end": 0.4, "body_top": 0.2, "row_start": 1, "expected_rows": 47}
    pages = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), *[F.lit(v).alias(c) for c, v in page.items()])
    return grid.row_anchors(tokens, pages, ["page"]).select("page", "row_no", F.col("y").cast("double").alias("y"))


@registered(
    """WITH p AS (SELECT s_suppkey AS page, (500 + s_suppkey % 100)::INT AS height, (20 + s_suppkey % 5)::INT AS n, (s_suppkey % 3 * 47 + 1)::INT AS first FROM supplier)
SELECT page, height, (first + i)::INT AS row_no, round(height * 0.2::DOUBLE + (height * 0.9::DOUBLE - height * 0.2::DOUBLE) / (n - 1) * i, 6) AS centre FROM p, (SELECT unnest(range(30)) AS i) WHERE i < n"""
)
def q48_template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows spread between a layout's ratios where no numbers were read. [NUM7, WIN6]"""
    key = F.col("s_suppkey")
    pages = _t(spark, sf_dir, "supplier").select(key.alias("page"), (500 + key % 100).cast("int").alias("height"), F.lit(0.2).alias("body_top"), F.lit(0.9).alias("body_bottom"), (20 + key % 5).cast("int").alias("expected_rows"), (key % 3 * 47 + 1).cast("int").alias("row_start"))
    return grid.template_centres(pages, ["page"]).select("page", "height", "row_no", F.round("centre", 6).alias("centre"))


@registered(
    """WITH m AS (SELECT s_suppkey AS page, 600 AS height, (8 + s_suppkey % 7)::DOUBLE AS step, (s_suppkey % 200 + 1)::INT AS first_row, CASE WHEN s_suppkey % 3 = 0 THEN 48 END AS expected FROM supplier),
s AS (SELECT *, coalesce(expected, (first_row - 1) // 47 * 47 + 1) AS start, page % 90 + 30 - step * coalesce(expected, (first_row - 1) // 47 * 47 + 1) AS icpt FROM m),
c AS (SELECT page, height, (start + i)::INT AS row_no, step * (start + i) + icpt AS centre FROM s, (SELECT unnest(range(47)) AS i))
SELECT page, height, row_no, centre FROM c QUALIFY min(centre) OVER (PARTITION BY page) >= height * 0.10::DOUBLE AND max(centre) OVER (PARTITION BY page) <= height * 1.02::DOUBLE"""
)
def q49_block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of rows under a model, where they lie plausibly. [NUM5, NUM6, PRD12]"""
    key = F.col("s_suppkey")
    start = F.coalesce(F.col("expected"), numbers.block_start(F.col("first_row")))
    rows = _t(spark, sf_dir, "supplier").select(key.alias("page"), F.lit(600).alias("height"), (8 + key % 7).cast("double").alias("step"), (key % 200 + 1).cast("int").alias("first_row"), F.when(key % 3 == 0, 48).alias("expected"))
    models = rows.select("page", "step", "first_row", (F.col("page") % 90 + 30 - F.col("step") * start).alias("intercept"))
    return grid.block_centres(models, rows.select("page", "height", "expected"), ["page"], "expected").select("page", "height", "row_no", "centre")


_PAGE_COLUMNS = """k AS (SELECT p_partkey // 8 AS page, (p_partkey % 8)::INT AS index, (p_partkey % 8 * 100 + p_size)::INT AS left_, (p_partkey % 8 * 100 + p_size + p_size * 2 + 10)::INT AS right_, 900 AS page_width FROM part)"""


def _page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    left = key % 8 * 100 + size
    return _t(spark, sf_dir, "part").select(F.floor(key / 8).alias("page"), (key % 8).cast("int").alias("index"), left.cast("int").alias("left"), (left + size * 2 + 10).cast("int").alias("right"), F.lit(900).alias("page_width"))


@registered(
    f"""WITH {_PAGE_COLUMNS}, w AS (SELECT *, right_ - left_ AS width, lead(right_ - left_) OVER (PARTITION BY page ORDER BY index) AS next FROM k),
b AS (SELECT page, index, next FROM w WHERE left_ < page_width * 0.55::DOUBLE AND index <> 0 QUALIFY row_number() OVER (PARTITION BY page ORDER BY width DESC, index) = 1)
SELECT p.page, coalesce(b.index, 1) AS article_index, CASE WHEN next <= 90 THEN b.index + 1 ELSE -1 END AS unit_index FROM (SELECT DISTINCT page FROM k) p LEFT JOIN b ON p.page = b.page"""
)
def q50_article_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column of a page holds articles, and which one units. [PRD16, TOP8]"""
    return grid.article_and_unit(_page_columns(spark, sf_dir), ["page"]).na.fill(-1, ["unit_index"])


_PEAKS = """WITH h AS (SELECT l_returnflag AS page, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::INT AS position, count(*)::DOUBLE AS value FROM lineitem GROUP BY ALL),
k AS (SELECT page, position FROM h QUALIFY value >= greatest(quantile_cont(value, 0.92) OVER (PARTITION BY page), max(value) OVER (PARTITION BY page) * 0.10)),
s AS (SELECT *, CASE WHEN position - lag(position) OVER (PARTITION BY page ORDER BY position) <= 4 THEN 0 ELSE 1 END AS starts FROM k),
i AS (SELECT *, sum(starts) OVER (PARTITION BY page ORDER BY position) AS island FROM s)
SELECT page, island::BIGINT AS island, round(avg(position), 6) AS position FROM i GROUP BY ALL"""


@registered(_PEAKS)
def q51_rule_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of the horizontal rules in a profile. [IMG20, AGG10, AGG12, WIN2]"""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    profile = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("page"), day.alias("position")).agg(F.count("*").cast("double").alias("value"))
    return grid.rule_peaks(profile, ["page"]).select("page", "island", F.round("position", 6).alias("position"))


@registered(
    f"""WITH {_PAGE_COLUMNS},
t AS (SELECT l_partkey // 8 AS page, (l_partkey % 8)::INT AS index, ((l_orderkey * 37 + l_linenumber * 11) % 700)::INT AS n, l_orderkey * 8 + l_linenumber AS pos, (l_orderkey + l_linenumber) % 41 AS y FROM lineitem),
d AS (SELECT page, index, CASE WHEN n % 10 = 0 THEN NULL ELSE n END AS row_no, (y * 60 + 20 / 2.0 - 8) / 2 AS y, CASE WHEN n % 13 = 5 THEN -1 ELSE 0.5 + n % 5 / 10.0 END AS confidence, pos FROM t),
c AS (SELECT d.page, d.index, row_no, d.y, confidence, pos FROM d JOIN k ON d.page = k.page AND d.index = k.index AND right_ - left_ <= 108 WHERE row_no BETWEEN 1 AND 600 AND confidence >= 0)
SELECT page, index AS strip, row_no, y::DOUBLE AS y, confidence::DOUBLE AS confidence, row_number() OVER (PARTITION BY page, index ORDER BY y, pos)::INT AS pos FROM c QUALIFY count(*) OVER (PARTITION BY page, index) >= 8"""
)
def q52_strip_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers read in the narrow columns' strips, back in the page's pixels. [PRD3, PRD17, NUM12, NUM11, SRT2]"""
    part, order, line = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    n = (order * 37 + line * 11) % 700
    read = _t(spark, sf_dir, "lineitem").select(
        F.floor(part / 8).alias("page"),
        (part % 8).cast("int").alias("index"),
        F.when(n % 10 == 0, "—").otherwise(F.concat(F.lit(" "), n.cast("string"), F.lit("."))).alias("text"),
        F.when(n % 13 == 5, -1.0).otherwise(0.5 + n % 5 / 10.0).alias("confidence"),
        ((order + line) % 41 * 60).alias("y"),
        F.lit(20).alias("height"),
        (order * 8 + line).alias("pos"),
    )
    return grid.strip_candidates(read, _page_columns(spark, sf_dir), ["page"])


@registered(
    """WITH m AS (SELECT l_orderkey AS page, l_linenumber AS strip, (l_partkey % 9)::BIGINT AS n_rows, l_extendedprice::DOUBLE AS score, l_quantity::DOUBLE AS step, l_discount::DOUBLE AS icpt, l_suppkey AS first_row FROM lineitem)
SELECT page, strip, step, icpt AS intercept, first_row FROM m QUALIFY row_number() OVER (PARTITION BY page ORDER BY n_rows DESC, score DESC, strip) = 1"""
)
def q53_best_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strip whose line most row numbers lie near. [TOP3, NUM11]"""
    c = F.col
    models = _t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("page"), c("l_linenumber").alias("strip"), (c("l_partkey") % 9).alias("n_rows"), c("l_extendedprice").alias("score"), c("l_quantity").cast("double").alias("step"), c("l_discount").cast("double").alias("intercept"), c("l_suppkey").alias("first_row"))
    return grid.best_strips(models, ["page"])


@registered(
    """WITH t AS (SELECT p_partkey // 8 AS page, (p_partkey % 8)::INT AS index, p_name AS text, p_size AS size, p_partkey AS pos FROM part),
u AS (SELECT *, CASE index WHEN 2 THEN 'Gross Amount of Duty' WHEN 3 THEN 'Remarks' WHEN 4 THEN 'As.' WHEN 5 THEN 'P.' WHEN 6 THEN 'Rates of Duty' ELSE text END AS head FROM t),
h AS (SELECT page, index, string_agg(head, ' ' ORDER BY pos) FILTER (size % 3 > 0) AS header FROM u GROUP BY ALL),
l AS (SELECT page, index, coalesce(header, '') AS header, lower(coalesce(header, '')) AS l FROM h)
SELECT page, index, (index * 100)::INT AS "left", (index * 100 + CASE index WHEN 1 THEN 99 ELSE 95 END)::INT AS "right", header,
  CASE WHEN index = 0 THEN 'row_no' WHEN index = 1 OR contains(l, 'article') THEN 'article' WHEN contains(l, 'remark') THEN 'remarks' WHEN contains(l, 'rates of duty') THEN 'duty_rate' WHEN contains(l, 'gross amount of duty') THEN 'duty_amount' WHEN l = 'as.' THEN 'duty_as' WHEN l = 'p.' THEN 'duty_p' ELSE 'column_0' || index END AS field,
  CASE WHEN index = 0 THEN 'numeric' WHEN index = 1 OR contains(l, 'remark') THEN 'text' WHEN contains(l, 'rates of duty') THEN 'rate' ELSE 'numeric' END AS kind FROM l"""
)
def q54_page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with the headings that stand above their first row. [TXT17, TXT19, JN3, PRD16]"""
    key, index = F.col("p_partkey"), (F.col("p_partkey") % 8).cast("int")
    parts = _t(spark, sf_dir, "part")
    page = F.floor(key / 8).alias("page")
    columns = parts.select(page, index.alias("index"), (index * 100).alias("left"), (index * 100 + F.when(index == 1, 99).otherwise(95)).alias("right"), F.lit(900).alias("page_width"))
    head = F.when(index == 2, "Gross Amount of Duty").when(index == 3, "Remarks").when(index == 4, "As.").when(index == 5, "P.").when(index == 6, "Rates of Duty").otherwise(F.col("p_name"))
    # a third of the headings stands too low to be one
    tokens = parts.select(page, head.alias("text"), (index * 100 + 10).alias("x"), F.when(F.col("p_size") % 3 == 0, 70).otherwise(20).alias("y"), F.lit(40).alias("width"), F.lit(10).alias("height"), key.alias("pos"))
    tops = columns.select("page").distinct().withColumn("first_top", F.lit(60))
    row_columns = columns.select("page").distinct().withColumn("row_index", F.lit(0))
    return grid.page_columns(tokens, columns, tops, ["page"], row_columns)


# readings and their scores

# a text is clean in all that follows
_NUMBER_POINTS = """(CASE WHEN regexp_full_match(replace({t}, ' ', ''), '[-0-9.,;:]+') THEN 1.5::DOUBLE ELSE 0 END - CASE WHEN regexp_matches({t}, '\\pL') THEN 1.5::DOUBLE ELSE 0 END + least(len(regexp_extract_all({t}, '[0-9]')), 8) * 0.04::DOUBLE
  + CASE WHEN regexp_full_match(replace({t}, ' ', ''), '-?\\d{{1,3}}(,\\d{{3}})+[.;:]?') THEN 0.8::DOUBLE ELSE 0 END - CASE WHEN regexp_full_match(replace({t}, ' ', ''), '-?\\d{{1,3}}(\\.\\d{{3}})+[.;:]?') THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN regexp_full_match(replace({t}, ' ', ''), '-?0[,.]\\d{{3}}[.;:]?') THEN 1.2::DOUBLE ELSE 0 END)"""
_RATE_POINTS = "(CASE WHEN regexp_matches({t}, '(?i)do|cent|per|ann|as|a\\.|p\\.|rs') THEN 1.0::DOUBLE ELSE 0 END - CASE WHEN len(regexp_extract_all({t}, '\\pL')) < 2 THEN 0.6::DOUBLE ELSE 0 END)"
_ARTICLE_POINTS = """(least(len(regexp_extract_all({t}, '\\pL')), 20) * 0.04::DOUBLE + CASE WHEN regexp_matches({t}, '[A-Za-z]{{3,}}') THEN 0.8::DOUBLE ELSE 0 END + least(len(regexp_extract_all({t}, '\\b[A-Z][a-z]{{2,}}\\b')), 3) * 0.25::DOUBLE
  + CASE WHEN regexp_matches({t}, '^[A-Z]') THEN 0.15::DOUBLE WHEN regexp_matches({t}, '^[a-z]') THEN -0.2::DOUBLE ELSE 0 END - CASE WHEN regexp_matches({t}, '^[^A-Za-z]') THEN 0.35::DOUBLE ELSE 0 END
  - least(len(regexp_extract_all({t}, '[|~{{}}\\[\\]<>_=+]')) * 0.2::DOUBLE, 1) - CASE WHEN regexp_matches({t}, '[^\\x00-\\x7F]') THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN regexp_matches({t}, '^[|.,]') THEN 0.4::DOUBLE ELSE 0 END
  - CASE WHEN len(regexp_extract_all({t}, '[A-Za-z]+')) > 5 THEN least((len(regexp_extract_all({t}, '[A-Za-z]+')) - 5) * 0.35::DOUBLE, 2) ELSE 0 END - CASE WHEN length({t}) > 40 THEN least((length({t}) - 40) * 0.04::DOUBLE, 2) ELSE 0 END)"""
_OTHER_POINTS = "(CASE WHEN regexp_full_match({t}, '[A-Za-z0-9 .,'';:()-]+') THEN 0.3::DOUBLE ELSE 0 END)"
_BLANK = "({t} = '' OR regexp_full_match(replace({t}, ' ', ''), '[.\\-–—_:;|]{{2,}}'))"
_SCORED = ["row_no", "article", "unit", "foreign_duty_rate", "remarks", "total_value", "indian_duty_p"]


def _points(field: str, t: str, confidence: str) -> str:
    """A reading's score in SQL."""
    parts = {"n": _NUMBER_POINTS, "r": _RATE_POINTS, "a": _ARTICLE_POINTS, "o": _OTHER_POINTS}
    n, r, a, o = (parts[k].format(t=t) for k in "nrao")
    return f"CASE WHEN {_BLANK.format(t=t)} THEN -10 ELSE coalesce({confidence}, 0)::DOUBLE + CASE WHEN {field} = 'article' THEN {a} WHEN {field} IN ('foreign_duty_rate', 'indian_duty_rate') THEN {r} WHEN {field} IN ('unit', 'remarks') THEN {o} ELSE {n} END END"


_READINGS = [None, "Red Widget", "at 3 per Cent.", "1,234", "12.345", "0,500.", "x7", ". . .", "|ab {c} é", ",a b c d e f g h", "Do", "a.", "-12", "Fine red Cotton cloth of many Sorts and of every Kind there is"]


def _readings_sql() -> str:
    listed = sql_list(v if v is not None else "" for v in _READINGS)
    return f"(SELECT p_partkey, ({sql_list(_SCORED)})[(p_partkey % {len(_SCORED)} + 1)::INT] AS field, CASE p_partkey // {len(_SCORED)} % {len(_READINGS)} WHEN 0 THEN p_name ELSE ({listed})[(p_partkey // {len(_SCORED)} % {len(_READINGS)} + 1)::INT] END AS t, CASE WHEN p_partkey % 5 > 0 THEN (p_size / 100.0)::DOUBLE END AS confidence FROM part)"


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    read = _case(F.floor(key / len(_SCORED)), F.col("p_name"), *map(F.lit, _READINGS[1:]))
    return _t(spark, sf_dir, "part").select("p_partkey", _case(key, *map(F.lit, _SCORED)).alias("field"), F.concat(F.lit(" "), F.replace(read, F.lit(" "), F.lit(" \t"))).alias("text"), F.when(key % 5 > 0, F.col("p_size") / 100.0).alias("confidence"))


@registered(f"SELECT p_partkey, field, round({_points('field', 't', 'confidence')}, 6) AS points FROM {_readings_sql()}")
def q55_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of every kind of field, scored. [SCR1, AGG19]"""
    return _readings(spark, sf_dir).select("p_partkey", "field", F.round(scoring.score_of(F.col("field"), F.col("text"), F.col("confidence")), 6).alias("points"))


_CELL = "CASE l_linenumber % 4 WHEN 0 THEN 'one two three four five six' WHEN 1 THEN 'Red cloth' WHEN 2 THEN 'Fine red cotton cloth of the very best kind there is' ELSE '' END"
_TOKEN = "CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Red' ELSE 'Red cloth' END"


@registered(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ({sql_list(_SCORED)})[(l_suppkey % {len(_SCORED)} + 1)::INT] AS field, {_CELL} AS cell, {_TOKEN} AS token, l_discount * 20 AS cs, l_tax * 30 AS ts, CASE WHEN l_quantity > 5 THEN l_quantity / 50 END AS tc FROM lineitem),
n AS (SELECT *, len(regexp_extract_all(token, '[A-Za-z]+')) AS nt, len(regexp_extract_all(cell, '[A-Za-z]+')) AS nc, coalesce(tc, 0) AS sure FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, field,
  token <> '' AND (ts >= cs OR (field = 'article' AND ((ts >= 0.8 AND sure >= 0.3 AND (nc >= 6 OR length(cell) >= 40)) OR (ts >= cs - 0.3::DOUBLE AND nc > nt + 3) OR (tc IS NOT NULL AND sure >= 0.8 AND ts >= 1.8 AND cs < ts + 0.6::DOUBLE)))) AS prefers,
  token = '' OR ts < CASE field WHEN 'article' THEN 2.2 WHEN 'total_value' THEN 2.5 ELSE 0.9 END AS again, field IN ('article', 'unit', 'total_value') AS may,
  CASE field WHEN 'article' THEN 'text' WHEN 'row_no' THEN 'numeric' WHEN 'total_value' THEN 'numeric' WHEN 'indian_duty_p' THEN 'numeric' END AS kind FROM n"""
)
def q56_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether tokens are preferred to a cell's reading, and which fields are read again. [SCR2, SCR3, PRD9, PRD10]"""
    c = F.col
    cell = _case(c("l_linenumber"), *map(F.lit, ("one two three four five six", "Red cloth", "Fine red cotton cloth of the very best kind there is", "")))
    field, token = _case(c("l_suppkey"), *map(F.lit, _SCORED)), _case(c("l_partkey"), *map(F.lit, ("", "Red", "Red cloth")))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", field.alias("field"), cell.alias("cell"), token.alias("token"), (c("l_discount") * 20).alias("cs"), (c("l_tax") * 30).alias("ts"), F.when(c("l_quantity") > 5, c("l_quantity") / 50).alias("tc"))
    kind = F.coalesce(*[F.when(c("field") == f, scoring.field_type(f)) for f in _SCORED])
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "field",
        scoring.prefers_token(c("field"), c("cell"), c("cs"), c("token"), c("tc"), c("ts")).alias("prefers"),
        scoring.needs_retry(c("field"), c("token"), c("ts")).alias("again"),
        scoring.may_retry(c("field")).alias("may"),
        kind.alias("kind"),
    )


@registered(
    f"""WITH r AS (SELECT p_partkey // 6 AS cell, (p_partkey % 6)::INT AS ord, CASE p_partkey // 6 % 2 WHEN 0 THEN 'total_value' ELSE 'article' END AS field, t, (p_partkey % 7) / 10.0 AS confidence, p_partkey % 4 = 3 OR p_partkey // 6 % 5 = 0 AS blank FROM {_readings_sql()}),
s AS (SELECT *, {_points('field', 't', 'confidence')} AS points FROM r),
e AS (SELECT *, ord = 0 AND NOT (t = '' OR points < CASE field WHEN 'article' THEN 2.2 ELSE 2.5 END) AS ends FROM s),
b AS (SELECT * FROM e WHERE NOT blank QUALIFY row_number() OVER (PARTITION BY cell ORDER BY ends DESC, round(points, 9) DESC, ord) = 1)
SELECT c.cell, coalesce(b.t, '') AS text, CASE WHEN b.cell IS NULL THEN 'blank_classifier' ELSE 'tesseract@v' || b.ord END AS engine, b.confidence::DOUBLE AS confidence FROM (SELECT DISTINCT cell FROM r) c LEFT JOIN b ON c.cell = b.cell"""
)
def q57_best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading of a cell's best box. [TOP4, PRD10, PRD11, SCR1, SCR6]"""
    key = F.col("p_partkey")
    cell = F.floor(key / 6)
    rows = _readings(spark, sf_dir).select(
        cell.alias("cell"),
        F.when(cell % 2 == 0, "total_value").otherwise("article").alias("field"),
        (key % 6).cast("int").alias("ord"),
        F.concat(F.lit("v"), (key % 6).cast("string")).alias("variant"),
        text.clean_spaces(F.col("text")).alias("text"),
        (key % 7 / 10.0).alias("confidence"),
        F.lit("tesseract").alias("engine"),
        ((key % 4 == 3) | (cell % 5 == 0)).alias("likely_blank"),
    )
    return choose.best_variant(rows, ["cell"])


@registered(
    f"""WITH r AS (SELECT p_partkey // 4 AS cell, ['tesseract', 'paddle', 'glm', 'other'][(p_partkey % 4 + 1)::INT] AS engine, p_partkey % 4 AS place, t FROM {_readings_sql()}),
s AS (SELECT *, greatest(({_points("'article'", 't', '0')}) / 5, 0) AS points FROM r WHERE t <> ''),
b AS (SELECT * FROM s WHERE points > 0 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY round(points, 9) DESC, place) = 1)
SELECT c.cell, coalesce(b.t, '') AS value, coalesce(b.engine, 'none') AS engine, round(coalesce(b.points, 0), 6)::DOUBLE AS confidence FROM (SELECT DISTINCT cell FROM r) c LEFT JOIN b ON c.cell = b.cell"""
)
def q58_picked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article that reads best among the engines', without a dictionary. [TOP6, SCR1]"""
    key = F.col("p_partkey")
    rows = _readings(spark, sf_dir).select(F.floor(key / 4).alias("cell"), _case(key, *map(F.lit, ("tesseract", "paddle", "glm", "other"))).alias("engine"), F.col("text").alias("value"))
    found = choose.picked_text(rows, ["cell"], [])
    return found.select("cell", "value", "engine", F.round("confidence", 6).alias("confidence"))


# cells and records


@registered(
    """WITH t AS (SELECT l_suppkey AS page, (l_partkey % 10)::INT AS row_no, CASE l_linenumber % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'total_value' ELSE 'remarks' END AS field, l_linenumber % 3 AS f, l_orderkey * 8 + l_linenumber AS pos,
  CASE l_orderkey % 5 WHEN 0 THEN 've' WHEN 1 THEN '. .' WHEN 2 THEN 'Vent' ELSE l_quantity::INT || CASE WHEN l_orderkey % 5 = 3 THEN '.' ELSE 'x' END END AS text, l_discount * 8 AS confidence FROM lineitem WHERE l_discount * 8 >= 0.15),
o AS (SELECT page, row_no, field, avg(confidence) AS confidence,
  string_agg(text, '' ORDER BY pos, text) FILTER (text <> '. .' AND regexp_matches(text, '\\d')) AS digits, string_agg(text, ' ' ORDER BY pos, text) FILTER (text NOT IN ('. .', 've')) AS plain FROM t GROUP BY ALL)
SELECT page, row_no, field, round(confidence, 6) AS confidence, CASE WHEN field = 'total_value' THEN coalesce(digits, '') ELSE replace(coalesce(plain, ''), 'Vent', 'Cent') END AS text FROM o"""
)
def q59_cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and confidence of cells from the tokens in their boxes. [PRD2, JN2, AGG1, AGG2, AGG3, SRT1, TXT2]"""
    c = F.col
    order, line = c("l_orderkey"), c("l_linenumber")
    number = F.concat(c("l_quantity").cast("int").cast("string"), F.when(order % 5 == 3, ".").otherwise("x"))
    tokens = _t(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("page"),
        _case(order, F.lit(" ve"), F.lit(". ."), F.lit("Vent "), number, number).alias("text"),
        (c("l_discount") * 8).alias("confidence"),
        (line % 3 * 100 + 20).alias("x"),
        (c("l_partkey") % 10 * 30 + 5).alias("y"),
        F.lit(10).alias("width"),
        F.lit(10).alias("height"),
        (order * 8 + line).alias("pos"),
    )
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(100 * i).alias("left"), F.lit(100 * i + 99).alias("right")) for i, f in enumerate(("article", "total_value", "remarks"))])
    boxes = _t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("page"), F.inline(fields)).select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("row_no"))
    boxes = boxes.withColumns({"top": c("row_no") * 30, "bottom": c("row_no") * 30 + 29})
    found = cells.cell_texts(cells.visible_tokens(tokens), boxes, ["page"], ["row_no", "field"])
    return found.select("page", "row_no", "field", F.round("confidence", 6).alias("confidence"), "text")


@registered(
    """WITH r AS (SELECT l_suppkey AS spread, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS row_no, l_linenumber AS n, l_quantity, l_discount, l_partkey FROM lineitem),
d AS (SELECT *, CASE n % 3 WHEN 0 THEN 'at 3 per Cent.' WHEN 1 THEN '' END AS own FROM r),
f AS (SELECT *, CASE WHEN n % 3 = 2 THEN coalesce(last_value(CASE WHEN own <> '' THEN own END IGNORE NULLS) OVER (PARTITION BY spread ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE own END AS rate FROM d),
a AS (SELECT *, CASE n % 5 WHEN 1 THEN 'Red cloth' WHEN 2 THEN 'Do.' WHEN 3 THEN '' WHEN 4 THEN 'Spices' ELSE 'Old books' END AS article FROM f WHERE n % 5 <> 4),
i AS (SELECT *, CASE WHEN n % 5 = 2 THEN 'Do' ELSE article END AS name, list_sort(list_distinct(list_filter([CASE WHEN l_quantity > 15 THEN 'annas_out_of_range' END, CASE WHEN n > 3 THEN 'pies_out_of_range' END, CASE WHEN l_partkey % 4 = 0 THEN 'total_value_non_numeric' END,
  CASE WHEN l_discount * 10 < 0.55 THEN 'low_ocr_confidence' END, CASE WHEN row_no = 1 AND n % 5 IN (2, 3) THEN 'first_article_unresolved' END], lambda x: x IS NOT NULL))) AS issues FROM a)
SELECT spread, row_no, name AS article, CASE WHEN n % 2 = 0 THEN 'lbs.' ELSE '"' END AS unit, rate AS foreign_duty_rate, l_quantity::DOUBLE AS foreign_duty_as, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE (l_partkey * 1000 + 5)::DOUBLE END AS total_value, CASE WHEN n % 2 = 0 THEN 'seen' ELSE '' END AS remarks,
  CASE WHEN len(issues) = 0 THEN 'ok' ELSE 'review:' || array_to_string(issues, ';') END AS confidence_flag, NULL::VARCHAR AS llm_notes FROM i"""
)
def q60_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records cleaned, filled and flagged. [FLG1, FLG3, TXT5, TXT8, TXT10, TXT11, NUM1, WIN1, PRD5, PRD6, AGG16, SET3, SET5, TXT9]"""
    c = F.col
    rows = windows.batched(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 1).withColumn("row_no", c("batch") + 1)
    n, part = c("l_linenumber"), c("l_partkey")
    raw = {f: F.lit("") for f in LEFT_FIELDS + RIGHT_FIELDS} | {
        "article": _case(n, F.lit("{ Old books ,"), F.lit("12 Red cloth ve"), F.lit("Do."), F.lit(". . ."), F.lit("Spices")),
        "unit": F.when(n % 2 == 0, "Ibs.").otherwise("“"),
        "foreign_duty_rate": _case(n, F.lit("3 per Vent"), F.lit("—— "), F.lit("Do,")),
        "foreign_duty_as": c("l_quantity").cast("int").cast("string"),
        "foreign_duty_p": F.concat(n.cast("string"), F.lit(".")),
        "total_value": F.when(part % 4 == 0, "x7").otherwise(F.concat(part.cast("string"), F.lit(",005"))),
        "remarks": F.when(n % 2 == 0, " seen").otherwise("—"),
    }
    rows = rows.select(c("l_suppkey").alias("spread"), "row_no", *[v.alias(f) for f, v in raw.items()], (c("l_discount") * 10).alias("mean_confidence"))
    return records.finalize(rows, ["spread"]).select("spread", F.col("row_no").cast("long").alias("row_no"), "article", "unit", "foreign_duty_rate", "foreign_duty_as", "total_value", "remarks", "confidence_flag", "llm_notes")


_RAW = ["row_no", *LEFT_FIELDS, *RIGHT_FIELDS]


@registered(
    "SELECT o_orderkey AS row_no, " + " || ' | ' || ".join(f"'{f}=' || " + {"row_no": "o_orderkey", "article": "o_orderpriority", "total_value": "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE '' END"}.get(f, "''") for f in _RAW) + " || ' | llm_notes=' AS raw_ocr_text FROM orders"
)
def q61_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's raw text: every field as it was read. [TXT15]"""
    c = F.col
    fields = {f: F.lit("") for f in LEFT_FIELDS + RIGHT_FIELDS} | {"article": c("o_orderpriority"), "total_value": F.when(c("o_orderkey") % 2 == 0, c("o_custkey").cast("string"))}
    rows = _t(spark, sf_dir, "orders").select(c("o_orderkey").alias("row_no"), *[v.alias(f) for f, v in fields.items()])
    return cells.raw_text(rows).select("row_no", "raw_ocr_text")


@registered(
    """WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' No.' WHEN 1 THEN p_name WHEN 2 THEN p_name || ', Bags' ELSE '' END AS a, CASE WHEN p_partkey % 4 = 2 THEN 'Bags' ELSE '' END AS u FROM part)
SELECT p_partkey, 'article' AS field, CASE WHEN p_partkey % 4 IN (0, 2) THEN p_name ELSE a END AS text, 'tesseract' || CASE WHEN p_partkey % 4 IN (0, 2) THEN '+row_split' ELSE '' END AS engine FROM r JOIN part USING (p_partkey)
UNION ALL SELECT p_partkey, 'unit', CASE WHEN p_partkey % 4 = 0 THEN 'No.' ELSE u END, 'table_tokens' FROM r UNION ALL SELECT p_partkey, 'remarks', 'x', NULL FROM r"""
)
def q62_row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units moved out of articles, with a word of it in the engine. [SCR6, TXT12]"""
    key, name = F.col("p_partkey"), F.col("p_name")
    article, unit = _case(key, F.concat(name, F.lit(" No.")), name, F.concat(name, F.lit(", Bags")), F.lit("")), F.when(key % 4 == 2, "Bags").otherwise("")
    item = lambda field, value, engine: F.struct(F.lit(field).alias("field"), value.alias("text"), F.lit(engine).cast("string").alias("engine"))
    listed = F.array(item("article", article, "tesseract"), item("unit", unit, "table_tokens"), item("remarks", F.lit("x"), None))
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("row_no"), F.inline(listed))
    return cells.split_rows(rows, ["p_partkey"]).drop("row_no")


@registered(
    """WITH l AS (SELECT event_id // 6 AS row_no, ['tesseract:a', 'tesseract:b', 'paddle'][(event_id % 3 + 1)::INT] AS engine, event_type || event_id AS text, event_id AS ord, event_id // 3 % 2 AS f FROM events),
n AS (SELECT row_no, f, split_part(engine, ':', 1) AS engine, text FROM l QUALIFY row_number() OVER (PARTITION BY row_no, f, split_part(engine, ':', 1) ORDER BY ord DESC) = 1)
SELECT row_no, CASE f WHEN 0 THEN 'article' ELSE 'unit' END AS field, max(text) FILTER (engine = 'tesseract') AS tesseract, max(text) FILTER (engine = 'paddle') AS paddle, row_no % 9 / 10.0 AS mean_confidence, CASE WHEN row_no % 2 = 0 THEN row_no * 3 ELSE -1 END AS y FROM n GROUP BY row_no, f"""
)
def q63_debug_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's cells with all engines' readings, beside its anchor. [JSN5, JSN6, JN12]"""
    key = F.col("event_id")
    cell = [F.lit(1).alias("spread"), F.floor(key / 6).alias("row_no"), F.when(F.floor(key / 3) % 2 == 0, "article").otherwise("unit").alias("field")]
    read = _t(spark, sf_dir, "events").select(*cell, _case(key, *map(F.lit, ("tesseract:a", "tesseract:b", "paddle"))).alias("engine"), F.concat("event_type", key.cast("string")).alias("text"), key.alias("ord"))
    all_ = cells.readings_by_engine(read, ["spread", "row_no", "field"])
    rows = all_.select("*", F.lit("").alias("text"), (F.col("row_no") % 9 / 10.0).alias("confidence"), F.lit("tesseract").alias("engine"), F.array(F.lit(0)).alias("crop_box"))
    anchors = rows.select("spread", "row_no").distinct().where("row_no % 2 = 0").withColumn("y", F.col("row_no") * 3)
    tree = cells.debug_tree(rows, anchors, ["spread"])
    return tree.select("row_no", F.explode("cells").alias("field", "cell"), "mean_confidence", "y").select("row_no", "field", F.col("cell.all")["tesseract"].alias("tesseract"), F.col("cell.all")["paddle"].alias("paddle"), F.round("mean_confidence", 6).alias("mean_confidence"), F.coalesce("y", F.lit(-1)).alias("y"))


@registered(
    """WITH c AS (SELECT l_returnflag || '.pdf' AS source_file, l_linenumber AS page_number, (l_suppkey % 47 + 1)::INT AS row_no, max(l_partkey)::VARCHAR AS v, max(l_shipmode) AS article FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY ALL)
SELECT source_file, page_number, 'foreign' AS page_kind, 'T' AS title, min(row_no) OVER p AS row_group_start, max(row_no) OVER p AS row_group_end, row_no, article, CASE WHEN page_number % 2 = 0 THEN v ELSE '' END AS col_02, CASE WHEN page_number % 2 = 1 THEN v ELSE '' END AS col_03
FROM c WINDOW p AS (PARTITION BY source_file, page_number)"""
)
def q64_import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as rows with the columns that any page has. [TXT20, SET2, AGG17]"""
    c = F.col
    keys = ["source_file", "page_number", "row_no"]
    rows = _t(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.lit(".pdf")).alias("source_file"), c("l_linenumber").alias("page_number"), (c("l_suppkey") % 47 + 1).cast("int").alias("row_no"), "l_partkey", "l_linestatus")
    rows = rows.groupBy(*keys).agg(F.max("l_partkey").cast("string").alias("v"), F.max("l_linestatus").alias("article"))
    edges = rows.groupBy("source_file", "page_number").agg(F.min("row_no").alias("row_group_start"), F.max("row_no").alias("row_group_end"))
    number = F.when(c("page_number") % 2 == 0, "col_02").otherwise("col_03")
    listed = F.array(F.struct(F.lit("article").alias("column"), c("article").alias("value")), F.struct(number.alias("column"), c("v").alias("value")))
    long = rows.select(*keys, F.inline(listed)).join(edges, ["source_file", "page_number"]).withColumns({"page_kind": F.lit("foreign"), "title": F.lit("T")})
    return imports.wide(long)


# answers, engines, dictionary


@registered(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' and more' WHEN 2 THEN 'Do. x' ELSE '' END AS answer,
  CASE WHEN p_size % 2 = 0 THEN p_size || ',' || p_partkey ELSE '' || p_size || p_partkey END AS digits, CASE WHEN p_size % 2 = 0 THEN p_name || ' Cent.' ELSE p_name END AS words FROM part"""
)
def q65_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without fences and quotes, and a cell's texts as one. [TXT13, TXT14]"""
    key, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    answer = _case(key, F.concat(F.lit("```text\n"), name, F.lit("\n```")), F.concat(F.lit(' "'), name, F.lit("\n and  more'\n")), F.lit("'Da. x'"), F.lit("```\n```"))
    even = size % 2 == 0
    digits = F.when(even, F.array(size.cast("string"), F.lit(","), key.cast("string"))).otherwise(F.array(size.cast("string"), key.cast("string")))
    words = F.when(even, F.array(name, F.lit(" Vent."))).otherwise(F.array(name))
    return _t(spark, sf_dir, "part").select("p_partkey", text.strip_fences(answer).alias("answer"), text.joined_cell(digits, True).alias("digits"), text.joined_cell(words, False).alias("words"))


@registered(
    """WITH t AS (SELECT user_id AS page, event_id AS pos, CASE WHEN event_type IN ('click', 'view') THEN 'paddle' ELSE 'tesseract' END AS engine FROM events),
n AS (SELECT page, count(*) FILTER (engine = 'paddle') AS p, count(*) FILTER (engine = 'tesseract') AS t FROM t GROUP BY page)
SELECT t.page, t.engine, pos FROM t JOIN n ON t.page = n.page AND t.engine = CASE WHEN p >= n.t AND p > 0 THEN 'paddle' ELSE 'tesseract' END"""
)
def q66_page_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the engine that a page takes. [UDF7]"""
    engine = F.when(F.col("event_type").isin("click", "view"), "paddle").otherwise("tesseract")
    tokens = _t(spark, sf_dir, "events").select(F.col("user_id").alias("page"), engine.alias("engine"), F.col("event_id").alias("pos"))
    return engines.chosen_tokens(tokens, ["page"]).select("page", "engine", "pos")


def _picky_client(prompt: str) -> str:
    """Answers each row of a request; fails where a row's number ends in 3."""
    rows = json.loads(prompt[prompt.rindex("Rows:\n") + 6 :])
    if any(r["row_no"] % 10 == 3 for r in rows):
        raise TimeoutError
    return "Sure:\n" + json.dumps([{"row_no": str(r["row_no"]), "article_suggestion": "Rice" if r["article"] == "x" else None, "duty_rate_ok": r["row_no"] % 2 == 0, "notes": f"n{r['row_no']}"} for r in rows])


@registered(
    """WITH r AS (SELECT p_partkey // 50 AS spread, (p_partkey % 50 + 1)::INT AS row_no, CASE WHEN p_size % 3 = 0 THEN 'x' ELSE p_name END AS article, CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'review:a' END AS flag FROM part),
w AS (SELECT *, (row_number() OVER (PARTITION BY spread ORDER BY row_no) - 1) // 6 AS batch FROM r WHERE flag <> 'ok'),
g AS (SELECT spread, row_no FROM w QUALIFY count(*) FILTER (row_no % 10 = 3) OVER (PARTITION BY spread, batch) = 0)
SELECT r.spread, r.row_no, CASE WHEN g.row_no IS NOT NULL AND article = 'x' THEN 'Rice' ELSE article END AS article, CASE WHEN g.row_no IS NOT NULL THEN 'n' || r.row_no END AS llm_notes,
  flag || CASE WHEN g.row_no IS NOT NULL AND article = 'x' THEN ';llm_corrected_article' ELSE '' END || CASE WHEN g.row_no IS NOT NULL AND r.row_no % 2 = 1 THEN ';llm_flagged_duty_rate' ELSE '' END AS confidence_flag
FROM r LEFT JOIN g ON r.spread = g.spread AND r.row_no = g.row_no"""
)
def q67_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak rows sent to a client in batches, its answers applied; a failed request costs its batch only. [UDF10, UDF11, JSN1, JSN2, JN9, SRT2]"""
    key, size = F.col("p_partkey"), F.col("p_size")
    rows = _t(spark, sf_dir, "part").select(
        F.floor(key / 50).alias("spread"),
        (key % 50 + 1).cast("int").alias("row_no"),
        F.when(size % 3 == 0, "x").otherwise(F.col("p_name")).alias("article"),
        F.lit("").alias("foreign_duty_rate"),
        F.lit("").alias("indian_duty_rate"),
        size.cast("double").alias("total_value"),
        F.when(size % 2 == 0, "ok").otherwise("review:a").alias("confidence_flag"),
        F.lit(None).cast("string").alias("llm_notes"),
    )
    return review.reviewed(rows, ["spread"], KNOWN_ARTICLES, _picky_client).select("spread", "row_no", "article", "llm_notes", "confidence_flag")


_SNAPPED = [n for n in KNOWN_ARTICLES if len(n) > 9 and not re.search(r"Do\.|[^A-Za-z ]", n)]


@registered(f"SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN '' ELSE ({sql_list(_SNAPPED)})[(p_partkey % {len(_SNAPPED)} + 1)::INT] END AS article FROM part")
def q68_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with noise around them, found again in the dictionary. [JN8, TXT9, TOP9, UDF13]"""
    key = F.col("p_partkey")
    name = F.get(F.array(*map(F.lit, _SNAPPED)), (key % len(_SNAPPED)).cast("int"))
    raw = _case(key, F.concat(F.lit("ve 12 "), name, F.lit(" ..")), name, F.lit(". . ."))
    return similarity.snap_articles(_t(spark, sf_dir, "part").select("p_partkey", raw.alias("article")), KNOWN_ARTICLES)


# boxes


@registered(
    f"""WITH {_COLUMNS}, w AS (SELECT a, (SELECT b FROM k WHERE field = 'unit') AS b FROM k WHERE field = 'article'),
p AS (SELECT s_suppkey AS page, (900 + s_suppkey % 300)::INT AS width, 1000 AS height, (s_suppkey % 40 * 20)::INT AS top, (s_suppkey % 40 * 20 + 19)::INT AS bottom FROM supplier),
x AS (SELECT *, trunc(width * a)::INT AS l, trunc(width * b)::INT AS r FROM p, w),
d AS (SELECT *, greatest(1, trunc((r - l) * 0.015::DOUBLE))::INT AS px, greatest(1, trunc((bottom - top) * 0.06::DOUBLE))::INT AS py FROM x)
SELECT page, l + px AS "left", r - px AS "right", top + py AS top, bottom - py AS bottom FROM d"""
)
def q69_article_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box in which an article is read again: its column and its unit's. [GEO7, GEO6]"""
    key = F.col("s_suppkey")
    pages = _t(spark, sf_dir, "supplier").select(key.alias("page"), (900 + key % 300).cast("int").alias("width"), F.lit(1000).alias("height"), (key % 40 * 20).cast("int").alias("top"), (key % 40 * 20 + 19).cast("int").alias("bottom"))
    return geometry.reading_boxes(pages, layouts.layout_columns(spark).where("side = 'left'")).where("field = 'article'").select("page", "box.*")


# files

def _scratch(spark: SparkSession, name: str) -> str:
    """A new place in the session's shared folder; in a local session, in a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quireflow-")
    return f"{folder.rstrip('/')}/quireflow/{name}-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf_dir: str, name: str = "orders") -> DataFrame:
    c = F.col
    return _t(spark, sf_dir, "orders").select(
        F.concat(c("o_orderstatus"), F.lit("[1].pdf")).alias("source_file"),
        (c("o_orderkey") % 9).cast("string").alias("page_number"),
        c("o_orderkey").alias("row_no"),
        F.concat(F.lit('"'), c("o_orderpriority"), F.lit('", x')).alias("article"),
        c("o_custkey").cast("double").alias("total_value"),
        F.lit("").alias("remarks"),
        F.when(c("o_orderkey") % 4 == 0, "review:a").otherwise("ok").alias("confidence_flag"),
        F.lit("left out").alias("other"),
    )


_TEXT_RECORD = {"source_file": "o_orderstatus || '[1].pdf'", "page_number": "(o_orderkey % 9)::VARCHAR", "row_no": "o_orderkey::VARCHAR", "article": "'\"' || o_orderpriority || '\", x'", "total_value": "o_custkey::VARCHAR", "confidence_flag": "CASE WHEN o_orderkey % 4 = 0 THEN 'review:a' ELSE 'ok' END"}


@registered("SELECT " + ", ".join(f"{_TEXT_RECORD.get(c, chr(39) * 2)} AS {c}" for c in OUTPUT_COLUMNS) + " FROM orders")
def q70_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as CSV and read back as text. [SNK1, SRC5]"""
    path = _scratch(spark, "csv")
    files.write_csv(_records(spark, sf_dir), path)
    return files.read_text_table(spark, path)


@registered("""SELECT o_orderkey AS row_no, o_orderstatus AS engine, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_custkey::VARCHAR END AS value, 'é,' || o_orderpriority AS words FROM orders""")
def q71_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows written as JSON and read back. [SNK7]"""
    c, path = F.col, _scratch(spark, "json")
    cell = F.struct(c("o_orderstatus").alias("engine"), F.when(c("o_orderkey") % 3 > 0, c("o_custkey")).alias("value"), F.array(F.lit("é"), c("o_orderpriority")).alias("words"))
    rows = _t(spark, sf_dir, "orders").select(c("o_orderkey").alias("row_no"), F.create_map(F.lit("article"), cell).alias("cells"))
    files.write_json(rows, path)
    back = spark.read.schema(rows.schema).json(path).select("row_no", c("cells")["article"].alias("cell"))
    return back.select("row_no", "cell.engine", F.coalesce(c("cell.value").cast("string"), F.lit("none")).alias("value"), F.array_join("cell.words", ",").alias("words"))


@registered("SELECT o_orderstatus || '[1].pdf' AS source_file, count(*) AS n, sum(o_orderkey)::BIGINT AS rows FROM orders GROUP BY 1")
def q72_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a folder for each source file, read back. [SNK5, AGG18]"""
    path = _scratch(spark, "files")
    files.write_by_file(_records(spark, sf_dir).select("source_file", "row_no", "article"), path)
    return spark.read.parquet(path).groupBy("source_file").agg(F.count("*").alias("n"), F.sum("row_no").alias("rows"))


def _sheets(data: bytes) -> list[tuple[str, int, str, str]]:
    """sheet, row, column and text of a workbook's filled cells."""
    out = []
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = re.findall(r'<sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
        for i, name in enumerate(names, 1):
            for column, row, inner in re.findall(r'<c r="([A-Z]+)(\d+)"[^>/]*>(.*?)</c>', z.read(f"xl/worksheets/sheet{i}.xml").decode()):
                out.append((name, int(row), column, re.sub("<[^>]*>", "", inner)))
    return out


@registered(
    """WITH r AS (SELECT n_nationkey AS row_no, 'f' || n_regionkey AS file, n_name AS article, CASE WHEN n_nationkey % 4 = 0 THEN 'review:a' ELSE 'ok' END AS flag FROM nation),
t AS (SELECT 'table' AS sheet, row_number() OVER (ORDER BY file, row_no) + 1 AS r, * FROM r UNION ALL SELECT 'review_only', row_number() OVER (ORDER BY file, row_no) + 1, * FROM r WHERE flag <> 'ok'),
c AS (SELECT sheet, r, unnest(['A', 'C', 'D', 'V']) AS col, unnest([file, row_no::VARCHAR, article, flag]) AS v FROM t
UNION ALL SELECT 'summary', n, unnest(['A', 'B']), unnest([m, v::VARCHAR]) FROM (SELECT 2 AS n, 'rows_total' AS m, count(*) AS v FROM r UNION ALL SELECT 3, 'rows_ok', count(*) FROM r WHERE flag = 'ok' UNION ALL SELECT 4, 'rows_review', count(*) FROM r WHERE flag <> 'ok'))
SELECT sheet, r::INT AS row, col AS "column", v AS value FROM c"""
)
def q73_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a workbook of records, as they are read back. [SNK2, SNK3, SNK4, AGG14, PRD8]"""
    key = F.col("n_nationkey")
    rows = _t(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_regionkey").cast("string")).alias("source_file"), key.cast("int").alias("row_no"), F.col("n_name").alias("article"), F.when(key % 4 == 0, "review:a").otherwise("ok").alias("confidence_flag"))
    found = [x for x in _sheets(files.records_workbook(rows)) if x[1] > 1]
    return spark.createDataFrame(found, "sheet string, row int, column string, value string")


@registered(
    """WITH r AS (SELECT n_regionkey, n_nationkey FROM nation)
SELECT 'all_rows' AS sheet, count(*) AS n FROM r UNION ALL SELECT 'page_headers', count(DISTINCT n_regionkey) FROM r UNION ALL SELECT 'file_' || n_regionkey || '_of_the_tables_of_all__na', count(*) FROM r GROUP BY n_regionkey"""
)
def q74_import_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for all rows, one for headers, and one a file, under a name that a workbook takes. [SNK5, SNK6, AGG18]"""
    name = F.concat(F.lit("file:"), F.col("n_regionkey").cast("string"), F.lit("[of]the*tables?of all/[nations].pdf"))
    rows = _t(spark, sf_dir, "nation").select(F.regexp_replace(name, r"[\]?]| ", "_").alias("source_file"), F.lit(1).alias("page_number"), F.col("n_nationkey").cast("int").alias("row_no"))
    data = files.imports_workbook(rows, rows.select("source_file", "page_number").distinct())
    counts: dict[str, set[int]] = {}
    for sheet, row, _, _ in _sheets(data):
        counts.setdefault(sheet, set()).add(row)
    return spark.createDataFrame([(k, len(v - {1})) for k, v in counts.items()], "sheet string, n long")


@registered("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS stem")
def q75_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a folder. [SRC3]"""
    return files.documents(spark, sf_dir, "*.parquet").select("stem")


@registered("SELECT c_custkey, unnest(generate_series(1, (c_custkey % 12)::INT, 2))::INT AS start_page FROM customer")
def q76_spread_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that the spreads of a file begin on. [SRC2]"""
    return _t(spark, sf_dir, "customer").select("c_custkey", F.explode(files.spread_starts((F.col("c_custkey") % 12).cast("int"))).alias("start_page"))
