"""Recovery of a page's rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import block_start, row_number_in
from ..functions.text import header, header_field
from .cells import reading_order, tokens_in_boxes
from .windows import group_centres, intervals, profile_threshold

# Limits of the fits.
LEAST_ANCHORS, LEAST_INLIERS, STEP_RANGE, BLOCK_ROWS = 4, 8, (25.0, 65.0), 47
# Margin and enlargement of a strip of row numbers.
STRIP_MARGIN, STRIP_SCALE = 8.0, 2.0


def row_anchors(tokens: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The best token for each row number: row_no, y. [NUM13, PRD15, AGG4]

    ``pages`` has width, height, strip_start, strip_end, body_top (ratios),
    row_start and expected_rows. Equal confidences go by place.
    """
    joined = tokens.withColumnsRenamed({"width": "w", "height": "h"}).join(pages, keys)
    x, y = F.col("x") + F.col("w") / 2.0, F.col("y") + F.col("h") / 2.0
    strip = x.between((F.col("strip_start") * F.col("width")).cast("int"), (F.col("strip_end") * F.col("width")).cast("int"))
    row_no = row_number_in(F.col("text"), F.col("row_start"), F.col("row_start") + F.col("expected_rows") - 1)
    found = joined.where(strip & (y >= F.col("height") * F.col("body_top") * 0.75)).withColumns({"row_no": row_no, "yc": y}).where("row_no is not null")
    return found.groupBy(*keys, "row_no").agg(F.max_by("yc", F.struct("confidence", -F.col("pos"))).alias("y"))


def template_centres(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Row centres spread evenly between the layout's body ratios. [NUM7]"""
    top, bottom = F.col("height") * F.col("body_top"), F.col("height") * F.col("body_bottom")
    step = (bottom - top) / F.greatest(F.col("expected_rows") - 1, F.lit(1))
    rows = pages.select(*keys, "height", top.alias("_top"), step.alias("_step"), "row_start", F.posexplode(F.sequence(F.lit(1), F.col("expected_rows"))).alias("_i", "_n"))
    return rows.select(*keys, "height", (F.col("row_start") + F.col("_i")).alias("row_no"), (F.col("_top") + F.col("_step") * F.col("_i")).alias("centre"))


def _grid(low: Column, high: Column) -> Column:
    """Numbers from ``low`` up to ``high`` by halves."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil((high + 0.1 - low) / 0.5).cast("int") - 1, F.lit(0))), lambda i: low + i * F.lit(0.5))


def grid_models(anchors: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The step and intercept under which most anchors fall on their rows: three points each, one a row off. [JN7, AGG6, TOP1, NUM9]

    Of equal scores the least step wins, then the least intercept. Pages with
    fewer than four anchors get none. The grid is searched page by page, its
    size set by the page's height.
    """
    enough = anchors.groupBy(*keys).agg(F.count("*").alias("n"), F.collect_list(F.struct("row_no", "y")).alias("anchors")).where(F.col("n") >= LEAST_ANCHORS)
    guess = F.col("height") / F.greatest(F.col("expected_rows") + 2, F.lit(1))
    low = F.greatest(F.lit(12.0), guess * 0.65)
    steps = _grid(low, F.greatest(low + 0.5, guess * 1.35))
    tried = enough.join(pages, keys).withColumn("step", F.explode(steps))
    tried = tried.withColumn("intercept", F.explode(_grid(F.col("height") * 0.04, F.col("height") * 0.24)))

    def points(total: Column, anchor: Column) -> Column:
        off = F.abs(F.bround((anchor["y"] - F.col("intercept")) / F.col("step")) - (anchor["row_no"] - F.col("row_start") + 1))
        return total + F.when(off == 0, 3).when(off == 1, 1).otherwise(0)

    scored = tried.withColumn("score", F.aggregate("anchors", F.lit(0), points))
    best = F.max_by(F.struct("step", "intercept", "score"), F.struct("score", -F.col("step"), -F.col("intercept")))
    return scored.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.step", "best.intercept", "best.score")


def row_centres(tokens: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Row centres by the best model, or the template's where anchors are few. [NUM9]"""
    models = grid_models(row_anchors(tokens, pages, keys), pages, keys)
    fallback = template_centres(pages, keys).join(models, keys, "left").join(pages.select(*keys, "row_start"), keys)
    fitted = F.col("intercept") + F.col("step") * (F.col("row_no") - F.col("row_start") + 1)
    return fallback.select(*keys, "height", "row_no", F.coalesce(fitted, F.col("centre")).alias("centre"))


def pair_models(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The line through two candidates that most row numbers lie near. [JN5, JN6, AGG7, TOP2, NUM10]

    ``candidates`` has row_no, y, confidence and pos (their order). Returns step,
    intercept, n_rows and score for keys where eight row numbers agree. Lines
    with more row numbers win, then higher scores, then earlier pairs.
    """
    item = F.struct("pos", "row_no", F.col("y").cast("double").alias("y"), F.col("confidence").cast("double").alias("confidence"))
    pages = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))

    def lines_from(a: Column, all_: Column) -> Column:
        step = lambda b: F.try_divide(b["y"] - a["y"], b["row_no"] - a["row_no"])
        ahead = F.filter(all_, lambda b: (a["pos"] < b["pos"]) & (b["row_no"] > a["row_no"]) & (b["y"] > a["y"]) & step(b).between(*STEP_RANGE))
        return F.transform(ahead, lambda b: F.struct(a["pos"].alias("pos_a"), b["pos"].alias("pos_b"), step(b).alias("step"), (a["y"] - step(b) * a["row_no"]).alias("intercept")))

    lines = pages.withColumn("a", F.explode("all")).select(*keys, "all", F.inline(lines_from(F.col("a"), F.col("all"))))
    tolerance = F.greatest(F.lit(8.0), F.col("step") * 0.35)
    error = lambda c: F.abs(F.col("step") * c["row_no"] + F.col("intercept") - c["y"])
    # the page's candidates go along with each line, so that nothing is joined
    near = lines.withColumn("_tolerance", tolerance).withColumn("_near", F.filter("all", lambda c: error(c) <= F.col("_tolerance"))).drop("all")
    points = F.aggregate("_near", F.lit(0.0), lambda total, c: total + (1.0 + c["confidence"] - error(c) / F.col("_tolerance") * 0.25))
    scored = near.select(*keys, "pos_a", "pos_b", "step", "intercept", F.size(F.array_distinct(F.transform("_near", lambda c: c["row_no"]))).cast("long").alias("n_rows"), points.alias("score"))
    best = F.max_by(F.struct("step", "intercept", "n_rows", "score"), F.struct("n_rows", "score", -F.col("pos_a"), -F.col("pos_b")))
    return scored.where(F.col("n_rows") >= LEAST_INLIERS).groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def narrow_columns(columns: DataFrame) -> DataFrame:
    """Columns (left, right, page_width) in which row numbers may stand. [PRD17]"""
    # The widths.
    return columns.where(F.col("right") - F.col("left") <= F.greatest(F.lit(90), (F.col("page_width") * 0.12).cast("int")))


def strip_candidates(read: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Row numbers read in the strips of narrow columns: strip, row_no, y, confidence, pos. [PRD3, PRD17, NUM12, SRT2]

    ``read`` has index (the column), text, confidence, y and height of each
    token as an engine saw it: in a strip with a margin, enlarged. ``columns``
    has index, left, right and page_width. Numbers from 1 to 600 count, with a
    confidence; columns that are wide, or in which fewer than eight were read,
    don't. Candidates are in the order of y, then of reading (pos).
    """
    # Numbers that may be a row's.
    narrow = narrow_columns(columns).select(*keys, "index")
    row_no = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^0-9]", "").try_cast("decimal(38,0)")
    y = (F.col("y") + F.col("height") / 2.0 - STRIP_MARGIN) / STRIP_SCALE
    found = read.join(narrow, [*keys, "index"]).where(row_no.between(1, 600) & (F.col("confidence") >= 0))
    found = found.select(*keys, F.col("index").alias("strip"), row_no.cast("int").alias("row_no"), y.alias("y"), F.col("confidence").cast("double").alias("confidence"), "pos")
    strip = Window.partitionBy(*keys, "strip")
    found = found.withColumns({"_n": F.count("*").over(strip), "pos": F.row_number().over(strip.orderBy("y", "pos"))})
    return found.where(F.col("_n") >= LEAST_INLIERS).drop("_n")


def best_strips(models: DataFrame, keys: list[str]) -> DataFrame:
    """The strip whose line most row numbers lie near, then that of higher score, then the first: strip, step, intercept, first_row. [TOP3, NUM11]"""
    best = F.max_by(F.struct("strip", "step", "intercept", "first_row"), F.struct("n_rows", "score", -F.col("strip")))
    return models.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def refined_models(models: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """A least-squares line through the surest inlier of each row number. [AGG5, AGG8]"""
    error = F.abs(F.col("step") * F.col("row_no") + F.col("intercept") - F.col("y"))
    near = candidates.join(models, keys).where(error <= F.greatest(F.lit(8.0), F.col("step") * 0.35))
    best = near.groupBy(*keys, "row_no").agg(F.max_by("y", F.struct("confidence", -F.col("pos"))).alias("y"), F.first("step").alias("step"), F.first("intercept").alias("intercept"), F.first("score").alias("score"))
    fit = best.groupBy(*keys).agg(
        F.coalesce(F.regr_slope("y", "row_no"), F.first("step")).alias("step"), F.coalesce(F.regr_intercept("y", "row_no"), F.first("intercept")).alias("intercept"), F.first("score").alias("score")
    )
    error = F.abs(F.col("step") * F.col("row_no") + F.col("intercept") - F.col("y"))
    kept = fit.join(candidates, keys).where(error <= F.greatest(F.lit(8.0), F.col("step") * 0.35))
    return kept.groupBy(*keys, "step", "intercept", "score").agg(F.count_distinct("row_no").alias("n_rows"), F.min("row_no").alias("first_row"))


def block_centres(models: DataFrame, pages: DataFrame, keys: list[str], expected_start: str | None = None) -> DataFrame:
    """The centres of a block of 47 rows under a model, for pages on which they lie plausibly. [NUM5, NUM6, PRD12]

    A block starts at the expected row, or where the first row seen says.
    """
    start = block_start(F.col("first_row"), BLOCK_ROWS)
    if expected_start:
        start = F.coalesce(F.col(expected_start), start)
    rows = models.join(pages, keys).withColumn("_start", start).withColumn("row_no", F.explode(F.sequence(F.col("_start"), F.col("_start") + BLOCK_ROWS - 1)))
    rows = rows.withColumn("centre", F.col("step") * F.col("row_no") + F.col("intercept"))
    page = Window.partitionBy(*keys)
    plausible = (F.min("centre").over(page) >= F.col("height") * 0.10) & (F.max("centre").over(page) <= F.col("height") * 1.02)
    return rows.withColumn("_ok", plausible).where("_ok").select(*keys, "height", "row_no", "centre")


def ruled_centres(peaks: DataFrame, pages: DataFrame, keys: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """Row centres between the rules under the header and at the bottom, or at usual ratios. [NUM8]

    ``peaks`` has position; ``pages`` has height and row_start.
    """
    edges = pages.join(peaks, keys, "left").groupBy(*keys, "height", "row_start").agg(
        F.max(F.when(F.col("position") < F.col("height") * 0.35, F.col("position"))).alias("head"), F.min(F.when(F.col("position") > F.col("height") * 0.70, F.col("position"))).alias("foot")
    )
    ruled = F.col("head").isNotNull() & F.col("foot").isNotNull()
    step = F.when(ruled, (F.col("foot") - F.col("head")) / (rows + 3.1)).otherwise(F.col("height") * 0.70 / max(rows - 1, 1))
    first = F.when(ruled, F.col("head") + step * 2.5).otherwise(F.col("height") * 0.21)
    listed = edges.select(*keys, "height", "row_start", step.alias("_step"), first.alias("_first"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("_i"))
    return listed.select(*keys, "height", (F.col("row_start") + F.col("_i")).alias("row_no"), (F.col("_first") + F.col("_step") * F.col("_i")).alias("centre"))


def column_intervals(profile: DataFrame, widths: DataFrame, keys: list[str]) -> DataFrame:
    """Columns between the peaks of a page's vertical-rule profile (position, value). [IMG19, AGG10, WIN2, WIN3]

    Peaks within 8 pixels are one, then boundaries within max(12, width / 100);
    columns narrower than max(18, width / 160) are left out.
    """
    hits = profile_threshold(profile, keys, "value", 0.9, 0.12)
    peaks = group_centres(hits, keys, "position", 8).join(widths, keys)
    bounds = group_centres(peaks, [*keys, "page_width"], "position", F.greatest(F.lit(12), F.floor(F.col("page_width") / 100)))
    return intervals(bounds, [*keys, "page_width"], "position", F.greatest(F.lit(18), F.floor(F.col("page_width") / 160)))


def rule_peaks(profile: DataFrame, keys: list[str]) -> DataFrame:
    """The centres of horizontal rules in a page's row profile. [IMG20]"""
    return group_centres(profile_threshold(profile, keys, "value", 0.92, 0.10), keys, "position", 4, whole=False)


def article_and_unit(columns: DataFrame, keys: list[str]) -> DataFrame:
    """Indexes of the article column, the widest of the left half but the first, and of a narrow one after it for the unit. [PRD16, TOP8]"""
    order = Window.partitionBy(*keys).orderBy("index")
    following = columns.withColumns({"_width": F.col("right") - F.col("left"), "_next": F.lead(F.col("right") - F.col("left")).over(order)})
    fits = (F.col("left") < F.col("page_width") * 0.55) & (F.col("index") != 0)
    best = F.max_by(F.struct("index", "_next"), F.when(fits, F.struct("_width", -F.col("index"))))
    found = following.groupBy(*keys, "page_width").agg(best.alias("best"))
    unit = F.when(F.col("best._next") <= (F.col("page_width") * 0.10).cast("int"), F.col("best.index") + 1)
    return found.select(*keys, F.coalesce(F.col("best.index"), F.lit(1)).alias("article_index"), unit.alias("unit_index"))


def text_in(tokens: DataFrame, boxes: DataFrame, keys: list[str], cell: list[str], name: str) -> DataFrame:
    """The heading text in each box, "" where no token lies. [JN3, AGG2]"""
    inside = tokens_in_boxes(tokens, boxes, keys).groupBy(*keys, *cell).agg(reading_order().alias("_tokens"))
    joined = header(F.array_join(F.transform("_tokens", lambda t: t["text"]), " "))
    return boxes.select(*keys, *cell).distinct().join(inside.select(*keys, *cell, joined.alias(name)), [*keys, *cell], "left").na.fill("", [name])


def page_columns(tokens: DataFrame, columns: DataFrame, first_tops: DataFrame, keys: list[str], row_columns: DataFrame) -> DataFrame:
    """A page's columns with their headings, fields and kinds. [TXT17, TXT19]

    ``first_tops`` has first_top, the top of a page's first row; ``row_columns``
    row_index, the column that row numbers stand in.
    """
    boxes = columns.join(first_tops, keys).select(*keys, "index", "left", "right", F.lit(0).alias("top"), F.greatest(F.lit(10), F.col("first_top") - 2).alias("bottom"))
    named = text_in(tokens, boxes, keys, ["index", "left", "right"], "header")
    named = named.join(article_and_unit(columns, keys), keys).join(row_columns, keys, "left")
    kind = header_field(F.col("header"), F.col("index"), F.col("article_index"), F.col("unit_index"), F.col("row_index"))
    return named.withColumn("_kind", kind).select(*keys, "index", "left", "right", "header", "_kind.field", "_kind.kind")
