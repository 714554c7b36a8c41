"""Layout presets as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Where the tables, rows and columns of the printed spreads lie, as ratios of a page or table. [SRC7]
LEFT_COLUMNS = {
    "row_no": (0.0, 0.05639),
    "article": (0.05639, 0.37193),
    "unit": (0.37193, 0.44511),
    "foreign_quantity": (0.44511, 0.58188),
    "foreign_value_rs": (0.58188, 0.71506),
    "foreign_duty_rate": (0.71506, 0.90342),
    "foreign_duty_rs": (0.90342, 0.95861),
    "foreign_duty_as": (0.95861, 0.97900),
    "foreign_duty_p": (0.97900, 0.99760),
}
RIGHT_COLUMNS = {
    "row_no": (0.0, 0.03571),
    "indian_quantity": (0.03571, 0.14516),
    "indian_value_rs": (0.14516, 0.25576),
    "indian_duty_rate": (0.25576, 0.47005),
    "indian_duty_rs": (0.47005, 0.60138),
    "indian_duty_as": (0.60138, 0.66912),
    "indian_duty_p": (0.66912, 0.73675),
    "total_value": (0.73675, 0.85369),
    "remarks": (0.85369, 0.98500),
}
#: By start page: rows, first row, bottom of the body, boxes (x, y, width, height) of the left and the right table.
SPREADS = {
    1: (46, 1, 0.982, (0.07295, 0.15308, 0.67191, 0.75114), (0.09714, 0.17474, 0.69972, 0.71864)),
    3: (47, 47, 0.982, (0.15518, 0.18757, 0.74688, 0.72007), (0.11890, 0.15279, 0.75655, 0.68900)),
    5: (47, 94, 0.982, (0.13100, 0.17474, 0.75816, 0.72406), (0.12495, 0.26767, 0.74204, 0.62771)),
    7: (47, 141, 0.982, (0.11165, 0.15365, 0.68077, 0.75086), (0.34301, 0.18358, 0.58565, 0.71351)),
    9: (15, 188, 0.760, (0.10480, 0.18358, 0.72511, 0.51596), (0.08384, 0.14994, 0.74728, 0.54618)),
}
#: Top of the body, and where row numbers stand, by side.
BODY_TOP = {"left": 0.188, "right": 0.165}
NUMBER_STRIP = {"left": (0.0, 0.075), "right": (0.0, 0.04)}
#: Families that take their layout by start page, and the prefix of their names.
FAMILIES = {"madras_exports_auto": "madras_exports", "madras_exports_186566_auto": "madras_exports_186566"}
#: First rows of known import pages, by file and page. [SRC9]
IMPORT_STARTS = {
    "186465_TotalImports_1": (1, 1, 1, 48, 48, 95, 95, 142, 142),
    "186465_TotalImports_2": (189, 189, 236, 236, 236, 283, 283, 330, 330),
}


def spread_names() -> dict[str, int]:
    """Preset names and the start page whose layout each has."""
    names = {f"{prefix}_p{start}_p{start + 1}": start for prefix in FAMILIES.values() for start in SPREADS}
    return names | {"madras_exports_v1": 1}


def resolve(layout: str, start_page: int) -> int:
    """The start page whose layout a name means, or KeyError with the ones there are. [SRC8]"""
    if layout in FAMILIES:
        if start_page not in SPREADS:
            raise KeyError(f"no layout for start page {start_page}; there are {sorted(SPREADS)}")
        return start_page
    return spread_names()[layout]


def layouts(spark: SparkSession) -> DataFrame:
    """A row for each spread and side: start, side, box ratios, body, strip, expected_rows, row_start."""
    rows = []
    for start, (n, first, bottom, left, right) in SPREADS.items():
        for side, box in (("left", left), ("right", right)):
            rows.append((start, side, *box, BODY_TOP[side], bottom, *NUMBER_STRIP[side], n, first))
    return spark.createDataFrame(
        rows,
        "start int, side string, bbox_x double, bbox_y double, bbox_w double, bbox_h double, body_top double, body_bottom double, strip_start double, strip_end double, expected_rows int, row_start int",
    )


def layout_columns(spark: SparkSession) -> DataFrame:
    """A row for each side's fields: side, field, start_ratio, end_ratio."""
    rows = [(side, field, *ends) for side, columns in (("left", LEFT_COLUMNS), ("right", RIGHT_COLUMNS)) for field, ends in columns.items()]
    return spark.createDataFrame(rows, "side string, field string, start_ratio double, end_ratio double")


def import_starts(spark: SparkSession) -> DataFrame:
    """stem, page_number, expected_start of the import pages that are known."""
    rows = [(stem, page, start) for stem, starts in IMPORT_STARTS.items() for page, start in enumerate(starts, 1)]
    return spark.createDataFrame(rows, "stem string, page_number int, expected_start int")
