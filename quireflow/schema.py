"""The record's columns and their groups."""

from __future__ import annotations

from pyspark.sql import types as T

# The record's columns in order, and which of them each treatment covers.
OUTPUT_COLUMNS = [
    "source_file",
    "page_number",
    "row_no",
    "article",
    "unit",
    "foreign_quantity",
    "foreign_value_rs",
    "foreign_duty_rate",
    "foreign_duty_rs",
    "foreign_duty_as",
    "foreign_duty_p",
    "indian_quantity",
    "indian_value_rs",
    "indian_duty_rate",
    "indian_duty_rs",
    "indian_duty_as",
    "indian_duty_p",
    "total_value",
    "remarks",
    "raw_ocr_text",
    "llm_notes",
    "confidence_flag",
]
LEFT_FIELDS = OUTPUT_COLUMNS[3:11]
RIGHT_FIELDS = OUTPUT_COLUMNS[11:19]
RATE_FIELDS = ["foreign_duty_rate", "indian_duty_rate"]
TEXT_FIELDS = ["article", "unit", *RATE_FIELDS, "remarks"]
NUMBER_FIELDS = [c for c in LEFT_FIELDS + RIGHT_FIELDS if c not in TEXT_FIELDS]
PRIMARY_FIELDS = ["article", "foreign_value_rs", "indian_value_rs", "total_value"]
LONG_TEXT_FIELDS = ["article", "remarks"]
ANNAS_FIELDS = ["foreign_duty_as", "indian_duty_as"]
PIES_FIELDS = ["foreign_duty_p", "indian_duty_p"]

RECORD = T.StructType(
    [T.StructField(c, T.IntegerType() if c == "row_no" else T.DoubleType() if c in NUMBER_FIELDS else T.StringType()) for c in OUTPUT_COLUMNS]
)
TOKEN = "page_id string, pos int, text string, confidence double, x int, y int, width int, height int"


def is_number(field: str) -> bool:
    return field in NUMBER_FIELDS or field == "row_no"
