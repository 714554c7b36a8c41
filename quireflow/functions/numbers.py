"""Numbers as they are printed in tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_spaces, is_placeholder, replaced


def clean_number(text: Column) -> Column:
    """Struct of value (double, null if there is none) and suspicious (text that is no number). [NUM1]

    Thousands may be set off by commas, dots or spaces; one dot before three
    digits at the end sets off thousands as well.
    """
    value = clean_spaces(text)
    bare = F.btrim(replaced(value, (" ", ""), (",", ""), ("—", "-"), ("−", "-"), ("|", "")), F.lit(".,;:"))
    grouped = bare.rlike(r"\A-?\d{1,3}(\.\d{3})+\z") | bare.rlike(r"\A-*\d+\.\d{3}\z")
    bare = F.when(grouped, F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
    number = F.when(bare.rlike(r"\A-?\d+(\.\d+)?\z"), bare.try_cast("double"))
    blank = is_placeholder(value)
    return F.struct(F.when(~blank, number).alias("value"), (~blank & number.isNull()).alias("suspicious"))


def vote_number(text: Column) -> Column:
    """A reading as votes compare it; "" without a digit. [NUM2]"""
    bare = replaced(F.btrim(clean_spaces(text), F.lit(".,;:")), (" ", ""), (",", ""))
    return F.when(bare.rlike(r"\d"), bare).otherwise("")


def row_number_in(text: Column, first: Column, last: Column) -> Column:
    """The row number that a token names within a range, null if none. [NUM3]

    The token must have one run of digits. Where row numbers have three
    digits, one of two digits may lack its hundreds.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\d+)"))
    raw = F.when(F.size(runs) == 1, F.get(runs, F.lit(0)))
    value = raw.try_cast("int")
    hundreds = lambda n: value + F.floor(n / 100).cast("int") * 100
    short = (last >= 100) & (F.length(raw) <= 2)
    tried = F.array(value, F.when(short, hundreds(first)), F.when(short, hundreds(last)))
    return F.get(F.filter(tried, lambda n: (n >= first) & (n <= last)), F.lit(0))


def block_start(row_no: Column, size: int = 47) -> Column:
    """The first row number of the block that a row stands in. [NUM5]"""
    return (F.floor((row_no - 1) / size) * size + 1).cast("int")


def rendered(value: Column) -> Column:
    """A number as a file shows it: whole ones without a fraction. [SNK1]"""
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))
