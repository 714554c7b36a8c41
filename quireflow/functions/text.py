"""Text normalisation. Blank text is the empty string; null counts as blank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, and the four separators that count as such where lines are split.
SPACE = r"(?U)[\s\x1c-\x1f]+"

# Recognition noise, ditto marks, unit spellings, category headings, characters cut from articles.
NOISE_TOKENS = ["|", "||", ".", ":", ";", ",", "_", "-", "+", "ve", "vee", "wee", "web", "ae", "te", "on", "en", "rn", "tn", "ws", "us", "po", "boe", "bee", "bes", "ves", "webte"]
DITTO = ["do", "do.", "per do", "per do."]
UNIT_DITTO = ['"', "“", "”"]
UNIT_SPELLINGS = {"No": "No.", "No]": "No.", "No,": "No.", "Cwt": "Cwt.", "Cwtl": "Cwt.", "Cwt.": "Cwt.", "Ibs": "lbs.", "Ibs.": "lbs.", "lbs": "lbs.", "lbs.": "lbs."}
CATEGORIES = [
    "Apparel",
    "Cattle",
    "Cotton Goods",
    "Drugs",
    "Dyes",
    "Fruits and Nuts",
    "Grain",
    "Horns",
    "Manufactured Metals",
    "Naval Stores",
    "Oils",
    "Precious Stones",
    "Provisions",
    "Seeds",
    "Spices",
    "Spirits",
    "Timber and Planks",
    "Woods",
    "Woollens",
    "Metals",
]
ARTICLE_EDGES = "\"'`.,;:()[]{}|/\\_-+=~*%^!?£©™"
ARTICLE_TAIL = "',.; °"
UNIT_WORDS = r"No\.?|Nos\.?|Pairs?|Pieces?|Pkgs?\.?|Bags?\.?|Lbs?\.?|Yds?\.?|Cwts?\.?"


def replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    """Plain replacements, one after the other."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def clean_spaces(text: Column) -> Column:
    """Runs of white space become one space; none at the ends. [TXT1]"""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def is_placeholder(text: Column) -> Column:
    """Nothing, or nothing but leader dots and dashes. [PRD1]"""
    value = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")
    return (value == "") | value.rlike(r"\A[.\-–—_:;|]{2,}\z")


def is_clean_placeholder(text: Column) -> Column:
    """``is_placeholder`` of a text whose white space is clean. [PRD1]"""
    value = replaced(text, (" ", ""))
    return (value == "") | value.rlike(r"\A[.\-–—_:;|]{2,}\z")


def basic(text: Column) -> Column:
    """White space cleaned, misread ditto marks and rates put right. [TXT2]"""
    # The misreadings, in this order.
    return F.trim(replaced(clean_spaces(text), ("Da.", "Do."), ("Da,", "Do."), ("Do,", "Do."), ("Vent.", "Cent."), ("Vent", "Cent")))


def header(text: Column) -> Column:
    """``basic`` and the misreadings of page headings. [TXT4]"""
    # The misreadings, in this order.
    return clean_spaces(replaced(basic(text), ("Rupoes", "Rupees"), ("Rupees.", "Rupees"), ("Extemal", "External"), ("Externa! ", "External ")))


def words(text: Column) -> Column:
    """The words of a text whose white space is clean."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def has_alphanumeric(text: Column) -> Column:
    return text.rlike("[A-Za-z0-9]")


def article_token(token: Column) -> Column:
    """A token without marks at its ends, in lower case. [TXT6]"""
    return F.lower(F.btrim(token, F.lit(ARTICLE_EDGES)))


def is_edge_noise(token: Column) -> Column:
    """Whether a token at an article's end, beside others, is noise. [PRD4]"""
    t = article_token(token)
    return (t == "") | t.rlike(r"\A\d{1,3}\z") | t.isin(NOISE_TOKENS) | ((F.length(t) == 1) & (t != "a")) | ~t.rlike("[a-z0-9]")


def strip_edges(text: Column) -> Column:
    """Noise dropped from the left, then from the right; one token stays, the last if all are noise. [TXT7]"""

    def kept(tokens: Column) -> Column:
        sound = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: ~is_edge_noise(F.get(tokens, i)))
        first, last = F.array_min(sound), F.array_max(sound)
        some = F.slice(tokens, F.coalesce(first, F.lit(0)) + 1, F.coalesce(last - first + 1, F.lit(0)))
        return F.when(F.size(tokens) < 2, F.array_join(tokens, " ")).otherwise(F.coalesce(F.when(first.isNotNull(), F.array_join(some, " ")), F.element_at(tokens, -1)))

    return F.transform(F.array(words(clean_spaces(text))), kept)[0]


def clean_article(text: Column) -> Column:
    """An article's name without noise around it, "" if nothing readable is left. [TXT8]"""
    value = basic(text)
    inner = F.regexp_replace(strip_edges(value), r'\A(?:[{}\[\]\\("]\s*)+', "")
    inner = clean_spaces(strip_edges(F.rtrim(inner, F.lit(ARTICLE_TAIL))))
    return F.when(is_placeholder(value) | ~has_alphanumeric(inner), "").otherwise(inner)


def clean_unit(text: Column) -> Column:
    """A unit in its usual spelling; every ditto mark is a double quote. [TXT10]"""
    value = basic(text)
    spellings = F.create_map(*[F.lit(x) for pair in UNIT_SPELLINGS.items() for x in pair])
    usual = F.coalesce(F.try_element_at(spellings, value), value)
    return F.when(value.isin(UNIT_DITTO), '"').when(usual.rlike('[A-Za-z0-9"]'), usual).otherwise("")


def clean_rate(text: Column, field: str) -> Column:
    """A duty rate in one of its usual forms, "Do." for a ditto mark, else the text. [TXT11]"""
    value = basic(text)
    plain = F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9.]+", " "))
    n = F.size(words(plain))
    has = lambda *parts: reduce(lambda a, b: a | b, (plain.contains(p) for p in parts))
    found = F.when(plain.isin(DITTO), "Do.")
    if field == "foreign_duty_rate":
        found = found.when(has("cent") & (n <= 3), "at 3 per Cent.")
    found = found.when(has("3") & has("cent") & has("at", "per") & (n <= 6), "at 3 per Cent.")
    return found.when(has("3") & has("rs") & has("md", "in") & (n <= 8), "at 3 Rs. per In. Md.").otherwise(value)


def clean_text(text: Column, field: str) -> Column:
    """The cleaning that a text field gets. [TXT5]"""
    value = basic(text)
    if field == "article":
        cleaned = clean_article(value)
    elif field == "unit":
        cleaned = clean_unit(value)
    elif field.endswith("_duty_rate"):
        cleaned = clean_rate(value, field)
    else:
        cleaned = F.when(has_alphanumeric(value), value).otherwise("")
    return F.when(is_placeholder(value), "").otherwise(cleaned)


def split_article_and_unit(article: Column, unit: Column) -> Column:
    """Struct of article and unit: a unit must be a known word; one that ends the article is cut from it, or found in it. [TXT12]"""
    a, u = basic(article), basic(unit)
    u = F.when(u.rlike(rf"(?i)\A(?:{UNIT_WORDS})\z"), u).otherwise("")
    tail = " ,;:-"
    ends = (u != "") & F.lower(a).endswith(F.lower(u))
    shorter = F.rtrim(F.substring(a, F.lit(1), F.length(a) - F.length(u)), F.lit(tail))
    inside = F.regexp_extract(a, rf"(?i)\b(?:{UNIT_WORDS})\z", 0)
    before = F.rtrim(F.substring(a, F.lit(1), F.length(a) - F.length(inside)), F.lit(tail))
    pair = lambda x, y: F.struct(x.alias("article"), y.alias("unit"))
    return (
        F.when(a == "", pair(F.lit(""), u))
        .when(ends, pair(shorter, u))
        .when((inside != "") & (before != ""), pair(before, F.when(u != "", u).otherwise(basic(inside))))
        .otherwise(pair(a, u))
    )


def strip_fences(text: Column) -> Column:
    """A model's answer without fence lines, outer white space and outer quotes. [TXT14]"""
    bare = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^```.*(?:\n|\z)", ""), F.lit(" \t\r\n"))
    return basic(F.btrim(bare, F.lit("\"'")))


def joined_cell(texts: Column, numeric: bool) -> Column:
    """The texts of a cell as one: digits run together, other text by spaces. [TXT13]"""
    return F.array_join(texts, "") if numeric else basic(F.array_join(texts, " "))


def comparable(value: Column) -> Column:
    """How a cell is compared: null is "", ends are trimmed. [TXT16]"""
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def header_field(text: Column, index: Column, article_index: Column, unit_index: Column, row_index: Column) -> Column:
    """Struct of field and kind for a column's heading; the first rule that holds. [TXT17]"""
    t = F.lower(F.coalesce(text, F.lit("")))
    is_ = lambda other: F.coalesce(index == other, F.lit(False))
    pair = lambda field, kind: F.struct((F.lit(field) if isinstance(field, str) else field).alias("field"), F.lit(kind).alias("kind"))
    # The words of headings.
    return (
        F.when(is_(row_index), pair("row_no", "numeric"))
        .when(is_(article_index) | t.contains("article"), pair("article", "text"))
        .when(is_(unit_index), pair("unit", "text"))
        .when(t.contains("remark"), pair("remarks", "text"))
        .when(t.contains("rates of duty") | t.contains("chargeable"), pair("duty_rate", "rate"))
        .when(t.contains("gross amount of duty"), pair("duty_amount", "numeric"))
        .when(t.isin("a.", "a", "as.", "annas"), pair("duty_as", "numeric"))
        .when(t.isin("p.", "p", "pies"), pair("duty_p", "numeric"))
        .otherwise(pair(F.format_string("column_%02d", index), "numeric"))
    )


def page_kind(role: Column, title: Column) -> Column:
    """indian, foreign or unknown, by the heading's band or else the title. [TXT18]"""
    t = F.lower(header(F.when(F.coalesce(role, F.lit("")) != "", role).otherwise(title)))
    return F.when(t.contains("indian") | t.contains("home ports"), "indian").when(t.contains("foreign") | t.contains("external ports"), "foreign").otherwise("unknown")


def sheet_name(name: Column) -> Column:
    """A name that a workbook takes for a sheet. [SNK6]"""
    return F.substring(F.regexp_replace(name, r"[\[\]*:/\\?]", "_"), 1, 31)
