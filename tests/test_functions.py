"""Scalar rules, with expectations from reading them and from small independent models."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.functions import geometry, numbers, scoring, similarity, text


def applied(spark, values, *functions):
    columns = [f(F.col("v")) for f in functions]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    found = rows.select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in found]


def test_basic_text(spark):
    given_ = {"  a \t\n b\u00a0c ": "a b c", "Da. x Da, Do,": "Do. x Do. Do.", "3 per Vent": "3 per Cent", None: "", "": ""}
    assert applied(spark, given_, text.basic) == list(given_.values())


def test_placeholders(spark):
    given_ = {"": True, None: True, " . . ": True, "—": False, "--": True, "Shoes...": False, ".": False, "|:_": True}
    assert applied(spark, given_, text.is_placeholder) == list(given_.values())


def test_headers(spark):
    given_ = {"Rupoes": "Rupees", "Rupees.": "Rupees", "Externa! Ports": "External Ports", "Extemal": "External"}
    assert applied(spark, given_, text.header) == list(given_.values())


def test_articles(spark):
    given_ = {
        "12 Boots and Shoes 9": "Boots and Shoes",
        "1 2 3": "3",
        "| ve Coffee...,": "Coffee",
        '{( "Hides, Tanned;': "Hides, Tanned",
        "....": "",
        "a Wool x": "a Wool",
        "°": "",
        None: "",
    }
    assert applied(spark, given_, text.clean_article) == list(given_.values())


def test_units(spark):
    given_ = {"No]": "No.", "Cwtl": "Cwt.", "Ibs": "lbs.", "“": '"', "”": '"', "-": "", "Pieces": "Pieces", None: ""}
    assert applied(spark, given_, text.clean_unit) == list(given_.values())


def test_rates(spark):
    given_ = {
        "Da.": ("Do.", "Do."),
        "at 3 per Vent.": ("at 3 per Cent.",) * 2,
        "8 cent": ("at 3 per Cent.", "8 cent"),
        "3 Rs per In. Md.": ("at 3 Rs. per In. Md.",) * 2,
        "at 5 per Cent. of it": ("at 5 per Cent. of it",) * 2,
        "": ("", ""),
    }
    assert applied(spark, given_, lambda v: text.clean_rate(v, "foreign_duty_rate"), lambda v: text.clean_rate(v, "indian_duty_rate")) == list(given_.values())


def test_article_and_unit(spark):
    given_ = {("Coffee Cwt.", ""): ("Coffee", "Cwt."), ("Bags", ""): ("Bags", ""), ("Horses No", "no"): ("Horses", "no"), ("Wool", '"'): ("Wool", ""), ("", "Pairs"): ("", "Pairs")}
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(given_)], "i int, a string, u string")
    got = rows.select("i", F.inline(F.array(text.split_article_and_unit(F.col("a"), F.col("u"))))).orderBy("i").collect()
    assert [(r["article"], r["unit"]) for r in got] == list(given_.values())


def test_answers_lose_fences(spark):
    assert applied(spark, ['```text\n"Coffee"\n```', " 'Tea' ", None], text.strip_fences) == ["Coffee", "Tea", ""]


def test_sheet_names(spark):
    assert applied(spark, ["a[b]*c:/\\?d", "x" * 40], text.sheet_name) == ["a_b__c____d", "x" * 31]


def model_number(raw):
    """The rule for numbers, said again in plain Python."""
    s = re.sub(r"\s+", " ", raw).strip()
    if not s or re.fullmatch(r"[.\-–—_:;|]{2,}", s.replace(" ", "")):
        return None, False
    s = s.translate(str.maketrans({" ": "", ",": "", "|": "", "—": "-", "−": "-"})).strip(".,;:")
    if re.fullmatch(r"-?[0-9]{1,3}(\.[0-9]{3})+", s) or re.fullmatch(r"-*[0-9]+\.[0-9]{3}", s):
        s = s.replace(".", "")
    return (float(s), False) if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", s) else (None, True)


def test_numbers_agree_with_model(spark):
    @settings(max_examples=20, deadline=None)
    @given(st.lists(st.text("0123456789.,-—|; x", max_size=9), min_size=30, max_size=30))
    def check(values):
        got = applied(spark, values, numbers.clean_number)
        assert [(r["value"], r["suspicious"]) for r in got] == [model_number(v) for v in values]

    check()


def test_row_numbers(spark):
    given_ = {"101": 101, "95.": 95, "7": 107, "x41": 141, "1 2": None, "": None, "900": None, "99999999999": None}
    assert applied(spark, given_, lambda v: numbers.row_number_in(v, F.lit(95), F.lit(141))) == list(given_.values())


def test_numbers_are_rendered(spark):
    got = spark.createDataFrame([(79.0,), (1.5,), (None,), (12345678901.0,)], "v double").select(numbers.rendered(F.col("v"))).collect()
    assert [r[0] for r in got] == ["79", "1.5", None, "12345678901"]


@pytest.mark.parametrize(
    ("field", "value", "confidence", "expected"),
    [
        ("total_value", "1,234", 0.5, 0.5 + 1.5 + 0.16 + 0.8),
        ("total_value", "1.234", 0.5, 0.5 + 1.5 + 0.16 - 0.4),
        ("total_value", "0,123", None, 1.5 + 0.16 + 0.8 - 1.2),
        ("total_value", "12a", 0.0, -1.5 + 0.08),
        ("total_value", "..", 0.9, -10.0),
        ("foreign_duty_rate", "Do.", 0.2, 1.2),
        ("foreign_duty_rate", "3", 0.2, -0.4),
        ("article", "Boots and Shoes", 0.5, 0.5 + 13 * 0.04 + 0.8 + 0.5 + 0.15),
        ("article", "|x", 0.0, 0.04 - 0.35 - 0.2 - 0.4),
        ("unit", "Cwt.", 0.1, 0.4),
    ],
)
def test_scores(spark, field, value, confidence, expected):
    row = spark.createDataFrame([(field, value, confidence)], "f string, v string, c double")
    got = row.select(scoring.score(field, F.col("v"), F.col("c")), scoring.score_of(F.col("f"), F.col("v"), F.col("c"))).first()
    assert got[0] == pytest.approx(expected) and got[1] == pytest.approx(expected)


def test_variant_boxes(spark):
    base = geometry.box(F.lit(0), F.lit(100), F.lit(10), F.lit(40))
    row = spark.range(1).select(geometry.variants(F.lit("article"), base, F.lit(100), F.lit(50)).alias("v"), geometry.variants(F.lit("foreign_duty_as"), base, F.lit(300), F.lit(50)).alias("w")).first()
    # at the page's edges wider is base, and wide_tall is taller
    assert [v["variant"] for v in row["v"]] == ["base", "taller", "shift_left", "shift_right"]
    assert [v["variant"] for v in row["w"]] == ["base", "wider", "shift_right"]


def test_likeness():
    assert similarity.common("kitten", "sitting") == 4
    assert similarity.ratio("Coffee", "Coffee") == 100
    assert similarity.weighted_ratio("Shoes and Boots", "Boots and Shoes") >= 95
    assert similarity.best_match("Cof fce", ["Coffee", "Copper", "Toffee"])[0] == "Coffee"
    assert similarity.weighted_ratio("", "x") == 0


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_common_subsequence_agrees_with_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.common(a, b) == table[-1][-1]
