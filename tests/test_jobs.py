"""From drawn page images to records and rows, with readers that know where the text stands."""

import logging
import re
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle

from quireflow import cli
from quireflow.operators import engines
from quireflow.plans import jobs
from quireflow.sources import layouts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module

NAMES = ["Rice", "Paddy", "Coffee", "Indigo"]
HEIGHT = {"left": 1400, "right": 1500}


def rows_y(side, height):
    n, first, bottom, *_ = layouts.SPREADS[1]
    top, low = height * layouts.BODY_TOP[side], height * bottom
    return [(first + i, top + (low - top) / (n - 1) * i) for i in range(n)]


def spread_reader(image):
    """Row numbers, articles and values in their places; the article of row 7 and the total of row 9 can't be read on the page."""
    h, w = image.shape[:2]
    side = "left" if w < 620 else "right"
    columns = layouts.LEFT_COLUMNS if side == "left" else layouts.RIGHT_COLUMNS
    for row, y in rows_y(side, h):
        said = {"row_no": str(row)}
        if side == "left":
            said |= {"article": NAMES[row % 4] if row != 7 else "", "unit": "lbs.", "foreign_value_rs": f"{row},500", "foreign_duty_rate": "at 3 per Cent." if row % 5 == 1 else "Do."}
        else:
            said |= {"indian_value_rs": f"{row},100", "total_value": f"{row},600" if row != 9 else ""}
        for field, text in said.items():
            a, b = columns[field]
            if text:
                # of the grids that all numbers fit the one with the least step and intercept wins; texts stand in its rows
                own = y if field == "row_no" else 203 + 18.23 * (row - 1) if side == "left" else 168 + 19.58 * (row - 1)
                yield text, 0.95, int(w * (a + b) / 2) - 2, int(own) - 4, 4, 8


def cell_reader(image, setting):
    return ("9,600", 0.9) if "whitelist" in setting else ("Sugar Candy", 0.9)


def page(side):
    h, w = HEIGHT[side], 900 if side == "left" else 905
    image = np.full((h, w), 250, dtype=np.uint8)
    # ink where row 7's article and row 9's total stand, so that they don't look blank
    x, y, bw, bh = layouts.SPREADS[1][3 if side == "left" else 4]
    tw, th = int(w * bw), int(h * bh)
    columns, row, field = (layouts.LEFT_COLUMNS, 7, "article") if side == "left" else (layouts.RIGHT_COLUMNS, 9, "total_value")
    (a, b), at = columns[field], dict(rows_y(side, th))[row]
    left, top = int(w * x), int(h * y)
    for k in range(5):
        image[top + int(at) - 9 : top + int(at) + 5, left + int(tw * (a + (b - a) * (0.2 + 0.12 * k))) :][:, :4] = 20
    return "book.pdf", 1 if side == "left" else 2, h, w, 1, image.tobytes()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([page("left"), page("right")], "source_file string, page_number int, height int, width int, nChannels int, data binary")


def test_records_from_images(spark, pages, tmp_path):
    got = jobs.spread_records(pages, str(tmp_path), {"tesseract": lambda: spread_reader}, {"tesseract": lambda: cell_reader}, ["Sugar Candy", *NAMES], denoise=False)
    rows = {r["row_no"]: r for r in got.collect()}
    assert sorted(rows) == list(range(1, 47))
    for n, r in rows.items():
        assert r["article"] == ("Sugar Candy" if n == 7 else NAMES[n % 4]), n
        assert (r["unit"], r["foreign_value_rs"], r["indian_value_rs"]) == ("lbs.", n * 1000.0 + 500, n * 1000.0 + 100), n
        assert r["total_value"] == n * 1000.0 + 600 and r["foreign_duty_rate"] == "at 3 per Cent.", n
    assert rows[1]["page_number"] == "1-2" and rows[1]["confidence_flag"] == "ok"


def test_records_without_cell_readers(spark, pages, tmp_path):
    rows = {r["row_no"]: r for r in jobs.spread_records(pages, str(tmp_path), {"tesseract": lambda: spread_reader}, {}, layout="madras_exports_v1", denoise=False).collect()}
    assert rows[7]["article"] == "" and rows[9]["total_value"] is None and rows[8]["article"] == NAMES[0]


COLUMNS = [(10, 60), (60, 260), (260, 300), (300, 420), (420, 560)]


def import_page(name, number):
    """A ruled page: a line between columns, one under the header and one at the foot."""
    image = np.full((1700, 600), 250, dtype=np.uint8)
    for x in {x for c in COLUMNS for x in c}:
        image[100:1600, 20 + x - 1 : 20 + x + 1] = 10
    for y in (100, 240, 1598):
        image[y : y + 2, 30:580] = 10
    return name, number, 1700, 600, 1, image.tobytes()


def centre(row, first, height):
    return 170 + (height - 200) / 47 * (row - first)


def import_reader(first):
    def read(image):
        h = image.shape[0]
        edges = [x + 12 + 8 for x in sorted({x for c in COLUMNS for x in c})]  # about where the rules are in the table
        yield "Imports from Foreign ports", 0.9, 200, 20, 40, 10
        for left, right, text in zip(edges, edges[1:], ["No.", "Names of Articles", "Unit", "Remarks, Foreign ports", "Gross Amount of Duty"], strict=False):
            yield text, 0.9, (left + right) // 2 - 5, 110, 10, 10
        for row in range(first, first + 47):
            y = int(centre(row, first, h)) - 5
            yield f"Goods {row}", 0.9, (edges[1] + edges[2]) // 2, y, 4, 10
            yield "Bags", 0.9, (edges[2] + edges[3]) // 2, y, 4, 10
            yield f"{row}00", 0.9, (edges[4] + edges[5]) // 2, y, 4, 10

    return read


def number_reader(first):
    def read(strip):
        """Row numbers of the first strip, with a margin and twice as large; other strips are wider."""
        if strip.shape[1] > 2 * (50 + 8 + 16) + 8:
            return
        h = (strip.shape[0] - 32) // 2 + 8
        for row in range(first, first + 47, 2):
            yield f"{row}.", 0.9, 0, 2 * (centre(row, first, h) + 8) - 10, 20, 20 - 8
        yield "700", 0.9, 0, 50, 20, 20
        yield "12", -1.0, 0, 60, 20, 20

    return read


def test_rows_from_import_pages(spark, tmp_path):
    pages = spark.createDataFrame([import_page("186465_TotalImports_1.pdf", 4), import_page("other.pdf", 1)], "source_file string, page_number int, height int, width int, nChannels int, data binary")
    rows, headers = jobs.import_rows(pages, str(tmp_path), {"tesseract": lambda: import_reader(48)}, {"six": lambda: number_reader(48), "eleven": lambda: number_reader(48)}, denoise=False)
    got = rows.toPandas()
    assert sorted(got["source_file"].unique()) == ["186465_TotalImports_1.pdf", "other.pdf"]
    for _, mine in got.groupby("source_file"):
        assert sorted(mine["row_no"]) == list(range(48, 95)) and set(mine["page_kind"]) == {"foreign"}
        assert all(r.article == f"Goods {r.row_no}" and r.unit == "Bags" for r in mine.itertuples())
        assert any(all(mine[c] == mine["row_no"].astype(str) + "00") for c in mine.columns if re.match("col_", c))
    assert headers.where("error is null").count() == 2


def test_a_page_without_numbers(spark, tmp_path):
    """Known pages fall back on their rules, others become error records."""
    pages = spark.createDataFrame([import_page("186465_TotalImports_1.pdf", 4), import_page("other.pdf", 1)], "source_file string, page_number int, height int, width int, nChannels int, data binary")
    rows, headers = jobs.import_rows(pages, str(tmp_path), {"tesseract": lambda: import_reader(48)}, {"six": lambda: lambda strip: iter(())}, denoise=False)
    got = rows.toPandas()
    assert set(got["source_file"]) == {"186465_TotalImports_1.pdf"} and sorted(got["row_no"]) == list(range(48, 95))
    errors = headers.where("error is not null").collect()
    assert [r["source_file"] for r in errors] == ["other.pdf"]


def test_no_rows(spark, pages, tmp_path):
    assert isinstance(jobs.spread_records(pages.limit(0), str(tmp_path), {"tesseract": lambda: spread_reader}, {}).toPandas(), pd.DataFrame)


@pytest.fixture
def logs_restored():
    before = logging.root.handlers[:]
    yield
    for handler in logging.root.handlers:
        if handler not in before:
            handler.close()
    logging.root.handlers = before


def test_command_line(spark, tmp_path, capsys, monkeypatch, logs_restored):
    (tmp_path / "truth.csv").write_text("row_no,article,unit\n1,Rice,lbs.\n2,Paddy,\n3,Tea,No.\n")
    (tmp_path / "read.csv").write_text('row_no,article,extra\n1,Rice,x\n2,"Paddy, wet",y\n')
    assert cli.main(["evaluate", str(tmp_path / "truth.csv"), str(tmp_path / "read.csv")]) == 0
    assert capsys.readouterr().out.splitlines() == ["article: 1 of 2", "*: 1 of 2", "row 2, article: 'Paddy', read 'Paddy, wet'"]
    for bad in (["evaluate", "none.csv", "none.csv"], ["spreads", "none", "out", "--engines", "m:f"], ["spreads", str(tmp_path), "out", "--engines", "m:f", "--start-page", "0"], []):
        with pytest.raises(SystemExit):
            cli.main(bad)
    (tmp_path / "scans").mkdir()
    (tmp_path / "scans" / "book.pdf").write_bytes(b"x")
    (tmp_path / "scans" / "bad.pdf").write_bytes(b"y")

    def render(content):
        if content == b"y":
            raise ValueError("no pages")
        yield from (page(side)[2:] for side in ("left", "right"))

    made = {"pages": render, "page_readers": {"tesseract": lambda: spread_reader}}
    monkeypatch.setattr(cli, "_engines", lambda named: made)
    assert cli.main(["spreads", str(tmp_path / "scans"), str(tmp_path / "out"), "--engines", "m:f"]) == 0
    rows = cli.files.read_text_table(spark, str(tmp_path / "out" / "records"))
    assert rows.count() == 46 and rows.where("article = 'Rice'").count() > 8
    log = (tmp_path / "out" / "run.log").read_text()
    assert "rows_total: 46" in log and "no pages" in log


def test_engines_are_located(tmp_path):
    (tmp_path / "engine").write_text("")
    assert engines.located("no-such-engine", ["nowhere", str(tmp_path / "engine")]) == str(tmp_path / "engine")
    with pytest.raises(FileNotFoundError):
        engines.located("no-such-engine")
