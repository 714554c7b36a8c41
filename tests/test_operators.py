"""Operators and plans on pages whose layout is known."""

import base64
import http.server
import io
import json
import threading
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.operators import cells, choose, compare, engines, grid, images, rasters, records, review, windows
from quireflow.plans import imports, spread
from quireflow.schema import OUTPUT_COLUMNS
from quireflow.functions.geometry import chosen_table
from quireflow.sources import artefacts, articles, files, layouts
from quireflow.streaming import folder


def test_dittos_reach_over_blanks(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(["Do.", "at 3", "", "do", "per Do.", "x", "DO."])], "s int, n int, r string")
    got = windows.fill_dittos(rows, ["r"], ["s"], ["n"]).orderBy("n").collect()
    assert [r["r"] for r in got] == ["", "at 3", "", "at 3", "at 3", "x", "x"]


def test_row_bounds_of_one_row(spark):
    got = windows.row_bounds(spark.createDataFrame([("p", 1, 5.0, 100)], "page string, row_no int, centre double, height int"), ["page"]).first()
    assert (got["top"], got["bottom"]) == (0, 15)


def test_tokens_on_an_edge_fall_in_both_boxes(spark):
    tokens = spark.createDataFrame([(1, 0, "x", 0.9, 5, 60, 10, 8), (1, 1, "y", 0.9, 0, 0, 0, 0)], "page int, pos int, text string, confidence double, x int, y int, width int, height int")
    boxes = spark.createDataFrame([(1, "a", 0, 10, 0, 64), (1, "b", 10, 20, 64, 200)], "page int, field string, left int, right int, top int, bottom int")
    got = cells.tokens_in_boxes(tokens, boxes, ["page"]).select("field", "text").collect()
    assert sorted(map(tuple, got)) == [("a", "x"), ("a", "y"), ("b", "x")]


def test_cells_join_numbers_and_drop_noise(spark):
    tokens = spark.createDataFrame([(1, i, t, c, x, 5, 2, 2) for i, (t, c, x) in enumerate([("234", 0.8, 9), ("1,", 0.6, 1), ("--", 0.9, 5), ("ve", 0.1, 7)])], "page int, pos int, text string, confidence double, x int, y int, width int, height int")
    boxes = spark.createDataFrame([(1, f, 0, 20, 0, 20) for f in ("total_value", "remarks")], "page int, field string, left int, right int, top int, bottom int")
    got = {r["field"]: r for r in cells.cell_texts(cells.visible_tokens(tokens), boxes, ["page"], ["field"]).collect()}
    assert got["total_value"]["text"] == "1,234" and got["remarks"]["text"] == "1, 234"
    assert got["remarks"]["confidence"] == pytest.approx((0.8 + 0.6 + 0.9) / 3)


def test_engines_vote_and_names_win(spark):
    rows = [(1, "tesseract", "1,234"), (1, "paddle", "1234."), (1, "glm", "99"), (2, "glm", "7"), (2, "paddle", "8"), (3, "paddle", "—"), (3, "glm", "")]
    out = spark.createDataFrame(rows, "cell int, engine string, value string")
    got = {r["cell"]: tuple(r)[1:] for r in choose.voted_numbers(out, ["cell"]).collect()}
    assert got == {1: ("1234", "tesseract", pytest.approx(2 / 3)), 2: ("8", "paddle", 0.5), 3: ("", "none", 0.0)}
    out = spark.createDataFrame([(1, "tesseract", "Cofee"), (1, "glm", "Coffee"), (2, "glm", " ")], "cell int, engine string, value string")
    got = {r["cell"]: (r["value"], r["engine"]) for r in choose.picked_text(out, ["cell"], ["Coffee", "Tea"]).collect()}
    assert got == {1: ("Coffee", "glm"), 2: ("", "none")}
    assert choose.picked_text(out, ["cell"], []).where("cell = 1").first()["engine"] == "glm"


def test_first_good_box_ends_the_search(spark):
    rows = [
        (1, "total_value", 0, "base", "1,234", 0.9, "t", False),
        (1, "total_value", 1, "wider", "1,234,567", 0.99, "t", False),
        (2, "total_value", 0, "base", "1a", 0.2, "t", False),
        (2, "total_value", 1, "wider", "12", 0.9, "t", False),
        (2, "total_value", 2, "taller", "12", 0.9, "t", False),
        (3, "unit", 0, "base", "", None, "t", True),
    ]
    table = spark.createDataFrame(rows, "cell int, field string, ord int, variant string, text string, confidence double, engine string, likely_blank boolean")
    got = {r["cell"]: (r["text"], r["engine"]) for r in choose.best_variant(table, ["cell"]).collect()}
    assert got == {1: ("1,234", "t@base"), 2: ("12", "t@wider"), 3: ("", "blank_classifier")}


def test_last_reading_of_an_engine_counts(spark):
    rows = spark.createDataFrame([(1, 0, "tesseract:a", "x"), (1, 1, "tesseract:b", "y"), (1, 2, "paddle", "z")], "cell int, ord int, engine string, text string")
    assert cells.readings_by_engine(rows, ["cell"]).first()["all"] == {"tesseract": "y", "paddle": "z"}


def spread_tokens(spark):
    """Two pages of a spread: row numbers, articles and values where the layout has them."""
    width, height, tokens, step = 2000, 3000, [], 3000 * (0.982 - 0.188) / 45
    for side, strip, field, ends in (("left", 0.02, "foreign_value_rs", (0.58188, 0.71506)), ("right", 0.01, "total_value", (0.73675, 0.85369))):
        top = 3000 * (0.188 if side == "left" else 0.165)
        for n in range(1, 47):
            y = int(top + step * (n - 1)) - 10
            tokens.append((side, len(tokens), str(n), 0.9, int(width * strip), y, 10, 20))
            tokens.append((side, len(tokens), f"{n},500", 0.9, int(width * sum(ends) / 2) - 20, y, 40, 20))
            if side == "left":
                tokens += [(side, len(tokens), "Coffe" if n == 3 else "Coffee", 0.9, 300, y, 60, 20), (side, len(tokens) + 1, "Do." if n > 1 else "at 3 per Cent.", 0.9, 1500, y, 60, 20)]
    tokens = spark.createDataFrame([("f.pdf", 1, *t) for t in tokens], "source_file string, start_page int, side string, pos int, text string, confidence double, x int, y int, width int, height int")
    pages = layouts.layouts(spark).where("start = 1").select(F.lit("f.pdf").alias("source_file"), F.lit(1).alias("start_page"), "side", F.lit(width).alias("width"), F.lit(height).alias("height"), "body_top", "body_bottom", "strip_start", "strip_end", "expected_rows", "row_start")
    return tokens, pages


def test_spread_becomes_records(spark, tmp_path):
    tokens, pages = spread_tokens(spark)
    got = spread.extract(tokens, pages, articles.KNOWN_ARTICLES).cache()
    rows = {r["row_no"]: r for r in got.collect()}
    assert sorted(rows) == list(range(1, 47))
    # of equal fits the smallest step wins, so that at a page's ends a token may lie on a row's padding
    assert sum(r["article"] == "Coffee" for r in rows.values()) >= 40 and {r["article"] for r in rows.values()} <= {"Coffee", ""}
    assert sum(r["foreign_duty_rate"] == "at 3 per Cent." for r in rows.values()) >= 40
    for field in ("foreign_value_rs", "total_value"):
        assert sum(rows[n][field] == n * 1000 + 500 for n in rows) >= 40 and all(rows[n][field] in (None, n * 1000 + 500) for n in rows)
    assert {r["confidence_flag"] for r in rows.values()} <= {"ok", "review:first_article_unresolved"}
    files.write_csv(got, str(tmp_path / "csv"))
    back = files.read_text_table(spark, str(tmp_path / "csv"))
    assert back.columns == OUTPUT_COLUMNS and back.where("row_no = '20'").first()["total_value"] == "20500"
    assert compare.field_matches(back, files.as_text(got).na.fill("")).where("field = '*'").first()["matches"] == 46
    book = zipfile.ZipFile(io.BytesIO(files.records_workbook(got)))
    assert "xl/worksheets/sheet3.xml" in book.namelist()
    sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert 'state="frozen"' in sheet and sheet.count("<row ") == 47 and "autoFilter" in sheet
    got.unpersist()


def test_sparse_numbers_leave_the_template(spark):
    tokens, pages = spread_tokens(spark)
    few = tokens.where("pos < 3")
    got = grid.row_centres(few, pages, ["side"]).where("side = 'left' and row_no in (1, 46)").orderBy("row_no").collect()
    assert [round(r["centre"], 6) for r in got] == [564.0, 2946.0]


def test_import_pages(spark):
    """One page fits its numbers, one falls back to its rules, one has neither."""
    page = lambda n: ("i.pdf", n)
    numbers = spark.createDataFrame([(*page(1), 0, r, 200.0 + 40 * (r - 47), 0.9, r) for r in range(48, 95)], "source_file string, page_number int, strip int, row_no int, y double, confidence double, pos int")
    edges = [(0, 60), (60, 500), (500, 580), (580, 900)]
    columns = spark.createDataFrame([(*page(n), i, a, b, 1000) for n in (1, 2, 3) for i, (a, b) in enumerate(edges)], "source_file string, page_number int, index int, left int, right int, page_width int")
    pages = spark.createDataFrame([(*page(1), 1000, 2300, None), (*page(2), 1000, 2300, 95), (*page(3), 1000, 2300, None)], "source_file string, page_number int, width int, height int, expected_start int")
    peaks = spark.createDataFrame([(*page(2), 200.0), (*page(2), 2200.0)], "source_file string, page_number int, position double")
    words = [(1, "External Ports", 300, 80), (1, "Coffee", 200, 230), (1, "Cwt.", 530, 230), (1, "12", 700, 230), (2, "Home Ports", 300, 100)]
    tokens = spark.createDataFrame([(*page(n), i, t, 0.9, x, y, 20, 20) for i, (n, t, x, y) in enumerate(words)], "source_file string, page_number int, pos int, text string, confidence double, x int, y int, width int, height int")
    got, headers = imports.page_rows(tokens, numbers, columns, pages, peaks)
    rows = {(r["page_number"], r["row_no"]): r for r in imports.wide(got).collect()}
    assert len(rows) == 94 and {k[1] for k in rows if k[0] == 2} == set(range(95, 142))
    first = rows[1, 48]
    assert (first["article"], first["unit"], first["col_03"], first["page_kind"]) == ("Coffee", "Cwt.", "12", "foreign")
    kinds = {r["page_number"]: (r["page_kind"], r["error"]) for r in headers.collect()}
    assert kinds == {1: ("foreign", None), 2: ("indian", None), 3: ("error", "no row positions found")}


def test_flags(spark):
    blank = {c: "" for c in OUTPUT_COLUMNS if c not in ("row_no", "llm_notes", "confidence_flag")}
    rows = [
        blank | {"row_no": 1, "article": "Do.", "mean_confidence": 0.9},
        blank | {"row_no": 2, "article": "Spices", "mean_confidence": 0.9},
        blank | {"row_no": 3, "article": "Coffee", "foreign_duty_as": "16", "foreign_duty_p": "4", "total_value": "x1", "mean_confidence": 0.54},
        blank | {"row_no": 4, "article": "Coffee", "foreign_duty_p": "3", "mean_confidence": None},
    ]
    got = records.finalize(spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'row_no' else 'double' if c == 'mean_confidence' else 'string'}" for c in rows[0])), ["source_file"])
    flags = {r["row_no"]: r["confidence_flag"] for r in got.collect()}
    assert flags == {1: "review:first_article_unresolved", 3: "review:annas_out_of_range;low_ocr_confidence;pies_out_of_range;total_value_non_numeric", 4: "ok"}
    assert {r["metric"]: r["value"] for r in records.summary(got).collect()} == {"rows_total": 3, "rows_ok": 1, "rows_review": 2}


def test_review_applies_the_last_word(spark):
    rows = spark.createDataFrame([(1, i, f"a{i}", "", "", float(i), "ok" if i == 9 else "review:x", None) for i in range(1, 10)], "spread int, row_no int, article string, foreign_duty_rate string, indian_duty_rate string, total_value double, confidence_flag string, llm_notes string")

    def client(prompt):
        asked = json.loads(prompt.split("Rows:\n")[1])
        if len(asked) < 6:
            raise TimeoutError
        told = [{"row_no": r["row_no"], "notes": "n", "duty_rate_ok": r["row_no"] != 2} for r in asked]
        told += [{"row_no": 3, "article_suggestion": "Tea ]", "notes": None}, {"row_no": 9, "article_suggestion": "Rice"}, {"notes": "lost"}]
        return "Sure:\n```json\n".replace("```json\n", "") + json.dumps(told) + " done]"

    got = {r["row_no"]: r for r in review.reviewed(rows, ["spread"], ["Tea"], client).collect()}
    assert (got[1]["llm_notes"], got[1]["confidence_flag"]) == ("n", "review:x")
    assert got[2]["confidence_flag"] == "review:x;llm_flagged_duty_rate"
    assert (got[3]["article"], got[3]["llm_notes"], got[3]["confidence_flag"]) == ("Tea ]", None, "review:x;llm_corrected_article")
    assert (got[9]["article"], got[9]["confidence_flag"]) == ("Rice", "ok;llm_corrected_article")
    assert got[7]["llm_notes"] is None


def test_json_arrays():
    assert review.first_json_array('```json\n[{"a": "]"}]\n```') == '[{"a": "]"}]'
    assert review.first_json_array("x [1, [2]] y") == "[1, [2]]"
    assert review.first_json_array("[1, 2") is None and review.first_json_array(None) is None


def test_golden_comparison(spark):
    truth = spark.createDataFrame([("1", "a", " b"), ("2", "c", None), ("3", "d", "")], "row_no string, article string, unit string")
    read = spark.createDataFrame([("1", "a", "b"), ("2", "x", ""), ("9", "", "")], "row_no string, article string, unit string")
    assert {r["field"]: (r["matches"], r["joined"]) for r in compare.field_matches(truth, read).collect()} == {"article": (1, 2), "unit": (2, 2), "*": (1, 2)}
    assert [tuple(r) for r in compare.differences(truth, read).collect()] == [("2", "article", "c", "x")]
    with pytest.raises(ValueError):
        compare.comparable_fields(truth.drop("row_no"), read)


def test_layout_presets(spark):
    assert layouts.resolve("madras_exports_auto", 5) == 5 and layouts.resolve("madras_exports_186566_p9_p10", 1) == 9
    with pytest.raises(KeyError):
        layouts.resolve("madras_exports_auto", 11)
    assert layouts.layouts(spark).where("side = 'left'").agg(F.sum("expected_rows")).first()[0] == 202
    assert len(articles.KNOWN_ARTICLES) == 181
    assert spark.range(1).select(files.spread_starts(F.lit(6)), files.spread_starts(F.lit(0))).first()[:] == ([1, 3, 5], [])


def test_debug_rows_follow_their_records(spark):
    made = spark.createDataFrame([(1, 1, "unit", "x", 0.5, "t", [0, 1, 2, 3], {"t": "x"}), (1, 2, "unit", "y", None, None, [0, 1, 2, 3], {})], "spread int, row_no int, field string, text string, confidence double, engine string, crop_box array<int>, all map<string,string>")
    anchors = spark.createDataFrame([(1, 1, 10.0)], "spread int, row_no int, left_row_anchor double")
    tree = cells.debug_tree(made, anchors, ["spread"])
    got = cells.surviving(tree, spark.createDataFrame([(1, 2)], "spread int, row_no int"), ["spread", "row_no"]).collect()
    assert len(got) == 1 and got[0]["cells"]["unit"]["text"] == "y" and got[0]["left_row_anchor"] is None


def test_kernels():
    page = rasters.raster(5, 3)
    binary = images.ink(page)
    assert images.rule_profile(binary, "y").argmax() == 10 and images.rule_profile(binary, "x").argmax() == 11
    assert images.cell_features(np.zeros((50, 50), np.uint8))["likely_blank"] and not images.cell_features(binary)["likely_blank"]
    blobs = np.zeros((6, 8), np.uint8)
    blobs[0:2, 0:2] = blobs[2, 2] = blobs[4:6, 5:8] = 1
    blobs[5, 1] = 1
    assert sorted(np.bincount(images.components(blobs).ravel())[1:][np.bincount(images.components(blobs).ravel())[1:] > 0].tolist()) == [1, 5, 6]
    square = np.ones((5, 5), np.uint8)
    square[0] = 0
    assert images.distances(square)[4, 2] == pytest.approx(4 * 0.955)
    two = np.array([[10] * 8 + [200] * 8] * 4, np.uint8)
    assert 10 <= images.otsu_threshold(two) < 200 and set(np.unique(images.otsu(two))) == {0, 255}
    assert images.prepared(two).shape == (round(20 * 2.2), round(32 * 2.2))
    assert images.equalized(page).shape == page.shape and images.denoised(page[:20, :20]).shape == (20, 20)
    assert [n for n, _ in images.cell_variants(page, "total_value")] == ["numeric_binary", "numeric_adaptive", "numeric_gray"]
    assert [n for n, _ in images.cell_variants(page, "article")] == ["text_gray", "text_binary", "text_adaptive"]
    ruled = images.without_rules(images.otsu(page))
    assert (ruled[10, 4:60] == 255).mean() > 0.8
    x, y, w, h = images.import_table_box(np.kron(binary, np.ones((8, 8), np.uint8)))
    assert w > 200 and h > 100 and x >= 0 and y >= 0
    assert images.gray(np.array([[[255, 0, 0], [0, 0, 255]]], np.uint8)).tolist() == [[29, 76]]


def test_stacks_of_images_have_the_features_of_each(spark):
    """Images of mixed shapes, more than one stack of them, and none of any pixel."""
    rng, rows = np.random.default_rng(6), []
    for i in range(90):
        h, w = ((48, 64), (48, 64), (30, 9), (0, 5))[i % 4]
        rows.append((f"p{i}", h, w, 1, 0, bytearray(np.where(rng.random((h, w)) < 0.2, 30, 240).astype(np.uint8).tobytes())))
    one = spark.createDataFrame([("rgb", 48, 64, 3, 16, bytearray(np.repeat(rasters.raster(7, 3)[:, :, None], 3, 2).tobytes()))], "origin string, height int, width int, nChannels int, mode int, data binary")
    flat = spark.createDataFrame(rows, one.schema).unionAll(one)
    pages = flat.selectExpr("struct(*) AS image").where("image.height > 0")
    got = {r["origin"]: r.asDict() for r in images.image_features_and_peaks(pages).collect()}
    assert len(got) == 69
    for origin, h, w, channels, _, data in pages.select("image.*").collect():
        binary = images.ink(images.gray(images.decoded(h, w, channels, data)))
        peaks = {a: images.rule_profile(binary, a).max() for a in "xy"}
        assert got[origin] == {"origin": origin} | images.cell_features(binary) | peaks


def test_pages_are_rendered_and_errors_kept(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"2")
    (tmp_path / "b.pdf").write_bytes(b"x")
    found = files.documents(spark, str(tmp_path))

    def pages_of(content):
        for _ in range(int(content)):
            yield 1, 2, 1, b"ab"

    got = sorted((r["path"][-5:], r["page_number"], r["error"] is None) for r in files.rendered_pages(found, pages_of).collect())
    assert got == [("a.pdf", 1, True), ("a.pdf", 2, True), ("b.pdf", 1, False)]
    with pytest.raises(FileNotFoundError):
        files.documents(spark, str(tmp_path), "*.tif")


def test_denoising_agrees_with_plain_means():
    rng = np.random.default_rng(8)
    page = np.where(rng.random((9, 12)) < 0.3, rng.integers(0, 90, (9, 12)), 220).astype(np.uint8)
    h, w, r, p = *page.shape, images.SEARCH // 2, images.PATCH // 2
    at = lambda y, x: float(page[min(max(y, 0), h - 1), min(max(x, 0), w - 1)])
    near = lambda y, x: [(min(max(y + i, 0), h - 1), min(max(x + j, 0), w - 1)) for i in range(-p, p + 1) for j in range(-p, p + 1)]
    for y, x in ((0, 0), (4, 6), (8, 11), (2, 9)):
        total = weight = 0.0
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                gap = np.mean([(at(i, j) - at(i + dy, j + dx)) ** 2 for i, j in near(y, x)])
                likeness = np.exp(-gap / images.STRENGTH**2)
                total, weight = total + likeness * at(y + dy, x + dx), weight + likeness
        assert images.denoised(page)[y, x] == round(total / weight)


def test_a_variant_is_prepared_once(spark, monkeypatch):
    """Each form of a cell is enlarged once, however many settings it is read under."""
    made = []
    monkeypatch.setattr(engines, "prepared", lambda image: made.append(image) or image)
    page = rasters.raster(7, 3)
    asked = engines.forms(page, "remarks", ["tesseract", "paddle"], False)
    assert len(made) == 3 and [(i, s) for i, _, _, s in asked] == [("tesseract", s) for _ in range(3) for s in engines.settings("remarks")]


def test_a_table_in_parts_is_one_document(spark, tmp_path):
    folder = tmp_path / "a folder"
    spark.range(100).repartition(3).write.parquet(str(folder / "in parts.parquet"))
    spark.range(9).selectExpr("id", "id % 2 AS half").write.partitionBy("half").parquet(str(folder / "by_half.parquet"))
    (folder / "one%20.parquet").write_bytes(b"abc")
    for name in (".hidden.parquet", "other.csv"):
        (folder / name).write_bytes(b"x")
    (folder / "other").mkdir()
    (folder / "other" / "deep.parquet").write_bytes(b"x")
    found = {r["stem"]: r for r in files.documents(spark, str(folder), "*.parquet").collect()}
    assert list(found) == ["by_half", "in parts", "one%20"]
    assert found["one%20"]["content"] == b"abc" and found["in parts"]["content"] is None
    assert found["in parts"]["length"] == sum(p.stat().st_size for p in (folder / "in parts.parquet").glob("*.parquet"))


def test_dropped_files_become_records(spark, tmp_path):
    tokens, pages = spread_tokens(spark)
    tokens.withColumn("page_id", F.col("side")).coalesce(1).write.json(str(tmp_path / "in"))
    job = lambda df: records.output(spread.extract(df.drop("page_id"), pages))
    folder.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), job).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 46


def png_pixels(data):
    """Height, width and pixels (red, green, blue or gray) of a PNG file of unfiltered lines."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, chunks = 8, {}
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        chunks[kind] = data[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + chunks[kind]) == int.from_bytes(data[at + 8 + n : at + 12 + n], "big")
        at += 12 + n
    width, height = (int.from_bytes(chunks[b"IHDR"][i : i + 4], "big") for i in (0, 4))
    lines = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(height, -1)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape((height, width, 3) if chunks[b"IHDR"][9] == 2 else (height, width))


def test_png_holds_the_pixels(spark):
    page = rasters.raster(9, 4)
    assert (png_pixels(artefacts.png(page)) == page).all()
    colour = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (png_pixels(artefacts.png(colour)) == colour[:, :, ::-1]).all()
    with pytest.raises(ValueError):
        artefacts.png(np.zeros((0, 3), np.uint8))
    got = artefacts.as_png(rasters.drawn(spark.createDataFrame([(9, 4)], "number int, size int"))).first()
    assert (png_pixels(bytes(got["png"])) == page).all() and base64.b64decode(got["base64"]) == bytes(got["png"])
    assert images.crop(page, 4, 10, 3, 2).tolist() == page[10:12, 4:7].tolist()


def test_overlays_are_written(spark, tmp_path):
    pages = rasters.drawn(spark.createDataFrame([(1, 1), (2, 2)], "number int, size int"))
    key = ["origin"]
    tables = spark.createDataFrame([("part-1", 5, 6, 20, 10)], "origin string, x int, y int, width int, height int")
    sizes = spark.createDataFrame([("part-1", 64, 48)], "origin string, width int, height int")
    rows = artefacts.on_page(spark.createDataFrame([("part-1", 3, 0, 100)], "origin string, row_no int, top int, bottom int"), tables, key)
    columns = artefacts.on_page(spark.createDataFrame([("part-1", "unit", 2, 9)], "origin string, field string, left int, right int"), tables, key)
    lines = artefacts.grid_lines(rows, columns, sizes, key)
    assert {tuple(r)[1:] for r in lines.collect()} == {("row", "3", 0, 6, 64, 6), ("row", "3", 0, 106, 64, 106), ("column", "unit", 7, 0, 7, 48), ("column", "unit", 14, 0, 14, 48)}
    drawn = artefacts.overlays(pages, lines.unionAll(artefacts.table_lines(tables, key)))
    artefacts.write_pngs(drawn.withColumn("name", F.concat(F.lit("debug/"), "origin", F.lit(".png"))), f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out/debug").iterdir()) == ["part-1.png", "part-2.png"]
    one, two = (png_pixels((tmp_path / f"out/debug/part-{i}.png").read_bytes()) for i in (1, 2))
    assert one.shape == (48, 64, 3) and one[6, 40].tolist() == [0, 255, 0] and one[40, 7].tolist() == [0, 0, 255] and one[12, 25].tolist() == [255, 0, 0]
    assert (two == rasters.raster(2, 2)[:, :, None]).all()


def test_template_table_comes_first(spark):
    box = "struct<x:int,y:int,width:int,height:int>"
    got = spark.createDataFrame([((1, 1, 5, 5), (2, 2, 6, 6)), ((1, 1, 0, 5), (2, 2, 6, 6)), (None, (3, 3, 7, 7))], f"t {box}, r {box}").select(chosen_table(F.col("t"), F.col("r")).alias("b"))
    assert [r["b"]["x"] for r in got.collect()] == [1, 2, 3]


def pages_of_engines(spark):
    return rasters.drawn(spark.createDataFrame([(1, 1), (2, 2)], "number int, size int")).select("image.*")


def test_pages_take_an_engine_s_tokens(spark):
    def first():
        return lambda image: iter([("a", 0.9, 1, 2, 3, 4)] * (2 if set(np.unique(image)) <= {0, 255} else 0))

    def second():
        return lambda image: [("b", 0.8, *engines.box_of([(1, 5), (4, 2)]))] * int(2 + (image[14:18, 12:17] < 100).any())

    def broken():
        raise OSError("not installed")

    key = ["origin"]
    got = engines.page_tokens(pages_of_engines(spark), {"tesseract": first, "paddle": second}, key).cache()
    assert got.where("engine = 'tesseract'").count() == 4
    b = got.where("engine = 'paddle'").first()
    assert (b["x"], b["y"], b["width"], b["height"]) == (1, 2, 3, 3)
    assert {r["engine"] for r in engines.chosen_tokens(got, key).collect()} == {"paddle"}
    alone = engines.page_tokens(pages_of_engines(spark), {"tesseract": first, "paddle": broken}, key)
    for backend in ("auto", "paddle", "tesseract"):
        assert [r["engine"] for r in engines.chosen_tokens(alone, key, backend).collect()] == ["tesseract"] * 4
    got.unpersist()


def test_cells_are_read_by_kind(spark):
    def first():
        return lambda image, setting: ("12" if "whitelist" in setting else "Cofee", 0.5)

    def second():
        return lambda image, setting: ("12", 0.7)

    def once():
        asked = []

        def read(image, setting):
            asked.append(setting)
            if len(asked) > 1:
                raise AssertionError("asked again after it failed")
            raise OSError("no server")

        return read

    keys = ["origin", "field"]
    crops = pages_of_engines(spark).coalesce(1).withColumn("field", F.explode(F.array(*map(F.lit, ("total_value", "article", "remarks")))))
    crops = crops.unionAll(crops.limit(1).withColumns({"origin": F.lit("blank"), "height": F.lit(0), "width": F.lit(0), "data": F.lit(b"")}))
    got = engines.cell_readings(crops, {"tesseract": first, "paddle": second, "glm": once}, keys).cache()
    by_field = {r["field"]: r["engines"] for r in got.where("origin = 'part-1'").groupBy("field").agg(F.collect_list("engine").alias("engines")).collect()}
    assert sorted(by_field["total_value"]) == ["paddle", "tesseract"] and all(e.startswith("tesseract:") for e in by_field["remarks"])
    assert len(by_field["remarks"]) == len(images.cell_variants(rasters.raster(1, 1), "remarks")) * len(engines.settings("remarks"))
    chosen = {(r["origin"], r["field"]): r for r in engines.chosen_readings(got, crops, keys, ["Coffee"]).collect()}
    assert len(chosen) == 7 and chosen["part-1", "total_value"]["cell_text"] == "12" and chosen["part-1", "total_value"]["cell_confidence"] == 1.0
    assert chosen["part-2", "article"]["cell_text"] == "Coffee" and chosen["part-1", "remarks"]["cell_text"] == "Cofee"
    blank = next(r for k, r in chosen.items() if k[0] == "blank")
    assert (blank["cell_text"], blank["cell_confidence"], blank["cell_engine"]) == ("", None, "none")
    got.unpersist()


def test_vision_request_and_breaker():
    body = json.loads(engines.vision_request(b"png", "total_value", "m"))
    assert base64.b64decode(body["images"][0]) == b"png" and body["options"]["num_predict"] == 128 and not body["stream"]
    made = []
    task = engines.Engines({"bad": lambda: made.append(1) or (lambda: 1 / 0), "good": lambda: lambda: "x"})
    assert [task.ask("bad"), task.ask("bad"), task.ask("good")] == [None, None, "x"] and made == [1]


def test_vision_client_posts_and_breaks():
    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = json.dumps({"response": f" {body['model']} \n"}).encode()
            self.send_response(200 if body["model"] == "m" else 500)
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        task = engines.Engines({"glm": lambda: engines.vision_client(f"http://127.0.0.1:{server.server_port}/")})
        assert task.ask("glm", engines.vision_request(b"png", "article", "m")) == "m"
        assert task.ask("glm", engines.vision_request(b"png", "article", "other")) is None and task.failed == {"glm"}
    finally:
        server.shutdown()
        server.server_close()
