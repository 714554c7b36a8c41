"""Command lines: records of spreads, rows of import pages, comparison with a golden table.

    python -m quireflow.cli evaluate truth.csv predicted.csv
    python -m quireflow.cli spreads scans/ out/ --engines mine:engines [--layout NAME]
    python -m quireflow.cli imports scans/ out/ --engines mine:engines

``--engines`` names a function that returns a dictionary: pages (renders a
file's bytes, see ``files.rendered_pages``), page_readers, and where wanted
cell_readers, strip_readers and client (see ``operators.engines``).
"""

from __future__ import annotations

import argparse
import importlib
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compare, records
from .plans import jobs
from .sources import files
from .sources.articles import KNOWN_ARTICLES


def start_log(folder: str | None = None) -> None:
    """Log lines go to the console and, with a folder, to run.log in it. [SNK11]"""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(folder, "run.log"), encoding="utf-8"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=handlers, force=True)


def _engines(named: str) -> dict:
    module, _, function = named.partition(":")
    return getattr(importlib.import_module(module), function or "engines")()


def _pages(spark: SparkSession, folder: str, engines: dict) -> DataFrame:
    pages = files.rendered_pages(files.documents(spark, folder), engines["pages"])
    for row in pages.where("error is not null").select("path", "page_number", "error").take(20):
        logging.warning("%s, page %s: %s", *row)
    return pages.where("error is null").withColumn("source_file", F.regexp_extract("path", r"([^/]+)$", 1))


def evaluate(spark: SparkSession, truth: str, predicted: str) -> list[str]:
    """Lines that tell how far two tables agree, field by field. [AGG15, DIF1, PRD18]"""
    for path in (truth, predicted):
        if not Path(path).exists():
            raise SystemExit(f"{path} does not exist")
    one, two = (files.read_text_table(spark, path) for path in (truth, predicted))
    lines = [f"{r['field']}: {r['matches']} of {r['joined']}" for r in compare.field_matches(one, two).collect()]  # a row each field
    differ = compare.differences(one, two)
    return [*lines, *(f"row {r['row_no']}, {r['field']}: {r['expected']!r}, read {r['actual']!r}" for r in differ.orderBy(F.col("row_no").try_cast("int"), "field").limit(200).collect())]


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quireflow", description=__doc__.split("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("evaluate", help="compare a table with a golden one")
    one.add_argument("truth")
    one.add_argument("predicted")
    for name, what in (("spreads", "records of two-page spreads"), ("imports", "rows of single pages")):
        other = commands.add_parser(name, help=what)
        other.add_argument("folder")
        other.add_argument("out")
        other.add_argument("--engines", required=True)
        other.add_argument("--start-page", type=int, default=1)
        other.add_argument("--layout", default="madras_exports_auto")
    asked = parser.parse_args(arguments)
    if getattr(asked, "start_page", 1) < 1:
        parser.error("--start-page counts from 1")  # [PRD18]
    spark = SparkSession.builder.appName("quireflow").getOrCreate()
    if asked.command == "evaluate":
        start_log()
        print("\n".join(evaluate(spark, asked.truth, asked.predicted)))
        return 0
    if "://" not in asked.folder and not Path(asked.folder).is_dir():
        parser.error(f"{asked.folder} is no folder")
    start_log(asked.out)
    engines = _engines(asked.engines)
    pages = _pages(spark, asked.folder, engines).where(F.col("page_number") >= asked.start_page)
    if asked.command == "spreads":
        found = jobs.spread_records(pages, f"{asked.out}/work", engines["page_readers"], engines.get("cell_readers", {}), KNOWN_ARTICLES, engines.get("client"), layout=asked.layout)
        found = jobs.kept(found, f"{asked.out}/work", "records")
        files.write_csv(found, f"{asked.out}/records")
        for metric, value in records.summary(found).collect():  # three rows
            logging.info("%s: %s", metric, value)
    else:
        rows, headers = jobs.import_rows(pages, f"{asked.out}/work", engines["page_readers"], engines["strip_readers"])
        files.write_by_file(rows, f"{asked.out}/rows")
        files.write_json(headers, f"{asked.out}/headers")
        logging.info("rows: %s", rows.count())
    return 0


if __name__ == "__main__":
    sys.exit(main())
