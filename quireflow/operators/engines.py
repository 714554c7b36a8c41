"""Calls to recognisers. Each is passed in as a factory that a task calls once, when it first needs it.

A page reader takes an image and yields (text, confidence, x, y, width, height);
a cell reader takes an image and a setting and returns (text, confidence). None
is part of this library. An engine that can't be made, or fails, isn't asked
again by its task; what the others read stands.
"""

from __future__ import annotations

import json
import logging
import shutil
import urllib.request
from base64 import b64encode
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LEFT_FIELDS, LONG_TEXT_FIELDS, RATE_FIELDS, RIGHT_FIELDS, is_number
from . import choose
from .images import cell_variants, decoded, gray, otsu, prepared

PageReader = Callable[[np.ndarray], Iterable[tuple[str, float, float, float, float, float]]]
CellReader = Callable[[np.ndarray, str], tuple[str, float | None]]

# Settings of the first engine by kind of field, and of a vision model's answer.
PAGE_MODE, LINE_MODE, DIGITS = "--psm 6", "--psm 7", "-c tessedit_char_whitelist=0123456789.,-"
VISION_OPTIONS, VISION_SECONDS = {"temperature": 0.0, "top_p": 1.0, "num_predict": 128}, 60
NUMBERS = [f for f in LEFT_FIELDS + RIGHT_FIELDS if is_number(f)]


def located(name: str, places: Iterable[str] = ()) -> str:
    """Where an engine's program lies: on the search path, or else at the first of ``places`` that exists. [UDF1]"""
    for place in filter(None, [shutil.which(name), *places]):
        if Path(place).is_file():
            return str(place)
    raise FileNotFoundError(f"{name} is neither on the search path nor at {', '.join(places) or 'any other place'}")


def settings(field: str) -> list[str]:
    """The settings under which a cell's variants are read. [UDF4]"""
    if is_number(field):
        return [f"{LINE_MODE} {DIGITS}"]
    return [LINE_MODE, PAGE_MODE] if field in RATE_FIELDS or field in LONG_TEXT_FIELDS else [LINE_MODE]


def box_of(points: Iterable[tuple[float, float]]) -> tuple[float, float, float, float]:
    """x, y, width, height of a polygon, as some engines mark tokens. [UDF6]"""
    x, y = zip(*points, strict=True)
    return min(x), min(y), max(x) - min(x), max(y) - min(y)


class Engines:
    """The engines of one task, made when first asked and put aside when they fail. [UDF5, UDF9]"""

    def __init__(self, factories: dict[str, Callable[[], Callable]]) -> None:
        self.factories, self.made, self.failed = factories, {}, set()

    def ask(self, name: str, *args: object) -> object | None:
        """What the engine answers; None once it has failed."""
        if name in self.failed:
            return None
        try:
            if name not in self.made:
                self.made[name] = self.factories[name]()
            answer = self.made[name](*args)
            return list(answer) if isinstance(answer, Iterator) else answer
        except Exception as error:  # another engine's reading takes its place
            logging.warning("engine %s failed, it isn't asked again: %s", name, error)
            self.failed.add(name)
            return None


def page_tokens(pages: DataFrame, factories: dict[str, Callable[[], PageReader]], keys: list[str]) -> DataFrame:
    """The tokens that each engine finds on each page: engine, pos and the token columns. [UDF2, UDF6]

    ``pages`` has height, width, nChannels and data. The first engine gets the
    page in black and white, others as it is.
    """
    token = "engine string, pos int, text string, confidence double, x int, y int, width int, height int"
    names = [*keys, *(part.split()[0] for part in token.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engines = Engines(factories)
        for batch in batches:
            for row in batch.to_dict("records"):
                image, found = decoded(row["height"], row["width"], row["nChannels"], row["data"]), []
                for i, name in enumerate(factories):
                    for pos, (text, confidence, *box) in enumerate(engines.ask(name, otsu(gray(image)) if i == 0 else image) or ()):
                        found.append((*(row[k] for k in keys), name, pos, text, confidence, *map(int, box)))
                yield pd.DataFrame(found, columns=names)

    of = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, "height", "width", "nChannels", "data").mapInPandas(run, f"{of}, {token}")


def chosen_tokens(tokens: DataFrame, keys: list[str], backend: str = "auto") -> DataFrame:
    """The tokens of the engine that each page takes; the first engine's where the one asked for found nothing. [UDF7]

    ``tokens`` is read twice: write it first, so that engines are asked once.
    """
    n = lambda name: F.count_if(F.col("engine") == name).alias(f"n_{name}")
    counts = tokens.groupBy(*keys).agg(n("tesseract"), n("paddle"))
    asked = choose.page_engine(counts, backend)
    taken = asked.select(*keys, F.when(F.when(F.col("engine") == "paddle", F.col("n_paddle")).otherwise(1) > 0, F.col("engine")).otherwise("tesseract").alias("engine"))
    return tokens.join(taken, [*keys, "engine"])


def forms(image: np.ndarray, field: str, names: list[str], all_engines: bool) -> list[tuple[str, str, np.ndarray, str]]:
    """engine, label, form and setting of each reading that a cell's field asks for."""
    first, *others = names
    if field == "article" or is_number(field):
        return [(name, name, prepared(image) if name == first else image, settings(field)[0]) for name in names]
    variants = [(f"{first}:{variant}", prepared(v)) for variant, v in cell_variants(gray(image), field)]
    asked = [(first, label, form, s) for label, form in variants for s in settings(field)]
    return asked + [(name, name, image, "") for name in others if all_engines]


def cell_readings(crops: DataFrame, factories: dict[str, Callable[[], CellReader]], keys: list[str], all_engines: bool = False) -> DataFrame:
    """Candidates for each cell: ord, engine, text, confidence. [UDF3, UDF4, UDF8]

    ``crops`` has field among its keys, and height, width, nChannels and data.
    Articles and numbers are read once by every engine. Of other fields the
    first engine reads each variant under each setting; the others read the
    crop only with ``all_engines``. Engines are named before a colon, variants
    after it.
    """
    token = "ord int, engine string, text string, confidence double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engines = Engines(factories)
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                field, image = row["field"], decoded(row["height"], row["width"], row["nChannels"], row["data"])
                if not image.size:
                    continue
                for i, (name, label, form, setting) in enumerate(forms(image, field, list(factories), all_engines)):
                    answer = engines.ask(name, form, setting)
                    if answer is not None:
                        found.append((*(row[k] for k in keys), i, label, *answer))
            yield pd.DataFrame(found, columns=[*keys, "ord", "engine", "text", "confidence"])

    of = ", ".join(f"{k} {crops.schema[k].dataType.simpleString()}" for k in keys)
    return crops.select(*keys, "height", "width", "nChannels", "data").mapInPandas(run, f"{of}, {token}")


def chosen_readings(candidates: DataFrame, cells: DataFrame, keys: list[str], names: Iterable[str] = ()) -> DataFrame:
    """Each cell's cell_text, cell_confidence and cell_engine: numbers by vote, articles by name, others by score. [UDF8, SCR4]

    Cells of ``cells`` that nothing was read in have "", null and none.
    ``candidates`` is read three times: write it first, so that engines are
    asked once.
    """
    field, typed = F.col("field"), ["article", *NUMBERS]
    outputs = candidates.withColumn("value", F.col("text"))
    won = [choose.voted_numbers(outputs.where(field.isin(NUMBERS)), keys), choose.picked_text(outputs.where(field == "article"), keys, list(names))]
    best = choose.best_candidate(candidates.where(~field.isin(typed)), keys).withColumnRenamed("text", "value")
    parts = [df.select(*keys, F.col("value").alias("cell_text"), F.col("confidence").cast("double").alias("cell_confidence"), F.col("engine").alias("cell_engine")) for df in (*won, best)]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return cells.select(*keys).join(found, keys, "left").na.fill({"cell_text": "", "cell_engine": "none"})


def vision_request(png: bytes, field: str, model: str) -> str:
    """The request that asks a vision model for a cell, as JSON. [UDF9, IMG16]"""
    what = "the number printed in it, digit by digit" if is_number(field) else "the name of the goods printed in it"
    prompt = f"The picture is one cell of an old printed trade table. Answer with {what} and nothing else; with nothing, if it is blank."
    return json.dumps({"model": model, "prompt": prompt, "images": [b64encode(png).decode()], "stream": False, "options": VISION_OPTIONS})


def vision_client(url: str) -> Callable[[str], str]:
    """Posts a request to a model's server and returns the response text. [UDF9, UDF10]"""

    def post(body: str) -> str:
        request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=VISION_SECONDS) as answer:
            return str(json.load(answer).get("response", "")).strip()

    return post
