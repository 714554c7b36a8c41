"""Choice among readings of a cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import vote_number
from ..functions.scoring import is_primary, may_retry, needs_retry, prefers_token, score, score_of_clean
from ..functions.similarity import match_names
from ..functions.text import clean_spaces, is_clean_placeholder

#: Engines in the order in which they are preferred.
ENGINES = ["tesseract", "paddle", "glm"]


def preference():
    """An engine's place among those preferred; others come after them."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ENGINES)), F.col("engine")), F.lit(0)), F.lit(len(ENGINES) + 1))


def voted_numbers(outputs: DataFrame, keys: list[str]) -> DataFrame:
    """The reading that most engines agree on, the preferred engine's of equals. [AGG13]

    ``outputs`` has engine and value. Returns value, engine and confidence (the
    share of non-blank readings that agree); "", none and 0.0 without readings.
    """
    votes = outputs.withColumns({"vote": vote_number(F.col("value")), "place": preference()})
    counted = votes.where("vote <> ''").groupBy(*keys, "vote").agg(F.count("*").alias("n"), F.min(F.struct("place", "engine")).alias("by"))
    best = F.max_by(F.struct("vote", "n", "by"), F.struct("n", -F.col("by.place")))
    won = counted.groupBy(*keys).agg(best.alias("best"), F.sum("n").alias("total"))
    won = won.select(*keys, F.col("best.vote").alias("value"), "best.by.engine", (F.col("best.n") / F.col("total")).alias("confidence"))
    blank = {"value": "", "engine": "none", "confidence": 0.0}
    return outputs.select(*keys).distinct().join(won, keys, "left").na.fill(blank)


def picked_text(outputs: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The reading nearest to a dictionary name, snapped to it above 85; the preferred engine's of equals. [TOP6]

    Without names readings go by their score. Blank readings and scores of 0
    don't count.
    """
    read = outputs.withColumns({"value": clean_spaces(F.col("value")), "place": preference()}).where("value <> ''")
    if names:
        known = read.select("value").distinct().withColumn("match", match_names(F.col("value"), names))
        read = read.join(known, "value").withColumns({"points": F.col("match.score") / 100.0, "text": F.when(F.col("match.score") > 85, F.col("match.name")).otherwise(F.col("value"))})
    else:
        read = read.withColumns({"points": F.greatest(score("article", F.col("value")) / 5.0, F.lit(0.0)), "text": F.col("value")})
    best = F.max_by(F.struct("text", "engine", "points"), F.struct("points", -F.col("place")))
    won = read.where("points > 0").groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.text").alias("value"), "best.engine", F.col("best.points").alias("confidence"))
    return outputs.select(*keys).distinct().join(won, keys, "left").na.fill({"value": "", "engine": "none", "confidence": 0.0})


def best_candidate(candidates: DataFrame, keys: list[str], field: str = "field") -> DataFrame:
    """The candidate (ord, text, confidence, engine) of highest score, the first of equals; blank ones don't count. [TOP5, PRD14]"""
    cleaned = candidates.withColumn("_text", clean_spaces(F.col("text")))
    points = cleaned.withColumn("points", score_of_clean(F.col(field), F.col("_text"), F.col("confidence")))
    best = F.max_by(F.struct("text", "confidence", "engine", "ord"), F.when(~is_clean_placeholder(F.col("_text")), F.struct("points", -F.col("ord"))))
    found = points.groupBy(*keys).agg(best.alias("best"))
    return found.where("best is not null").select(*keys, "best.*")


def doubtful_first(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The cells whose first box looks blank, or reads so that the others are tried as well. [PRD10]"""
    f, t = F.col("field"), F.coalesce("text", F.lit(""))
    read = readings.where("ord = 0").withColumn("_text", clean_spaces(t)).withColumn("_points", score_of_clean(f, F.col("_text"), F.col("confidence")))
    return read.where(F.col("likely_blank") | needs_retry(f, t, F.col("_points"))).select(*keys)


def best_variant(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The reading of a cell's best box. [TOP4]

    ``readings`` has field, ord, variant, text, confidence, engine and
    likely_blank. The first box ends the search if it reads well; otherwise the
    highest score wins, the first of equals. Boxes that look blank aren't read;
    if all do, the blank classifier is the engine.
    """
    f, t, c = F.col("field"), F.col("text"), F.col("confidence")
    read = readings.withColumn("_text", clean_spaces(t)).withColumn("points", score_of_clean(f, F.col("_text"), c)).withColumn("ends", (F.col("ord") == 0) & ~needs_retry(f, t, F.col("points")))
    item = F.struct("text", "confidence", F.concat("engine", F.lit("@"), "variant").alias("engine"))
    best = F.max_by(item, F.when(~F.col("likely_blank"), F.struct("ends", "points", -F.col("ord"))))
    found = read.groupBy(*keys).agg(best.alias("best"), F.bool_and("likely_blank").alias("blank"))
    engine = F.when(F.col("blank"), "blank_classifier").otherwise(F.col("best.engine"))
    return found.select(*keys, F.coalesce("best.text", F.lit("")).alias("text"), F.col("best.confidence").alias("confidence"), engine.alias("engine"))


def resolved(cells: DataFrame) -> DataFrame:
    """The text that a field ends with. [SCR5, SCR6]

    ``cells`` has field, token_text, token_confidence, cell_text,
    cell_confidence and cell_engine (null where a cell wasn't read). Primary
    fields are read again where the tokens are blank or doubtful, and the
    reading stands unless the tokens are preferred. Other fields are read again
    if they may be, and the reading stands if it scores as well.
    """
    f, t, tc = F.col("field"), F.coalesce("token_text", F.lit("")), F.col("token_confidence")
    c, cc = F.coalesce("cell_text", F.lit("")), F.col("cell_confidence")
    cells = cells.withColumns({"_token": clean_spaces(t), "_cell": clean_spaces(c)})
    cells = cells.withColumns({"_token_score": score_of_clean(f, F.col("_token"), tc), "_cell_score": F.when(c != "", score_of_clean(f, F.col("_cell"), cc)).otherwise(-10.0)})
    ts, cs = F.col("_token_score"), F.col("_cell_score")
    doubtful = needs_retry(f, t, ts)
    primary = is_primary(f) & doubtful & (c != "") & ~prefers_token(f, c, cs, t, tc, ts)
    other = ~is_primary(f) & may_retry(f) & doubtful & (c != "") & (cs >= ts)
    again = primary | other
    blank = is_primary(f) & (t == "")
    engine = F.when(again, F.coalesce("cell_engine", F.lit("table_tokens"))).when(blank, F.col("cell_engine")).otherwise("table_tokens")
    return cells.withColumns({"text": F.when(again, c).otherwise(t), "confidence": F.when(again, cc).otherwise(tc), "engine": engine}).drop("_token", "_cell", "_token_score", "_cell_score")


def cells_to_read(cells: DataFrame) -> DataFrame:
    """The cells whose tokens leave them to be read again; only these go to an engine. [PRD9, PRD10]"""
    f, t = F.col("field"), F.coalesce("token_text", F.lit(""))
    cells = cells.withColumn("_token", clean_spaces(t)).withColumn("_points", score_of_clean(f, F.col("_token"), F.col("token_confidence")))
    return cells.where((is_primary(f) | may_retry(f)) & needs_retry(f, t, F.col("_points"))).drop("_token", "_points")


def page_engine(counts: DataFrame, backend: str = "auto"):
    """Which engine's tokens a page takes: the one asked for, else the second if it finds as many. [UDF7]"""
    if backend != "auto":
        return counts.withColumn("engine", F.lit(backend))
    second = F.col("n_paddle") >= F.col("n_tesseract")
    return counts.withColumn("engine", F.when(second, "paddle").otherwise("tesseract"))
