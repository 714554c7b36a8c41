"""Likeness of names, for matching them against a dictionary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import CATEGORIES, clean_article


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    free = full  # a bit for each place of b that no match has reached
    for c in a:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(b) - free.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times the share of characters that insertions and deletions keep."""
    return 100.0 if not a and not b else 200.0 * common(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ``ratio`` of the shorter text with a stretch of the longer one of its length, or shorter at the ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    stretches = {b[max(0, i) : i + n] for i in range(1 - n, len(b))}
    return max(ratio(a, s) for s in stretches if s)


def _by_tokens(a: str, b: str, measure) -> float:
    """``measure`` of the sorted tokens, or of the common ones with either text's others."""
    x, y = a.split(), b.split()
    best = measure(" ".join(sorted(x)), " ".join(sorted(y)))
    both = " ".join(sorted({*x} & {*y}))
    if both and measure is partial_ratio:
        return 100.0
    one = " ".join(filter(None, [both, " ".join(sorted({*x} - {*y}))]))
    two = " ".join(filter(None, [both, " ".join(sorted({*y} - {*x}))]))
    found = [best, measure(one, two)]
    if both:
        found += [measure(both, one), measure(both, two)]
    return max(found)


def weighted_ratio(a: str, b: str) -> float:
    """The best of several ratios, each weighted by how far it looks away from order and length. [UDF13]

    Close to the scorer that the thresholds come from; scores near a threshold
    may fall on its other side.
    """
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if longer < 1.5:
        return max(best, 0.95 * _by_tokens(a, b, ratio))
    scale = 0.9 if longer <= 8.0 else 0.6
    return max(best, scale * partial_ratio(a, b), 0.95 * scale * _by_tokens(a, b, partial_ratio))


def best_match(text: str, names: list[str]) -> tuple[str, float]:
    """The name that scores best, the first of equals. [TOP9]"""
    best, top = "", -1.0
    for name in names:
        value = weighted_ratio(text, name)
        if value > top:
            best, top = name, value
    return best, top


def match_names(texts: Column, names: list[str]) -> Column:
    """Struct of name and score of the best match, by a vectorised kernel; use it on distinct texts."""

    @F.pandas_udf("name string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([best_match(t or "", names) for t in batch], columns=["name", "score"])

    # so that no filter on the score is moved below it and scores twice
    return run.asNondeterministic()(texts)


def snap_articles(records: DataFrame, names: Iterable[str], *, column: str = "article", noisy: float = 72.0, clean: float = 85.0) -> DataFrame:
    """Replace articles by the dictionary name they come near enough to. [TXT9, JN8]

    Only distinct articles are scored. Texts with digits or unusual signs need
    the lower score. Without names, and for categories and blanks, the cleaned
    article stands.
    """
    cleaned = clean_article(F.col(column))
    names = list(names)
    if not names:
        return records.withColumn(column, cleaned)
    asked = records.select(cleaned.alias("_text")).where((F.col("_text") != "") & ~F.col("_text").isin(CATEGORIES)).distinct()
    least = F.when(F.col("_text").rlike(r"\d") | F.col("_text").rlike(r"[^A-Za-z0-9 .,&'-]"), noisy).otherwise(clean)
    found = asked.select("_text", match_names(F.col("_text"), names).alias("_match")).where(F.col("_match.score") >= least)
    joined = records.withColumn("_text", cleaned).join(found, "_text", "left")
    return joined.withColumn(column, F.coalesce("_match.name", "_text")).select(*records.columns)
