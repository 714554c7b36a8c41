"""A quality classifier: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WORD, written

#: Random features, ridge penalty, width of the kernel in standard deviations of all statistics together.
FEATURES, PENALTY, WIDTH = 384, 1e-3, 0.5
#: Labelled rows the model is fitted on, at most; folds whose scores calibrate it; bins of a calibration curve.
FIT_ROWS, FOLDS, BINS = 200_000, 4, 512
#: Documents scored at least this are kept.
THRESHOLD = 0.3

_WORDS = re.compile(WORD)
_CLASSES = ("letter", "upper", "digit", "blank", "stop", "comma", "shout", "bar", "mark", "other", "high")


def _byte_classes() -> np.ndarray:
    """The class of each byte of UTF-8."""
    table = np.full(256, _CLASSES.index("other"))
    for name, chars in (("letter", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("blank", " \t\n\x0b\x0c\r"), ("stop", ".;:"), ("comma", ",'\"-()"), ("shout", "!?"), ("bar", "|/\\_<>[]{}="), ("mark", "#$%&*@^~+")):
        table[list(chars.encode())] = _CLASSES.index(name)
    table[128:] = _CLASSES.index("high")
    return table


_CLASS_OF = _byte_classes()
STATISTICS = (*_CLASSES, "bytes", "words", "word_length", "word_spread", "longest", "distinct", "commonest", "capital_words", "upper_words", "marked_words", "bare_words", "short_words", "line_words", "distinct_lines", "words_a_stop")


def statistics(text: str) -> list[float]:
    """Numbers that describe a text's form; all are finite, for an empty text too."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(_CLASS_OF[data], minlength=len(_CLASSES)) if len(data) else np.zeros(len(_CLASSES))
    words = _WORDS.findall(text)
    n, lines = max(1, len(words)), [line for line in text.split("\n") if line]
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    seen = Counter(words)
    shares = counts / max(1, len(data))
    signs = frozenset("#$%&*@!|+=~^")
    return [
        *np.sqrt(shares).tolist(),
        math.log1p(len(data)),
        math.log1p(len(words)),
        float(lengths.mean()),
        float(lengths.std()),
        math.log1p(float(lengths.max())),
        len(seen) / n,
        (max(seen.values()) if seen else 0) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isupper, words)) / n,
        sum(w[-1] in signs for w in words) / n,
        sum(not any(map(str.isalnum, w)) for w in seen) / max(1, len(seen)),
        float((lengths <= 3).mean()),
        math.log1p(len(words) / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)),
        math.log1p(len(words) / (1.0 + float(counts[_CLASSES.index("stop")]))),
    ]


@dataclass
class Model:
    """A fitted classifier; small and of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """A constant and cosines whose products approximate a Gaussian kernel between rows of statistics."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        cosines = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(x), 1)), cosines])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores from 0 to 1."""
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nondecreasing sequence nearest to ``values`` in weighted squares, by pooling neighbours that violate the order."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _with_statistics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(text.as_py() or "") for text in batch.column("text")]
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(x, pa.list_(pa.float64()))], [*kept, "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(-1, len(STATISTICS))


def _sums(model: Model):
    """Each partition's Z'Z and Z'y, fold by fold, in one row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(model.phases) + 1
        sums = np.zeros((FOLDS, n + 1, n))
        for batch in batches:
            if batch.num_rows:
                z, y = model.features(_matrix(batch.column("x"))), batch.column("y").to_numpy(zero_copy_only=False)
                fold = batch.column("fold").to_numpy(zero_copy_only=False)
                for f in range(FOLDS):
                    mine = z[fold == f]
                    sums[f, :n] += mine.T @ mine
                    sums[f, n] += mine.T @ y[fold == f]
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    return run


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column("sums").to_pylist():
            part = np.frombuffer(value).copy()
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def _raw(model: Model, weights: np.ndarray):
    """Scores of rows by the weights that their fold had no part in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.features(_matrix(batch.column("x"))) @ weights.T
                fold = batch.column("fold").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(raw[np.arange(len(raw)), fold]), batch.column("y")], ["raw", "y"])

    return run


def _solved(sums: np.ndarray) -> np.ndarray:
    """Ridge weights from Z'Z over Z'y; the constant isn't penalised."""
    a, b = sums[:-1], sums[-1]
    return np.linalg.solve(a + PENALTY * max(1.0, a[0, 0]) / FEATURES * np.diag([1e-9, *[1.0] * FEATURES]), b)


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from: crc32 of the id as text leaves no rest by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", fit_rows: int = FIT_ROWS, seed: int = 5) -> Model:
    """Fit a model to the labels of documents that are not held out.

    At most about ``fit_rows`` labelled ids take part, drawn by a hash; this
    bounds the table of statistics that is fitted on, and is all that is
    sampled. Partitions sum their normal equations by folds, the sums are added
    in tasks of 16, and one row of matrices reaches the driver. The regression
    is solved over all folds, and without each; every row's score by the
    solution without its fold calibrates, in bins whose sums reach the driver.

    Several labels of an id are averaged; null labels and ids don't count.
    Without labels, or with equal ones, the score is constant (0.5, or that
    label's value).
    """
    spark = docs.sparkSession
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    marks = marks.where(~held_out(F.col("doc_id")))
    marks = written(marks, "labels")
    share = min(1.0, fit_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")  # fit_rows rows
    rows = written(rows.mapInArrow(_with_statistics, f"doc_id {id_type}, y double, x array<double>"), "statistics")

    size, rng = len(STATISTICS), np.random.default_rng(seed)
    moments = [f(F.get("x", F.lit(i))) for i in range(size) for f in (F.avg, F.stddev_pop)]
    found = rows.agg(F.count("*"), F.min("y"), F.max("y"), F.avg("y"), *moments).first()
    mean = np.array([found[4 + 2 * i] or 0.0 for i in range(size)])
    scale = np.array([found[5 + 2 * i] or 0.0 for i in range(size)])
    model = Model(
        mean,
        np.where(scale > 1e-9, scale, 1.0),
        rng.standard_normal((size, FEATURES)) / (WIDTH * math.sqrt(size) * 2),
        rng.uniform(0, 2 * math.pi, FEATURES),
        np.zeros(FEATURES + 1),
        np.array([0.0, 1.0]),
        np.full(2, 0.5 if found[3] is None else found[3]),
    )
    if not found[0] or found[1] == found[2]:
        return model

    rows = rows.select("y", "x", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1)), F.lit(FOLDS)).cast("int").alias("fold"))
    sums = written(rows.mapInArrow(_sums(model), "sums binary"), "normal-sums")
    while (parts := sums.rdd.getNumPartitions()) > 1:
        sums = written(sums.coalesce(-(-parts // 16)).mapInArrow(_added, "sums binary"), "normal-sums")
        if parts <= 16:
            break
    total = sum(np.frombuffer(r["sums"]) for r in sums.collect())  # a row for each task that added: one
    folds = total.reshape(FOLDS, FEATURES + 2, FEATURES + 1)
    total = folds.sum(0)
    model.weights = _solved(total)
    without = np.array([_solved(total - fold) for fold in folds])
    raw = written(rows.mapInArrow(_raw(model, without), "raw double, y double"), "calibration")
    low, high = raw.agg(F.min("raw"), F.max("raw")).first()
    width = max((high - low) / BINS, 1e-12)
    bins = raw.groupBy(F.least(F.floor((F.col("raw") - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.avg("raw"), F.avg("y"), F.count("*"))
    bins = sorted(bins.collect())  # BINS rows at most
    values = isotonic(np.array([r[2] for r in bins]), np.array([float(r[3]) for r in bins]))
    model.knots = np.array([r[1] for r in bins])
    # the least slope within the curve's flat parts keeps better texts ahead
    model.values = values * 0.999 + 0.001 * np.linspace(0, 1, len(values))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The input's columns and score, from 0 to 1, higher where label 1 is likelier. Only the text counts; null is empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(text.as_py() or "") for text in batch.column("text")]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, "score"])

    docs = docs.drop("score")
    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, score double")


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The input's columns with held_out, score and predicted (1 where the score reaches ``threshold``, else 0).

    The model learns from ``labels`` and the texts of documents that are not
    held out; language, source and id are not read. Input columns named
    held_out, score or predicted are replaced. Rows are scored one for one,
    null and empty texts too; an empty table gives an empty result.
    """
    docs = docs.drop("held_out", "score", "predicted")
    scored = score(docs, fit(docs, labels, label=label, fit_rows=fit_rows))
    return scored.select(*docs.columns, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
