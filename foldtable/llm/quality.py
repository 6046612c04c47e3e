"""Quality scores: ridge regression on random Fourier features of document statistics.

Random Fourier features stand in for a Gaussian kernel over standardised statistics of the whole
text. Each partition sums its share of the normal equations, by fold; the sums are small, of a
fixed size, and are solved on the driver. Scores of rows by the folds without them are
calibrated by isotonic regression over bins.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_lists, slices, stage

CUT = 0.3
FOLDS = 5  # rows of fold 0 are held out
MARKS = b"!#$%&*|.,;:?-_/\\@=+<>()[]{}\"'"
FEATURES = 256
SPREAD = 1.0  # width of the kernel against the root of the number of statistics
RIDGE = 1e-5
BINS, LOW, HIGH = 4000, -1.0, 2.0


def statistics(text: bytes) -> list[float]:
    """Statistics of one whole text, all finite; an empty text has a row of its own kind."""
    n = len(text)
    chars = np.bincount(np.frombuffer(text, "uint8"), minlength=256) if n else np.zeros(256, "int64")
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    counts, starts = Counter(words), Counter(lines)
    k, u, m = max(1, len(words)), max(1, len(counts)), max(1, len(lines))
    size = n - int(chars[[9, 10, 13, 32]].sum())
    letters = int(chars[65:91].sum() + chars[97:123].sum() + chars[128:].sum())
    some = max(1, size)
    share = chars[chars > 0] / max(1, n)
    marks = [math.sqrt(int(chars[c]) / some) for c in MARKS]
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), size / k, chars[65:91].sum() / max(1, letters),
        math.sqrt(chars[48:58].sum() / some), letters / some, chars[128:].sum() / some, len(counts) / k, math.log(k / u), max(counts.values(), default=0) / k,
        math.log1p(len(words) / m), len(starts) / m, max(starts.values(), default=0) / m, float(-(share * np.log(share)).sum()),
        sum(len(x) == 1 for x in words) / k, max(map(len, counts), default=0) ** 0.5, *marks,
    ]


WIDTH = len(statistics(b""))


def _describe(batches):
    for batch in batches:
        for some in slices(batch, 1000):
            rows = np.array([statistics(t) for t in byte_lists(some, "text")], dtype="float64")
            lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), WIDTH).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), lists], ["doc_id", "x"])


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS, F.lit(0)).cast("int")


class Projection:
    """Standardised statistics to random Fourier features and a constant, the same in every task."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.turn = rng.normal(size=(len(mean), FEATURES)) / (SPREAD * math.sqrt(len(mean)))
        self.phase = rng.uniform(0, 2 * math.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.turn + self.phase) * math.sqrt(2 / FEATURES), np.ones((len(z), 1))])


def _matrix(batch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, WIDTH)


def _sums(project: Projection):
    """One partition's sums for each fold: a row for each row of z'z, with z'y at its end."""

    def run(batches):
        total = {}
        for batch in batches:
            z, y, folds = project(_matrix(batch)), batch.column("y").to_numpy().astype("float64"), batch.column("fold").to_numpy()
            for k in np.unique(folds):
                at = folds == k
                part = np.hstack([z[at].T @ z[at], (z[at].T @ y[at])[:, None]])
                total[int(k)] = total[int(k)] + part if int(k) in total else part
        for k, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(m), k, "int32")), pa.array(np.arange(len(m), dtype="int32")), pa.array(list(m), pa.list_(pa.float64()))],
                ["fold", "i", "v"],
            )

    return run


def _add(table):
    rows = table["v"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return pa.table({"fold": table["fold"][:1], "i": table["i"][:1], "v": pa.array([rows.sum(0)], pa.list_(pa.float64()))})


def _solved(total: np.ndarray) -> np.ndarray:
    a, b = total[:, :-1], total[:, -1]
    return np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1]) * np.eye(len(a)), b)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled means of y (sums over n rows at x, x rising) that never fall: where they lie, and they."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, n, strict=True):
        blocks.append([a * w, b, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    sums = np.array(blocks)
    at, value = sums[:, 0] / sums[:, 2], (sums[:, 1] + 0.5 * (sums[:, 1] / sums[:, 2])) / (sums[:, 2] + 0.5)
    return at, np.maximum.accumulate(value)


class Model:
    """What fitting leaves: a projection, weights and calibration knots, of a fixed size."""

    def __init__(self, project: Projection, weights: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.project, self.weights, self.at, self.value = project, weights, at, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.project(x) @ self.weights, LOW, HIGH)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # A little of the uncalibrated score keeps the order within a pooled block.
        return 0.99 * np.interp(raw, self.at, self.value) + 0.01 * np.clip(raw, 0, 1)


def _apply(score, kind: str):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, folds = _matrix(batch), batch.column("fold").to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(kind), batch.column("fold"), pa.array(score(x, folds))], [kind, "fold", "score"])

    return run


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, fold and statistics of each row of docs; the text alone is looked at."""
    found = docs.select("doc_id", "text").mapInArrow(_describe, "doc_id long, x array<double>")
    return found.select("doc_id", fold(F.col("doc_id")).alias("fold"), "x")


def fit(described: DataFrame, labels: DataFrame, seed: int = 11) -> Model | None:
    """Fits on the labelled rows whose fold is not 0; None where those don't hold both labels.

    All of them count. Labels without a document, or without a value, are ignored; a repeated
    label counts each time.
    """
    wanted = labels.where(F.col("quality").isNotNull() & (fold(F.col("doc_id")) > 0)).select("doc_id", F.col("quality").cast("int").alias("y"))
    train = stage(described.where("fold > 0").join(wanted, "doc_id").select("fold", "y", "x"), "quality-train")
    values = [F.col("x")[k] for k in range(WIDTH)]
    row = train.agg(F.min("y"), F.max("y"), *[F.avg(v).alias(f"m{k}") for k, v in enumerate(values)], *[F.stddev_pop(v).alias(f"s{k}") for k, v in enumerate(values)]).first()
    if row[0] is None or row[0] == row[1]:
        return None
    project = Projection(np.array(row[2 : 2 + WIDTH]), np.array(row[2 + WIDTH :]), seed)
    sums = train.mapInArrow(_sums(project), "fold int, i int, v array<double>").groupBy("fold", "i").applyInArrow(_add, "fold int, i int, v array<double>")
    parts = {k: np.zeros((FEATURES + 1, FEATURES + 2)) for k in range(1, FOLDS)}
    for k, i, v in sums.collect():  # FOLDS times FEATURES rows
        parts[k][i] = v
    total = sum(parts.values())
    models = {k: Model(project, _solved(total - parts[k]), np.zeros(1), np.zeros(1)) for k in parts}

    def others(x, folds):
        out = np.zeros(len(x))
        for k in np.unique(folds):
            out[folds == k] = models[int(k)].raw(x[folds == k])
        return out

    raw = train.mapInArrow(_apply(others, "y"), "y int, fold int, score double")
    bins = raw.groupBy(F.floor((F.col("score") - LOW) / (HIGH - LOW) * BINS).alias("bin")).agg(F.avg("score"), F.sum("y"), F.count("*"))
    at, y, n = (np.array(c, dtype="float64") for c in list(zip(*sorted(bins.collect()), strict=True))[1:])
    return Model(project, _solved(total), *isotonic(at, y, n))


def score(described: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, fold and score; without a model every score is 0.5."""
    if model is None:
        return described.select("doc_id", "fold", F.lit(0.5).alias("score"))
    return described.mapInArrow(_apply(lambda x, folds: model.score(x), "doc_id"), "doc_id long, fold int, score double")


def score_documents(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and verdict of every row of docs, repeated rows and rows without doc_id included.

    Null and empty texts are scored by their statistics like any other. An empty table gives no
    rows. Only texts enter scores; a null doc_id counts as held out.
    """
    described = stage(describe(docs), "quality-described")
    scored = score(described, fit(described, labels))
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose text scores at least CUT; the verdict is made where the text lies."""
    model = fit(stage(describe(docs), "quality-described"), labels)
    if model is None:
        return docs
    names = docs.columns

    def run(batches):
        for batch in batches:
            for some in slices(batch, 1000):
                x = np.array([statistics(t) for t in byte_lists(some, "text")], dtype="float64")
                yield pa.RecordBatch.from_arrays([some.column(c) for c in names], names).filter(pa.array(model.score(x) >= CUT))

    return docs.mapInArrow(run, docs.schema)
