"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Statistics are taken over whole texts. The normal equations are summed inside partitions and then by row of the
matrix; the calibration counts are summed by bin; the driver gets one matrix and at most ``bins`` rows.

Defined results: null text counts as empty; empty texts get the score that their statistics earn; without
labelled rows (or with labels of one class) every score is that class's prior, 0.5 without any; labels that
repeat for an id count once, at their largest, and ids without a label or with another value than 0 and 1 teach nothing; equal texts,
repeated rows among them, get equal scores; very long texts are read whole; an empty table gives no rows; only id and text are
read, ``out`` is replaced if it is there, and all other columns stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table, text_or_empty

N_STATS = 18


def statistics(texts) -> np.ndarray:
    """One row of N_STATS document statistics for each text."""
    out = np.zeros((len(texts), N_STATS))
    for i, text in enumerate(texts):
        n = len(text)
        if not n:
            continue
        c = np.bincount(_CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).clip(0, 255)], minlength=8) / n
        words = text.split()
        lines = text.split("\n")
        k = max(1, len(words))
        distinct = len(set(words))
        lone = sum(1 for w in words if not w[0].isalpha())
        tails = sum(1 for w in words if w[-1] in "!#$%&*|~^")
        out[i] = (
            c[0], c[1], c[2], c[3], c[4], c[5], c[6],
            np.log1p(n), np.log1p(k), min(20.0, (n - len(words) + 1) / k), distinct / k,
            np.log1p(n / len(lines)), len(set(lines)) / len(lines), np.log1p(len(lines)),
            tails / k, lone / k, c[2] / (c[1] + c[2] + 1e-9), text.count("!!") / k,
        )
    return out


def _classes() -> np.ndarray:
    """0 space, 1 lower case and beyond ASCII, 2 upper case, 3 digit, 4 sentence marks, 5 strange marks, 6 line ends."""
    out = np.full(256, 1)
    for code in range(128):
        ch = chr(code)
        out[code] = 6 if ch == "\n" else 0 if ch.isspace() else 2 if ch.isupper() else 3 if ch.isdigit() else 1 if ch.isalpha() else 4 if ch in ".,;:'\"?-()" else 5
    return out


_CLASS = _classes()


def _stats(texts: pd.Series) -> pd.Series:
    return pd.Series(list(statistics(list(texts))))


class Model:
    """z = sqrt(2/D) cos((x - mean)/sd W + b); score = isotonic(ridge(z)), made strict by a small share of the ridge score."""

    def __init__(self, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 1 / width, (N_STATS, features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.mean, self.sd = np.zeros(N_STATS), np.ones(N_STATS)
        self.beta = np.zeros(features + 1)
        self.knots, self.values = np.array([0.0]), np.array([0.5])

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(2 / len(self.b)) * np.cos(np.clip((x - self.mean) / self.sd, -8, 8) @ self.w + self.b)
        return np.concatenate([z, np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.lift(x) @ self.beta, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        r = self.raw(x)
        return np.round(np.clip(0.99 * np.interp(r, self.knots, self.values) + 0.01 * r, 0, 1), 9)  # sums differ in the last place with the batch


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators."""
    level, weight, length = [], [], []
    for a, b in zip(y, w):
        level.append(a), weight.append(b), length.append(1)
        while len(level) > 1 and level[-2] >= level[-1]:
            total = weight[-2] + weight[-1]
            level[-2:] = [(level[-2] * weight[-2] + level[-1] * weight[-1]) / total]
            weight[-2:] = [total]
            length[-2:] = [length[-2] + length[-1]]
    return np.repeat(level, length)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, features: int = 192, width: float = 3.0, ridge: float = 1e-3, bins: int = 400, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Folds 1-3 fit the ridge, fold 4 calibrates, fold 0 is never read."""
    bounded_batches(docs.sparkSession)
    model = Model(features, width, seed)
    y = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("double").alias("_y"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), fold(id_col).alias("_fold"), F.pandas_udf(_stats, "array<double>")(text_or_empty(text_col)).alias("_x")).where("_fold > 0")
    rows = rows.join(y, "_id").select("_fold", "_x", "_y").persist()
    try:
        return _fitted(model, rows, ridge, bins)
    finally:
        rows.unpersist()


def _fitted(model: Model, rows: DataFrame, ridge: float, bins: int) -> Model:
    m = [F.avg(F.col("_x")[i]).alias(f"m{i}") for i in range(N_STATS)] + [F.stddev_pop(F.col("_x")[i]).alias(f"s{i}") for i in range(N_STATS)]
    got = rows.where("_fold < 4").agg(F.count("*").alias("n"), F.avg("_y").alias("prior"), *m).first()
    if not got["n"] or got["prior"] in (0.0, 1.0):
        model.values = np.array([0.5 if got["prior"] is None else got["prior"]])
        return model
    model.mean = np.array([got[f"m{i}"] for i in range(N_STATS)])
    model.sd = np.array([got[f"s{i}"] for i in range(N_STATS)]) + 1e-6
    d = len(model.b) + 1

    def sums(batches):
        a = np.zeros((d, d + 1))
        for pdf in batches:
            z = model.lift(np.array(pdf["_x"].tolist()).reshape(len(pdf), N_STATS))
            a[:, :d] += z.T @ z
            a[:, d] += z.T @ pdf["_y"].to_numpy()
        yield pd.DataFrame({"i": np.arange(d), "row": list(a)})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "row": [np.sum(pdf["row"].tolist(), axis=0)]})

    part = rows.where("_fold < 4").select("_x", "_y").mapInPandas(sums, "i int, row array<double>")
    matrix = np.zeros((d, d + 1))
    for r in part.groupBy("i").applyInPandas(total, "i int, row array<double>").toLocalIterator():
        matrix[r["i"]] = r["row"]
    model.beta = np.linalg.solve(matrix[:, :d] + ridge * got["n"] * np.eye(d), matrix[:, d])

    @F.pandas_udf("int")
    def bin_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.minimum((model.raw(np.array(x.tolist()).reshape(len(x), N_STATS)) * bins).astype(int), bins - 1))

    for wanted in ("_fold = 4", "_fold < 4"):  # a table too small for fold 4 calibrates on the others
        counts = rows.where(wanted).groupBy(bin_of("_x").alias("b")).agg(F.avg("_y").alias("y"), F.count("*").alias("w")).orderBy("b").collect()  # at most `bins` rows
        if counts:
            break
    model.knots = np.array([(r["b"] + 0.5) / bins for r in counts])
    model.values = isotonic(np.array([r["y"] for r in counts]), np.array([float(r["w"]) for r in counts]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.score(statistics(list(texts))))

    return docs.withColumn(out, scored(text_or_empty(text_col)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
