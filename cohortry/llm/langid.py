"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties, so weights are sparse), then
calibrated by one temperature on examples that training did not see."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import bounded_sample, held_out, table, with_arrow_columns

UNKNOWN = "und"
#: Features: hashed n-grams of 1 to 3 code points.
BITS = 15


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter by its Unicode category; number signs such as Roman numerals are not."""
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of the hashed n-grams of the whole text; runs of white space count as one space."""
    c = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    mul, shift = np.uint32(2654435761), np.uint32(32 - BITS)
    one = c * mul
    two = (one[:-1] ^ (c[1:] + np.uint32(7))) * mul
    three = (two[:-1] ^ (c[2:] + np.uint32(77))) * mul
    counts = np.bincount(np.concatenate([one >> shift, two >> shift, three >> shift]).astype(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = grams(text)
        x = np.log1p(n) * self.idf[at]
        return at, x / (np.sqrt(x @ x) or 1.0)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*self.vector(text)) / self.temperature)
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(rows: list[tuple[str, str]], *, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, seed: int = 7) -> Model:
    """Fit on (text, label) rows; every fifth row in a shuffled order is kept for the temperature."""
    rows = sorted((t, y) for t, y in rows if has_letter(t))
    classes = sorted({y for _, y in rows})
    size = 1 << BITS
    df = np.zeros(size)
    raw = [grams(t) for t, _ in rows]
    for at, _ in raw:
        df[at] += 1
    model = Model(classes, np.log((1 + len(rows)) / (1 + df)) + 1.0, np.zeros((size, len(classes))), np.zeros(len(classes)))
    if len(classes) < 2:
        return model
    data = []
    for at, n in raw:
        x = np.log1p(n) * model.idf[at]
        data.append((at, x / np.sqrt(x @ x)))
    target = np.array([classes.index(y) for _, y in rows])
    order = np.random.default_rng(seed).permutation(len(rows))
    fit, rest = order[: max(1, len(order) * 4 // 5)], order[max(1, len(order) * 4 // 5) :]
    # The last coordinate is the bias, which has no penalty.
    z, n = np.zeros((size + 1, len(classes))), np.zeros((size + 1, len(classes)))
    pen = np.full((size + 1, 1), l1)
    pen[size] = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= pen[i], 0.0, -(zi - np.sign(zi) * pen[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in np.random.default_rng(seed + 1).permutation(fit):
            at, x = data[k]
            i, v = np.append(at, size), np.append(x, 1.0)
            w = weights(i)
            p = softmax(v @ w)
            p[target[k]] -= 1.0
            g = v[:, None] * p[None, :]
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - step * w
            n[i] += g * g
    every = weights(np.arange(size + 1))
    model.weights, model.bias = every[:size], every[size]
    if len(rest):
        logits = np.array([model.logits(*data[k]) for k in rest])

        def loss(t: float) -> float:
            s = logits / t
            top = s.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(s - top).sum(1)) + top[:, 0] - s[np.arange(len(rest)), target[rest]]))

        model.temperature = float(min(np.geomspace(0.05, 20.0, 121), key=loss))
    return model


def fit(df: DataFrame, *, allowed: Column, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_rows: int = 800) -> Model:
    """Fit on at most about `sample_rows` whole texts of each label, chosen by a hash of the id (bounded, the same in every run)."""
    usable = df.where(allowed & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    picked = bounded_sample(usable, F.col(f"`{id_col}`"), sample_rows, F.col(f"`{label_col}`"))
    return train([(r[0], r[1]) for r in picked.select(F.col(f"`{text_col}`"), F.col(f"`{label_col}`").cast("string")).collect()])


def identify(df: DataFrame, model: Model, text_col: str = "text", keep: Iterable[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all by default) with lang_pred and score (calibrated probability). Null texts and texts without a letter: `und`, 0.

    Each row is judged from its whole text alone; columns with the new names are replaced; an empty table stays empty."""

    def fn(texts: list) -> list[pa.Array]:
        got = [model.predict(t) for t in texts]
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

    return with_arrow_columns(df, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], fn, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, allowed=~held_out())
    return identify(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
