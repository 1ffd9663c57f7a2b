"""Toxic spans by a linear-chain conditional random field; document scores from its marginals.

The data label documents, so the tags of tokens are latent: no token of a clean document is toxic, and at least one token
of a toxic document is. The field (two states; features: word, prefixes, suffixes, transitions) maximises the penalised
likelihood of those facts; the expected tags that a document's label leaves open follow from forward-backward. Features are
those whose document frequencies in toxic and clean documents differ beyond chance (a likelihood ratio test, with
Bonferroni's correction over all features); training starts from their log ratios. Forward-backward over the whole token
chain gives each token's marginal; a logistic layer over sums of them gives the document's score."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import bounded_sample, held_out, table, with_arrow_columns

_WORD = re.compile(r"\w+")
#: Tokens of a chain, and chains handled at once, in training.
SEGMENT, ROWS = 64, 2048


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # log-odds of state 1 by feature, added to `other`
    other: float = -4.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    layer: tuple[float, ...] = (-4.0, 6.0, 1.0, 0.0, 0.0)  # weights of what summary() gives

    def __post_init__(self) -> None:
        self._runs: dict[int, np.ndarray] = {}
        self._words: dict[str, float | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_runs": {}, "_words": {}}  # caches stay where they are

    def unary(self, word: str) -> float | None:
        """Log-odds of state 1, None for a word without a feature (its log-odds are `other`)."""
        try:
            return self._words[word]
        except KeyError:
            if len(self._words) > 60_000:
                self._words.clear()
            got = [v for f in word_features(word) if (v := self.weights.get(f)) is not None]
            self._words[word] = out = self.other + sum(got) if got else None
            return out

    def run(self, n: int) -> np.ndarray:
        """The product of n steps over words without a feature, scaled to a largest entry of 1."""
        if n not in self._runs:
            if len(self._runs) > 4096:
                self._runs.clear()
            step = np.exp(self.trans) * np.array([1.0, np.exp(self.other)])
            out, power = np.eye(2), step / step.max()
            k = n
            while k:
                if k & 1:
                    out = out @ power
                    out /= out.max()
                power = power @ power
                power /= power.max()
                k >>= 1
            self._runs[n] = out
        return self._runs[n]

    def marginals(self, n: int, at: list[int], odds: list[float]) -> list[float]:
        """P(state 1) of the tokens at `at`; exact forward-backward over all n tokens, whose other tokens share one factor."""
        if not at:
            return []
        edge = np.exp(self.trans)
        local = [np.array([1.0, np.exp(u)]) for u in odds]
        gaps = [at[0]] + [b - a - 1 for a, b in zip(at, at[1:], strict=False)] + [n - at[-1] - 1]
        first = np.array([1.0, np.exp(self.other)])
        fore, a = [], None
        for k, u in enumerate(local):
            if a is None:
                a = u if not gaps[0] else ((first / first.max()) @ self.run(gaps[0] - 1)) @ edge * u
            else:
                a = (a @ self.run(gaps[k])) @ edge * u
            a = a / a.sum()
            fore.append(a)
        b = self.run(gaps[-1]) @ np.ones(2)
        out = []
        for k in range(len(at) - 1, -1, -1):
            p = fore[k] * b
            out.append(float(p[1] / p.sum()))
            if k:
                b = self.run(gaps[k]) @ (edge @ (local[k] * b))
                b = b / b.sum()
        return out[::-1]

    def tag(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """(document score, [(start, end, marginal)] of tokens more likely toxic than not; code points)."""
        found: list[tuple[int, int, float]] = []
        at: list[int] = []
        n = 0
        if text:
            words = _WORD.findall(text.lower())
            if any(self.unary(w) is not None for w in set(words)):
                for n, m in enumerate(_WORD.finditer(text)):  # noqa: B007
                    if (u := self.unary(m[0].lower())) is not None:
                        at.append(n)
                        found.append((m.start(), m.end(), u))
                n += 1
        p = self.marginals(n, at, [u for _, _, u in found])
        return self.score(p), [(s, e, q) for (s, e, _), q in zip(found, p, strict=True) if q >= 0.5]

    def score(self, p: list[float]) -> float:
        return float(1 / (1 + math.exp(-max(-500.0, min(500.0, sum(w * f for w, f in zip(self.layer, summary(p), strict=True)))))))


def summary(p: list[float]) -> tuple[float, ...]:
    """Of a document's marginals: 1, the largest, log1p of their sum, of the sum without the largest, and the log-odds that none is toxic."""
    top, total = max(p, default=0.0), sum(p)
    return 1.0, top, math.log1p(total), math.log1p(max(0.0, total - top)), math.log1p(-sum(math.log1p(-min(q, 1 - 1e-9)) for q in p))


def word_features(word: str) -> list[str]:
    """The word, its prefixes and its suffixes of 3 to 6 code points."""
    ends = range(3, min(7, len(word)))
    return [f"={word}", *(f"<{word[:k]}" for k in ends), *(f">{word[-k:]}" for k in ends)]


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hashes of the runs of four word ids (of all of them, in shorter texts)."""
    width = min(4, len(ids))
    out = np.zeros(max(1, len(ids) - width + 1), np.uint64)
    for k in range(width):
        out = (out ^ ids[k : len(ids) - width + 1 + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def telling_features(rows: list[tuple[list[str], int]], ratio: float = 4.0, level: float = 0.05) -> dict[str, float]:
    """Features whose document frequency in toxic documents is at least `ratio` times that in clean ones, beyond chance, with the log of how many times."""
    known: dict[str, int] = {}
    count = ([], [])  # by label: a document's distinct word ids, and of how many documents
    n = [0, 0]
    seen: set[tuple[int, int, int]] = set()
    for words, y in rows:
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        # Copies are no further evidence: a document that shares two of three minima of its hashed shingles is left out.
        grams = _grams(ids)
        marks = {(y, k, int((grams * np.uint64(2 * m + 1)).min())) for k, m in enumerate((2654435761, 2246822519, 3266489917))}
        if len(seen & marks) < 2:
            count[y].append(np.unique(ids))
            n[y] += 1
        seen |= marks
    index: dict[str, int] = {}
    of_word = [np.array([index.setdefault(f, len(index)) for f in word_features(w)], np.int64) for w in known]
    total = []
    for docs in count:
        out = np.zeros(len(index), np.int64)
        for ids in docs:
            if len(ids):
                out[np.unique(np.concatenate([of_word[i] for i in ids.tolist()]))] += 1
        total.append(out)
    share = n[1] / (n[0] + n[1])
    limit = 2 * math.log(len(index) / level + 1)
    found = {}
    for f, i in index.items():
        k, c = int(total[1][i]), int(total[0][i])
        if k and k / n[1] >= ratio * (c + 0.5) / n[0]:
            p = k / (k + c)
            g = 2 * (k * math.log(p / share) + (c * math.log((1 - p) / (1 - share)) if c else 0.0))
            if g >= limit:
                found[f] = math.log(k / n[1] * n[0] / (c + 0.5))
    return dict(sorted(found.items()))


def _segments(rows: list[tuple[list[str], int]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Kinds of words in rows of SEGMENT tokens (training only; -1: no token), the row's document, how many rows it stands
    for, the features of each kind (0: none), and each document's kinds. Equal rows of clean documents are one: their
    documents do not matter."""
    kinds: dict[tuple[int, ...], int] = {(): 0}
    known: dict[str, int] = {}
    rows_, docs, all_ = [], [], []
    for d, (words, y) in enumerate(rows):
        for w in set(words):
            if w not in known:
                known[w] = kinds.setdefault(tuple(index[f] for f in word_features(w) if f in index), len(kinds))
        f = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        all_.append(f)
        for s in range(0, len(words), SEGMENT):
            rows_.append(f[s : s + SEGMENT])
            docs.append(d if y else -1)
    x = np.full((len(rows_), SEGMENT + 1), -1, np.int32)
    for i, (f, d) in enumerate(zip(rows_, docs, strict=True)):
        x[i, : len(f)], x[i, SEGMENT] = f, d
    x, times = np.unique(x, axis=0, return_counts=True)
    has = np.zeros((len(kinds), len(index) + 1))
    has[:, 0] = 1.0  # the bias
    for fs, k in kinds.items():
        has[k, list(fs)] = 1.0
    return x[:, :SEGMENT], x[:, SEGMENT], times, has, all_


def _expected(u: np.ndarray, trans: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of tokens: marginals of state 1, expected transition counts, and the log probability that all are state 0."""
    rows, steps = u.shape
    edge, live = np.exp(trans), mask.astype(bool)
    local = np.stack([np.ones_like(u), np.exp(u)], -1)
    fore, back = np.zeros((steps, rows, 2)), np.ones((steps, rows, 2))
    size = local[:, 0].sum(-1, keepdims=True)
    fore[0], total = local[:, 0] / size, np.log(size[:, 0])
    for t in range(1, steps):
        a = fore[t - 1] @ edge * local[:, t]
        size = a.sum(-1, keepdims=True)
        fore[t] = np.where(live[:, t, None], a / size, fore[t - 1])
        total += np.where(live[:, t], np.log(size[:, 0]), 0.0)
    pairs = np.zeros((rows, 2, 2))
    for t in range(steps - 1, 0, -1):
        right = local[:, t] * back[t]
        b = right @ edge.T
        pair = fore[t - 1][:, :, None] * edge * right[:, None, :]
        pairs += np.where(live[:, t, None, None], pair / pair.sum((1, 2), keepdims=True), 0.0)
        back[t - 1] = np.where(live[:, t, None], b / b.sum(-1, keepdims=True), back[t])
    p = fore * back
    return (p[..., 1] / p.sum(-1)).T, pairs, trans[0, 0] * (mask.sum(1) - 1) - total


def train(rows: list[tuple[str, int]], *, steps: int = 40, l2: float = 0.5, rate: float = 0.5) -> Model:
    """Fit on (text, 0 or 1) rows. Without both labels the model knows no toxic word and gives every text the same score."""
    rows = sorted((t or "", int(y)) for t, y in rows)
    if len({y for _, y in rows}) < 2:
        return Model()
    pool: dict[str, str] = {}  # one object for each word
    split = [([pool.setdefault(w, w) for w in _WORD.findall(t.lower())], y) for t, y in rows]
    telling = telling_features(split)
    index = {f: i + 1 for i, f in enumerate(telling)}
    x, doc, times, has, kinds = _segments(split, index)
    start = np.array([-5.0, *(min(4.0, v) for v in telling.values())])  # also the centre of the penalty
    w, trans = start.copy(), np.zeros((2, 2))
    if len(x) and len(index):
        m = x >= 0
        toxic, known, words = doc >= 0, x[m], m.sum(1)
        gw, gt = np.zeros_like(w), np.zeros_like(trans)
        for _ in range(steps):
            odds = has @ w
            parts = [_expected(np.where(live, odds[k], 0.0), trans, live) for k, live in ((x[i : i + ROWS], m[i : i + ROWS]) for i in range(0, len(x), ROWS))]
            p, pairs, none = (np.concatenate(v) for v in zip(*parts, strict=True))
            # What the labels leave open: nothing in clean documents, all but the tags that are all 0 in toxic ones.
            clear = np.exp(np.minimum(np.bincount(doc[toxic], weights=(none * times)[toxic], minlength=len(rows)), -1e-9))[doc] * toxic
            some = np.where(toxic, 1 / (1 - clear), 0.0)
            want = pairs * some[:, None, None]
            want[:, 0, 0] = np.where(toxic, (pairs[:, 0, 0] - clear * (words - 1)) * some, words - 1)
            v = (p * ((some - 1) * times)[:, None])[m]
            g = np.bincount(known, weights=v, minlength=len(has)) @ has - l2 * (w - start)
            h = ((want - pairs) * times[:, None, None]).sum(0) - l2 * trans
            gw += g * g
            gt += h * h
            w += rate * g / np.sqrt(gw + 1e-9)
            trans += rate * h / np.sqrt(gt + 1e-9)
    model = Model({k: float(w[i]) for k, i in index.items()}, float(w[0]), trans)
    # The layer over the marginals: logistic regression on the same rows.
    f, odds = [], has @ w
    for k in kinds:
        at = np.flatnonzero(k)
        f.append(summary(model.marginals(len(k), at.tolist(), odds[k[at]].tolist())))
    f, t = np.array(f), np.array([y for _, y in rows], float)
    b = np.zeros(f.shape[1])
    for _ in range(60):  # Newton steps
        q = 1 / (1 + np.exp(-f @ b))
        h = (f * (q * (1 - q))[:, None]).T @ f + 0.1 * np.eye(f.shape[1])
        b += np.clip(np.linalg.solve(h, f.T @ (t - q) - 0.1 * b), -2, 2)
    model.layer = tuple(float(v) for v in b)
    return model


def fit(df: DataFrame, labels: DataFrame, *, allowed: Callable[[Column], Column], text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = 2000) -> Model:
    """Fit on at most about `sample_rows` labelled documents of each label, chosen by a hash of the id.

    The sampled ids (a bounded number, hence the broadcast) select whole texts. Ids whose labels contradict count as toxic."""
    known = labels.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y")).where(F.col("__y").isNotNull() & F.col("__id").isNotNull())
    chosen = bounded_sample(known.where(allowed(F.col("__id"))), F.col("__id"), sample_rows, F.col("__y"))
    rows = df.join(F.broadcast(chosen), F.col(f"`{id_col}`") == F.col("__id")).select(F.col(f"`{text_col}`"), "__y")
    return train([(r[0], r[1]) for r in rows.collect()])


def tag(df: DataFrame, model: Model, text_col: str = "text", *, outputs: tuple[str, ...] = ("score", "predicted", "spans"), keep: Iterable[str] | None = None) -> DataFrame:
    """The columns `keep` of df (all by default) with the outputs asked for of score, predicted and spans (offsets of toxic tokens with their marginals).

    Null and empty texts get the score of a text without toxic tokens and no spans. Rows are independent; columns
    with the new names are replaced; an empty table stays empty."""
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())])

    def fn(texts: list) -> list[pa.Array]:
        got = [model.tag(t) for t in texts]
        made = {
            "score": lambda: pa.array([g[0] for g in got], pa.float64()),
            "predicted": lambda: pa.array([int(g[0] >= 0.5) for g in got], pa.int32()),
            "spans": lambda: pa.array([[{"start": s, "end": e, "p": q} for s, e, q in g[1]] for g in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))),
        }
        return [made[o]() for o in outputs]

    kinds = {"score": T.DoubleType(), "predicted": T.IntegerType(), "spans": T.ArrayType(span)}
    return with_arrow_columns(df, text_col, [T.StructField(o, kinds[o]) for o in outputs], fn, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), allowed=lambda i: ~held_out(i))
    return tag(docs, model, outputs=("score", "predicted"), keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")

