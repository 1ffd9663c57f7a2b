"""Quality rules with risk-controlled thresholds.

Base rules are fixed. Further rules compare ratios with cutoffs, and one number, the allowance, moves all cutoffs of a
stratum: each rule takes the strictest cutoff that rejects at most that share of good documents in a first part of the
labelled ones, if it rejects bad ones oftener. A second part, which had no say in this, walks through the allowances from
the laxest (fixed-sequence testing, so the walk needs no correction) and keeps the last before the first whose exact
binomial (Clopper-Pearson) upper bound for false rejection, by all rules together, exceeds `risk`. The level is divided
over the strata (Bonferroni): with probability 1 - `delta`, of the good documents that pass the base rules at most `risk`
are rejected in every stratum. Bounds need independent rows, so of copies and near copies one is counted."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm.common import held_out, materialize, table, with_arrow_columns

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Extra counts for the method's own rules.
EXTRA = ("n_lines", "n_distinct_words")
#: Minima of hashed four-word shingles: of documents that share one, one is calibrated on. Copies of similarity 0.8 share
#: none of four with probability 0.002.
KEYS = 4


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside a window of `width` words that occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    key, m = ids, len(seen)
    for k in range(1, width):  # exact: the key of a prefix becomes its rank, then one more word joins
        key = key[:-1] * m + ids[k:]
        if k < width - 1:
            _, key = np.unique(key, return_inverse=True)
    _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
    hit = cnt[inv] > 1
    if not hit.any():
        return 0
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(hit)
    step[at] += 1
    np.subtract.at(step, at + width, 1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * (len(COUNTS) + len(EXTRA))
    words = text.encode("utf-8", "surrogatepass").split()
    lines, dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            n_lines += 1
            dup += line in lines
            lines.add(line)
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    return len(words), chars, sum(text.count(c) for c in _SYMBOLS), dup, repeated_words(words), n_lines, len(set(words))


def copy_keys(text: str | None) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return []
    ids = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    width = min(4, len(ids))
    h = np.zeros(len(ids) - width + 1, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : len(ids) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return [int(((h ^ np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(8)).min()) * KEYS + k for k in range(KEYS)]


def features(df: DataFrame, text_col: str = "text", keep: Iterable[str] | None = None, keys: str | None = None) -> DataFrame:
    """The columns `keep` of df (all by default) with the counts of each whole text, and with copy_keys() as `keys`, where
    asked for. Null and empty texts count 0 everywhere and have no keys."""

    def fn(texts: list) -> list[pa.Array]:
        rows = [measure(t) for t in texts]
        out = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS) + len(EXTRA))]
        return out + ([pa.array([copy_keys(t) for t in texts], pa.list_(pa.int64()))] if keys else [])

    fields = [T.StructField(c, T.LongType()) for c in COUNTS + EXTRA]
    return with_arrow_columns(df, text_col, fields + ([T.StructField(keys, T.ArrayType(T.LongType()))] if keys else []), fn, keep)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Ratios; larger is worse. Where the denominator is 0 the ratio is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    mean = ratio("word_chars", "n_words")
    return {
        "symbols": ratio("n_symbols", "word_chars"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "repeats": ratio("n_repeat_words", "n_words"),
        "long_words": mean,
        "short_words": F.when(F.col("n_words") > 0, -mean).otherwise(F.lit(-100.0)),
    }


#: Candidate cutoffs of each rule, laxest first. A document fails if its ratio is above the cutoff.
GRID = {
    "symbols": [0.5 * 0.8**k for k in range(24)],
    "dup_lines": [0.9 * 0.85**k for k in range(24)],
    "repeats": [0.2 * 0.85**k for k in range(16)],
    "long_words": [30.0 * 0.94**k for k in range(24)],
    "short_words": [-1.2 * 1.05**k for k in range(24)],
}


#: Shares of good documents that each rule may reject in the first part of the labelled ones.
ALLOWANCES = (0.0, 0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05)


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1) or tiny)
    out = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + k * d or tiny)
            c = 1.0 + k / c or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * out


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson upper limit of a proportion with k of n: the p at which P(X <= k) = level."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if beta_share(1.0 - p, n - k, k + 1) > level else (lo, p)
    return hi


def independent(rows: DataFrame, id_col: str, keys: str) -> DataFrame:
    """The rows that share no key with a row of smaller id."""
    each = rows.select(F.col(f"`{id_col}`").alias("__row"), F.explode(keys).alias("__key"))
    first = each.groupBy("__key").agg(F.min("__row").alias("__first"))
    later = each.join(first, "__key").where(F.col("__row") != F.col("__first")).select("__row")
    return rows.join(later, F.col(f"`{id_col}`") == F.col("__row"), "left_anti")


def fails(cutoffs: dict[str, float]) -> Column:
    out = F.lit(False)
    for r, c in cutoffs.items():
        out = out | (rules()[r] > c)
    return out


def by_stratum(stratum: Column, values: dict[str, Column]) -> Column:
    out = F.lit(False)
    for s, v in values.items():
        out = F.when(stratum == F.lit(s), v).otherwise(out)
    return out


def calibrate(rows: DataFrame, stratum: Column, good: Column, second: Column, risk: float, delta: float) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and rule. rows: one of each group of copies; second: which part a row belongs to.

    Only counts are collected: strata x rules x candidates of the first part, strata x allowances of the second."""
    cols = rules()
    aggs = [F.count_if(good).alias("n1"), F.count_if(~good).alias("n0")]
    aggs += [F.count_if((cols[r] > c) & (good if y else ~good)).alias(f"{r}_{i}_{y}") for r, grid in GRID.items() for i, c in enumerate(grid) for y in (0, 1)]
    paths: dict[str, list[dict[str, float]]] = {}
    for row in rows.where(~second).groupBy(stratum.alias("s")).agg(*aggs).collect():
        steps = []
        for q in ALLOWANCES:
            step = {}
            for r, grid in GRID.items():
                for i, c in enumerate(grid):
                    wrong, right = row[f"{r}_{i}_1"], row[f"{r}_{i}_0"]
                    if wrong > q * row["n1"]:
                        break
                    if right * row["n1"] > 2 * wrong * row["n0"]:
                        step[r] = c
            steps.append(step)
        paths[row["s"]] = steps
    tests = [by_stratum(stratum, {s: fails(steps[i]) for s, steps in paths.items()}) for i in range(len(ALLOWANCES))]
    found = rows.where(second & good).groupBy(stratum.alias("s")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t).alias(f"k{i}") for i, t in enumerate(tests)]).collect()
    level = delta / max(1, len(paths))
    out: dict[str, dict[str, float]] = {}
    for row in found:
        for i, step in enumerate(paths.get(row["s"], [])):
            if upper_bound(row[f"k{i}"], row["n"], level) > risk:
                break
            out[row["s"]] = step
    return out


def judge(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = 0.05, delta: float = 0.05, allowed: Callable[[Column], Column] | None = None) -> DataFrame:
    """df without text_col, with the counts, base_failed and kept.

    labels has id_col and quality (1 good); allowed: a condition on the ids to calibrate on. A stratum without enough
    labelled rows gets no extra rule, so only base_failed rejects there; a null stratum is a stratum of its own; null
    texts have no words and fail the base rule. Repeated rows are judged alike and calibrated on once; contradicting
    labels of an id count as not good. Columns with a new column's name are replaced; empty tables give no rows."""
    kept = [c for c in df.columns if c.lower() not in {*COUNTS, *EXTRA, "base_failed", "kept", "__keys", "__stratum"} and c != text_col]
    ready = df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("\0null")).alias("__stratum"), F.col(f"`{text_col}`").alias("__text"))
    ready = features(ready, "__text", [*kept, "__stratum"], "__keys")
    ready = materialize(ready, "quality").withColumn("base_failed", base_failed())
    known = labels.groupBy(F.col(id_col).alias("__id")).agg((F.min("quality") == 1).alias("__good")).where(F.col("__good").isNotNull() & F.col("__id").isNotNull())
    known = known if allowed is None else known.where(allowed(F.col("__id")))
    used = ready.where(~F.col("base_failed")).select(F.col(f"`{id_col}`").alias("__id"), "__stratum", "__keys", *COUNTS, *EXTRA).join(known, "__id")
    rest = ["__stratum", "__good", *COUNTS, *EXTRA]
    used = materialize(used, "labelled")
    used = independent(used, "__id", "__keys").groupBy("__id").agg(F.min(F.struct(*rest)).alias("r")).select("__id", *[F.col(f"r.{c}").alias(c) for c in rest])
    cuts = calibrate(materialize(used, "labelled"), F.col("__stratum"), F.col("__good"), F.pmod(F.xxhash64("__id"), F.lit(2)) == 1, risk, delta)
    bad = by_stratum(F.col("__stratum"), {s: fails(c) for s, c in cuts.items()})
    return ready.withColumn("kept", ~F.col("base_failed") & ~bad).drop("__stratum", "__keys", *EXTRA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the documents with crc32(doc_id) mod 5 = 0 are not used, so that results can be measured on them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs, table(spark, sf_dir, "labels"), allowed=lambda i: ~held_out(i)).select("doc_id", *COUNTS, "base_failed", "kept")
