"""Document quality by a regularised quadratic discriminant over document statistics.

* *Statistics*: each whole text gives a fixed vector of counts (words, their lengths, repeats of words and of pairs,
  capitals, digits, symbols, punctuation, lines), transformed to log ratios, which are near to normal. The vectors are
  written once and all later passes read them instead of texts.
* *Moments*: for both classes and each of four folds, Spark sums counts, vectors and outer products over all labelled
  rows; some hundred numbers a class come to the driver, whatever the input.
* *Shrinkage*: a class covariance is drawn to the pooled one by ``toward_pooled`` and to its own diagonal by
  ``toward_diagonal``. Both, and a temperature that makes scores probabilities, are the ones of a fixed grid with the
  least log loss in cross-validation, itself a sum over all labelled rows.
* *Scores*: the Cholesky factor and the log determinant of both covariances are computed once and sent to all tasks;
  a score is the logistic function of the difference of log densities (squared Mahalanobis lengths) and log shares.

Labels are learned from only where ``held_out`` is false; a null or unknown label, a null id and an id with both labels
teach nothing. Texts that share an id are scored each for itself, and each is learned from. Null texts count as empty
and have the statistics of zero words. Without labels every score is 0.5; with one class only it is that class's
smoothed share. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_or_empty
from tidemark.llm.hashing import mix, span_hashes, word_spans

#: The statistics, in order.
STATISTICS = ["words", "word_length", "length_spread", "capitals", "digits", "symbols", "punctuation", "symbol_words", "repeats", "distinct", "pairs", "top_word", "lines", "other_bytes"]
_D = len(STATISTICS)
_SYMBOL, _POINT, _UPPER, _LETTER, _DIGIT = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[[ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~"]] = True
_POINT[[ord(c) for c in ".,;:?'\"()-[]"]] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
FOLDS = 4
GRID = [(p, d) for p in (0.02, 0.1, 0.3, 0.6, 0.9) for d in (0.02, 0.1, 0.4)]
TEMPERATURES = np.geomspace(1, 64, 13)


def _ratio(part, whole) -> float:
    """A share as log odds, with half a case added on either side."""
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of a whole text."""
    low = text.lower()  # of bytes: A-Z only
    data = np.frombuffer(text, np.uint8)
    byte = np.bincount(data, minlength=256)
    start, end = word_spans(data)
    n = len(start)
    size = end - start
    words = span_hashes(low, start, end)
    _, counts = np.unique(words, return_counts=True)
    pairs = np.unique(mix(words[1:]) + words[:-1])
    letters, upper = int(byte[_LETTER].sum()), int(byte[_UPPER].sum())
    filled = int(size.sum())
    symbols, points, digits = int(byte[_SYMBOL].sum()), int(byte[_POINT].sum()), int(byte[_DIGIT].sum())
    return np.array([
        np.log1p(n), np.log((filled + 1) / (n + 1)), np.log1p(size.std() if n else 0.0),
        _ratio(upper, letters), _ratio(digits, filled), _ratio(symbols, filled), _ratio(points, filled),
        _ratio(int(_SYMBOL[data[end - 1]].sum()), n), _ratio(int((words[1:] == words[:-1]).sum()), max(n - 1, 0)),
        _ratio(len(counts), n), _ratio(len(pairs), max(n - 1, 0)), _ratio(int(counts.max()) if n else 0, n),
        np.log((byte[10] + 1) / (n + 1)), _ratio(max(filled - letters - symbols - points - digits, 0), filled),
    ])


@dataclass
class Moments:
    """Number, sum and sum of outer products of vectors."""

    n: float
    total: np.ndarray
    outer: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.outer + other.outer)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.outer - other.outer)

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    @property
    def covariance(self) -> np.ndarray:
        return self.outer / self.n - np.outer(self.mean, self.mean)


@dataclass
class Discriminant:
    """Means, Cholesky factors, log determinants and log shares of the two classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    logdets: list[float]
    shares: list[float]
    temperature: float = 1.0

    @staticmethod
    def of(classes: list[Moments], toward_pooled: float, toward_diagonal: float, temperature: float = 1.0) -> Discriminant:
        n = sum(c.n for c in classes)
        pooled = sum(c.n * c.covariance for c in classes) / n
        factors = []
        for c in classes:
            s = (1 - toward_pooled) * c.covariance + toward_pooled * pooled
            s = (1 - toward_diagonal) * s + toward_diagonal * np.diag(np.diag(s))
            # A statistic that never varies would leave no density.
            factors.append(np.linalg.cholesky(s + np.diag(1e-3 * np.diag(pooled) + 1e-6)))
        return Discriminant([c.mean for c in classes], factors, [2 * float(np.log(np.diag(f)).sum()) for f in factors], [float(np.log(c.n / n)) for c in classes], temperature)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density and share of class 1 less those of class 0."""
        out = np.zeros(len(x))
        for sign, mean, factor, logdet, share in zip((-1, 1), self.means, self.factors, self.logdets, self.shares):
            z = np.linalg.solve(factor, (x - mean).T)
            out += sign * (share - 0.5 * logdet - 0.5 * (z * z).sum(axis=0))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -500, 500)))


@dataclass
class Constant:
    """Where there are not two classes to tell apart."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def held_out(id_col: str) -> Column:
    """Rows whose labels aren't learned from: a third, by the CRC-32 of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def document_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, x`` for each row, written once."""

    @F.pandas_udf("array<double>")
    def vector(bodies: pd.Series) -> pd.Series:
        return pd.Series([statistics(bytes(b)) for b in bodies])

    return materialize(docs.select(F.col(id_col).alias("id"), vector(F.encode(text_or_empty(text_col), "UTF-8")).alias("x")), "quality-vectors")


def labelled(vectors: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``y, fold, x`` of the rows to learn from. Rows of one id are combined by their vectors before they meet labels."""
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("most"))
    rows = vectors.filter(~held_out("id") & F.col("id").isNotNull()).groupBy("id", "x").agg(F.count(F.lit(1)).alias("times"))
    return rows.join(one.filter("y = most"), "id").select("y", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"), "x", "times")


def _summed(train: DataFrame, function, *keys: str) -> dict[tuple, np.ndarray]:
    """``function(batch)`` gives ``(key, vector)``; the sums of vectors by key, combined in tasks and by Spark."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, v in function(batch):
                held[key] = held[key] + v if key in held else v
        rows = [(*key, i, float(x)) for key, v in held.items() for i, x in enumerate(v)]
        yield pd.DataFrame(rows, columns=[*keys, "i", "v"])

    schema = ", ".join(f"{k} int" for k in (*keys, "i")) + ", v double"
    sums = train.mapInPandas(partial, schema).groupBy(*keys, "i").agg(F.sum("v").alias("v"))
    out: dict[tuple, dict] = {}
    for r in sums.collect():  # a fixed number of rows
        out.setdefault(tuple(r[k] for k in keys), {})[r["i"]] = r["v"]
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def _moment_sums(batch: pd.DataFrame):
    x, w = np.stack(batch["x"]) if len(batch) else np.empty((0, _D)), batch["times"].to_numpy(float)
    y, fold = batch["y"].to_numpy(int), batch["fold"].to_numpy(int)
    for c in (0, 1):
        for f in range(FOLDS):
            m = (y == c) & (fold == f)
            if m.any():
                wx = x[m] * w[m, None]
                yield (c, f), np.concatenate(([w[m].sum()], wx.sum(axis=0), (wx.T @ x[m]).ravel()))


def train_quality_model(vectors: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality"):
    """Fits on all labelled rows that aren't held out."""
    train = materialize(labelled(vectors, labels, id_col, label_col), "quality-train")
    sums = {k: Moments(v[0], v[1 : 1 + _D], v[1 + _D :].reshape(_D, _D)) for k, v in _summed(train, _moment_sums, "y", "fold").items()}
    none = Moments(0.0, np.zeros(_D), np.zeros((_D, _D)))
    by = [[sums.get((c, f), none) for f in range(FOLDS)] for c in (0, 1)]
    classes = [sum(folds, none) for folds in by]
    if min(c.n for c in classes) == 0:
        n0, n1 = (c.n for c in classes)
        return Constant((n1 + 1) / (n0 + n1 + 2))
    left = [[classes[c] - by[c][f] for c in (0, 1)] for f in range(FOLDS)]
    if min(m.n for pair in left for m in pair) < 2 * _D:
        return Discriminant.of(classes, 0.5, 0.5)  # too few rows to choose by
    models = [[Discriminant.of(pair, *how) for how in GRID] for pair in left]

    def losses(batch: pd.DataFrame):
        fold = batch["fold"].to_numpy(int)
        for f in np.unique(fold).tolist():
            m = fold == f
            x, w, sign = np.stack(batch["x"][m]), batch["times"][m].to_numpy(float), 2.0 * batch["y"][m].to_numpy(int) - 1
            margins = np.stack([model.margin(x) * sign for model in models[f]])
            yield (0,), (np.logaddexp(0, -margins[:, None, :] / TEMPERATURES[None, :, None]) * w).sum(axis=2).ravel()

    loss = _summed(train, losses, "all")[(0,)].reshape(len(GRID), len(TEMPERATURES))
    g, t = np.unravel_index(int(loss.argmin()), loss.shape)
    return Discriminant.of(classes, *GRID[g], float(TEMPERATURES[t]))


def score_quality(vectors: DataFrame, model, id_col: str = "doc_id") -> DataFrame:
    """``id, held_out, score, predicted`` for each row of ``vectors``."""
    held = vectors.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(held.value.score(np.stack(x)) if len(x) else [], dtype=float)

    rows = vectors.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), score("x").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    vectors = document_vectors(docs, id_col, text_col)
    return score_quality(vectors, train_quality_model(vectors, labels, id_col, label_col), id_col)
