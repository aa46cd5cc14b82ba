"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's features are its byte n-grams (A-Z as a-z), hashed to a fixed number of
buckets. A bucket has a learned vector; a text is the mean of its vectors, and a
linear layer with a softmax gives a probability for each learned language. Both are
trained together by stochastic gradient descent in numpy, on the driver, from a
bounded sample of labelled rows: at most ``rows_a_language`` for each language, of at
most ``sample_bytes`` each, chosen by a hash of the id. To prediction the two
layers are one table of bucket x language, broadcast at a size that doesn't depend on
the data.

*Calibration*: a quarter of the sample is not trained on. A temperature is fitted to
it, so that the score is a probability, and a rejection threshold: the score
under which a share ``reject_rate`` of correctly named texts falls, never above
``reject_ceiling`` times the probability that each language has by chance.

Every text is read whole, in blocks. A null text or one without a letter is ``und``
with score 0 and rejected, and so is every text if no row has a label. Rows with a
null label or id are never trained on. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashing import Roller

_U = np.uint64
_BLOCK = 1 << 18
_SPREAD = _U(0x9E3779B97F4A7C15)
_ROLLER = Roller(41_011, fold=True)
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int
    grams: tuple[int, ...]

    def score(self, text: str) -> tuple[str, float]:
        """The best language and its probability; unknown if there is no letter."""
        if not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for ids in buckets(text.encode("utf-8"), self.bits, self.grams):
            total += self.table[ids].sum(axis=0, dtype=np.float64)
            n += len(ids)
        p = softmax((total / max(n, 1) + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def buckets(text: bytes, bits: int, grams: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text with a blank at both ends, block by block."""
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    reach = max(grams) - 1
    for s in range(0, len(data), _BLOCK):
        prefix = _ROLLER.prefix(data[s : s + _BLOCK + reach])
        for k in grams:
            n = min(len(prefix) - k, _BLOCK)
            if n > 0:
                h = (prefix[k : k + n] - prefix[:n]) * _ROLLER._down[:n]
                yield ((h * _SPREAD) >> _U(64 - bits)).astype(np.int64)


def _features(text: bytes, bits: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = np.unique(np.concatenate(list(buckets(text, bits, grams))), return_counts=True)
    return ids, (counts / counts.sum()).astype(np.float32)


def fit(rows: list[tuple[str, str]], bits: int = 16, grams: tuple[int, ...] = (2, 3, 4), width: int = 16, epochs: int = 4, rate: float = 8.0, seed: int = 5, reject_rate: float = 0.001, reject_ceiling: float = 1.2) -> LanguageModel:
    """Fits on ``(text, language)`` rows; every fourth calibrates."""
    languages = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (1 << bits, width)).astype(np.float32)
    layer, bias = np.zeros((width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    train, held = [], []
    for i, (text, lang) in enumerate(rows):
        y, raw = languages.index(lang), text.encode("utf-8")
        into = held if i % 4 == 3 else train
        into.append((*_features(raw, bits, grams), y))
        # Short texts occur as well: a few pieces of each long one.
        for _ in range(2 if len(raw) > 200 else 0):
            n = int(rng.integers(20, 150))
            at = int(rng.integers(0, len(raw) - n))
            into.append((*_features(raw[at : at + n], bits, grams), y))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(train)):
            ids, weights, y = train[k]
            h = weights @ vectors[ids]
            g = softmax(h @ layer + bias)
            g[y] -= 1
            back = layer @ g
            layer -= 0.05 * step * np.outer(h, g)
            bias -= 0.005 * step * g
            vectors[ids] -= (step * weights)[:, None] * back
    if not languages:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), bias, 1.0, 0.0, bits, grams)
    table = vectors @ layer
    temperature, threshold = 1.0, 0.0
    if held:
        z = np.array([w @ table[ids] + bias for ids, w, _ in held], np.float64)
        y = np.array([h[2] for h in held])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        temperature = min(np.geomspace(0.05, 20, 60), key=loss)
        p = softmax(z / temperature)
        right = p.argmax(axis=1) == y
        if right.any():
            threshold = min(reject_ceiling / len(languages), float(np.quantile(p.max(axis=1)[right], reject_rate)))
    return LanguageModel(languages, table.astype(np.float32), bias.astype(np.float64), float(temperature), threshold, bits, grams)


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: a quarter, by the CRC-32 of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_a_language: int, sample_bytes: int) -> list[tuple[str, str]]:
    """The bounded sample, in the order of a hash of the id."""
    usable = docs.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.octet_length(text_col) <= sample_bytes))
    rows = usable.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("body"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    counts = {r["lang"]: r["n"] for r in docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    # About three times what is needed of each language, then the first by hash.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3 * rows_a_language / n))])
    chosen = rows.filter(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    ranked = chosen.selectExpr("*", "row_number() over (partition by lang order by h, body) as k").filter(F.col("k") <= rows_a_language)
    return [(r["body"], r["lang"]) for r in ranked.orderBy("h", "lang", "body").select("body", "lang").collect()]


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_a_language: int = 300, sample_bytes: int = 20_000) -> LanguageModel:
    return fit(labelled_sample(docs, id_col, text_col, lang_col, rows_a_language, sample_bytes))


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with the predicted language, its probability and whether it is rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = held.value
        got = [m.score(t) if t is not None else (UNKNOWN, 0.0) for t in texts]
        return pd.DataFrame({"lang": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[0] == UNKNOWN or g[1] < m.threshold for g in got]})

    rows = docs.withColumn("__language", predict(F.col(text_col).cast("string")))
    fields = [F.col(f"__language.{f}").alias(name) for f, name in zip(("lang", "score", "rejected"), out)]
    return rows.select(*[c for c in docs.columns if c not in out], *fields)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score, rejected`` for each row."""
    model = train_language_model(docs, id_col, text_col, lang_col)
    return predict_language(docs.select(id_col, held_out(id_col).alias("held_out"), text_col), model, text_col).drop(text_col)
