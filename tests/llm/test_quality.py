import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm import queries as Q

BIG = "/root/testdata/sf0.01"


def ratio(part, whole):
    return math.log((part + 0.5) / (whole - part + 0.5))


def plain_statistics(text):
    """The statistics once more, word by word."""
    raw = text.encode()
    words = [w for w in raw.replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\t", b" ").replace(b"\r", b" ").replace(b"\n", b" ").split(b" ") if w]
    low, n = [w.lower() for w in words], len(words)
    sizes, flat = [len(w) for w in words], b"".join(words)
    symbols, points = b"!#$%&*+/<=>@\\^_`{|}~", b".,;:?'\"()-[]"
    count = lambda test: sum(1 for b in raw if test(b))
    upper, letters = count(lambda b: 65 <= b <= 90), count(lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
    digits, syms, pts = count(lambda b: 48 <= b <= 57), count(lambda b: b in symbols), count(lambda b: b in points)
    mean = sum(sizes) / n if n else 0
    spread = math.sqrt(sum((s - mean) ** 2 for s in sizes) / n) if n else 0
    return [
        math.log1p(n), math.log((len(flat) + 1) / (n + 1)), math.log1p(spread),
        ratio(upper, letters), ratio(digits, len(flat)), ratio(syms, len(flat)), ratio(pts, len(flat)),
        ratio(sum(w[-1] in symbols for w in words), n), ratio(sum(a == b for a, b in zip(low, low[1:])), max(n - 1, 0)),
        ratio(len(set(low)), n), ratio(len(set(zip(low, low[1:]))), max(n - 1, 0)), ratio(max(Counter(low).values(), default=0), n),
        math.log((raw.count(b"\n") + 1) / (n + 1)), ratio(max(len(flat) - letters - syms - pts - digits, 0), len(flat)),
    ]


@pytest.mark.parametrize("text", ["", " \n", "one", "One one TWO two! a|b 12,5 é\x01 x", "A" * 900, "the the the the", "word, piece\n" * 3000])
def test_statistics_equal_plain_ones(text):
    assert np.allclose(quality.statistics(text.encode()), plain_statistics(text), atol=1e-9)


def density(x, mean, cov):
    d = x - mean
    return -0.5 * (d @ np.linalg.inv(cov) @ d + math.log(np.linalg.det(cov)))


def test_scores_are_those_of_two_normal_densities():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + k for k in (0, 2)]
    m = quality.Discriminant.of([quality.Moments(len(r), r.sum(axis=0), r.T @ r) for r in x], 0.3, 0.1, temperature=2.0)
    covs = [np.cov(r.T, bias=True) for r in x]
    pooled = (covs[0] + covs[1]) / 2
    used = []
    for c in covs:
        s = 0.7 * c + 0.3 * pooled
        used.append(0.9 * s + 0.1 * np.diag(np.diag(s)) + np.diag(1e-3 * np.diag(pooled) + 1e-6))
    for p in np.concatenate(x)[::60]:
        margin = density(p, x[1].mean(axis=0), used[1]) - density(p, x[0].mean(axis=0), used[0])
        assert m.margin(p[None])[0] == pytest.approx(margin, abs=1e-6)
        assert m.score(p[None])[0] == pytest.approx(1 / (1 + math.exp(-margin / 2)), abs=1e-6)


def test_held_out_accuracy(spark):
    got = Q.op13_quality(spark, BIG).cache()
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1").isEmpty()
    rows = got.join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97
    assert sum(r["predicted"] for r in held if r["quality"] == 1) / sum(r["quality"] for r in held) > 0.97


def test_moments_and_folds_are_sums_over_all_labelled_rows(spark):
    """What Spark sums equals the same sums made of the rows one by one."""
    vectors = quality.document_vectors(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    train = quality.labelled(vectors, labels, "doc_id", "quality")
    sums = quality._summed(train, quality._moment_sums, "y", "fold")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    for y in (0, 1):
        x = np.array([plain_statistics(texts[i]) for i, q in known.items() if q == y])
        got = sum(v for k, v in sums.items() if k[0] == y)
        assert got[0] == len(x) and np.allclose(got[1 : 1 + x.shape[1]], x.sum(axis=0)) and np.allclose(got[1 + x.shape[1] :], (x.T @ x).ravel())


def test_odd_rows_and_labels(spark):
    good, bad = "a plain line of some words, then more of them.", "BUY!! BUY!! BUY!! | $$$ | $$$ BUY!!"
    rows = [(i, good + f" Part {i}." * (i % 5) if i % 2 else bad * (1 + i % 4), 1.0) for i in range(120)] + [(None, None, 1.0), (7, "", 2.0), (7, "", 2.0), (9, good, 0.0), (500, "x" * 300_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score double").withColumn("x", F.lit("clash")).withColumn("id", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, "y") for i in range(120)] + [(3, 0, "y"), (None, 1, "y"), (5, None, "y"), (11, 7, "y"), (500, None, None)], "doc_id bigint, quality int, fold string")
    got = quality.classify_quality(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in got if (r["doc_id"] or 500) < 120) > 110
    empty = labels.limit(0)
    assert {r["score"] for r in quality.classify_quality(df, empty).collect()} == {0.5}
    one = quality.classify_quality(df, labels.filter("quality = 1"), label_col="quality").collect()
    assert len({r["score"] for r in one}) == 1 and one[0]["score"] > 0.9 and one[0]["predicted"] == 1
    assert quality.classify_quality(df.limit(0), labels).count() == 0
