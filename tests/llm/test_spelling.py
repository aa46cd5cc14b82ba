import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries as Q
from tidemark.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows, divisor=199, least=6, enough=5):
    counts = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % divisor else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= enough}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_near(words):
    """By deletion neighbourhoods: two words one edit apart share a word with one character deleted, or one is it."""
    by, near = {}, {w: set() for w in words}
    for w in words:
        for key in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by.setdefault(key, set()).add(w)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    return near


def brute(rows, divisor=199, least=6, enough=5):
    words = brute_words(rows, divisor, least, enough)
    near, form = brute_near(words), {}
    for w, others in near.items():
        top = min(((-words[o], o) for o in others), default=None)
        form[w] = top[1] if top and -top[0] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def rows_of(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in df.collect())


def test_query_equals_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = brute(docs)
    assert rows_of(Q.op11_spelling(spark, sf)) == expected
    assert len(expected) > 500 and sum(1 for r in expected if r[1]) > 10


@pytest.mark.parametrize("pairs_a_key", [0, 3, 256])
def test_pairs_of_short_and_dense_words(spark, pairs_a_key):
    """Words over two or three letters share every segment; insertions into runs of one letter can be seen in many places."""
    rnd = random.Random(4)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 7))) for _ in range(140)} | {"".join(rnd.choice("xyé") for _ in range(rnd.randint(2, 5))) for _ in range(80)}
    words |= {"a" * k for k in range(1, 12)} | {"abcdefghij" * 3, "abcdefghij" * 3 + "k", "bcdefghij" + "abcdefghij" * 2, "abcdefghijXbcdefghijabcdefghij", "z"}
    got = {(r["a"], r["b"]) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), pairs_a_key).collect()}
    assert got == {(a, b) for a, near in brute_near(words).items() for b in near if a < b}


def test_hot_segments_are_cut_again(spark):
    """Of 3,000 words that share their first half, candidates stay in proportion to the words."""
    rnd = random.Random(8)
    words = sorted({"common" + "".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(3000)})
    got = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), 64)
    assert {(r["a"], r["b"]) for r in got.collect()} == {(a, b) for a, near in brute_near(words).items() for b in near if a < b}


def test_counts_corruption_and_odd_rows(spark):
    text = "Naïve NAÏVES, naïves×naïves ÷÷÷÷÷÷÷ l'école_écoles écoles écoles"
    rows = [(i, f"{text} word{'s' * (i % 3)} letters lettersz LETTERS" * 3, "x") for i in range(30)]
    rows += [(None, "letters lettres " * 6, "y"), (None, None, "y"), (5, "", "z"), (5, "letters", "z"), (5, "letters", "z"), (77, "q" * 30_000 + " " + "q" * 30_000, "z")] + [(i, "q" * 30_000, "z") for i in (78, 79, 80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, word string").withColumn("n", F.lit("clash")).withColumn("form", F.lit(0))
    for divisor in (2, 199):
        expected = brute([(i, t) for i, t, _ in rows], divisor)
        assert rows_of(spelling.spelling_groups(df, change=spelling.corrupt(divisor))) == expected
        counted = spelling.word_counts(df, change=spelling.corrupt(divisor), room=3)
        assert {r["word"]: r["n"] for r in counted.collect()} == {r[0]: r[3] for r in expected}
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def test_pieces_cut_no_word(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    for text in ("", "abc defg hij, klmnopqrstuv w", "a" * 30, " " * 30, "ab " * 9):
        pieces = list(spelling._pieces(text))
        assert "".join(pieces) == text and [w for p in pieces for w in RUN.findall(p)] == RUN.findall(text)
        assert len(pieces) > 1 or len(text) <= 7 or text == "a" * 30


def test_roots_follow_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w4"), ("y", "z")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{f"w{i}": "w9" for i in range(9)}, "x": "w9", "y": "z"}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0
