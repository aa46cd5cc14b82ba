import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm.components import connected_components, extended_components
from tidemark.llm.decontaminate import ItemIndex, decontaminate, find_leaks
from tidemark.llm.hashing import bitmap, folded, shingle_set, shingle_sets, word_hashes
from tidemark.llm.jaccard_join import Signer, ngram_jaccard_join, similarity_classes
from tidemark.llm.suffix_dedup import remove_repeats

DOCS = "doc_id bigint, text string"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute_components(rows):
    sets = {i: set(shingles(t)) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join_equals_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(2000)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    base, hot, chain, texts = some(150), some(40), some(90), []
    for _ in range(150):  # a family of near copies
        w = list(base)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        texts.append(w)
    texts += [hot + some(rnd.randrange(40)) for _ in range(150)]  # a passage that many hold
    for _ in range(50):  # each like the one before it only
        chain = list(chain)
        chain[rnd.randrange(len(chain))] = rnd.choice(vocabulary)
        chain = chain[rnd.randrange(2) :] + some(1)
        texts.append(chain)
    rows = list(enumerate([" ".join(w) for w in texts] + [None, "", "  ", "a b", "A  b", "a b c", "a b c d e", "a b c d E", " ".join(some(5000))]))
    df = spark.createDataFrame(rows, DOCS).repartition(7).selectExpr("*", "1 as id", "2 as n")
    got = ngram_jaccard_join(df, bucket_bytes=20_000, allowance=1)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows)


def test_jaccard_join_equals_brute_force_on_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(df).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in df.collect()])


def test_jaccard_join_on_nothing_null_and_shared_ids(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], DOCS)).count() == 0
    text, other = "a b c d e f", "p q r s t u"
    got = ngram_jaccard_join(spark.createDataFrame([(None, text), (4, text), (4, text), (4, other), (9, other), (None, "x y"), (None, None)], DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (0, 4), (4, 4), (4, 4), (4, 4), (9, 4)]
    kept = similarity_classes(spark.createDataFrame([(None, text), (4, text), (4, other), (5, other), (2**60 + 1, "x")], DOCS)).filter("kept").collect()
    assert sorted(r["id"] for r in kept) == [4, 4, 2**60 + 1] and len({r["node"] for r in kept}) == 3


def test_words_that_polynomials_confuse_do_not_link(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    pairs = [thue, thue.translate(str.maketrans("ab", "ba")), thue[:200], thue[:200].translate(str.maketrans("ab", "ba"))]
    got = ngram_jaccard_join(spark.createDataFrame(list(enumerate(pairs)), DOCS)).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)


def test_word_hashes_follow_the_words():
    rnd = random.Random(4)
    seen = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 20))) for _ in range(3000)] + [b"z" * n for n in (7, 8, 9, 16, 255, 256, 257, 5000)]
    got = word_hashes(b" ".join(seen) + b"\t")
    assert len(got) == len(seen) and len(set(got.tolist())) == len(set(seen))
    assert len({(w, h) for w, h in zip(seen, got.tolist())}) == len(set(seen))
    assert np.array_equal(word_hashes(b"One TWO"), word_hashes(b"one\x0btwo ")) and not len(word_hashes(b" \n"))


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    frequent = rng.integers(0, 2**63, 300, dtype=np.uint64) * np.uint64(2)
    signer = Signer(3, 4, frequent)
    for n in [1, 2, 3, 4, 5, 8, 15, 16, 20, 63, 64, 200, 255, 256, 700, 1023, 1024, 1100, 3000]:
        for _ in range(40):
            common = rng.choice(frequent, min(n, int(rng.integers(0, 300))), replace=False) if rng.random() < 0.5 else np.empty(0, np.uint64)
            a = np.unique(np.concatenate((rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2), common)))
            b = rng.choice(a, len(a) - int(rng.integers(0, max(1, len(a) // 4 + 1))), replace=False)
            b = np.unique(np.concatenate((b, rng.integers(0, 2**63, int(rng.integers(0, max(1, len(a) // 8 + 1))), dtype=np.uint64) * np.uint64(2))))
            both = len(np.intersect1d(a, b))
            if len(b) and 4 * both >= 3 * (len(a) + len(b) - both):
                owner, sig, _ = signer.sign([a, np.empty(0, np.uint64), b])
                assert len(np.intersect1d(sig[owner == 0], sig[owner == 2])) and not (owner == 1).any()


def test_batched_shingles_and_bitmaps():
    rnd = random.Random(2)
    texts = ["", " ", "One", "one two", "a b c d e f A"] + [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(30))) + rnd.choice(["", " ", "\n"]) for _ in range(200)]
    raw = [t.encode() for t in texts]
    for t, one, many in zip(texts, map(shingle_set, raw), shingle_sets(raw)):
        assert np.array_equal(one, many) and len(one) == len(set(shingles(t)))
    a, b = shingle_set(b"a b c d e f g h i j"), shingle_set(" ".join(f"v{i}" for i in range(90)).encode() + b" a b c d e f")
    x, y = (np.frombuffer(bitmap(s), np.uint64)[None, :] for s in (a, b))
    y = folded(y, x.shape[1])
    assert np.bitwise_count(x & ~y).sum() <= len(np.setdiff1d(a, b)) and np.bitwise_count(y & ~x).sum() <= len(np.setdiff1d(b, a))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, **{i: 200 for i in range(200, 230)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def least_reachable(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def test_components_hold_every_node(spark):
    # 4 takes 1 as its parent; 2 has no smaller neighbour and nobody took it.
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame([(1, 4), (4, 1), (2, 4)], "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 4: 1}


def test_components_grow_with_more_edges(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    first, more = edges[:50], edges[50:]
    table = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint")
    whole = least_reachable(edges)
    assert {r["id"]: r["component"] for r in connected_components(table(edges)).collect()} == whole
    labels = connected_components(table(first))
    got = {r["id"]: r["component"] for r in extended_components(labels, table(more)).collect()}
    assert got == whole
    assert {r["id"]: r["component"] for r in extended_components(connected_components(table([])), table(edges)).collect()} == whole
    assert extended_components(labels, table([])).count() == labels.count()


def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(1 for j in range(len(raw)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("length", "seed"), [(100, 32), (40, 16), (16, 16)])
def test_repeats_equal_brute_force(spark, length, seed):
    rnd = random.Random(3)
    vocabulary = ["the", "alpha", "of", "beta", "x" * 30, "y", "ab" * 40, "é"]
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(60)) for _ in range(5)]
    piece = lambda: rnd.choice([rnd.choice(passages)[rnd.randrange(50) : rnd.randrange(60, 300)], "".join(rnd.choice("abcdefgh ") for _ in range(120)), "a" * rnd.randrange(300), "ab" * rnd.randrange(200)])
    rows = [(3 * i, " ".join(piece() for _ in range(rnd.randrange(5)))) for i in range(120)]
    rows += [(1, None), (2, ""), (4, rows[5][1]), (5, rows[5][1]), (7, "z" * 300_000)]
    df = spark.createDataFrame(rows, DOCS).repartition(5).selectExpr("*", "1 as id", "2 as lo", "3 as body")
    got = remove_repeats(df, length=length, seed=seed, bucket_bytes=5_000).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows, length)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_repeats_in_rows_with_one_id(spark):
    text = "q" * 5 + "".join(chr(97 + i % 26) + str(i) for i in range(80))
    got = remove_repeats(spark.createDataFrame([(1, text), (1, text), (None, text)], DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, len(text)), (1, len(text))]
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_in_different_texts_with_one_id(spark):
    rnd = random.Random(5)
    some = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared, alone = some(250), [some(300 + 40 * i) for i in range(4)]
    rows = [(7, alone[0] + shared), (7, shared + alone[1]), (None, alone[2]), (None, shared), (3, alone[3] + shared), (9, ""), (9, None), (8, alone[1])]
    got = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    # The null ids come first, and of them only one holds the shared passage; the second text of 7 stands before 8.
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == sorted(
        [(-1, len(alone[2]), 0), (-1, 250, 0), (3, len(alone[3]) + 250, 250), (7, len(alone[0]) + 250, 250), (7, 250 + len(alone[1]), 250), (8, len(alone[1]), len(alone[1])), (9, 0, 0), (9, 0, 0)]
    )
    twice = remove_repeats(spark.createDataFrame([(5, shared)] * 3, DOCS)).collect()
    assert sorted(r["n_removed"] for r in twice) == [0, 250, 250]


def brute_leaks(text, items):
    from collections import Counter

    s, out = shingles(text), {}
    for item, body in items:
        c = Counter(shingles(body))
        span = sum(c.values())
        best = None
        for a in range(max(len(s) - span, 0) + 1) if c and s else ():
            d = Counter(s[a : a + span])
            low = sum(min(v, d[k]) for k, v in c.items())
            high = span + sum(d.values()) - low
            if 4 * low >= 3 * high and (best is None or low / high > best[0]):
                best = (low / high, a)
        if best:
            out[item] = best
    return out


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 60)))) for i in range(30)] + [(30, None), (31, "")]
    rows = []
    for i in range(150):
        w = words(rnd.choice(items[:30])[1])
        for _ in range(rnd.randrange(4)):
            k, kind = rnd.randrange(len(w)), rnd.random()
            if kind < 0.5:
                w[k] = rnd.choice(vocabulary).upper()
            elif kind < 0.8:
                w.insert(k, rnd.choice(vocabulary))
            elif len(w) > 6:
                del w[k]
        rows.append((i, " ".join([rnd.choice(vocabulary) for _ in range(rnd.randrange(30))] + w + [rnd.choice(vocabulary) for _ in range(rnd.randrange(30))])))
    rows += [(900, None), (901, ""), (902, "w1 w2")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' as similarity")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    expected = {(i, item): v for i, t in rows for item, v in brute_leaks(t, [x for x in items if x[1]]).items()}
    for chunk in (8 << 20, 1_000):
        got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in find_leaks(docs, bench, chunk_bytes=chunk).collect()}
        assert got == expected
    clean = {r["doc_id"] for r in decontaminate(docs, bench).collect()}
    assert clean == {i for i, _ in rows} - {i for i, _ in expected}
    assert find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate(docs.limit(0), bench).count() == 0


def test_multi_index_finds_all_in_the_radius():
    rng = np.random.default_rng(3)
    index = ItemIndex([(i, " ".join(f"v{rng.integers(10**9)}" for _ in range(20))) for i in range(200)], radius=20)
    for _ in range(50):
        item = int(rng.integers(200))
        bits = np.unpackbits(index.prints[item])
        flip = rng.choice(128, int(rng.integers(0, 26)), replace=False)
        bits[flip] ^= 1
        found = {i for _, i in index.lookup(np.packbits(bits)[None, :])}
        assert (item in found) == (len(flip) <= 20)


def test_families_beyond_a_cell_are_compared_whole_or_by_group(spark, monkeypatch):
    """Cells of a few members: families are cut in blocks, and hubs go back to their groups."""
    from tidemark.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "CELL", 4)
    rnd = random.Random(3)
    vocabulary = [f"v{i}" for i in range(900)]
    base, rows = [rnd.choice(vocabulary) for _ in range(120)], []
    for i in range(70):  # near copies around the threshold
        w = list(base)
        for _ in range(rnd.randrange(14)):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:30] + [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 60))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for allowance in (1, 64):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_join(df, bucket_bytes=20_000, allowance=allowance).collect()}
        assert got == brute_components(rows)


def test_rows_of_a_family_grow_with_its_members():
    """Neither cells nor buckets give a row for each pair of a family's members, and all its links stay within reach."""
    import pandas as pd

    from tidemark.llm import jaccard_join

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2)
    family = [np.unique(np.concatenate((base[rng.permutation(200)[:196]], rng.integers(0, 2**63, 3, dtype=np.uint64)))) for _ in range(120)]
    cell = pd.DataFrame({"g": 1, "cell": 0, "node": range(120), "component": range(120), "n": [len(s) for s in family], "side": 0, "bits": [bitmap(s) for s in family]})
    found = pd.concat(jaccard_join._across(3, 4, 4)(iter([cell])))
    pairs = found[~found["cut"]]
    assert found["cut"].any() and len(pairs) <= 4 * 120 and set(pairs["a"]) | set(pairs["b"]) >= set(range(1, 120))
    whole = pd.concat(jaccard_join._across(3, 4, 1000)(iter([cell])))
    assert not whole["cut"].any() and len(whole) == 120 * 119 // 2
    # Of each group that shares a signature: a row for every member but the least, in however many buckets.
    texts = [" ".join(f"w{i}" for i in range(k, 300)).encode() for k in range(20)]
    frequent = type("Held", (), {"value": np.empty(0, np.int64)})
    owner, sig, _ = Signer(3, 4, np.empty(0, np.uint64)).sign(shingle_sets(texts))
    count = np.unique(np.unique(np.stack((sig, owner.astype(np.uint64))), axis=1)[0], return_counts=True)[1]
    rows = [(5 - 2**62 + 7 * k, t) for k, t in enumerate(texts)]
    for buckets in (16, 500):
        blocks = pd.concat(jaccard_join._signatures(5, 3, 4, frequent, buckets, 300_000)(iter([pd.DataFrame(rows, columns=["node", "body"])])))
        made = pd.concat([jaccard_join._candidates(buckets)(b) for _, b in blocks.groupby("bucket")])
        assert len(made) == (count - 1).sum() and sorted(made["m"]) == sorted(np.repeat(count, count - 1))
        assert made["g"].nunique() == (count > 1).sum() and set(made["b"]) <= {r[0] for r in rows} and (made["a"] < made["b"]).all()
