"""Similarity join of documents on word n-grams with PartEnum signatures.

Two sets whose Jaccard similarity is at least t differ in at most ``n * (1 - t) / t``
elements, n being the size of either. PartEnum turns this into equality of signatures:

* *Size bands* of a factor of three. A set whose partners can be in the next band signs in both,
  so partners always meet in one band.
* *First-level partitions* cut the domain of features in a sixth as many parts as the band's
  largest sets have elements. *Second-level partitions* cut each of them in four.
* *Enumerated subsets*: for each first-level partition, a set has one signature for each two of
  its four second-level partitions (n2 = 4, k2 = 2), over all elements it has in the two. A subset
  that holds fewer than two elements gives none, as single features are shared by chance.
  How many second-level partitions must differ before none of a first-level partition's
  signatures is left follows from its counts (``PLACES``). So a set signs first-level partitions, in
  the same order for all sets, until these numbers add up to more than it may differ in. Of
  two similar sets the one that ends first then has a signature that the other has too.
* *Frequent features* (a boilerplate line, a family of a thousand near copies) stay out of these
  partitions. A set whose other features don't add up signs all its partitions and, besides, once
  more with every feature a first-level partition of its own, rarest last to come: any
  ``n - ceil(t * n) + 1`` of them are enough. Which features count as frequent changes the
  cost, not the result.

Only one row of each set is signed. Signatures travel packed, in blocks for each hash bucket: the 40 bits that tell those of a bucket
apart, and for each set in the block its node's offset and how many signatures it has there. The number of sets that can share one
is bounded by the frequency of the features in it. Signatures of frequent features, at most
``max_frequent`` of them, may be shared by any number of sets; they travel one by one, and their
least member is found by partial aggregation.

*Candidates*: a bucket gives a row for each member but the least of a group that shares a signature, so never more rows than
signatures, however large groups are. Every member meets the least one first. Those pairs
that sizes and bitmaps of the sets don't rule out are verified, best supported first, and
components are formed. Only groups that still span components go on: in groups of up to ``SMALL_GROUP`` members all pairs across
components are tried; larger ones, joined to families where they have one least member,
are compared in cells of bounded size by their bitmaps, and what these don't rule out is verified, the likeliest partners of each
set first. Each round allows more partners, until none is left: no cap, and no link lost.
Verification compares the words of the texts, not hashes.

Null or empty texts have no features and no links. A null id orders after all others; rows
that share an id are separate documents (see ``with_nodes``). A component of rows without ids
has a null one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, skew_join, text_or_empty, with_nodes
from tidemark.llm.components import connected_components, extended_components
from tidemark.llm.hashing import bitmap, folded, mix, shingle_sets

_U = np.uint64
_SALT = 0x9FB21C651E98DF25
_PART = _U(0xD6E8FEB86659FD93)
_HOT = _U(0xA0761D6478BD642F)
_SUB = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
#: Upper size of the first band, and how many times as high each further one is.
SMALL, BAND = 16, 3
#: Second-level partitions of each first-level one; subsets of two of them are enumerated.
PARTS, LEAST = 4, 2
_SUBSETS = list(itertools.combinations(range(PARTS), 2))


def _places(counts: tuple[int, ...]) -> int:
    """The fewest second-level partitions with a change that leave no subset of ``LEAST`` elements as it was."""
    signed = [s for s in _SUBSETS if sum(counts[i] for i in s) >= LEAST]
    return next(k for k in range(PARTS + 1) if any(all(set(s) & set(hit) for s in signed) for hit in itertools.combinations(range(PARTS), k)))


#: By the counts of a first-level partition, each at most ``LEAST``, as digits.
PLACES = np.array([_places(c[::-1]) for c in itertools.product(range(LEAST + 1), repeat=PARTS)])


class Signer:
    """Signatures of sorted feature sets for a similarity of ``num / den``."""

    def __init__(self, num: int, den: int, frequent: np.ndarray):
        self.num, self.den = num, den
        # frequent: features, rarest first
        self.order = np.argsort(frequent)
        self.frequent = frequent[self.order]

    def budget(self, n: np.ndarray) -> np.ndarray:
        """How many elements a set of n may differ in from any partner."""
        return n * (self.den - self.num) // self.num

    def _rank(self, features: np.ndarray) -> np.ndarray:
        """Place among the frequent features, -1 for all others."""
        if not len(self.frequent):
            return np.full(len(features), -1)
        at = np.minimum(np.searchsorted(self.frequent, features), len(self.frequent) - 1)
        return np.where(self.frequent[at] == features, self.order[at], -1)

    def sign(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the set, signature, and whether it is of a frequent feature, for all sets together."""
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, _U)
        owner = np.repeat(np.arange(len(sets)), size)
        rank = self._rank(flat)
        cold = rank < 0
        out_owner, out_sig, out_hot = [], [], []
        short = np.zeros(len(sets), bool)
        level, upper, lower = 0, SMALL, 1
        while len(size) and lower <= size.max() * self.den // self.num:
            here = (size >= lower) & (size < upper) | (size < lower) & (size * self.den >= self.num * lower) & (size > 0)
            if here.any():
                take = here[owner] & cold
                who, sig, missed = self._enumerate(flat[take], owner[take], self.budget(size) + 1, here, level, upper)
                out_owner.append(who)
                out_sig.append(sig)
                out_hot.append(np.zeros(len(who), bool))
                short |= missed
            level, lower, upper = level + 1, upper, upper * BAND
        if short.any():
            take = short[owner]
            f, o, r = flat[take], owner[take], rank[take]
            by = np.lexsort((r, o))  # -1, not frequent, comes first
            f, o, r = f[by], o[by], r[by]
            want = size - -(-self.num * size // self.den) + 1
            start = np.searchsorted(o, np.arange(len(sets)))
            keep = np.arange(len(o)) - start[o] < want[o]
            out_owner.append(o[keep])
            out_sig.append(mix(f[keep] ^ _HOT))
            out_hot.append(r[keep] >= 0)
        if not out_owner:
            return np.empty(0, np.int64), np.empty(0, _U), np.empty(0, bool)
        return np.concatenate(out_owner), np.concatenate(out_sig), np.concatenate(out_hot)

    @staticmethod
    def _enumerate(f: np.ndarray, owner: np.ndarray, want: np.ndarray, here: np.ndarray, level: int, upper: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures of one band: owners, signatures, and which sets have too few partitions."""
        parts = -(-upper // 6)
        sub = (f >> _U(32)) * _U(PARTS * parts) >> _U(32)  # ascending within a set: partitions are ranges of the hashes
        if not len(f):
            return np.empty(0, np.int64), np.empty(0, _U), here.copy()
        start = np.flatnonzero(np.concatenate(([True], (sub[1:] != sub[:-1]) | (owner[1:] != owner[:-1]))))
        part_hash = np.add.reduceat(mix(f), start)  # of the elements in each second-level partition
        elements = np.diff(np.append(start, len(f)))
        sub, who = sub[start].astype(np.int64), owner[start]
        first = sub // PARTS
        new = np.concatenate(([True], (first[1:] != first[:-1]) | (who[1:] != who[:-1])))
        row = np.cumsum(new) - 1
        first, who = first[new], who[new]
        held = np.zeros((len(first), PARTS), _U)
        held[row, sub % PARTS] = part_hash
        count = np.zeros((len(first), PARTS), np.int64)
        count[row, sub % PARTS] = np.minimum(elements, LEAST)
        places = PLACES[count @ (LEAST + 1) ** np.arange(PARTS)]
        total = np.cumsum(places)
        before = np.concatenate(([0], total))[np.searchsorted(who, np.arange(len(want) + 1))]  # places of all sets before
        missed = here & (before[1:] - before[:-1] < want)
        use = total - places - before[who] < want[who]
        first, who, held, count = first[use], who[use], held[use], count[use]
        owners, sigs = [], []
        for k, (i, j) in enumerate(_SUBSETS):
            some = count[:, i] + count[:, j] >= LEAST
            salt = _U((_SALT * (len(_SUBSETS) * level + k + 1)) % 2**64)
            sigs.append(mix(mix(held[some, i] * _SUB[0] + held[some, j] * _SUB[1]) + first[some].astype(_U) * _PART + salt))
            owners.append(who[some])
        return np.concatenate(owners), np.concatenate(sigs), missed


def _filled(df: pd.DataFrame, columns: list[str]) -> pd.DataFrame:
    """With all the columns, those that are missing null."""
    return df.assign(**{c: None for c in columns if c not in df.columns})[columns]


def _two(features: np.ndarray) -> tuple[int, int]:
    """128 bits of a feature set, as two signed longs."""
    with np.errstate(over="ignore"):
        a = mix(features).sum(dtype=_U) + _U(len(features))
        b = mix(features ^ _HOT).sum(dtype=_U)
    return int(a.view(np.int64)), int(b.view(np.int64))


#: Features of a task among which frequent ones are looked for.
FREQUENT_AMONG = 1_000_000


def _release() -> None:
    """Hands back what Arrow holds of earlier batches: workers live on from stage to stage."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def _by_size(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Cuts of a list of texts into stretches of about ``most`` bytes."""
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= most):
            total += len(texts[j])
            j += 1
        yield i, j
        i = j


PROFILE = "node bigint, id string, n bigint, h1 bigint, h2 bigint, bits binary, feature bigint, df bigint"
_PROFILE = [c.split()[0] for c in PROFILE.split(", ")]


def _profiles(size: int, local_df: int, chunk: int):
    """For each row its set size, 128-bit name and bitmap; and the features that occur in ``local_df``
    or more different sets among about ``chunk`` features of a task."""

    def profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        total = 0

        def frequent() -> pd.DataFrame:
            values = np.concatenate(held)
            values.sort()
            start = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            counts = np.diff(np.append(start, len(values)))
            many = counts >= local_df
            return _filled(pd.DataFrame({"feature": values[start[many]].view(np.int64), "df": counts[many]}), _PROFILE)

        for batch in batches:
            rows, texts = [], list(batch["body"])
            for i, j in _by_size(texts, 1 << 19):
                for s in shingle_sets(texts[i:j], size):
                    name = _two(s)
                    rows.append((len(s), *name, bitmap(s, 4)))
                    if len(s) and name not in seen:
                        seen.add(name)
                        held.append(s)
                        total += len(s)
                if total >= chunk:
                    yield frequent()
                    held, seen, total = [], set(), 0
                    _release()
            out = pd.DataFrame(rows, columns=["n", "h1", "h2", "bits"])
            yield _filled(out.assign(node=batch["node"].to_numpy(), id=list(batch["id"])), _PROFILE)
        if held:
            yield frequent()

    return profiles


#: Packed signatures of a bucket. Those of frequent features are in buckets beyond, and stay single rows after it.
BLOCKS = "bucket int, node binary, count binary, sig binary"
_BLOCKS = [c.split()[0] for c in BLOCKS.split(", ")]
#: Bytes of a signature in its block. Two that agree in them and in the bucket are taken as one: a candidate more, never a link.
SIG_BYTES = 5


def _trimmed(x: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned longs."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widened(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(_U)


def _packed(x: np.ndarray) -> bytes:
    """Longs as a width, their least one, and what they exceed it by in so many bytes."""
    above = x.view(_U) - x.min().view(_U)
    width = max(1, -(-int(above.max()).bit_length() // 8))
    return bytes([width]) + int(x.min()).to_bytes(8, "little", signed=True) + _trimmed(above, width)


def _unpacked(raw: bytes) -> np.ndarray:
    return (_widened(raw[9:], raw[0]) + np.frombuffer(raw[1:9], "<u8").astype(_U)).view(np.int64)


def _signatures(size: int, num: int, den: int, frequent, buckets: int, chunk: int):
    """Packed signatures by bucket. A text that a task has met before is signed once."""

    def flush(nodes: list[int], owner: np.ndarray, sig: np.ndarray, hot: np.ndarray) -> Iterator[pd.DataFrame]:
        node = np.array(nodes, np.int64)
        if hot.any():
            yield pd.DataFrame([(buckets + int(node[0] % buckets), node[owner[hot]].tobytes(), b"", sig[hot].tobytes())], columns=_BLOCKS)
        owner, sig = owner[~hot], sig[~hot]
        bucket = (sig % _U(buckets)).astype(np.int32)
        order = np.lexsort((owner, bucket))
        bucket, owner, sig = bucket[order], owner[order], sig[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else []
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            who, count = np.unique(owner[a:b], return_counts=True)
            out.append((int(bucket[a]), _packed(node[who]), _packed(count.astype(np.int64)), _trimmed(sig[a:b] >> _U(64 - 8 * SIG_BYTES), SIG_BYTES)))
            if len(out) == 64:
                yield pd.DataFrame(out, columns=_BLOCKS)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_BLOCKS)

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import blake2b

        signer = Signer(num, den, np.array(frequent.value, _U))
        nodes: list[int] = []
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[bytes] = set()
        total = 0
        for batch in batches:
            fresh_nodes, texts = [], []
            for node, text in zip(batch["node"], batch["body"]):
                digest = blake2b(text.lower(), digest_size=16).digest()
                if digest not in seen:
                    seen.add(digest)
                    fresh_nodes.append(node)
                    texts.append(text)
            if len(seen) > 500_000:
                seen.clear()
            for i, j in _by_size(texts, 1 << 19):
                owner, sig, hot = signer.sign(shingle_sets(texts[i:j], size))
                held.append((owner + len(nodes), sig, hot))
                nodes += fresh_nodes[i:j]
                total += len(sig)
                if total >= chunk:
                    yield from flush(nodes, *[np.concatenate(x) for x in zip(*held)])
                    nodes, held, total = [], [], 0
                    _release()
        if held:
            yield from flush(nodes, *[np.concatenate(x) for x in zip(*held)])

    return signatures


#: Members of a group whose pairs are all candidates where it spans components; larger ones are compared as families.
SMALL_GROUP = 8
#: The least member ``a`` of a group ``g``, another member ``b``, and the number of members; of a frequent feature's group only a member ``b``.
FOUND = "g bigint, a bigint, b bigint, m bigint"


def _candidates(buckets: int):
    """A row for each member but the least of a bucket's groups."""

    def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] >= buckets:
            one, member = np.frombuffer(b"".join(pdf["sig"]), np.int64), np.frombuffer(b"".join(pdf["node"]), np.int64)
            return pd.DataFrame({"g": one, "a": None, "b": member, "m": None})
        _release()
        sig = np.concatenate([_widened(x, SIG_BYTES) for x in pdf["sig"]])
        node = np.concatenate([np.repeat(_unpacked(x), _unpacked(c)) for x, c in zip(pdf["node"], pdf["count"])])
        order = np.argsort(sig)
        s = sig[order]
        again = s[1:] == s[:-1]
        order = order[np.concatenate((again, [False])) | np.concatenate(([False], again))]
        node, sig = node[order], sig[order]
        del s, again
        order = np.lexsort((node, sig))
        s, v = sig[order], node[order]
        fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (v[1:] != v[:-1])))[: len(s)]
        s, v = s[fresh], v[fresh]
        start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))[: len(s)])
        length = np.diff(np.append(start, len(s)))
        others = np.ones(len(s), bool)
        others[start] = False
        least, many = np.repeat(v[start], length), np.repeat(length, length)
        name = (s * _U(buckets) + _U(int(pdf["bucket"].iloc[0]))).view(np.int64)
        return pd.DataFrame({"g": name[others], "a": least[others], "b": v[others], "m": many[others]})

    return candidates


def _possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Drops pairs that sizes or bitmaps rule out: a bit of one set alone is an element the other lacks."""

    @F.pandas_udf("boolean")
    def may(na: pd.Series, nb: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q, v, w in zip(na, nb, x, y):
            v, w = np.frombuffer(v, _U), np.frombuffer(w, _U)
            least = min(len(v), len(w))
            v, w = folded(v[None, :], least)[0], folded(w[None, :], least)[0]
            both = min(p - int(np.bitwise_count(v & ~w).sum()), q - int(np.bitwise_count(w & ~v).sum()))
            out.append(den * both >= num * (p + q - both))
        return pd.Series(out, dtype=bool)

    at = lambda side: sketches.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("bits").alias(f"bits{side}"))
    salted, lookup = _spread(pairs, _among(at("a"), pairs, "a"))
    sized = salted.join(_among(at("b"), pairs, "b"), "b").join(lookup, ["a", "salt"]).filter(num * F.greatest("na", "nb") <= den * F.least("na", "nb"))
    return sized.filter(may("na", "nb", "bitsa", "bitsb")).select(*pairs.columns)


def _among(lookup: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The rows of ``lookup`` for nodes that are this side of a pair: wide rows of others needn't travel."""
    return lookup.join(pairs.select(side).distinct(), side, "left_semi")


#: Pairs of one node in a join's group; the rows of nodes with more are salted.
DEGREE = 512


def _spread(pairs: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds a salt to the pairs of nodes ``a`` that have many, and repeats their rows in ``lookup`` for each salt."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / DEGREE).cast("int").alias("salts")).filter("salts > 1")
    hubs = materialize(hubs, "join-hubs")
    if hubs.isEmpty():
        return pairs.withColumn("salt", F.lit(0)), lookup.withColumn("salt", F.lit(0))
    salted = skew_join(pairs, hubs, ["a"], "salts").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts").cast("bigint")), F.lit(0).cast("bigint"))).drop("salts")
    wide = lookup.join(hubs, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("salts"), F.lit(1)).cast("bigint") - 1))).drop("salts")
    return salted, wide


def _verify(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar enough, word by word."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        names: dict[bytes, int] = {}  # each word's number, so that equal numbers mean equal words
        held: dict[int, set[tuple[int, ...]]] = {}
        room = 200_000

        def shingles(node: int, text: bytes) -> set[tuple[int, ...]]:
            nonlocal room
            if node not in held:
                words = [names.setdefault(w, len(names)) for w in zstandard.decompress(text).lower().split()]
                held[node] = set(zip(*[words[i:] for i in range(size)])) if len(words) >= size else {tuple(words)}
                room -= len(held[node])
            return held[node]

        for batch in batches:
            good = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                if room < 0:  # only between pairs: both sets of one need the same numbers
                    held.clear()
                    names.clear()
                    room = 200_000
                p, q = shingles(a, x), shingles(b, y)
                both = len(p & q)
                good.append(den * both >= num * (len(p) + len(q) - both))
            yield batch.loc[good, ["a", "b"]]

    at = lambda side: texts.select(F.col("node").alias(side), F.col("packed").alias(f"text_{side}"))
    salted, lookup = _spread(pairs.select("a", "b"), _among(at("a"), pairs, "a"))
    joined = salted.join(_among(at("b"), pairs, "b"), "b").join(lookup, ["a", "salt"]).select("a", "b", "text_a", "text_b")
    return joined.mapInPandas(check, "a bigint, b bigint")


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pd.DataFrame({"node": batch["node"], "packed": [packer.compress(t) for t in batch["body"]]})


#: Members of one side of a cell, about.
CELL = 1024


def _across(num: int, den: int, allowance: int):
    """Of cells, in order: pairs between components that bitmaps don't rule out, for each set the ``allowance``
    likeliest; and a row with ``cut`` where there were more. Sets of a cell's largest component are partners only:
    every pair across components has an end outside it, so rows grow with the members and not with their pairs."""

    def compare(node: np.ndarray, comp: np.ndarray, n: np.ndarray, side: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, ...] | None:
        width = np.array([len(b) // 8 for b in bits])
        left, right, miss = [], [], []
        for w in np.unique(width).tolist():
            mine = np.flatnonzero(width == w)
            other = np.flatnonzero((width == w) | (width == 2 * w))
            flat = np.stack([folded(np.frombuffer(bits[i], _U)[None, :], w)[0] for i in other])
            at = {int(i): k for k, i in enumerate(other)}
            for i in mine.tolist():
                ok = np.flatnonzero((comp[other] != comp[i]) & (num * np.maximum(n[other], n[i]) <= den * np.minimum(n[other], n[i])) & ((side[other] != side[i]) | (side[i] == 0)) & ((width[other] != w) | (other > i)))
                if not len(ok):
                    continue
                a, b = flat[at[i]], flat[ok]
                x, y = np.bitwise_count(a & ~b).sum(axis=1).astype(np.int64), np.bitwise_count(~a & b).sum(axis=1).astype(np.int64)
                both = np.minimum(n[i] - x, n[other[ok]] - y)
                may = den * both >= num * (n[i] + n[other[ok]] - both)
                if may.any():
                    left.append(np.full(int(may.sum()), i))
                    right.append(other[ok[may]])
                    miss.append((x + y)[may])
        if not left:
            return None
        left, right, miss = np.concatenate(left), np.concatenate(right), np.concatenate(miss)
        names, sizes = np.unique(comp, return_counts=True)
        left, right, miss = np.concatenate((left, right)), np.concatenate((right, left)), np.concatenate((miss, miss))
        asks = comp[left] != names[sizes.argmax()]
        left, right, miss = left[asks], right[asks], miss[asks]
        by = np.lexsort((node[right], miss, left))
        left, right = left[by], right[by]
        start = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
        keep = np.arange(len(left)) - np.repeat(start, np.diff(np.append(start, len(left)))) < allowance
        a, b = node[left[keep]], node[right[keep]]
        return np.minimum(a, b), np.maximum(a, b), not keep.all()

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush(df: pd.DataFrame) -> pd.DataFrame:
            got = []
            for _, cell in df.groupby(["g", "cell"], sort=False):
                if cell["component"].iloc[0] == cell["component"].iloc[-1] and cell["component"].nunique() == 1:
                    continue
                if (found := compare(cell["node"].to_numpy(), cell["component"].to_numpy(), cell["n"].to_numpy(), cell["side"].to_numpy(), list(cell["bits"]))) is not None:
                    got.append(found)
            a = np.concatenate([x[0] for x in got]) if got else np.empty(0, np.int64)
            b = np.concatenate([x[1] for x in got]) if got else np.empty(0, np.int64)
            out = pd.DataFrame({"a": a, "b": b}).drop_duplicates()
            out["cut"] = False
            if any(x[2] for x in got):
                out = pd.concat([out, pd.DataFrame({"a": [0], "b": [0], "cut": [True]})], ignore_index=True)
            return out

        for batch in batches:
            if not len(batch):
                continue
            last = (batch["g"] == batch["g"].iloc[-1]) & (batch["cell"] == batch["cell"].iloc[-1])
            if last.all() and held and (held[-1]["g"].iloc[-1], held[-1]["cell"].iloc[-1]) == (batch["g"].iloc[0], batch["cell"].iloc[0]):
                held.append(batch)
                continue
            done = pd.concat([*held, batch[~last]], ignore_index=True)
            held = [batch[last]]
            if len(done):
                yield flush(done)
        if held:
            yield flush(pd.concat(held, ignore_index=True))

    return across


def similarity_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    num: int = 3,
    den: int = 4,
    bucket_bytes: int = 4 << 20,
    max_frequent: int = 100_000,
    allowance: int = 4,
) -> DataFrame:
    """``node, id, n_shingles, component_id, kept`` for each row of ``docs``; documents link when the Jaccard
    similarity of their n-gram sets is at least ``num / den``. One node of each component is ``kept``: the one
    with the smallest id. ``bucket_bytes`` of text make a hash bucket; ``max_frequent`` bounds the broadcast
    list of frequent features."""
    spark = docs.sparkSession
    rows, shared = with_nodes(docs, id_col, F.encode(text_or_empty(text_col), "UTF-8"))
    # Ids go through pandas as strings: longs with nulls among them would become floats.
    profile = materialize(rows.withColumn("id", F.col("id").cast("string")).mapInPandas(_profiles(size, 3, FREQUENT_AMONG), PROFILE), "join-profile")
    members = profile.filter("df is null").select("node", F.col("id").cast("bigint").alias("id"), "n", "h1", "h2", "bits")
    hot = profile.filter("df is not null").groupBy("feature").agg(F.sum("df").alias("df")).filter("df >= 6")
    hot = hot.orderBy(F.desc("df"), "feature").limit(max_frequent).orderBy("df", "feature").collect()
    frequent = spark.sparkContext.broadcast(np.array([r["feature"] for r in hot], np.int64).view(_U))

    # One name for each distinct set: the least node that has it.
    filled = members.filter("n > 0")
    names = materialize(filled.groupBy("h1", "h2").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("copies")), "join-names")
    named = skew_join(filled.select("node", "h1", "h2"), names.filter("copies > 1").select("h1", "h2", "rep", "copies"), ["h1", "h2"], "copies")
    copies = materialize(named.filter("node <> rep").select("node", "rep").distinct(), "join-copies")

    buckets = max(16, int((docs.select(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("s")).first()["s"] or 0) // bucket_bytes))
    # One row of each set signs.
    signing = rows.select("node", "body").join(copies.select("node"), "node", "left_anti")
    blocks = signing.mapInPandas(_signatures(size, num, den, frequent, buckets, 300_000), BLOCKS)
    found = materialize(blocks.groupBy("bucket").applyInPandas(_candidates(buckets), FOUND), "join-found")

    ones = found.filter("a is null").select("g", "b").distinct()
    least = ones.groupBy("g").agg(F.min("b").alias("a"), F.count(F.lit(1)).alias("m"))  # at most one row for each frequent feature
    hot_groups = ones.join(F.broadcast(least), "g").filter("a <> b").select("g", "a", "b", "m")
    grouped = found.filter("m > 2").unionByName(materialize(hot_groups, "join-ones"))
    stars = grouped.select("a", "b").unionByName(found.filter("m = 2").select("a", "b"))
    stars = materialize(stars.groupBy("a", "b").agg(F.count(F.lit(1)).alias("support")), "join-stars")
    involved = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    sketches = filled.select("node", "n", "bits").join(involved, "node", "left_semi")
    sketches = materialize(sketches.dropDuplicates(["node"]) if shared else sketches, "join-sketches")
    # Sizes alone rule out many pairs before bitmaps have to meet.
    near = stars
    for side in ("a", "b"):
        near = near.join(sketches.select(F.col("node").alias(side), F.col("n").alias(f"n{side}")), side)
    near = materialize(near.filter(num * F.greatest("na", "nb") <= den * F.least("na", "nb")).select("a", "b", "support"), "join-near")
    pairs = materialize(_possible(near, sketches, num, den), "join-pairs")

    texts = materialize(_texts(pairs, rows), "join-texts")
    # The best supported pair of each node first; then what still joins different components.
    best = materialize(pairs.groupBy("b").agg(F.max_by("a", F.struct("support", -F.col("a"))).alias("a")), "join-best")
    links = materialize(_verify(best, texts, size, num, den), "join-links")
    labels = connected_components(links)
    rest = materialize(_apart(pairs, labels).join(best, ["a", "b"], "left_anti"), "join-rest")
    if not rest.isEmpty():
        labels = extended_components(labels, materialize(_verify(rest, texts, size, num, den), "join-links"))
    tried = pairs.select("a", "b")

    # Small groups that still span components; their pairs with the least member are settled.
    apart = materialize(_apart(stars, labels), "join-apart")
    small = grouped.filter(F.col("m") <= SMALL_GROUP)
    spanning = materialize(small.join(apart, ["a", "b"], "left_semi").select("g").distinct(), "join-groups")
    small = materialize(small.join(spanning, "g", "left_semi").select("g", "b"), "join-grouped")
    two = small.withColumnRenamed("b", "a").join(small, "g").filter("a < b").select("a", "b").distinct()
    two = materialize(_apart(two, labels).join(stars, ["a", "b"], "left_anti"), "join-small")
    if not two.isEmpty():
        two = materialize(_possible(two, sketches, num, den), "join-small")
        labels = extended_components(labels, materialize(_verify(two, materialize(_texts(two, rows), "join-texts"), size, num, den), "join-links"))
        tried = tried.unionByName(two)
    # Larger groups with one least member are one family from here on, so that a member of many groups is one row. ``times`` is
    # how many rows its groups would be: a group of m members has m - 1 rows besides the least one's.
    large = grouped.filter(F.col("m") > SMALL_GROUP)
    families = large.groupBy(F.col("a").alias("family"), F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("times"))
    families = materialize(families.unionByName(large.groupBy(F.col("a").alias("family"), F.col("a").alias("node")).agg(F.round(F.sum(1 / (F.col("m") - 1))).cast("bigint").alias("times"))), "join-families")

    while True:
        placed = lambda df: df.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        at = materialize(placed(families), "join-family-nodes")
        spans = at.groupBy("family").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("times").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("name"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("again")
        ).filter("lo < hi")
        # Families with the same members are one; 128 bits and their number tell different ones apart.
        spans = materialize(spans.groupBy("name", "again", "members").agg(F.min(F.struct("family", "rows")).alias("x")).select("x.*", "members"), "join-spans")
        if spans.isEmpty():
            break
        at = skew_join(at, spans.select("family", "members", F.col("rows").alias("total")), ["family"], "members").filter("members is not null")
        at = materialize(at.drop("times"), "join-spanning")
        # Compared whole where that is fewer rows than its groups have, else group by group.
        as_one = F.col("members") * F.ceil(F.col("members") / CELL) <= F.col("total")
        cells = at.filter(as_one).select(F.col("family").alias("g"), "node", "component", "members")
        hubs = at.filter(~as_one).select("family").distinct()
        if not hubs.isEmpty():
            own = large.join(hubs.withColumnRenamed("family", "a"), "a", "left_semi").select("g", F.col("m").alias("members"), "a", "b")
            own = own.select("g", "members", F.col("b").alias("node")).unionByName(own.select("g", "members", F.col("a").alias("node")).distinct())
            cells = cells.unionByName(placed(own).select("g", "node", "component", "members"))
        cells = cells.withColumn("cuts", F.ceil(F.col("members") / CELL).cast("bigint"))
        block, other = F.pmod(F.xxhash64("node"), F.col("cuts")), F.col("other")
        cells = cells.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cuts") - 1)))
        # A cell is a block against a block, sides 1 and 2, or a block against itself, side 0.
        cells = cells.select("g", "node", "component", (F.least("block", other) * F.col("cuts") + F.greatest("block", other)).alias("cell"), F.when(F.col("block") == other, 0).when(F.col("block") < other, 1).otherwise(2).alias("side"))
        cells = cells.join(sketches, "node").repartition("g", "cell").sortWithinPartitions("g", "cell")
        new = materialize(cells.select("g", "cell", "node", "component", "n", "side", "bits").mapInPandas(_across(num, den, allowance), "a bigint, b bigint, cut boolean"), "join-across")
        more = materialize(new.filter("not cut").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "join-more")
        if not more.isEmpty():
            tried = tried.unionByName(more)
            labels = extended_components(labels, materialize(_verify(more, materialize(_texts(more, rows), "join-texts"), size, num, den), "join-links"))
        if new.filter("cut").isEmpty():
            break  # every pair across components was verified
        families = families.join(spans.select("family"), "family", "left_semi")
        allowance *= 16

    # Each set's component, then each row's.
    sets = names.select("h1", "h2", "copies", "rep").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("h1", "h2", "copies", F.coalesce("component", "rep").alias("component"))
    out = skew_join(members.select("node", "id", "n", "h1", "h2"), sets, ["h1", "h2"], "copies").withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("node")))
    if not shared:
        return out.select("node", "id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("component") == F.col("node")).alias("kept"))
    # Nodes of shared ids aren't ids: the smallest id of each component is looked up.
    out = materialize(out, "join-rows")
    ends = out.groupBy("component").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("first"), F.count(F.lit(1)).alias("members"))
    out = skew_join(out, materialize(ends.select("component", "component_id", F.col("first.node").alias("first"), "members"), "join-ends"), ["component"], "members")
    return out.select("node", "id", F.col("n").alias("n_shingles"), "component_id", (F.col("node") == F.col("first")).alias("kept"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``id, n_shingles, component_id`` for each row, as ``similarity_classes`` finds them."""
    return similarity_classes(docs, id_col, text_col, **how).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _texts(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The packed texts of all nodes in ``pairs``. The join comes first, so that only theirs reach Python."""
    involved = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return rows.select("node", "body").join(involved, "node", "left_semi").mapInPandas(_pack, "node bigint, packed binary")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(labels.select(F.col("id").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return out.filter("ca <> cb").select("a", "b")
