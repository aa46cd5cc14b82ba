"""Personal data: fixed patterns, and a skip-chain conditional random field on top.

*Base spans* come from four patterns (e-mail, IP address, card, phone number) with
their checks. They are found in time linear in the text and always stay.

*The field* labels the tokens that have a digit or an at sign, and those without that
are alike to a base span of the document: outside, or one of the four kinds. Its factors are the token's shape, the labels of neighbouring tokens, and
skip factors: tokens of a document that repeat each other or are alike (equal when
case and punctuation are dropped, or the name part of an address) are tied to a hub
that prefers one label for all of them, however far apart they stand. Each token has
one factor to each of its hubs, so a token that occurs n times costs n factors, not n
squared. Tokens within base spans are observed; loopy message passing carries their
labels along chain and hubs to mentions that no pattern matches: a phone number
without its prefix, an address cut short. Tokens outside base spans whose belief in
one kind reaches ``least_belief`` become added spans.

Weights are trained here, by stochastic gradient descent on the pseudo-likelihood
of the base labels in a bounded sample of different documents (``sample_rows`` of at most
``sample_bytes`` each, by a hash of id and text); shape weights never see whether a
pattern matched.

Texts are searched without a shuffle; the broadcast weights have a fixed size. Null text counts as
empty: no spans. Texts are read whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
OUTSIDE = 0
_ANY = re.compile("[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile("[0-9]+")
_CARD = re.compile("[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, end, kind


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    # A chain of dotted numbers holds a match for each four of its parts.
    for chain in _DOTTED.finditer(text):
        if chain[0].count(".") >= 3:
            parts = [p.span() for p in _PART.finditer(text, *chain.span())]
            for i in range(0, len(parts) - 3, 4):
                if all(_at_most_255(text[a:b]) for a, b in parts[i : i + 4]):
                    yield parts[i][0], parts[i + 3][1]


def _at_most_255(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and int(digits) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(a, b, 1) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


_TRIM = re.compile(r"[^\w+(]*(.*?)[^\w)]*\Z", re.S)
#: Longer tokens (encoded data, say) are no mention of a person; they stay outside.
LONGEST_TOKEN = 80


def tokens(text: str) -> list[tuple[int, int]]:
    """Tokens with a digit or an at sign, without the punctuation around them."""
    out = []
    hits = _ANY.finditer(text)
    end = -1
    for hit in hits:
        if hit.start() < end:
            continue
        a = hit.start()
        while a > 0 and not text[a - 1].isspace() and hit.start() - a <= LONGEST_TOKEN:
            a -= 1
        b = hit.end()
        while b < len(text) and not text[b].isspace() and b - a <= 4 * LONGEST_TOKEN:
            b += 1
        end = b
        if b - a <= LONGEST_TOKEN:
            m = _TRIM.match(text[a:b])
            i, j = a + m.start(1), a + m.end(1)
            if j > i:
                out.append((i, j))
    return out


_WORD = re.compile(r"\S+")


def alike_words(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Tokens without digit or at sign whose letters are a hub key of a base span: an address's name part, say."""
    keys = {key for a, b, _ in base for key in hub_keys(text[a:b]) if not _DIGIT.search(key)}
    out = []
    for word in _WORD.finditer(text) if keys else ():
        if word.end() - word.start() <= LONGEST_TOKEN and not _ANY.search(word[0]) and "".join(c for c in word[0].lower() if c.isalnum()) in keys:
            m = _TRIM.match(word[0])
            if m.end(1) > m.start(1):
                out.append((word.start() + m.start(1), word.start() + m.end(1)))
    return out


#: Hashed shape features for each token.
N_FEATURES = 512


def shape_features(token: str) -> list[int]:
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]+", "0", token))[:12]
    lengths = ".".join(str(min(len(x), 6)) for x in re.findall("[0-9]+", token)[:5])
    names = ["bias", f"shape {shape}", f"digits {min(digits, 20)}", f"letters {min(letters, 3)}", f"at {'@' in token}", f"plus {token[:1] == '+'}", f"dots {min(token.count('.'), 4)}", f"runs {lengths}"]
    return [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=4).digest(), "big") % N_FEATURES for n in names]


def hub_keys(token: str) -> list[str]:
    """What a token is alike by: its letters and digits, and the name part of an address."""
    plain = "".join(c for c in token.lower() if c.isalnum())
    keys = [plain] if len(plain) >= 4 else []
    if "@" in token:
        name = "".join(c for c in token.lower().split("@")[0] if c.isalnum())
        if len(name) >= 4:
            keys.append(name)
    return keys


@dataclass
class Document:
    spans: list[tuple[int, int]]
    features: list[list[int]]
    observed: np.ndarray  # label, or -1
    adjacent: np.ndarray  # whether the next token follows directly
    hubs: np.ndarray  # rows (token, hub)
    n_hubs: int


def document(text: str, base: list[Span]) -> Document:
    spans = sorted(tokens(text) + alike_words(text, base))
    observed = np.full(len(spans), -1)
    k = 0
    for i, (a, b) in enumerate(spans):
        while k < len(base) and base[k][1] <= a:
            k += 1
        for start, end, kind in base[k:]:
            if start >= b:
                break
            if end > a:
                observed[i] = kind + 1
    adjacent = np.array([text[spans[i][1] : spans[i + 1][0]].strip(" .,;:()") == "" and spans[i + 1][0] - spans[i][1] <= 4 for i in range(len(spans) - 1)], bool)
    keys: dict[str, list[int]] = {}
    for i, (a, b) in enumerate(spans):
        for key in hub_keys(text[a:b]):
            keys.setdefault(key, []).append(i)
    shared = [v for v in keys.values() if len(v) > 1]
    hubs = np.array([(i, h) for h, v in enumerate(shared) for i in v], int).reshape(-1, 2)
    return Document(spans, [shape_features(text[a:b]) for a, b in spans], observed, adjacent, hubs, len(shared))


@dataclass
class SkipChainModel:
    shape: np.ndarray  # feature x label
    chain: np.ndarray  # label x label
    skip: float
    least_belief: float = 0.9
    rounds: int = 12

    def beliefs(self, doc: Document) -> np.ndarray:
        """Approximate marginals by loopy message passing in logarithms."""
        n, labels = len(doc.spans), len(KINDS) + 1
        own = np.array([self.shape[f].sum(axis=0) for f in doc.features]).reshape(n, labels)
        seen = doc.observed >= 0
        own[seen] = -30.0
        own[np.flatnonzero(seen), doc.observed[seen]] = 0.0
        right, left = np.zeros((max(n - 1, 0), labels)), np.zeros((max(n - 1, 0), labels))
        token, hub = doc.hubs[:, 0], doc.hubs[:, 1]
        to_hub, to_token = np.zeros((len(token), labels)), np.zeros((len(token), labels))
        agree = self.skip * np.eye(labels)

        def total() -> np.ndarray:
            b = own.copy()
            if n > 1:
                b[1:] += right
                b[:-1] += left
            np.add.at(b, token, to_token)
            return b

        for _ in range(self.rounds):
            b = total()
            if n > 1:
                on = doc.adjacent[:, None]
                new_right = np.where(on, _through(b[:-1] - left, self.chain), 0)
                new_left = np.where(on, _through(b[1:] - right, self.chain.T), 0)
            if len(token):
                to_hub = _through(b[token] - to_token, agree)
                held = np.zeros((doc.n_hubs, labels))
                np.add.at(held, hub, to_hub)
                to_token = 0.5 * to_token + 0.5 * _through(held[hub] - to_hub, agree)
            if n > 1:
                right, left = new_right, new_left
        b = total()
        b = np.exp(b - b.max(axis=1, keepdims=True))
        return b / b.sum(axis=1, keepdims=True)

    def added_spans(self, text: str, base: list[Span]) -> list[Span]:
        doc = document(text, base)
        if not len(doc.spans) or (doc.observed >= 0).all():
            return []
        belief = self.beliefs(doc)
        out: list[Span] = []
        for i in np.flatnonzero((doc.observed < 0) & (belief.argmax(axis=1) > 0) & (belief.max(axis=1) >= self.least_belief)):
            (a, b), kind = doc.spans[i], int(belief[i].argmax()) - 1
            if out and out[-1][2] == kind and i and doc.adjacent[i - 1] and out[-1][1] == doc.spans[i - 1][1]:
                out[-1] = (out[-1][0], b, kind)
            else:
                out.append((a, b, kind))
        return out


def _through(message: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Sums a message's labels out through a factor; normalised."""
    x = message[:, :, None] + factor[None, :, :]
    top = x.max(axis=1)
    out = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
    return out - out.max(axis=1, keepdims=True)


def fit(texts: list[str], epochs: int = 5, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> SkipChainModel:
    """Pseudo-likelihood: each token's label given its shape and its neighbours' labels."""
    labels = len(KINDS) + 1
    shape, chain, skip = np.zeros((N_FEATURES, labels)), np.zeros((labels, labels)), 1.0
    docs = [d for t in texts if len((d := document(t, base_spans(t))).spans)]
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for k in rng.permutation(len(docs)):
            doc = docs[k]
            y = np.maximum(doc.observed, 0)
            votes = np.zeros((len(y), labels))
            if len(doc.hubs):
                counts = np.zeros((doc.n_hubs, labels))
                np.add.at(counts, (doc.hubs[:, 1], y[doc.hubs[:, 0]]), 1)
                np.add.at(votes, doc.hubs[:, 0], counts[doc.hubs[:, 1]])
                np.add.at(votes, (doc.hubs[:, 0], y[doc.hubs[:, 0]]), -1)
                votes /= np.maximum(votes.sum(axis=1, keepdims=True), 1)
            for i in range(len(y)):
                z = shape[doc.features[i]].sum(axis=0) + skip * votes[i]
                before = i > 0 and doc.adjacent[i - 1]
                after = i + 1 < len(y) and doc.adjacent[i]
                if before:
                    z = z + chain[y[i - 1]]
                if after:
                    z = z + chain[:, y[i + 1]]
                g = np.exp(z - z.max())
                g /= g.sum()
                g[y[i]] -= 1
                shape[doc.features[i]] -= step * (g + decay * shape[doc.features[i]])
                if before:
                    chain[y[i - 1]] -= step * (g + decay * chain[y[i - 1]])
                if after:
                    chain[:, y[i + 1]] -= step * (g + decay * chain[:, y[i + 1]])
                skip = max(0.0, skip - 0.1 * step * float(g @ votes[i]))
    return SkipChainModel(shape, chain, max(skip, 1.0))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1_000, sample_bytes: int = 20_000) -> DataFrame:
    """``h, body``: of the different rows that have a token to label, the ``sample_rows`` least by a hash of id and text.

    A bar first keeps about twice as many as are asked for, so that what travels is bounded whatever the
    number of tasks; copies of a row, which have one hash, are one row from the task on.
    """
    usable = docs.filter(F.col(text_col).rlike("[0-9@]") & (F.octet_length(text_col) <= sample_bytes))
    body = F.col(text_col).cast("string")
    rows = usable.select(body.alias("body"), F.xxhash64(F.col(id_col).cast("string"), body, F.lit(17)).alias("h"))
    known = rows.agg(F.approx_count_distinct("h").alias("n")).first()["n"]
    if known > 4 * sample_rows:
        rows = rows.filter(F.col("h") < F.lit(int(2**64 * 2 * sample_rows / known) - 2**63))
    return rows.groupBy("h").agg(F.min("body").alias("body")).orderBy("h").limit(sample_rows)


def train_pii_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1_000, sample_bytes: int = 20_000) -> SkipChainModel:
    """Fits on a bounded sample of documents that have a token to label."""
    return fit([r["body"] for r in training_sample(docs, id_col, text_col, sample_rows, sample_bytes).collect()])


def listed(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, b, k in spans])


def find_pii(docs: DataFrame, model: SkipChainModel, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True) -> DataFrame:
    """``id, n_email, n_ip, n_card, n_phone, base_sha256, n_added, spans`` for each row, counts of base
    spans; with ``redacted`` also the text with every span replaced by its kind."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    none = hashlib.sha256(b"").hexdigest()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            rows = []
            for text in batch["body"]:
                if not _ANY.search(text):
                    rows.append((0, 0, 0, 0, none, 0, "", text))
                    continue
                base = base_spans(text)
                added = m.added_spans(text, base)
                every = sorted(base + added, key=lambda s: (s[0], s[2], s[1]))
                count = [sum(s[2] == k for s in base) for k in range(len(KINDS))]
                rows.append((*count, hashlib.sha256(listed(base).encode()).hexdigest(), len(added), listed(every), redact(text, every) if redacted else None))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "n_added", "spans", "redacted"]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "id", batch["id"].to_numpy())
            yield out if redacted else out.drop(columns="redacted")

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, n_added bigint, spans string" + ", redacted string" * redacted
    return rows.mapInPandas(find, schema).withColumnRenamed("id", id_col)


def redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
