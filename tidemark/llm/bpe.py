"""Byte-pair encoding and decoding with a heap of merge ranks over a linked symbol list.

The vocabulary file is a public tokenizer's JSON (a parameter, never copied). Text
goes through the steps that the file names: special strings are cut out as they
stand, the rest is brought to NFC, white space is made single blanks and letters
lower case, then a pattern cuts words, and each word's UTF-8 bytes are symbols, the
last one with the end-of-word suffix.

A word is encoded with a priority queue of ``(rank, position)`` over a doubly linked
list of symbols. Merging a pair leaves stale entries of its neighbours in the queue;
they are recognised, because the pair that they stand for is no longer there, and
skipped. Decoding concatenates the vocabulary's strings, one blank between tokens, as
a tokenizer without a decoder step does.

Words repeat, so a task keeps two generations of a cache that is bounded by its number of
entries and by their length; memory doesn't grow with the input. Spark partitions the rows; nothing is shuffled.

A null or empty text has no tokens. Long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

# Unicode's white space, as the pattern libraries of the tokenizers see it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII controls that ``str.split`` takes for white space and the tokenizers don't.
_INFO = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    it is visible in Latin-1, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


#: Longer words aren't remembered.
CACHED_CHARS = 64
CACHE_WORDS = 200_000


class BpeCodec:
    """``cache_words`` bounds each of two generations of remembered words; a full young one becomes the old one."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = [self.vocab[c] for c in symbols]
        self.final = [self.vocab[c + suffix] for c in symbols]
        #: Of two ids, as one number: the rank of their merge. Of a rank: the merged id.
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for m in model["merges"]:
            left, right = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault(self.vocab[left] << 20 | self.vocab[right], len(self.merged))
            self.merged.append(self.vocab[left + right])
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
        self.words_ascii = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.white = re.compile(f"[{WHITE}]+")
        self.size, self.young, self.old = cache_words, {}, {}

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one word of the pattern."""
        raw = word.encode("utf-8")
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.final[raw[-1]]
        n, ranks = len(sym), self.ranks
        queue = []
        for i in range(n - 1):
            if (rank := ranks.get(sym[i] << 20 | sym[i + 1])) is not None:
                queue.append(rank << 32 | i)
        if not queue:
            return sym
        heapify(queue)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            top = heappop(queue)
            rank, i = top >> 32, top & 0xFFFFFFFF
            j = nxt[i]
            if sym[i] < 0 or j >= n or ranks.get(sym[i] << 20 | sym[j]) != rank:
                continue  # stale: this pair is no longer there
            new = sym[i] = self.merged[rank]
            sym[j] = -1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (rank := ranks.get(new << 20 | sym[k])) is not None:
                    heappush(queue, rank << 32 | i)
            if (p := prv[i]) >= 0 and (rank := ranks.get(sym[p] << 20 | new)) is not None:
                heappush(queue, rank << 32 | p)
        return [s for s in sym if s >= 0]

    def _word(self, word: str) -> tuple[int, str, str]:
        if (got := self.young.get(word) or self.old.get(word)) is None:
            ids = self.encode_word(word)
            got = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return self._keep(word, got)

    def _keep(self, key: str, got: tuple[int, str, str]) -> tuple[int, str, str]:
        if len(key) > CACHED_CHARS:
            return got
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = got
        return got

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        """Of text without white space: number of tokens, ids and strings, both joined by blanks."""
        if (got := self.old.get(chunk)) is None:
            words = (self.words_ascii if chunk.isascii() else self.words).findall(chunk)
            if len(words) == 1:
                return self._word(words[0])
            parts = [self._word(w) for w in words]
            got = (sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]))
        return self._keep(chunk, got)

    def _pieces(self, text: str) -> list[tuple[int, str, str]]:
        out: list[tuple[int, str, str]] = []
        for part in self.cut.split(text) if self.cut and self.cut.search(text) else (text,):
            if part in self.special:
                out.append((1, str(self.special[part]), part))
                continue
            if part.isascii():
                chunks = part.lower().split() if not _INFO.search(part) else self.white.sub(" ", part.lower()).split(" ")
            else:
                # One lower-case form for each character, wherever it stands in a word.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                chunks = self.white.sub(" ", part).lower().split(" ")
            got = list(map(self.young.get, chunks))
            if None in got:
                got = [g or self._chunk(c) for g, c in zip(got, chunks) if c]
            out += got
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self._pieces(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, special ones too; ids without one are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def digest(self, text: str) -> tuple[int, str, str, str]:
        """Number of tokens, SHA-256 of the ids and of the decoded text, and the ids joined by blanks."""
        got = self._pieces(text)
        ids, decoded = " ".join([g[1] for g in got]), " ".join([g[2] for g in got])
        return sum([g[0] for g in got]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids


#: Rows that are encoded before their results leave the worker.
ROWS_AT_ONCE = 256


@lru_cache(maxsize=4)
def codec(path: str, cache_words: int = CACHE_WORDS) -> BpeCodec:
    """One codec and cache for each worker process."""
    return BpeCodec(path, cache_words)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``token_ids`` for each row.
    ``cache_words`` trades a worker's memory for time."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, cache_words)
        for batch in batches:
            # A few rows at a time: a batch may hold thousands of texts, and their ids stand in memory several times.
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = [bpe.digest(t) for t in part.column("body").to_pylist()]
                out = {"id": part.column("id"), "n_tokens": pa.array([r[0] for r in rows], pa.int64()), "ids_sha256": pa.array([r[1] for r in rows], pa.string()), "decoded_sha256": pa.array([r[2] for r in rows], pa.string())}
                if keep_ids:
                    out["token_ids"] = pa.array([np.array(r[3].split(), np.int32) for r in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids
    return rows.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of a column of id arrays; null ids stay null."""

    @F.pandas_udf("string")
    def decoded(ids: pd.Series) -> pd.Series:
        bpe = codec(path)
        return ids.map(lambda x: None if x is None else bpe.decode([int(i) for i in x]))

    return rows.withColumn(out_col, decoded(F.col(ids_col)))
