"""Exact token counts at every prefix of a text, by dynamic programming.

The vocabulary is a sentencepiece BPE model with byte fallback (its file is a
parameter). The encoding of a prefix ends in exactly one piece, so the last piece of
every prefix and the count follow from shorter prefixes: among the pieces that end at
a position, the one before which the shorter prefix's last piece may stand is the last
piece, and the count is one more than the shorter prefix's. Two pieces may stand
side by side if merging their characters by rank gives just these two; the answer is
remembered for each pair.

Blanks only start a piece and a line end is never within one, so a text falls apart
into chunks whose counts add up: the table of a chunk holds the count at each of its
prefixes. A text's table (``prefix_counts``) joins those of its chunks to the count at
every prefix; it is built once for each text, and the number of tokens and the longest
prefix within a budget are read off it. ``prefix_table`` keeps the counts at chunk ends
only, the form in which tables are stored.

A null or empty text has 0 tokens. Chunks are remembered in two bounded generations;
memory doesn't grow with the input. Nothing is shuffled.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import sub

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

BLANK = "▁"
_CHUNK = f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n"


class PrefixCounter:
    def __init__(self, path: str, cache_chunks: int = 200_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.rank = {model.id_to_piece(i): model.get_score(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        #: Chunks must not hide a piece that crosses their borders.
        assert not any("\n" in p or BLANK in p.lstrip(BLANK) for p in self.rank)
        #: A comma or full stop after a letter is another such border, unless some piece crosses it.
        crossed = any(re.search("[A-Za-zÀ-ÿ][.,]", p) for p in self.rank)
        self.cut_marks = not crossed
        self.chunk = re.compile(_CHUNK if crossed else f"{BLANK}*[A-Za-zÀ-ÿ]+(?=[.,])|{_CHUNK}")
        #: Pieces that merging gives whole, and a tree of their characters: (number or -1, what may follow).
        self.pieces: list[str] = []
        self.tree: dict[str, tuple[int, dict]] = {}
        for piece in self.rank:
            if len(piece) == 1 or self.merge(piece) == [piece]:
                node = self.tree
                for c in piece[:-1]:
                    node = node.setdefault(c, (-1, {}))[1]
                node[piece[-1]] = (len(self.pieces), node.get(piece[-1], (-1, {}))[1])
                self.pieces.append(piece)
        self.pairs: dict[int, bool] = {}
        self.size, self.young, self.old = cache_chunks, {}, {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging the best-ranked neighbours first, leftmost among equals."""
        sym: list[str | None] = list(text)
        n, rank = len(sym), self.rank
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(-rank[p], i, p) for i in range(n - 1) if (p := text[i : i + 2]) in rank]
        heapify(queue)
        while queue:
            _, i, piece = heappop(queue)
            j = nxt[i]
            if sym[i] is None or j >= n or len(sym[i]) + len(sym[j]) != len(piece):
                continue
            sym[i], sym[j] = piece, None
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (p := piece + sym[k]) in rank:
                    heappush(queue, (-rank[p], i, p))
            if (q := prv[i]) >= 0 and (p := sym[q] + piece) in rank:
                heappush(queue, (-rank[p], q, p))
        return [s for s in sym if s is not None]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are side by side."""
        a, b = self.pieces[left], self.pieces[right]
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        got = self.pairs[left << 20 | right] = self.merge(a + b) == [a, b]
        return got

    def chunk_table(self, chunk: str) -> tuple[int, ...]:
        """The number of tokens of each prefix of a chunk, of length 1 and up."""
        if (got := self.young.get(chunk)) is not None:
            return got
        if (got := self.old.get(chunk)) is None:
            got = self._table(chunk)
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[chunk] = got
        return got

    def _table(self, chunk: str) -> tuple[int, ...]:
        n, pairs = len(chunk), self.pairs
        last: list[int | None] = [None] * (n + 1)  # of each prefix; -1: a character outside the vocabulary
        last[0] = -1
        count = [0] * (n + 1)
        for start in range(n):
            left, here, node = last[start], count[start] + 1, self.tree
            for end in range(start, n):
                if (found := node.get(chunk[end])) is None:
                    break
                piece, node = found
                if piece >= 0 and last[end + 1] is None and (left < 0 or (pairs[k] if (k := left << 20 | piece) in pairs else self.adjacent(left, piece))):
                    last[end + 1], count[end + 1] = piece, here
            if chunk[start] not in self.rank:
                last[start + 1], count[start + 1] = -1, here - 1 + len(chunk[start].encode("utf-8"))
        return tuple(count[1:])

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall((BLANK + text).replace(" ", BLANK)) if text else []

    def count(self, text: str) -> int:
        """The number of tokens of the whole text."""
        return int(self.prefix_counts(text)[-1])

    def _word_steps(self, word: str) -> bytes:
        """By how much each character of a word, and its blank if it has one, changes the count."""
        if (got := self.words.get(word)) is not None:
            return got
        if (got := self.old_words.get(word)) is None:
            if word[-1:] in (",", ".") and self.cut_marks and word[-2:-1].isascii() and word[-2:-1].isalpha():
                got = self._word_steps(word[:-1]) + _steps(self._table(word[-1]))
            elif word[:1] == "\n":
                got = _steps(self._table("\n")) + _steps(self._table(word[1:]))
            else:
                got = _steps(self._table(BLANK + word))
        if len(self.words) >= 2 * self.size:
            self.old_words, self.words = self.words, {}
        self.words[word] = got
        return got

    def prefix_counts(self, text: str) -> np.ndarray:
        """The number of tokens of ``text[:i]`` for each ``i`` from 0 to the text's length."""
        if not text:
            return np.zeros(1, np.int64)
        words = text.replace("\n", " \n")
        if text[0] == " " or "  " in words or BLANK in text:
            steps = [_steps(self.chunk_table(c)) for c in self.chunks(text)]
        else:
            # Single blanks only: a word is one chunk with its blank, or a line end and what follows it.
            words = words.split(" ")
            steps = list(map(self.words.get, words))
            if None in steps:
                steps = [self._word_steps(w) if s is None else s for s, w in zip(steps, words)]
        counts = np.cumsum(np.frombuffer(b"".join(steps), np.int32), dtype=np.int64)
        counts[0] = 0  # the blank before the text alone
        return counts

    def prefix_table(self, text: str) -> tuple[list[int], list[int]]:
        """Ends (in characters of the text) and running counts of its chunks."""
        ends, counts, at, total = [], [], -1, 0
        for chunk in self.chunks(text):
            at += len(chunk)
            total += self.chunk_table(chunk)[-1]
            ends.append(at)
            counts.append(total)
        return ends, counts

    def count_at(self, text: str, end: int, table: tuple[list[int], list[int]] | None = None) -> int:
        """The number of tokens of ``text[:end]``."""
        if end <= 0:
            return 0
        ends, counts = table or self.prefix_table(text)
        k = bisect_right(ends, end - 1)
        start, before = (ends[k - 1], counts[k - 1]) if k else (-1, 0)
        if k == len(ends):
            return counts[-1] if counts else 0
        chunk = (BLANK + text)[start + 1 : ends[k] + 1].replace(" ", BLANK)
        return before + self.chunk_table(chunk)[end - start - 1]

    def longest_within(self, text: str, budget: int) -> int:
        """The greatest ``end`` for which ``text[:end]`` has at most ``budget`` tokens and every
        shorter chunk-aligned prefix does too."""
        ends, counts = self.prefix_table(text)
        k = bisect_right(counts, budget)
        if k == len(ends):
            return len(text)
        start, before = (ends[k - 1], counts[k - 1]) if k else (-1, 0)
        chunk = (BLANK + text)[start + 1 : ends[k] + 1].replace(" ", BLANK)
        fit = [i for i, c in enumerate(self.chunk_table(chunk)) if before + c <= budget]
        return max(0, start + 1 + fit[-1]) if fit else max(0, start)


def _steps(table: tuple[int, ...]) -> bytes:
    return array("i", map(sub, table, (0, *table))).tobytes()


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One counter and cache for each worker process."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, prefixes: bool = True) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, fits_chars`` for each row, and with ``prefixes`` the
    stored table ``chunk_ends, chunk_counts``. ``fits_chars`` is the length of the longest prefix
    within the limit."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = counter(path)
        for batch in batches:
            texts = batch["body"]
            n, fits = [], []
            for t in texts:
                counts = table.prefix_counts(t)
                n.append(int(counts[-1]))
                fits.append(len(t) if n[-1] <= limit else int(np.flatnonzero(counts <= limit)[-1]))
            out = pd.DataFrame({"id": batch["id"], "n_bytes": batch["n_bytes"], "n_tokens": n})
            out["over_limit"] = out["n_tokens"] > limit
            out["fits_chars"] = fits
            if prefixes:
                both = [table.prefix_table(t) for t in texts]
                out["chunk_ends"], out["chunk_counts"] = [b[0] for b in both], [b[1] for b in both]
            yield out

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body")).withColumn("n_bytes", F.octet_length("body").cast("bigint"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fits_chars bigint" + ", chunk_ends array<bigint>, chunk_counts array<bigint>" * prefixes
    return rows.mapInPandas(count, schema).withColumnRenamed("id", id_col)
