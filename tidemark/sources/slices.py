"""Texts of an Arrow column a few at a time, so that what is made of them never stands in memory for a whole batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: A slice ends at so many texts or at so many bytes, whichever comes first; one text is never cut.
MOST_TEXTS, MOST_BYTES = 64, 1 << 20


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and (i - start >= MOST_TEXTS or held + n > MOST_BYTES):
            yield texts.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield texts.slice(start)


def each_slice(batches: Iterator[pa.Array], read: Callable[[str | None], object], kind: pa.DataType) -> Iterator[pa.Array]:
    """``read`` of every text, handed on slice by slice."""
    for batch in batches:
        for part in slices(batch):
            yield pa.array([read(text) for text in part.to_pylist()], kind)
