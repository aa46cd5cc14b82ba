"""Removal of byte strings that occur earlier, by prefix doubling over sampled positions.

Every string of ``length`` bytes that also starts earlier (smaller id, or the same
document further left) is found, and the bytes that such strings cover are removed.

Prefix doubling ranks positions by ever longer prefixes and keeps only positions whose
rank isn't unique. Sorting every position would move many times the input, so
positions are thinned first, without losing one:

* *First rank, sampled.* In each window of ``length`` bytes the least hash of a
  ``seed``-byte prefix marks a position (the leftmost of equals). Equal windows mark
  the same place. Consecutive windows with one mark are a run; some thirty windows
  share a run. Runs whose mark's prefix occurs once in the corpus hold no repeated
  window and drop out after this round.
* *Second rank, of runs.* Runs are ranked by the pair of their first rank and the
  name of all bytes that their windows cover. All but the first run of a class are
  repeats in full. A class alone with its prefix needs nothing more.
* *Third rank, of cores.* Where one prefix has several classes, the windows of each
  class's first run are cut into stretches of ``STRETCH``, counted from the mark, and
  ranked by the bytes that a stretch's windows have in common. Unique ones drop out.
* *Fourth rank, of positions.* The windows that are left are ranked one by one, by the
  pair of the ranks at offset 0 and at half the length. This is past the threshold, and
  doubling ends: of equal pairs all but the first are repeats.

Names are hashes of 64 bits for the first rank and 128 for the others.

Ranks are shuffled packed, by hash bucket; each task first settles what it can: of runs
(or windows) it holds twice only the first travels. A prefix that a task
has seen with several classes sends its classes apart, so that a frequent prefix, too,
spreads over all buckets. Texts travel once, to be cut, along with the lookup of
the third rank, which reuses that exchange.

Null texts count as empty. A null id orders before all others. Rows that share an id
are different documents; among them the order is fixed by a hash of their bytes, and of
equal rows all but one are repeats of it. An empty table gives an empty result;
other columns are ignored. Long texts are hashed in blocks; memory is bounded by a
block, and for cutting by one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, text_or_empty
from tidemark.llm.hashing import Roller, mix

_U = np.uint64
_C = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_POS = _U((1 << 24) - 1)
#: Windows hashed at a time.
BLOCK = 1 << 17
#: Windows that share a third rank.
STRETCH = 8
NULL_ID = -(1 << 63)


@lru_cache(maxsize=1)
def _rollers() -> tuple[Roller, Roller]:
    return Roller(31_013), Roller(31_019)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width``, by doubling."""
    out, have = v, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    if have < width:
        out = np.minimum(out[: len(v) - width + 1], out[width - have :])
    return out


def window_runs(data: np.ndarray, length: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one mark, by block: first rank, second rank, first window, number of windows, and
    how far the mark is behind the first window."""
    one, two = _rollers()
    n = len(data) - length + 1
    for s in range(0, max(n, 0), BLOCK):
        part = data[s : min(s + BLOCK, n) + length - 1]
        h = one.windows(one.prefix(part), seed)
        mark = sliding_min(h & ~_POS | np.arange(len(h), dtype=_U), length - seed + 1) & _POS
        lo = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1])))
        end = np.append(lo[1:], len(mark))
        at = mark[lo]
        name = two.span(two.prefix(part), lo, end + (length - 1))
        c = mix(name + (at - lo.astype(_U)) * _C[0] + (end - lo).astype(_U) * _C[1])
        yield h[at.astype(np.int64)], c, lo + s, end - lo, at.astype(np.int64) - lo


def _by_block(data: np.ndarray, lo: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, slice, int]]:
    """Pieces of a text that hold the spans starting at ascending ``lo``: bytes, which spans, where the piece starts."""
    at = 0
    while at < len(lo):
        stop = max(at + 1, int(np.searchsorted(lo, lo[at] + BLOCK)))
        yield data[lo[at] : lo[stop - 1] + reach], slice(at, stop), int(lo[at])
        at = stop


def core_names(data: np.ndarray, lo: np.ndarray, count: np.ndarray, mark: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Third ranks of runs: two names, first window and number of windows of each stretch."""
    far = mark  # distance from the mark to the first window, then to the last
    near = mark - count + 1
    first, n = near // STRETCH, far // STRETCH - near // STRETCH + 1
    run = np.repeat(np.arange(len(lo)), n)
    c = first[run] + np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    a = lo[run] + mark[run]
    p = a - np.minimum(far[run], c * STRETCH + STRETCH - 1)
    windows = a - np.maximum(near[run], c * STRETCH) - p + 1
    core = a - c * STRETCH
    order = np.argsort(core, kind="stable")
    core, p, windows = core[order], p[order], windows[order]
    size = length - STRETCH + 1
    names = [[], []]
    for part, which, s in _by_block(data, core, size):
        for r, out in zip(_rollers(), names):
            out.append(mix(r.span(r.prefix(part), core[which] - s, core[which] - s + size)))
    return np.concatenate(names[0]), np.concatenate(names[1]), p, windows


def window_names(data: np.ndarray, lo: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fourth ranks of the windows of some runs: two names and the position of each."""
    half = length // 2
    p = np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    p.sort()
    names = [[], []]
    for part, which, s in _by_block(data, p, length):
        q = p[which] - s
        for r, out in zip(_rollers(), names):
            prefix = r.prefix(part)
            out.append(mix(mix(r.span(prefix, q, q + half)) * _C[2] + mix(r.span(prefix, q + half, q + length)) * _C[3]))
    return np.concatenate(names[0]), np.concatenate(names[1]), p


PACKED = "bucket int, kind int, node binary, owner binary, a binary, b binary, lo binary, cnt binary, mark binary"
#: Kinds of packed rows: to be ranked; a mark that a prefix has several classes; of a prefix known to have several classes; found to be repeats.
RANK, MARK, SEVERAL, REPEAT = 0, 1, 2, 3


def _pack(bucket: np.ndarray, kind: int, ids: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray, cnt: np.ndarray, mark: np.ndarray) -> list[tuple]:
    out = []
    order = np.lexsort((lo, ids, bucket))  # neighbours in a document stay so, which compresses well
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(order) else []
    for i, j in zip(cuts[:-1], cuts[1:]):
        rows = order[i:j]
        node, owner = np.unique(ids[rows], return_inverse=True)
        owner = owner.astype(np.uint16 if len(node) <= 65_536 else np.uint32)
        none = kind == REPEAT
        out.append((int(bucket[rows[0]]), kind, node.tobytes(), owner.tobytes(), b"" if none else a[rows].tobytes(), b"" if none else b[rows].tobytes(), lo[rows].astype(np.uint32).tobytes(), cnt[rows].astype(np.uint8).tobytes(), mark[rows].astype(np.uint8).tobytes()))
    return out


def _unpack(pdf: pd.DataFrame, kind: int) -> tuple[np.ndarray, ...]:
    got: list[tuple[np.ndarray, ...]] = []
    pdf = pdf[pdf["kind"] == kind]
    for node, owner, a, b, lo, cnt, mark in zip(pdf["node"], pdf["owner"], pdf["a"], pdf["b"], pdf["lo"], pdf["cnt"], pdf["mark"]):
        node = np.frombuffer(node, np.int64)
        small = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (cnt, mark))
        got.append((node[np.frombuffer(owner, np.uint16 if len(node) <= 65_536 else np.uint32)], np.frombuffer(a, _U), np.frombuffer(b, _U), np.frombuffer(lo, np.uint32).astype(np.int64), *small))
    if not got:
        none = np.empty(0, np.int64)
        return none, np.empty(0, _U), np.empty(0, _U), none, none, none
    return tuple(np.concatenate(x) for x in zip(*got))


def _first_of_class(ids: np.ndarray, a: np.ndarray, b: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (a, b, id, lo); in it, whether a row starts a class; and whether it is a repeat (the first
    position of a class isn't, even if it comes twice)."""
    order = np.lexsort((lo, ids, b, a))
    a, b, ids, lo = a[order], b[order], ids[order], lo[order]
    starts = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(order)]
    first = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    return order, starts, (ids != ids[first]) | (lo != lo[first])


FOUND = "id bigint, lo bigint, cnt bigint, mark bigint, expand boolean"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _flushed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * (len(_NAMES) - 2)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(_NAMES), kinds)], names=_NAMES)


def _packed_ranks(ranks, flush, chunk: int):
    """Runs ``ranks`` over the bodies (and lists) of rows, and ``flush`` over what it gives whenever ``chunk``
    positions are held. Bodies are read in place from the Arrow batch."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            ids, body = batch.column(0).to_numpy(), batch.column(1)
            lists = [batch.column(i) for i in range(2, batch.num_columns)]
            for i, id_ in enumerate(ids):
                for part in ranks(body[i].as_buffer(), *[np.asarray(x[i].values, np.int64) for x in lists]):
                    if len(part[0]):
                        held.append((np.full(len(part[0]), id_, np.int64), *part))
                        total += len(part[0])
                    if total >= chunk:
                        yield _flushed(flush([np.concatenate(x) for x in zip(*held)]))
                        held, total = [], 0
        if held:
            yield _flushed(flush([np.concatenate(x) for x in zip(*held)]))

    return packed


def _flush_runs(buckets: int):
    """Repeats within the task are settled; prefixes with several classes are marked and their runs spread."""

    def flush(cols: list[np.ndarray]) -> list[tuple]:
        ids, g, c, lo, cnt, mark = cols
        order, starts, repeat = _first_of_class(ids, g, c, lo)
        ids, g, c, lo, cnt, mark = (x[order] for x in (ids, g, c, lo, cnt, mark))
        n = _U(buckets)
        put = lambda bucket, kind, m: _pack((bucket[m] % n).astype(np.int64), kind, ids[m], g[m], c[m], lo[m], cnt[m], mark[m])
        new = np.concatenate(([True], g[1:] != g[:-1]))
        group = np.cumsum(new) - 1
        several = (np.bincount(group, weights=starts) > 1)[group]
        spread = mix(g ^ c)
        return put(spread, REPEAT, repeat) + put(g, RANK, starts & ~several) + put(spread, SEVERAL, starts & several) + put(g, MARK, several & new)

    return flush


def _rerank_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: runs that are repeats in full, and first runs whose windows have to be ranked."""
    out = [_repeats(pdf)]
    ids, g, c, lo, cnt, mark = _unpack(pdf, RANK)
    if len(ids):
        order, starts, repeat = _first_of_class(ids, g, c, lo)
        ids, g, lo, cnt, mark = (x[order] for x in (ids, g, lo, cnt, mark))
        group = np.cumsum(np.concatenate(([True], g[1:] != g[:-1]))) - 1
        several = (np.bincount(group, weights=starts) > 1)[group] | _among(g, _unpack(pdf, MARK)[1])
        out += [_rows(ids, lo, cnt, mark, repeat, False), _rows(ids, lo, cnt, mark, starts & several, True)]
    ids, g, c, lo, cnt, mark = _unpack(pdf, SEVERAL)
    if len(ids):
        order, starts, repeat = _first_of_class(ids, g, c, lo)
        ids, lo, cnt, mark = (x[order] for x in (ids, lo, cnt, mark))
        out += [_rows(ids, lo, cnt, mark, repeat, False), _rows(ids, lo, cnt, mark, starts, True)]
    return pd.concat(out, ignore_index=True)


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    values = np.unique(values)
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _rows(ids, lo, cnt, mark, mask, expand: bool) -> pd.DataFrame:
    return pd.DataFrame({"id": ids[mask], "lo": lo[mask], "cnt": cnt[mask], "mark": mark[mask], "expand": np.full(int(mask.sum()), expand)})


def _repeats(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, _, _, lo, cnt, mark = _unpack(pdf, REPEAT)
    return _rows(ids, lo, cnt, mark, np.ones(len(ids), bool), False)


def _flush_cores(buckets: int):
    """Cores that a task holds more than once are spread, with one mark for the others."""

    def flush(cols: list[np.ndarray]) -> list[tuple]:
        ids, a, b, lo, cnt = cols
        order = np.lexsort((b, a))
        ids, a, b, lo, cnt = (x[order] for x in (ids, a, b, lo, cnt))
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        group = np.cumsum(new) - 1
        several = (np.bincount(group) > 1)[group]
        n, none = _U(buckets), np.zeros(len(ids), np.int64)
        put = lambda bucket, kind, m: _pack((bucket[m] % n).astype(np.int64), kind, ids[m], a[m], b[m], lo[m], cnt[m], none[m])
        return put(a, RANK, ~several) + put(mix(ids.view(_U) + lo.view(_U)), REPEAT, several) + put(a, MARK, several & new)

    return flush


def _rerank_cores(pdf: pd.DataFrame) -> pd.DataFrame:
    """Stretches whose core occurs elsewhere too."""
    out = [_repeats(pdf).assign(expand=True)]
    ids, a, b, lo, cnt, mark = _unpack(pdf, RANK)
    if len(ids):
        order = np.lexsort((b, a))
        ids, a, b, lo, cnt, mark = (x[order] for x in (ids, a, b, lo, cnt, mark))
        group = np.cumsum(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) - 1
        several = (np.bincount(group) > 1)[group] | _among(a, _unpack(pdf, MARK)[1])
        out.append(_rows(ids, lo, cnt, mark, several, True))
    return pd.concat(out, ignore_index=True)


def _flush_windows(buckets: int):
    def flush(cols: list[np.ndarray]) -> list[tuple]:
        ids, a, b, lo = cols
        order, starts, repeat = _first_of_class(ids, a, b, lo)
        ids, a, b, lo = (x[order] for x in (ids, a, b, lo))
        n, one, none = _U(buckets), np.ones(len(ids), np.int64), np.zeros(len(ids), np.int64)
        put = lambda bucket, kind, m: _pack((bucket[m] % n).astype(np.int64), kind, ids[m], a[m], b[m], lo[m], one[m], none[m])
        return put(mix(ids.view(_U) + lo.view(_U)), REPEAT, repeat) + put(a, RANK, starts)

    return flush


def _rerank_windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """Windows that are repeats."""
    out = [_repeats(pdf)]
    ids, a, b, lo, cnt, mark = _unpack(pdf, RANK)
    if len(ids):
        order, _, repeat = _first_of_class(ids, a, b, lo)
        out.append(_rows(ids[order], lo[order], cnt[order], mark[order], repeat, False))
    return pd.concat(out, ignore_index=True)


def _zip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        body = batch.column(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(body[i].as_buffer()) for i in range(len(body))], pa.binary())], names=["id", "body"])


def _bytes(body) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(body), np.uint8)


def _cut(length: int, keep_text: bool):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for body, lo, cnt in zip(batch["body"], batch["lo"], batch["cnt"]):
                removed = spans = 0
                data = _bytes(body)
                kept = data.tobytes()
                if lo is not None and len(lo):
                    lo, cnt = np.asarray(lo, np.int64), np.asarray(cnt, np.int64)
                    depth = np.bincount(lo, minlength=len(data) + 1) - np.bincount(lo + cnt + (length - 1), minlength=len(data) + 1)
                    gone = np.cumsum(depth)[:-1] > 0
                    removed, spans = int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                    kept = data[~gone].tobytes()
                out.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            yield pd.DataFrame({"id": batch["id"], "n_bytes": [o[0] for o in out], "n_removed": [o[1] for o in out], "n_spans": [o[2] for o in out], "kept_sha256": [o[3] for o in out]} | ({"kept": [o[4] for o in out]} if keep_text else {}))

    return cut


def _numbered(rows: DataFrame) -> DataFrame | None:
    """``id, doc, body`` with ids that differ and keep the order of the documents, if any id (now ``doc``) is shared.

    The numbers follow a range sort by id, bytes and row, so that rows of one id are spread over tasks.
    """
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return None
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("__hash", F.xxhash64("body")).withColumn("__row", F.monotonically_increasing_id())
    by = ["id", "__hash", "__row"]
    inorder = keyed.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return materialize(inorder.select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("doc"), "body"), "suffix-numbered")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, seed: int = 32, bucket_bytes: int = 2 << 20, keep_text: bool = True) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``keep_text``, the remaining
    bytes ``kept``, for each row of ``docs``."""
    if not 1 <= seed <= length or length < 2 * STRETCH or length - seed > 200:
        raise ValueError(f"1 <= seed <= length, length >= {2 * STRETCH} and length - seed <= 200 are needed")
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("id"), F.encode(text_or_empty(text_col), "UTF-8").alias("body"))
    numbered = _numbered(rows)
    rows = rows if numbered is None else numbered.select("id", "body")
    total = rows.select(F.sum(F.octet_length("body")).alias("s")).first()["s"] or 0
    buckets = max(16, int(total // bucket_bytes))
    chunk = 200_000
    first = _packed_ranks(lambda body: window_runs(np.frombuffer(body, np.uint8), length, seed), _flush_runs(buckets), chunk)
    runs = materialize(rows.mapInArrow(first, PACKED).groupBy("bucket").applyInPandas(_rerank_runs, FOUND), "suffix-runs")

    lists = lambda df, *cols: df.groupBy("id").agg(F.collect_list(F.struct(*cols)).alias("r")).select("id", *[F.col(f"r.{c}").alias(c) for c in cols])
    # The three uses of the texts share one exchange.
    zipped = rows.mapInArrow(_zip, "id bigint, body binary")
    third = _packed_ranks(lambda body, lo, cnt, mark: [core_names(_bytes(body), lo, cnt, mark, length)], _flush_cores(buckets), chunk)
    asked = zipped.join(lists(runs.filter("expand"), "lo", "cnt", "mark"), "id")
    cores = asked.mapInArrow(third, PACKED).groupBy("bucket").applyInPandas(_rerank_cores, FOUND)
    fourth = _packed_ranks(lambda body, lo, cnt: [window_names(_bytes(body), lo, cnt, length)], _flush_windows(buckets), chunk)
    windows = zipped.join(lists(cores, "lo", "cnt"), "id").mapInArrow(fourth, PACKED).groupBy("bucket").applyInPandas(_rerank_windows, FOUND)
    repeats = runs.filter("not expand").unionByName(windows)
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    out = zipped.join(lists(repeats, "lo", "cnt"), "id", "left").mapInPandas(_cut(length, keep_text), schema)
    out = materialize(out, "suffix-kept")
    if numbered is not None:
        columns = [F.col("doc").alias("id"), *out.columns[1:]]
        out = out.join(numbered.select("id", "doc"), "id").select(columns)
    return out.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))).withColumnRenamed("id", id_col)
