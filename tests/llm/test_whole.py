"""Operators over whole tables and texts, against brute force in Python."""

import hashlib

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from tests.llm.test_tokens import TEXTS
from tidemark.llm import pii
from tidemark.llm import queries as Q
from tidemark.llm.token_counts import PrefixCounter
from tidemark.llm.warc import CaptureIndex, archive_round_trip, plan_records, write_archives

PAGES = "page_id bigint, url string, html string"


def test_index_finds_a_key_over_many_blocks(spark, tmp_path):
    hot = [(None, "http://m.example.com/hot", f"hot {i}") for i in range(40)]
    rows = hot + [(i, f"http://m.example.com/{c}", f"{c} {i}") for c in ("a", "hot", "z") for i in range(12)] + [(90, "http://m.example.com/a\tb\tc", "tabs")]
    path = str(tmp_path / "warc")
    write_archives(plan_records(spark.createDataFrame(rows, PAGES)), path, file_bytes=5_000)
    index = CaptureIndex(spark, path, block_lines=7, ranges=2).build()
    assert index.directory().filter("first_key = 'com,example,m)/hot '").count() > 2
    keys = spark.createDataFrame([r[:2] for r in rows] + [(5000, "http://m.example.com/hot")], "id bigint, url string").select(CaptureIndex.key(F.col("url"), F.col("id")).alias("key"))
    found = index.read(index.locate(keys)).collect()
    assert sorted((r["id"] or -1, r["url"], bytes(r["payload"]).decode()) for r in found) == sorted((i or -1, u, h) for i, u, h in rows)


def test_round_trip_of_a_hot_key(spark):
    rows = [(None, "http://a.b/hot", f"page {i}") for i in range(7_000)] + [(1, "http://a.b/x\ty", "tab"), (2, None, ""), (2, None, "")]
    got = archive_round_trip(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r["page_id"] or -1, r["payload_digest"]) for r in got) == sorted((i or -1, hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows)


def test_round_trip_of_repeated_large_rows(spark):
    big = "b" * 2_000
    rows = [(7, "http://a.b/7", big)] * 4 + [(None, "http://a.b/n", big)] * 3 + [(5, "http://a.b/5", big), (7, "http://a.b/7", "other")]
    got = archive_round_trip(spark.createDataFrame(rows, PAGES)).collect()
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert sorted((r["page_id"] or -1, r["payload_digest"], r["refers_to"] or -1) for r in got) == sorted((i or -1, sha(h), 7 if h == big and i != 7 else -1) for i, _, h in rows)


def test_lookup_reads_only_its_ranges(spark, tmp_path):
    rows = [(i, f"http://a.b/{i}", f"page {i} " * 50) for i in range(40)]
    path = tmp_path / "warc of pages"
    write_archives(plan_records(spark.createDataFrame(rows, PAGES)).coalesce(1), str(path), file_bytes=1 << 20)
    index = CaptureIndex(spark, str(path), block_lines=7, ranges=2).build()
    key = spark.createDataFrame([(17, "http://a.b/17")], "id bigint, url string").select(CaptureIndex.key(F.col("url"), F.col("id")).alias("key"))
    located = index.locate(key).collect()
    # The bytes before the range are spoilt, those after it gone; and no plan scans the archives.
    (at, n), (file,) = located[0][2:], path.glob("*.txt")
    whole = file.read_bytes()
    file.with_name(f".{file.name}.crc").unlink()
    file.write_bytes(b"x" * at + whole[at : at + n])
    got = index.read(spark.createDataFrame(located)).collect()
    assert [(r["id"], bytes(r["payload"]).decode()) for r in got] == [(17, rows[17][2])]
    assert "binaryFile" not in index.read(spark.createDataFrame(located))._jdf.queryExecution().toString()


def test_one_table_of_every_prefix_gives_the_token_columns():
    path = Q.tokenizer("piece_bpe_32k.model")
    own, library = PrefixCounter(path, cache_chunks=50), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t[:300] for t in TEXTS] + ["\nNext, word.\nend", "it, was. the ünï, widget", "a \n b", "x" * 70 + ", y."]
    for text in texts:
        assert own.prefix_counts(text).tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)]
        for budget in (1, 4, 9):
            if own.count(text) > budget:
                assert np.flatnonzero(own.prefix_counts(text) <= budget)[-1] == own.longest_within(text, budget)


def test_letters_only_mentions_share_the_hub_of_their_address():
    text = "Mail anna.meier@example.org or call 12. Then (anna.meier), said others; Anna.Meier again, not annameiers."
    doc = pii.document(text, pii.base_spans(text))
    named = [text[a:b].strip("()") for a, b in doc.spans]
    assert named == ["anna.meier@example.org", "12", "anna.meier", "Anna.Meier"] and doc.spans == sorted(doc.spans)
    hubs = {i: {h for t, h in doc.hubs.tolist() if t == i} for i in range(4)}
    assert hubs[0] & hubs[2] & hubs[3] and not hubs[1]
    assert pii.document("anna.meier and nobody else", []).spans == []


def test_training_reads_every_token_of_a_document():
    calls = " ".join(f"n{i}" for i in range(300))
    a, b = (pii.fit([f"{calls} {tail}"], epochs=1) for tail in ("a@b.co " * 3, "77 " * 3))
    assert (a.shape != b.shape).any() and a.shape[pii.shape_features("a@b.co"), 1].sum() > 0
