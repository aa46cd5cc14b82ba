"""WARC archives and a two-level capture index.

*Archives* are plain WARC/1.1 files that Spark's text writer makes: one row is one
record, the line separator that follows it is the second of the two line ends that
close a record. Payloads that repeat are written once, as a response, and as
revisits that name it.

*Index*: archives are scanned for records; their keys (the URL with its host reversed,
then the record id) are range-partitioned and sorted, and blocks of a few thousand
lines are compressed. That is the first level. The second is a sparse directory with
the first key and the place of each block. A lookup finds the blocks that can hold
a key (one, unless its records run over a block's end) by binary search in the directory
of its range, opens only those, searches them the same way, and reads only the record's range of the archive.

Directories are never collected: keys asked for are dealt by the same ranges, and one
range's directory (bounded by its number of blocks) is searched where its blocks are.

Null pages have an empty payload; a null URL counts as empty. Rows with a null id are
archived and can be read back by URL, with a null id. An empty table gives no archive.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, shared_path, skew_join, text_or_empty

_EOL = "\r\n"


def surt(url: Column) -> Column:
    """``https://m.a.example.com/x?y#z`` -> ``com,example,a,m)/x?y``: the host reversed, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    rest = F.regexp_extract(bare, "^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def _header(*lines: tuple[str, Column]) -> Column:
    parts = [F.lit(f"WARC/1.1{_EOL}")]
    for name, value in lines:
        parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit("")))
    return F.concat(*parts, F.lit(_EOL))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """``id, url, payload, sha1, payload_bytes, record_type, refers_to``: of equal payloads of
    ``least_bytes`` or more the one with the greatest id is the response."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(url_col).alias("url"), text_or_empty(html_col).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("sha1", F.sha1("payload")).withColumn("sha2", F.sha2("payload", 256))
    large = F.col("payload_bytes") >= least_bytes
    keep = materialize(rows.filter(large).groupBy("sha1", "sha2").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "warc-repeats")
    first = F.col("keep").isNull() | F.col("id").eqNullSafe(F.col("keep"))
    return (
        skew_join(rows, keep, ["sha1", "sha2"], "n")
        .withColumn("refers_to", F.when(~first, F.col("keep")))
        .select("id", "url", F.when(first, F.col("payload")).alias("payload"), "sha1", "payload_bytes", F.when(first, "response").otherwise("revisit").alias("record_type"), "refers_to")
    )


def record_text(at: str = "2024-01-01T00:00:00Z") -> Column:
    """The text of a planned record up to and with the first of its two closing line ends."""
    response = F.col("record_type") == "response"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_EOL + _EOL))
    block = F.concat(http, F.coalesce("payload", F.lit("")))
    uri = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    clean = F.regexp_replace("url", r"[\r\n]", " ")
    return F.concat(
        _header(
            ("WARC-Type", F.col("record_type")),
            ("WARC-Record-ID", F.coalesce(uri(F.col("id")), F.lit("<urn:page:>"))),
            ("WARC-Date", F.lit(at)),
            ("WARC-Target-URI", clean),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
            ("WARC-Refers-To", F.when(~response, uri(F.col("refers_to")))),
            ("WARC-Profile", F.when(~response, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(block).cast("string")),
        ),
        block,
        F.lit(_EOL),
    )


def write_archives(records: DataFrame, path: str, file_bytes: int = 16 << 20) -> None:
    """Writes planned records as WARC files of about ``file_bytes``, by their mean size."""
    size = records.select(F.avg("payload_bytes").alias("mean")).first()["mean"] or 0
    records_a_file = max(1, int(file_bytes / (size + 500)))
    records.select(record_text().alias("value")).write.option("lineSep", _EOL).option("maxRecordsPerFile", records_a_file).text(path)


_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        size = int(_LENGTH.search(data, at, head + 2)[1])
        lines = data[at:head].decode("utf-8").split(_EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        start = head + 4
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield at, start + size + 4 - at, dict(x.split(": ", 1) for x in lines[1:]), data[start : start + size]
        at = start + size + 4


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``url, id, path, offset, length`` of each record in the archives."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                rows = [(h.get("WARC-Target-URI", ""), h["WARC-Record-ID"][10:-1], name, at, n) for at, n, h, _ in parse_records(data)]
                yield pd.DataFrame(rows, columns=["url", "id", "path", "offset", "length"])

    return _archives(spark, path).mapInPandas(records, "url string, id string, path string, offset bigint, length bigint")


BLOCK_SCHEMA = "range int, block int, first_key string, lines int, data binary"


class CaptureIndex:
    """Blocks of sorted keys and their sparse directory, as tables in the shared folder."""

    def __init__(self, spark: SparkSession, archives: str, block_lines: int = 3_000, ranges: int | None = None):
        self.spark, self.archives, self.block_lines = spark, archives, block_lines
        self.path = shared_path(spark, "capture-index")
        self.ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @staticmethod
    def key(url: Column, id_: Column) -> Column:
        return F.concat(surt(url), F.lit(" "), F.coalesce(id_.cast("string"), F.lit("")))

    def build(self) -> CaptureIndex:
        entries = materialize(scan(self.spark, self.archives).withColumn("key", self.key(F.col("url"), F.col("id"))), "capture-entries")
        block_lines = self.block_lines

        def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            part, number, held = TaskContext.get().partitionId(), 0, []
            for batch in batches:
                held += [f"{k}\t{p}\t{o}\t{n}" for k, p, o, n in zip(batch["key"], batch["path"], batch["offset"], batch["length"])]
                while len(held) >= block_lines:
                    yield _block(part, number, held[:block_lines])
                    number, held = number + 1, held[block_lines:]
            if held:
                yield _block(part, number, held)

        ordered = entries.select("key", "path", "offset", "length").repartitionByRange(self.ranges, "key").sortWithinPartitions("key")
        ordered.mapInPandas(blocks, BLOCK_SCHEMA).write.parquet(f"{self.path}/blocks")
        # The directory holds no block's data: a line for each few thousand records.
        self.blocks().select("range", "block", "first_key", "lines").write.parquet(f"{self.path}/directory")
        return self

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCK_SCHEMA).parquet(f"{self.path}/blocks")

    def directory(self) -> DataFrame:
        return self.spark.read.schema("range int, block int, first_key string, lines int").parquet(f"{self.path}/directory")

    def locate(self, keys: DataFrame) -> DataFrame:
        """``keys(key)`` -> ``key, path, offset, length`` of every record with that key."""
        keys = keys.select("key").distinct()
        bounds = [r["first_key"] for r in self.directory().filter("block = 0").orderBy("range").select("range", "first_key").collect()]  # one for each range
        names = [r["range"] for r in self.directory().filter("block = 0").orderBy("range").select("range").collect()]

        @F.pandas_udf("int")
        def range_of(key: pd.Series) -> pd.Series:
            return key.map(lambda k: names[max(0, bisect_right(bounds, k) - 1)])

        if not bounds:
            return keys.select("key", F.lit(None).cast("string").alias("path"), F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("bigint").alias("length")).limit(0)

        def find_blocks(directory: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            directory = directory.sort_values("block")
            first, number = list(directory["first_key"]), list(directory["block"])
            # A key's records may begin in the block before the first that starts with it.
            rows = [(r, k, b) for r, k in zip(asked["range"], asked["key"]) for b in number[max(0, bisect_left(first, k) - 1) : bisect_right(first, k)]]
            return pd.DataFrame(rows, columns=["range", "key", "block"])

        asked = keys.withColumn("range", range_of("key"))
        wanted = asked.groupBy("range").cogroup(self.directory().groupBy("range")).applyInPandas(lambda a, d: find_blocks(d, a), "range int, key string, block int")
        grouped = wanted.groupBy("range", "block").agg(F.collect_list("key").alias("keys"))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for data, asked in zip(batch["data"], batch["keys"]):
                    lines = zlib.decompress(data).decode("utf-8").split("\n")
                    first = [_fields(x)[0] for x in lines]
                    for key in asked:
                        i = bisect_left(first, key)
                        while i < len(first) and first[i] == key:
                            rows.append(_fields(lines[i]))
                            i += 1
                yield pd.DataFrame([(k, p, int(o), int(n)) for k, p, o, n in rows], columns=["key", "path", "offset", "length"])

        return self.blocks().join(grouped, ["range", "block"]).mapInPandas(search, "key string, path string, offset bigint, length bigint")

    def read(self, located: DataFrame) -> DataFrame:
        """Reads the located ranges: ``key, id, url, record_type, refers_to, digest, payload``."""

        def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for path, keys, offsets, lengths in zip(batch["path"], batch["keys"], batch["offsets"], batch["lengths"]):
                    rows, held = [], 0
                    for key, data in zip(keys, _read_ranges(path, offsets, lengths)):
                        ((_, _, h, block),) = parse_records(data)
                        ref = h.get("WARC-Refers-To")
                        rows.append((key, _number(h["WARC-Record-ID"]), h.get("WARC-Target-URI", ""), h["WARC-Type"], _number(ref) if ref else None, h["WARC-Payload-Digest"][5:], block.split(b"\r\n\r\n", 1)[1] if h["WARC-Type"] == "response" else None))
                        held += len(data)
                        if held >= _HELD_BYTES:
                            yield _read_rows(rows)
                            rows, held = [], 0
                    yield _read_rows(rows)

        # Ranges are small whatever the records they name, so their partitions aren't to be joined by size.
        spread = located.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "path")
        lists = spread.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "key"))).alias("r")).select("path", F.col("r.key").alias("keys"), F.col("r.offset").alias("offsets"), F.col("r.length").alias("lengths"))
        return lists.mapInPandas(ranges, "key string, id bigint, url string, record_type string, refers_to bigint, digest string, payload binary")


#: Bytes of records that a task reads before it passes them on.
_HELD_BYTES = 4 << 20


def _read_ranges(path: str, offsets: Iterator[int], lengths: Iterator[int]) -> Iterator[bytes]:
    """The ranges of one archive, each by a seek and a read, in the file system its path names."""
    from pyarrow import fs

    where = re.sub("^file:/+", "/", path)
    if where.startswith("/"):
        files, name = fs.LocalFileSystem(), where
    else:
        files, name = fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as file:
        for at, n in zip(offsets, lengths):
            file.seek(int(at))
            data = file.read(int(n))
            if len(data) != n:
                raise ValueError(f"{path} ends within the {n} bytes from byte {at}")
            yield data


def _read_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "id", "url", "record_type", "refers_to", "digest", "payload"]).astype({"id": "Int64", "refers_to": "Int64"})


def _number(uri: str) -> int | None:
    return int(uri[10:-1]) if uri[10:-1] else None


def _fields(line: str) -> list[str]:
    """Key, path, offset and length of an index line; the key may have tabs."""
    return line.rsplit("\t", 3)


def _block(part: int, number: int, lines: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"range": [part], "block": [number], "first_key": [_fields(lines[0])[0]], "lines": [len(lines)], "data": [zlib.compress("\n".join(lines).encode("utf-8"))]})


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages, indexes the archives and reads every page back through the index:
    ``id, payload_bytes, payload_digest, record_type, refers_to, url``. Figures of a response come
    from its own payload, those of a revisit from the payload of the response it names."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    planned = plan_records(pages, id_col, url_col, html_col)
    write_archives(planned, path)
    index = CaptureIndex(spark, path).build()
    keys = pages.select(CaptureIndex.key(F.regexp_replace(text_or_empty(url_col), r"[\r\n]", " "), F.col(id_col)).alias("key"))
    back = index.read(index.locate(keys))

    @F.pandas_udf("string")
    def sha1(payload: pd.Series) -> pd.Series:
        return payload.map(lambda b: None if b is None else hashlib.sha1(b).hexdigest())

    back = materialize(back.select("id", "url", "record_type", "refers_to", "digest", F.octet_length("payload").cast("bigint").alias("n"), sha1("payload").alias("own")), "warc-back")
    # Rows of one id may repeat or differ: the digest says which of them a revisit names.
    asked = back.filter("record_type = 'revisit'").groupBy("refers_to", "digest").agg(F.count(F.lit(1)).alias("revisits"))
    named = back.filter("record_type = 'response'").select(F.col("id").alias("refers_to"), F.col("own").alias("digest"), F.col("n").alias("named_n"), F.col("own").alias("named_own")).distinct()
    out = skew_join(back, materialize(asked.join(named, ["refers_to", "digest"]), "warc-named"), ["refers_to", "digest"], "revisits")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", "named_n").alias("payload_bytes"), F.coalesce("own", "named_own").alias("payload_digest"), "record_type", "refers_to", "url")
