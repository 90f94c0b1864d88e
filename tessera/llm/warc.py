"""Dictionary-compressed WARC archives (operator 12): a writer and a reader.

Every task of the table writes one archive through Spark's own file writer, so it works on any file system that
Spark reaches and a lost task is simply written again. An archive begins with a skippable Zstandard frame
(0x184D2A5D) that holds a dictionary, trained on the first records of the archive itself (at most SAMPLE bytes of
them); after it each record is a frame of its own, compressed with the dictionary. What Spark's text writer puts
between rows is an empty skippable frame, so a whole file is one valid Zstandard stream. Archives with too few
records to train on have no dictionary.

Equal payloads of at least `least_bytes` are stored once: the page with the smallest id is a `response`, others are
`revisit` records without payload. The smallest ids come from one aggregation of digests with partial minima, so a
payload that a third of all pages share costs a row a task; only digests that repeat are joined back to the pages.

The reader takes archives as whole binary files, so an archive must fit a task: keep partitions of the pages to
some hundred MB. It checks every payload against its record's digest and every revisit against its response.

Edge cases: a null html is an empty payload; a null url leaves out the target URI; control characters of a url are
percent-encoded. Null ids are larger than all others; where all pages of a payload have none, each is a response.
Rows that repeat an id with its payload are alike: all are responses (of one record id) or all are revisits. Other
columns are not archived. An empty table makes no archive and reads back empty.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir, sized

DICTIONARY_MAGIC = 0x184D2A5D
#: A skippable frame without content.
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
#: Bytes of an archive's first records that its dictionary is trained on, of one record, and of the dictionary.
SAMPLE, SAMPLE_RECORD, DICTIONARY = 8_000_000, 100_000, 112_640
#: Bytes of compressed records that a task hands over at once.
CHUNK = 4_000_000
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "page_id {}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {}, record_id string, refers_to_id string"


def _quoted(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def _unquoted(text: str) -> str:
    return re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)


def _urn(*parts: object) -> str:
    return uuid.UUID(bytes=hashlib.sha256("\n".join(map(str, parts)).encode()).digest()[:16], version=5).urn


def record(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None, date: str, unique: str) -> bytes:
    """One WARC record; with `first`, the page of the response, a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Date", date), ("WARC-Record-ID", f"<{_urn(page, digest) if first is None else _urn(page, digest, unique)}>")]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page is not None:
        fields.append(("Page-ID", _quoted(page)))
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_urn(first, digest)}>"), ("Refers-To-Page-ID", _quoted(first))]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from some records, or None where they are too few."""
    samples = [r[:SAMPLE_RECORD] for r in records]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, samples)) // 50)), samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of an archive: the dictionary's, then one a record."""
    head, size = [], 0
    for r in records:
        head.append(r)
        size += min(len(r), SAMPLE_RECORD)
        if size >= SAMPLE:
            break
    if not head:
        return
    dictionary = trained(head)
    if dictionary:
        raw = dictionary.as_bytes()
        dictionary.precompute_compress(level=LEVEL)
        yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True).compress
    while head:
        yield from map(compress, head)
        head = [r for r in (next(records, None),) if r is not None]


def _archived(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0

        def records() -> Iterator[bytes]:
            for i, batch in enumerate(batches):
                page, url, html, digest, first = batch.columns
                for j in range(batch.num_rows):  # one row at a time: a batch may hold long texts
                    yield record(page[j].as_py(), url[j].as_py(), html[j].as_buffer().to_pybytes(), digest[j].as_py(), first[j].as_py(), date, f"{task}/{i}/{j}")

        out, size = [], 0
        for frame in archive(records()):
            out.append(frame)
            size += len(frame)
            if size >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                out, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes one archive a partition of pages into the new folder `path`; every record gets `date`."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    table = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    long = F.octet_length("html") >= least_bytes
    repeated = table.filter(long).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    repeated = materialise(repeated.select(F.col("digest").alias("d"), "first"), "repeated")
    joined = table.join(sized(repeated), (table["digest"] == repeated["d"]) & long, "left")
    later = F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    rows = joined.select(F.col("page").cast("string").alias("page"), "url", F.col("html").cast("binary").alias("html"), "digest", later.alias("first"))
    frames = rows.mapInArrow(_archived(date), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME.decode("latin-1")).text(path)


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an archive."""
    dictionary = None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_MAGIC:
        n = struct.unpack_from("<I", content, 4)[0]
        raw = bytes(memoryview(content)[8 : 8 + n])
        if raw[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    plain = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(content, read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := plain.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = plain.read(n)
        if len(block) != n or plain.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} is cut")
        yield fields, block


def _parsed(with_payload: bool):
    def row(fields: dict[str, str], block: bytes) -> tuple:
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of record {fields['warc-record-id']} does not have its digest")
        ids = [None if x is None else _unquoted(x) for x in (fields.get("page-id"), fields.get("refers-to-page-id"))]
        return (ids[0], fields.get("warc-target-uri"), kind, size, digest, ids[1], fields["warc-record-id"], fields.get("warc-refers-to"), *([payload if kind == "response" else None] if with_payload else []))

    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), *([pa.binary()] if with_payload else [])]
    names = [c.split()[0] for c in COLUMNS.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out, size = [], 0
                for fields, block in read_records(batch.column(0)[i].as_buffer()):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    out.append(row(fields, block))
                    size += 500 + len(block) * with_payload
                    if size >= CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def read_archives(spark: SparkSession, path: str, id_type: str = "long", with_payload: bool = True) -> DataFrame:
    """Rows COLUMNS and, if asked for, the payload (null for revisits) of all records in the archives of a folder.

    Fails where a payload does not have its record's digest.
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    found = files.mapInArrow(_parsed(with_payload), COLUMNS.format("string", "string") + ", payload binary" * with_payload)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def resolved(records: DataFrame) -> DataFrame:
    """Stored records where each revisit has payload_bytes and payload_digest of the response it refers to.

    Fails where the response is missing or has another payload. Only responses that something refers to are joined.
    """
    revisits = records.filter("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to_id").alias("record_id")).distinct()
    targets = records.filter("record_type = 'response'").join(wanted.hint("merge"), "record_id", "left_semi")
    targets = materialise(targets.groupBy(F.col("record_id").alias("id")).agg(F.min("payload_bytes").alias("bytes"), F.min("payload_digest").alias("digest")), "targets")
    same = F.col("digest").eqNullSafe(F.col("payload_digest")) & F.col("bytes").eqNullSafe(F.col("payload_bytes"))
    checked = F.when(same, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("no response of the same payload for "), "record_id")).cast("long"))
    found = revisits.join(sized(targets), F.col("refers_to_id") == F.col("id"), "left").withColumns({"payload_bytes": checked, "payload_digest": F.col("digest")})
    return records.filter("record_type <> 'revisit'").unionByName(found.select(*records.columns))


def round_trip(pages: DataFrame, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back, without payloads."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}-warc"
    write_archives(pages, path, least_bytes, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    return resolved(materialise(read_archives(spark, path, kind, with_payload=False), "records"))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
"""
