"""WARC archives compressed record by record with an embedded Zstandard dictionary.

An archive is a leading skippable frame that holds a dictionary made from the
archive's own records, then one Zstandard frame per WARC record. The dictionary is
trained on pieces of the records, spread over the whole archive; where there are too
few of them to train on, the pieces themselves are the dictionary, so every archive
with a record has one. It takes a sixteenth of the records' bytes at most. Archives
are bounded in size, so a task writes as many as its rows need. They are the rows of a
table (name, data), each a complete archive file, so that Spark's own committer decides
which attempt of a task counts; ``export_archives`` copies them out as files.

Payloads repeat: among records with equal payloads of at least 100 bytes the one
with the smallest page_id is a response, the others are revisits that carry no
payload, but its length in their HTTP head. Which is which comes from one aggregate
over digests.

Null html is an empty payload; a null url leaves the target field out. Rows that
repeat the smallest page_id of their payload are responses too. Rows with a null
page_id count as larger than any other. Other columns are left out; no pages give no
archives.
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

from sluice.llm.shared import small_batches, written

#: Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_LEAST_BYTES = 100
#: Raw bytes of records in one archive; of those, how many the dictionary is made from, in pieces of what size; its own size, and part of the records.
ARCHIVE_BYTES = 12 << 20
SAMPLE_BYTES, PIECE_BYTES = 1 << 20, 4 << 10
DICTIONARY_BYTES, DICTIONARY_PART = 48 << 10, 16
LEVEL = 5

RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _uri(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: header fields, an HTTP head, and the payload unless it's a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Length", str(len(body))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _uri(refers_to)), ("X-Refers-To-Page", str(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for these records: trained on pieces of them, or the pieces as they are."""
    total = sum(map(len, records))
    pieces = [x[a : a + PIECE_BYTES] for x in records for a in range(0, len(x), PIECE_BYTES)]
    sample = pieces[:: max(1, -(-total // SAMPLE_BYTES))]
    size = min(DICTIONARY_BYTES, max(256, total // DICTIONARY_PART))
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8)
    except zstandard.ZstdError:  # too few pieces, or too little in common
        part = max(1, size // len(sample))
        return zstandard.ZstdCompressionDict(b"".join(x[:part] for x in sample)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack_archive(records: list[bytes]) -> bytes:
    """An archive of these records; nothing for none."""
    if not records:
        return b""
    dictionary = dictionary_of(records)
    raw = dictionary.as_bytes()
    out = io.BytesIO()
    out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    for x in records:
        out.write(packer.compress(x))
    return out.getvalue()


def unpack_archive(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Header fields, HTTP fields and payload of each record of an archive."""
    dictionary, at = None, 0
    if len(data) >= 8:
        magic, length = struct.unpack_from("<II", data)
        if magic == SKIPPABLE_MAGIC:
            dictionary, at = zstandard.ZstdCompressionDict(data[8 : 8 + length]), 8 + length
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[at:]), read_across_frames=True)
    stream = io.BufferedReader(reader, 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name] = value
        body = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        head, _, payload = body.partition(b"\r\n\r\n")
        http = dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
        yield fields, http, payload


def _write(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, records, total = TaskContext.get(), 0, [], 0

        def archive() -> pa.RecordBatch:
            name = f"part-{task.partitionId():06d}-{k:04d}.warc.zst"
            return pa.RecordBatch.from_pydict({"name": pa.array([name]), "data": pa.array([pack_archive(records)], pa.binary())})

        for batch in small_batches(batches, "html"):
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                payload = (row[2] or "").encode()
                records.append(_record(row[0], row[1], payload, row[3], row[4], date))
                total += len(records[-1])
                if total >= ARCHIVE_BYTES:
                    yield archive()
                    k, records, total = k + 1, [], 0
        if records:
            yield archive()

    return run


def _read(payloads: bool):
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for data in b.column(b.schema.get_field_index("data")):
                rows, total = [], 0
                for fields, http, payload in unpack_archive(data.as_py()):
                    kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't have its digest or length")
                    rows.append((
                        number(fields.get("X-Page-ID")), fields.get("WARC-Target-URI"), size, digest, kind,
                        number(fields.get("X-Refers-To-Page")), payload if payloads and kind == "response" else None,
                    ))
                    total += len(payload) + 100
                    if total >= 4 << 20:
                        yield batch(rows)
                        rows, total = [], 0
                if rows:
                    yield batch(rows)

    return run


def write_archives(pages: DataFrame, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Archives (name, data) with a record for each row of ``pages`` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256))
    long = pages.where(F.octet_length("html") >= REVISIT_LEAST_BYTES)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    firsts = written(firsts, "firsts")
    dealt = pages.join(firsts, pages.digest == firsts.d, "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= REVISIT_LEAST_BYTES)
    dealt = dealt.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"))
    return written(dealt.mapInArrow(_write(date), "name string, data binary"), "archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (name, data). Responses are checked against their digests and
    lengths; revisits have no payload, but the length of the one they refer to. Without
    ``payloads`` that column is null throughout."""
    return archives.select("data").mapInArrow(_read(payloads), RECORDS)


def _export(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1), strict=True):
                path = f"{root}/{name.as_py()}"
                part = f"{path}.{uuid.uuid4().hex}.part"  # attempts of a task don't meet
                with files.open_output_stream(part) as out:
                    out.write(data.as_py())
                files.move(part, path)
                yield pa.RecordBatch.from_pydict({"name": [name.as_py()], "bytes": [len(data.as_py())]})

    return run


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each archive (name, data) as a file of its name under ``folder``; returns name and bytes of each.

    ``folder`` is a URI of a store that all executors reach and pyarrow can write (a shared
    mount, s3, gs, hdfs). A file is moved to its name when it is complete, so repeated
    attempts leave one.
    """
    return written(archives.select("name", "data").mapInArrow(_export(folder), "name string, bytes long"), "exported")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages), payloads=False).drop("url", "payload")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, octet_length(encode(html)) as n, sha256(html) as d from p),
r as (select *, case when n >= 100 then min(page_id) over (partition by d, n) end as first from q)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when first is not null and first <> page_id then 'revisit' else 'response' end as record_type,
       case when first is not null and first <> page_id then first end as refers_to
from r
"""
