"""WARC archives with an index, and reads of selected records by coalesced byte ranges.

Every record is a gzip member of its own, so it can be read alone. While a task writes its archive it
yields the record's file, offset, length, URL and digest; these rows are stored as the index, which is
also the commit record: files of attempts that did not finish are in no index row. Readers sort the
selected records by place, merge neighbours into ranges and fetch each range with one read.

Records with equal payloads of at least ``REVISIT_BYTES`` are written once: the largest ``page_id`` is
the response, the others are revisits that refer to it.

Defined results: null html is an empty payload; a null url is left out of the record and read back as
null; equal payloads without any id are all responses, otherwise rows without an id revisit; rows that
repeat the largest id are all responses; an empty table writes nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewise.llm.words import text_chunks
from cratewise.session import materialize, run_folder

REVISIT_BYTES = 1000
#: Bytes after which a task begins its next archive.
ARCHIVE_BYTES = 1 << 30
#: A read covers records of one such stretch of an archive, and gaps up to ``GAP_BYTES`` between them.
STRETCH_BYTES, GAP_BYTES = 8 << 20, 64 << 10
SALTS = 32
DATE = "2024-01-01T00:00:00Z"

INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, digest string, record_type string, refers_to bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, name: str) -> bytes:
    """One WARC record, uncompressed. A revisit has no payload, but its digest and length."""
    body = b"" if kind == "revisit" else payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else json.dumps(url)[1:-1]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>" if refers_to is not None else None),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", len(body)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """The fields of a record and its body (``payload``); a response's length and digest are measured anew."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    refers = fields.get("WARC-Refers-To")
    body = rest[: int(fields["Content-Length"])]
    url = fields.get("WARC-Target-URI")
    whole = fields["WARC-Type"] == "response"
    return {
        "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
        "url": None if url is None else json.loads(f'"{url}"'),
        "payload_bytes": len(body) if whole else int(fields["X-Payload-Length"]),
        "payload_digest": hashlib.sha1(body).hexdigest() if whole else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None,
        "payload": body,
    }


def compress(data: bytes) -> bytes:
    tool = zlib.compressobj(6, zlib.DEFLATED, 31)
    return tool.compress(data) + tool.flush()


def with_revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, digest, refers_to)``: the page that a revisit refers to, null for responses.

    Only digests that occur more than once are joined back; a digest's rows are salted, so copies that
    are a large part of all pages do not meet in one task.
    """
    hashed = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    long = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= REVISIT_BYTES)
    groups = long.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("c")).where("c > 1 AND last IS NOT NULL").select("digest", "last")
    copies = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = salted.join(copies, ["digest", "salt"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("last")).alias("refers_to"))


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = pafs.FileSystem.from_uri(folder)
    out, name, offset = None, "", 0
    try:
        for batch in batches:
            for a, b, texts in text_chunks(batch, "html"):
                rows = []
                facts = batch.slice(a, b - a).drop_columns(["html"]).to_pylist()
                for r, payload in zip(facts, texts, strict=True):
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        # a name of its own for every attempt: none overwrites another's archive
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    kind = "response" if r["refers_to"] is None else "revisit"
                    own = uuid.UUID(bytes=hashlib.sha1(f"{name}:{offset}".encode()).digest()[:16])
                    data = compress(record(r["page_id"], r["url"], payload, r["digest"], kind, r["refers_to"], str(own)))
                    out.write(data)
                    rows.append((r["page_id"], r["url"], name, offset, len(data), r["digest"], kind, r["refers_to"]))
                    offset += len(data)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = [c.split()[0] for c in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)
    finally:
        if out is not None:
            out.close()


def _uri(folder: str) -> str:
    if "://" in folder:
        return folder
    return "file://" + folder.removeprefix("file:")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as archives under ``folder``; the stored index."""
    store, root = pafs.FileSystem.from_uri(_uri(folder))
    store.create_dir(root, recursive=True)
    return materialize(with_revisits(pages).mapInArrow(lambda it: _write(it, _uri(folder)), INDEX), "warc-index").df


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the rows of ``index``, read from the archives under ``folder``."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(_uri(folder))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        for file, begin, end, places in ranges(r for batch in batches for r in batch.to_pylist()):
            with store.open_input_file(f"{root}/{file}") as source:
                data = source.read_at(end - begin, begin)
            rows = [parse(zlib.decompress(data[o - begin : o - begin + n], 31)) for o, n in places]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names=names)

    stretch = F.floor(F.col("offset") / STRETCH_BYTES).alias("stretch")
    placed = index.select("file", stretch, "offset", "length").repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return placed.select("file", "offset", "length").mapInArrow(fetch, RECORD)


def ranges(rows: Iterator[dict]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Byte ranges ``(file, begin, end, records)`` that cover records sorted by file and offset."""
    file, begin, end, places = None, 0, 0, []
    for r in rows:
        if places and (r["file"] != file or r["offset"] - end > GAP_BYTES or r["offset"] + r["length"] - begin > STRETCH_BYTES):
            yield file, begin, end, places
            places = []
        if not places:
            file, begin = r["file"], r["offset"]
        end = r["offset"] + r["length"]
        places.append((r["offset"], r["length"]))
    if places:
        yield file, begin, end, places


def archive(pages: DataFrame) -> DataFrame:
    """Write all ``pages`` to the working folder and read every record back."""
    spark: SparkSession = pages.sparkSession
    folder = f"{run_folder(spark)}/warc-{uuid.uuid4().hex}"
    return read_records(write_archives(pages, folder), folder)
