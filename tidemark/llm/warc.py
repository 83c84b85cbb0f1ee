"""WARC archives with an index of byte ranges.

Writing: each task writes its rows as WARC 1.1 records, a gzip member each, to archives of its own in the shared folder and
returns the index: archive, offset, length, url, digest. The index is a table that only lists what successful tasks wrote;
archives of lost or repeated tasks stand beside it unread.

Reading: the index is filtered first. What is selected is dealt out by archive and region, sorted by offset, and neighbouring ranges
(gaps up to GAP bytes) become one read of READ bytes at most, so a task holds READ bytes or one record.

Of rows with equal payloads (equal length, SHA-1 and SHA-256) of at least min_bytes, those with the largest page id are responses; others are
revisits, which have the HTTP header but no payload and refer to that id. Rows that repeat the largest id are responses too. Null html is an empty payload.
Null ids sort below all others; a group of null ids only has responses. Null urls have no target line.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh_path, settled, spread_join, text_or_empty

GAP, READ, ROLL = 64 * 1024, 8 << 20, 256 << 20
#: Regions of an archive that reading tasks take as a whole.
REGION = 32 << 20
_NAMES = uuid.UUID("b9b1fd0e-2d7d-4a7e-9c38-2c0a5ad0f6b1")


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest}')}>"


def clean(value: str) -> str:
    """No line ends or controls in a header line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(kind: str, fields: dict[str, str | None], block: bytes, date: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Date": date, **fields, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {clean(v)}\r\n" for k, v in head.items() if v is not None)
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, is_revisit: bool, date: str) -> tuple[bytes, str]:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Page-ID": page_id,
        "Content-Type": "application/http; msgtype=response",
    }
    if is_revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, digest), "WARC-Refers-To-Page-ID": refers_to}
        return make_record("revisit", fields, http, date), digest
    return make_record("response", fields, http + payload, date), digest


def headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}, rest


def parse_record(member: bytes) -> dict:
    """One gzip member back to page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    warc, rest = headers(zlib.decompress(member, 31))
    http, payload = headers(rest[: int(warc["content-length"])])
    digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
    if kind == "response":
        real = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if real != digest or len(payload) != int(http["content-length"]):
            raise ValueError(f"damaged record {warc['warc-record-id']}")
    return {
        "page_id": warc.get("warc-page-id"), "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind,
        "refers_to": warc.get("warc-refers-to-page-id"), "url": warc.get("warc-target-uri"), "payload": payload if kind == "response" else None,
    }


INDEX = "archive string, offset long, length long, url string, digest string, record_type string, page_id string"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes all rows; returns the index, settled."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"), text_or_empty(html_col).alias("__html"))
    rows = rows.withColumn("__sha", F.sha1("__html")).withColumn("__own", F.sha2("__html", 256))
    marks = settled(rows.select("__id", F.octet_length("__html").alias("__size"), "__sha", "__own"), "marks")
    same = ["__size", "__sha", "__own"]
    # a payload's largest id: copies are combined before the shuffle, and payloads of many pages are dealt out
    tops = settled(marks.where(F.col("__size") >= min_bytes).groupBy(*same).agg(F.max("__id").alias("__top"), F.count("*").alias("__c")).where("__c > 1"), "tops")
    revisits = spread_join(marks, tops, same, "__c", marks.count(), ["__id"]).where("not (__id <=> __top)")
    revisits = settled(revisits.select(F.col("__id").alias("__r"), F.col("__own").alias("__rs"), "__top", F.lit(True).alias("__again")).distinct(), "revisits")
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    rows = rows.join(revisits, F.col("__id").eqNullSafe(F.col("__r")) & (F.col("__own") == F.col("__rs")), "left")
    rows = rows.select(F.col("__id").cast("string"), "__url", F.encode("__html", "utf-8").alias("__html"), F.col("__top").cast("string"), F.coalesce("__again", F.lit(False)).alias("__again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(folder)
        store.create_dir(at, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, html, top, again in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or offset > ROLL:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{at}/{name}", compression=None)
                        info = make_record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n", date)
                        out.write(info)
                        offset = len(info)
                    record, digest = page_record(page_id, url, bytes(html), top, again, date)
                    out.write(record)
                    index.append({"archive": f"{folder}/{name}", "offset": offset, "length": len(record), "url": url, "digest": digest, "record_type": "revisit" if again else "response", "page_id": page_id})
                    offset += len(record)
                yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return settled(rows.mapInArrow(run, INDEX), "index")


_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.string())])
_READ = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload", pa.binary())])


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) as reads (begin, end, ranges in it)."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in ranges:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            begin, _, own = out[-1]
            out[-1] = (begin, offset + length, [*own, (offset, length)])
        else:
            out.append((offset, offset + length, [(offset, length)]))
    return out


def read_records(selected: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the (filtered) index lists."""
    fields = [f for f in _READ if with_payload or f.name != "payload"]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            columns = batch.to_pydict()
            by: dict[str, list[tuple[int, int]]] = {}
            for archive, offset, length in zip(columns["archive"], columns["offset"], columns["length"]):
                by.setdefault(archive, []).append((offset, length))
            for archive, ranges in by.items():
                if opened != archive:
                    store, path = open_store(archive)
                    source, opened = store.open_input_file(path), archive
                for begin, end, own in coalesced(sorted(ranges)):
                    source.seek(begin)
                    data = source.read(end - begin)
                    rows = [parse_record(data[o - begin : o - begin + n]) for o, n in own]
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)

    kinds = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string" + (", payload binary" if with_payload else "")
    ranges = selected.select("archive", F.floor(F.col("offset") / REGION).alias("__region"), "offset", "length")
    # a number of partitions of our own: merging partitions by the few bytes of their index rows would leave the reading to one task
    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(n, "archive", "__region").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return ranges.mapInArrow(run, kinds)


def archived_pages(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Writes all rows and reads all back: id, payload_bytes, payload_digest, record_type, refers_to."""
    index = write_archives(pages, id_col=id_col, **options)
    kind = pages.schema[id_col].dataType
    return read_records(index, with_payload=False).select(
        F.col("page_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
