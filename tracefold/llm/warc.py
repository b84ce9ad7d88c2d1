"""Content-addressed archive of web records.

A WARC record is its header block, its payload and the mark that ends it. Payload bytes are stored once for each SHA-256
digest; header blocks and marks are stored for every record, byte for byte. Joined by digest, the two give back each
original record exactly. Records come from .warc and .warc.gz files, or are made of the pages of a table.

Scale: which record brings a payload is settled on (digest, key), so bytes are not shuffled to find the
distinct ones; reconstruction shuffles each stored payload once, and the headers, by digest. A payload that
very many records share is one row on its side of the join, and AQE splits the records' side. Files are read as streams,
one record at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CRLF = "\r\n"
_END = b"\r\n\r\n"
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
_NEXT = re.compile(rb"WARC/\d")


def header(page_id: Column, url: Column, digest: Column, size: Column) -> Column:
    """The header block of a page's record, with the blank line that ends it."""
    lines = [
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.concat(F.lit("Content-Length: "), size.cast("string")),
    ]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF + _CRLF))


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, header, payload, tail) of each page with a page_id: a null html is a payload of no bytes, a null url an empty target."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    block = header(F.col("page_id"), F.col("url"), F.sha2("payload", 256), F.octet_length("payload"))
    return rows.select("page_id", F.encode(block, "UTF-8").alias("header"), "payload", F.lit(_END).alias("tail"))


def store(records: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """(payloads, headers) of records (key..., header, payload, tail): payloads(digest, stored_by, payload), headers(key..., digest, header, tail, size).

    Of records with the same payload the one of least key stores it. Null payloads count as empty. Repeated rows are records
    of their own. Should two payloads of different length have one digest, neither is stored, so that reconstruction stops.
    """
    rows = records.withColumn("payload", F.coalesce("payload", F.lit(b""))).select(*key, "header", "tail", "payload", F.sha2("payload", 256).alias("digest"))
    headers = rows.select(*key, "digest", "header", "tail", F.octet_length("payload").alias("size"))
    first = headers.groupBy("digest").agg(F.min(F.struct(*key)).alias("stored_by"), F.min("size").alias("least"), F.max("size").alias("most")).where("least = most").select("digest", "stored_by")
    payloads = rows.withColumn("stored_by", F.struct(*key)).join(first, ["digest", "stored_by"]).select("digest", "stored_by", "payload").dropDuplicates(["digest"])
    return payloads, headers


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``store`` of a table of pages by page_id; reads page_id, url and html. Empty tables give empty tables."""
    return store(page_records(pages), "page_id")


def restored(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """``headers`` with stored_by and record, the original bytes, the payload checked against its digest and length.

    A record whose stored payload is missing or doesn't match stops the query.
    """
    both = headers.join(payloads, "digest", "left")
    good = F.coalesce((F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("size")), F.lit(False))
    record = F.when(good, F.concat("header", "payload", "tail")).otherwise(F.raise_error(F.concat(F.lit("payload doesn't match digest "), "digest")))
    return both.select(*headers.columns, "stored_by", record.alias("record"))


def reconstruct(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """(page_id, digest, stored_by, size, record): every original record of ``archive``, as text."""
    return restored(payloads, headers).select("page_id", "digest", F.col("stored_by.page_id").alias("stored_by"), "size", F.decode("record", "UTF-8").alias("record"))


def write_archive(payloads: DataFrame, headers: DataFrame, path: str) -> None:
    """Writes both tables below ``path``, payloads in folders by the first two characters of their digests, over which they spread evenly."""
    payloads.withColumn("folder", F.substring("digest", 1, 2)).repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/payloads")
    headers.write.mode("overwrite").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.option("basePath", f"{path}/payloads").parquet(f"{path}/payloads").drop("folder"), spark.read.parquet(f"{path}/headers")


class _Stream:
    """The bytes of a plain or gzipped file, members one after the other, of which only what is asked for is held."""

    def __init__(self, file, step: int = 1 << 20) -> None:
        self.file, self.step, self.held, self.over = file, step, bytearray(), False
        first = file.read(2)
        self.gz = zlib.decompressobj(31) if first == b"\x1f\x8b" else None
        self._take(first)

    def _take(self, data: bytes) -> None:
        while self.gz is not None and data:
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            self.held += self.gz.decompress(data)
            data = self.gz.unused_data
        self.held += data

    def more(self) -> bool:
        data = self.file.read(self.step)
        self.over = not data
        self._take(data)
        return not self.over

    def upto(self, n: int) -> bytes:
        """The next n bytes, or all that there are."""
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def before(self, what: re.Pattern) -> bytes:
        """All up to where the pattern begins, or the end."""
        while not (m := what.search(self.held)) and self.more():
            pass
        return self.upto(m.start() if m else len(self.held))


def records_of(file) -> Iterator[tuple[bytes, bytes, bytes]]:
    """(header, payload, tail) of each record; joined they are the file's bytes, whatever is wrong with them.

    The header ends with its blank line; the payload is as long as Content-Length says, or none; the tail is all before the next record.
    """
    s = _Stream(file)
    blank = re.compile(rb"\r?\n\r?\n")
    while True:
        while not (m := blank.search(s.held)) and s.more():
            pass
        head = s.upto(m.end() if m else len(s.held))
        if not head:
            return
        size = _LENGTH.search(head)
        yield head, s.upto(int(size.group(1)) if size else 0), s.before(_NEXT)


def parse_warc(spark: SparkSession, path: str, batch_bytes: int = 16 << 20) -> DataFrame:
    """(path, record_no, header, payload, tail) of the records in .warc and .warc.gz files below ``path``, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["path", "record_no", "header", "payload", "tail"])

        for b in batches:
            for name in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", name))
                out, held = [], 0
                with system.open_input_stream(at, compression=None) as file:
                    for k, r in enumerate(records_of(file)):
                        out.append((name, k, *r))
                        held += sum(map(len, r))
                        if held >= batch_bytes:
                            yield batch(out)
                            out, held = [], 0
                if out:
                    yield batch(out)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "path string, record_no int, header binary, payload binary, tail binary")


ARCHIVE_SQL = """
WITH r AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
d AS (SELECT *, sha256(html) AS digest, CAST(octet_length(encode(html)) AS INT) AS size FROM r)
SELECT page_id, digest, min(page_id) OVER (PARTITION BY digest) AS stored_by, size,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
  || 'WARC-Payload-Digest: sha256:' || digest || chr(13) || chr(10) || 'Content-Length: ' || size || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
FROM d
"""
