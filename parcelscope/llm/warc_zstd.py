"""WARC archives in Zstandard frames: writer and reader.

Layout of an archive: a leading skippable frame that holds the dictionary
(trained on the archive's own first records, a bounded number of bytes),
then one Zstandard frame per WARC record.  The reader streams an archive
frame by frame, loads the dictionary from the skippable frame, decodes one
record per frame and checks version, required headers, block length, record
end, HTTP length and payload digest; the first fault raises, naming archive
and record.

Of records with equal payloads (SHA-1 and length) of at least
``revisit_min_bytes`` that with the smallest id is a response, the others are
revisits that refer to it; smaller ones are all responses.

Recovery: a task names its archives after its attempt and lists them in the
manifest it returns, which Spark writes; files of a lost attempt are in no
manifest and so are never read.  Tasks write through ``pyarrow.fs``, so the
folder is a URI every executor can reach.

Edge cases.  A null payload is empty.  A null URL writes no target URI.  Of
rows that repeat the smallest id with an equal payload each is a response.  A
row with a null id is a revisit when a row with an id has its payload.  An
empty table makes no archive and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.llm.common import scratch_path, slices, stored, table

# Fixed values of the WARC 1.1 and WARC-Zstandard formats.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICT_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
ZSTD_DICT = 0xEC30A437
RECORD_END = b"\r\n\r\n"

ARCHIVE_BYTES = 64 << 20        # an archive is closed at this size
DICT_SAMPLE = 1 << 20           # bytes of records a dictionary is trained on
DICT_BYTES = 32 << 10
MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = ("path string, record_id string, record_type string, target_uri string, refers_to string, "
           "payload_digest string, payload_bytes bigint, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _safe(value: str) -> str:
    """A header value on one line, reversible for a URI."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None,
           date: str) -> bytes:
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
            + str(len(payload)).encode() + b"\r\n\r\n")
    block = http if refers_to else http + payload
    head = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"),
            ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", _safe(url)))
    if refers_to:
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + RECORD_END


class _Archive:
    """One open archive; holds back the first records to train on them."""

    def __init__(self, uri: str, level: int):
        self.uri, self.level, self.records, self.bytes = uri, level, 0, 0
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        self.first: list[bytes] | None = []
        self.first_bytes = 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _start(self) -> None:
        held, self.first = self.first, None
        trained = None
        try:
            trained = zstandard.train_dictionary(DICT_BYTES, held)
        except zstandard.ZstdError:
            pass            # too few records to train on: the archive has no dictionary
        if trained:
            raw = trained.as_bytes()
            self._write(DICT_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
        self.pack = zstandard.ZstdCompressor(level=self.level, dict_data=trained,
                                             write_checksum=True, write_content_size=True)
        for data in held:
            self._write(self.pack.compress(data))

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.first is None:
            self._write(self.pack.compress(data))
            return
        self.first.append(data)
        self.first_bytes += len(data)
        if self.first_bytes >= DICT_SAMPLE:
            self._start()

    def close(self) -> tuple[str, int, int]:
        if self.first is not None:
            self._start()
        self.out.close()
        return self.uri, self.records, self.bytes


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", revisit_min_bytes: int = 0, level: int = 3,
                   date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row under ``folder``; returns the written
    manifest ``(path, records, bytes)``."""
    body = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
                        body.alias("body"), F.sha1(body.cast("binary")).alias("sha"),
                        F.octet_length(body).alias("size"))
    # only payloads that occur again; ids and hashes alone are shuffled
    firsts = stored(base.where(F.col("size") >= revisit_min_bytes).groupBy("sha", "size")
                    .agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
                    .where("copies > 1").drop("copies"), "first_payloads")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        done, archive = [], None
        for part in slices(batches, 2):
            columns = (part.column(k).to_pylist() for k in range(5))
            for page, url, text, sha, first in zip(*columns):
                payload = text.encode("utf-8", "surrogatepass")
                digest = base64.b32encode(bytes.fromhex(sha)).decode("ascii")
                refers = f"urn:page:{first}" if first is not None and first != page else None
                if archive is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst"
                    archive = _Archive(f"{folder}/{name}", level)
                archive.add(record(f"urn:page:{'' if page is None else page}", url, payload, digest, refers, date))
                if archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    joined = base.join(firsts, ["sha", "size"], "left").select("id", "url", "body", "sha", "first_id")
    return stored(joined.mapInArrow(run, MANIFEST), "warc_manifest")


class _Frames:
    """Whole Zstandard and skippable frames of a byte stream, one at a time."""

    def __init__(self, stream):
        self.stream, self.buffer, self.at = stream, b"", 0

    def _have(self, n: int) -> bool:
        """At least n bytes from ``at`` on are in the buffer."""
        if len(self.buffer) - self.at < n:
            parts, size = [self.buffer[self.at:]], len(self.buffer) - self.at
            while size < n and (more := self.stream.read(max(n - size, 1 << 20))):
                parts.append(more)
                size += len(more)
            self.buffer, self.at = b"".join(parts), 0
        return len(self.buffer) - self.at >= n

    def _need(self, n: int) -> None:
        if not self._have(n):
            raise ValueError("archive ends inside a frame")

    def _int(self, offset: int, width: int) -> int:
        return int.from_bytes(self.buffer[self.at + offset:self.at + offset + width], "little")

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        while self._have(1):
            self._need(8)
            magic = self._int(0, 4)
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                end = 8 + self._int(4, 4)
                self._need(end)
            elif magic == ZSTD_FRAME:
                end = self._data_frame()
            else:
                raise ValueError(f"no frame starts with {magic:#x}")
            yield magic, self.buffer[self.at:self.at + end]
            self.at += end

    def _data_frame(self) -> int:
        flags = self._int(4, 1)
        single = flags >> 5 & 1
        content = (single, 2, 4, 8)[flags >> 6]
        end = 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + content
        last = False
        while not last:
            self._need(end + 3)
            block = self._int(end, 3)
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
        self._need(end)
        return end


def parse(data: bytes) -> dict:
    """Checked fields of one record."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not cut or lines[0].encode() != VERSION:
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(": ")
        if not colon or key.lower() in fields:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[key.lower()] = value
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in fields:
            raise ValueError(f"no {key}")
    size = fields["content-length"]
    if not size.isdigit() or len(rest) != int(size) + len(RECORD_END) or not rest.endswith(RECORD_END):
        raise ValueError("the block's length differs from Content-Length")
    out = {"record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"],
           "target_uri": fields.get("warc-target-uri"), "refers_to": None, "payload": None,
           "payload_bytes": None, "payload_digest": None}
    if out["record_type"] not in ("response", "revisit"):
        return out
    http, cut, payload = rest[:-len(RECORD_END)].partition(b"\r\n\r\n")
    lengths = [x[16:] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")]
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if not cut or not http.startswith(b"HTTP/") or len(lengths) != 1 or algorithm != "sha1":
        raise ValueError("no HTTP block with a length, or no payload digest")
    out |= {"payload_bytes": int(lengths[0]), "payload_digest": digest}
    if out["record_type"] == "revisit":
        if payload or "warc-refers-to" not in fields or fields.get("warc-profile") != REVISIT_PROFILE:
            raise ValueError("a revisit has a payload, no target or another profile")
        return out | {"refers_to": fields["warc-refers-to"].strip("<>")}
    if len(payload) != out["payload_bytes"] or base32_sha1(payload) != digest:
        raise ValueError("the payload differs from its length or digest")
    return out | {"payload": payload}


def read_stream(stream) -> Iterator[dict]:
    """Records of one archive, in order."""
    opened = None
    for k, (magic, frame) in enumerate(_Frames(stream)):
        if magic != ZSTD_FRAME:
            if k == 0 and magic == DICT_FRAME:
                raw = frame[8:]
                if raw[:4] == ZSTD_FRAME.to_bytes(4, "little"):
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                if raw[:4] != ZSTD_DICT.to_bytes(4, "little"):
                    raise ValueError("the leading frame holds no dictionary")
                opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            continue
        opened = opened or zstandard.ZstdDecompressor()
        # a frame without its content size is decoded as a stream
        yield parse(opened.decompressobj().decompress(frame))


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives named in ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.binary() if f.endswith("binary") else pa.int64() if f.endswith("bigint") else pa.string()
                 for f in RECORDS.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t)
                                               for n, t in zip(names, kinds)], names)

        for part in batches:
            for uri in part.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    records = read_stream(stream)
                    while True:
                        try:
                            found = next(records, None)
                        except (ValueError, zstandard.ZstdError) as fault:
                            raise ValueError(f"{uri}: after record {rows[-1]['record_id'] if rows else '-'}: "
                                             f"{fault}") from fault
                        if found is None:
                            break
                        if not with_payload:
                            found["payload"] = None
                        rows.append(found | {"path": uri})
                        size += len(found["payload"] or b"")
                        if len(rows) >= 2000 or size >= 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    paths = manifest.select("path")
    return paths.repartition(max(1, min(10_000, paths.count()))).mapInArrow(run, RECORDS)


def op5_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))

    def page(column: str):
        return F.nullif(F.substring_index(column, ":", -1), F.lit("")).cast("bigint")

    return (read_archives(manifest, with_payload=False)
            .select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    page("refers_to").alias("refers_to")))
