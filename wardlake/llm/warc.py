"""WARC archives: a writer with revisit records and a splittable reader.

Archives are gzip files with one member per record, as crawlers write them. The reader needs no
index: an archive is cut into byte ranges, and the task of a range looks for the gzip magic number,
validates each candidate by decoding the record's header from it, and owns exactly the records
whose member starts inside its range. From an owned record the next one follows directly; only
where a chain breaks off (a range's begin, or bytes that are no member) is the magic looked for
again. Members are decoded as streams and may reach beyond the range.

The writer puts pages into archives by partition. A task writes under a name of its own attempt and
returns it in a manifest; only names in the committed manifest are read, so tasks that were lost,
repeated or run twice leave no double records. Both sides use the file system that the path names
(local or mounted folders, HDFS, S3, GCS), through Arrow.

A payload inside a member could only be taken for a record if it held a whole gzip member with a
WARC header, uncompressed. Page payloads are UTF-8, where the magic's second byte cannot follow
its first.

Defined cases: null html is an empty payload; a null url leaves out the target header; a null id is
written as such and never referred to while an equal payload has one; rows with equal ids stay
separate records, and if theirs is the id referred to, all are responses; an empty table gives no
records; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm.store import stored
from wardlake.session import scratch_path

MIN_REVISIT = 0  # payloads of fewer bytes are always stored whole
SPLIT_BYTES = 4 << 20
RANGES_PER_TASK = 8
ARCHIVE_BYTES = 256 << 20  # a task begins another archive beyond this
SALTS = 16
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 256 << 10

RECORD = (
    "path string, offset long, record_type string, page_id long, url string, refers_to long,"
    " payload_bytes long, payload_digest string, payload binary"
)


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(text: str) -> str:
    """A header value: no line breaks, which would end it."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
                 revisit: bool) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    header = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        "WARC-Date: 2024-04-01T00:00:00Z",
    ]
    if url is not None:
        header.append(f"WARC-Target-URI: {_line(url)}")
    header.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        header += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    header += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(header).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:", path) else (fs.LocalFileSystem(), path)


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Add ``refers_to``: the largest id with an equal payload, where that is another row's.

    Groups of equal payloads are reduced before the shuffle, and the one row left of each is put
    beside its pages under several salts, so that a payload of very many pages is not one task's.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
                         F.unhex(F.sha1(html)).alias("_digest"))
    long_enough = F.octet_length("html") >= min_revisit
    groups = keyed.where(long_enough).groupBy("_digest").agg(
        F.max("page_id").alias("_last"), F.count("*").alias("_n")
    )
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    groups = groups.where("_n > 1").select("_digest", "_last", F.explode(salts).alias("_salt"))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    other = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return salted.join(groups, ["_digest", "_salt"], "left").select(
        "page_id", "url", "html", F.when(other, F.col("_last")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write all pages below ``folder``; returns the manifest (``path``, ``bytes``, ``records``)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        name = out = None
        size = records = 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch[c] for c in batch), strict=True):
                if out is None:
                    name, size, records = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                revisit = not pd.isna(refers_to)
                raw = record_bytes(
                    None if pd.isna(page_id) else int(page_id), url, html.encode(),
                    int(refers_to) if revisit else None, revisit,
                )
                out.write(raw)
                size, records = size + len(raw), records + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [records]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "bytes": [size], "records": [records]})

    chosen = with_revisits(pages, min_revisit).select(
        F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string")
    )
    manifest = chosen.mapInPandas(write, "path string, bytes long, records long")
    return stored(manifest, "warc-manifest")


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives at a path or pattern (``path``, ``bytes``); contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return found.select("path", F.col("length").alias("bytes"))


@dataclass
class Member:
    offset: int
    size: int
    content: bytes


class ArchiveRange:
    """The records of one archive whose members start in ``begin .. end - 1``."""

    def __init__(self, source, length: int, begin: int, end: int):
        self.source, self.length, self.begin, self.end = source, length, begin, min(end, length)

    def _read(self, at: int, size: int) -> bytes:
        return self.source.read_at(min(size, self.length - at), at) if at < self.length else b""

    def _validate(self, at: int) -> bool:
        """Whether a member with a WARC record starts here, by decoding the start of its header."""
        unpacker = zlib.decompressobj(31)
        head = b""
        try:
            while len(head) < 5 and not unpacker.eof:
                raw = self._read(at, 512)
                if not raw:
                    break
                head += unpacker.decompress(raw, 64)
                at += len(raw)
        except zlib.error:
            return False
        return head.startswith(b"WARC/")

    def _find(self, at: int) -> int | None:
        """The next validated member start in the range, from ``at`` on."""
        while at < self.end:
            # The magic may begin in the range and end behind it.
            raw = self._read(at, min(_CHUNK, self.end - at) + len(MAGIC) - 1)
            place = raw.find(MAGIC)
            while place >= 0:
                if at + place < self.end and self._validate(at + place):
                    return at + place
                place = raw.find(MAGIC, place + 1)
            at += max(1, len(raw) - len(MAGIC) + 1)
        return None

    def _decode(self, start: int) -> Member:
        unpacker, parts, at = zlib.decompressobj(31), [], start
        while not unpacker.eof:
            raw = self._read(at, _CHUNK)
            if not raw:
                raise EOFError(f"the member at {start} is cut off")
            parts.append(unpacker.decompress(raw))
            at += len(raw)
        return Member(start, at - len(unpacker.unused_data) - start, b"".join(parts))

    def members(self) -> Iterator[Member]:
        at = self._find(self.begin)
        while at is not None:
            member = self._decode(at)
            yield member
            at += member.size
            if at < self.end and not self._validate(at):
                at = self._find(at)
            elif at >= self.end:
                at = None


def _number(record_id: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return found[1] if found else None


def parse_record(content: bytes) -> dict:
    """Header fields and payload of a decoded member; payload figures are checked for responses."""
    head, _, block = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = block[:int(fields.get("content-length", len(block)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields.get("warc-type") == "revisit"
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size = len(payload)
    if revisit:
        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(told[1]) if told else 0
    elif digest and digest != payload_digest(payload):
        raise ValueError(f"payload digest of {fields.get('warc-record-id')} does not match")
    url = fields.get("warc-target-uri")
    return {
        "record_type": fields.get("warc-type"),
        "page_id": _number(fields.get("warc-record-id")),
        "url": None if url is None else _unline(url),
        "refers_to": _number(fields.get("warc-refers-to")),
        "payload_bytes": size,
        "payload_digest": digest or payload_digest(payload),
        "payload": None if revisit else payload,
    }


def read_archives(
    archives: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True
) -> DataFrame:
    """All records of the archives (``path``, ``bytes``), read by ranges of ``split_bytes``.

    Ranges are rows, dealt out evenly; a record belongs to the range its member starts in.
    Records come back once each, in no particular order. Without ``payload`` that column is null.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, length, begin in zip(batch["path"], batch["bytes"], batch["begin"], strict=True):
                system, name = _open(path)
                rows, held = [], 0
                with system.open_input_file(name) as source:
                    for member in ArchiveRange(source, length, begin, begin + split_bytes).members():
                        row = {"path": path, "offset": member.offset, **parse_record(member.content)}
                        if not payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(member.content) if payload else 512
                        if held >= 8 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows)

    last = F.greatest(F.col("bytes") - 1, F.lit(0))
    ranges = archives.select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split_bytes).cast("long"))).alias("begin")
    )
    text_ids = RECORD.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")
    # Rows that describe ranges are tiny, so the number of tasks is told by the bytes behind them.
    wanted = F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / split_bytes)
    number = archives.agg(F.sum(wanted)).first()[0] or 1
    dealt = ranges.repartition(-(-int(number) // RANGES_PER_TASK), F.xxhash64("path", "begin"))
    records = dealt.mapInPandas(read, text_ids)
    return records.withColumn("page_id", F.col("page_id").cast("long")).withColumn(
        "refers_to", F.col("refers_to").cast("long")
    )


def _frame(rows: list[dict]) -> pd.DataFrame:
    names = [part.split()[0] for part in RECORD.split(", ")]
    return pd.DataFrame(rows, columns=names).astype(object)


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write all pages to archives in the shared folder and read the records back."""
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, min_revisit)
    return read_archives(manifest, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
