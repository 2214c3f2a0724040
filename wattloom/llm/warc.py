"""WARC archives of pages, with revisit records, and a reader that salvages damage.

Archives are rows (archive, content) of a table: Spark commits them, so a lost executor
or a repeated task leaves no half archive, and any store that Spark can write to will do.
Each content is a complete gzip WARC file (one member a record) that other tools read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.session import cut, scratch, ship

#: Payloads with fewer bytes are never stored as revisits.
MIN_REVISIT = 100
#: An archive is closed at this size; compressed bytes.
ARCHIVE_BYTES = 8_000_000
#: Bytes given to the decompressor at once: it copies what is left over.
FEED = 1 << 14
#: The same at the start of what may be no member at all.
FIRST = 256
#: Bytes of a name or comment in a member's header.
NAME = 1 << 14
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD = "archive string, position long, size long, inner long, inner_size long, gap string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[%\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html of every row with revisit and refers_to.

    Of rows with equal payloads of at least MIN_REVISIT bytes the smallest page_id is the
    response. Only (digest, page_id) pairs of larger page_ids are joined back, by page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    ids = cut(rows.where((F.octet_length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull()).select("digest", "page_id").distinct())
    first = cut(ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to"))
    later = ids.join(first, "digest").where("page_id > refers_to").select("page_id", F.col("digest").alias("of"), "refers_to")
    joined = rows.join(later.withColumnRenamed("page_id", "later"), (F.col("page_id") == F.col("later")) & (F.col("digest") == F.col("of")), "left")
    return joined.select("page_id", "url", "payload", F.col("later").isNotNull().alias("revisit"), "refers_to")


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write the records of pages as archives to a table at path, and return that table."""
    spark = pages.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        first, size = "", 0

        def archive() -> pa.RecordBatch:
            content = b"".join(parts)
            name = f"pages-{first}-{hashlib.sha256(content).hexdigest()[:16]}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                first = first or str(page_id)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                parts.append(packer.compress(record(page_id, url, payload, refers_to, revisit)) + packer.flush())
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    parts, first, size = [], "", 0
        if parts:
            yield archive()

    plan(pages).mapInArrow(run, "archive string, content binary").write.parquet(path)
    return spark.read.parquet(path)


_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
#: What ends a header: a blank line, or the version line of the next record where it is broken.
_HEADER_END = re.compile(rb"\r?\n\r?\n|WARC/1\.[01]\r?\n")
_MEMBER = b"\x1f\x8b\x08"
_FIELD = re.compile(rb"(?:WARC|Content|X)-[A-Za-z-]+:[^\x00-\x1f]*\r\n", re.I)
_SIZES = {"md5": 16, "sha1": 20, "sha256": 32, "sha384": 48, "sha512": 64}


def known_digest(value: str) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a labelled digest, in hex, base32 or base64 (told apart by length
    and alphabet); no bytes where the value is none of them, as no data has that digest. None
    for another algorithm or no label: that can't be checked."""
    kind, _, text = value.partition(":")
    kind, text = kind.strip().lower().replace("-", ""), text.strip().rstrip("=")
    size = _SIZES.get(kind)
    if not size:
        return None
    if len(text) == 2 * size and re.fullmatch("[0-9a-fA-F]+", text):
        return kind, bytes.fromhex(text)
    if len(text) == -(-8 * size // 5) and re.fullmatch("[A-Za-z2-7]+", text):
        return kind, base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    if len(text) == -(-4 * size // 3) and re.fullmatch("[A-Za-z0-9+/]+", text):
        return kind, base64.b64decode(text + "=" * (-len(text) % 4))
    return kind, b""


def _fits(digest: tuple[str, bytes] | None, data: bytes) -> bool | None:
    """Whether data has the digest; None where that can't be checked."""
    return hashlib.new(digest[0], data).digest() == digest[1] if digest else None


def _parse(raw: bytes, start: int, strict: bool = False) -> tuple[int, dict | None, str]:
    """The record of raw at start: its end, its fields, or None and what failed.

    The block's digest decides; the payload's only where there is none of the block (crawlers
    differ in what they take for the payload of a chunked answer). strict is for bytes whose
    own check failed: fields must be whole, a known digest must be there."""
    m = _VERSION.match(raw, start)
    if not m:
        return start, None, "no version line"
    split = _HEADER_END.search(raw, m.end())
    if not split or split[0].startswith(b"WARC"):
        return start, None, "no end of header"
    head: dict[str, str] = {}
    for line in raw[m.end() : split.start()].splitlines():
        key, _, value = line.partition(b":")
        head[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch("[0-9]{1,18}", head.get("content-length", "")):
        return start, None, "no length"
    end = split.end() + int(head["content-length"])
    if end > len(raw):
        return start, None, "cut short"
    block = raw[split.end() : end]
    whole = _fits(known_digest(head.get("warc-block-digest", "")), block)
    if whole is False:
        return start, None, "block digest"
    kind = head.get("warc-type")
    http, payload = b"", block
    if head.get("content-type", "").startswith("application/http") or kind in ("response", "revisit") and block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    revisit = kind == "revisit"
    named = known_digest(head.get("warc-payload-digest", ""))
    right = None if revisit or re.search(rb"(?im)^transfer-encoding:", http) else _fits(named, payload)
    if whole is None and right is False:
        return start, None, "payload digest"
    if strict:
        fields = raw[m.end() : split.start()] + b"\r\n"
        if "".join(f.decode("latin-1") for f in _FIELD.findall(fields)) != fields.decode("latin-1"):
            return start, None, "header"
        if whole is None:
            return start, None, "no digest"
    number = lambda k: int(head[k]) if re.fullmatch(r"-?\d{1,18}", head.get(k, "")) else None
    tail = re.compile(rb"(?:\r?\n){0,2}").match(raw, end)
    url = head.get("warc-target-uri")
    sha = named[1].hex() if named and named[0] == "sha256" and (revisit or right) else None if revisit else hashlib.sha256(payload).hexdigest()
    return tail.end(), {
        "page_id": number("x-page-id"),
        "url": None if url is None else re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), url),
        "record_type": kind,
        "payload_bytes": int(size[1]) if size and (revisit or int(size[1]) == len(payload)) else None if revisit else len(payload),
        "payload_digest": sha,
        "refers_to": number("x-refers-to-page"),
        "payload": None if revisit else payload,
    }, ""


def _opens_member(content: bytes, pos: int) -> bool:
    """Whether a gzip header stands at pos: no reserved flags, names of at most NAME bytes."""
    if not content.startswith(_MEMBER, pos) or len(content) < pos + 10 or content[pos + 3] & 0xE0:
        return False
    flags, at = content[pos + 3], pos + 10
    if flags & 4:
        at += 2 + int.from_bytes(content[at : at + 2], "little")
    for flag in (8, 16):
        if flags & flag:
            at = content.find(b"\0", at, at + NAME) + 1
            if not at:
                return False
    return True


def _unpack(content: bytes, pos: int) -> tuple[bytes, int, str]:
    """What the gzip member at pos holds as far as it can be read, where reading ended, and
    what failed."""
    unpack = zlib.decompressobj(31)
    parts: list[bytes] = []
    end = pos
    try:
        while end < len(content) and not unpack.eof:
            step = FEED if end > pos else FIRST
            parts.append(unpack.decompress(content[end : end + step]))
            end = min(len(content), end + step)
    except zlib.error:
        # the failed step gave nothing: read up to it again, and then byte by byte
        unpack = zlib.decompressobj(31)
        unpack.decompress(content[pos:end])
        try:
            while end < len(content):
                parts.append(unpack.decompress(content[end : end + 1]))
                end += 1
        except zlib.error:
            pass
        return b"".join(parts), end, "member"
    return b"".join(parts), end - len(unpack.unused_data), "" if unpack.eof else "member cut short"


def _inside(raw: bytes, failed: str) -> Iterator[tuple[int, int, dict | None, str]]:
    """(start, end, fields, failure) of the records and gaps in a member's bytes; failed is
    why the bytes end early."""
    at, gap_at, why = 0, None, ""
    while at < len(raw):
        end, fields, failure = _parse(raw, at, failed == "member")
        if fields is None:
            if gap_at is None:
                gap_at, why = at, failure
            version = _VERSION.search(raw, at + 1)
            at = version.start() if version else len(raw)
            continue
        if gap_at is not None:
            yield gap_at, at, None, why
            gap_at = None
        yield at, end, fields, ""
        at = end
    if failed or gap_at is not None:
        yield len(raw) if gap_at is None else gap_at, len(raw), None, failed or why


class _Search:
    """Where the search in an archive goes on. Members and version lines are looked for once:
    a place that was found ahead, or that there is none, holds for later searches."""

    def __init__(self, content: bytes):
        self.content = content
        self.member = self.version = 0

    def members(self, at: int) -> int:
        if self.member < at:
            found = self.content.find(_MEMBER, at)
            self.member = found if found >= 0 else len(self.content)
        return self.member

    def versions(self, at: int) -> int:
        if self.version < at:
            found = _VERSION.search(self.content, at)
            self.version = found.start() if found else len(self.content)
        return self.version

    def after(self, pos: int, end: int, seen: set[bytes]) -> int:
        """The next member or version line after a broken member at pos that was read until
        end, which may be past its own end. Of records that stand before end as they are,
        those with digests in seen are the member's own (stored blocks)."""
        at = pos + 1
        while True:
            member, start = self.members(at), self.versions(at)
            if member <= start or start >= end:
                return min(member, start)
            at, fields, _ = _parse(self.content, start)
            if fields and hashlib.sha256(self.content[start:at].rstrip()).digest() not in seen:
                return start
            at = max(at, start + 1)


def salvage(content: bytes) -> Iterator[dict]:
    """Every record of an archive, plain or gzip, and every quarantined gap of bytes.

    After a failed check the search goes on, one byte behind the start of the failed
    record, at the next gzip member or version line; later records are recovered. Inside a
    member the same search runs over its decompressed bytes, also over those read before
    the member broke off or failed its check sum: there a record needs right digests and
    whole header fields, and a wrong byte in a field's value shows in the member's gap row
    alone. A gap has position, size and the first failure as gap; records and gaps inside a
    member have the member's position and size, and their own place in its decompressed
    bytes as inner and inner_size. All other fields of a gap are None."""
    pos, gap_at, why = 0, None, ""
    search = _Search(content)
    while pos < len(content):
        rows: list[dict] = []
        if _opens_member(content, pos):
            raw, end, broken = _unpack(content, pos)
            inside = list(_inside(raw, broken))
            failure = broken or next((f for *_, f in inside if f), "")
            if any(fields for _, _, fields, _ in inside):
                rows = [{"inner": a, "inner_size": z - a, "gap": f or None} | (fields or {}) for a, z, fields, f in inside]
            if broken:
                end = search.after(pos, end, {hashlib.sha256(raw[a:z].rstrip()).digest() for a, z, fields, _ in inside if fields})
        else:
            end, fields, failure = _parse(content, pos)
            if fields:
                rows = [{"gap": None} | fields]
            else:
                end = search.after(pos, pos, set())
        if rows and gap_at is not None:
            yield {"position": gap_at, "size": pos - gap_at, "gap": why}
            gap_at = None
        if not rows and gap_at is None and failure:
            gap_at, why = pos, failure
        for row in rows:
            yield {"position": pos, "size": end - pos} | row
        pos = end
    if gap_at is not None:
        yield {"position": gap_at, "size": len(content) - gap_at, "gap": why}


def read_archives(archives: DataFrame) -> DataFrame:
    """Records and gaps of archives (archive, content): see RECORD and salvage(). Null or
    empty contents give no rows. Any source of named binary contents will do, such as
    spark.read.format("binaryFile")."""
    ship(archives.sparkSession)
    names = [f.split()[0] for f in RECORD.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[dict] = []
                for row in salvage(content.as_py() or b""):
                    rows.append(row | {"archive": name})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds)], names=names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds)], names=names)

    return archives.select("archive", "content").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the shared folder and read every record back: page_id,
    payload_bytes, payload_digest, record_type, refers_to; one row per row of pages. A gap in
    what was just written is an error.

    A null html is an empty payload. A null page_id is never revisited nor revisits. Rows
    that repeat page_id and payload have the same type. Extra columns are ignored; an
    empty table gives no rows."""
    read = read_archives(write_archives(pages, scratch(pages.sparkSession, "warc")))
    lost = F.concat(F.lit("gap in "), "archive", F.lit(" at "), F.col("position").cast("string"), F.lit(": "), "gap")
    checked = F.when(F.col("gap").isNotNull(), F.raise_error(lost)).otherwise(F.col("record_type"))
    return read.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")
