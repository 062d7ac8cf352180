"""Web archives: a writer with revisit records and a salvage reader.

The writer makes one gzip member per record. Spark's text writer puts them into the files of the shared folder, with an
empty gzip member as line separator, so every file is a plain concatenation of members and no executor needs a file
system library of its own. The reader takes whole files, checks each record, and after a failed check looks for the
next place at which a valid member or version line starts; the bytes between are logged as a quarantined gap. The same
search runs inside a member's text, also where the member is cut or damaged and only its start can be expanded; a gap
inside a member has the member's place in the file and its own place in the text.

Records of WARC 0.10 to 1.9 are known, header lines may be folded, and a body that is chunked is decoded where its payload
digest is of the decoded body, or where it has none. A payload digest that fits neither form is a mark on the record
(``note``), not a gap, as its other checks hold; only in a damaged member is it one. In a member that expands to more than
is held, a record of over ``most`` bytes is streamed past its digests: it is a record without a payload.

Defined results: a null html is an empty payload; a null id is carried (in a group of equal payloads null ids revisit
the smallest id); of repeated rows all with the group's smallest id are responses; control characters in a URL are
percent-encoded, a null URL gives no target header; a very long page is one record, held whole by one task; other columns
are dropped; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import arrow_map, slices

_MAGIC = b"\x1f\x8b\x08"
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
_VERSION = re.compile(rb"WARC/(?:0\.1[0-9]|1\.[0-9])\r\n")
_START = re.compile(_VERSION.pattern + rb"|\x1f\x8b\x08")
_VERSION_BYTES = 11
#: Bytes in which the headers of a record and of its HTTP message must end.
_HEADERS = 16 << 20
_FEED = 16_384
_EXPANDED = 1 << 20
_ONCE = frozenset(["warc-type", "warc-record-id", "content-length", "content-type", "warc-date", "warc-block-digest", "warc-payload-digest"])
_ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_DAMAGED = "bad gzip member"


class Record(NamedTuple):
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes | None  # None: too large to be held
    size: int  # bytes of the payload
    sha256: str  # of the payload
    note: str = ""


class Gap(NamedTuple):
    offset: int
    length: int
    reason: str
    inner_offset: int | None = None  # in the member's text, where the rest of the member is read
    inner_length: int | None = None


class Broken(Exception):
    pass


def build_record(kind: str, record_id: str, date: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """An uncompressed record; of a revisit the payload is left out and only described."""
    stored = payload if kind == "response" else b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + stored
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compress(record: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _hash(said: str | None):
    """A hash of the algorithm that a digest names; None where there is no digest, or an unknown algorithm, which is no evidence."""
    try:
        return hashlib.new(said.partition(":")[0].strip().lower()) if said else None
    except ValueError:
        return None


def _is(said: str, found: bytes) -> bool:
    value = said.partition(":")[2].strip().lower()
    return value in (found.hex(), base64.b32encode(found).decode().lower().rstrip("="), base64.b32encode(found).decode().lower())


def _digest_ok(said: str, data: bytes) -> bool:
    h = _hash(said)
    if h is None:
        return True
    h.update(data)
    return _is(said, h.digest())


def _has_digest(headers: dict[str, str]) -> bool:
    """Whether a digest of the record has been checked."""
    return any(_hash(x) for x in (headers.get("warc-block-digest"), headers.get("warc-payload-digest") if headers["warc-type"] == "response" else None))


def _unchunked(body: bytes) -> bytes | None:
    """A chunked body decoded; None where it is not one."""
    parts, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        at = m.end() + size
        if not size:
            return b"".join(parts)
        if body[at : at + 2] != b"\r\n":
            return None
        parts.append(body[m.end() : at])
        at += 2
    return None


_CHUNK = re.compile(rb"([0-9a-fA-F]{1,12})[ \t]*(?:;[^\r\n]*)?\r\n")
_CHUNKED = re.compile(rb"(?i)\r\ntransfer-encoding:[^\r\n]*chunked")
_HTTP_LENGTH = re.compile(rb"(?i)\r\ncontent-length:\s*([0-9]{1,15})")
_DIFFERS = "payload digest differs"


class _More(Exception):
    """The text held ends before the record does."""


def _headers(data: bytes, at: int, whole: bool) -> tuple[dict[str, str], int, int]:
    """Headers of the record that starts at ``at``, where its block starts and the block's length; raises Broken when a check fails."""
    if not (m := _VERSION.match(data, at)):
        if not whole and len(data) - at < _VERSION_BYTES:
            raise _More
        raise Broken("no version line")
    end = data.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        if not whole and len(data) - at < _HEADERS:
            raise _More
        raise Broken("headers do not end")
    headers: dict[str, str] = {}
    name = ""
    for line in data[m.end() : end].decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and name:  # folded
            headers[name] = f"{headers[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("malformed header")
        name = name.strip().lower()
        if name in headers and name in _ONCE:
            raise Broken("header repeated")  # as where a cut record runs into the next one
        headers[name] = value.strip()
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise Broken("required header missing")
    if not re.fullmatch(r"[0-9]{1,15}", size := headers.get("content-length", "")):
        raise Broken("bad content length")
    return headers, end + 4, int(size)


def _http(headers: dict[str, str]) -> bool:
    return headers.get("content-type", "").startswith("application/http")


def _noted(headers: dict[str, str], head: bytes) -> bool:
    """Keep what the HTTP headers say of the length; whether they say that the body is chunked."""
    if m := _HTTP_LENGTH.search(head):
        headers["http-content-length"] = m[1].decode()
    return _CHUNKED.search(head) is not None


def _parse(data: bytes, at: int, whole: bool = True) -> tuple[Record, int]:
    """The record that starts at ``at`` and its end; raises Broken when a check fails, and _More where ``data``, not the whole,
    ends before it."""
    headers, start, size = _headers(data, at, whole)
    stop = start + size
    if stop + 4 > len(data) and not whole:
        raise _More
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Broken("record does not end where its length says")
    block = data[start:stop]
    if (said := headers.get("warc-block-digest")) and not _digest_ok(said, block):
        raise Broken("block digest differs")
    payload, plain = block, None
    if _http(headers):
        cutoff = block.find(b"\r\n\r\n")
        if cutoff < 0:
            raise Broken("HTTP headers do not end")
        payload = block[cutoff + 4 :]
        plain = _unchunked(payload) if _noted(headers, block[:cutoff]) else None
    note = ""
    said = headers.get("warc-payload-digest") if headers["warc-type"] == "response" else None
    if _hash(said) is None:
        payload = payload if plain is None else plain
    elif not _digest_ok(said, payload):
        if plain is not None and _digest_ok(said, plain):
            payload = plain
        else:
            note = _DIFFERS
    return Record(at, stop + 4 - at, headers, payload, len(payload), hashlib.sha256(payload).hexdigest(), note), stop + 4


class _Member:
    """A gzip member, expanded piece by piece; once ``pieces`` has ended, where the member does, and why it stopped early (empty if
    it did not)."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end, self.reason = data, at, at, ""

    def pieces(self) -> Iterator[bytes]:
        z, at = zlib.decompressobj(31), self.at
        while not z.eof:
            if at >= len(self.data) and not z.unconsumed_tail:
                self.reason = "gzip member does not end"
                break
            piece = z.unconsumed_tail or self.data[at : at + _FEED]  # in pieces, as what follows the member is copied each time
            at += 0 if z.unconsumed_tail else len(piece)
            before = z.copy()
            try:
                out = z.decompress(piece, _EXPANDED)
            except zlib.error:
                yield _before_error(before, piece)
                self.reason = _DAMAGED
                break
            yield out
        self.end = at - len(z.unused_data)


def _before_error(z, piece: bytes) -> bytes:
    """What a piece with a damaged byte expands to before it."""
    out = []
    for k in range(len(piece)):
        try:
            out.append(z.decompress(piece[k : k + 1]))
        except zlib.error:
            break
    return b"".join(out)


class _Text:
    """A member's text, of which as much is held as a record needs; ``again`` expands it anew."""

    def __init__(self, held: bytes, again: Callable[[], Iterator[bytes]] | None = None):
        self.held, self.base, self.again, self.whole = held, 0, again, again is None
        self.rest = again() if again else iter(())

    def grow(self) -> bool:
        """Hold about twice as much; False where the text ends."""
        parts, size = [self.held], 0
        for piece in self.rest:
            parts.append(piece)
            size += len(piece)
            if size >= max(len(self.held), _EXPANDED):
                break
        else:
            self.whole = True
        self.held = b"".join(parts)
        return size > 0

    def parse(self, at: int, most: int) -> tuple[Record, int]:
        while True:
            if at - self.base > _EXPANDED:
                self.held, self.base = self.held[at - self.base :], at
            try:
                if not self.whole:
                    headers, start, size = _headers(self.held, at - self.base, False)
                    if size > most:
                        return self.streamed(at, headers, start + self.base, size)
                record, end = _parse(self.held, at - self.base, self.whole)
            except _More:
                self.grow()
                continue
            return record._replace(offset=at), end + self.base

    def streamed(self, at: int, headers: dict[str, str], start: int, size: int) -> tuple[Record, int]:
        """A record whose block is not held: it passes its digests piece by piece."""
        try:
            return self._streamed(at, headers, start, size)
        except Broken:
            self.held, self.base, self.whole, self.rest = b"", 0, False, self.again()  # the search goes on inside it
            self.skip(at)
            raise

    def _streamed(self, at: int, headers: dict[str, str], start: int, size: int) -> tuple[Record, int]:
        end = start + size
        while _http(headers) and (cutoff := self.held.find(b"\r\n\r\n", start - self.base, end - self.base)) < 0:
            if self.base + len(self.held) >= min(end, start + _HEADERS) or not self.grow():
                raise Broken("HTTP headers do not end")
        body = start
        chunked = False
        if _http(headers):
            body = cutoff + 4 + self.base
            chunked = _noted(headers, self.held[start - self.base : cutoff])
        block_said, said = headers.get("warc-block-digest"), headers.get("warc-payload-digest") if headers["warc-type"] == "response" else None
        block, payload, own = _hash(block_said), _hash(said), hashlib.sha256()
        if block:
            block.update(self.held[start - self.base : body - self.base])
        at_byte = body
        while at_byte < end:
            piece = self.held[at_byte - self.base : end - self.base]
            for h in (block, payload, own):
                if h:
                    h.update(piece)
            at_byte += len(piece)
            if at_byte < end:
                self.held, self.base = b"", at_byte
                if not self.grow():
                    raise Broken("record does not end where its length says")
        self.skip(end)
        while len(self.held) < 4 and self.grow():
            pass
        if self.held[:4] != b"\r\n\r\n":
            raise Broken("record does not end where its length says")
        if block and not _is(block_said, block.digest()):
            raise Broken("block digest differs")
        note = "payload not held" + (", still chunked" if chunked else "") + (f", {_DIFFERS}" if payload and not chunked and not _is(said, payload.digest()) else "")
        return Record(at, end + 4 - at, headers, None, end - body, own.hexdigest(), note), end + 4

    def skip(self, at: int) -> None:
        """Let go of what lies before ``at``."""
        while self.base + len(self.held) < at:
            self.base, self.held = self.base + len(self.held), b""
            if not self.grow():
                return
        self.held, self.base = self.held[at - self.base :], at

    def ended(self, at: int) -> bool:
        while at - self.base >= len(self.held):
            if not self.grow():
                return True
        return False

    def next_version(self, at: int) -> int:
        """Where the next version line starts, or the text ends."""
        while True:
            if m := _VERSION.search(self.held, at - self.base):
                return m.start() + self.base
            at = max(at, self.base + len(self.held) - _VERSION_BYTES + 1)
            self.held, self.base = self.held[at - self.base :], at
            if not self.grow():
                return self.base + len(self.held)


def _inside(text: _Text, reason: str, most: int) -> Iterator[Record | tuple[int, int, str]]:
    """The records of a member's text, with offsets in it, and the gaps between them as (offset, length, reason)."""
    at, bad, why = 0, -1, ""
    while not text.ended(at):
        try:
            record, end = text.parse(at, most)
            if reason == _DAMAGED and not _has_digest(record.headers):
                raise Broken("no digest in a damaged member")
            if reason == _DAMAGED and _DIFFERS in record.note:
                raise Broken(_DIFFERS)
        except Broken as e:
            if bad < 0:
                bad, why = at, str(e)
            at = text.next_version(at + 1)
            continue
        if bad >= 0:
            yield bad, at - bad, why
            bad = -1
        yield record
        at = end
    if bad >= 0:
        yield bad, at - bad, reason or why
    elif reason:
        yield at, 0, reason


def salvage(data: bytes, most: int = 256 << 20, held: int = 64 << 20) -> Iterator[Record | Gap]:
    """All records of an archive that pass the checks, and the byte gaps between them, in file order.

    A member may expand to any size: beyond ``held`` bytes it is expanded a second time, record by record, and there a
    record's block of over ``most`` bytes is not held.
    """
    at, bad, reason = 0, -1, ""
    while at < len(data):
        found: Iterator = iter(())
        stopped = ""
        try:
            if data[at : at + 3] == _MAGIC:
                member, parts, size = _Member(data, at), [], 0
                for piece in member.pieces():
                    size += len(piece)
                    parts = [*parts, piece] if size <= held and len(parts) < 64 else [b"".join([*parts, piece])] if size <= held else []
                end, stopped = member.end, member.reason
                text = _Text(b"".join(parts)) if size <= held else _Text(b"", _Member(data, at).pieces)
                found = _inside(text, stopped, most)
                first = list(islice(found, 2))
                if (first or stopped) and not any(isinstance(x, Record) for x in first):
                    raise Broken(stopped or first[0][2])
                if stopped and len(first) == 2 and isinstance(first[0], Record) and first[1][1:] == (0, stopped):
                    raise Broken(stopped)  # a member of one record: its own check is the record's
                found = chain(first, found)
            else:
                record, end = _parse(data, at)
                found = iter([record])
        except Broken as e:
            if bad < 0:
                bad, reason = at, str(e)
            m = _START.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad >= 0:
            yield Gap(bad, at - bad, reason)
            bad = -1
        if stopped:  # where such a member ends is not known: the search goes on after its first bytes
            m = _START.search(data, at + 1)
            end = m.start() if m else len(data)
        for x in found:
            yield x._replace(offset=at, length=end - at) if isinstance(x, Record) else Gap(at, end - at, x[2], x[0], x[1])
        at = end
    if bad >= 0:
        yield Gap(bad, len(data) - bad, reason)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 100, file_bytes: int = 32 << 20, date: str = "1970-01-01T00:00:00Z", broadcast_digests: int = 100_000) -> None:
    """Write one record per row below ``path``; ``file_bytes`` is the aim for a file's uncompressed size.

    Only digests are grouped, and only those of several rows are joined back: by broadcast where there are at most
    ``broadcast_digests`` of them (some 10 MB), so that no payload is shuffled. Beyond that payloads are joined by
    digest, those too short for a revisit left out; a hot digest is split by adaptive skew handling, as nothing above
    the join needs its rows together.
    """
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2(F.col("html"), 256))
    long = F.octet_length("html") >= least_revisit
    mean = base.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    grouped = base.where(long).groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    firsts = cut(grouped.where("rows > 1").select("of", "first"), "digests")
    if firsts.limit(broadcast_digests + 1).count() <= broadcast_digests:
        rows = base.join(F.broadcast(firsts), F.col("digest") == F.col("of"), "left")
    else:
        rows = base.where(long).join(firsts, F.col("digest") == F.col("of"), "left").unionByName(base.where(~long), allowMissingColumns=True)
    rows = rows.select("id", "url", "html", "digest", "first")

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in slices(batches, 256):
            for key, url, html, digest, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                revisit = first is not None and key != first
                name = f"{_ID}{'' if key is None else key}"
                yield (compress(build_record("revisit" if revisit else "response", name, date, url, html.encode(), digest, f"{_ID}{first}" if revisit else None)),)

    schema = T.StructType([T.StructField("member", T.BinaryType())])
    out = arrow_map(rows, members, schema, rows=256).select(F.col("member").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", max(1, int(file_bytes / (mean + 700)))).option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


_READ = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("gap_reason", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("inner_offset", T.LongType()),
        T.StructField("inner_length", T.LongType()),
        T.StructField("note", T.StringType()),
    ]
)


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per record that passes the checks, and one per quarantined gap (``gap_reason`` set, other fields null but, for a
    gap inside a gzip member, ``inner_offset`` and ``inner_length`` in the member's text).

    payload_bytes and payload_digest are of the full payload: a response's are taken from its bytes, a revisit's from
    its headers. ``note`` says where a payload digest differs, or a payload is too large to be a value.
    """
    bare = lambda x: x[1:-1] if x and x[0] == "<" else x

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in slices(batches, 1):
            file, data = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            for x in salvage(data):
                if isinstance(x, Gap):
                    yield file, x.offset, x.length, x.reason, *[None] * 7, x.inner_offset, x.inner_length, None
                    continue
                h = x.headers
                kind = h["warc-type"]
                if kind == "revisit":
                    size, digest = int(h.get("http-content-length", 0)), h.get("warc-payload-digest", "").partition(":")[2]
                else:
                    size, digest = x.size, x.sha256
                yield file, x.offset, x.length, None, kind, bare(h["warc-record-id"]), h.get("warc-target-uri"), bare(h.get("warc-refers-to")), size, digest, x.payload if keep_payload else None, None, None, x.note or None

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return arrow_map(files, read, _READ, rows=256 if keep_payload else 4096)


def page_number(column: str):
    """The id that ``write_archives`` put into a record's name; null where it was null."""
    return F.nullif(F.regexp_extract(column, f"^{_ID}(-?[0-9]*)$", 1), F.lit("")).cast("long")
