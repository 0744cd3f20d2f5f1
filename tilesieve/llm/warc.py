"""WARC: a writer with revisit records, and a reader that salvages damaged files.

Writing. A payload's digest is its SHA-256. Of payloads that are equal and have
at least ``least`` bytes, the row with the smallest id is a response, the others
are revisits that refer to it. The few payloads with over a ``HEAVY``-th of all
rows (counted with map-side combine, ``HEAVY`` of them at most) get their
smallest id by broadcast, so their rows never meet in one task; the others meet
their digest's smallest id in a join that buffers no payload. Every record is a gzip member of its own. Spark's text writer
writes the members, with an empty gzip member (or, uncompressed, the record end
CR LF CR LF) where it would put line ends: valid archives on any file system,
committed as any Spark output, so a lost executor leaves no half file.
``records_per_file`` bounds the records of a file and ``BYTES_PER_FILE`` its bytes, as
long payloads go to files of fewer records, and with them what the reader holds.

Reading. Each file, plain or gzip, is parsed record by record. A record whose
head, length, end mark, member check, block digest or payload digest is wrong is
not trusted (digests of SHA-1, SHA-2 and MD5 are checked, in hexadecimal or base 32): the reader searches all that follows for a version line that parses
or a gzip member that inflates to one, whichever comes first, recovers what
follows, and logs the bytes between as a quarantined gap with its reason. What a
damaged member gave before the damage is read too.

Edge cases: null html is an empty payload; null urls are written as urn:page
uris; blanks and control characters in urls are percent-encoded; repeated rows
with the smallest id are all responses, ties cannot arise otherwise; null ids
are written without an id and read back as null; very long payloads are records as
any other, up to what a row can hold; an empty table gives no files
and no rows; other columns are ignored, whatever their names. Payloads are
written and digested whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilesieve.llm.common import map_rows
from tilesieve.plans.shared import fresh_path, materialize

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
HEAVY = 512
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 1000
BYTES_PER_FILE = 1 << 29
EMPTY_MEMBER = gzip.compress(b"", 9, mtime=0)
MAGIC = b"\x1f\x8b\x08"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_breaks = re.compile("[\\x00-\\x20\\x7f]")


def record_id(page: int | None) -> str:
    h = hashlib.md5(f"page:{page}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record without its end mark."""
    uri = _breaks.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page}"
    head = HTTP.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-ID", "" if page is None else str(page)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[5:5] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def digest_of(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """``(id, url, html, digest, refers_to)``; a null ``refers_to`` means a response."""

    @F.pandas_udf(T.BinaryType())
    def digest(html):
        return html.map(lambda t: hashlib.sha256(t.encode()).digest())

    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", digest("html")).withColumn("long", F.octet_length("html") >= least)
    keyed = materialize(rows.select("id", "digest", "long"), "payloads")
    sizes = keyed.where("long").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    heavy = F.broadcast(materialize(sizes.where(F.col("n") > max(32, keyed.count() // HEAVY)).select("digest", "first"), "heavy"))
    columns = ["id", "url", "html", "digest", F.when(F.col("long") & (F.col("id") != F.col("first")), F.col("first")).alias("refers_to")]
    at_once = rows.join(heavy, "digest", "left").where("first is not null or not long").select(columns)
    again = sizes.where("n > 1").select("digest", "first").join(heavy.select("digest"), "digest", "left_anti")
    rest = rows.where("long").join(heavy, "digest", "left_anti").join(again, "digest", "left").select(columns)
    return at_once.union(rest)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, compressed: bool = True, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record for each row below ``path``."""

    def start():
        def step(ids, urls, texts, digests, refers):
            out = []
            for page, url, text, digest, first in zip(ids, urls, texts, digests, refers):
                data = record(page, url, text.encode(), digest.hex(), first)
                out.append(gzip.compress(data + END, 6, mtime=0) if compressed else data)
            return [out]

        return step

    size = F.octet_length(F.col(html_col).cast("string"))
    longest = pages.agg(F.max(size)).first()[0] or 0
    low = BYTES_PER_FILE // records_per_file
    separator = (EMPTY_MEMBER if compressed else END).decode("latin-1")
    planned = plan_records(pages, id_col, url_col, html_col, least)
    # payloads up to 512 KB, then up to 16 times as much each time, in files of fewer records
    bounds = [0, low]
    while bounds[-1] < longest:
        bounds.append(bounds[-1] * 16)
    for k, (above, upto) in enumerate(zip(bounds, bounds[1:])):
        own = F.octet_length("html")
        some = planned if len(bounds) == 2 else planned.where(own <= upto if k == 0 else (own > above) & (own <= upto))
        rows = map_rows(some, "record binary", start).select(F.col("record").cast("string").alias("value"))
        each = records_per_file if k == 0 else max(1, BYTES_PER_FILE // upto)
        rows.write.options(lineSep=separator, encoding="ISO-8859-1", maxRecordsPerFile=each).mode("append").text(path)


class Damage(Exception):
    """A failed check; ``sound`` is what was read of a member before it."""

    def __init__(self, why: str, sound: bytes = b""):
        super().__init__(why)
        self.sound = sound


def differs(given: str, data: bytes) -> bool:
    """Whether a digest field, in hexadecimal or base 32, is that of other data; kinds not known are let pass."""
    kind, _, value = given.partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha256", "sha512"):
        return False
    own = hashlib.new(kind, data).digest()
    return value.lower() != own.hex() and value.upper().rstrip("=") != base64.b32encode(own).decode().rstrip("=")


def _parse(data: bytes, at: int) -> tuple[int, dict]:
    """The record at ``at``: its end and what it says."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise Damage("no version line")
    body = data.find(END, at)
    if body < 0:
        raise Damage("head without end")
    fields = {}
    for line in data[at:body].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("head line without a colon")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise Damage("no length")
    body += 4
    end = body + int(size)
    if data[end : end + 4] != END:
        raise Damage("no end mark after the block")
    block = data[body:end]
    kind = fields.get("warc-type", "")
    out = {"kind": kind, "uri": fields.get("warc-target-uri"), "page_id": None, "refers_to": None, "payload": None, "payload_bytes": None, "payload_digest": None}
    for field, key in (("x-page-id", "page_id"), ("x-refers-to-page-id", "refers_to")):
        if re.fullmatch(r"-?\d{1,19}", fields.get(field, "")):
            out[key] = int(fields[field])
    if differs(fields.get("warc-block-digest", ""), block):
        raise Damage("block digest differs")
    given = fields.get("warc-payload-digest", "")
    own = given[7:] if given.startswith("sha256:") else None
    if kind in ("response", "revisit"):
        split = block.find(END)
        if block.startswith(b"HTTP/") and split < 0:
            raise Damage("http head without end")
        http, payload = (block[: split + 2], block[split + 4 :]) if block.startswith(b"HTTP/") else (b"", block)
        if kind == "response":
            if differs(given, payload):
                raise Damage("payload digest differs")
            out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest_of(payload)}
        else:
            said = re.search(rb"(?im)^content-length:\s*(\d+)\r$", http)
            out |= {"payload_bytes": int(said[1]) if said else None, "payload_digest": own}
    return end + 4, out


def _inflate(data: bytes, at: int) -> tuple[int, bytes]:
    """The gzip member at ``at``: its end and contents."""
    stream, out, view, p = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not stream.eof and p < len(data):
            out.append(stream.decompress(view[p : p + 65536]))
            p += 65536
    except zlib.error as e:
        raise Damage(f"gzip: {e}", b"".join(out)) from None
    if not stream.eof:
        raise Damage("gzip member without end", b"".join(out))
    return min(p, len(data)) - len(stream.unused_data), b"".join(out)


_starts = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def _next(data: bytes, at: int, inside: bool) -> int:
    """Where the next good record, or gzip member that is empty or inflates to records, begins, or the end."""
    for found in _starts.finditer(data, at):
        try:
            if found[0] != MAGIC:
                _parse(data, found.start())
                return found.start()
            if inside:
                continue
            inner = _inflate(data, found.start())[1]
            if not inner or inner.startswith(b"WARC/"):
                return found.start()
        except Damage:
            pass
    return len(data)


def salvage(data: bytes, inside: bool = False) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record) and, for quarantined gaps, (start, end, reason), in order.

    Nothing is taken from how a file begins: each place is a record or a member by itself; ``inside`` a member there are records only.
    """
    at = 0
    while at < len(data):
        try:
            if not inside and data.startswith(MAGIC, at):
                end, inner = _inflate(data, at)
                for _, _, found in salvage(inner, True):
                    yield at, end, found
            else:
                end, found = _parse(data, at)
                yield at, end, found
        except Damage as why:
            end = _next(data, at + 1, inside)
            for _, _, found in salvage(why.sound, True):
                if isinstance(found, dict):
                    yield at, end, found
            yield at, end, str(why)
        at = end


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """``(file, start, end, kind, uri, page_id, refers_to, payload_bytes, payload_digest, reason[, payload])``.

    Gaps have the kind ``gap`` and a reason; ``kind != 'gap'`` are the records.
    """
    columns = ["file", "start", "end", "kind", "uri", "page_id", "refers_to", "payload_bytes", "payload_digest", "reason"] + ["payload"] * payloads
    schema = "file string, start bigint, end bigint, kind string, uri string, page_id bigint, refers_to bigint, payload_bytes bigint, payload_digest string, reason string" + ", payload binary" * payloads

    def start():
        def step(paths, contents):
            rows = []
            for name, data in zip(paths, contents):
                for a, b, found in salvage(data):
                    gap = isinstance(found, str)
                    known = {"file": name, "start": a, "end": b, "reason": found if gap else None} | ({"kind": "gap"} if gap else found)
                    rows.append([known.get(c) for c in columns])
            return list(map(list, zip(*rows))) if rows else [[] for _ in columns]

        return step

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return map_rows(files, schema, start)


def round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """Write the archives, read them back: ``(id, payload_bytes, payload_digest, record_type, refers_to)``."""
    path = path or fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, html_col, least)
    found = read_archives(pages.sparkSession, path).where("kind in ('response', 'revisit')")
    return found.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
