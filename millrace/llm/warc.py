"""WARC derivatives: linked metadata and plain-text conversion records from response records.

A response record gives a ``metadata`` record, whose JSON block holds the
source's WARC headers, HTTP status and headers, title, charset and links, and a
``conversion`` record with the page's plain text. Both carry
``WARC-Refers-To`` (the response's record id), its target and date, and the
source's payload digest in the metadata; each names the other, and each has its
own block digest. Record ids are name-based UUIDs of the source's id, so a rerun
gives the same records. Records come and go as raw bytes, one a row;
``split_records`` and ``read_warc`` cut files (plain or gzip members) into
rows and ``gzip_member`` packs a row for a file.

Pages are read in time proportional to their length, however broken: a tag
ends at the next ``>``, what is opened and never closed is searched for once.

Defined results: null html is an empty payload; a null or empty url leaves the
target header out; records that aren't responses, or can't be parsed, give no
derivatives and one row of type ``error`` that says why; repeated records give
repeated rows; an empty table gives none; whole texts are converted, however
long; other columns are carried along, but for those named as in ``OUT``,
which the results replace.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

CHUNK = 1 << 20
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
TYPES = {"metadata": "application/json", "conversion": "text/plain"}
OUT = "record_type string, record_id string, refers_to string, target_uri string, record_date string, block_digest string, payload_digest string, content_length long, record binary, error string"

HIDDEN = re.compile(r"(?i)<!--|<(script|style|head|noscript|template|svg)\b|<!")
CLOSED = {t: re.compile(rf"(?i)</{t}\s*>") for t in ("script", "style", "head", "noscript", "template", "svg")}
BREAKS = re.compile(r"(?i)</?(?:address|article|aside|blockquote|br|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>")
TAGS = re.compile(r"</?[A-Za-z][^>]*>")
BLANKS = re.compile(r"[ \t\r\f\v ]+")
LINES = re.compile(r" ?\n[ \n]*")
TITLE, TITLE_END = re.compile(r"(?i)<title\b[^>]*>"), re.compile(r"(?i)</title\s*>")
LINKED = re.compile(r"(?i)<(a|area|link|img|script|iframe|source|form)\b[^>]*>")
ADDRESS = re.compile(r"""(?i)\s(?:href|src|action)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
META = re.compile(rb"(?i)<meta\b[^>]*>")
CHARSET = re.compile(rb"""(?i)charset\s*=\s*["']?([A-Za-z0-9_:.-]+)""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _headers(lines: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and out:  # a folded line
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip().decode(errors='replace')}")
        elif b":" in line:
            k, _, v = line.partition(b":")
            out.append((k.strip().decode(errors="replace"), v.strip().decode(errors="replace")))
    return out


def parse_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """The headers, in order, and the block of one record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not sep or not version.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = _headers(lines)
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    if not length.isdigit() or int(length) > len(rest):
        raise ValueError("bad Content-Length")
    return headers, rest[: int(length)]


def _inflated(data: bytes):
    """The contents of gzip members, piece by piece."""
    rest = memoryview(data)
    member = zlib.decompressobj(31)
    while len(rest):
        piece, rest = rest[:CHUNK], rest[CHUNK:]
        while len(piece):
            yield member.decompress(piece)
            if not member.eof:
                break
            yield member.flush()
            piece = memoryview(member.unused_data)
            member = zlib.decompressobj(31)


def split_records(data: bytes):
    """The raw records of a file, plain or in gzip members; of these no more is held than a record and a piece."""
    held, ended = b"", False
    pieces = _inflated(data) if data[:2] == b"\x1f\x8b" else iter([data])
    want = 0  # bytes that make it worth looking again
    while not ended:
        parts, size = [held], len(held)
        while size <= want and not ended:
            piece = next(pieces, None)
            ended = piece is None
            parts.append(piece or b"")
            size += len(parts[-1])
        held, at, want = b"".join(parts), 0, 0
        while (start := held.find(b"WARC/", at)) >= 0:
            end = held.find(b"\r\n\r\n", start)
            if end < 0:
                at = start
                break
            length = next((v for k, v in _headers(held[start:end]) if k.lower() == "content-length"), "0")
            stop = end + 4 + (int(length) if length.isdigit() else 0)
            if stop > len(held) and not ended:
                at, want = start, stop - start
                break
            yield held[start:stop] + b"\r\n\r\n"
            at = stop
        held = held[at:]
        want = max(want, len(held))


def gzip_member(record: bytes) -> bytes:
    return gzip.compress(record, mtime=0)


def response_record(url: str | None, html: str | None, date: str) -> bytes:
    """A response record with these contents, as a crawler would have written it."""
    payload = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    own = uuid.uuid5(SPACE, f"{url or ''} {date} {digest(payload)}")
    target = [("WARC-Target-URI", " ".join(url.split()))] if url and url.strip() else []
    return record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{own}>"), ("WARC-Date", date), *target, ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def decode(payload: bytes, content_type: str) -> tuple[str, str]:
    """The payload as text and the charset used: the header's, the page's own, or UTF-8 and else Latin-1."""
    named = re.search(r"charset=[\"']?([A-Za-z0-9_:.-]+)", content_type, re.I)
    own = next((c[1].decode() for m in META.finditer(payload[: payload.rfind(b">") + 1]) if (c := CHARSET.search(m[0]))), None)
    for name in [named and named[1], own, "utf-8"]:
        if name:
            try:
                return payload.decode(name), name.lower()
            except (LookupError, UnicodeDecodeError):
                pass
    return payload.decode("latin-1"), "latin-1"


def _shown(page: str) -> str:
    """The page without comments, declarations and elements that aren't shown, a blank for each."""
    out, at, pos, open_ = [], 0, 0, set()
    while m := HIDDEN.search(page, pos):
        kind, stop = (m[1] or m[0]).lower(), -1
        if kind == "<!--":
            if kind not in open_ and (end := page.find("-->", m.end())) >= 0:
                stop = end + 3
            else:
                open_.add(kind)
                kind = "<!"
        if kind == "<!":
            if kind not in open_ and (end := page.find(">", m.end())) >= 0:
                stop = end + 1
        elif stop < 0 and kind not in open_ and (close := CLOSED[kind].search(page, m.end())):
            stop = close.end()
        if stop < 0:
            open_.add(kind)
            pos = m.end()
            continue
        out.append(page[at : m.start()])
        at = pos = stop
    return " ".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """The visible text: blocks on lines of their own, white space collapsed, character references resolved."""
    page = _shown(page).replace("\n", " ")
    tags = page.rfind(">") + 1
    page = TAGS.sub("", BREAKS.sub("\n", page[:tags])) + page[tags:]
    return LINES.sub("\n", BLANKS.sub(" ", entities.unescape(page))).strip()


def _title(page: str) -> str | None:
    end = TITLE_END.search(page)
    if not end:
        return None
    start = TITLE.search(page[: end.start()])
    return BLANKS.sub(" ", entities.unescape(page[start.end() : end.start()])).strip() if start else None


def _page_links(page: str, target: str) -> list[dict]:
    links = []
    for m in LINKED.finditer(page[: page.rfind(">") + 1]):
        found = ADDRESS.search(m[0])
        url = entities.unescape(next((x for x in found.groups() if x is not None), "")).strip() if found else ""
        if url and not url.startswith("#"):
            try:
                url = urljoin(target, url)
            except ValueError:
                pass
            links.append({"tag": m[1].lower(), "url": url})
    return links


def derivatives(record: bytes) -> list[tuple[str, str, str, list[tuple[str, str]], bytes]]:
    """(type, record id, refers to, headers, block) of the metadata and the conversion of one response record."""
    headers, block = parse_record(record)
    named = {k.lower(): v for k, v in headers}
    if named.get("warc-type", "").lower() != "response":
        raise ValueError("not a response")
    source = named.get("warc-record-id", "")
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP response")
    status, _, lines = head.partition(b"\r\n")
    http = _headers(lines)
    page, charset = decode(payload, next((v for k, v in http if k.lower() == "content-type"), ""))
    target = named.get("warc-target-uri", "")
    ids = {kind: f"<urn:uuid:{uuid.uuid5(SPACE, f'{source} {kind}')}>" for kind in TYPES}
    payload_digest = named.get("warc-payload-digest") or digest(payload)
    envelope = {
        "warc": [list(x) for x in headers],
        "http": {"status": status.decode(errors="replace"), "headers": [list(x) for x in http]},
        "payload": {"digest": payload_digest, "computed_digest": digest(payload), "length": len(payload), "charset": charset},
        "html": {"title": _title(page), "links": _page_links(page, target)},
        "conversion": ids["conversion"],
    }
    blocks = {"metadata": json.dumps(envelope, ensure_ascii=False).encode(errors="replace"), "conversion": plain_text(page).encode(errors="replace")}
    out = []
    for kind, data in blocks.items():
        other = ids["conversion" if kind == "metadata" else "metadata"]
        own = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", named.get("warc-date", "")), *([("WARC-Target-URI", target)] if target else []), ("WARC-Refers-To", source), *([("WARC-Refers-To-Target-URI", target)] if target else []), ("WARC-Refers-To-Date", named.get("warc-date", "")), ("WARC-Concurrent-To", other), ("WARC-Block-Digest", digest(data)), ("WARC-Source-Payload-Digest", payload_digest), ("Content-Type", TYPES[kind])]
        out.append((kind, ids[kind], source, own, data))
    return out


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", date_col: str | None = None) -> DataFrame:
    """``pages`` with the response record of each row as ``record``, in place of url and html."""
    small_batches(pages.sparkSession)
    rest = [c for c in pages.columns if c not in (url_col, html_col, date_col, "record")]
    date = F.date_format(F.col(date_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = pages.select(*rest, F.col(url_col).alias("__url"), F.col(html_col).alias("__html"), F.coalesce(date, F.lit("1970-01-01T00:00:00Z")).alias("__date"))
    n = len(rest)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [response_record(*x) for x in zip(*[batch.column(n + i).to_pylist() for i in range(3)], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(made, pa.binary())], names=[*rest, "record"])

    return rows.mapInArrow(run, rows.select(*rest).schema.add("record", "binary"))


def derive(records: DataFrame, record_col: str = "record") -> DataFrame:
    """The derived records of each response, one a row, after the other columns of ``records``: see ``OUT``."""
    small_batches(records.sparkSession)
    added = [x.split()[0] for x in OUT.split(", ")]
    rest = [c for c in records.columns if c != record_col and c not in added]
    rows = records.select(*rest, F.col(record_col).alias("__record"))
    n = len(rest)

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64() if c == "content_length" else pa.binary() if c == "record" else pa.string() for c in added]
        for batch in batches:
            place, out = [], []
            for i, data in enumerate(batch.column(n).to_pylist()):
                try:
                    made = derivatives(data or b"")
                except ValueError as e:
                    place.append(i)
                    out.append(("error", *[None] * 8, str(e)))
                    continue
                for kind, own, source, headers, block in made:
                    named = dict(headers)
                    place.append(i)
                    out.append((kind, own, source, named.get("WARC-Target-URI"), named["WARC-Date"], named["WARC-Block-Digest"], named["WARC-Source-Payload-Digest"], len(block), record_bytes(headers, block), None))
            kept = batch.take(pa.array(place, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:n], *[pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]], names=[*rest, *added])

    schema = rows.select(*rest).schema
    for x in OUT.split(", "):
        schema = schema.add(*x.split())
    return rows.mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, record) of every record in WARC files, plain or gzip; a file is read by one task."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for record in split_records(data):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([record], pa.binary())], names=["path", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, record binary")
