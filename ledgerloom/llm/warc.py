"""Derivatives of WARC responses: metadata and plain-text conversion records that refer to them.

A response record is parsed into its WARC headers, HTTP status, HTTP headers and body. For each response there is a
``metadata`` record with a JSON block (envelope, headers, title, links) and, if the body is HTML or text, a ``conversion``
record with the plain text. Both carry WARC-Refers-To, the source's target URI and date, and digests of their own block;
the metadata keeps the source headers and compares the payload digest that the response declares with the payload's.

Digests are taken over the body as it was sent; title, links and text come from the body with its transfer and content
encodings undone, read in the character set that the header, a byte order mark or the page itself names.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_map

CRLF = b"\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs (RFC 4122)
# Elements whose content is not text, and elements that begin a line.
HIDDEN = frozenset("script style noscript template title".split())
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav aside blockquote pre form main body html td th dd dt dl hr figure figcaption".split())
TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
TAG = re.compile(r"<(?:[^>\"'=]|=\s*+(?:\"[^\"]*\"|'[^']*')|[=\"'])*+>")
BLANKS = re.compile(r"\s+")
HREF = re.compile(r"\shref\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
GZIP = b"\x1f\x8b"
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))
CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)
SCHEMA = (
    "record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length bigint, "
    "block_digest string, source_payload_digest string, source_digest_ok boolean, source_status int, source_headers map<string,string>, n_links int, error string, block string"
)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same id for the same parts: a record that is made again replaces itself."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF * 2 + block + CRLF * 2


def response_record(source: str, uri: str, body: bytes, date: str) -> bytes:
    """A response record around a page."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(body)]) + CRLF * 2 + body
    uri = BLANKS.sub("%20", uri)
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", source, uri)), ("WARC-Target-URI", uri), ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http)),
    ], http)


def parse_headers(lines: list[bytes]) -> dict[str, str]:
    """Names in lower case; folded lines join the one before; of repeated names the values are joined by commas."""
    out, name = {}, None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, found, rest = data.partition(CRLF * 2)
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    headers = parse_headers(head.split(CRLF)[1:])
    length = headers.get("content-length", "")
    if not length.isdigit() or int(length) > len(rest):
        raise ValueError("block shorter than its length")
    return headers, rest[: int(length)]


def parse_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    head, found, body = block.partition(CRLF * 2)
    lines = head.split(CRLF)
    status = re.match(rb"HTTP/\S+ (\d{3})", lines[0])
    if not found or not status:
        raise ValueError("no HTTP header")
    return int(status[1]), parse_headers(lines[1:]), body


def unchunked(body: bytes) -> bytes:
    """A chunked body put together. Trailers are left out."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        size = re.fullmatch(rb"\s*([0-9a-fA-F]{1,15})\s*(?:;[^\n]*)?", body[at:end]) if 0 <= end else None
        if not size:
            raise ValueError("chunked body without a chunk size")
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n
        if len(out[-1]) < n or body[at : at + 2] != CRLF:
            raise ValueError("chunk shorter than its size")
        at += 2


def members(data: bytes, bits: int, most: int) -> tuple[list[bytes], int]:
    """(pieces of unpacked data, where packed data ends) of zlib data, or of gzip members one after the other."""
    out, at = [], 0
    while at < len(data):
        member, size = zlib.decompressobj(bits), 1 << 12
        while not member.eof and at < len(data):
            block = data[at : at + size]
            try:
                out.append(member.decompress(block))
            except zlib.error:
                raise ValueError("packed data that cannot be unpacked") from None
            at += len(block) - len(member.unused_data)
            most -= len(out[-1])
            if most < 0:
                raise ValueError("unpacked data longer than the bound")
            size = min(2 * size, 1 << 16)
        if not member.eof:
            raise ValueError("packed data cut short")
        if data[at : at + 2] != GZIP:
            break
    return out, at


def inflated(body: bytes, most: int) -> bytes:
    """A gzip (one or more members), zlib or raw deflate body."""
    if body[:2] == GZIP:
        return b"".join(members(body, 31, most)[0])
    try:
        return b"".join(members(body, 15, most)[0])
    except ValueError:
        return b"".join(members(body, -15, most)[0])


def unpacked(http: dict[str, str], body: bytes, most: int) -> bytes:
    """The body with its transfer and content encodings undone, the last applied first."""
    for header in ("transfer-encoding", "content-encoding"):
        for coding in reversed([x.strip().lower() for x in http.get(header, "").split(",")]):
            if coding == "chunked":
                body = unchunked(body)
            elif coding in ("gzip", "x-gzip", "deflate") and body:
                body = inflated(body, most)
            elif coding not in ("", "identity", "gzip", "x-gzip", "deflate"):
                raise ValueError(f"content encoding {coding}")
    return body


def decoded(data: bytes, content_type: str, is_html: bool) -> str:
    """Text in the character set of a byte order mark, the header, or the page's first meta element with one; else UTF-8."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    named = CHARSET.search(content_type)
    if not named and is_html:
        # ASCII bytes stand for themselves in what a meta element can name
        named = next((found for name, tag, _, _ in tags(data.decode("latin-1")) if name == "meta" and (found := CHARSET.search(tag))), None)
    try:
        return data.decode(named[1] if named else "utf-8", "replace")
    except (LookupError, UnicodeError):
        return data.decode("utf-8", "replace")


def tags(page: str) -> Iterator[tuple[str, str, int, int]]:
    """(name in lower case, tag, start, end) of every tag in page order; end tags have a slash before the name.

    Comments and declarations come as names ``!``; for elements of ``HIDDEN`` the end is that of their end tag or of the page.
    Time grows with the page, however malformed: what was once looked for in vain is not looked for again.
    """
    last, at, quotes = page.rfind(">"), 0, True
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield "!", "", at, end
        elif page[at + 1] in "!?":
            end = page.find(">", at) + 1
            yield "!", "", at, end
        elif found := TAG_NAME.match(page, at):
            tag = TAG.match(page, at) if quotes else None
            if not tag:  # a quote that never ends
                quotes = False
            end = tag.end() if tag else page.find(">", at) + 1
            name = found[1].lower()
            if page[at + 1] == "/":
                yield "/" + name, page[at:end], at, end
            elif name in HIDDEN:
                closing = re.compile(rf"</{name}(?![^\s/>])", re.I).search(page, end)
                stop = page.find(">", closing.end()) + 1 if closing else 0
                yield name, page[at : closing.start() if closing else len(page)], at, stop or len(page)
                end = stop or len(page)
            else:
                yield name, page[at:end], at, end
        else:
            end = at + 1
        at = end


def read_page(page: str) -> tuple[str, str | None, list[str]]:
    """(text, title, links). A line for each block, white space inside a line as one blank, character references decoded."""
    parts, title, links, at = [], None, [], 0
    for name, tag, start, end in tags(page):
        parts.append(page[at:start].replace("\0", ""))
        at = end
        if name.lstrip("/") in BREAKS:
            parts.append("\0")
        elif name == "title" and title is None:
            title = BLANKS.sub(" ", html.unescape(tag[tag.find(">") + 1 :])).strip()
        elif name == "a" and (found := HREF.search(tag)):
            links.append(html.unescape(found[1] or found[2] or found[3] or ""))
    parts.append(page[at:].replace("\0", ""))
    lines = (BLANKS.sub(" ", x).strip() for x in "".join(parts).split("\0"))
    text = "\n".join(x for x in lines if x)
    return html.unescape(text) if "&" in text else text, title, links


def derivatives(data: bytes | None, most: int = 1 << 28) -> list[dict]:
    """The records derived from one record. Other types than responses have none; what cannot be parsed gives an error row.

    A body whose encoding cannot be undone, or that is longer than ``most`` bytes then, has a metadata record that says so
    in ``error``, and no conversion.
    """
    blank = dict.fromkeys(x.split()[0] for x in SCHEMA.replace("map<string,string>", "map").split(", "))
    try:
        headers, block = parse_record(data or b"")
        if headers.get("warc-type") != "response":
            return []
        status, http, body = parse_http(block)
    except ValueError as e:
        return [blank | {"record_type": "error", "error": str(e)}]
    source, uri, date = headers.get("warc-record-id", ""), headers.get("warc-target-uri", ""), headers.get("warc-date", "")
    kind = http.get("content-type", "").split(";")[0].strip().lower()
    is_html = kind in ("text/html", "application/xhtml+xml")
    wanted = is_html or kind.startswith("text/")
    text = title = error = None
    links = []
    try:
        text = decoded(unpacked(http, body, most), http.get("content-type", ""), is_html) if wanted else None
    except ValueError as e:
        error = str(e)
    if is_html and text is not None:
        text, title, links = read_page(text)
    actual = digest(body)
    declared = headers.get("warc-payload-digest")
    common = blank | {
        "refers_to": source, "target_uri": uri, "warc_date": date, "source_payload_digest": actual, "source_status": status,
        "source_digest_ok": None if declared is None else declared == actual, "source_headers": list(http.items()), "n_links": len(links), "error": error,
    }
    meta = {
        "envelope": {"warc-headers": headers, "payload-digest": actual, "digest-ok": common["source_digest_ok"]},
        "response": {"status": status, "headers": http, "body-length": len(body)},
        "html": {"title": title, "links": links},
    }
    out = [("metadata", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True))]
    if text is not None:
        out.append(("conversion", "text/plain", text))
    rows = []
    for name, content, body_text in out:
        data = body_text.encode("utf-8", "replace")
        rows.append(common | {"record_type": name, "record_id": record_id(name, source, uri), "content_type": content, "content_length": len(data), "block_digest": digest(data), "block": body_text})
    return rows


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(key, warc) response records of a table of pages. NULL url and page count as empty."""
    text = F.coalesce(F.col(page).cast("string"), F.lit(""))

    def make():
        def step(batch):
            made = [response_record(str(k), u, b, date) for k, u, b in zip(batch.column(key).to_pylist(), batch.column("uri").to_pylist(), batch.column("body").to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(key), pa.array(made, pa.binary())], [key, "warc"])

        return step

    rows = pages.select(key, F.coalesce(F.col(url).cast("string"), F.lit("")).alias("uri"), text.cast("binary").alias("body"))
    return arrow_map(rows, make, f"{key} {dict(pages.dtypes)[key]}, warc binary", "body")


def derive(records: DataFrame, key: str = "page_id", warc: str = "warc") -> DataFrame:
    """Derived records of every response in ``records``: the key, then the columns of ``SCHEMA``.

    Records of other types have no derivatives. A record that cannot be parsed, NULL and empty ones among them, gives one
    row of type ``error``. Of a body whose encoding cannot be undone there is only the metadata, with the reason in
    ``error``. Equal records give equal rows.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    types = [kinds[x.split()[1]] for x in SCHEMA.split(", ")]

    def make():
        def step(batch):
            made = [derivatives(x) for x in batch.column("warc").to_pylist()]
            at = pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int64())
            rows = [r for rows in made for r in rows]
            return pa.RecordBatch.from_arrays([batch.column("key").take(at), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, types))], [key, *names])

        return step

    return arrow_map(records.select(F.col(key).alias("key"), F.col(warc).alias("warc")), make, f"{key} {dict(records.dtypes)[key]}, {SCHEMA}", "warc")


def split_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of a WARC file, plain or of gzip members; offsets count unpacked bytes.

    What does not begin a record, or is cut short, is given as it stands up to the end of the file, and so is a whole file
    that cannot be unpacked: :func:`derive` makes an error row of it.
    """
    if data[:2] == GZIP:
        try:
            parts, end = members(data, 31, 1 << 31)
            data = b"".join([*parts, data[end:]])
        except ValueError:
            yield 0, data
            return
    at = 0
    while at < len(data):
        if data.startswith(CRLF, at):  # blank lines between records
            at += 2
            continue
        head = data.find(CRLF * 2, at)
        length = parse_headers(data[at:head].split(CRLF)[1:]).get("content-length", "") if head >= 0 and data.startswith(b"WARC/", at) else ""
        end = head + 4 + int(length) if length.isdigit() else len(data)
        yield at, data[at:end]
        at = end


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, warc) of every record in WARC files, for :func:`derive` with ``offset`` or another key.

    A file, unpacked, is held by one task, so files should be some 100 MB at most. Empty files have no records.
    """

    def task(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = list(split_records(data.as_py() or b""))
                for i in range(0, len(found), 256):
                    some = found[i : i + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(some)), pa.array([x for x, _ in some], pa.int64()), pa.array([x for _, x in some], pa.binary())], ["path", "offset", "warc"]
                    )

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(task, "path string, offset bigint, warc binary")


def write_records(derived: DataFrame, path: str) -> None:
    """Write derived records as WARC files: Spark's text files whose line end is the end of a record."""
    end = "\r\n"
    header = F.concat_ws(
        end, F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: "), "record_id"),
        F.concat(F.lit("WARC-Refers-To: "), "refers_to"), F.concat(F.lit("WARC-Target-URI: "), "target_uri"), F.concat(F.lit("WARC-Date: "), "warc_date"),
        F.concat(F.lit("Content-Type: "), "content_type"), F.concat(F.lit("WARC-Block-Digest: "), "block_digest"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")),
    )
    derived.where("record_type != 'error'").select(F.concat(header, F.lit(end * 2), "block").alias("value")).write.option("lineSep", end * 2).text(path)
