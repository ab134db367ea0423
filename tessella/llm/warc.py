"""WARC derivatives: from response records to linked metadata and plain-text conversion records."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_column
from .scratch import stored

#: Of gzip, for records in files of their own. Tables have plain records: Parquet compresses many of them together.
LEVEL = 1
DATE = "2024-01-01T00:00:00Z"
Headers = list[tuple[str, str]]

_NAMES_OF_URLS = uuid.NAMESPACE_URL.bytes
#: Base 32, ten bits at once.
_BASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PAIRS = [a + b for a in _BASE for b in _BASE]

# Elements whose content is no text, and elements that end a line.
_HIDDEN = {"noscript", "template", "head", "svg"}
_BLOCKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul"}

_RAW = {tag: re.compile(f"</{tag}(?=[\\s/>]|$)", re.I) for tag in ("script", "style")}
_TITLE_END = re.compile(r"</title(?=[\s/>]|$)", re.I)
#: A comment, a declaration, or a tag: whether it ends an element, its name, its attributes.
_MARKUP = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)>?)""", re.S)
_LINK = re.compile(r"""(?<![^\s/"'])href\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'>]+))""", re.I)


def digest(data: bytes) -> str:
    n = int.from_bytes(hashlib.sha1(data).digest(), "big")
    return "sha1:" + "".join([_PAIRS[n >> k & 1023] for k in range(150, -1, -10)])


def record_id(*parts: str) -> str:
    """An identifier that the same parts always give, so that a task that runs again writes the same records: a name-based
    (SHA-1) UUID."""
    n = int.from_bytes(hashlib.sha1(_NAMES_OF_URLS + chr(0).join(parts).encode()).digest()[:16], "big")
    h = f"{n & ~(0xF << 76) & ~(0x3 << 62) | 5 << 76 | 2 << 62:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def clean(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(headers: Headers, block: bytes, packed: bool = False) -> bytes:
    """A record, plain or as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {clean(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, LEVEL, mtime=0) if packed else data


def _split(head: bytes) -> tuple[str, Headers]:
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    out: Headers = []
    for line in rest:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return first, out


def get(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record of a file, compressed by records or not. A ValueError where no whole record follows."""
    while data:
        if data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                plain, data = member.decompress(data) + member.flush(), member.unused_data
            except zlib.error as e:
                raise ValueError("a member does not decompress") from e
            if not member.eof:
                raise ValueError("a member does not end")
        else:
            plain, data = data, b""
        at = 0
        while at < len(plain):
            end = plain.find(b"\r\n\r\n", at)
            if end < 0:
                raise ValueError("a record's headers do not end")
            version, headers = _split(plain[at:end])
            told = get(headers, "Content-Length") or ""
            size = int(told) if told.isascii() and told.isdigit() else -1
            if not version.startswith("WARC/") or size < 0 or end + 4 + size > len(plain):
                raise ValueError("no whole WARC record")
            yield headers, plain[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def whole_records(data: bytes) -> tuple[list[tuple[Headers, bytes]], bool]:
    """The records of a file up to the first that is not whole, and whether there is no such."""
    out = []
    try:
        for r in records(data):
            out.append(r)
    except ValueError:
        return out, False
    return out, True


def _value(m: re.Match) -> str:
    return unescape(next((x for x in m.groups() if x is not None), ""))


def plain_text(html: str) -> tuple[str, str, list[str]]:
    """Text by lines without blank ones, title, links in order.

    The markup is scanned once; a tag, a comment or a quoted value that never ends takes the rest of the page. Scripts and
    styles are skipped to their end tags. A title ends at its end tag, or without one at the next tag.
    """
    out, title, links, hidden, at = [], [], [], [], 0

    def told(data):
        if not hidden:
            out.append(unescape(data) if "&" in data else data)

    while m := _MARKUP.search(html, at):
        if m.start() > at:
            told(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if tag in _BLOCKS:
            out.append("\n")
        if m[1]:
            if tag in hidden:
                while hidden.pop() != tag:
                    pass
        elif tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = end.start() if end else len(html)
        elif tag == "title":
            end = _TITLE_END.search(html, at) or _MARKUP.search(html, at)
            title.append(unescape(html[at : end.start() if end else len(html)]))
            at = end.start() if end else len(html)
        elif tag == "body":
            hidden.clear()
        elif tag in _HIDDEN:
            if not m[3].endswith("/"):
                hidden.append(tag)
        elif tag == "a" and (link := _LINK.search(m[3])):
            links.append(_value(link))
    told(html[at:])
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), " ".join(" ".join(title).split()), [x for x in links if x]


def response(url: str, html: str, packed: bool = False) -> bytes:
    """A response record of a page."""
    body = html.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url, digest(block))), ("WARC-Date", DATE), ("WARC-Target-URI", url)]
    return record([*headers, ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body))], block, packed)


def derive(data: bytes, packed: bool = False) -> tuple[bytes, bool]:
    """For each response record, a metadata and a conversion record that refer to it, and whether all of the file could be
    read; other records are passed over, and what follows a record that is not whole is lost.

    Both keep the response's id, URI and date in their refers-to headers. The metadata record lists the digests and the
    HTTP status and headers of the source, its title and links. A response whose digests do not hold gives a metadata
    record that says so, and no conversion.
    """
    out = []
    found, whole = whole_records(data)
    for headers, block in found:
        if get(headers, "WARC-Type") != "response":
            continue
        head, _, body = block.partition(b"\r\n\r\n")
        status, http = _split(head)
        source, url, date = (get(headers, f"WARC-{x}") or "" for x in ("Record-ID", "Target-URI", "Date"))
        told = [(k, v) for k in ("WARC-Block-Digest", "WARC-Payload-Digest") if (v := get(headers, k))]
        good = all(digest(block if k == "WARC-Block-Digest" else body) == v for k, v in told)
        text, title, links = plain_text(body.decode("utf-8", "replace"))
        linked = [("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date)]
        conversion = record_id("conversion", source)
        facts = [("source-status", status), *((f"source-http-{k.lower()}", v) for k, v in http), *((f"source-{k[5:].lower()}", v) for k, v in told), ("digests-hold", str(good).lower()), ("title", title)]
        facts += [("conversion", conversion)] * good + [("outlink", x) for x in links]
        block = "".join(f"{k}: {clean(v)}\r\n" for k, v in facts).encode()
        meta = record_id("metadata", source)
        out.append(record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta), *linked, ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(block))], block, packed))
        if good:
            block = text.encode()
            out.append(record([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion), *linked, ("WARC-Concurrent-To", meta), ("Content-Type", "text/plain; charset=utf-8"), ("WARC-Block-Digest", digest(block))], block, packed))
    return b"".join(out), whole


def responses(pages: DataFrame) -> DataFrame:
    """page_id and ``warc``: a response record of each row of ``pages`` (page_id, url, html). Null is the empty string."""
    url = F.coalesce("url", F.lit(""))
    pair = F.concat(F.char_length(url).cast("string"), F.lit(":"), url, F.coalesce("html", F.lit("")))

    def work(rows):
        pairs = ((int(n), rest) for n, _, rest in (r.partition(":") for r in rows))
        return {"warc": [response(rest[:n], rest[n:]) for n, rest in pairs]}

    return map_column(pages.select("page_id", pair.alias("page")), "page", "warc binary", lambda: work)


def derivatives(files: DataFrame) -> DataFrame:
    """page_id, ``warc``: the derivative records of each row's file, and ``whole``: whether all of the file could be read. A null
    file is an empty one."""

    def work(rows):
        found = [derive(x or b"") for x in rows]
        return {"derived": [x for x, _ in found], "whole": [ok for _, ok in found]}

    out = map_column(files.select("page_id", "warc"), "warc", "derived binary, whole boolean", lambda: work)
    return out.withColumnRenamed("derived", "warc")


_NAMES = ("metadata_id", "conversion_id", "refers_to", "target_uri", "source_status", "source_content_type", "source_payload_digest", "title", "n_links", "n_text_bytes", "text_digest", "text_sha256")


def told(data: bytes) -> tuple:
    """What the derivative records of one file hold, of its first response, in the order of ``_NAMES``; nulls without one. An error
    if a block has another digest than its record says."""
    meta = converted = None
    for headers, block in records(data):
        if get(headers, "WARC-Block-Digest") != digest(block):
            raise ValueError("a derivative record's block has another digest")
        if get(headers, "WARC-Type") == "metadata":
            if meta:
                break
            meta = (headers, _split(b"\r\n" + block)[1])
        else:
            converted = converted or (headers, block)
    if not meta:
        return (None,) * len(_NAMES)
    headers, facts = meta
    own = [get(headers, "WARC-Record-ID"), get(converted[0], "WARC-Record-ID") if converted else None, get(headers, "WARC-Refers-To"), get(headers, "WARC-Target-URI")]
    own += [get(facts, x) for x in ("source-status", "source-http-content-type", "source-payload-digest", "title")]
    text = converted[1] if converted else b""
    return *own, sum(k == "outlink" for k, _ in facts), len(text), get(converted[0], "WARC-Block-Digest") if converted else digest(text), hashlib.sha256(text).hexdigest()


def summary(files: DataFrame) -> DataFrame:
    """What the derivative records of each page hold, as read back; block digests are checked."""

    def work(rows):
        return dict(zip(_NAMES, map(list, zip(*map(told, rows))), strict=True)) if rows else {n: [] for n in _NAMES}

    schema = ", ".join(f"{n} {'long' if n.startswith('n_') else 'string'}" for n in _NAMES)
    return map_column(files, "warc", schema, lambda: work)


def page_derivatives(pages: DataFrame) -> DataFrame:
    """Derive every row of ``pages`` (page_id, url, html) and tell what the stored records hold.

    Null url or html is the empty string; a page without text has an empty conversion; pages of any length are read whole;
    repeated rows have records of equal ids; other columns, whatever their names, are not looked at; an empty table gives an
    empty table. No shuffle.
    """
    return summary(stored(derivatives(stored(responses(pages), "warc-responses", "zstd")), "warc-derivatives", "zstd"))
