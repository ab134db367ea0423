"""Ogg pages: checksums, packets from lacing values, logical streams apart, times from granule positions."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_column
from .scratch import stored

CONTINUED, FIRST, LAST = 1, 2, 4
RATE, PACKET = 8000, 4096
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The page checksum (polynomial 0x04C11DB7, most significant bit first, from 0, not inverted).

    It is zlib's CRC over bytes with their bits turned round, itself turned round, so the library's speed is had.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII B".replace(" ", ""), b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream; each packet comes with the granule position at its end. The first has its own page."""
    pages: list[bytes] = []
    lacing, body, flags, granule = bytearray(), bytearray(), FIRST, -1

    def flush(last: bool) -> None:
        nonlocal flags, granule
        pages.append(page(serial, len(pages), flags | LAST * last, granule, bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        flags, granule = 0, -1

    for k, (data, end) in enumerate(packets):
        lengths = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        if len(lacing) + len(lengths) > 255 and lacing and len(lengths) <= 255:
            flush(False)
        for x in lengths:
            if len(lacing) == 255:
                flush(False)
                flags = CONTINUED
            lacing.append(x)
            body += data[at : at + x]
            at += x
        granule = end
        if k == 0 and len(packets) > 1:
            flush(False)
    flush(True)
    return pages


@dataclass
class Stream:
    """What one logical stream holds: packets, and for each the granule position at its end (-1 if no page tells it)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _open: list[bytes] | None = None
    _next: int = 0


def pages_of(data: bytes) -> Iterator[tuple[bool, int, int, int, int, bytes, bytes]]:
    """Each page: whether its checksum holds, flags, granule, serial, sequence, lacing, body. Junk between pages is skipped."""
    at = 0
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        whole = data[at : at + size]
        good = version == 0 and len(whole) == size and checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) == crc
        yield good, flags, granule, serial, sequence, lacing, whole[27 + n :] if good else b""
        at += size if good else 4


def demultiplex(data: bytes) -> tuple[dict[int | tuple[int, int], Stream], int]:
    """The logical streams by serial number, and the number of pages that fail their checksum. A stream that begins after
    another of its serial number has ended (a chained file) goes by that number and 1, 2 and so on.

    A packet is kept only if all its parts came; a page that is missing or broken loses those that it would have had.
    """
    streams: dict[int | tuple[int, int], Stream] = {}
    now: dict[int, Stream] = {}
    links: dict[int, int] = {}
    broken = 0
    for good, flags, granule, serial, sequence, lacing, body in pages_of(data):
        if not good:
            broken += 1
            continue
        s = now.get(serial)
        if s is None or (s.ended and flags & FIRST):
            nth = links[serial] = links.get(serial, -1) + 1
            s = now[serial] = streams[(serial, nth) if nth else serial] = Stream(serial)
        s.pages += 1
        if sequence != s._next or not flags & CONTINUED:
            s.lost += s._open is not None
            s._open = None
        parts, skipping = s._open or [], bool(flags & CONTINUED) and s._open is None
        s._next, at, first = sequence + 1, 0, len(s.packets)
        for x in lacing:
            if not skipping:
                parts.append(body[at : at + x])
            at += x
            if x < 255:
                if skipping:
                    s.lost, skipping = s.lost + 1, False
                else:
                    s.packets.append(b"".join(parts))
                parts = []
        s._open = parts if lacing and lacing[-1] == 255 and not skipping else None
        s.granules += [-1] * (len(s.packets) - len(s.granules))
        if len(s.packets) > first:
            s.granules[-1] = granule
        s.ended |= bool(flags & LAST)
    return streams, broken


def times(stream: Stream, rate: int = RATE) -> list[float | None]:
    """The time at the end of each packet. A page tells the granule position of the last packet that ends on it; packets before
    it have their share by bytes of what lies between two such positions. None after the last position that is told."""
    out: list[float | None] = []
    was, waiting = 0, []
    for data, granule in zip(stream.packets, stream.granules, strict=True):
        waiting.append(len(data))
        if granule >= 0:
            whole, done = sum(waiting) or 1, 0
            for n in waiting:
                done += n
                out.append((was + (granule - was) * done / whole) / rate)
            out[-1] = granule / rate
            was, waiting = granule, []
    return out + [None] * len(waiting)


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + b"\0" * (-len(raw) % 64 or 64 * (not raw)), len(raw)


def encode(text: str) -> bytes:
    """A text as two interleaved streams: its bytes as 8-bit samples, and a stream that tells the number of them."""
    payload, n = padded(text)
    serial = zlib.crc32(payload)
    head = struct.pack("<8sIBB", b"PCM8RAW\0", RATE, 1, 8)
    sound = stream_pages(serial, [(head, 0), *((payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET))])
    told = stream_pages(serial ^ 0xFFFFFFFF, [(b"TEXTINFO", 0), (json.dumps({"bytes": n, "samples": len(payload)}).encode(), len(payload))])
    return b"".join([sound[0], told[0], *sound[1:-1], told[1], sound[-1]])


def decode(data: bytes) -> tuple[bytes, int, str]:
    """Payload, unpadded length and features of what :func:`encode` made; an error if a page is broken or missing."""
    streams, broken = demultiplex(data)
    sound = next((s for s in streams.values() if s.packets and s.packets[0].startswith(b"PCM8RAW")), None)
    told = next((s for s in streams.values() if s.packets and s.packets[0] == b"TEXTINFO"), None)
    if broken or not sound or not told or sound.lost or not sound.ended or len(told.packets) != 2:
        raise ValueError(f"{broken} pages fail their checksum or a stream is not whole")
    payload, info = b"".join(sound.packets[1:]), json.loads(told.packets[1])
    if len(payload) != info["samples"] or sound.granules[-1] != len(payload):
        raise ValueError("the samples are not as many as the granule position says")
    x = np.frombuffer(payload, np.uint8)
    level = np.bincount(x, minlength=256)
    mean = float(level @ np.arange(256)) / len(x)
    power = float(level @ (np.arange(256) - 128.0) ** 2) / len(x)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    end = times(sound)[-1]
    feature = f"streams={len(streams)};pages={sound.pages + told.pages};packets={len(sound.packets) + len(told.packets)};seconds={end:.6f};mean={mean:.4f};rms={power**0.5:.4f};crossings={crossings}"
    return payload, info["bytes"], feature


def encode_column(docs: DataFrame) -> DataFrame:
    """doc_id and ``media``: the text of each row as an Ogg file. Null is the empty text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_column(rows, "text", "media binary", lambda: lambda texts: {"media": [encode(t) for t in texts]})


def features(media: DataFrame) -> DataFrame:
    """Instead of ``media``, the digest columns of each file, from its bytes as they are read back."""

    def work(files):
        out = {name: [] for name in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data in files:
            payload, n, feature = decode(data)
            values = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature)
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
        return out

    return map_column(media, "media", "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", lambda: work)


def text_round_trip(docs: DataFrame) -> DataFrame:
    """Store every text of ``docs`` (doc_id, text) as an Ogg file in a table of the shared folder, read it back and tell
    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null and empty texts are 64 zero bytes; repeated rows and equal texts have equal values; long texts are one file each;
    other columns are not looked at; an empty table gives an empty table. No shuffle; a task holds a batch of rows.
    """
    return features(stored(encode_column(docs), "ogg"))
