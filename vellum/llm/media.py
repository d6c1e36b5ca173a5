"""Media columns in Ogg: pages with checksums, packets from lacing values, several logical streams, granule times.

Layout written here: one logical stream carries the samples (8 bits, RATE a second) in packets of up to PACKET bytes after
a header packet; a second one carries a note with the unpadded length. Pages of both are interleaved. The reader takes any
valid physical stream: it checks every page's CRC, order and continuation flag and rebuilds packets per serial number.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

RATE, PACKET, UNIT = 8000, 4000, 64
SAMPLES, NOTES = 0x5341, 0x4E4F
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
#: A header packet of samples: this, then samples a second and bits of a sample.
KIND, PCM = b"\x01samples", struct.Struct("<IB")
#: Granule position of a page on which no packet ends.
NONE_ENDS = -1
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class BadMedia(ValueError):
    """The stored bytes are no valid Ogg stream."""


def page_crc(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04C11DB7, most significant bit first, no inversion).

    zlib computes the mirrored CRC with inversions; mirroring the input's and the result's bits gives Ogg's.
    """
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(_MIRROR), "little")


def lacing(length: int) -> bytes:
    """A packet's lacing values: 255 for each full segment and a smaller one to end it."""
    return b"\xff" * (length // 255) + bytes([length % 255])


def page(kind: int, granule: int, serial: int, number: int, laces: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(laces)) + laces
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def pages_of(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream from (packet, granule at its end). The header packet has the first page alone."""
    out: list[bytes] = []

    def put(laces: bytes, body: bytes, granule: int, continued: bool, last: bool) -> None:
        out.append(page(CONTINUED * continued | FIRST * (not out) | LAST * last, granule, serial, len(out), laces, body))

    laces, body, granule, continued = bytearray(), bytearray(), NONE_ENDS, False
    for k, (packet, end) in enumerate(packets):
        at = 0
        for lace in lacing(len(packet)):
            if len(laces) == 255:
                put(bytes(laces), bytes(body), granule, continued, False)
                laces, body, granule, continued = bytearray(), bytearray(), NONE_ENDS, at > 0
            laces.append(lace)
            body += packet[at : at + lace]
            at += lace
        granule = end
        if k in (0, len(packets) - 1):
            put(bytes(laces), bytes(body), granule, continued, k == len(packets) - 1)
            laces, body, granule, continued = bytearray(), bytearray(), NONE_ENDS, False
    return out


def write_ogg(payload: bytes, unpadded: int) -> bytes:
    """Stores a payload of 8-bit samples and its unpadded length as two interleaved logical streams."""
    cut = [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    samples = pages_of(SAMPLES, [(KIND + PCM.pack(RATE, 8), 0), *cut])
    notes = pages_of(NOTES, [(b"\x01notes", 0), (struct.pack("<Q", unpadded), len(payload))])
    return b"".join([samples[0], notes[0], *samples[1:], *notes[1:]])  # all first pages come before any other


def read_ogg(media: bytes) -> dict[int, dict]:
    """Per serial number: packets, the granule at each packet's end where its page tells it, pages. Raises BadMedia."""
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise BadMedia(f"cut header at {at}")
        magic, version, kind, granule, serial, number, crc, n = HEADER.unpack_from(media, at)
        body = at + HEADER.size + n
        laces = media[at + HEADER.size : body]
        end = body + sum(laces)
        if magic != b"OggS" or version or len(laces) < n or end > len(media):
            raise BadMedia(f"no whole page at {at}")
        if page_crc(b"".join((media[at : at + 22], b"\0\0\0\0", media[at + 26 : end]))) != crc:
            raise BadMedia(f"checksum of the page at {at}")
        if bool(kind & FIRST) == (serial in streams):
            raise BadMedia(f"first page of stream {serial:#x} missing or repeated at {at}")
        s = streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "open": [], "ended": False})
        if number != s["pages"] or s["ended"] or bool(kind & CONTINUED) != bool(s["open"]):
            raise BadMedia(f"page out of order at {at}")
        s["pages"] += 1
        s["ended"] = bool(kind & LAST)
        first, start, ended = body, body, len(s["packets"])
        for lace in laces:
            start += lace
            if lace < 255:
                s["packets"].append(b"".join((*s["open"], media[first:start])))
                s["granules"].append(None)
                s["open"], first = [], start
        if first < start or laces[-1:] == b"\xff":
            s["open"].append(media[first:start])
        if len(s["packets"]) > ended:
            s["granules"][-1] = granule
        elif granule != NONE_ENDS:
            raise BadMedia(f"a granule position without a packet's end at {at}")
        at = end
    for serial, s in streams.items():
        if s.pop("open") or not s.pop("ended"):
            raise BadMedia(f"stream {serial:#x} is cut")
    return streams


def header(stream: dict) -> tuple[int, int] | None:
    """(samples a second, bits of a sample) from a stream's header packet; null for streams of other kinds."""
    head = stream["packets"][0] if stream["packets"] else b""
    if len(head) != len(KIND) + PCM.size or not head.startswith(KIND):
        return None
    rate, bits = PCM.unpack_from(head, len(KIND))
    return (rate, bits) if rate and bits else None


def timestamps(stream: dict) -> list[float]:
    """Seconds at each data packet's end, derived from granule positions.

    A page's granule position, which counts samples, is the end of the last packet that ends on the page; the packets before
    it end as much earlier as the samples after them take, so a stream may start anywhere and may have gaps. Raises
    BadMedia where positions step back or a stream isn't one of samples.
    """
    form = header(stream)
    if form is None:
        raise BadMedia("no stream of samples")
    rate, bits = form
    out: list[float] = []
    waiting: list[int] = []
    before = None
    for packet, granule in zip(stream["packets"][1:], stream["granules"][1:], strict=True):
        waiting.append(8 * len(packet) // bits)
        if granule is None:
            continue
        if granule < 0 or (before is not None and granule < before):
            raise BadMedia(f"granule position {granule} after {before}")
        ends, at = [], granule
        for samples in reversed(waiting):
            ends.append(at / rate)
            at -= samples
        out += reversed(ends)
        waiting, before = [], granule
    if waiting:
        raise BadMedia("packets without a granule position")
    return out


_STREAM = pa.struct([("serial", pa.int64()), ("pages", pa.int64()), ("packets", pa.int64()), ("bytes", pa.int64()), ("first_s", pa.float64()), ("last_s", pa.float64())])


def _streams(media: bytes | None) -> tuple[str | None, list]:
    """(error, streams) of stored bytes: an error is a value, so a bad row never ends the task."""
    if media is None:
        return "null", []
    out = []
    try:
        for serial, s in sorted(read_ogg(media).items()):
            times = timestamps(s) if header(s) else []
            out.append((serial, s["pages"], len(s["packets"]), sum(map(len, s["packets"])), *((times[0], times[-1]) if times else (None, None))))
    except BadMedia as exc:
        return str(exc), []
    return None, out


def read_media(docs: DataFrame, media: str = "media", id: str = "doc_id") -> DataFrame:
    """Per row of a table with a media column (binary Ogg): doc_id, error, streams.

    error tells why the bytes are no valid Ogg (`null` where there are none) and is null for good rows; streams has serial,
    pages, packets, bytes, and the seconds at which the first and the last data packet of a stream of samples end. Ids may
    be null or repeated; other columns are ignored.
    """

    def run(batches):
        for batch in blocks(batches, "x_media", 4 << 20):
            rows = [_streams(m) for m in batch.column(1).to_pylist()]
            errors, streams = zip(*rows, strict=True)
            named = [[dict(zip([f.name for f in _STREAM], s, strict=True)) for s in own] for own in streams]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string()), pa.array(named, pa.list_(_STREAM))], ["doc_id", "error", "streams"])

    schema = "doc_id long, error string, streams array<struct<serial:long,pages:long,packets:long,bytes:long,first_s:double,last_s:double>>"
    return docs.select(F.col(id).cast("long").alias("x_id"), F.col(media).cast("binary").alias("x_media")).mapInArrow(run, schema)


def stored(text: str | None) -> tuple[bytes, bytes]:
    """(a text's bytes, the Ogg that holds them padded to UNIT)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw, write_ogg(raw + bytes(-len(raw) % UNIT or (UNIT if not raw else 0)), len(raw))


def write_media(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, media (binary): the text as Ogg; a null text is empty."""

    def run(batches):
        for batch in blocks(batches, "x_text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stored(t)[1] for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id).cast("long").alias("x_id"), F.col(text).alias("x_text")).mapInArrow(run, "doc_id long, media binary")


def _row(text: str | None) -> tuple:
    media = stored(text)[1]
    streams = read_ogg(media)
    data, note = streams[SAMPLES], streams[NOTES]
    back = b"".join(data["packets"][1:])
    times = timestamps(data)
    pages = sum(s["pages"] for s in streams.values())
    feature = f"ogg;streams={len(streams)};pages={pages};packets={len(times)};seconds={times[-1]:.6f};peak={max(back)};zero={back.count(0)}"
    return struct.unpack("<Q", note["packets"][1])[0], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature


_NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _features(batches):
    for batch in blocks(batches, "x_text", 4 << 20):
        rows = [_row(t) for t in batch.column(1).to_pylist()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *_NAMES])


def media_features(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Stores every text as Ogg, reads it back with all checks, and returns the contract's digests and a feature string.

    A null text is empty and stored as 64 zero bytes; equal texts give equal values; rows are independent, so ids may be
    null or repeated; other columns are ignored. Memory is bounded by the longest single text.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id).cast("long").alias("x_id"), F.col(text).alias("x_text")).mapInArrow(_features, schema)
