"""Operator 1: MPEG audio columns.

`store` keeps any bytes losslessly in an MPEG-1 Layer III stream (an ID3v2 tag, a Xing table of a
variable-bitrate stream, then silent frames of checked side information that carry the bytes as ancillary
data); `read` takes any column of MPEG audio bytes, skips tags, resynchronises frame headers, parses
Xing/Info/VBRI tables, verifies the checksums of all three layers and gives exact durations (samples over samples a second) and every
frame's byte offset.

Null or empty media: no frames, duration 0, sync_losses 0. Bytes without a frame: frames 0 and skipped_bytes their
number. Repeated rows give repeated rows. Other columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.words import Texts, pieces

UNIT = 192

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, for (MPEG-1 layers I, II, III) and (MPEG-2 layers I, II and III).
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Samples a second of MPEG-1 by index; MPEG-2 has half, MPEG-2.5 a quarter.
FREQUENCIES = (44100, 48000, 32000)

#: 32 kHz frames of these many units of 192 bytes: bitrate index.
_INDEX = {1: 3, 2: 7, 3: 10, 4: 11, 5: 12, 6: 14, 7: 14}
_SIDE = 17
_LEAD = 4 + 2 + _SIDE


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def frame_crc(data: bytes) -> int:
    """The CRC-16 of the standard over the header's last two bytes and the side information."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) ^ _CRC[(c >> 8) ^ b]) & 0xFFFF
    return c


def _crc_bits(data: bytes, bits: int) -> int:
    """The same over so many bits of data."""
    c = frame_crc(data[: bits // 8])
    for k in range(bits % 8):
        bit = data[bits // 8] >> (7 - k) & 1
        c = ((c << 1) ^ (0x8005 if c >> 15 ^ bit else 0)) & 0xFFFF
    return c


# Fixed values of the standards: runs of (subbands, bits of allocation) by Layer II table; the last one is MPEG-2's.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}


def allocation_table(h: Header) -> list[int]:
    """Bits of allocation of each subband of a Layer II frame."""
    each = h.kbit // h.channels
    if h.version != 1:
        name = "low"
    elif each in (32, 48):
        name = "d" if h.rate == 32000 else "c"
    else:
        name = "a" if h.rate == 48000 or 56 <= each <= 80 else "b"
    return [bits for n, bits in ALLOCATION[name] for _ in range(n)]


def covered_bits(four: bytes, h: Header, body: bytes) -> int:
    """Bits behind the checksum that it covers: side information, allocations, and in Layer II which scale factors come."""
    if h.layer == 3:
        return 8 * h.side
    table = [4] * 32 if h.layer == 1 else allocation_table(h)
    bound = min(len(table), 4 * ((four[3] >> 4 & 3) + 1)) if four[3] >> 6 == 1 else len(table)
    if h.layer == 1:
        return 4 * (bound * h.channels + 32 - bound)
    bits = int.from_bytes(body[:64].ljust(64, b"\0"), "big")
    at, selections = 0, 0
    for k, n in enumerate(table):
        for _ in range(h.channels if k < bound else 1):
            value = bits >> (512 - at - n) & (1 << n) - 1
            selections += (value > 0) * (1 if k < bound else h.channels)
            at += n
    return at + 2 * selections


def checksum_holds(data: bytes, at: int, h: Header) -> bool:
    """Whether a protected frame's checksum is that of the header's last two bytes and what it covers."""
    four, body = data[at : at + 4], data[at + 6 : at + h.length]
    bits = covered_bits(four, h, body)
    return bits <= 8 * len(body) and _crc_bits(four[2:] + body[: bits // 8 + 1], 16 + bits) == int.from_bytes(data[at + 4 : at + 6], "big")


class Header:
    """What four bytes of a frame header say."""

    __slots__ = ("channels", "kbit", "layer", "length", "protected", "rate", "samples", "side", "version")

    def __init__(self, version, layer, protected, rate, length, samples, channels, side, kbit):
        self.version, self.layer, self.protected, self.rate = version, layer, protected, rate
        self.length, self.samples, self.channels, self.side, self.kbit = length, samples, channels, side, kbit

    def like(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(65536)
def header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {3: 1.0, 2: 2.0, 0: 2.5}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    index, speed = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or speed == 3 or four[3] & 3 == 2:
        return None
    kbit = RATES[1 if version == 1 else 2, layer][index]
    rate = FREQUENCIES[speed] // {1.0: 1, 2.0: 2, 2.5: 4}[version]
    padding = four[2] >> 1 & 1
    mono = four[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    length = (12000 * kbit // rate + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbit // rate + padding
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Header(version, layer, not four[1] & 1, rate, length, samples, 1 if mono else 2, side, kbit)


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Bytes of the leading tag, and its text frames (user texts by their description)."""
    if len(data) < 10 or data[:3] != b"ID3" or any(x & 0x80 for x in data[6:10]):
        return 0, {}
    size, out, at = _syncsafe(data[6:10]), {}, 10
    end = min(len(data), 10 + size)
    while at + 10 <= end and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode("ascii")
        length = _syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + length)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out[key] = value.rstrip("\0")
        at += 10 + length
    return min(len(data), 10 + size + 10 * bool(data[5] & 0x10)), out


def trailing_tags(data: bytes) -> int:
    """Bytes of ID3v1 and APE tags at the end."""
    n = 128 if len(data) >= 128 and data[-128:-125] == b"TAG" else 0
    foot = data[len(data) - n - 32 : len(data) - n]
    if len(foot) == 32 and foot[:8] == b"APETAGEX":
        n += int.from_bytes(foot[12:16], "little") + 32 * bool(int.from_bytes(foot[20:24], "little") >> 31)
    return min(n, len(data))


def vbr_table(data: bytes, at: int, h: Header) -> dict | None:
    """The Xing, Info or VBRI table in the frame at this offset."""
    for x in {at + 4 + h.side, at + 4 + 2 * h.protected + h.side}:
        kind = data[x : x + 4]
        if kind in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(data[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(data[p : p + 100])
            return out
    if data[at + 36 : at + 40] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big")}
    return None


def parse(data: bytes) -> dict:
    """Tags, table, frame offsets, samples, checksum results and losses of synchronisation of one stream."""
    skip, tags = id3v2(data)
    end = len(data) - trailing_tags(data)
    out = {"tags": tags, "vbr": None, "sample_rate": 0, "samples": 0, "offsets": [], "lengths": [], "crc_checked": 0, "crc_bad": 0, "sync_losses": 0, "skipped": 0}
    at, last = skip, None
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h and (last is None or not last.like(h) or at != out["next"]):
            follows = at + h.length
            after = header(data[follows : follows + 4]) if follows + 4 <= end else None
            h = h if follows == end or after and after.like(h) else None
        if not h or at + h.length > end:
            nearest = data.find(b"\xff", at + 1, end)
            nearest = end if nearest < 0 else nearest
            out["skipped"] += nearest - at
            out["sync_losses"] += last is not None and at == out.get("next")
            at = nearest
            continue
        if h.protected:
            out["crc_checked"] += 1
            out["crc_bad"] += not checksum_holds(data, at, h)
        table = vbr_table(data, at, h) if last is None else None
        if table:
            out["vbr"] = table
        else:
            out["offsets"].append(at)
            out["lengths"].append(h.length)
            out["samples"] += h.samples
        out["sample_rate"] = out["sample_rate"] or h.rate
        last, at = h, at + h.length
        out["next"] = at
    if at < end:
        out["skipped"] += end - at
    return out


def _lead(index: int, protected: bool = True) -> bytes:
    four = bytes((0xFF, 0xFA if protected else 0xFB, index << 4 | 2 << 2, 0xC0))
    side = bytes(_SIDE)
    return four + (frame_crc(four[2:] + side).to_bytes(2, "big") if protected else b"") + side


def _frames(payload: np.ndarray, units: int) -> np.ndarray:
    """Frames of so many units each; payload has whole frames' bytes."""
    index = _INDEX[units]
    length = 144 * RATES[1, 3][index] // 32
    out = np.zeros((len(payload) // (units * UNIT), length), np.uint8)
    out[:, :_LEAD] = np.frombuffer(_lead(index), np.uint8)
    out[:, _LEAD : _LEAD + units * UNIT] = payload.reshape(len(out), -1)
    return out


def encode(payload: bytes) -> bytes:
    """A stream that carries the payload, a positive multiple of 192 bytes."""
    units = len(payload) // UNIT
    if not units or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    flat = np.frombuffer(payload, np.uint8)
    whole, rest = divmod(units, 7)
    parts = [_frames(flat[: whole * 7 * UNIT], 7)] if whole else []
    parts += [_frames(flat[whole * 7 * UNIT :], rest)] if rest else []
    body = b"".join(x.tobytes() for x in parts)
    sizes = [x.shape[1] for x in parts for _ in range(len(x))]
    first = _lead(_INDEX[1], protected=False)
    first = first + b"Xing" + (7).to_bytes(4, "big") + len(sizes).to_bytes(4, "big")
    total = 216 + len(body)
    starts = 216 + np.concatenate(([0], np.cumsum(sizes)[:-1]))
    toc = np.minimum(255, starts[np.arange(100) * len(sizes) // 100] * 256 // total).astype(np.uint8)
    first = (first + total.to_bytes(4, "big") + toc.tobytes()).ljust(216, b"\0")
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    n = len(frame)
    return b"ID3\3\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + frame + first + body


def payload_of(data: bytes, parsed: dict) -> bytes:
    """The bytes that `encode` has put into these frames, wherever they stand."""
    n, flat = int(parsed["tags"].get("payload_bytes", 0)), np.frombuffer(data, np.uint8)
    offsets, room = np.array(parsed["offsets"], np.int64), (np.array(parsed["lengths"], np.int64) - _LEAD) // UNIT * UNIT
    out, i = [], 0
    while i < len(offsets) and n > 0:
        j = i + 1
        while j < len(offsets) and room[j] == room[i]:
            j += 1
        at = offsets[i:j, None] + _LEAD + np.arange(room[i])
        out.append(flat[at].tobytes()[:n])
        n -= len(out[-1])
        i = j
    return b"".join(out)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, n_bytes (of the text's UTF-8) and media (the stream); a null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = Texts(batch.column("text"))
            media = []
            for i, n in enumerate(texts.sizes.tolist()):
                media.append(encode(texts.bytes(i) + b" " * (-n % UNIT if n else UNIT)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts.sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    rows = df.selectExpr(f"`{id_col}` id", f"`{text_col}` text")
    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


READ = "frames bigint, samples bigint, sample_rate int, vbr string, vbr_frames bigint, crc_checked bigint, crc_bad bigint, sync_losses bigint, skipped_bytes bigint, tags map<string,string>, seek array<bigint>, media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint"


def read(df: DataFrame, keys: list[str], media_col: str = "media") -> DataFrame:
    """The keys and what the streams say; the duration is exactly samples / sample_rate seconds."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_media"):
            rows = []
            for data in batch.column("_media"):
                data = data.as_py() or b""
                p = parse(data)
                payload = payload_of(data, p)
                vbr = p["vbr"] or {}
                rows.append((len(p["offsets"]), p["samples"], p["sample_rate"], vbr.get("kind"), vbr.get("frames"), p["crc_checked"], p["crc_bad"], p["sync_losses"], p["skipped"], list(p["tags"].items()), p["offsets"], len(data), hashlib.sha256(data).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
            fields = [f for f in schema if f.name not in names]
            arrays = [pa.array(x, f.type) for x, f in zip(zip(*rows), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in names] + arrays, names=names + [f.name for f in fields])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    names = [f"_key{i}" for i in range(len(keys))]
    rows = df.selectExpr(*[f"`{k}` {n}" for k, n in zip(keys, names, strict=True)], f"`{media_col}` _media")
    out = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + [READ])
    schema = to_arrow_schema(_parse_datatype_string(READ))
    done = rows.mapInArrow(work, out)
    return done.selectExpr(*[f"{n} `{k}`" for n, k in zip(names, keys, strict=True)], *[x.split()[0] for x in READ.split(", ")])
