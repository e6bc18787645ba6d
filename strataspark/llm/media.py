"""Media columns by signature sniffing.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass; a validator for each format follows its
structure (chunk lengths, checksums, block chains) and gives the length of the object, or rejects the place. What is
found at offset 0 corrects the declared type; what is found further in is embedded media and can be carved.

Null bytes or texts count as empty. Equal inputs give equal values. Bytes without a valid object have the type
``unknown``. Only the named columns are read."""
from __future__ import annotations

import hashlib
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, map_documents

#: Magic bytes.
MAGIC = {b"RIFF": "wav", b"BM": "bmp", b"\x89PNG\r\n\x1a\n": "png", b"GIF87a": "gif", b"GIF89a": "gif", b"\xff\xd8\xff": "jpeg", b"\x1f\x8b\x08": "gzip"}
FRAME, WIDTH = 576, 24
_AUTOMATON: list = []


def _wav(b: bytes, at: int) -> int | None:
    if len(b) < at + 12 or b[at + 8:at + 12] != b"WAVE":
        return None
    end, p, seen = at + 8 + int.from_bytes(b[at + 4:at + 8], "little"), at + 12, set()
    while p + 8 <= end <= len(b):
        seen.add(b[p:p + 4])
        size = int.from_bytes(b[p + 4:p + 8], "little")
        p += 8 + size + size % 2
    return end - at if p == end and {b"fmt ", b"data"} <= seen else None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, reserved, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if reserved or planes != 1 or head not in (40, 108, 124) or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or at + size > len(b):
        return None
    return size if 14 + head <= start and start + (width * bits + 31) // 32 * 4 * abs(height) == size else None


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        size, kind = int.from_bytes(b[p:p + 4], "big"), b[p + 4:p + 8]
        if p + 12 + size > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[p + 4:p + 8 + size]) != int.from_bytes(b[p + 8 + size:p + 12 + size], "big"):
            return None
        p, first = p + 12 + size, False
        if kind == b"IEND":
            return p - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 13:
        return None
    colours = lambda flags: 3 << (flags & 7) + 1 if flags & 128 else 0
    p = at + 13 + colours(b[at + 10])
    while p < len(b):
        mark = b[p]
        if mark == 0x3B:
            return p + 1 - at
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 <= len(b):
            p += 11 + colours(b[p + 9])
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p, scanned = at + 2, False
    while p + 2 <= len(b) and b[p] == 0xFF:
        mark = b[p + 1]
        if mark == 0xD9:
            return p + 2 - at if scanned else None
        if mark == 0xFF:
            p += 1
            continue
        if not 0xC0 <= mark <= 0xFE or p + 4 > len(b):
            return None
        size = int.from_bytes(b[p + 2:p + 4], "big")
        if size < 2:
            return None
        p += 2 + size
        if mark == 0xDA:
            scanned = True
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
    return None


def _gzip(b: bytes, at: int) -> int | None:
    z = zlib.decompressobj(31)
    try:
        for p in range(at, len(b), 1 << 16):
            data = b[p:p + (1 << 16)]
            while data and not z.eof:
                z.decompress(data, 1 << 20)
                data = z.unconsumed_tail
            if z.eof:
                return min(p + (1 << 16), len(b)) - len(z.unused_data) - at
    except zlib.error:
        pass
    return None


VALIDATORS = {"wav": _wav, "bmp": _bmp, "png": _png, "gif": _gif, "jpeg": _jpeg, "gzip": _gzip}


def sniff(data: bytes) -> list[tuple[int, str, int]]:
    """Valid objects (offset, kind, length): that at offset 0, if any, and those further in, leftmost without overlap."""
    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for magic, kind in MAGIC.items():
            a.add_word(magic.decode("latin-1"), (kind, len(magic)))
        a.make_automaton()
        _AUTOMATON.append(a)
    found, end = [], 0
    for last, (kind, size) in _AUTOMATON[0].iter(data.decode("latin-1")):
        at = last - size + 1
        if at and at < end:
            continue
        length = VALIDATORS[kind](data, at)
        if length:
            found.append((at, kind, length))
            end = at + length if at else end
    return found


def store(payload: bytes, kind: str) -> bytes:
    """``payload`` as 8-bit samples (wav) or 8-bit grey pixels in rows of 24 (bmp, png)."""
    n = len(payload)
    if kind == "wav":
        return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload
    rows = n // WIDTH
    if kind == "bmp":
        palette = b"".join(bytes((g, g, g, 0)) for g in range(256))
        return b"BM" + struct.pack("<IIIIiiHHIIIIII", 54 + 1024 + n, 0, 54 + 1024, 40, WIDTH, -rows, 1, 8, 0, n, 2835, 2835, 256, 0) + palette + payload
    if kind == "png":
        lines = np.zeros((rows, WIDTH + 1), np.uint8)
        lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")
    raise ValueError(f"no such format: {kind}")


def read(data: bytes, kind: str) -> bytes:
    """The samples of what ``store`` made."""
    if kind == "wav":
        return data[44:44 + int.from_bytes(data[40:44], "little")]
    if kind == "bmp":
        return data[int.from_bytes(data[10:14], "little"):int.from_bytes(data[2:6], "little")]
    if kind == "png":
        p, body = 8, []
        while p < len(data):
            size, t = int.from_bytes(data[p:p + 4], "big"), data[p + 4:p + 8]
            if t == b"IDAT":
                body.append(data[p + 8:p + 8 + size])
            p += 12 + size
        return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()
    raise ValueError(f"no such format: {kind}")


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def sniff_column(df: DataFrame, *, row_id: str, data: str, declared: str) -> DataFrame:
    """Rows (id, declared, actual, length, embedded): the type and length that the bytes show at offset 0, and what
    is embedded as ``kind:offset:length``, comma-joined."""
    kind = df.schema[row_id].dataType.simpleString()

    def run(block: pa.RecordBatch) -> dict:
        out: dict = {row_id: block.column(0), "declared": block.column(2), "actual": [], "length": [], "embedded": []}
        for b in block.column(1).to_pylist():
            found = sniff(b or b"")
            top = found[0] if found and not found[0][0] else (0, "unknown", len(b or b""))
            out["actual"].append(top[1])
            out["length"].append(top[2])
            out["embedded"].append(",".join(f"{k}:{a}:{n}" for a, k, n in found if a))
        return out
    return map_documents(documents(df, row_id, data, declared), data, f"`{row_id}` {kind}, declared string, actual string, length long, embedded string", run)


def carve(df: DataFrame, *, row_id: str, data: str) -> DataFrame:
    """A row (id, offset, kind, content) for each embedded object."""
    kind = df.schema[row_id].dataType.simpleString()

    def run(block: pa.RecordBatch) -> dict:
        got = [(i, a, k, b[a:a + n]) for i, b in enumerate(block.column(1).to_pylist()) for a, k, n in sniff(b or b"") if a]
        return {row_id: block.column(0).take(pa.array([x[0] for x in got], pa.int64())), "offset": [x[1] for x in got], "kind": [x[2] for x in got], "content": [x[3] for x in got]}
    return map_documents(documents(df, row_id, data), data, f"`{row_id}` {kind}, offset long, kind string, content binary", run)


def stored_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", declared: str = "wav") -> DataFrame:
    """Texts kept as media: rows (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature).

    The payload's checksum picks the format; all rows declare the same one, which sniffing corrects. The payload is
    read back from the stored bytes by the type found in them."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(block: pa.RecordBatch) -> dict:
        out: dict = {doc_id: block.column(0), **{n: [] for n in names}}
        for t in block.column(1).to_pylist():
            size, payload = padded(t)
            media = store(payload, ("wav", "bmp", "png")[zlib.crc32(payload) % 3])
            found = sniff(media)
            if not found or found[0][0] or found[0][2] != len(media):
                raise ValueError("the stored bytes aren't one valid object")
            actual = found[0][1]
            back = read(media, actual)
            samples = np.frombuffer(back, np.uint8)
            embedded = ",".join(f"{k}:{a}:{n}" for a, k, n in found if a)
            feature = f"type={actual};declared={declared};corrected={str(actual != declared).lower()};mean={samples.mean():.4f};changes={int((samples[1:] != samples[:-1]).sum())};embedded={embedded}"
            for n, v in zip(names, (size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)):
                out[n].append(v)
        return out
    return map_documents(documents(docs, doc_id, text), text, f"`{doc_id}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", run)
