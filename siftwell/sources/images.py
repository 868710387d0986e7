"""What images say beside their pixels, and copies without it."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

#: Published tags.
EXIF = {0x010E: "description", 0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "modified", 0x013B: "artist", 0x8298: "copyright", 0x9003: "taken", 0x9C9B: "title", 0xA430: "owner", 0xA431: "serial"}
GPS_POINTER, EXIF_POINTER = 0x8825, 0x8769
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
PNG = b"\x89PNG\r\n\x1a\n"
PNG_TEXT = (b"tEXt", b"iTXt", b"zTXt", b"eXIf", b"tIME", b"iCCP")
MOST_TEXT = 1 << 20


def jpeg_segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of the segments before the picture's own data."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD9, 0xDA) or at + 2 + (size := int.from_bytes(data[at + 2 : at + 4], "big")) > len(data) or size < 2:
            return
        yield marker, at, at + 2 + size
        at += 2 + size


def png_chunks(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    at = len(PNG)
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + size > len(data):
            return
        yield data[at + 4 : at + 8], at, at + 12 + size
        at += 12 + size


def _directory(tiff: bytes, at: int, order: str) -> dict[int, tuple]:
    """An image directory's tags: numbers, or a text's bytes."""
    out = {}
    if at + 2 > len(tiff):
        return out
    (n,) = struct.unpack_from(order + "H", tiff, at)
    for k in range(min(n, 512)):
        if at + 14 + 12 * k > len(tiff):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
        size = SIZES.get(kind, 0) * count
        place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", tiff, at + 10 + 12 * k)[0]
        if not size or place + size > len(tiff):
            continue
        if kind in (1, 2, 7):
            out[tag] = (tiff[place : place + size],)
        elif kind in (3, 4, 9):
            out[tag] = struct.unpack_from(f"{order}{count}{ {3: 'H', 4: 'I', 9: 'i'}[kind]}", tiff, place)
        else:
            parts = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", tiff, place)
            out[tag] = tuple(a / b if b else 0.0 for a, b in zip(parts[::2], parts[1::2], strict=True))
    return out


def exif(tiff: bytes) -> dict[str, str]:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return {}
    main = _directory(tiff, struct.unpack_from(order + "I", tiff, 4)[0], order)
    inner = _directory(tiff, main[EXIF_POINTER][0], order) if EXIF_POINTER in main else {}
    out = {name: value.split(b"\0")[0].decode("utf-8", "replace").strip() for tag, name in EXIF.items() if isinstance((value := (main | inner).get(tag, (None,))[0]), bytes)}
    gps = _directory(tiff, main[GPS_POINTER][0], order) if GPS_POINTER in main else {}
    if len(gps.get(2, ())) == 3 and len(gps.get(4, ())) == 3:
        degrees = lambda v, side, back: (v[0] + v[1] / 60 + v[2] / 3600) * (-1 if side[0][:1] == back else 1)
        out["gps"] = f"{degrees(gps[2], gps.get(1, (b'N',)), b'S'):.6f}, {degrees(gps[4], gps.get(3, (b'E',)), b'W'):.6f}"
    return {k: v for k, v in out.items() if v}


def metadata(data: bytes) -> dict[str, str]:
    """Camera, software, persons, times, place and texts that an image carries."""
    out: dict[str, str] = {}
    if data.startswith(b"\xff\xd8"):
        for marker, a, b in jpeg_segments(data):
            body = data[a + 4 : b]
            if marker == 0xE1 and body.startswith(b"Exif\0\0"):
                out |= exif(body[6:])
            elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap"):
                out["xmp"] = body[29:].decode("utf-8", "replace")
            elif marker == 0xFE:
                out["comment"] = body.decode("utf-8", "replace")
    elif data.startswith(PNG):
        for kind, a, b in png_chunks(data):
            body = data[a + 8 : b - 4]
            if kind == b"eXIf":
                out |= exif(body)
            elif kind == b"tEXt" and b"\0" in body:
                name, text = body.split(b"\0", 1)
                out[name.decode("latin-1").lower()] = text.decode("latin-1")
            elif kind == b"iTXt" and body.count(b"\0") >= 4:
                name, rest = body.split(b"\0", 1)
                text = rest[2:].split(b"\0", 2)[2]
                try:
                    raw = zlib.decompressobj().decompress(text, MOST_TEXT) if rest[:1] == b"\1" else text
                except zlib.error:
                    continue
                out[name.decode("latin-1").lower()] = raw.decode("utf-8", "replace")
    return out


def strip(data: bytes) -> bytes | None:
    """The same picture without metadata (application segments but JFIF's and Adobe's colours, comments, texts); none for other formats."""
    if data.startswith(b"\xff\xd8"):
        out, at = [data[:2]], 2
        for marker, a, b in jpeg_segments(data):
            if not (marker == 0xE1 or 0xE3 <= marker <= 0xED or marker == 0xEF or marker == 0xFE):
                out.append(data[a:b])
            at = b
        return b"".join([*out, data[at:]])
    if data.startswith(PNG):
        out, at = [data[: len(PNG)]], len(PNG)
        for kind, a, b in png_chunks(data):
            if kind not in PNG_TEXT[:5]:
                out.append(data[a:b])
            at = b
        return b"".join([*out, data[at:]])
    return None
