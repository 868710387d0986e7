"""Text of PDF files, from their content streams."""

from __future__ import annotations

import re
import zlib

from siftwell.sources.office import Extract

#: Bounds on what a file may unpack to: a stream, all streams, streams.  A gap as wide as this, in thousandths of the type's size, is a blank.
MOST_STREAM, MOST_TOTAL, MOST_STREAMS, BLANK, FEW = 24 << 20, 96 << 20, 4096, 120, 24

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)endobj", re.DOTALL)
STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.DOTALL)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def literal(raw: bytes) -> bytes:
    """A string in parentheses, without them and its escapes."""
    def one(m: re.Match) -> bytes:
        c = m[1]
        return bytes([int(c, 8) & 255]) if c.isdigit() else b"" if c in (b"\n", b"\r\n", b"\r") else ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw[1:-1], flags=re.DOTALL)


def inflate(data: bytes, most: int) -> bytes | None:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, most + 1)
    except zlib.error:
        return None
    return out if len(out) <= most else None


def unicode_map(cmap: bytes) -> dict[int, str]:
    """Codes to characters, from a ToUnicode table."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block) if len(b) % 2 == 0}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first, last = int(a, 16), int(b, 16)
            out |= {k: chr(min(0x10FFFF, int(c, 16) + k - first)) for k in range(first, min(last, first + 65_535) + 1)}
    return out


def shown(raw: bytes, table: dict[int, str]) -> str:
    """A shown string: by the table, two bytes a code if it has such; else as Latin-1."""
    if table and (max(table) > 255 or (len(raw) % 2 == 0 and raw[::2].count(0) == len(raw) // 2 and raw)):
        return "".join(table.get(int.from_bytes(raw[k : k + 2], "big"), "") for k in range(0, len(raw), 2))
    return "".join(table.get(c, chr(c)) for c in raw) if table else raw.decode("latin-1")


def content_text(stream: bytes, table: dict[int, str]) -> str:
    out: list[str] = []
    last: list[bytes] = []
    for m in TOKEN.finditer(stream):
        t = m[0]
        value = lambda s: shown(literal(s) if s[:1] == b"(" else bytes.fromhex((h := re.sub(rb"\s", b"", s[1:-1]).decode()) + "0" * (len(h) % 2)), table)
        if t in (b"Tj", b"'", b'"') and last:
            strings = [x for x in last if x[:1] in b"(<"]
            out += ["\n"] * (t != b"Tj") + [value(strings[-1])] * bool(strings)
        elif t == b"TJ":
            for x in last:
                if x[:1] in b"(<":
                    out.append(value(x))
                elif re.fullmatch(rb"[-+]?\d*\.?\d+", x) and float(x) < -BLANK:
                    out.append(" ")
        elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET", b"BT") and out and out[-1] != "\n":
            out.append("\n")
        if t[:1].isalpha() or t in (b"'", b'"'):
            last = []
        else:
            last.append(t)
    return "".join(out).strip()


def extract_pdf(data: bytes) -> Extract:
    """Text of all pages' streams; a file with an image and hardly any text is a scan, which can't be read."""
    if b"/Encrypt" in data:
        return Extract("pdf", "opaque", "", ["encrypted"], {})
    left, tables, contents, unread, objects = MOST_TOTAL, {}, [], [], [data]
    for k, m in enumerate(STREAM.finditer(data)):
        if k >= MOST_STREAMS:
            unread.append("further streams")
            break
        head, body = m[1], m[2]
        if b"/Image" in head or b"/FontFile" in head:
            continue
        if b"/FlateDecode" in head or b"/Fl " in head:
            body = inflate(body, min(MOST_STREAM, left))
        elif b"/Filter" in head:
            unread.append("a stream of an unknown filter")
            continue
        if body is None:
            unread.append("a broken or too large stream")
            continue
        left -= len(body)
        if b"/ObjStm" in head:
            objects.append(body)  # objects of the file packed into a stream: pages, information
        elif b"beginbfchar" in body or b"beginbfrange" in body:
            tables |= unicode_map(body)
        elif b"BT" in body and b"ET" in body:
            contents.append(body)
    text = "\n".join(t for c in contents if (t := content_text(c, tables)))
    info = {k.decode().lower(): literal(v).decode("latin-1") for x in objects for k, v in re.findall(rb"/(Title|Author|Subject|Keywords|Creator|Producer)\s*(\((?:\\.|[^\\()])*\))", x)}
    pages = sum(len(re.findall(rb"/Type\s*/Page\b", x)) for x in objects)
    scanned = b"/Image" in data and len(text) < FEW
    status = "opaque" if scanned or not text else "partial" if unread else "readable"
    return Extract("pdf", status, text, unread + ["pages that are images"] * scanned, info, pages)
