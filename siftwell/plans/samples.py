"""Files of known content, for the queries over sources."""

from __future__ import annotations

import html
import io
import struct
import zipfile
import zlib


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def docx(lines: list[str]) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{html.escape(x)}</w:t></w:r></w:p>" for x in lines)
    return _zip({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document><w:body>{body}</w:body></w:document>"})


def xlsx(lines: list[str]) -> bytes:
    """A row for each line, its words in cells: every other one a shared string."""
    strings = sorted({w for x in lines for w in x.split()})
    cell = lambda r, c, w: f'<c r="{chr(65 + c)}{r}" t="s"><v>{strings.index(w)}</v></c>' if c % 2 else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{html.escape(w)}</t></is></c>'
    rows = "".join(f'<row r="{r}">' + "".join(cell(r, c, w) for c, w in enumerate(x.split())) + "</row>" for r, x in enumerate(lines, 1))
    table = "".join(f"<si><t>{html.escape(w)}</t></si>" for w in strings)
    return _zip({"xl/workbook.xml": "<workbook/>", "xl/sharedStrings.xml": f"<sst>{table}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"})


def pptx(lines: list[str]) -> bytes:
    return _zip({"ppt/presentation.xml": "<p/>", **{f"ppt/slides/slide{k}.xml": f"<a:p><a:r><a:t>{html.escape(x)}</a:t></a:r></a:p>" for k, x in enumerate(lines, 1)}})


def odt(lines: list[str]) -> bytes:
    body = "".join(f"<text:p>{html.escape(x)}</text:p>" for x in lines)
    return _zip({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": f"<office:body>{body}</office:body>"})


def pdf(lines: list[str]) -> bytes:
    escaped = [x.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") for x in lines]
    stream = zlib.compress("BT /F1 12 Tf {} ET".format(" T* ".join(f"({x}) Tj" for x in escaped)).encode("latin-1"))
    return b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n2 0 obj << /Length " + str(len(stream)).encode() + b" /Filter /FlateDecode >> stream\n" + stream + b"\nendstream endobj\n"


def rtf(lines: list[str]) -> bytes:
    return (r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}" + "".join(f"{x}\\par " for x in lines) + "}").encode("latin-1")


def png(lines: list[str]) -> bytes:
    """An image whose only text is its author, the first line."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"tEXt", b"Author\0" + lines[0].encode("latin-1")) + chunk(b"IEND", b"")


def plain(lines: list[str]) -> bytes:
    return "\n".join(lines).encode()


MAKERS = {"docx": docx, "xlsx": xlsx, "pptx": pptx, "odf": odt, "pdf": pdf, "rtf": rtf, "png": png, "text": plain}
