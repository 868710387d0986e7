"""Text of zipped office documents: DOCX, XLSX, PPTX and the OpenDocument formats."""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from typing import NamedTuple

#: Bounds on what an archive may unpack to, against ones made to fill memory: an entry, all entries, entries and document parts, rows of a sheet.
MOST_ENTRY, MOST_TOTAL, MOST_ENTRIES, MOST_PARTS = 32 << 20, 96 << 20, 4096, 512


class Extract(NamedTuple):
    """``status``: readable, partial (some parts can't be read), metadata or opaque; ``unread`` names what was left."""

    kind: str
    status: str
    text: str
    unread: list[str]
    meta: dict[str, str]
    pages: int = 0


class Archive:
    """A ZIP file's entries, unpacked within bounds."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.entries = self.zip.infolist()[:MOST_ENTRIES]
        self.skipped = [i.filename for i in self.zip.infolist()[MOST_ENTRIES:]]
        self.left = MOST_TOTAL

    def names(self) -> list[str]:
        return [i.filename for i in self.entries if not i.is_dir()]

    def read(self, name: str) -> bytes | None:
        """An entry's bytes; none if it is encrypted, broken or too large."""
        info = next(i for i in self.entries if i.filename == name)
        most = min(MOST_ENTRY, self.left)
        if info.flag_bits & 1 or info.file_size > most:
            return None
        try:
            with self.zip.open(info) as f:
                data = f.read(most + 1)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError, RuntimeError, OSError):
            return None
        if len(data) > most:
            return None
        self.left -= len(data)
        return data


TAG = re.compile(r"<[^>]*>")


def plain(xml: str) -> str:
    return html.unescape(TAG.sub("", xml))


def _cell(text: str) -> str:
    return re.sub(r"\s*[,\n]\s*", " ", text).strip()


def _tables(xml: str, table: str, row: str, cell: str) -> tuple[str, list[str]]:
    """(the rest, tables as lines of comma-separated cells)."""
    found = []
    for t in re.finditer(rf"<{table}[ >].*?</{table}>", xml, re.DOTALL):
        rows = re.findall(rf"<{row}[ >].*?</{row}>", t[0], re.DOTALL)
        found.append("\n".join(",".join(_cell(plain(c)) for c in re.findall(rf"<{cell}[ >].*?</{cell}>", r, re.DOTALL)) for r in rows))
    return re.sub(rf"<{table}[ >].*?</{table}>", "", xml, flags=re.DOTALL), found


def word_text(xml: str) -> str:
    """Paragraphs, then tables."""
    rest, tables = _tables(xml, "w:tbl", "w:tr", "w:tc")
    rest = re.sub(r"<w:tab ?/>", "\t", re.sub(r"<w:br ?[^>]*/>|<w:cr ?/>", "\n", rest))
    lines = [plain(re.sub(r"<w:delText[ >].*?</w:delText>|<w:instrText[ >].*?</w:instrText>", "", p, flags=re.DOTALL)) for p in re.split("</w:p>", rest)]
    return "\n".join([x for x in lines if x.strip()] + tables)


def slide_text(xml: str) -> str:
    rest, tables = _tables(xml, "a:tbl", "a:tr", "a:tc")
    lines = [plain("".join(re.findall(r"<a:t>(.*?)</a:t>", p, re.DOTALL))) for p in re.split("</a:p>", rest)]
    return "\n".join([x for x in lines if x.strip()] + tables)


def open_text(xml: str) -> str:
    rest, tables = _tables(xml, "table:table", "table:table-row", "table:table-cell")
    rest = re.sub(r"<text:tab ?/>", "\t", re.sub(r"<text:(?:line-break|s)[^>]*/>", " ", rest))
    body = re.search(r"<office:body>(.*)</office:body>", rest, re.DOTALL)
    lines = [plain(p) for p in re.split("</text:(?:p|h)>", body[1] if body else rest)]
    return "\n".join([x for x in lines if x.strip()] + tables)


def column_of(ref: str) -> int:
    """A is 0, AA 26."""
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return max(0, n - 1)


def shared_strings(xml: str) -> list[str]:
    return [plain("".join(re.findall(r"<t(?: [^>]*)?>(.*?)</t>", si, re.DOTALL))) for si in re.findall(r"<si>(.*?)</si>", xml, re.DOTALL)]


def sheet_text(xml: str, strings: list[str]) -> str:
    """Rows as comma-separated cells, at their columns."""
    out = []
    for row in re.findall(r"<row[ >].*?</row>", xml, re.DOTALL):
        cells: list[str] = []
        for attrs, inner in re.findall(r"<c( [^>]*?)?(?:/>|>(.*?)</c>)", row, re.DOTALL):
            ref, kind = re.search(r' r="([A-Z]+)', attrs or ""), re.search(r' t="(\w+)"', attrs or "")
            value = re.search(r"<v>(.*?)</v>", inner, re.DOTALL)
            text = plain("".join(re.findall(r"<t(?: [^>]*)?>(.*?)</t>", inner, re.DOTALL))) if kind and kind[1] == "inlineStr" else plain(value[1]) if value else ""
            if kind and kind[1] == "s" and text.isdigit():
                text = strings[int(text)] if int(text) < len(strings) else ""
            at = min(column_of(ref[1]), 16_383) if ref else len(cells)
            cells += [""] * (at - len(cells))
            cells.append(_cell(text))
        out.append(",".join(cells))
    return "\n".join(out)


#: Parts with text, by the kind of document, in their order; parts that hold none and need no mention.
PARTS = {
    "docx": re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml"),
    "pptx": re.compile(r"ppt/(?:slides/slide\d+|notesSlides/notesSlide\d+|comments/comment\d+)\.xml"),
    "xlsx": re.compile(r"xl/(?:worksheets/sheet\d+|comments\d+)\.xml"),
    "odf": re.compile(r"(?:content|styles|meta)\.xml"),
}
STRUCTURAL = re.compile(r"(?:.*/)?(?:_rels/.*|\[Content_Types\]\.xml|theme/.*|settings\.xml|settings/.*|styles\.xml|fontTable\.xml|webSettings\.xml|numbering\.xml|sharedStrings\.xml|calcChain\.xml|workbook\.xml|presentation\.xml|presProps\.xml|viewProps\.xml|tableStyles\.xml|slideLayouts/.*|slideMasters/.*|notesMasters/.*|docProps/.*|mimetype|META-INF/.*|manifest\.rdf|Configurations2/.*|Thumbnails/.*|printerSettings/.*|tables/.*|customXml/.*|fonts/.*)")


def _order(name: str) -> tuple:
    return tuple(int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name.replace("word/document", "word/0")))


def kind_of(names: list[str], archive: Archive) -> str | None:
    for kind, part in (("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml"), ("pptx", "ppt/presentation.xml")):
        if part in names:
            return kind
    if "mimetype" in names and "content.xml" in names and (archive.read("mimetype") or b"").startswith(b"application/vnd.oasis.opendocument"):
        return "odf"
    return None


def properties(archive: Archive, names: list[str]) -> dict[str, str]:
    xml = (archive.read("docProps/core.xml") or b"").decode("utf-8", "replace") if "docProps/core.xml" in names else ""
    return {k: plain(v) for k, v in re.findall(r"<(?:dc|cp|dcterms):(\w+)[^>]*>([^<]+)<", xml)}


def extract_zip(data: bytes) -> Extract:
    """An office document's text; of another archive, the names of what it holds."""
    try:
        archive = Archive(data)
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError) as e:
        return Extract("zip", "opaque", "", [str(e)], {})
    names = archive.names()
    kind = kind_of(names, archive)
    if kind is None:
        return Extract("zip", "opaque", "", names[:MOST_PARTS], {})
    wanted = sorted((n for n in names if PARTS[kind].fullmatch(n)), key=_order)
    unread = archive.skipped + wanted[MOST_PARTS:] + [n for n in names if n not in wanted and not STRUCTURAL.fullmatch(n)]
    strings = shared_strings((archive.read("xl/sharedStrings.xml") or b"").decode("utf-8", "replace")) if kind == "xlsx" and "xl/sharedStrings.xml" in names else []
    texts = []
    for name in wanted[:MOST_PARTS]:
        raw = archive.read(name)
        if raw is None:
            unread.append(name)
            continue
        xml = raw.decode("utf-8", "replace")
        read = {"docx": word_text, "pptx": slide_text, "odf": open_text, "xlsx": lambda x: sheet_text(x, strings) if "<sheetData" in x else plain(x)}[kind]
        texts.append(read(xml))
    return Extract(kind, "partial" if unread else "readable", "\n".join(t for t in texts if t.strip()), unread, properties(archive, names))
