"""Files built here, and their text read back."""

import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from siftwell.operators.scan import findings, scan
from siftwell.sources import files, images, office, pdf


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(extra=None):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("name", "email"), ("Jane, Doe", "j@mail.org"))) + "</w:tbl>"
    body = f"<w:document><w:body>{p('A &amp; B')}{p('tab<w:tab/>end')}{table}</w:body></w:document>"
    return zipped(**{"word/document.xml": body, "word/header1.xml": p("Head"), "docProps/core.xml": "<cp:p><dc:creator>Jane</dc:creator></cp:p>", "[Content_Types].xml": "", **(extra or {})})


def xlsx():
    sheet = '<sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x, y</t></is></c></row><row r="2"><c r="A2"><v>4.5</v></c></row></sheetData>'
    return zipped(**{"xl/workbook.xml": "<w/>", "xl/sharedStrings.xml": "<sst><si><t>first</t></si></sst>", "xl/worksheets/sheet1.xml": f"<w>{sheet}</w>"})


def pdf_file(text=b"(Hello) Tj", more=b""):
    stream = zlib.compress(b"BT /F1 12 Tf " + text + b" ET")
    return b"%%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n2 0 obj << /Length %d /Filter /FlateDecode >> stream\n%s\nendstream endobj\n3 0 obj << /Title (A \\(b\\)) >> endobj\n" % (len(stream), stream) + more


def jpeg(gps=True):
    # Big-endian directory: make, GPS pointer; then the GPS directory.
    make = b"Maker\0"
    entries = struct.pack(">HHII", 0x010F, 2, len(make), 200) + (struct.pack(">HHII", 0x8825, 4, 1, 100) if gps else b"")
    tiff = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 1 + gps) + entries + b"\0\0\0\0"
    place = struct.pack(">H", 4) + struct.pack(">HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack(">HHII", 2, 5, 3, 220) + struct.pack(">HHI4s", 3, 2, 2, b"E\0\0\0") + struct.pack(">HHII", 4, 5, 3, 250)
    tiff = tiff.ljust(100, b"\0") + place
    tiff = tiff.ljust(200, b"\0") + make
    tiff = tiff.ljust(220, b"\0") + struct.pack(">6I", 33, 1, 30, 1, 0, 1)
    tiff = tiff.ljust(250, b"\0") + struct.pack(">6I", 151, 1, 12, 1, 36, 1)
    app1 = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xfe\0\x07hello\xff\xda\0\x04xxpicture\xff\xd9"


def png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return images.PNG + chunk(b"IHDR", b"\0" * 13) + chunk(b"tEXt", b"Author\0Jane") + chunk(b"iTXt", b"Note\0\1\0en\0n\0" + zlib.compress("naïve".encode())) + chunk(b"IDAT", b"data") + chunk(b"IEND", b"")


def test_sniff(spark):
    rows = [
        (b"%PDF-1.7", "pdf"), (b"\n\njunk %PDF-1.4", "pdf"), (b"PK\x03\x04", "zip"), (b"plain", "text"), (b"a\0b", "binary"), (b"{\\rtf1 x}", "rtf"), (b"", "text"), (b"stop\n", "text"), (b"hello \nworld p\n", "text"),
        (b"total: 10\n", "text"), (b"p\x0a\x00", "binary"), (jpeg(), "jpeg"), (png(), "png"), (b"RIFF0000WEBPx", "webp"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole2"), (b"%!PS-Adobe", "postscript"),
    ]
    got = spark.createDataFrame([(bytearray(a), b) for a, b in rows], "c binary, want string").select(files.sniff(F.col("c")), "want").collect()
    assert [r[0] for r in got] == [b for _, b in rows] == [files.sniff_bytes(a) for a, _ in rows]


def test_rtf():
    rtf = r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}{\info{\title T}}\uc1 caf\'e9 \u8364?5\par next\tab cell {\b bold} a\~b\{c\}}"
    assert files.rtf_text(rtf) == "café €5\nnext\tcell bold a b{c}"


def test_office():
    d = files.extract(docx())
    assert (d.kind, d.status, d.meta) == ("docx", "readable", {"creator": "Jane"}) and d.text == "A & B\ntab\tend\nname,email\nJane Doe,j@mail.org\nHead"
    assert files.extract(docx({"word/embeddings/o.bin": "x"})).unread == ["word/embeddings/o.bin"] and files.extract(docx({"word/embeddings/o.bin": "x"})).status == "partial"
    assert files.extract(xlsx()).text == "first,,x y\n4.5"
    slides = zipped(**{"ppt/presentation.xml": "", "ppt/slides/slide10.xml": "<a:p><a:t>ten</a:t></a:p>", "ppt/slides/slide2.xml": "<a:p><a:r><a:t>tw</a:t></a:r><a:r><a:t>o</a:t></a:r></a:p>"})
    assert files.extract(slides).text == "two\nten"
    odt = zipped(mimetype="application/vnd.oasis.opendocument.text", **{"content.xml": "<office:body><text:h>T</text:h><text:p>one<text:tab/>two</text:p></office:body>"})
    assert (files.extract(odt).kind, files.extract(odt).text) == ("odf", "T\none\ttwo")
    other = files.extract(zipped(a="x"))
    assert (other.kind, other.status, other.unread) == ("zip", "opaque", ["a"])
    assert files.extract(b"PK\x03\x04 broken").status == "opaque"
    assert [office.column_of(r) for r in ("A1", "Z1", "AA1", "")] == [0, 25, 26, 0]


def test_an_archive_can_not_fill_memory(monkeypatch):
    monkeypatch.setattr(office, "MOST_ENTRY", 1000)
    d = files.extract(docx({"word/footer1.xml": "<w:p><w:t>" + "x" * 5000 + "</w:t></w:p>"}))
    assert d.status == "partial" and d.unread == ["word/footer1.xml"] and "A & B" in d.text


def test_pdf():
    d = files.extract(pdf_file(rb"(Hel\154o \(you\)) Tj T* [(wo) -20 (rld) -300 (again)] TJ"))
    assert (d.kind, d.status, d.pages, d.text, d.meta) == ("pdf", "readable", 1, "Hello (you)\nworld again", {"title": "A (b)"})
    table = b"1 beginbfchar <0041> <0048> endbfchar 1 beginbfrange <0042> <0043> <0069> endbfrange"
    mapped = pdf_file(b"<004100420043> Tj", b"4 0 obj << /Length 9 >> stream\n" + table + b"\nendstream endobj\n")
    assert files.extract(mapped).text == "Hij"
    assert files.extract(pdf_file(b"() Tj", b"/Image")).status == "opaque" and files.extract(b"%PDF-1.4 /Encrypt").unread == ["encrypted"]
    packed = zlib.compress(b"5 0 6 20 << /Type /Page >> << /Author (Ann) >>")
    more = files.extract(pdf_file(more=b"7 0 obj << /Type /ObjStm /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj\n"))
    assert (more.pages, more.meta["author"], more.text) == (2, "Ann", "Hello")
    assert pdf.inflate(zlib.compress(b"x" * 5000), 100) is None and pdf.inflate(b"junk", 100) is None


def test_images():
    assert images.metadata(jpeg()) == {"make": "Maker", "gps": "-33.500000, 151.210000", "comment": "hello"}
    assert images.metadata(png()) == {"author": "Jane", "note": "naïve"}
    bare = images.strip(jpeg())
    assert images.metadata(bare) == {} and bare.endswith(b"\xff\xda\0\x04xxpicture\xff\xd9") and b"\xff\xe0\0\x04ab" in bare
    assert images.metadata(images.strip(png())) == {} and b"IDATdata" in images.strip(png()) and images.strip(b"GIF89a") is None
    for k in range(0, len(jpeg()), 7):
        images.metadata(jpeg()[:k]), images.strip(jpeg()[:k])


@pytest.mark.parametrize("make", [docx, xlsx, pdf_file, jpeg, png])
def test_damaged_files_are_no_errors(make):
    data = make()
    for k in range(0, len(data), max(1, len(data) // 60)):
        files.extract(data[:k])
        files.extract(data[:k] + b"\xff\0" + data[k + 2 :])


def test_folder(spark, tmp_path):
    for name, data in {"a.txt": b"mail j@mail.org", "b/c.docx": docx(), "d.pdf": pdf_file(), "e.jpg": jpeg(), ".git/x.txt": b"k@mail.org", "f.mp4": b"l@mail.org", "g.txt": b"m@mail.org " * 100}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    got = files.read_files(spark, str(tmp_path / "in"), largest=1000 + 4 * len(docx()))
    assert {(r.path.rsplit("/", 1)[1], r.kind, r.status) for r in got.collect()} == {("a.txt", "text", "readable"), ("c.docx", "docx", "readable"), ("d.pdf", "pdf", "readable"), ("e.jpg", "jpeg", "metadata"), ("g.txt", "text", "readable")}
    small = files.read_files(spark, str(tmp_path / "in"), largest=1000).where("path like '%g.txt'").first()
    assert (small.kind, small.text) == ("large", None)
    found = findings(got.where("path not like '%g.txt'"), "path")
    assert {(r.path.rsplit("/", 1)[1], r.rule_id) for r in found.collect()} == {("a.txt", "email"), ("c.docx", "email"), ("c.docx", "person_name")}
    scanned = scan(got)
    assert files.exit_code(scanned) == 1 and files.exit_code(scanned.limit(0)) == 0  # a name warns
    files.write_report(scanned, str(tmp_path / "out"))
    assert "match" not in {f.name for f in spark.read.json(str(tmp_path / "out")).schema["findings"].dataType.elementType.fields}
    assert {r.content is None for r in files.stripped_images(spark, str(tmp_path / "in")).collect()} == {False}
