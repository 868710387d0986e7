"""Files as documents: kinds by their first bytes, and the text of each kind."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftwell import prepare
from siftwell.sources import images
from siftwell.sources.office import Extract, extract_zip
from siftwell.sources.pdf import extract_pdf

#: Published magic numbers.
MAGIC = [
    (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole2"), (b"\xff\xd8\xff", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"BM", "bmp"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"),
    (b"PK\x03\x04", "zip"), (b"PK\x05\x06", "zip"), (b"{\\rtf", "rtf"), (b"%!PS", "postscript"),
]
HEAD, LARGEST = 1024, 16 << 20
#: Folders that hold no documents, and endings of files that hold no text.
SKIPPED_FOLDERS = (".git", "node_modules", "dist", "build", "coverage", ".next", "vendor")
SKIPPED_ENDINGS = ("ico", "woff", "woff2", "ttf", "eot", "mp3", "mp4", "mov", "avi", "webm", "wav", "gz", "tgz", "bz2", "xz", "7z", "rar", "jar", "class", "so", "dll", "exe", "wasm")


def sniff_bytes(data: bytes) -> str:
    """Kind of a file by its content; the name says nothing."""
    head = data[:HEAD]
    if b"%PDF-" in head:
        return "pdf"
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "webp"
    return next((kind for magic, kind in MAGIC if head.startswith(magic)), "binary" if b"\0" in head else "text")


def sniff(content: Column) -> Column:
    """The same as a column, for files of which only the kind is asked."""
    head = F.hex(F.substring(content, 1, HEAD))
    found = lambda h: head.rlike(f"^(?:..)*?{h}")  # noqa: E731  whole bytes, not halves of two
    kind = F.when(found("00"), "binary").otherwise("text")
    for magic, name in reversed(MAGIC):
        kind = F.when(head.startswith(magic.hex().upper()), name).otherwise(kind)
    kind = F.when(head.rlike("^52494646.{8}57454250"), "webp").otherwise(kind)
    return F.when(F.octet_length(content) == 0, "text").when(found("255044462D"), "pdf").otherwise(kind)


#: Groups of RTF that hold no text of the document.
RTF_ASIDE = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "object", "header", "footer", "generator", "themedata", "datastore", "listtable", "listoverridetable"}
RTF_TOKEN = re.compile(r"\\u(-?\d+) ?|\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z0-9])|([{}])|([^\\{}]+)")
RTF_SIGNS = {"par": "\n", "line": "\n", "row": "\n", "sect": "\n", "page": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf_text(rtf: str) -> str:
    """Plain text: destinations aside, characters by number, code page and name, controls left out."""
    out: list[str] = []
    aside = [False]
    skip, after_u = 1, 0
    for number, code, word, value, sign, brace, text in RTF_TOKEN.findall(rtf):
        if brace == "{":
            aside.append(aside[-1])
        elif brace == "}":
            aside = aside[:-1] or [False]
        elif sign == "*" or word in RTF_ASIDE:
            aside[-1] = True
        elif word == "uc" and value:
            skip = int(value)
        elif aside[-1]:
            continue
        elif number:
            out.append(chr(int(number) % 65536))
            after_u = skip
            continue
        elif code or text:
            part = bytes.fromhex(code).decode("cp1252", "replace") if code else text.replace("\r", "").replace("\n", "")
            gone = min(after_u, len(part))
            out.append(part[gone:])
            after_u -= gone
            continue
        elif word:
            out.append(RTF_SIGNS.get(word, ""))
        elif sign:
            out.append({"~": " ", "_": "-", "-": "", "\n": "\n", "\r": "\n"}.get(sign, sign))
        after_u = 0
    merged = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return merged.strip()


def extract(data: bytes) -> Extract:
    """Kind, status and text of a file's content; a file that breaks its reader is opaque, and says why."""
    kind = sniff_bytes(data)
    try:
        if kind == "text":
            return Extract(kind, "readable", data.decode("utf-8", "replace").removeprefix("\ufeff"), [], {})
        if kind == "rtf":
            return Extract(kind, "readable", rtf_text(data.decode("latin-1")), [], {})
        if kind == "zip":
            return extract_zip(data)
        if kind == "pdf":
            return extract_pdf(data)
        if kind in ("jpeg", "png"):
            meta = images.metadata(data)
            return Extract(kind, "metadata" if meta else "opaque", "\n".join(f"{k}: {v}" for k, v in meta.items()), ["the picture"], meta)
    except Exception as e:
        return Extract(kind, "opaque", "", [f"{type(e).__name__}: {e}"], {})
    return Extract(kind, "opaque", "", [], {})


EXTRACTED = "kind string, status string, text string, unread array<string>, meta map<string,string>, pages int"


def extracted(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds kind, status, text, unread, meta and pages of each row's file, in place of its content; null content is an empty text."""
    added = T._parse_datatype_string(EXTRACTED)
    kept = [c for c in df.columns if c != content_col and c not in added.names]
    schema = T.StructType([*(df.schema[c] for c in kept), *added.fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                e = extract(b.column(len(kept))[k].as_py() or b"")
                values = [e.kind, e.status, e.text if e.status != "opaque" or e.text else None, e.unread, list(e.meta.items()), e.pages]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(k, 1) for c in range(len(kept))), *(pa.array([v], arrow.field(len(kept) + n).type) for n, v in enumerate(values))], schema=arrow)

    prepare(df.sparkSession)
    return df.select(*kept, content_col).mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str, largest: int = LARGEST) -> DataFrame:
    """(path, length, kind, status, text, unread, meta, pages) of a folder's files, whatever folder below it they are in.

    Folders and endings that hold no text are left out.  Files larger than ``largest`` are named (kind ``large``), not read.  Findings of a text: ``scan`` of the result.
    """
    files = prepare(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = F.col("path").rlike(rf"/(?:{'|'.join(map(re.escape, SKIPPED_FOLDERS))})/") | F.lower("path").rlike(rf"\.(?:{'|'.join(SKIPPED_ENDINGS)})$")
    files = files.where(~inside)
    # The reader knows a file's length before it opens it: large ones are told by a scan that leaves the content out.
    large = files.where(F.col("length") > largest).select("path", "length", F.lit("large").alias("kind"), F.lit("opaque").alias("status"))
    return extracted(files.where(F.col("length") <= largest).select("path", "length", "content")).unionByName(large, allowMissingColumns=True)


def stripped_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): images of a folder without their metadata; null where the format can't be stripped."""
    files = prepare(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= LARGEST)
    kind = sniff(F.col("content"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([images.strip(c.as_py()) for c in b.column(1)], pa.binary())], names=["path", "content"])

    return files.where(kind.isin("jpeg", "png", "gif", "webp", "bmp", "tiff")).select("path", "content").mapInArrow(run, "path string, content binary")


def write_report(scanned: DataFrame, path: str, id_col: str = "path") -> None:
    """Findings as JSON lines, without the values themselves."""
    found = F.transform("findings", lambda f: f.dropFields("match"))
    scanned.select(id_col, "verdict", found.alias("findings")).write.json(path)


def exit_code(scanned: DataFrame) -> int:
    """0 if all is clean, 1 if something warns, 2 if something blocks: one aggregate, one row."""
    worst = scanned.agg(F.max(F.when(F.col("verdict") == "block", 2).when(F.col("verdict") == "warn", 1).otherwise(0))).first()[0]
    return int(worst or 0)
