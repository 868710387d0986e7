"""SentencePiece encoding and decoding by a table of distinct chunks (operators 8 and 9).

When no piece of the model has a white-space marker after another character,
and none has a line feed, a piece can't reach from one marked word into the
next, nor over a line feed: the text cut before each run of markers and each
line feed can be segmented chunk by chunk, every distinct chunk once, and the
ids joined back by position.  If a model has such pieces, whole texts go to the
library instead.

Results: null text counts as empty (no ids).  Repeated rows each give a row.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, id_text, kept, rows_batch, slices, strings_of, table, tidied
from .ragged import Recent, at, spread, words_of

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Distinct chunks that a worker keeps, about; those not seen for longest go.
TABLE_MOST = 500_000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(text: str) -> list[str]:
    """The text's chunks; together they lose nothing.

    The library puts a marker before a text that isn't empty and turns spaces
    into markers.  A chunk is one or more markers and what follows, given
    without its first marker, or a line feed and what follows it.
    """
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [x[1:] if x[0] == " " else x for x in re.findall(" +[^ \n]*|\n[^ \n]*", " " + text)]
    return text.replace("\n", " \n").split(" ")


def cut_all(texts: pa.StringArray):
    """(rows, code of each chunk, distinct chunks, offsets of the rows' chunks), for texts by the way they are cut."""
    slow = pc.match_substring(texts, MARK)
    for found in (pc.match_substring(texts, "  "), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.equal(texts, "")):
        slow = pc.or_(slow, found)
    slow = slow.to_numpy(zero_copy_only=False)
    if len(rows := np.flatnonzero(~slow)):
        yield rows, *words_of(texts.filter(pa.array(~slow)), " \n")
    if len(rows := np.flatnonzero(slow)):
        cuts = [cut(texts[r].as_py()) for r in rows]
        nth: dict[str, int] = {}
        codes = np.array([nth.setdefault(c, len(nth)) for x in cuts for c in x], np.int64)
        yield rows, codes, list(nth), np.concatenate([[0], np.cumsum([len(x) for x in cuts])])


class ChunkTable:
    """Ids of each distinct chunk, found once."""

    def __init__(self, path: str, most: int = TABLE_MOST):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most = most
        self.ids, self.n = Recent(most), Recent(most)  # ids in decimal, a comma after each; their number
        self.back: dict[str, str] = {}  # decoded chunks, where they differ from the chunk
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        probe = self.sp.encode("a b")
        self.by_chunk = (
            not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
            and self.sp.encode("b") == probe[-1:] and self.sp.encode(" ") != []  # a marker goes before the text; spaces are kept
        )
        self.alone = self.sp.piece_to_id(MARK)

    def segment(self, chunks: list[str]) -> list[list[int]]:
        found = self.sp.encode(chunks, num_threads=1)
        return [[self.alone] if not c else x[1:] if c[0] == "\n" else x for c, x in zip(chunks, found, strict=True)]

    def values(self, known: Recent, chunks: list[str]) -> list:
        """What the table has of each chunk, after the missing ones are learnt."""
        if new := known.missing(chunks):
            ids = self.segment(new)
            if known is self.n:
                known.new.update((c, len(x)) for c, x in zip(new, ids, strict=True))
            else:
                known.new.update((c, "".join([f"{i}," for i in x]).encode()) for c, x in zip(new, ids, strict=True))
                if len(self.back) > self.most:
                    self.back = {c: d for c, d in self.back.items() if c in known.new or c in known.old}
                self.back.update((c, d) for c, d in zip(new, self.sp.decode(ids, num_threads=1), strict=True) if c != d)
        return list(map(known.new.__getitem__, chunks))

    def encode(self, texts: pa.StringArray) -> list[tuple[str, int, str]]:
        """For each text its ids, joined by commas, their number, and the decoded text."""
        whole = texts.to_pylist()
        if not self.by_chunk:
            return [(",".join(map(str, x)), len(x), self.sp.decode(x)) for x in self.sp.encode(whole, num_threads=1)]
        out: list = [None] * len(whole)
        for rows, codes, chunks, offsets in cut_all(texts):
            ids, ends = spread(self.values(self.ids, chunks), codes, np.uint8)
            commas = np.concatenate([[0], np.cumsum(ids == 44)])
            place = at(ends, offsets)
            n = np.diff(commas[place]).tolist()
            ids, place = ids.tobytes().decode("ascii"), place.tolist()
            odd = np.fromiter((c in self.back for c in chunks), bool, len(chunks)) if self.back else None
            for k, row in enumerate(rows):
                mine = codes[offsets[k] : offsets[k + 1]]
                if odd is not None and odd[mine].any():
                    back = " ".join([self.back.get(c, c) for c in (chunks[i] for i in mine)]).replace(" \n", "\n")
                else:  # the library decoded each of its chunks to the chunk
                    back = whole[row].replace(MARK, " ")
                out[row] = ids[place[k] : max(place[k], place[k + 1] - 1)], n[k], back
        return out

    def count(self, texts: pa.StringArray) -> np.ndarray:
        if not self.by_chunk:
            return np.array([len(x) for x in self.sp.encode(texts.to_pylist(), num_threads=1)], np.int64)
        out = np.zeros(len(texts), np.int64)
        for rows, codes, chunks, offsets in cut_all(texts):
            n = np.array(self.values(self.n, chunks), np.int64)
            out[rows] = np.diff(np.concatenate([[0], np.cumsum(n[codes])])[offsets])
        return out


def chunk_table(path: str) -> ChunkTable:
    return kept(("chunks", path), lambda: ChunkTable(path))


OUT = "doc_id long, ids string, n_tokens long, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids joined by commas, n_tokens, decoded text) of each whole text."""
    path, schema = path or model_path(), arrow_schema(OUT)

    @tidied(("chunks", path))
    def run(batches):
        tab = chunk_table(path)
        for b in slices(batches, most_bytes=8 << 20):
            got = tab.encode(strings_of(b))
            yield rows_batch(schema, [b.column(0), *(list(x) for x in zip(*got, strict=True))])

    return id_text(docs).mapInArrow(run, OUT)


def encode_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The same, with the ids and the decoded text as SHA-256 in place of themselves."""
    path, schema = path or model_path(), arrow_schema(DIGESTS)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    @tidied(("chunks", path))
    def run(batches):
        tab = chunk_table(path)
        for b in slices(batches, most_bytes=8 << 20):
            got = tab.encode(strings_of(b))
            yield rows_batch(schema, [b.column(0), [n for _, n, _ in got], [sha(x) for x, _, _ in got], [sha(y) for _, _, y in got]])

    return id_text(docs).mapInArrow(run, DIGESTS)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
