"""Removal of repeated strings by suffix sorting (operator 7).

Each byte that is covered by a 50-byte string which also starts in a document
with a smaller doc_id is removed.  All positions of all texts can't be sorted in
one place, so they are dealt out by anchors: of the 24-byte strings within a
50-byte window, the one with the smallest hash, the leftmost of equals.  Equal
windows have equal anchors, so only windows of one anchor need comparing.

1. ``segments``: documents are packed into files of about 4 MB in the shared
   folder; a manifest table names them.  All later steps read these files.
2. ``shared_anchors``: hashes of each segment's anchors, sorted, go to buckets
   of hash ranges, which say for each whether two or more documents have it.
   Only a filter: 32 bits of a hash within its bucket are enough.
3. ``contexts``: the runs of windows of each shared anchor, as bytes with their
   smallest doc_id, each different one once a segment.
4. ``repeats``: the windows of all runs of a bucket are put in suffix order by
   deep-shallow sorting; each class of equal windows has a smallest doc_id.
5. ``decide``: segments get back, a bit for each window, whether a smaller
   document has it, and mark and hash what is left.

An anchor in more than ``HOT`` documents is not kept in one bucket: its windows
become runs of their own, dealt by the hash of the window.

Results: one row for each document row.  Null text counts as empty.  A null
doc_id comes after all others; documents with the same id do not affect one
another.  Texts shorter than 50 bytes lose nothing.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, free_name, get, id_text, materialise, put, rows_batch, table, tidied, work_dir
from .shingles import mix
from .suffixes import deep_shallow

LENGTH, GRAM = 50, 24
SEGMENT, HOT = 4 << 20, 4096
NO_ID = (1 << 63) - 1
_B = 0x9E3779B97F4A7C15


def pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(struct.pack("<q", a.nbytes) + np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind in kinds:
        (n,) = struct.unpack_from("<q", raw, at)
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


MANIFEST = "path string, bytes long"


def segments(docs: DataFrame, folder: str, size: int = SEGMENT) -> DataFrame:
    """Write the segments; their manifest."""
    schema = arrow_schema(MANIFEST)

    @tidied()
    def run(batches):
        ids, texts, n = [], [], 0

        def write():
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            name = f"{folder}/{uuid.uuid4().hex}.seg"
            put(name, pack(np.array([NO_ID if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), offsets, np.frombuffer(b"".join(texts), np.uint8)))
            return rows_batch(schema, [[name], [int(offsets[-1])]])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                if texts and n + len(data) > size:
                    yield write()
                    ids, texts, n = [], [], 0
                ids.append(i), texts.append(data)
                n += len(data)
        if texts:
            yield write()

    return materialise(id_text(docs), "segments", run, MANIFEST)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the 24-byte strings at each position."""
    h = data.astype(np.uint64) + np.uint64(1)
    parts, power, size = {}, _B, 1
    while size < 16:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power & (1 << 64) - 1, size * 2
        parts[size] = h
    eight, sixteen = parts[8], parts[16]
    return mix(sixteen[: len(data) - GRAM + 1] * np.uint64(pow(_B, 8, 1 << 64)) + eight[16 : 16 + len(data) - GRAM + 1])


class Segment:
    """A segment's texts and the runs of windows with the same anchor."""

    def __init__(self, path: str):
        self.ids, self.null, self.offsets, self.data = unpack(get(path), "<i8", "u1", "<i8", "u1")
        self._runs()

    def _runs(self, block: int = 1 << 18) -> None:
        n, wide = len(self.data), LENGTH - GRAM + 1
        last = n - LENGTH + 1
        starts, hashes, ends = [], [], []
        owner_end = self.offsets[1:]
        for at in range(0, max(0, last), block):
            to = min(last, at + block)
            h = gram_hashes(self.data[at : to + LENGTH - 1])
            low = ((h >> np.uint64(32)) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
            m = low
            for step in (1, 2, 4, 8):
                m = np.minimum(m[:-step], m[step:])
            m = np.minimum(m[: to - at], m[wide - 16 : wide - 16 + to - at])  # 27 = two overlapping runs of 16
            p = np.arange(at, to)
            doc_end = owner_end[np.searchsorted(owner_end, p, "right")]
            fits = p + LENGTH <= doc_end
            p, q = p[fits], m[fits].astype(np.int64) & 0xFFFFFFFF
            if not len(p):
                continue
            new = np.concatenate([[True], (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)])
            first = np.flatnonzero(new)
            starts.append(p[first])
            ends.append(p[np.append(first[1:], len(p)) - 1])
            hashes.append(h[q[first]])
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.first, self.last, self.hash = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, np.uint64)
        self.doc = np.searchsorted(self.offsets, self.first, "right") - 1
        # Empty texts share their offset with the next one; the last of equal offsets owns the bytes.

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(anchors' different hashes in order, documents that have each)."""
        order = np.lexsort((self.doc, self.hash))
        h, d = self.hash[order], self.ids[self.doc[order]]
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
        fresh = new.copy()
        if len(h):
            fresh[1:] |= d[1:] != d[:-1]
        begin = np.flatnonzero(new)
        return h[begin], np.add.reduceat(fresh, begin, dtype=np.int64) if len(begin) else np.empty(0, np.int64)

    def contexts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, document, dealing hash, context's number) of the runs to compare; ``codes`` as for ``distinct``."""
        known, _ = self.distinct()
        code = codes[np.searchsorted(known, self.hash)] if len(known) else np.empty(0, np.uint8)
        plain, hot = code == 1, np.flatnonzero(code == 2)
        first, last, doc, deal = self.first[plain], self.last[plain], self.doc[plain], self.hash[plain]
        if len(hot):
            n = self.last[hot] - self.first[hot] + 1
            p = np.repeat(self.first[hot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            h = np.zeros(len(p), np.uint64)
            for k in range(LENGTH):
                h = h * np.uint64(_B) + self.data[p + k]
            first, last, doc, deal = np.append(first, p), np.append(last, p), np.append(doc, np.repeat(self.doc[hot], n)), np.append(deal, mix(h))
        raw, nth = self.data.tobytes(), {}
        number = np.fromiter((nth.setdefault(raw[a : b + LENGTH], len(nth)) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.int64, len(first))
        return first, last, doc, mix(deal), number


CODES, RUNS = "bucket long, zero long, path string, data binary", "bucket long, zero long, path string, data binary"
BACK = "path string, bucket long, zero long, data binary"


def grouped(batches) -> Iterator[list[tuple]]:
    """Rows of each consecutive first column."""
    for rows, begin, end in units_by_first(batches):
        for a, b in zip(begin, np.append(begin[1:], end), strict=True):
            part = rows.slice(a, b - a)
            yield list(zip(*(part.column(k).to_pylist() for k in range(part.num_columns)), strict=True))


def units_by_first(batches):
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not t.num_rows:
            continue
        key = np.array(t.column(0).to_pylist(), object)
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        whole = t.to_batches()[0]
        if len(begin) > 1:
            yield whole.slice(0, begin[-1]), begin[:-1], begin[-1]
        held = whole.slice(begin[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0]), held.num_rows


def shared_anchors(manifest: DataFrame, buckets: int, parts: int, hot: int) -> DataFrame:
    """(path, bucket, zero, codes) of each segment and bucket: 0 in one document, 1 shared, 2 hot."""
    shift, schema, back = np.uint64(64 - buckets.bit_length() + 1), arrow_schema(CODES), arrow_schema(BACK)

    @tidied()
    def send(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                h, n = Segment(path).distinct()
                bucket = (h >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)
                low = (h if buckets == 1 else h << np.uint64(buckets.bit_length() - 1)) >> np.uint64(32)
                begin = np.searchsorted(bucket, np.arange(buckets + 1))
                some = [k for k in range(buckets) if begin[k] < begin[k + 1]]
                data = [pack(low[begin[k] : begin[k + 1]].astype("<u4"), np.minimum(n[begin[k] : begin[k + 1]], 65535).astype("<u2")) for k in some]
                yield rows_batch(schema, [[-1, *some], [0] * (len(some) + 1), [path] * (len(some) + 1), [b"", *data]])  # -1: so that no segment is without a row

    @tidied()
    def count(batches):
        for rows in grouped(batches):
            if rows[0][0] < 0:
                yield rows_batch(back, [[r[2] for r in rows], [-1] * len(rows), [0] * len(rows), [b""] * len(rows)])
                continue
            got = [unpack(r[3], "<u4", "<u2") for r in rows]
            h, where = np.unique(np.concatenate([x for x, _ in got]), return_inverse=True)
            total = np.bincount(where, np.concatenate([n for _, n in got]), len(h))
            code = ((total > 1).astype(np.uint8) + (total > hot))[where]
            cut = np.cumsum([len(x) for x, _ in got])[:-1]
            yield rows_batch(back, [[r[2] for r in rows], [r[0] for r in rows], [0] * len(rows), [pack(c) for c in np.split(code, cut)]])

    # The rows of bucket -1 say nothing but that a segment is there; they are dealt out by path.
    sent = manifest.select("path").repartition(parts, "path").mapInArrow(send, CODES)
    return sent.repartition(parts, "bucket", F.when(F.col("bucket") < 0, F.col("path"))).sortWithinPartitions("bucket").mapInArrow(count, BACK)


def codes_of(rows: list[tuple]) -> np.ndarray:
    got = [unpack(r[3], "u1")[0] for r in sorted(rows, key=lambda r: r[1]) if r[1] >= 0]
    return np.concatenate(got) if got else np.empty(0, np.uint8)


def dealt(seg: Segment, codes: np.ndarray, buckets: int):
    """(runs as from ``contexts``, smallest doc_id, bucket and one run of each context, contexts in the order of buckets)."""
    first, last, doc, deal, number = seg.contexts(codes)
    n = int(number.max()) + 1 if len(number) else 0
    least = np.full(n, NO_ID, np.int64)
    np.minimum.at(least, number, seg.ids[doc])
    one = np.zeros(n, np.int64)
    one[number[::-1]] = np.arange(len(number))[::-1]
    bucket = (deal[one] % np.uint64(buckets)).astype(np.int64)
    return first, last, doc, number, least, one, bucket, np.argsort(bucket, kind="stable")


def contexts(codes: DataFrame, buckets: int, parts: int) -> DataFrame:
    """(bucket, zero, path, runs) with the bytes and the smallest doc_id of each context."""
    schema = arrow_schema(RUNS)

    @tidied()
    def run(batches):
        for rows in grouped(batches):
            seg = Segment(rows[0][0])
            first, last, _, _, least, one, bucket, order = dealt(seg, codes_of(rows), buckets)
            begin = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [[-1], [rows[0][0]], [pack(codes_of(rows))]]
            raw = seg.data.tobytes()
            for k in range(buckets):
                of = order[begin[k] : begin[k + 1]]
                if len(of):
                    a, b = first[one[of]], last[one[of]] + LENGTH
                    text = b"".join([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    out[0].append(k), out[1].append(rows[0][0])
                    out[2].append(pack((b - a).astype("<i4"), least[of], np.frombuffer(text, np.uint8)))
            yield rows_batch(schema, [out[0], [0] * len(out[0]), out[1], out[2]])

    return codes.repartition(parts, "path").sortWithinPartitions("path").mapInArrow(run, RUNS)


def repeats(runs: DataFrame, parts: int) -> DataFrame:
    """(path, bucket, zero, bits): for each window of each context, whether a document smaller than the context's smallest has it."""
    schema = arrow_schema(BACK)

    @tidied()
    def run(batches):
        for rows in grouped(batches):
            if rows[0][0] < 0:
                yield rows_batch(schema, [[r[2] for r in rows], [-1] * len(rows), [0] * len(rows), [r[3] for r in rows]])
                continue
            got = [unpack(r[3], "<i4", "<i8", "u1") for r in rows]
            size = np.concatenate([x for x, _, _ in got]).astype(np.int64)
            least = np.concatenate([x for _, x, _ in got])
            data = np.concatenate([x for _, _, x in got])
            # Contexts that several segments have are sorted once, with the smallest of their doc_ids.
            raw, ends, nth = data.tobytes(), np.cumsum(size), {}
            which = np.fromiter((nth.setdefault(raw[e - m : e], len(nth)) for e, m in zip(ends.tolist(), size.tolist(), strict=True)), np.int64, len(size))
            one = np.empty(len(nth), np.int64)
            one[which[::-1]] = np.arange(len(size))[::-1]
            lowest = np.full(len(nth), NO_ID, np.int64)
            np.minimum.at(lowest, which, least)
            n = size[one] - LENGTH + 1
            first = np.cumsum(n) - n
            starts = np.repeat((ends - size)[one] - first, n) + np.arange(n.sum())
            order, new = deep_shallow(data, starts, LENGTH)
            smallest = np.empty(len(starts), np.int64)
            smallest[order] = np.minimum.reduceat(np.repeat(lowest, n)[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            n = size - LENGTH + 1
            found = smallest[np.repeat(first[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())] < np.repeat(least, n)
            cut = np.cumsum([int((x.astype(np.int64) - LENGTH + 1).sum()) for x, _, _ in got])[:-1]
            yield rows_batch(schema, [[r[2] for r in rows], [r[0] for r in rows], [0] * len(rows), [pack(np.packbits(x)) for x in np.split(found, cut)]])

    return runs.repartition(parts, "bucket", F.when(F.col("bucket") < 0, F.col("path"))).sortWithinPartitions("bucket", "path").mapInArrow(run, BACK)


def removed_bytes(seg: Segment, rows: list[tuple], buckets: int) -> np.ndarray:
    """Which bytes of the segment are covered by a repeated string."""
    by = {r[1]: r[3] for r in rows}
    first, last, doc, number, least, one, bucket, order = dealt(seg, unpack(by[-1], "u1")[0], buckets)
    n = (last - first + 1)[one] if len(one) else np.empty(0, np.int64)
    bits = np.zeros(int(n.sum()), bool)
    place = np.empty(len(one), np.int64)  # where the bits of each context begin
    place[order] = np.cumsum(n[order]) - n[order]
    begin = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in range(buckets):
        of = order[begin[k] : begin[k + 1]]
        if len(of):
            m = int(n[of].sum())
            bits[place[of[0]] : place[of[0]] + m] = np.unpackbits(unpack(by[k], "u1")[0], count=m).astype(bool)
    size = last - first + 1
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flagged = bits[np.repeat(place[number], size) + at] | np.repeat(seg.ids[doc] > least[number], size)
    p = (np.repeat(first, size) + at)[flagged]
    edge = np.zeros(len(seg.data) + 1, np.int32)
    np.add.at(edge, p, 1)
    np.add.at(edge, p + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEPT = OUT + ", digest binary, kept binary, spans binary"
TEXT = OUT + ", digest binary, kept string, spans binary"


def decide(back: DataFrame, buckets: int, parts: int, texts: bool = False, characters: bool = False) -> DataFrame:
    ddl = (TEXT if characters else KEPT) if texts else OUT
    schema = arrow_schema(ddl)

    @tidied()
    def run(batches):
        for rows in grouped(batches):
            seg = Segment(rows[0][0])
            gone = removed_bytes(seg, rows, buckets)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = seg.offsets[:-1][np.diff(seg.offsets) > 0]
            begins[heads] = gone[heads]
            total, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
            at, ends = np.flatnonzero(begins), np.flatnonzero(gone & ~np.concatenate([gone[1:] & ~begins[1:], [False]]))[: int(spans[-1])]
            out = [[] for _ in schema]
            o = seg.offsets
            keep = ~gone
            for k in range(len(seg.ids)):
                part = seg.data[o[k] : o[k + 1]]
                left = part[keep[o[k] : o[k + 1]]].tobytes() if total[o[k + 1]] > total[o[k]] else part.tobytes()
                values = [None if seg.null[k] else int(seg.ids[k]), len(part), int(total[o[k + 1]] - total[o[k]]), int(spans[o[k + 1]] - spans[o[k]]), hashlib.sha256(left).hexdigest()]
                if texts:
                    mine = slice(spans[o[k]], spans[o[k + 1]])
                    values += [hashlib.md5(part.tobytes()).digest(), left.decode("utf-8", "ignore") if characters else left, (np.stack([at[mine], ends[mine] + 1], 1) - o[k]).astype("<i8").tobytes()]
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield rows_batch(schema, out)

    return back.repartition(parts, "path").sortWithinPartitions("path").mapInArrow(run, ddl)


def suffix_dedup(docs: DataFrame, texts: bool = False, segment: int = SEGMENT, hot: int = HOT, characters: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256); with ``texts`` also the bytes kept and the removed (start, end) pairs, as i64.

    With ``characters`` the bytes kept are a string, without what is left of characters cut in two.
    """
    spark = docs.sparkSession
    manifest = segments(docs, work_dir(spark, "segment-files"), segment)
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = int(max(2 * least, min(100_000, total >> 24)))
    buckets = 1 << max(4, min(20, max(int(total >> 23).bit_length(), least.bit_length())))  # 8 MB of text or less for each, and one for each partition
    codes = shared_anchors(manifest, buckets, parts, hot)
    back = repeats(contexts(codes, 2 * buckets, parts), parts)
    return decide(back, 2 * buckets, parts, texts, characters)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their repeated strings, all columns kept; ``n_chars``, if there, is the new length.

    Bytes are removed, and what is left of a character cut in two goes with it.
    A text of which nothing is left stays as an empty one.
    """
    name = {k: free_name(docs, k) for k in ("own_id", "own_digest", "kept_text")}
    id_key = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(""))
    kept = suffix_dedup(docs, texts=True, characters=True).select(id_key("doc_id"), "digest", "kept").toDF(*name.values())
    # Equal rows have equal results.  The texts' size can't be told from the manifest that they come from, so the join is never to be a broadcast; it uses the partitions of this step.
    texts = kept.dropDuplicates([name["own_id"], name["own_digest"]]).hint("merge")
    keyed = docs.withColumn("text", F.unhex(F.md5(F.coalesce("text", F.lit("")))))  # the text itself need not move
    out = keyed.join(texts, (id_key("doc_id") == F.col(name["own_id"])) & (F.col("text") == F.col(name["own_digest"])))
    new = {"text": F.col(name["kept_text"]), "n_chars": F.length(name["kept_text"]).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*(new[c].alias(c) if new.get(c) is not None else F.col(f"`{c}`") for c in docs.columns))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
