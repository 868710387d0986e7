"""Token ids of a corpus as binary files (operator 4).

Texts are put in ascending order of doc_id over a range partition, encoded there,
and written to shards of patched frame-of-reference blocks (``pfor``) in the
shared folder; a manifest table names the shards that count.  A task that is
run again writes new files, and the manifest names those of one run only.

Results: null text counts as empty (its only id is the end id).  Rows with the
same doc_id follow one another, ordered by a digest of their text; null doc_ids
come first.  An empty table gives no shards and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pfor
from .common import arrow_schema, get, id_text, kept, materialise, put, rows_batch, slices, strings_of, table, tidied, work_dir
from .ragged import Recent, at, spread, words_of

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Ids in a shard; distinct words that a worker keeps; shards that a task reads back.
SHARD_IDS, TABLE_MOST, SHARDS_READ = 4_000_000, 1_000_000, 16
#: Letters, and the punctuation after them, of a run that is nothing else.
PLAIN = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[.,!?]*)$"


class WordTable:
    """Ids of each distinct run of characters between spaces and line feeds, found once.

    No token of the vocabulary reaches over white space, and neither the
    normaliser nor the splitter looks past it, so the ids of a text are those
    of its runs, one after another.  A run of letters with punctuation after it
    is two words to the splitter; its parts are kept apart, so that the same
    word before a comma or with a capital is not encoded again.
    """

    def __init__(self, path: str, most: int = TABLE_MOST):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.words = Tokenizer.from_file(path), Recent(most)
        # Byte-level models write a byte that is printable as itself and the others as the signs from U+0100 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.signs = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")

    def library(self, words: list[str], plain: list[bool]) -> list[bytes]:
        """Ids of words.  What is plain letters is one word to the splitter and goes to its model at once, as the signs that stand for its bytes."""
        rest = iter(self.tok.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        model, signs, kind = self.tok.model.tokenize, self.signs, "H" if self.kind.itemsize == 2 else "I"
        return [array(kind, [t.id for t in model(w if w.isascii() else w.encode().decode("latin-1").translate(signs))] if p else next(rest).ids).tobytes() for w, p in zip(words, plain, strict=True)]

    def values(self, words: list[str], plain: list[bool]) -> list[bytes]:
        """Ids of each word, after the missing ones are learnt."""
        missing = set(self.words.missing(words))
        if missing:
            new, kinds = zip(*((w, p) for w, p in zip(words, plain, strict=True) if w in missing), strict=True)
            self.words.new.update(zip(new, self.library(new, kinds), strict=True))
        return list(map(self.words.new.__getitem__, words))

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id after it; their offsets)."""
        codes, runs, offsets = words_of(texts, " ", arrow=True)
        cut = pc.extract_regex(runs, PLAIN)
        plain, mark = cut.is_valid(), pc.fill_null(pc.struct_field(cut, 1), "").dictionary_encode()
        word = pc.if_else(plain, pc.utf8_lower(pc.struct_field(cut, 0)), runs).dictionary_encode()
        # What isn't plain may be spelt like a word that is, but never the other way round: a plain word is letters only.
        words, marks = word.dictionary.to_pylist(), mark.dictionary.to_pylist()
        letters = pc.match_substring_regex(word.dictionary, "^[a-zß-öø-ÿ]+$").to_pylist()
        values = [*self.values(words, letters), *self.values(marks, [False] * len(marks)), np.array([end_id], self.kind).tobytes()]
        # A run's punctuation goes after its word, where it has any, and the end id after each text.
        marked = np.flatnonzero(np.array([m != "" for m in marks], bool)[mark.indices.to_numpy()][codes])
        after = len(words) + mark.indices.to_numpy()[codes[marked]].astype(np.int64)
        place, value = np.concatenate([marked + 1, offsets[1:]]), np.concatenate([after, np.full(len(offsets) - 1, len(values) - 1)])
        ids, ends = spread(values, np.insert(word.indices.to_numpy()[codes].astype(np.int64), place, value), self.kind)
        return ids, at(ends, offsets + np.searchsorted(marked, offsets) + np.arange(len(offsets)))


def word_table(path: str) -> WordTable:
    return kept(("words", path), lambda: WordTable(path))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


MANIFEST, READ = "part long, seq long, path string, n_docs long, n_ids long", "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the shards below ``folder``; returns their manifest, in the order of doc_id, with ``start``.

    The texts themselves are dealt out by doc_id, and each task encodes what it
    writes: ids are never stored or shuffled before they are in their files.
    """
    path, spark = path or vocabulary_path(), docs.sparkSession
    # The text's digest in the key deals out rows that share a doc_id.
    rows = id_text(docs).withColumn("digest", F.xxhash64("text"))
    total = rows.select(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = int(max(1, min(1 << 20, max(total // (32 << 20), int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    schema = arrow_schema(MANIFEST)

    @tidied(("words", path))
    def run(batches):
        from pyspark import TaskContext

        part, seq, tab = TaskContext.get().partitionId(), 0, word_table(path)
        doc_ids, counts, held, n = [], [], [], 0

        def shard():
            nonlocal seq, n
            name = f"{folder}/{part:07d}-{seq:05d}-{uuid.uuid4().hex}.pfor"
            put(name, pfor.encode(doc_ids, np.concatenate(counts), np.concatenate(held)))
            out = rows_batch(schema, [[part], [seq], [name], [len(doc_ids)], [n]])
            seq, n = seq + 1, 0
            for x in (doc_ids, counts, held):
                x.clear()
            return out

        for b in slices(batches):
            ids, place = tab.encode(strings_of(b), end_id)
            doc_ids += b.column(0).to_pylist()
            counts.append(np.diff(place))
            held.append(ids)
            n += len(ids)
            if n >= shard_ids:
                yield shard()
        if n:
            yield shard()

    dealt = rows.repartitionByRange(parts, "doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    shards = materialise(dealt, "token-manifest", run, MANIFEST)
    # Ids before each shard: within its partition, then over partitions, which are far fewer than shards' documents.
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    return shards.withColumn("in_part", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(before, "part").select("part", "seq", "path", "n_docs", "n_ids", (F.col("in_part") + F.col("before")).alias("start"))


def checksums(shard: pfor.Shard, ends: np.ndarray) -> np.ndarray:
    """crc32 of each document's ids; a document may reach over several ranges of ids."""
    crc, k, at, stop = np.zeros(len(ends), np.int64), 0, 0, ends.tolist()
    for ids in shard.ranges():
        data, base = memoryview(np.ascontiguousarray(ids, "<u4").tobytes()), at
        to = base + len(ids)
        while at < to:
            while stop[k] <= at:
                k += 1
            cut = min(to, stop[k])
            crc[k] = zlib.crc32(data[4 * (at - base) : 4 * (cut - base)], int(crc[k]))
            at = cut
    return crc


def read_files(manifest: DataFrame, parts: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    schema = arrow_schema(READ)

    @tidied()
    def run(batches):
        for b in batches:
            for path, start in zip(*(b.column(k).to_pylist() for k in (0, 1)), strict=True):
                shard = pfor.Shard(get(path))
                ends = np.cumsum(shard.counts, dtype=np.int64)
                yield rows_batch(schema, [shard.doc_ids, start + ends - shard.counts, shard.counts.astype(np.int64), checksums(shard, ends)])

    return manifest.select("path", "start").repartition(parts, "path").mapInArrow(run, READ)


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_files(table(spark, sf_dir, "documents"), work_dir(spark, "token-files"))
    # A task reads some shards one after another: each is unpacked in ranges, so that only time is at stake.
    tasks = max(spark.sparkContext.defaultParallelism, manifest.count() // SHARDS_READ)
    return read_files(manifest, min(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
