"""N-gram Jaccard join with Bayesian candidate pruning (operator 5).

Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more are linked.  Equal texts are first made one class, with a count.  Classes
that share a band of their MinHash signature are candidates; their signatures
are compared 16 values at a time, and a pair is dropped as soon as the posterior
probability that it reaches 0.8 falls below 1e-6.  The pairs left tie classes
into blocks.  Within a block all pairs are pruned in the same way and those left
verified on the exact shingle sets (of 64-bit hashes).

A band or a block with more than ``CHUNK`` classes, or a block with more than
``CHUNK_SHINGLES`` shingles, is cut into chunks, and each pair of chunks is a
task's unit of its own, so no group has to fit in one task.
Pairs are never rows: a unit gives each class its number of links and a
spanning forest of them.

Result: one row for each document row: ``class_id``, the smallest doc_id of the
documents it is linked to directly or through others; ``n_links``, the other
rows that it is linked to (equal texts included); ``n_text_links``, the
different texts among them.  Null and empty texts have no links, and their
class is their own id.  Null ids come after all others: a class has a null id
only if all its documents do.  Texts of one to four words are one shingle.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, free_name, id_text, materialise, rows_batch, slices, strings_of, table, tidied
from .components import components
from .ragged import Recent
from .shingles import SHORT, SIMILARITY, Union, band_keys, least_matches, shingles, signatures, survivors

#: Classes in a chunk and shingles in one of a block, about; rows up to which a table of digests is broadcast (24 bytes each).
CHUNK, CHUNK_SHINGLES, BROADCAST_ROWS = 512, 1 << 20, 1_000_000
#: Shingles looked up at a time when a text's partners are verified.
LOOKED_UP = 1 << 20
#: Words whose hashes a task remembers, about 170 bytes each.
RECENT = 1 << 18
NO_ID = (1 << 63) - 1


def with_digest(docs: DataFrame) -> DataFrame:
    return id_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.md5("text")))


def classes_of(docs: DataFrame) -> DataFrame:
    """One row for each different text with shingles: node, digest, smallest doc_id, rows, shingles, low bytes and band keys."""
    ddl = "doc_id long, digest binary, low binary, keys binary, size long"
    schema = arrow_schema(ddl)

    @tidied()
    def run(batches):
        known = Recent(RECENT)
        for b in slices(batches, most_bytes=2 << 20):
            hashes, offsets = shingles(strings_of(b), known)
            has = np.diff(offsets) > 0
            signs = signatures(hashes, offsets)
            low, keys = (signs[:, :SHORT] & np.uint32(255)).astype(np.uint8), band_keys(signs)
            kept = b.filter(pa.array(has))
            yield rows_batch(schema, [kept.column(0), kept.column(2), [x.tobytes() for x in low], [x.tobytes() for x in keys], np.diff(offsets)[has]])

    rows = with_digest(docs).mapInArrow(run, ddl)
    found = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("low").alias("low"), F.first("keys").alias("keys"))
    return materialise(found.withColumn("node", F.monotonically_increasing_id()), "classes")


def in_units(rows: DataFrame, chunks: Column) -> DataFrame:
    """Rows of a group dealt to its pairs of chunks: adds ``i``, ``j`` and ``mine``, the row's own one of the two."""
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks"))
    rows = rows.withColumn("chunks", chunks.cast("long")).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return rows.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))


def units(batches, columns: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows of consecutive equal (group, i, j), the first three columns."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if held is None else [held, batch])
        t = t.combine_chunks()
        key = [t.column(k).to_numpy() for k in range(3)]
        n = t.num_rows
        if not n:
            continue
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])
        begin = np.flatnonzero(new)
        whole = t.to_batches()[0]
        if len(begin) > 1:
            yield whole.slice(0, begin[-1]), begin[:-1], begin[-1]
        held = whole.slice(begin[-1])
    if held is not None and held.num_rows:
        yield held, np.array([0]), held.num_rows


def fixed(column: pa.Array, kind, width: int) -> np.ndarray:
    """Binary values of one width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def forest(pairs: np.ndarray, n: int) -> list[int]:
    """Which of the pairs tie together what earlier ones didn't."""
    sets = Union(n)
    return [k for k, (x, y) in enumerate(pairs.tolist()) if sets.join(x, y)]


def pairs_of(size: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if side is None:
        return np.triu_indices(size, 1)
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(x, len(y)), np.tile(y, len(x))


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(a, b): spanning forests of the pairs that share a band and survive the pruning."""
    ddl = "key long, node long"
    schema = arrow_schema(ddl)

    @tidied()
    def bands(batches):
        for b in batches:
            keys = fixed(b.column(1), np.int64, len(b.column(1)[0].as_py()) // 8) if b.num_rows else np.empty((0, 1), np.int64)
            nodes = np.repeat(b.column(0).to_numpy(), keys.shape[1])
            yield rows_batch(schema, [keys.ravel(), nodes])

    rows = classes.select("node", "keys").mapInArrow(bands, ddl)
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = in_units(rows.join(shared, "key"), F.ceil(F.col("n") / CHUNK)).select("key", "i", "j", (F.col("mine") != F.col("i")).cast("int").alias("side"), "node")
    dealt = dealt.join(classes.select("node", "low"), "node").select("key", "i", "j", "side", "node", "low")
    least = least_matches()
    out = "a long, b long"
    out_schema = arrow_schema(out)

    @tidied()
    def prune(batches):
        for rows, begin, end in units(batches, 6):
            size = np.diff(np.append(begin, end))
            node, low, side = rows.column(4).to_numpy(), fixed(rows.column(5), np.uint8, SHORT), rows.column(3).to_numpy()
            cross = rows.column(1).to_numpy()[begin] != rows.column(2).to_numpy()[begin]
            a, b = [], []
            for s in np.unique(size[~cross]):
                of = begin[(size == s) & ~cross]
                x, y = pairs_of(s, None)
                step = max(1, 200_000 // max(1, len(x)))
                for at in range(0, len(of), step):
                    some = of[at : at + step, None]
                    left, right = (some + x).ravel(), (some + y).ravel()
                    stay = survivors(low[left], low[right], least)
                    left, right = left[stay], right[stay]
                    if s > 8:
                        ties = forest(np.stack([left, right], 1) - some[0, 0], int(some[-1, 0] - some[0, 0]) + s) if len(stay) else []
                        left, right = left[ties], right[ties]
                    a.append(node[left]), b.append(node[right])
            for k in np.flatnonzero(cross):
                own = slice(begin[k], begin[k] + size[k])
                x, y = pairs_of(size[k], side[own])
                stay = survivors(low[own][x], low[own][y], least)
                ties = np.array(forest(np.stack([x[stay], y[stay]], 1), size[k]), np.int64)
                a.append(node[own][x[stay][ties]]), b.append(node[own][y[stay][ties]])
            a, b = np.concatenate([*a, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*b, np.empty(0, np.int64)]).astype(np.int64)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield rows_batch(out_schema, [both[:, 0], both[:, 1]])

    parts = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(prune, out)


def exact_links(low: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, least: dict[int, int], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit that reach the similarity, after pruning, by their exact sets."""
    x, y = pairs_of(len(sets), side)
    size = np.array([len(s) for s in sets])
    fit = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9
    x, y = x[fit], y[fit]
    stay = np.concatenate([at + survivors(low[x[at : at + 200_000]], low[y[at : at + 200_000]], least) for at in range(0, len(x), 200_000)] or [np.empty(0, np.int64)]).astype(np.int64)
    x, y = x[stay], y[stay]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    flag = np.zeros(int(ids.max()) + 1, np.int32)
    linked = np.zeros(len(x), bool)
    cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
    for a, b in zip(cuts, cuts[1:], strict=False):
        mine, others = x[a], y[a:b]
        own = ids[ends[mine] - size[mine] : ends[mine]]
        flag[own] = 1
        # By shingles, not by texts: long texts are looked up a few at a time.
        room = np.cumsum(size[others]) // LOOKED_UP
        steps = [a, *(a + 1 + np.flatnonzero(room[1:] != room[:-1])).tolist(), b]
        for at, to in zip(steps, steps[1:], strict=False):
            some = y[at:to]
            where = np.repeat(ends[some] - size[some] - (np.cumsum(size[some]) - size[some]), size[some])
            where += np.arange(len(where))
            common = np.add.reduceat(flag[ids[where]], np.cumsum(size[some]) - size[some])
            linked[at : at + len(some)] = common >= similarity * (size[mine] + size[some] - common) - 1e-9
        flag[own] = 0
    return x[linked], y[linked]


def verified(docs: DataFrame, classes: DataFrame, blocks: DataFrame, similarity: float) -> DataFrame:
    """(a, b, texts, rows): links of class a, or with b the edges of spanning forests."""
    members = blocks.join(classes.select("node", "digest", "least", "n", "low", "size"), "node")
    sizes = members.groupBy("root").agg(F.count("*").alias("classes"), F.sum("size").alias("shingles"))
    members = members.drop("size").join(sizes, "root")
    members = materialise(members, "members")
    wanted = members.select("digest", "least", "node")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    d = with_digest(docs)
    texts = d.join(wanted, (d.digest == wanted.digest) & (d.doc_id == wanted.least)).select("node", "text")
    dealt = in_units(members, F.greatest(F.ceil(F.col("classes") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES))).select("root", "i", "j", (F.col("mine") != F.col("i")).cast("int").alias("side"), "node", "n", "low")
    dealt = dealt.join(texts, "node").select("root", "i", "j", "side", "node", "n", "low", "text")
    least = least_matches(similarity)
    ddl = "a long, b long, texts long, rows long"
    schema = arrow_schema(ddl)

    @tidied()
    def run(batches):
        known = Recent(RECENT)
        for rows, begin, end in units(batches, 8):
            out = [[], [], [], []]
            for at, to in zip(begin, np.append(begin[1:], end), strict=True):
                unit = rows.slice(at, to - at)
                node = unit.column(4).to_numpy()
                first = np.unique(node, return_index=True)[1]  # rows repeated in the input come twice
                if len(first) < len(node):
                    unit = unit.take(pa.array(np.sort(first)))
                    node = unit.column(4).to_numpy()
                hashes, offsets = shingles(unit.column(7).cast(pa.string()), known)
                sets = [np.unique(hashes[p:q]) for p, q in zip(offsets, offsets[1:], strict=False)]
                cross = unit.column(1)[0] != unit.column(2)[0]
                n = unit.column(5).to_numpy()
                x, y = exact_links(fixed(unit.column(6), np.uint8, SHORT), sets, unit.column(3).to_numpy() if cross else None, least, similarity)
                count = np.bincount(x, minlength=len(node)) + np.bincount(y, minlength=len(node))
                weight = np.bincount(x, n[y], len(node)) + np.bincount(y, n[x], len(node))
                ties = np.array(forest(np.stack([x, y], 1), len(node)), np.int64)
                for col, stats, edges in zip(out, (node, None, count, weight), (node[x[ties]], node[y[ties]], None, None), strict=True):
                    col += [None] * len(node) if stats is None else stats.astype(np.int64).tolist()
                    col += [0] * len(ties) if edges is None else edges.tolist()
            yield rows_batch(schema, out)

    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(dealt.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j"), "links", run, ddl)


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links) of each document row."""
    return joined(docs, similarity).drop("digest")


def joined(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The same, with the digest of each row's text."""
    classes = classes_of(docs)
    blocks = components(candidate_edges(classes))
    links = verified(docs, classes, blocks, similarity)
    counts = links.where("b is null").groupBy("a").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows")).withColumnRenamed("a", "node")
    roots = components(links.where("b is not null").select("a", "b"))
    own = classes.select("node", "digest", "least", "n")
    least = roots.join(own, "node").groupBy("root").agg(F.min("least").alias("class_id"))
    found = own.join(roots.join(least, "root").select("node", "class_id"), "node", "left").join(counts, "node", "left")
    # The digest of each text with shingles: class, links.
    found = found.select("digest", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("rows", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (
        with_digest(docs).select("doc_id", "digest").join(found, "digest", "left")
        .select("digest", real("doc_id").alias("doc_id"), F.when(F.col("class_id").isNull(), real("doc_id")).otherwise(real("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"))
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, that with the smallest doc_id, with all its columns; null and empty texts all stay."""
    found = materialise(joined(docs, similarity), "near-copies")
    spare = found.where("n_links > 0 and not (doc_id <=> class_id)").select("doc_id", "digest").distinct()
    if spare.count() <= BROADCAST_ROWS:
        spare = F.broadcast(spare)
    # Names of the input's own columns are never taken.
    other, digest = free_name(docs, "spare_id"), free_name(docs, "spare_digest")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(other)) & (F.unhex(F.md5(F.coalesce("text", F.lit("")))) == F.col(digest))
    left = docs.join(spare.toDF(other, digest), same, "left_anti")
    again = found.where("n_links > 0").groupBy("doc_id", "class_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").limit(1).count()
    if again:  # rows repeated with their id: the first of each id and text stays
        empty = F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0
        left = left.where(~empty).dropDuplicates(["doc_id", "text"]).unionByName(left.where(empty))
    return left


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b, ta.text <> tb.text AS differ, tb.text AS other FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
      JOIN documents ta ON ta.doc_id = a JOIN documents tb ON tb.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.d),
k AS (SELECT d, min(m) AS class_id FROM r GROUP BY d)
SELECT doc_id, class_id, (SELECT count(*) FROM l WHERE a = doc_id) AS n_links,
       (SELECT count(DISTINCT other) FROM l WHERE a = doc_id AND differ) AS n_text_links
FROM documents JOIN k ON d = doc_id"""
