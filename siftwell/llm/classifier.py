"""Ordinal quality classifier (operator 1).

A cumulative-link (proportional odds) model: all grades share the weights of
hashed text features, and ordered thresholds cut the score into grades,

    P(grade >= k) = sigmoid(score - threshold_k),  threshold_1 < threshold_2 < ...

It gives the expected grade and the tail probability P(grade >= k) by which
documents are selected.  It is fitted on a bounded sample of rated documents
(``SAMPLE`` rows, by the hash of their id); every document is scored.

Features are the distinct lower-cased words and runs of punctuation of a text,
the first four letters of its longer words, and its share of distinct words in
tenths; each counts once.

Results: null text has no features and gets the score 0.  Ratings without a
document, or with a null, are left out.  Without any rating there is no model:
grade and probabilities are null and everything is kept.  Repeated rows each
give a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, id_text, rows_batch, slices, strings_of, table, tidied
from .ragged import Recent, words_of

#: Rated rows that are used at most; buckets of features (a power of two); documents a feature needs in the sample.
SAMPLE, BUCKETS, LEAST_DOCS = 20_000, 1 << 20, 4
STEPS, RATE, RIDGE = 200, 0.1, 1e-3


def bucket_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) & (BUCKETS - 1)


def features(texts: pa.StringArray, table_: Recent | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all texts, distinct within each, one text after another; offsets)."""
    table_ = table_ or Recent(1 << 20)
    apart = pc.replace_substring_regex(pc.utf8_lower(texts), r"([^\p{L}\p{N}\s]+)", r" \1 ")
    codes, words, offsets = words_of(pc.replace_substring_regex(apart, r"\s+", " "), " ")
    new = table_.missing(words)
    table_.new.update((w, bucket_of(w) << 20 | bucket_of("\0" + w[:4] if len(w) > 4 else w) if w else -1) for w in new)
    both = np.fromiter(map(table_.new.__getitem__, words), np.int64, len(words))[codes]
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    real = both >= 0
    n = np.bincount(doc[real], minlength=len(texts))
    pair = np.unique(doc[real] << 40 | both[real])  # a batch has far fewer texts than 2 ** 23
    doc, both = pair >> 40, pair & ((1 << 40) - 1)
    tenth = np.where(n > 0, 10 * np.bincount(doc, minlength=len(texts)) // np.maximum(n, 1), 11)
    key = np.unique(np.concatenate([doc << 20 | both >> 20, doc << 20 | both & (BUCKETS - 1)]))
    own, bucket = key >> 20, key & (BUCKETS - 1)
    size = np.bincount(own, minlength=len(texts))
    variety = np.array([xxhash.xxh3_64_intdigest(f"\0variety{k}") & (BUCKETS - 1) for k in range(12)])
    ends = np.cumsum(size)
    return np.insert(bucket, ends, variety[tenth]), np.concatenate([[0], np.cumsum(size + 1)])


class Model:
    """Weights by bucket and thresholds by grade, the lowest grade left out."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: list[int]):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def scores(self, buckets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
        return np.diff(total[offsets])

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= g) for each grade but the lowest."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + (tails * np.diff(self.grades)[None, :]).sum(1)


def fit(buckets: np.ndarray, offsets: np.ndarray, grades: np.ndarray, steps: int = STEPS) -> Model:
    """Maximum likelihood with a ridge, by Adam on the whole sample; classes weigh by the root of their share."""
    kinds = sorted(set(grades.tolist()))
    y = np.searchsorted(kinds, grades)
    n, k = len(y), len(kinds)
    seen = np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(seen >= LEAST_DOCS)
    # The driver fits: numbers of four bytes, and no copies kept.
    place = np.full(BUCKETS, len(used), np.int32)
    place[used] = np.arange(len(used))
    col, row = place[buckets], np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    known = col < len(used)
    row, col = row[known], col[known]
    del known
    share = np.bincount(y, minlength=k) / n
    weight = (1 / np.sqrt(share))[y]
    weight /= weight.mean()
    tail = 1 - np.cumsum(share)[:-1]
    first = -np.log(np.clip(tail, 1e-3, 1 - 1e-3) / np.clip(1 - tail, 1e-3, 1)) if k > 1 else np.zeros(0)
    # Gaps between thresholds are exponentials, so they stay in order.
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    params = np.concatenate([np.zeros(len(used)), theta])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -50, 50)))
    for step in range(1, steps + 1 if k > 1 else 1):
        w, gaps = params[: len(used)], np.exp(params[len(used) + 1 :])
        cuts = np.concatenate([params[len(used) : len(used) + 1], gaps]).cumsum()
        s = np.bincount(row, w[col], minlength=n)
        up = np.concatenate([np.ones((n, 1)), sig(s[:, None] - cuts[None, :]), np.zeros((n, 1))], 1)  # P(grade >= k)
        hi, lo = up[np.arange(n), y], up[np.arange(n), y + 1]
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        g_s = -weight * (d_hi - d_lo) / p / n
        g_cut = np.zeros(k - 1)
        np.add.at(g_cut, np.maximum(y - 1, 0), np.where(y > 0, weight * d_hi / p / n, 0))
        np.add.at(g_cut, np.minimum(y, k - 2), np.where(y < k - 1, -weight * d_lo / p / n, 0))
        g_theta = g_cut[::-1].cumsum()[::-1].copy()
        g_theta[1:] *= gaps
        g = np.concatenate([np.bincount(col, g_s[row], minlength=len(used)) + RIDGE * w, g_theta])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params -= RATE * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(BUCKETS, np.float32)
    out[used] = params[: len(used)]
    cuts = np.concatenate([params[len(used) : len(used) + 1], np.exp(params[len(used) + 1 :])]).cumsum() if k > 1 else np.zeros(0)
    return Model(out, cuts, kinds)


def rated(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, offsets, grades) of at most ``sample`` rated documents; ``ratings`` has doc_id and grade."""
    some = ratings.dropna().select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("long").alias("grade")).distinct()
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)  # so few that a broadcast is safe
    ddl = "grade long, buckets binary"
    schema = arrow_schema(ddl)

    @tidied()
    def run(batches):
        for b in slices(batches):
            got, offsets = features(strings_of(b))
            yield rows_batch(schema, [b.column(b.schema.get_field_index("grade")), [got[x:y].astype("<i4").tobytes() for x, y in zip(offsets, offsets[1:], strict=False)]])

    # One text for each rating, also where an id is repeated, so that there are ``sample`` rows at most.
    texts = id_text(docs).join(F.broadcast(some), "doc_id").groupBy("doc_id", "grade").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = texts.select("text", "grade").mapInArrow(run, ddl).collect()
    lists = [np.frombuffer(r[1], "<i4") for r in rows]
    return np.concatenate([*lists, np.empty(0, "<i4")]), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), np.array([r[0] for r in rows], np.int64)


OUT = "doc_id long, expected_grade double, p_above_lowest double, p_highest double, kept boolean"


def classify(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """Expected grade, tail probabilities, and whether P(highest grade) reaches ``least``."""
    spark = docs.sparkSession
    buckets, offsets, grades = rated(docs, ratings, sample)
    model = fit(buckets, offsets, grades) if len(grades) else None
    shared = spark.sparkContext.broadcast((model.weights, model.thresholds, model.grades) if model else None)  # BUCKETS floats, whatever the input
    schema = arrow_schema(OUT)

    @tidied()
    def run(batches):
        seen, own = Recent(1 << 20), Model(*shared.value) if shared.value else None
        for b in slices(batches, most_bytes=8 << 20):
            if own is None:
                none = [None] * b.num_rows
                yield rows_batch(schema, [b.column(0), none, none, none, [True] * b.num_rows])
                continue
            tails = own.tails(own.scores(*features(strings_of(b), seen)))
            if not tails.shape[1]:  # one grade only
                tails = np.ones((b.num_rows, 1))
                expected = np.full(b.num_rows, float(own.grades[0]))
            else:
                expected = own.expected(tails)
            yield rows_batch(schema, [b.column(0), expected, tails[:, 0], tails[:, -1], tails[:, -1] >= least])

    return id_text(docs).mapInArrow(run, OUT)


def graded_labels(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels: 0 toxic, 1 of low quality, 2 of high quality."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).alias("grade"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), graded_labels(table(spark, sf_dir, "labels")))
