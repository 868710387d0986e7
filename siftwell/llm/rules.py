"""Quality rules as a short-circuit cascade (operator 10).

Base figures are taken of every whole text.  Texts that pass the base rule go
through the rules below, one after another, until one rejects.  Before that, a
bounded sample of documents is put through every rule, and the rules are
ordered by rejections per second.  The order changes what is computed, never
the verdict, which is that of all rules together.

A word is a run of characters other than the six ASCII white-space characters.
Results: null text has no words, so it fails the base rule.  Repeated rows each
give a row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, filter_rows, id_text, rows_batch, slices, table, texts_of, tidied

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
#: Documents by which the rules' costs and rejections are estimated.
SAMPLE = 1000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


class Doc:
    """A text and its base figures."""

    __slots__ = ("data", "n_dup_lines", "n_lines", "n_repeat_words", "n_symbols", "n_words", "text", "word_chars", "words")

    def __init__(self, text: str):
        self.text, self.data = text, text.encode("utf-8", "surrogatepass")
        self.words = self.data.split()  # of bytes, it splits at ASCII white space only
        self.n_words = len(self.words)
        self.word_chars = len(text) - sum(map(text.count, SPACES))
        self.n_symbols = sum(map(text.count, SYMBOLS))
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        self.n_lines, self.n_dup_lines = len(lines), len(lines) - len(set(lines))
        self.n_repeat_words = repeat_words(self.words)

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows that the text has twice or more."""
    n = len(words)
    if n <= window:
        return 0
    nth = dict(zip(words, range(n), strict=True))
    ids = np.fromiter(map(nth.__getitem__, words), np.int64, n)
    if n >= 1 << 21:  # three ids no longer fit in 63 bits
        ids = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    most = int(ids.max()) + 1
    first = ids[: n - 2] * most + ids[1 : n - 1]
    if most**3 >= 1 << 63:
        first = np.unique(first, return_inverse=True)[1].astype(np.int64)
    key = first * most + ids[2:]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    for k in range(window):
        cover[k : k + len(key)] |= twice
    return int(cover.sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def symbols(d: Doc) -> bool:
    return 10 * d.n_symbols > d.n_words


def dup_lines(d: Doc) -> bool:
    return 10 * d.n_dup_lines > 6 * d.n_lines


def word_length(d: Doc) -> bool:
    return d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words


def shouting(d: Doc) -> bool:
    rest = d.data.translate(None, string.ascii_uppercase.encode())
    upper = len(d.data) - len(rest)
    return 10 * upper > 3 * (upper + len(rest) - len(rest.translate(None, string.ascii_lowercase.encode())))


def exclamation(d: Doc) -> bool:
    return 10 * d.text.count("!") > 3 * d.n_words


def one_word(d: Doc) -> bool:
    return 10 * max(Counter(d.words).values()) > 3 * d.n_words


def no_letters(d: Doc) -> bool:
    """More than three words in ten have no letter: ASCII ones, or any code point over 127."""
    low = d.data.translate(bytes(120 if x > 127 or chr(x).isalpha() else 32 if chr(x) in SPACES else 46 for x in range(256)))
    return 10 * sum(b"x" not in w for w in low.split()) > 3 * d.n_words


RULES = [Rule(f.__name__, f) for f in (symbols, dup_lines, word_length, shouting, exclamation, one_word, no_letters)]


def estimate(docs: list[Doc], rules: list[Rule]) -> list[tuple[str, float, float]]:
    """(name, seconds a document, share rejected) of each rule."""
    out = []
    for r in rules:
        began = time.perf_counter()
        rejected = sum(map(r.rejects, docs))
        out.append((r.name, (time.perf_counter() - began) / max(1, len(docs)), rejected / max(1, len(docs))))
    return out


def order_rules(docs: DataFrame, rules: list[Rule] = RULES, sample: int = SAMPLE) -> tuple[list[Rule], list[tuple[str, float, float]]]:
    """Rules by rejections per cost, best first, from at most ``sample`` documents chosen by the hash of their id.

    The estimates are made in one task; only their few numbers come to the driver.
    """
    some = id_text(docs).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = [r[0] for r in some.collect() if r[0] is not None]
    if not chosen:
        return list(rules), []
    ddl = "name string, cost double, rejected double"
    schema = arrow_schema(ddl)

    @tidied()
    def run(batches):
        seen: list[Doc] = []
        for b in slices(batches):
            seen += [d for d in map(Doc, texts_of(b)) if not d.base_failed][: sample - len(seen)]
        yield rows_batch(schema, list(zip(*estimate(seen, rules), strict=True)))

    got = [tuple(r) for r in id_text(docs).where(F.col("doc_id").isin(chosen)).limit(sample).mapInArrow(run, ddl).collect()]
    by = {r.name: r for r in rules}
    total: dict[str, list[float]] = {}
    for name, cost, rejected in got:
        total.setdefault(name, []).append(rejected / max(cost, 1e-9))
    return [by[n] for n in sorted(total, key=lambda n: -sum(total[n]))], got


OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_rules(docs: DataFrame, rules: list[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Base figures and verdict of each document."""
    ordered, _ = order_rules(docs, rules, sample)
    schema = arrow_schema(OUT)

    @tidied()
    def run(batches):
        for b in slices(batches):
            rows = [Doc(t) for t in texts_of(b)]
            failed = [d.base_failed for d in rows]
            kept = [not f and not any(r.rejects(d) for r in ordered) for d, f in zip(rows, failed, strict=True)]
            yield rows_batch(schema, [b.column(0), *([getattr(d, k) for d in rows] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), failed, kept])

    return id_text(docs).mapInArrow(run, OUT)


def kept_documents(docs: DataFrame, rules: list[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """The rows that the rules keep, with all their columns; rows need no key, as each is judged by its own text."""
    ordered, _ = order_rules(docs, rules, sample)

    def judge(texts):
        return [not (d := Doc(t)).base_failed and not any(r.rejects(d) for r in ordered) for t in texts.to_pylist()]

    return filter_rows(docs, lambda: judge)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
f AS (SELECT doc_id, t, ws, ls, len(ws) AS n,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS symbols,
             len(ls) AS lines, len(ls) - len(list_distinct(ls)) AS dups FROM w),
win AS (SELECT doc_id, i, (ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT doc_id, ws, unnest(range(1, n - 1)) AS i FROM f WHERE n >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
top AS (SELECT doc_id, max(c) AS c FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS x FROM f) GROUP BY ALL) GROUP BY doc_id),
b AS (SELECT f.*, coalesce(r, 0) AS reps, coalesce(top.c, 0) AS most,
             n < 50 OR 100 * coalesce(r, 0) > 50 * n AS failed,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
             length(t) - length(replace(t, '!', '')) AS bangs,
             len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS bare
      FROM f LEFT JOIN rep USING (doc_id) LEFT JOIN top USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines,
       reps::BIGINT AS n_repeat_words, failed AS base_failed,
       NOT failed AND NOT (10 * symbols > n OR 10 * dups > 6 * lines OR chars < 2 * n OR chars > 15 * n OR 10 * up > 3 * letters
                           OR 10 * bangs > 3 * n OR 10 * most > 3 * n OR 10 * bare > 3 * n) AS kept
FROM b"""
