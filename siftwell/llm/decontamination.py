"""Benchmark decontamination (operator 3).

The test items are the documents of a BM25 inverted index; every passage of the
training texts is a query.  Passages are windows of twice the longest item's
words, half overlapping, so that any copy of an item lies in one of them.  An
item's scores are divided by its score for itself, which makes one threshold
fit items of any length.  Block-max WAND retrieves every item at or over the
threshold: terms' upper bounds rule out nearly all passages at once, blocks'
bounds skip items within posting lists.  What is retrieved is verified: shares
of the question's and of the answer's word n-grams found in the passage.

An item's answer is what follows its last question mark or the word "answer:".
An item without either is also verified as a whole, as no one can tell where its
answer starts: it counts when its own n-grams are found, or those of its first
three quarters and of its last quarter, and both shares are the better of the two.
N-grams of short texts are shorter, so that one changed word leaves at least
``OVERLAP`` of them where that can be: words of answers, bigrams of whole items.

Results: one row for each document row and item that leaks into it.  Null and
empty texts and items without words give none.  Whole items and questions of fewer
words than the n-gram are compared whole.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, filter_rows, id_text, rows_batch, slices, strings_of, table, tidied
from .ragged import words_of

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP, NGRAM = 0.5, 0.8, 5
#: Items in one index; more are taken in several passes.  Items in a block of a posting list; shortest passage in words.
INDEX_ITEMS, BLOCK, SHORTEST = 20_000, 64, 64
#: Share of an item's weight in its head, less than which (1 - HEAD < threshold) an item can't reach the threshold without it.
HEAD = 0.75
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def marked(text: str) -> tuple[list[str], list[str]] | None:
    """Words of an item's question and answer, if a mark parts them."""
    marks = [*re.finditer(r"\?|\banswer\s*:", text, re.IGNORECASE)]
    if marks and (answer := words(text[marks[-1].end() :])) and (question := words(text[: marks[-1].end()])):
        return question, answer
    return None


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer; without a mark, the last quarter stands for the answer."""
    if parts := marked(text):
        return parts
    all_ = words(text)
    k = len(all_) - len(all_) // 4
    return all_[:k], all_[k:]


def grams(ws: list[str], n: int = NGRAM) -> set[tuple[str, ...]]:
    n = min(n, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()


def fitting(ws: list[str], least: int) -> int:
    """The longest n-gram up to ``NGRAM``, but of ``least`` words, of which one changed word leaves the share ``OVERLAP``."""
    # A changed word takes n of the len - n + 1 n-grams at most.
    return max(least, min(NGRAM, math.floor((1 - OVERLAP) * (len(ws) + 1) / (2 - OVERLAP) + 1e-9)))


def share(ws: list[str], passage: list[str], n: int = NGRAM) -> float:
    """Share of the n-grams of ``ws`` that the passage has; 1 if there are none."""
    own = grams(ws, n)
    if not own:
        return 1.0
    n = len(next(iter(own)))
    return len(own & {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}) / len(own)


class Statistics:
    """Document frequencies and mean length over all items, for the weights of every index."""

    def __init__(self, items):
        self.n, self.df, total = 0, Counter(), 0
        self.longest = 0
        for _, text in items:
            if ws := words(text or ""):
                self.n, total, self.longest = self.n + 1, total + len(ws), max(self.longest, len(ws))
                self.df.update(set(ws))
        self.mean = total / max(1, self.n)

    def idf(self, term: str) -> float:
        return math.log(1 + (self.n - self.df[term] + 0.5) / (self.df[term] + 0.5))


class Index:
    """Posting lists by term in the order of items, with the largest weight of each list and block."""

    def __init__(self, items: list[tuple[int, str]], stats: Statistics):
        self.items, self.passage = [], max(SHORTEST, 2 * stats.longest)
        lists: dict[str, list[tuple[int, float]]] = {}
        heads: dict[str, list[tuple[int, float]]] = {}
        rest: list[float] = []
        for item, text in items:
            ws = words(text or "")
            if not ws:
                continue
            tf = Counter(ws)
            norm = K1 * (1 - B + B * len(ws) / stats.mean)
            own = {t: stats.idf(t) * n * (K1 + 1) / (n + norm) for t, n in tf.items()}
            whole = sum(own.values())
            for t, w in own.items():
                lists.setdefault(t, []).append((len(self.items), w / whole))
            question, answer = split_item(text)
            self.items.append((item, question, answer, None if marked(text) else ws))
            # The item's rarest terms, up to HEAD of its weight; what the others can add is known beforehand.
            mass = 0.0
            for t in sorted(own, key=lambda t: (stats.df[t], t)):
                if mass >= HEAD:
                    break
                mass += own[t] / whole
                heads.setdefault(t, []).append((len(self.items) - 1, own[t] / whole))
            rest.append(1 - mass)
        self.terms = {t: k for k, t in enumerate(lists)}
        self.posts = [[d for d, _ in x] for x in lists.values()]
        self.weights = [[w for _, w in x] for x in lists.values()]
        self.most = np.array([max(x) for x in self.weights] + [0.0])
        flat = [heads.get(t, []) for t in lists]
        self.head_n = np.array([len(x) for x in flat] + [0])
        self.head_at = np.cumsum(self.head_n) - self.head_n
        self.head_item, self.head_weight = np.array([d for x in flat for d, _ in x], np.int64), np.array([w for x in flat for _, w in x])
        self.rest = np.array(rest)
        self.blocks = [[(p[min(i + BLOCK, len(p)) - 1], max(w[i : i + BLOCK])) for i in range(0, len(p), BLOCK)] for p, w in zip(self.posts, self.weights, strict=True)]

    def retrieve(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """(item's place, score) of every item whose score for these distinct terms reaches ``least``."""
        least -= 1e-9  # sums in another order
        cursors = [[self.posts[t][0], 0, t, 0] for t in terms]  # item, place in list, term, block
        found, end = [], len(self.items)

        def move(c: list, target: int) -> None:
            """To the first posting at or after the target; whole blocks are jumped."""
            posts, blocks = self.posts[c[2]], self.blocks[c[2]]
            while c[3] < len(blocks) and blocks[c[3]][0] < target:
                c[3] += 1
                c[1] = c[3] * BLOCK
            while c[1] < len(posts) and posts[c[1]] < target:
                c[1] += 1
            c[0] = posts[c[1]] if c[1] < len(posts) else end

        while True:
            cursors = sorted(c for c in cursors if c[0] < end)
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                total += self.most[c[2]]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # The blocks in which the pivot would lie bound its score more closely.
            bound, until = 0.0, end
            for c in cursors[: pivot + 1]:
                blocks, b = self.blocks[c[2]], c[3]
                while b < len(blocks) and blocks[b][0] < item:
                    b += 1
                if b < len(blocks):
                    bound += blocks[b][1]
                    until = min(until, blocks[b][0] + 1)
            if bound < least:
                target = max(item + 1, min(until, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
                for c in cursors[: pivot + 1]:
                    move(c, target)
            elif cursors[0][0] == item:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    score += self.weights[c[2]][c[1]]
                    move(c, item + 1)
                if score >= least:
                    found.append((item, score))
            else:
                for c in cursors[:pivot]:
                    if c[0] < item:
                        move(c, item)

    def leaks(self, texts: pa.StringArray, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
        """(row, item_id, score, question's share, answer's share), the best passage of each row and item."""
        plain = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+", " "), " ")
        codes, distinct, offsets = words_of(plain, " ")
        if threshold <= 1 - HEAD:
            raise ValueError("the threshold must be over what the terms outside the heads can give")
        term = np.fromiter((self.terms.get(w, -1) for w in distinct), np.int64, len(distinct))[codes]
        bound = np.concatenate([[0.0], np.cumsum(self.most[term])])
        half = self.passage // 2
        n = np.diff(offsets)
        passages = np.maximum(1, -(-n // half) - 1)  # starts every half passage
        row = np.repeat(np.arange(len(n)), passages)
        begin = offsets[row] + half * (np.arange(len(row)) - np.repeat(np.cumsum(passages) - passages, passages))
        end = np.minimum(begin + self.passage, offsets[row + 1])
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        # Upper bounds rule passages out: first with repeated words counted, then with each distinct term once.
        likely = np.flatnonzero(bound[end] - bound[begin] >= threshold - 1e-6)
        n = end[likely] - begin[likely]
        which = np.repeat(np.arange(len(likely)), n)
        asked_of = term[np.repeat(begin[likely] - (np.cumsum(n) - n), n) + np.arange(len(which))]
        known = asked_of >= 0
        pair = np.unique(which[known] * len(self.most) + asked_of[known])
        which, asked_of = pair // len(self.most), pair % len(self.most)
        total = np.bincount(which, self.most[asked_of], len(likely))
        cuts = np.searchsorted(which, np.arange(len(likely) + 1))
        # Then by item: what its rarest terms give, and all that the others could.
        m = self.head_n[asked_of]
        at = np.repeat(self.head_at[asked_of] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        key, place = np.unique(np.repeat(which, m) * max(1, len(self.items)) + self.head_item[at], return_inverse=True)
        reach = np.bincount(place, self.head_weight[at], len(key)) + self.rest[key % max(1, len(self.items))]
        able = np.zeros(len(likely), bool)
        able[key[reach >= threshold - 1e-6] // max(1, len(self.items))] = True
        for nth in np.flatnonzero((total >= threshold - 1e-6) & able):
            k, asked = likely[nth], asked_of[cuts[nth] : cuts[nth + 1]]
            if got := self.retrieve(asked.tolist(), threshold):
                passage = [distinct[c] for c in codes[begin[k] : end[k]]]
                for place, score in got:
                    item, question, answer, whole = self.items[place]
                    if whole is None:
                        q, a = share(question, passage), share(answer, passage, fitting(answer, 1))
                    else:
                        parts = min(share(question, passage), share(answer, passage))
                        q = a = max(parts, share(whole, passage, NGRAM if len(whole) < NGRAM else fitting(whole, 2)))
                    if q >= overlap and a >= overlap:
                        key = int(row[k]), item
                        best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, a))
        return [(r, i, *x) for (r, i), x in sorted(best.items())]


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = INDEX_ITEMS):
    """Indexes of at most ``size`` items each; the benchmark is read once for its statistics and once for the items."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    stats = Statistics(rows.toLocalIterator())
    held: list = []
    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == size:
            yield Index(held, stats)
            held = []
    if held or not stats.n:
        yield Index(held, stats)


OUT = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, size: int = INDEX_ITEMS) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    schema, out = arrow_schema(OUT), None
    for index in indexes(benchmark, size=size):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # of at most ``size`` items

        @tidied()
        def run(batches, shared=shared):
            own = shared.value
            for b in slices(batches, most_bytes=8 << 20):
                ids = b.column(0).to_pylist()
                got = own.leaks(strings_of(b), threshold, overlap) if own.items else []
                yield rows_batch(schema, [[ids[x[0]] for x in got], *([x[k] for x in got] for k in range(1, 5))])

        found = id_text(docs).mapInArrow(run, OUT)
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows into which no item leaks, with all their columns."""
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def keep(shared=shared):
            def judge(texts):
                ok = np.ones(len(texts), bool)
                ok[[x[0] for x in shared.value.leaks(texts, threshold, overlap)]] = False
                return ok

            return judge

        docs = filter_rows(docs, keep)
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
