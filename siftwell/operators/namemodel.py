"""A classifier of single words into names and others, by their letters; trained on lists of one's own."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of features; words that a model is fitted on at most; passes, step and ridge of the fit; share held out for the threshold.
BUCKETS, SAMPLE, PASSES, STEP, RIDGE, HELD_OUT = 1 << 14, 50_000, 300, 0.2, 1e-4, 0.15


def fold(word: str) -> str:
    """Small letters without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()


def features(word: str) -> list[str]:
    """Pieces of two to four letters with the word's ends marked, its first and last letters, its length and its shape."""
    t = fold(word)
    marked, n = f"^{t}$", len(t)
    vowels, runs = len(re.findall("[aeiouy]", t)), [len(r) for r in re.findall("[^aeiouy]+", t)]
    shape = {"apostrophe": "'" in word or "’" in word, "hyphen": "-" in word, "accent": t != word.lower(), "capitals": bool(re.fullmatch("[A-Z]+", word)), "double": re.search(r"(.)\1", t) is not None}
    return [
        *(f"{k}|{marked[i : i + k]}" for k in (2, 3, 4) for i in range(len(marked) - k + 1)), *(f"<{t[:k]}" for k in range(1, min(4, n) + 1)), *(f">{t[-k:]}" for k in range(1, min(4, n) + 1)),
        f"length {min(n, 14)}", f"vowels {round(6 * vowels / max(1, n))}", f"consonants {min(max(runs, default=0), 5)}", *(k for k, yes in shape.items() if yes),
    ]


def buckets(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % BUCKETS for f in features(word)]


@dataclass(frozen=True)
class NameModel:
    """Weights as eighths of a byte's range times ``scale``; a word whose score reaches ``threshold`` is held for a name."""

    weights: bytes
    scale: float
    bias: float
    threshold: float

    def score(self, word: str) -> float:
        total = self.bias + self.scale * sum(w - 256 if (w := self.weights[b]) > 127 else w for b in buckets(word))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def fit(words: list[str], is_name: list[bool]) -> NameModel:
    """Logistic regression with both classes of equal weight, the threshold by F1 on words held out, weights rounded to bytes."""
    rows = [np.unique(buckets(w)) for w in words]
    y = np.array(is_name, float)
    order = np.argsort([zlib.crc32(w.encode()) for w in words], kind="stable")
    cut = max(1, int(len(words) * (1 - HELD_OUT)))
    col = np.concatenate([rows[k] for k in order[:cut]])
    row = np.repeat(np.arange(cut), [len(rows[k]) for k in order[:cut]])
    t = y[order[:cut]]
    weight = np.where(t > 0, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum()))
    w, bias, m, v = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, PASSES + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], cut) + bias, -50, 50)))
        g = weight * (p - t)
        grad = np.append(np.bincount(col, g[row], BUCKETS) + RIDGE * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = STEP * (1 - step / (PASSES + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    scale = max(float(np.abs(w).max()) / 127, 1e-9)
    model = NameModel(np.round(w / scale).astype(np.int8).tobytes(), scale, float(bias), 0.5)
    scored = [(model.score(words[k]), bool(y[k])) for k in (order[cut:] if cut < len(words) else order)]

    def f1(least: float) -> float:
        hit = sum(s >= least and n for s, n in scored)
        return 2 * hit / max(1, sum(s >= least for s, _ in scored) + sum(n for _, n in scored))

    return NameModel(model.weights, scale, float(bias), max((k / 20 for k in range(2, 19)), key=f1))


def train(labelled: DataFrame, sample: int = SAMPLE) -> NameModel:
    """Fit on (word, is_name): different words, at most ``sample``, chosen by their hash."""
    some = labelled.dropna().select(F.col("word").cast("string").alias("word"), F.col("is_name").cast("boolean").alias("is_name")).dropDuplicates(["word"])
    rows = some.orderBy(F.xxhash64("word"), "word").limit(sample).collect()
    return fit([r.word for r in rows], [r.is_name for r in rows])
