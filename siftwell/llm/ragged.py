"""Texts cut at spaces by Arrow, and values of distinct words set back in the words' places by numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def words_of(texts: pa.StringArray, line_feed: str, arrow: bool = False) -> tuple[np.ndarray, list[str] | pa.StringArray, np.ndarray]:
    """(code of each word, distinct words as a list or in Arrow's form, offsets of each text's words); a line feed is replaced first.

    A text without characters has one word, the empty one.
    """
    cut = pc.split_pattern(pc.replace_substring(texts, "\n", line_feed), " ")
    found = cut.flatten().dictionary_encode()
    offsets = cut.offsets.to_numpy().astype(np.int64)
    words = found.dictionary if arrow else found.dictionary.to_numpy(zero_copy_only=False).tolist()
    return found.indices.to_numpy().astype(np.int64), words, offsets - offsets[0]


def spread(values: list[bytes], codes: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(values one after another in the order of ``codes``, end of each in elements)."""
    kind = np.dtype(kind)
    flat = np.frombuffer(b"".join(values), kind)
    size = np.fromiter(map(len, values), np.int64, len(values)) // kind.itemsize
    begin = np.cumsum(size) - size
    n = size[codes]
    ends = np.cumsum(n)
    where = np.repeat(begin[codes] - (ends - n), n)
    where += np.arange(len(where))
    return flat[where], ends


def at(ends: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Element offsets of texts, from the ends of their words and the words' offsets."""
    return np.concatenate([[0], ends])[offsets]


class Recent:
    """A table of at most about ``most`` entries beside one batch's own: the younger half, and the half before it.

    What a batch asks for goes to the younger half; when that is full it
    becomes the older one, and what has not been asked for since is forgotten.
    """

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def missing(self, keys: list[str]) -> list[str]:
        """Keys that it lacks; all others are then in ``new``."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for k in keys:
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out
