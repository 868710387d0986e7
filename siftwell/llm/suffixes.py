"""Deep-shallow sorting of suffixes, cut off at a fixed length, over whole arrays at a time."""

from __future__ import annotations

import numpy as np

SHALLOW = 16


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a big-endian number; zeros follow the end."""
    n = len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = data
    out = np.empty(n + 8, np.uint64)
    for k in range(min(8, len(out))):
        place = out[k::8]
        place[:] = np.frombuffer(padded, ">u8", len(place), k)
    return out


#: Groups up to this size are put in order at once, as insertion sort does for multikey quicksort's small groups.
SMALL = 24


def multikey_quicksort(symbols: list[np.ndarray], small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """(order of the strings, which of them differ from the one before); string i has the symbols ``symbols[0][i]``, ``symbols[1][i]`` and so on.

    A group is split by its pivot, the median of three of its current symbols,
    into what is less, equal and greater: what is equal goes on to the next
    symbol, the rest stays at this one.  The groups of a level are split
    together, by counting, and those of ``small`` strings at most leave the
    recursion for one direct sort at the end.
    """
    n = len(symbols[0])
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    begin, size, depth = np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n, np.int64), np.zeros(min(n, 1), np.int64)
    rest: list[tuple[np.ndarray, ...]] = []
    while len(begin):
        few = size <= small
        if few.any():
            rest.append((begin[few], size[few], depth[few]))
            begin, size, depth = begin[~few], size[~few], depth[~few]
            if not len(begin):
                break
        next_groups = []
        for k in np.unique(depth):
            mine = depth == k
            b, m = begin[mine], size[mine]
            ends = np.cumsum(m)
            head = ends - m
            slot = np.arange(ends[-1]) + np.repeat(b - head, m)
            own = order[slot]
            x = symbols[k][own]
            low, mid, high = x[head], x[head + m // 2], x[ends - 1]
            pivot = np.repeat(np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high)), m)
            less, more = x < pivot, x > pivot
            before_less, before_more = np.cumsum(less), np.cumsum(more)
            n_less = before_less[ends - 1] - before_less[head] + less[head]
            n_more = before_more[ends - 1] - before_more[head] + more[head]
            n_same = m - n_less - n_more
            # Places within the group: less from its start, equal after those, greater last, each in the order they came.
            rank_less = before_less - np.repeat(before_less[head] - less[head], m)
            rank_more = before_more - np.repeat(before_more[head] - more[head], m)
            place = np.arange(ends[-1]) - np.repeat(head, m) - rank_less - rank_more + np.repeat(n_less, m)
            place = np.where(less, rank_less - 1, np.where(more, rank_more - 1 + np.repeat(n_less + n_same, m), place))
            order[np.repeat(b, m) + place] = own
            some = n_more > 0
            new[b + n_less] = True
            new[(b + n_less + n_same)[some]] = True
            level = np.full(len(b), k)
            next_groups += [(b, n_less, level), (b + n_less + n_same, n_more, level)]
            if k + 1 < len(symbols):
                next_groups.append((b + n_less, n_same, level + 1))
        begin, size, depth = (np.concatenate(x) for x in zip(*next_groups, strict=True))
        several = size > 1
        begin, size, depth = begin[several], size[several], depth[several]
    if rest:
        b, m, d = (np.concatenate(x) for x in zip(*rest, strict=True))
        in_order = np.argsort(b)
        b, m, d = b[in_order], m[in_order], d[in_order]
        ends = np.cumsum(m)
        slot = np.arange(int(ends[-1])) + np.repeat(b - (ends - m), m)
        group, level, own = np.repeat(np.arange(len(b)), m), np.repeat(d, m), order[slot]
        keys = [np.where(level <= k, s[own], np.uint64(0)) for k, s in enumerate(symbols)]
        sort = np.lexsort((*keys[::-1], group))
        order[slot] = own[sort]
        fresh = np.zeros(len(slot), bool)
        for key in keys:
            key = key[sort]
            fresh[1:] |= key[1:] != key[:-1]
        fresh[ends - m] = False  # a group's first string was settled when it was split off
        new[slot] |= fresh
    return order, new


def deep_shallow(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes of ``length`` bytes at ``starts``, which of them differ from the one before).

    Shallow: multikey quicksort, by symbols of 8 bytes, down to 16 bytes.  Deep: each
    group that is still equal becomes a blind trie.  Its first suffix is the
    leaf that others are compared with; where they leave it (position and byte)
    is their branch, and a branch is again a group with a leaf of its own.  The
    tries of all groups grow together, a level at a time, at most one level for
    each byte beyond the shallow depth.
    """
    if not 0 < length < 1 << 14:
        raise ValueError("the length must be from 1 to 16,383 bytes")
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, bool)
    word = words_at(data)
    depth = min(SHALLOW, length)
    mask = lambda k: np.uint64((1 << 64) - (1 << 8 * (8 - min(8, length - k))) if length - k < 8 else (1 << 64) - 1)
    order, new = multikey_quicksort([word[starts + k] & mask(k) for k in range(0, depth, 8)])
    if length <= depth:
        return order, new
    # Deep: symbols of the rest; the last one overlaps, so that it ends with the suffix.
    offsets = [*range(depth, length - 7, 8)]
    if not offsets or offsets[-1] + 8 < length:
        offsets.append(max(0, length - 8))
    group = np.cumsum(new) - 1
    active = np.flatnonzero(np.bincount(group)[group] > 1)  # slots, groups of which are consecutive
    group = group[active]
    while len(active):
        own = starts[order[active]]
        head = np.concatenate([[True], group[1:] != group[:-1]])
        leaf = own[np.flatnonzero(head)][np.cumsum(head) - 1]
        lcp, side, byte = np.full(len(active), length, np.int64), np.ones(len(active), np.int64), np.zeros(len(active), np.int64)
        open_ = np.arange(len(active))
        for at in offsets:
            x, y = word[own[open_] + at], word[leaf[open_] + at]
            apart = x != y
            if not apart.any():
                continue
            here, x, y = open_[apart], x[apart], y[apart]
            diff = x ^ y
            k = np.zeros(len(here), np.int64)
            for half in (32, 16, 8):  # whole bytes in which the upper parts agree
                same = (diff >> np.uint64(64 - half)) == 0
                k += np.where(same, half // 8, 0)
                diff = np.where(same, diff << np.uint64(half), diff)
            lcp[here] = at + k
            byte[here] = (x >> (56 - 8 * k).astype(np.uint64)) & np.uint64(255)
            side[here] = np.where(x < y, 0, 2)
            open_ = open_[~apart]
        # Before the leaf: earlier branches first; after it: later branches first.
        rank = np.where(side == 0, lcp, np.where(side == 2, length - lcp, 0))
        key = ((np.cumsum(head) - 1) << 24) | (side << 22) | (rank << 8) | byte
        sort = np.argsort(key, kind="stable")
        order[active] = order[active[sort]]
        key, side = key[sort], side[sort]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        new[active] |= start
        # What equals its leaf is placed; branches of two and more go on.
        branch = np.cumsum(start) - 1
        on = (side != 1) & (np.bincount(branch)[branch] > 1)
        active, group = active[on], branch[on]
    return order, new
