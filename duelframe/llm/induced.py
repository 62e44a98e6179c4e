"""Suffix and longest-common-prefix arrays by external induced sorting.

The text is a set of strings, each closed by a terminator of its own. Suffixes are S (smaller than their
successor) or L. The leftmost S of each run (LMS) are sorted first: an induction sorts the pieces between them,
equal pieces get one name, and the string of names is sorted by recursion. Then one pass upwards induces
the L suffixes and one downwards the S suffixes. Both passes take tuples (suffix, rank of its successor)
from a priority queue by first character. Tuples of one character arrive in order, so the queue is a
first-in-first-out run for each character, kept in memory up to a limit and in an unlinked file of the
task beyond it. The common prefix of two neighbours of a character is one more than the smallest common
prefix between their successors, so these values are carried along.
"""

from __future__ import annotations

import tempfile

import numpy as np


class RunQueue:
    """For each character the arrays pushed, in order; beyond `limit` bytes they go to disk."""

    def __init__(self, limit: int):
        self.limit, self.held, self.file = limit, 0, None
        self.runs: dict[int, list] = {}

    def push(self, char: int, data: np.ndarray) -> None:
        if self.held + data.nbytes > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            data.tofile(self.file)
            self.runs.setdefault(char, []).append((at, data.shape))
        else:
            self.held += data.nbytes
            self.runs.setdefault(char, []).append(data)

    def pop(self, char: int) -> np.ndarray | None:
        parts = []
        for r in self.runs.pop(char, ()):
            if isinstance(r, tuple):
                self.file.seek(r[0])
                r = np.fromfile(self.file, np.int64, int(np.prod(r[1]))).reshape(r[1])
            else:
                self.held -= r.nbytes
            parts.append(r)
        return None if not parts else parts[0] if len(parts) == 1 else np.concatenate(parts, axis=1)


def _kinds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is S, length of the run of equal characters from here). 0 is the terminator."""
    n = len(text)
    differ = np.append(text[:-1] != text[1:], True)
    nxt = np.where(differ, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # the last place of the run
    after = np.append(text[1:], 0)[np.minimum(nxt, n - 1)]
    return (text == 0) | (text < after), nxt - np.arange(n) + 1


def _pass(text: np.ndarray, run: np.ndarray, mask: np.ndarray, seeds: dict, upward: bool, limit: int, chars: np.ndarray, carry: bool) -> dict:
    """One induction. mask: the kind induced; seeds: char -> (suffixes, common prefix with the one before), in the pass's order.

    Without carry the common prefixes are left at 0.
    Returns char -> (suffixes, common prefix with the one before) of the induced suffixes, in the pass's order.
    In each character's bucket the induced suffixes come first, then the seeds.
    """
    queue, out = RunQueue(limit), {}
    lcps = np.zeros(len(text) + 1, np.int64)
    rank = 0

    def spread(suffixes: np.ndarray, ranks: np.ndarray, char: int) -> np.ndarray | None:
        ok = suffixes > 0
        before = np.where(ok, suffixes - 1, 0)
        ok &= mask[before] & (text[before] != 0)
        before, ranks = before[ok], ranks[ok]
        c = text[before]
        same = None
        if len(before):
            order = np.argsort(c, kind="stable")
            c, data = c[order], np.stack([before[order], ranks[order]])
            edges = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(c)), strict=True):
                if c[a] == char:
                    same = data[:, a:b]
                else:
                    queue.push(int(c[a]), np.ascontiguousarray(data[:, a:b]))
        return same

    for char in chars if upward else chars[::-1]:
        char = int(char)
        batch = queue.pop(char)
        found, values = [], []
        last = -1
        while batch is not None:
            suffixes, after = batch
            edge = after if last < 0 else np.append(last, after)
            v = np.zeros(len(suffixes), np.int64)
            if carry and len(edge) > 1:
                inner = 1 + np.minimum.reduceat(lcps[: int(edge[-1]) + 1], edge[:-1] + 1)
                v[len(v) - len(inner) :] = inner
            last = int(after[-1])
            ranks = np.arange(rank, rank + len(suffixes))
            lcps[ranks] = v
            rank += len(suffixes)
            found.append(suffixes)
            values.append(v)
            batch = spread(suffixes, ranks, char)
        if found:
            out[char] = (np.concatenate(found), np.concatenate(values))
        if char in seeds:
            suffixes, v = seeds[char]
            v = v.copy()
            v[0] = min(int(run[out[char][0][-1]]), int(run[suffixes[0]])) if found else 0
            ranks = np.arange(rank, rank + len(suffixes))
            lcps[ranks] = v
            rank += len(suffixes)
            spread(suffixes, ranks, char)
    return out


def _induce(text: np.ndarray, small: np.ndarray, run: np.ndarray, lms: np.ndarray, lcp: np.ndarray, limit: int, carry: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix with the one before) from LMS suffixes in order."""
    chars = np.unique(text)

    def by_char(s: np.ndarray, v: np.ndarray) -> dict:
        c = text[s]
        edges = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(s) else []
        return {int(c[a]): (s[a:b], v[a:b]) for a, b in zip(edges, np.append(edges[1:], len(s)).astype(int), strict=True)} if len(s) else {}

    large = _pass(text, run, ~small, by_char(lms, lcp), True, limit, chars, carry)

    def flipped(s: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return s[::-1], np.append(0, v[1:][::-1])

    down = {c: flipped(*x) for c, x in large.items()}
    s_part = _pass(text, run, small, down, False, limit, chars, carry)
    ends = np.flatnonzero(text == 0)
    order, values = [ends], [np.zeros(len(ends), np.int64)]
    for c in chars[chars > 0].tolist():
        l_part = large.get(c)
        if l_part is not None:
            order.append(l_part[0])
            values.append(np.append(0, l_part[1][1:]))
        if c in s_part:
            s, v = flipped(*s_part[c])
            v[0] = min(int(run[l_part[0][-1]]), int(run[s[0]])) if l_part is not None else 0
            order.append(s)
            values.append(v)
    return np.concatenate(order), np.concatenate(values)


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the suffixes a and b, pair by pair, several characters at a time; terminators equal nothing."""
    n = len(text)
    stop = np.where(text == 0, np.arange(n), n)
    left = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)  # to the terminator
    most = np.minimum(left[a], left[b])
    bits = max(1, int(text.max()).bit_length())
    width = max(1, 62 // bits)
    packed = np.zeros(n, np.int64)
    for k in range(min(width, n)):
        packed[: n - k] |= text[k:] << (bits * k)
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most >= width)
    while len(live):
        at = out[live]
        live = live[packed[a[live] + at] == packed[b[live] + at]]
        out[live] += width
        live = live[out[live] + width <= most[live]]
    live = np.flatnonzero(out < most)
    while len(live):
        at = out[live]
        live = live[text[a[live] + at] == text[b[live] + at]]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


def suffix_array(text: np.ndarray, limit: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix with the one before) of strings that each end in a 0; other characters > 0."""
    text = text.astype(np.int64)
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    small, run = _kinds(text)
    is_lms = small & np.append(False, ~small[:-1])
    is_lms[1:] &= text[:-1] != 0
    is_lms |= text == 0
    lms = np.flatnonzero(is_lms)
    first = lms[np.argsort(text[lms], kind="stable")]
    rough, _ = _induce(text, small, run, first, np.zeros(len(first), np.int64), limit, False)
    rough = rough[is_lms[rough]]  # by the piece up to the next LMS suffix
    where = np.full(len(text), -1)
    where[lms] = np.arange(len(lms))
    size = np.append(np.diff(lms), 0)  # of a piece, to the next LMS place
    size[text[lms] == 0] = 0
    at = where[rough]
    equal = (size[at[1:]] == size[at[:-1]]) & (text[rough[1:]] != 0)
    k = np.flatnonzero(equal)
    a, b, length, live = rough[1:][k], rough[:-1][k], size[at[1:]][k], np.arange(len(k))
    step = 0
    while len(live):
        live = live[length[live] >= step]
        same = (text[a[live] + step] == text[b[live] + step]) & (text[a[live] + step] != 0)
        equal[k[live[~same]]] = False
        live = live[same]
        step += 1
    names = np.empty(len(lms), np.int64)
    names[at] = np.append(0, np.cumsum(~equal)) + 1
    ends = text[lms] == 0
    if equal.any():
        inner = names.copy()
        inner[ends] = 0
        order = _sort_names(inner, limit)
    else:
        order = np.argsort(names, kind="stable")
    ordered = lms[order]
    ordered = np.concatenate([ordered[text[ordered] == 0], ordered[text[ordered] != 0]])
    value = np.append(0, common_prefix(text, ordered[1:], ordered[:-1]))
    return _induce(text, small, run, ordered, value, limit)


def _sort_names(names: np.ndarray, limit: int, most: int = 2048) -> np.ndarray:
    """The order of the suffixes of strings of names: by recursion, or by doubling once the alphabet is large."""
    if len(np.unique(names)) <= most:
        return suffix_array(names, limit)[0]
    n = len(names)
    end = np.flatnonzero(names == 0)
    rank = names + len(end)
    rank[end] = np.arange(len(end))  # each terminator is its own
    width = 1
    while True:
        after = np.where(np.arange(n) + width < n, rank[np.minimum(np.arange(n) + width, n - 1)] + 1, 0)
        key = rank * (int(rank.max()) + 3) + after
        _, new = np.unique(key, return_inverse=True)
        if int(new.max()) == n - 1:
            return np.argsort(new)
        rank, width = new, width * 2
