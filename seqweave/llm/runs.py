"""Runs: maximal periodic stretches of words, found with suffix trees.

The longest common extensions of two places to the right and to the left are
lowest common ancestors in Ukkonen's suffix trees of the words and of their
reversal; an Euler tour leaves the depths between neighbouring leaves, and a
sparse table of their minima answers each query in constant time. Every run has
a root that is a longest Lyndon word at its place under one of the two orders of
the words, so those 2 n candidates, extended both ways, give all runs.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqweave.llm.common import map_batches

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Shortest stretch that counts, in words, besides two periods.
LEAST = 12


class SuffixTree:
    """Ukkonen's tree of whole numbers from 1 on; an end mark of 0 is added, which is less than all of them."""

    def __init__(self, codes: list[int]) -> None:
        self.word = word = [*codes, 0]
        n, self.sigma = len(word), max(codes, default=0) + 1
        sigma = self.sigma
        self.start, self.stop, self.parent, self.leaf = start, stop, parent, leaf = [0], [0], [-1], [-1]
        child: dict[int, int] = {}
        link = [0]
        node, edge, length, left, leaves = 0, 0, 0, 0, 0
        for i, c in enumerate(word):
            left += 1
            pending = 0  # an inner node that still needs its suffix link
            while left:
                if not length:
                    edge = i
                key = node * sigma + word[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    parent.append(node)
                    leaf.append(leaves)
                    link.append(0)
                    leaves += 1
                    if pending:
                        link[pending] = node
                        pending = 0
                else:
                    span = stop[below] - start[below]
                    if length >= span:
                        node, edge, length = below, edge + span, length - span
                        continue
                    at = start[below] + length
                    if word[at] == c:
                        length += 1
                        if pending:
                            link[pending] = node
                        break
                    middle = len(start)
                    child[key] = middle
                    start += (start[below], i)
                    stop += (at, n)
                    parent += (node, middle)
                    leaf += (-1, leaves)
                    link += (0, 0)
                    leaves += 1
                    start[below], parent[below] = at, middle
                    child[middle * sigma + word[at]] = below
                    child[middle * sigma + c] = middle + 1
                    if pending:
                        link[pending] = middle
                    pending = middle
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self.keys = np.fromiter(child.keys(), np.int64, len(child))
        self.below = np.fromiter(child.values(), np.int64, len(child))

    def tour(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of the leaves, and the depth of the lowest node between each leaf and the one before it.

        falling reverses the order of the words, but not that of the end mark.
        """
        above, symbol = np.divmod(self.keys, self.sigma)
        if falling:
            symbol = np.where(symbol == 0, 0, self.sigma - symbol)
        order = np.argsort(above * self.sigma - symbol)  # the stack takes the last child first
        kids = self.below[order].tolist()
        ends = np.cumsum(np.bincount(above, minlength=len(self.start))).tolist()
        length, leaf, parent = np.subtract(self.stop, self.start).tolist(), self.leaf, self.parent
        depth = [0] * len(length)
        order_out, between = [], []
        low, stack = 0, kids[: ends[0]]
        pop, extend = stack.pop, stack.extend
        while stack:
            v = pop()
            d = depth[parent[v]]
            if d < low:
                low = d
            if leaf[v] >= 0:
                order_out.append(leaf[v])
                between.append(low)
                low = 1 << 60
            else:
                depth[v] = d + length[v]
                extend(kids[ends[v - 1] : ends[v]])
        return np.array(order_out), np.array(between)


class Extensions:
    """Lengths of common prefixes of suffixes, by minima over the tour."""

    def __init__(self, suffixes: np.ndarray, between: np.ndarray) -> None:
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.table = [between.astype(np.int32)]
        step = 1
        while 2 * step <= len(between):
            last = self.table[-1]
            self.table.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the suffixes at x and at y, which differ, have in common."""
        a, b = self.rank[x], self.rank[y]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level).tolist():
            here = level == k
            row = self.table[k]
            out[here] = np.minimum(row[low[here]], row[high[here] + 1 - (1 << k)])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each suffix the place of the next smaller one: the longest Lyndon word at a place ends there."""
    out, stack = [0] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(codes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least max(least, 2 periods), by start, then period."""
    n = len(codes)
    codes = codes.tolist()
    forth, back = SuffixTree(codes), SuffixTree(codes[::-1])
    rising = forth.tour()
    right, left = Extensions(*rising), Extensions(*back.tour())
    found = []
    for suffixes in (rising[0], forth.tour(falling=True)[0]):
        rank = np.empty(n + 1, np.int64)
        rank[suffixes] = np.arange(n + 1)
        i = np.arange(n)
        end = np.array(next_smaller(rank.tolist())[:n])
        period = end - i
        after = right(i, end)
        before = np.where(i > 0, left(n - i, n - end), 0)
        size = period + after + before
        good = size >= np.maximum(least, 2 * period)
        found.append(np.column_stack([(i - before)[good], size[good], period[good]]))
    out = np.unique(np.concatenate(found), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def repeated(codes: np.ndarray, width: int) -> np.ndarray:
    """Whether a place lies in a stretch of width words that stands in the text twice or more; hashes that collide only add places."""
    n = len(codes)
    out = np.zeros(n, bool)
    if n < width:
        return out
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - width + 1 + k]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n + 1, np.int64)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    starts = np.zeros(n - width + 1, bool)
    starts[at] = True
    twice[: n - width + 1] += starts
    twice[width:] -= starts
    return np.cumsum(twice[:n]) > 0


def text_runs(words: list[str], least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of words.

    A run of n >= max(least, 2q) words repeats its first n - q >= least / 2 words q
    further on, so each of its words is in a stretch of least / 2 words that the
    text has twice. Trees are built over the parts of such words alone: what isn't
    in one can't be in a run, nor can a run reach over it.
    """
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    inside = np.concatenate([[False], repeated(codes, max(1, least // 2)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    found = [np.zeros((0, 3), np.int64)]
    for a, b in edges[edges[:, 1] - edges[:, 0] >= least].tolist():
        found.append(runs_of(np.unique(codes[a:b], return_inverse=True)[1] + 1, least) + np.array([a, 0, 0]))
    return np.concatenate(found)


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words joined by a space, without those that a run holds after its first period."""
    drop = [0] * (len(words) + 1)
    for start, length, period in runs.tolist():
        drop[start + period] += 1
        drop[start + length] -= 1
    return " ".join(w for w, d in zip(words, accumulate(drop), strict=False) if not d)


def periodic_runs(df: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (array of start, length, period, by start, then period) and collapsed of each row's whole text.

    Words are parted by ASCII white space. A run is a stretch with smallest period
    q of at least max(least, 2q) words that no neighbour extends; collapsed has
    the words, joined by a space, that no run repeats. A text of null has no words.
    Rows with equal or null keys stay apart, other columns are dropped, no rows
    give no rows. Time and memory are linear in a text's words but for the sparse
    tables, which take a logarithm more.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, found, kept = [], [], []
        for value in batch.column(1):
            words = WORDS.findall(value.as_py() or "")
            runs = text_runs(words, least)
            n.append(len(words))
            found.append(runs)
            kept.append(collapsed(words, runs))
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate(found)
        rows = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows), pa.array(kept, pa.string())], ["key", "n_words", "runs", "collapsed"])

    kind = dict(df.dtypes)[key]
    rows = map_batches(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), fn, f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return rows.withColumnRenamed("key", key)
