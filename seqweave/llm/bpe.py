"""Byte-level BPE by the ranks of a vocabulary file: texts to ids and back.

Each match of the split pattern is encoded alone. Matches that are new to a
worker are put into matrices by the length of their bytes, padded; in every
round each row merges its leftmost pair of the least rank, where a pair's rank
is looked up in a hash table, and finished rows are taken out.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqweave.llm.common import map_batches

#: No rank: a pair that isn't in the vocabulary, or padding.
NONE = np.int32(2**31 - 1)
#: Widest row of a matrix, in bytes; longer matches merge equal pairs together (see merge_long).
WIDEST = 256
#: Bytes of a matrix's rows together.
BLOCK = 1 << 19
#: Matches that a worker remembers, and the longest of them in characters.
CACHE, CACHED = 400_000, 64
#: Characters of text that are split at once.
SLICE = 1 << 20
#: The split pattern of the vocabulary file, and the same for texts of ASCII alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Letters and numbers of later Unicode versions than 16, that of the tiktoken library, which takes them for neither.
LATER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb
11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191
191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
NEW = "".join("-".join(chr(int(c, 16)) for c in span.split("-")) for span in LATER.split())
HAS_NEW = re.compile(f"[{NEW}]")
WITH_NEW = regex.compile(PATTERN.replace(r"\p{L}+", rf"(?:(?![{NEW}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{NEW}])\p{{N}})+").replace(r"[^\s\p{L}\p{N}]+", rf"(?:[{NEW}]|[^\s\p{{L}}\p{{N}}])+"))


class Vocabulary:
    """Ranks of a file, the hash table of pairs and the matches met so far."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.pattern, self.known = regex.compile(pattern), pattern == PATTERN
        self.seen: dict[str, bytes] = {}
        size = max(self.rank.values()) + 1
        self.length = np.zeros(size, np.int64)
        for token, i in self.rank.items():
            self.length[i] = len(token)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.zeros(int(self.length.sum()), np.uint8)
        for token, i in self.rank.items():
            self.bytes[self.start[i] : self.start[i] + len(token)] = np.frombuffer(token, np.uint8)
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.inside = np.zeros((256, 256), bool)  # bytes that stand side by side in some token
        self.two = np.full((256, 256), NONE, np.int32)  # ranks of pairs of bytes
        pairs = []
        for token, i in self.rank.items():
            for at in range(1, len(token)):
                self.inside[token[at - 1], token[at]] = True
                left, right = self.rank.get(token[:at]), self.rank.get(token[at:])
                if left is not None and right is not None:
                    pairs.append((left << 32 | right, i))
                    if len(token) == 2:
                        self.two[token[0], token[1]] = i
        self._hash(np.array(pairs, np.int64).reshape(-1, 2))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _hash(self, pairs: np.ndarray) -> None:
        """Open addressing: each pair in the first free slot after its own."""
        bits = max(4, int(4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        key, value = pairs[:, 0], pairs[:, 1].astype(np.int32)
        slot = self._slot(key)
        while len(key):
            first = np.zeros(len(key), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            first &= self.keys[slot] == -1
            self.keys[slot[first]], self.values[slot[first]] = key[first], value[first]
            key, value, slot = key[~first], value[~first], (slot[~first] + 1) & self.mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE if it has none (ids of -1 never have one)."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = left.ravel()[at].astype(np.int64) << 32 | right.ravel()[at]
        slot = self._slot(key)
        flat = out.reshape(-1)
        while len(at):
            found = self.keys[slot]
            hit = found == key
            flat[at[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            at, key, slot = at[on], key[on], (slot[on] + 1) & self.mask
        return out

    def merge(self, rows: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of byte strings of at most WIDEST bytes, in one matrix.

        Byte strings are the matrix's columns, so that steps over all of them are
        over contiguous memory; "row" in the module's text means one of them.
        """
        size = np.array([len(r) for r in rows])
        width, n = int(size.max()), len(rows)
        raw = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in rows]), np.uint8).reshape(n, width).T
        place = np.arange(width, dtype=np.int16)[:, None]
        ids = np.where(place < size, self.of_byte[raw], np.int32(-1))
        rank = np.full((width, n), NONE, np.int32)
        rank[:-1] = np.where(place[1:] < size, self.two[raw[:-1], raw[1:]], NONE)
        of, out = np.arange(n), [b""] * n
        while len(of):
            best = rank.min(0)
            live = best != NONE
            if not live.all():
                done = ids[:, ~live].T
                used = done >= 0
                flat, ends = done[used].astype("<u4").tobytes(), (4 * np.cumsum(used.sum(1))).tolist()
                for k, a, b in zip(of[~live].tolist(), [0, *ends], ends, strict=False):
                    out[k] = flat[a:b]
                most = int((ids[:, live] >= 0).sum(0).max(initial=0))
                of, ids, rank, best = of[live], ids[:most, live], rank[:most, live], best[live]
                if not len(of):
                    break
            width = len(ids)
            every, place = np.arange(len(of)), np.arange(width, dtype=np.int16)[:, None]
            at = np.where(rank == best, place, np.int16(width)).min(0)  # the leftmost of the least
            ids[at, every] = best
            # the place after the merged pair goes; what follows moves up
            later = place[:-1] > at
            ids, rank = np.where(later, ids[1:], ids[:-1]), np.where(later, rank[1:], rank[:-1])
            left, right = np.maximum(at - 1, 0), np.minimum(at + 1, width - 2)
            rank[at, every] = np.where(right > at, self.ranks(best, ids[right, every]), NONE)
            rank[left, every] = np.where(left < at, self.ranks(ids[left, every], best), rank[left, every])
        return out

    def merge_long(self, raw: bytes) -> bytes:
        """Ids of one long byte string, the same as merge's.

        A round merges the leftmost pair of the least rank and, left to right, the
        equal ones after it, which are next in order as long as no merged pair makes
        a new pair of a lower rank beside it; at the first that does the round ends.
        So there are about as many rounds as ranks in use, not as many as bytes.
        """
        ids = self.of_byte[np.frombuffer(raw, np.uint8)]
        rank = self.ranks(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
            place = np.arange(len(at))
            at = at[(place - place[np.unique(run, return_index=True)[1]][run]) % 2 == 0]  # of overlapping pairs every other one
            merged = np.full(len(at), best, np.int32)
            left = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
            left[1:] = np.where(at[1:] == at[:-1] + 2, best, left[1:])
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            lower = np.flatnonzero((self.ranks(left, merged) < best) | (self.ranks(merged, right) < best))
            if len(lower):
                at = at[: lower[0] + 1]
            ids[at] = best
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, where = ids[keep], np.cumsum(keep)[at] - 1
            rank = rank[keep[1:]]
            for near in (where, where - 1):
                near = near[(near >= 0) & (near < len(ids) - 1)]
                rank[near] = self.ranks(ids[near], ids[near + 1])
        return ids.astype("<u4").tobytes()

    def encode_bytes(self, raws: list[bytes]) -> list[bytes]:
        """Ids of byte strings: whole tokens at once, others by merges in matrices of like lengths."""
        out = [b"" if (i := self.rank.get(raw)) is None else i.to_bytes(4, "little") for raw in raws]
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for k, raw in enumerate(raws):
            if not out[k] and len(raw) <= WIDEST:
                buckets.setdefault(-(-len(raw) // 4), []).append((k, raw))
        long = [(k, self.cut(raw)) for k, raw in enumerate(raws) if len(raw) > WIDEST and not out[k]]
        parts = [p for _, cut in long for p in cut]
        for at, part in enumerate(parts):
            if len(part) <= WIDEST:
                buckets.setdefault(-(-len(part) // 4), []).append((len(raws) + at, part))
            else:
                parts[at] = self.merge_long(part)
        out += parts
        for rows in buckets.values():
            step = max(1, BLOCK // len(rows[0][1]))
            for at in range(0, len(rows), step):
                block = rows[at : at + step]
                for (k, _), ids in zip(block, self.merge([raw for _, raw in block]), strict=True):
                    out[k] = ids
        at = len(raws)
        for k, cut in long:
            out[k] = b"".join(out[at : at + len(cut)])
            at += len(cut)
        return out[: len(raws)]

    def cut(self, raw: bytes) -> list[bytes]:
        """A long byte string in parts: between two bytes that no token has side by side nothing merges."""
        x = np.frombuffer(raw, np.uint8)
        at = [0, *(np.flatnonzero(~self.inside[x[:-1], x[1:]]) + 1).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def matches(self, text: str) -> list[str]:
        if not self.known:
            return self.pattern.findall(text)
        if text.isascii():
            return ASCII.findall(text)
        return (WITH_NEW if HAS_NEW.search(text) else self.pattern).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian 32-bit."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, list[str]]] = []
        held = 0
        for k, text in enumerate(texts):
            for part in slices(text):
                group.append((k, self.matches(part)))
                held += len(part)
                if held >= SLICE:
                    self._finish(group, out)
                    group, held = [], 0
        self._finish(group, out)
        return [b"".join(x) for x in out]

    def _finish(self, group: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        new = list({p for _, parts in group for p in parts if p not in seen})
        seen.update(zip(new, self.encode_bytes([p.encode() for p in new]), strict=True))
        for k, parts in group:
            out[k].append(b"".join(map(seen.__getitem__, parts)))
        for p in new:
            if len(p) > CACHED:
                del seen[p]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids. An id that the vocabulary lacks is an error."""
        if len(ids) and (ids.max() >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.length[ids]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return self.bytes[np.repeat(self.start[ids], size) + within].tobytes()


def slices(text: str) -> Iterator[str]:
    """A text in slices of about SLICE characters, cut before a space that follows another character than white space: no match crosses such a place."""
    at = 0
    while len(text) - at > SLICE:
        end = text.find(" ", at + SLICE)
        while end > 0 and text[end - 1].isspace():
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str = PATTERN) -> Vocabulary:
    """One per worker process, file and pattern."""
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(path, pattern)
    return _vocabularies[path, pattern]


def encode(df: DataFrame, path: str, pattern: str = PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and ids (binary, little-endian unsigned 32-bit) of each row's whole text.

    A text of null is empty and has no ids. Rows with equal or null keys stay apart,
    other columns are dropped, no rows give no rows. Long texts are split in
    slices and long matches without a gap are merged in rounds over equal pairs;
    a worker holds one batch of texts and their ids.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = vocabulary(path, pattern).encode([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    kind = dict(df.dtypes)[key]
    return map_batches(df.selectExpr(f"`{key}` AS key", f"`{text}` AS text"), fn, f"key {kind}, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with decoded (binary), the bytes of each row's ids; ids of null give null. A column of this name is replaced."""
    keep = [c for c in df.columns if c.lower() not in ("decoded", ids.lower())]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        back = [None if x is None else vocabulary(path).decode(np.frombuffer(x, "<u4")) for x in batch.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], [*keep, ids, "decoded"])

    kinds = dict(df.dtypes)
    return map_batches(df.select(*keep, ids), fn, ", ".join(f"`{c}` {kinds[c]}" for c in [*keep, ids]) + ", decoded binary")
