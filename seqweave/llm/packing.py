"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best-two-fit: a sequence is filled greedily with the largest pieces that fit;
then its smallest piece is replaced by two unpacked ones that fit the gap it
leaves more tightly. Which pieces of one length go where doesn't matter, so the
plan is made over the counts of lengths (as many as the capacity at most),
whole runs of equal sequences at a time, and the pieces take their places by
their rank within their length.
"""

from __future__ import annotations

import json
import re
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.normalizers import Lowercase

from seqweave.llm.common import map_batches, materialise, shuffle_partitions

TOKEN_CACHE = 500_000
#: Fixed value: the split pattern of the vocabulary file, for words whose characters Python's classes treat alike.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")
#: Characters that Python lower-cases or splits at in another way than the tokenizer.
ODD = "\x1c\x1d\x1e\x1fΣ"


class WordTokenizer(dict):
    """Ids of texts by their words, each tokenized once while it is in the cache.

    The vocabulary's words never cross white space, so a text's ids are its
    words' ids, one after the other. A text with a word that Python might treat
    in another way (special tokens, digits or marks beyond ASCII, forms that
    aren't normalised) goes to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.parts: dict[str, bytes] = {}
        self.tok = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        # for new words: the same merges without a cache, which they would only fill, and without steps that checked words don't need
        model = json.loads(Path(path).read_text())["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.quick = Tokenizer.from_file(path)
        self.quick.model = BPE(vocab=model["vocab"], merges=merges, unk_token=model["unk_token"], end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0)
        self.quick.normalizer = Lowercase()

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def plain(word: str) -> bool:
        """Whether Python's classes split the word as the vocabulary's pattern does."""
        if word.isascii():
            return "<|" not in word
        return (word.isalpha() or "<|" not in word and all(c.isascii() or c.isalpha() for c in word)) and unicodedata.is_normalized("NFC", word)

    def learn(self, words: set[str]) -> bool:
        """Adds new lower-case words from the ids of their pieces; False if one isn't plain."""
        if not all(map(self.plain, words)):
            return False
        split = {w: (w,) if w.isalpha() else PIECES.findall(w) for w in words}
        new = list({p for v in split.values() for p in v if p not in self.parts})
        if len(self.parts) + len(new) > TOKEN_CACHE:
            self.parts.clear()
            new = list({p for v in split.values() for p in v})
        if len(self) + len(words) > TOKEN_CACHE:
            self.clear()
        if new:
            ids = np.array(self.quick.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(new) and cut[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(4 * cut).tolist()]
                self.parts.update((w, raw[a:b]) for w, a, b in zip(new, at, at[1:], strict=False))
            else:
                self.parts.update((w, self.whole(w)) for w in new)
        parts = self.parts
        self.update((w, parts[w] if len(v) == 1 else b"".join([parts[p] for p in v])) for w, v in split.items())
        return True

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        get = self.get
        for text in texts:
            if any(c in text for c in ODD):
                out.append(self.whole(text))
                continue
            words = text.lower().split()
            ids = list(map(get, words))
            if None in ids:
                missing = [k for k, x in enumerate(ids) if x is None]
                if not self.learn({words[k] for k in missing}):
                    out.append(self.whole(text))
                    continue
                for k in missing:
                    ids[k] = self[words[k]]
            out.append(b"".join(ids))
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian 32-bit, binary) of each piece.

    A document is its ids and end_id; only longer ones than the capacity are cut.
    A text of null is empty: its only token is end_id.
    """
    end = int(end_id).to_bytes(4, "little")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        tok, of, piece, start, ids = tokenizer(path), [], [], [], []
        for row, raw in enumerate(tok.encode([t or "" for t in batch.column(1).to_pylist()])):
            raw += end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                of.append(row)
                piece.append(k)
                start.append(at // 4)
                ids.append(raw[at : at + 4 * capacity])
        length = pa.array([len(x) // 4 for x in ids], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), length, pa.array(ids, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    kind = dict(df.dtypes)[key]
    return map_batches(df.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text"), fn, f"doc_id {kind}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs of equal sequences: (how many, [(length, how often in each), ...]).

    Works on the counts of lengths alone. Each run uses up a length (but for a
    rest smaller than its use in one sequence), so runs don't grow with the rows.
    """
    left = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        left[size] = n
    sizes = np.arange(capacity + 1)
    runs = []
    while left.any():
        best = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # largest unpacked length up to each gap
        use: dict[int, int] = {}
        gap = capacity
        while gap and (size := int(best[gap])):
            most = min(int(left[size]) - use.get(size, 0), gap // size)
            if most <= 0:  # all of this length are in this sequence: look below it
                spare = np.flatnonzero((left - np.array([use.get(i, 0) for i in range(size)] + [0] * (capacity + 1 - size)))[:size] > 0)
                if not len(spare):
                    break
                size = int(spare[-1])
                most = min(int(left[size]) - use.get(size, 0), gap // size)
            use[size] = use.get(size, 0) + most
            gap -= most * size
        if gap and len(use) > 1:
            use = _two_for_one(use, gap, left, best)
        times = min(int(left[s]) // n for s, n in use.items())
        for s, n in use.items():
            left[s] -= n * times
        runs.append((times, sorted(use.items(), reverse=True)))
    return runs


def _two_for_one(use: dict[int, int], gap: int, left: np.ndarray, best: np.ndarray) -> dict[int, int]:
    """The sequence with its smallest piece replaced by the two that fill the gap best, if they fill more."""
    small = min(use)
    room = gap + small
    free = left[: room + 1].copy()
    for s, n in use.items():
        if s <= room:
            free[s] -= n
    free[small] += 1
    sizes = np.arange(room + 1)
    top = np.maximum.accumulate(np.where(free > 0, sizes, 0))
    one = np.flatnonzero(free > 0)
    one = one[one > 0]
    if not len(one):
        return use
    two = top[room - one]
    two = np.where((two == one) & (free[one] < 2), top[np.maximum(one - 1, 0)], two)
    both = np.where((two > 0) & (one + two <= room), one + two, 0)
    k = int(both.argmax())
    if both[k] <= small:
        return use
    out = dict(use)
    for s, n in ((small, -1), (int(one[k]), 1), (int(two[k]), 1)):
        out[s] = out.get(s, 0) + n
    return {s: n for s, n in out.items() if n}


def layout(runs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, uses in a sequence, offset), sorted; a rank's place follows from its row."""
    rows, next_rank, sequence = [], {}, 0
    for times, use in runs:
        offset = 0
        for size, n in use:
            first = next_rank.get(size, 0)
            rows.append((size, first, sequence, n, offset))
            next_rank[size] = first + n * times
            offset += n * size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length from 1 to the capacity.

    Sequences are gapless from offset 0. Equal rows and ties take any of their
    length's places; no rows give no rows; the other columns stay as they are.
    Ranks are counted in cells of a few rows, so a length that a third of all
    pieces have is in no single task.
    """
    spark = parts.sparkSession
    # the salt is written, so that a task that runs again finds the same one
    rows = materialise(parts.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    table = layout(plan(counts, capacity))
    cell_rows = max(256, sum(counts.values()) // (4 * shuffle_partitions(spark)))
    cells = [0] * (capacity + 1)
    for size, n in counts.items():
        cells[size] = -(-n // cell_rows)
    per_length = F.element_at(F.split(F.lit(",".join(map(str, cells[1:]))), ","), F.col("length").cast("int")).cast("int")
    celled = rows.withColumn("_cell", F.pmod("_salt", per_length).cast("int"))
    filled = celled.groupBy("length", "_cell").agg(F.count("*").alias("n")).collect()  # capacity + 4 * partitions rows at most
    before, at = {}, {}
    for r in sorted(filled, key=lambda r: (r["length"], r["_cell"])):
        before[(r["length"], r["_cell"])] = at.get(r["length"], 0)
        at[r["length"]] = at.get(r["length"], 0) + r["n"]
    starts = np.array(sorted((s << 32) + c for s, c in before), np.int64)
    offsets = np.array([before[(int(x) >> 32, int(x) & 0xFFFFFFFF)] for x in starts], np.int64)
    keys = (table[:, 0] << 40) + table[:, 1]
    ranked = celled.withColumn("_rank", F.expr("row_number() OVER (PARTITION BY length, _cell ORDER BY _salt)"))
    keep = [c for c in parts.columns]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        size = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
        cell = batch.column("_cell").to_numpy(zero_copy_only=False).astype(np.int64)
        rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64) - 1 + offsets[np.searchsorted(starts, (size << 32) + cell)]
        row = table[np.searchsorted(keys, (size << 40) + rank, "right") - 1]
        within = rank - row[:, 1]
        sequence, offset = row[:, 2] + within // row[:, 3], row[:, 4] + within % row[:, 3] * size
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {t}" for c, t in parts.dtypes)
    return map_batches(ranked, fn, f"{schema}, sequence_id long, offset long")


def assemble(df: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id and its ids as one binary value, from packed pieces that still have their ids.

    A sequence has at most the capacity of tokens, so a group is small.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("parts"), F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", joined.alias("ids"))
