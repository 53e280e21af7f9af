"""Large files, each read by many tasks: lines and lists of JSON by ranges of bytes.

Whoever reads a range from the middle of a JSON file can't tell whether it begins
within a string, or how deep. So one pass notes for each range the parity of its
quotes and what its brackets add up to, for either case; sums over a file's ranges,
a small table, then tell where each begins, and another pass cuts the items out.
An item belongs to the range in which it starts. Ids are hashes of file and
offset, so they don't depend on how a file is split.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqweave.functions.tables import written

#: Keys under which a list may stand, by precedence, and those of an item's symbols.
WRAPPERS = ("inscriptions", "data", "texts")
SYMBOLS = ("signs", "sequence", "tokens")
SPLIT = 16 << 20


def _open(path: str) -> pa.NativeFile:
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def ranges(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, start, stop) of all files of a path, one range or a few to a task; empty files have none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    n = files.agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 1  # from the listing alone
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start")
    return files.select("file", "length", start).select("file", "start", F.least("length", F.col("start") + split).alias("stop")).repartition(min(int(n), 20_000))


def _each(rows: DataFrame, read: Callable[[pa.NativeFile, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """What `read` gives for each range, in batches of some megabytes."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, types[k]) for k, c in enumerate(zip(*held, strict=True))], names)
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["file"]) as f:
                    for out in read(f, row):
                        held.append((row["file"], *out))
                        size += 64 + sum(len(v) for v in out if isinstance(v, str))
                        if size > 4 << 20:
                            yield pack()
                            held, size = [], 0
        if held:
            yield pack()

    types = [{"string": pa.string(), "long": pa.int64()}[c.split(" ")[1]] for c in schema.split(", ")]
    return rows.mapInArrow(fn, schema)


def _read(f: pa.NativeFile, start: int, stop: int) -> bytes:
    f.seek(start)
    return f.read(stop - start)


def _read_lines(f: pa.NativeFile, row: dict) -> Iterator[tuple]:
    """(offset, line) of the lines that begin in the range; the last one is read to its end."""
    start, stop = row["start"], row["stop"]
    data = _read(f, start, stop)
    at = 0 if start == 0 or _read(f, start - 1, start) == b"\n" else data.find(b"\n") + 1 or len(data)
    if at == len(data):
        return
    rest = []
    f.seek(stop)
    while not data.endswith(b"\n") and (more := f.read(1 << 16)):
        k = more.find(b"\n")
        rest.append(more if k < 0 else more[:k])
        if k >= 0:
            break
    data += b"".join(rest)
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        yield start + at, data[at:end].decode("utf-8", "replace").removesuffix("\r")
        at = end + 1


def read_text_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, offset, line) of text files, ended by \\n or \\r\\n; offset is where the line's first byte stands."""
    return _each(ranges(spark, path, split), _read_lines, "file string, offset long, line string")


def read_transliteration(spark: SparkSession, path: str, comments: tuple[str, ...] = ("#", "$", "@", "&"), least: int = 2, split: int = SPLIT) -> DataFrame:
    """(seq_id, file, offset, symbols): a sequence for each line of transliteration files; symbols that begin a comment go, short lines too."""
    keep = lambda x: (x != "") & ~F.exists(F.array(*[F.lit(c) for c in comments]), lambda c: F.startswith(x, c))
    words = F.filter(F.split(F.trim("line"), r"\s+"), keep)
    return read_text_lines(spark, path, split).select(F.xxhash64("file", "offset").alias("seq_id"), "file", "offset", words.alias("symbols")).where(F.size("symbols") >= least)


def _brackets(data: bytes, inside: int, escaped: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the brackets outside of strings, +1 or -1 for each, and the parity of the quotes."""
    if escaped:
        data = b"_" + data[1:]
    if b"\\" in data:
        data = re.sub(rb"(?s)\\.", b"__", data)
    a = np.frombuffer(data, np.uint8)
    quotes = np.cumsum(a == 34, dtype=np.uint8)  # wraps, which keeps the parity
    kind = np.zeros(256, np.int8)
    kind[[91, 123]], kind[[93, 125]] = 1, -1
    sign = kind[a]
    at = np.flatnonzero((sign != 0) & ((quotes + np.uint8(inside)) % 2 == 0))
    return at, sign[at].astype(np.int64), int(quotes[-1] % 2) if len(a) else 0


def _escaped(f: pa.NativeFile, start: int) -> bool:
    """Whether an odd number of backslashes stands before."""
    n = 0
    while start > 0:
        before = _read(f, max(0, start - 64), start)
        n += len(before) - len(before.rstrip(b"\\"))
        if before.rstrip(b"\\"):
            break
        start -= len(before)
    return n % 2 == 1


def _summed(f: pa.NativeFile, row: dict) -> Iterator[tuple]:
    """start, stop, parity of quotes, sum of brackets if it begins outside of a string or inside, and the file's first sign."""
    data, escaped = _read(f, row["start"], row["stop"]), _escaped(f, row["start"])
    outside, inside = (_brackets(data, k, escaped) for k in (0, 1))
    first = data[:4096].lstrip()[:1].decode("utf-8", "replace") if row["start"] == 0 else None
    yield row["start"], row["stop"], outside[2], int(outside[1].sum()), int(inside[1].sum()), first


def _lists(f: pa.NativeFile, row: dict) -> Iterator[tuple]:
    """(offset, rank) where a list begins under a key of an outermost object, and (offset, null) where one ends."""
    data = _read(f, row["start"], row["stop"])
    at, sign, _ = _brackets(data, row["inside"], _escaped(f, row["start"]))
    depth = row["depth"] + np.cumsum(sign)
    for k in np.flatnonzero(((sign > 0) & (depth == 2)) | ((sign < 0) & (depth == 1))):
        p = row["start"] + int(at[k])
        if sign[k] < 0:
            yield p, None
        elif data[at[k] : at[k] + 1] == b"[":
            key = re.search(rb'"(' + "|".join(WRAPPERS).encode() + rb')"\s*:\s*$', _read(f, max(0, p - 256), p))
            if key:
                yield p, WRAPPERS.index(key[1].decode())


def _items(f: pa.NativeFile, row: dict) -> Iterator[tuple]:
    """(offset, item): lists and objects that begin in the range, `level` deep and between `low` and `high`."""
    start, level = row["start"], row["level"]
    data = _read(f, start, row["stop"])
    at, sign, parity = _brackets(data, row["inside"], _escaped(f, start))
    depth = row["depth"] + np.cumsum(sign)
    begins = at[(sign > 0) & (depth == level + 1)]
    ends = at[(sign < 0) & (depth == level)]
    begins = begins[(begins + start > row["low"]) & (begins + start < row["high"])]
    match = np.searchsorted(ends, begins)
    for b, k in zip(begins.tolist(), match.tolist(), strict=True):
        if k < len(ends):
            yield start + b, data[b : ends[k] + 1].decode("utf-8", "replace")
        else:  # it ends in a later range
            text, deep, inside, stop = [data[b:]], int(depth[-1]), (row["inside"] + parity) % 2, row["stop"]
            while more := _read(f, stop, stop + (1 << 16)):
                at, sign, parity = _brackets(more, inside, _escaped(f, stop))
                found = at[(sign < 0) & (deep + np.cumsum(sign) == level)]
                text.append(more[: found[0] + 1] if len(found) else more)
                if len(found):
                    yield start + b, b"".join(text).decode("utf-8", "replace")
                    break
                deep, inside, stop = deep + int(sign.sum()), (inside + parity) % 2, stop + len(more)


def _whole(f: pa.NativeFile, row: dict) -> Iterator[tuple]:
    yield row["low"], _read(f, row["low"], min(row["high"] + 1, f.size())).decode("utf-8", "replace")


def read_json_lists(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(seq_id, file, offset, symbols): the shapes of `corpora.read_json`, each file read by a task for every `split` bytes.

    Lists of lists or of objects with signs, sequence or tokens, as they are or under
    inscriptions, data or texts of an object (the first of these that holds a list).
    Anything else in a list is skipped; a list without lists or objects is one
    sequence, hence one task's. Items without symbols, empty and cut-off files give no
    rows. UTF-8 is expected. An item is held by one task, a file never is.
    """
    noted = _each(ranges(spark, path, split), _summed, "file string, start long, stop long, parity long, outside long, within long, first string")
    noted = written(noted, "ranges")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = noted.withColumn("inside", F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2)
    known = known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("outside")).otherwise(F.col("within"))).over(before), F.lit(0)))
    known = written(known.select("file", "start", "stop", "inside", "depth"), "known")
    tasks = min(known.count(), 20_000) or 1

    first = noted.where("start = 0").select("file", "first")
    plain = first.where("first = '['").select("file", F.lit(1).alias("level"), F.lit(0).cast("long").alias("low"), F.lit((1 << 62)).alias("high"))
    objects = known.join(first.where("first = '{'").select("file"), "file", "left_semi").repartition(tasks)
    marks = written(_each(objects, _lists, "file string, at long, rank long"), "lists")
    chosen = marks.where("rank IS NOT NULL").groupBy("file").agg(F.min(F.struct("rank", "at")).alias("m")).select("file", F.col("m.at").alias("low"))
    closed = chosen.join(marks.where("rank IS NULL"), "file").where("at > low").groupBy("file", "low").agg(F.min("at").alias("high"))
    bodies = written(plain.unionByName(closed.select("file", F.lit(2).alias("level"), "low", "high")), "bodies")

    items = written(_each(known.join(bodies, "file").repartition(tasks), _items, "file string, offset long, item string"), "items")
    keyed = F.coalesce(*[F.from_json(F.get_json_object("item", f"$.{k}"), "array<string>") for k in SYMBOLS])
    nested = items.withColumn("symbols", F.when(F.col("item").startswith("["), F.from_json("item", "array<string>")).otherwise(keyed)).where("symbols IS NOT NULL")
    flat = bodies.join(items.select("file").distinct(), "file", "left_anti")
    flat = _each(flat, _whole, "file string, offset long, item string").withColumn("symbols", F.from_json(F.trim("item"), "array<string>")).where("size(symbols) > 0")
    both = nested.unionByName(flat)
    return both.select(F.xxhash64("file", "offset").alias("seq_id"), "file", "offset", "symbols")
