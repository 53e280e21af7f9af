"""Exact n-gram Jaccard self-join by partitions of the token universe.

A document is its set of hashed word n-grams. If two sets are similar enough,
they differ by at most H tokens, a number that follows from their sizes. The hash
range is cut into m = H + 1 segments for each size band, so in at least one
segment both sets hold the same subset (pigeonhole); its signature brings them
together. Each set allots its segments budgets by what they cost. A subset without
tokens is shared with a fixed share of all sets, whatever they hold: it gets the
budget -1, its signature isn't written. To make up for that, the first
q = 2 k + k1 segments get the budget 1 beside their own, one-deletion
neighbourhoods (k segments of the set are empty, k1 hold one token); the others
have the budget 0. All candidates are verified exactly.

No pair is lost: let no non-empty subset be shared. Then the t >= 1 shared ones are
empty, m - t segments differ, by H < m tokens in all, so at most t - 1 of them
by two or more. Of those that differ by one, the ones that are empty on one side
aren't found; they and the t shared ones are at most k + k1 by the set's own
counts. So at most 2 k + k1 - 1 segments fail, for either set, and of the first
min(q, q') one succeeds. A set with q > m writes the empty subsets as well; two
such sets meet there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import join_small, map_batches, materialise
from seqweave.llm.graph import components

#: Sizes of neighbouring bands differ by this ratio; it has to be at least 1 / threshold.
BAND_RATIO = 1.5
WORD_CACHE = 300_000
HOT_COPIES = 16
#: Documents whose texts are looked up by a broadcast of their ids; beyond, by an ordinary join.
MOST_IDS = 1_000_000
#: Cells in which signatures are counted: as many as hold so many rows each on average, and no fewer than the first number; one with HEAT times the mean holds a hot signature.
#: So no group in a window is over HEAT * CELL_ROWS rows, however many documents there are.
HEAT_CELLS, CELL_ROWS, HEAT = 4096, 1 << 16, 4
#: Bits kept of a signature: as many, or 16 more than the number of rows has.
KEPT = 44
#: Beyond so many expected rows, heat is told from one document in HEAT_SHARE: it only says which way a cell goes, not what is found.
HEAT_SAMPLED, HEAT_SHARE = 1 << 22, 8
#: Signatures that a task packs at a time.
CHUNK = 1 << 19
#: Members up to which a torn group is compared as it is, 8 million cheap comparisons at most. Larger ones are split by a fresh partition, which costs
#: about 200 rows a member, whatever the group's size. Parts that are still larger are compared in blocks of about so many.
CROWD = 4096
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads all bits."""
    x = (x ^ (x >> _S30)) * _MIX1
    x = (x ^ (x >> _S27)) * _MIX2
    return x ^ (x >> _S31)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of the whole text.

    Words are maximal runs without space, \\t, \\n, \\v, \\f and \\r, A-Z lower-cased.
    Fewer than n words form one shingle; no words form none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    total = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(total)


class Scheme:
    """Bands, differences and segments that a threshold (in percent) implies."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.ratio = max(BAND_RATIO, 100 / percent)
        self.starts = [1]
        while self.starts[-1] < 1 << 34:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * self.ratio)))

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def difference(self, both: int) -> int:
        """Most tokens by which two similar sets of so many tokens together can differ."""
        return both + 2 * (-self.percent * both // (100 + self.percent))

    def segments(self, band: int) -> int:
        """For pairs whose smaller set is in the band: the largest difference plus 1.

        difference(t) is never under difference(t - 2), so two values tell the largest.
        """
        top = self.starts[band + 1] - 1
        both = top + top * 100 // self.percent
        return max(self.difference(both), self.difference(both - 1), 0) + 1

    def bands_of(self, size: int) -> list[int]:
        """Its own, and the one below if a smaller partner can be there."""
        k = self.band(size)
        low = -(-size * self.percent // 100)
        return [k] if k == 0 or low >= self.starts[k] else [k, k - 1]


def segment_sums(tokens: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of m equal parts of the hash range: where it begins in the sorted tokens, and the sum of the mixed tokens before."""
    edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(np.uint64)
    at = np.concatenate(([0], np.searchsorted(tokens, edges), [len(tokens)]))
    return at, np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(tokens), dtype=np.uint64)))


def _sign(band: int, segment: np.ndarray, count: np.ndarray, total: np.ndarray, near: bool = False) -> np.ndarray:
    seed = np.uint64((2 * band + near + 1) << 40)
    return mix64(mix64(total + (seed + segment.astype(np.uint64)) * _MIX2) + count.astype(np.uint64))


def signatures(tokens: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Signatures of a set's subsets, and of their one-deletion neighbourhoods where it allots them."""
    out = []
    for band in scheme.bands_of(len(tokens)):
        m = scheme.segments(band)
        at, sums = segment_sums(tokens, m)
        count, total = np.diff(at), sums[at[1:]] - sums[at[:-1]]
        q = int(2 * (count == 0).sum() + (count == 1).sum())
        written = np.flatnonzero(count) if q <= m else np.arange(m)
        out.append(_sign(band, written, count[written], total[written]))
        if q := min(q, m):
            held = np.flatnonzero(count[:q])
            own = np.repeat(np.arange(q), count[:q])
            rest = total[own] - mix64(tokens[: at[q]])
            own, rest = own[count[own] > 1], rest[count[own] > 1]
            out.append(_sign(band, np.concatenate((held, own)), np.concatenate((count[held], count[own] - 1)), np.concatenate((total[held], rest)), near=True))
    return np.unique(np.concatenate(out))


SKETCH = 16  # longs


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens by 10 bits of their hash; they differ in at most as many places as the sets do."""
    flips = np.bincount((tokens & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


#: Places of a set's counts: one for 2 to 4 tokens, within these bounds.
PLACES = 1 << 8, 1 << 14


def counts(tokens: np.ndarray) -> np.ndarray:
    """Tokens at each of a power of two of places, by the low bits of their hash, 255 at most."""
    m = min(PLACES[1], max(PLACES[0], 1 << max(0, len(tokens).bit_length() - 2)))
    return np.minimum(np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m), 255).astype(np.uint8)


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A number of tokens by which two sets differ at least, from their counts; those of more places are folded."""
    m = min(len(x), len(y))
    x, y = (np.minimum(c.reshape(-1, m).sum(0, dtype=np.int64), 255) for c in (x, y))
    return int(np.abs(x - y).sum())


def _marked(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, mark, text: the mark is the same for rows of one id and text."""
    return df.selectExpr(f"CAST(`{key}` AS LONG) AS doc_id", f"xxhash64(CAST(`{key}` AS LONG), `{text}`) AS mark", f"`{text}` AS text")


def profiles(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """doc_id, mark, n_shingles, digest and sketch (s0, s1, ...) of each row."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, digest, parts = [], [], []
        for t in batch.column(2).to_pylist():
            tokens = shingle_set(t, n)
            size.append(len(tokens))
            digest.append(xxhash.xxh3_128_digest(tokens.tobytes()))
            parts.append(sketch(tokens))
        parts = np.array(parts)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), *[pa.array(parts[:, i]) for i in range(SKETCH)]],
            ["doc_id", "mark", "n_shingles", "digest", *[f"s{i}" for i in range(SKETCH)]],
        )

    return map_batches(_marked(df, key, text), fn, "doc_id long, mark long, n_shingles long, digest binary, " + ", ".join(f"s{i} long" for i in range(SKETCH)))


def _may_link(a: str, b: str, percent: int) -> str:
    """A condition that all linked pairs meet: sizes, and the sketches' parities."""
    most = f"({a}.n_shingles + {b}.n_shingles - 2 * CEIL({percent} * ({a}.n_shingles + {b}.n_shingles) / {100 + percent}D))"
    apart = " + ".join(f"BIT_COUNT({a}.s{i} ^ {b}.s{i})" for i in range(SKETCH))
    return f"100 * LEAST({a}.n_shingles, {b}.n_shingles) >= {percent} * GREATEST({a}.n_shingles, {b}.n_shingles) AND {apart} <= {most}"


def _texts(df: DataFrame, pairs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """doc_id, text, size and counts of the documents in pairs: few beside all. Whole texts are smaller than their sets of hashes, counts about a twentieth of them."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    docs = df.selectExpr(f"CAST(`{key}` AS LONG) AS doc_id", f"`{text}` AS text")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, n) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([counts(x).tobytes() for x in sets], pa.binary())], ["doc_id", "text", "size", "counts"])

    return materialise(map_batches(join_small(docs, ids, ["doc_id"], MOST_IDS, "left_semi"), fn, "doc_id long, text string, size long, counts binary"), "texts")


def _of_both(pairs: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """pairs with columns of both documents, those of a before those of b."""
    of = lambda end: texts.select(F.col("doc_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns])
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", *[f"{end}_{c}" for end in "ab" for c in columns])


def _near(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that may meet the threshold by their counts: no other pair's texts are shuffled."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        for batch in batches:
            _, _, na, ca, nb, cb = (c.to_pylist() for c in batch.columns)
            ok = [least_difference(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= scheme.difference(i + j) for i, x, j, y in zip(na, ca, nb, cb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return materialise(_of_both(pairs, texts, "size", "counts").mapInArrow(test, "a long, b long").distinct(), "near")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose whole shingle sets meet the threshold."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = shingle_set(x, n), shingle_set(y, n)
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                ok.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return _of_both(_near(pairs, texts, percent), texts, "text").mapInArrow(test, "a long, b long").distinct()


Sign = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _given(sigs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.ones(len(sigs), np.int64), sigs.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def signer(n: int, percent: int) -> Sign:
    """From texts to the number of signatures of each one, and all of them in a row."""

    def sign(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        scheme = Scheme(percent)
        found = [signatures(x, scheme) if len(x := shingle_set(t, n)) else np.empty(0, np.uint64) for t in texts.to_pylist()]
        return np.array([len(x) for x in found], np.int64), np.concatenate([*found, np.empty(0, np.uint64)])

    return sign


def _heat(docs: DataFrame, bits: int, sign: Sign) -> DataFrame:
    """(cell, n): signatures of each cell, counted within a task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << bits, np.int64)
        for batch in batches:
            n += np.bincount((sign(batch.column(1))[1] & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n[held])], ["cell", "n"])

    return docs.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _packed(docs: DataFrame, bits: int, kept: int, sign: Sign) -> DataFrame:
    """cell, high, low, rest: arrays of the documents and signatures of one cell, as far as a task has read.

    A cell is the low bits of a signature; of the others the next are kept, up to
    32, so a few documents meet that don't share one: one pair for some 100,000
    signatures. An id is its high and low 32 bits.
    """

    def pack(ids: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        cell, high = (sigs & np.uint64((1 << bits) - 1)).astype(np.int32), (ids >> 32).astype(np.int32)
        order = np.lexsort((high, cell)) if len(high) and high.min() < high.max() else np.argsort(cell, kind="stable")
        cell, high = cell[order], high[order]
        at = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), (np.diff(cell) != 0) | (np.diff(high) != 0))))
        ends = pa.array(np.append(at, len(cell)).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(ends, pa.array(x[order].astype(np.uint32).view(np.int32))) for x in (ids & 0xFFFFFFFF, sigs >> np.uint64(bits) & np.uint64((1 << min(32, kept - bits)) - 1))]
        return pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array(high[at]), *arrays], ["cell", "high", "low", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sigs = [], []
        for batch in batches:
            n, found = sign(batch.column(1))
            ids.append(np.repeat(batch.column(0).to_numpy(), n))
            sigs.append(found)
            if sum(map(len, sigs)) >= CHUNK:
                whole = np.concatenate(ids), np.concatenate(sigs)
                ids, sigs = [], []
                yield pack(*whole)
        if any(map(len, sigs)):
            yield pack(np.concatenate(ids), np.concatenate(sigs))

    return docs.mapInArrow(run, "cell int, high int, low array<int>, rest array<int>")


def _groups(docs: DataFrame, rows: int = 0, sign: Sign = _given) -> DataFrame:
    """doc_id and sig with hub, the smallest doc_id of the signature, and n, its rows; only where n > 1.

    docs has a doc_id and what sign makes signatures of: texts, or a signature itself.
    Signatures are counted in cells first, whose number grows with the rows expected.
    They are shuffled by their cell, packed, and never written beside that. Those of
    hot cells, a quarter at most, are aggregated (which combines before it shuffles)
    and joined back, a join that adaptive execution splits; the rest are small
    groups, which a window serves.
    """
    bits = max(HEAT_CELLS, 1 << max(0, rows // CELL_ROWS).bit_length()).bit_length() - 1
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HEAT_SHARE)) == 0) if rows > HEAT_SAMPLED else docs
    heat = materialise(_heat(some, bits, sign), "heat")
    hot = heat.crossJoin(F.broadcast(heat.agg(F.avg("n").alias("mean")))).where(F.col("n") > HEAT * F.col("mean")).select("cell", F.lit(True).alias("hot"))
    celled = join_small(_packed(docs, bits, max(KEPT, rows.bit_length() + 16), sign), hot, ["cell"])

    def unpacked(packed: DataFrame) -> DataFrame:
        each = packed.select("cell", "high", F.inline(F.arrays_zip("low", "rest")))
        return each.selectExpr("cell", "shiftleft(CAST(high AS LONG), 32) | (CAST(low AS LONG) & 4294967295) AS doc_id", f"shiftleft(CAST(rest AS LONG) & 4294967295, {bits}) | cell AS sig")

    calm = unpacked(celled.where("hot IS NULL").repartition("cell"))
    found = calm.select("doc_id", "sig", F.expr("min(doc_id) OVER (PARTITION BY cell, sig) AS hub"), F.expr("count(*) OVER (PARTITION BY cell, sig) AS n")).where("n > 1")
    if not hot.isEmpty():
        busy = unpacked(materialise(celled.where("hot"), "busy")).drop("cell")
        totals = materialise(busy.groupBy("sig").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "totals")
        found = found.unionByName(busy.join(totals, "sig").select(found.columns))
    return found


def _anew(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, fresh): signatures of each text's set under another partition of the hash range."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        scheme = Scheme(percent)
        sigs = [signatures(np.sort(mix64(shingle_set(t, n) + _MIX2)), scheme).view(np.int64) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "fresh"])

    return map_batches(texts.select("doc_id", "text"), fn, "doc_id long, fresh array<long>")


def _torn(members: DataFrame) -> DataFrame:
    """members (sig, doc_id, c) of groups with several components, with the group's size."""
    sizes = members.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    return materialise(members.join(sizes.select("sig", "size"), "sig"), "torn")


def _apart(members: DataFrame, small: DataFrame, df: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of one group and different components that may link.

    Similar sets share a signature under any partition of the hash range. So a large
    group is split by a fresh one, into groups of those that share a signature under
    both; whoever shares only what made the group large is apart then. What a fresh
    partition leaves together in large parts are sets that share much of what they
    hold; another one would multiply their rows and leave most of them together too,
    so blocks of such a part are compared, each pair of blocks in a task of its own.
    """
    torn = _torn(members)
    crowd, parts = torn.where(f"size > {CROWD}"), torn.where(f"size <= {CROWD}")
    if not crowd.isEmpty():
        ids = crowd.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
        fresh = materialise(_anew(_texts(df, ids, key, text, n), n, percent), "fresh")
        split = crowd.join(fresh, "doc_id").select("doc_id", "c", "sig", F.explode("fresh").alias("again")).select(F.xxhash64("sig", "again").alias("sig"), "doc_id", "c")
        parts = parts.unionByName(_torn(split))
    blocks = F.ceil(F.col("size") / CROWD).cast("int")
    fine = parts.select("sig", "doc_id", "c", F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
    x = fine.join(small, "doc_id")
    y = x.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    pairs = x.alias("x").join(y.alias("y"), F.expr(f"x.sig = y.sig AND x.block = y.block AND x.doc_id < y.doc_id AND x.c <> y.c AND {_may_link('x', 'y', percent)}"))
    return pairs.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    One row per row of df: doc_id, n_shingles and component_id (the smallest
    doc_id reachable by links, itself included). A text of null or without words
    has no shingles and is linked with nothing; rows with equal sets form one
    class at once; repeated rows give a row each; two texts under one doc_id count
    as that one document when it represents both; a row without an id has no
    component. Other columns aren't looked at; no rows give no rows. Ids are whole
    numbers, others are an error.

    Members of a signature group are set against one hub of the group: first each
    against the hub it shares most with, then, of the other hubs, against those that
    are still in another component. Last, members of one group that are still in
    different components are set against each other; groups of more than CROWD
    members are split by a fresh partition before.
    """
    if (kind := dict(df.dtypes)[key]) not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids have to be whole numbers, not {kind}")
    prof = materialise(profiles(df, key, text, n), "profiles")
    some = prof.where("n_shingles > 0 AND doc_id IS NOT NULL")
    parts = ["n_shingles", *[f"s{i}" for i in range(SKETCH)]]
    classes = materialise(some.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in parts]), "classes")
    # one row of each large class of equal sets writes signatures; a few equal ones more don't make a group hot
    hot = classes.where(F.col("copies") > HOT_COPIES).select("digest", F.col("doc_id").alias("rep"))
    copies = materialise(join_small(some.select("doc_id", "mark", "digest"), hot, ["digest"], how="inner").where("rep <> doc_id").select("mark").distinct(), "copies")
    one = join_small(_marked(df, key, text).where("doc_id IS NOT NULL"), copies, ["mark"], MOST_IDS, "left_anti").select("doc_id", "text")
    groups = materialise(_groups(one, some.agg(F.sum("n_shingles")).first()[0] or 0, signer(n, percent)), "groups")

    small = classes.select("doc_id", *parts)
    first = groups.where("doc_id <> hub").groupBy(F.col("hub").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("shared"))
    stars = materialise(first.join(small.alias("x"), F.expr("a = x.doc_id")).join(small.alias("y"), F.expr(f"b = y.doc_id AND {_may_link('x', 'y', percent)}")).select("a", "b", "shared"), "stars")
    texts = _texts(df, stars, key, text, n)
    nearest = stars.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("z"))).alias("m")).select((-F.col("m.z")).alias("a"), "b")
    links = materialise(_verified(nearest, texts, n, percent), "links")
    found = materialise(components(links), "found")
    at = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    apart = stars.join(nearest, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    more = materialise(_verified(apart, texts, n, percent), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        found = materialise(components(links), "found")

    # members of one group that are still in different components: pairs that no hub has settled
    placed = groups.where("n > 2").select("sig", "doc_id", "hub").join(classes.select("doc_id"), "doc_id", "left_semi").join(found.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left").select("sig", "doc_id", "hub", F.coalesce("c", "doc_id").alias("c"))
    cross = materialise(_apart(placed.select("sig", "doc_id", "c"), small, df, key, text, n, percent).join(stars, ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        links = links.unionByName(materialise(_verified(cross, _texts(df, cross, key, text, n), n, percent), "links"))
        found = components(links)

    owner = classes.select("digest", "doc_id", "copies").join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").where("copies > 1 OR component IS NOT NULL")
    told = owner.select("digest", F.coalesce("component", "doc_id").alias("component"))
    rows = prof.select("doc_id", "n_shingles", "digest").join(told, "digest", "left")
    of_set = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, of_set).otherwise(F.col("doc_id")).alias("component_id"))
