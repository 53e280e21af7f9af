"""Centroids, runs of words and byte-level BPE against plain versions, and their odd cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import struct
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import __spark_entry__
from seqweave.llm import bpe, centroids, runs

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD_TEXTS = [None, "", " ", "\n\n", "a", "a a a a", "x " * 40_000, "y" * 30_000, " " * 5_000 + "z", "ab" * 2_000 + " 1", "naïve Straße 中文字 ٣٤ 👍🏽 é", "<|endoftext|>", "it's we'll  two\t\x1c\x85 ends ", "՘౜ab ꟎1"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with results'."""
    rows = [(k % 12 if k else None, t, 1, b"2", [3], "4") for k, t in enumerate([*ODD_TEXTS, *ODD_TEXTS[:3]])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids binary, runs array<int>, collapsed string")


# --- centroids


def plain_clusters(vectors, k=16, rounds=3):
    """Rows (id, cluster, distance) and the centroids, one vector after the other."""
    kept = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    best = lambda v: min((far(v, c), k) for k, c in enumerate(means))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        means = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(means)]
    return [(i, best(v)[1], best(v)[0]) for i, v in kept], means


def clustered(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, v int")
    vectors = centroids.integral(df)
    found = centroids.fit(vectors)
    return [tuple(r) for r in centroids.assign(vectors, found).collect()], found


def test_centroids_against_plain_version(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(i % 5, 0.3) for _ in range(64)], "a", 1) for i in range(150)]
    rows += [(7, rows[7][1], "b", 2), (None, [0.5] * 64, "c", 3), (500, None, "d", 4), (501, [1.0] * 63, "e", 5), (502, [1.0] * 63 + [None], "f", 6), (503, [1.0] * 63 + [float("nan")], "g", 7), (504, [1.0] * 63 + [float("-inf")], "h", 8)]
    got, means = clustered(spark, rows)
    want, plain_means = plain_clusters([r[:2] for r in rows])
    assert means == plain_means
    total, by = sum(r[2] for r in want), {}
    for r in want:
        by[r[1]] = by.get(r[1], 0) + r[2]
    assert sorted(got, key=str) == sorted([(*r, by[r[1]], total) for r in want], key=str)


def test_centroids_of_few_equal_and_huge_vectors(spark):
    assert clustered(spark, [(1, None, "a", 1)])[0] == []
    got, means = clustered(spark, [(i, [0.25] * 64, "a", 1) for i in range(40)])
    assert {r[1:] for r in got} == {(0, 0, 0, 0)} and means == [[16] * 64] * 16  # ties: the smallest number; empty centroids stay
    got, _ = clustered(spark, [(1, [1e300] * 64, "a", 1), (2, [-1e300] * 64, "a", 1)])
    assert sorted(r[:3] for r in got) in ([(1, 0, 0), (2, 1, 0)], [(1, 1, 0), (2, 0, 0)])
    table = centroids.centroid_table(spark, [[1, -2], [3, 4]])
    assert [tuple(r) for r in table.orderBy("cluster").collect()] == [(0, [1, -2]), (1, [3, 4])]


# --- runs


def plain_runs(words, least=12):
    """All runs by comparing the words with themselves at each distance."""
    n, number = len(words), {}
    x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = {}
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= max(q, least - q)].tolist():
            found.setdefault((a, b + q - a), q)  # a smaller period of the same stretch was there before
    return sorted((s, size, q) for (s, size), q in found.items())


def plain_collapsed(words, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_short_words_against_plain_version():
    rnd = random.Random(3)
    for _ in range(400):
        n, letters = rnd.randrange(70), rnd.choice([1, 2, 2, 3, 6])
        words = [str(rnd.randrange(letters)) for _ in range(n)]
        for least in (2, 5, 12):
            assert sorted(map(tuple, runs.text_runs(words, least).tolist())) == plain_runs(words, least)
    a, b = ["a"], ["a", "b"]
    while len(b) < 2000:
        a, b = b, b + a
    assert sorted(map(tuple, runs.text_runs(b).tolist())) == plain_runs(b)


def test_runs_that_touch_and_nest():
    words = "s1 a b a b c a b a b c a b a b c s2 d d d d d d d d d d d d d s3".split()
    found = [tuple(r) for r in runs.text_runs(words).tolist()]
    assert found == [(1, 15, 5), (17, 13, 1)] == plain_runs(words)
    assert runs.collapsed(words, np.array(found)) == "s1 a b a b c s2 d s3"
    assert not len(runs.text_runs(words[:12]))  # 11 words of the run are too few


def test_run_query_against_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in __spark_entry__.queries()["op12_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = runs.WORDS.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in sorted(found, key=lambda r: (r[0], r[2])))
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *want)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 10


def test_runs_of_odd_tables(spark, odd_docs):
    rows = runs.periodic_runs(odd_docs).collect()
    assert rows[0].__fields__ == ["doc_id", "n_words", "runs", "collapsed"] and len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    x = by[6][0]
    assert x.n_words == 40_000 and [tuple(v) for v in x.runs] == [(0, 40_000, 1)] and x.collapsed == "x"
    assert sorted(r.n_words for r in by[None]) == [0]
    assert runs.periodic_runs(odd_docs.limit(0)).collect() == []
    assert runs.periodic_runs(odd_docs.where("doc_id IS NULL")).first().collapsed == ""


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = __spark_entry__.queries()["op13_bpe"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_bpe_of_odd_tables(spark, odd_docs, library):
    coded = bpe.encode(odd_docs, PATH)
    assert coded.columns == ["doc_id", "n_tokens", "ids"]
    rows = bpe.decode(coded, PATH).collect()
    want = sorted((str(r.doc_id), r.text or "") for r in odd_docs.collect())
    assert sorted((str(r.doc_id), r.decoded.decode()) for r in rows) == want
    for r in rows:
        ids = library.encode_ordinary(r.decoded.decode())
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
    assert bpe.decode(bpe.encode(odd_docs.limit(0), PATH), PATH).collect() == []
    more = spark.createDataFrame([(None, "old", None), (struct.pack("<I", 7), "old", 2)], "ids binary, decoded string, ID long")
    assert [tuple(r) for r in bpe.decode(more, PATH).orderBy("ID").collect()] == [(None, None, None), (2, bytearray(struct.pack("<I", 7)), bytearray(library.decode_single_token_bytes(7)))]


def test_bpe_of_random_texts(library):
    rnd, v = random.Random(6), bpe.vocabulary(PATH)
    letters = ["abcdefghijklmnopqrstuvwxyz", "aab", "ab '", "äöüßéñ", "中文字日本", "\n\t  \r\x1c\x85　", "0123456789", "!?.,-_=+/", "🎉👍🏽‍", "٣४"]
    for _ in range(40):
        texts = ["".join(rnd.choice(rnd.choice(letters)) for _ in range(rnd.randrange(200))) for _ in range(10)]
        texts += ["".join(rnd.choice(letters[0]) for _ in range(rnd.randrange(900))), "a" * rnd.randrange(1200), " " * rnd.randrange(900) + "x", "ab" * rnd.randrange(600), "=-" * rnd.randrange(900)]
        for text, ids in zip(texts, v.encode(texts), strict=True):
            assert ids == np.array(library.encode_ordinary(text), "<u4").tobytes()
            assert v.decode(np.frombuffer(ids, "<u4")) == text.encode()


def test_bpe_merges_alike_in_matrices_and_long_rows():
    rnd, v = random.Random(7), bpe.vocabulary(PATH)
    raws = [bytes(rnd.choice(b"etaoin shrdlu") for _ in range(rnd.randrange(2, 250))) for _ in range(200)] + [b"a" * n for n in range(2, 99)]
    assert v.merge(raws) == [v.merge_long(raw) for raw in raws]


def test_bpe_slices_change_nothing(monkeypatch):
    v = bpe.vocabulary(PATH)
    texts = ["one two  three\n\n four 55 six's\t seven " * 9, "no-gap" * 50, "   ", ""]
    whole = v.encode(texts)
    monkeypatch.setattr(bpe, "SLICE", 7)
    assert v.encode(texts) == whole and "".join(bpe.slices(texts[0])) == texts[0]


def test_bpe_letters_newer_than_the_librarys(library):
    v = bpe.vocabulary(PATH)
    for span in bpe.LATER.split():
        for c in {int(x, 16) for x in span.split("-")}:
            text = f"ab{chr(c)}c {chr(c)}1!{chr(c)}"
            assert v.encode([text])[0] == np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_bpe_unknown_ids_are_an_error():
    with pytest.raises(ValueError, match="vocabulary"):
        bpe.vocabulary(PATH).decode(np.array([10**6]))
