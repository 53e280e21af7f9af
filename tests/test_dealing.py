"""Lengths dealt anew, against plain Python."""

from collections import Counter
from hashlib import md5

from seqweave.operators import resampling as r


def test_dealt_lengths(spark, monkeypatch):
    monkeypatch.setattr(r, "RANKS", 16)
    rows = [(s, f"{s}|{k}|{i}", k, None if i == 3 else i % 7) for s in ("x", "y") for k, n in (("n", 40), ("o", 130)) for i in range(n)]
    want = Counter()
    for rep in (1, 2, 3):
        for s in ("x", "y"):
            own = [x for x in rows if x[0] == s]
            order = lambda side: sorted(own, key=lambda x: md5(f"q|{side}|{rep}|{x[1]}".encode()).hexdigest())  # noqa: B023, E731
            want.update((rep, s, a[2], b[3]) for a, b in zip(order("a"), order("b"), strict=True))
    pool = spark.createDataFrame(rows, "stratum string, tail string, kind string, len int")
    got = Counter()
    for x in r.dealt_lengths(pool, "q", 3).collect():
        got[x.rep, x.stratum, x.kind, x.len] += x.n
    assert got == want
    ordered = lambda width: {(x.rep, x.stratum, x.side, x.cell): bytes(x["items"]) for x in r._in_hash_order(pool.selectExpr("stratum", "tail", "int(kind = 'o') kind", "coalesce(len, -1) len"), "q", 3, width).collect()}
    assert ordered(8) == ordered(15)


def test_equal_bits_are_told(spark):
    rows = [("x", "same", 0, i) for i in range(2)]
    cells = r._in_hash_order(spark.createDataFrame(rows, "stratum string, tail string, kind int, len int"), "q", 1, 8)
    assert all(x.ties for x in cells.collect())
