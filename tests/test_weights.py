"""Bootstrap counts against plain Python."""

import hashlib
from collections import Counter

from seqweave.operators import resampling as r


def drawn(seed, rep, seq_id):
    u = int(hashlib.md5(f"{seed}|{rep}|{seq_id}".encode()).hexdigest()[:8], 16) / (1 << 32)
    return sum(u >= c for c in r.POISSON)


def test_weights_stand_beside_each_other(spark):
    rows = [(i, "xyz"[i % 3], ["a", "b"] if i % 2 else ["a", "c", "a"]) for i in range(60)]
    reps = r.WIDTH + 3
    want = Counter()
    for rep in range(reps + 1):
        for i, site, symbols in rows:
            for sym in symbols:
                want[rep, site, sym] += drawn("s", rep, i) if rep else 1
    got = r.weighted_counts(spark.createDataFrame(rows, "seq_id long, site string, symbols array<string>"), ["site"], "s", reps)
    assert {(x.rep, x.site, x.sym): x.cnt for x in got.collect()} == {k: n for k, n in want.items() if n}
    # no token is repeated for each replicate
    assert "w7" in got._jdf.queryExecution().optimizedPlan().toString()
