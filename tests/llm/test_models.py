"""Decisions and scores of models with known weights, against plain versions."""

import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from seqweave.llm import langid, toxicity
from seqweave.llm.common import table

SMALL = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def plain_grams(text):
    """Letter n-grams by dictionaries and whole numbers."""
    letters = [32]
    for ch in text:
        code = ord(ch) if ord(ch) > 65535 else ord(ch.lower()[0]) if ch.isalpha() else 32
        # of a run of signs that aren't letters one stays; the space before the text is a sign of its own
        if code != 32 or letters[-1] != 32 or len(letters) == 1:
            letters.append(code)
    letters.append(32)
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            g = letters[i]
            if n == 2:
                g = letters[i] * 0x10001 + letters[i + 1]
            if n == 3:
                g = (letters[i] * 0x10001 + letters[i + 1]) * 0x1003F + letters[i + 2]
            found[((g + n) * 0x9E3779B97F4A7C15 & MASK) >> (64 - langid.BITS)] += 1
    total = sum(found.values())
    return {h: math.sqrt(n / total) for h, n in found.items()}


@pytest.mark.parametrize("text", ["a", "The  quick\n\nbrown 123 fox", "  ÄÖ ß x ", "字漢 mixed 😀😀 text", "İstanbul ǅ", "x" * 3000])
def test_letter_grams(text):
    want, got = plain_grams(text), langid.grams(text)
    assert {int(h) for h in np.flatnonzero(got)} == want.keys()
    assert all(math.isclose(got[h], v, rel_tol=1e-5) for h, v in want.items())
    assert math.isclose(float((got.astype(float) ** 2).sum()), 1, rel_tol=1e-5)


def plain_decision(model, x):
    """Family by the greatest margin, then every pair within it votes."""
    dot = lambda w: float(np.dot(w[:-1].astype(float), x.astype(float)) + w[-1])
    margins = [dot(w) for w in model.family_weights]
    f = max(range(len(margins)), key=lambda k: margins[k])
    score = 1 / sum(math.exp(4 * (m - margins[f])) for m in margins)
    own = model.members[f]
    votes = dict.fromkeys(own, 0.0)
    for a, b in combinations(own, 2):
        soft = 1 / (1 + math.exp(-4 * max(-8, min(8, dot(model.pairs[a, b])))))
        votes[a] += soft
        votes[b] += 1 - soft
    best = max(own, key=lambda v: votes[v])
    return model.langs[best], score * (votes[best] / (len(own) - 1) if len(own) > 1 else 1), sorted(margins)[-2:], sorted(votes.values())[-2:]


def test_language_decision_of_known_weights(spark):
    """Families of one, two and three languages with drawn weights, over whole texts, through the operator."""
    rng = np.random.default_rng(5)
    w = lambda: rng.normal(0, 1, langid.SIZE + 1)
    members = [[0, 3, 5], [1], [2, 4]]
    model = langid.Model(list("abcdef"), ["x", "y", "z"], members, np.stack([w() for _ in members]), {p: w() for own in members for p in combinations(own, 2)})
    df = table(spark, SMALL, "documents")
    got = {(r.doc_id): r for r in langid.predict(df, model).collect()}
    seen = set()
    for r in df.select("doc_id", "text").collect():
        if not r.text or not any(map(str.isalpha, r.text)):
            assert got[r.doc_id].lang_pred == "und" and got[r.doc_id].score == 0
            continue
        lang, score, margins, votes = plain_decision(model, langid.grams(r.text))
        near = [v for v in (margins, votes) if len(v) == 2 and v[1] - v[0] < 1e-5]
        assert near or got[r.doc_id].lang_pred == lang and math.isclose(got[r.doc_id].score, score, rel_tol=1e-4)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        seen.add(lang)
    assert len(seen) > 1


def test_toxicity_score_of_a_known_machine(spark):
    """Bias, weights and the products of all pairs of terms, one by one, on whole texts."""
    df = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    def plain_terms(text):
        words = {w for w in toxicity.WORD.findall((text or "").lower())}
        return {zlib.crc32(w.encode()) % toxicity.BUCKETS for w in words | {w[: toxicity.STEM] + "~" for w in words if len(w) > toxicity.STEM}}

    counts = Counter(b for t in texts.values() for b in plain_terms(t))
    buckets = np.array(sorted(b for b, n in counts.items() if n >= 2)[:400], np.int64)
    rng = np.random.default_rng(2)
    m = toxicity.Machine(-0.7, buckets, rng.normal(0, 0.5, len(buckets)), rng.normal(0, 0.3, (len(buckets), 4)))
    got = {r.doc_id: r for r in toxicity.score(df, m).collect()}
    place = {int(b): i for i, b in enumerate(buckets)}
    met = 0
    for i, t in texts.items():
        at = sorted(place[b] for b in plain_terms(t) if b in place)
        z = m.bias + sum(m.weights[k] for k in at) + sum(float(m.vectors[a] @ m.vectors[b]) for a, b in combinations(at, 2))
        want = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert math.isclose(got[i].score, want, rel_tol=1e-6, abs_tol=1e-9) and got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        met += len(at) > 1
    assert met > len(texts) / 2
    kept = {r.doc_id for r in toxicity.keep_civil(df, m).select("doc_id").collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.5}


def test_bias_is_put_back_by_the_sampling_rates():
    """Learned where toxic rows are e times likelier to be sampled, only the bias differs, by 1 in log-odds."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 8)) for _ in range(600)]
    y = np.array([float(7 in r or rng.random() < 0.05) for r in rows])
    a, b = toxicity.fit(rows, y), toxicity.fit(rows, y, over=1.0)
    assert math.isclose(a.bias - b.bias, 1) and np.array_equal(a.weights, b.weights) and np.array_equal(a.vectors, b.vectors)
    odds = lambda p: math.log(p / (1 - p))
    assert all(math.isclose(odds(a.score(r)) - odds(b.score(r)), 1, abs_tol=1e-6) for r in rows[:50])
