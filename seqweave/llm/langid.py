"""Language identification in two steps: the family, then the language within it.

Linear support vector machines over hashed character n-grams: one against the
rest for families; one against one for the languages of a family, by votes.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqweave.llm.common import id_crc, map_batches

BITS = 12
SIZE = 1 << BITS
#: Families of common languages by ISO 639-1 code; others are a family each.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "indo-aryan": "hi bn ur mr ne pa gu",
    "turkic": "tr az kk uz",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def _letters() -> np.ndarray:
    """Lower-case code point of each letter of the basic plane; 32 for all else."""
    table = np.full(1 << 16, 32, np.uint64)
    for c in range(1 << 16):
        if (x := chr(c)).isalpha():
            table[c] = ord(x.lower()[0])
    return table


_table: list[np.ndarray] = []


def grams(text: str) -> np.ndarray:
    """Root-scaled shares of hashed letter n-grams of 1 to 3 of the whole text; its length as a vector is 1."""
    if not _table:
        _table.append(_letters())
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = _table[0][np.minimum(code, 65535)]
    if len(code) and code.max() > 65535:  # letters beyond the plane keep their code
        c = np.where(code > 65535, code.astype(np.uint64), c)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    c = np.concatenate(([np.uint64(32)], c[keep], [np.uint64(32)])).astype(np.uint64)
    one, two, three = c, c[:-1] * np.uint64(0x10001) + c[1:], (c[:-2] * np.uint64(0x10001) + c[1:-1]) * np.uint64(0x1003F) + c[2:]
    total = np.zeros(SIZE)
    for k, g in enumerate((one, two, three)):
        h = (g + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        total += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=SIZE)
    return np.sqrt(total / total.sum()).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 20.0, rounds: int = 150) -> np.ndarray:
    """Weights, the last one the bias, for labels 1 and -1: squared hinge loss, accelerated gradient steps, classes weighed evenly."""
    x = np.hstack((x.astype(np.float32), np.ones((len(x), 1), np.float32)))
    y = y.astype(np.float32)
    weight = (np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * penalty).astype(np.float32)
    step = np.float32(1 / (1 + 2 * float((weight * np.einsum("ij,ij->i", x, x)).sum())))
    w = np.zeros(x.shape[1], np.float32)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        loss = np.maximum(np.float32(0), 1 - y * (x @ ahead))
        new = ahead - step * (ahead - 2 * ((weight * y * loss) @ x))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    members: list[list[int]]
    family_weights: np.ndarray
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of rows of n-gram shares."""
        x = np.hstack((x, np.ones((len(x), 1), np.float32)))
        margins = x @ self.family_weights.T
        pick = margins.argmax(1)
        spread = np.exp(4 * (margins - margins.max(1, keepdims=True)))
        score = 1 / spread.sum(1)
        lang = np.zeros(len(x), np.int64)
        for f, own in enumerate(self.members):
            rows = np.flatnonzero(pick == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(own)))
            for (i, a), (j, b) in combinations(enumerate(own), 2):
                m = x[rows] @ self.pairs[a, b]
                soft = 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
                votes[:, i] += soft
                votes[:, j] += 1 - soft
            best = votes.argmax(1)
            lang[rows] = np.array(own)[best]
            if len(own) > 1:
                score[rows] *= votes[np.arange(len(rows)), best] / (len(own) - 1)
        return [self.langs[i] for i in lang], np.clip(score, 0, 1)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    family = [FAMILY_OF.get(v.lower().split("-")[0], f"({v})") for v in names]
    families = sorted(set(family))
    members = [[i for i, f in enumerate(family) if f == g] for g in families]
    of = np.array([families.index(f) for f in family])[y]
    if len(families) > 1:
        weights = np.stack([svm(x, np.where(of == k, 1.0, -1.0)) for k in range(len(families) if len(families) > 2 else 1)])
        weights = weights if len(families) > 2 else np.vstack((weights, -weights))  # the mirrored problem has the mirrored answer
    else:
        weights = np.zeros((1, x.shape[1] + 1))
    model = Model(names, families, members, weights)
    for own in members:
        for a, b in combinations(own, 2):
            rows = np.flatnonzero((y == a) | (y == b))
            model.pairs[a, b] = svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))
    return model


def train(df: DataFrame, per_lang: int = 400, key: str = "doc_id", text: str = "text", lang: str = "lang", most_langs: int = 200) -> Model | None:
    """Fits on about per_lang documents of each language (a bounded sample by a hash of id and text).

    Documents of the held-out fold (crc32 of the id modulo 4 is 2), without a text
    or a language aren't used. None if there is nothing to learn from. More than
    most_langs languages are an error rather than a cut.
    """
    known = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL").where(F.pmod(id_crc(F.col("id")), F.lit(4)) != 2)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not sizes:
        return None
    rates = df.sparkSession.createDataFrame([(r.lang, min(1.0, per_lang / r.n)) for r in sizes], "lang string, rate double")
    chosen = known.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.col("rate") * (1 << 30))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, g, grams(t).tobytes()) for i, t, g in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True) if has_letter(t)]
        return pa.RecordBatch.from_pylist([dict(zip(("id", "lang", "x"), r, strict=True)) for r in rows], pa.schema([("id", pa.string()), ("lang", pa.string()), ("x", pa.binary())]))

    rows = map_batches(chosen.select(F.col("id").cast("string").alias("id"), "text", "lang"), fn, "id string, lang string, x binary").orderBy(F.xxhash64("id", "x")).limit(3 * per_lang * len(sizes)).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.id, bytes(r.x)))
    return fit(np.stack([np.frombuffer(r.x, np.float32) for r in rows]), [r.lang for r in rows])


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from its whole text alone.

    A text of null, an empty one or one without letters is `und` with score 0, and
    so is all if nothing could be learned. Equal texts are predicted alike.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        rows = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            found, s = model.predict(np.stack([grams(texts[i]) for i in some]))
            score[some] = s
            for i, v in zip(some, found, strict=True):
                lang[i] = v
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    docs = df.select(F.col(key).alias("doc_id"), (F.pmod(id_crc(F.col(key)), F.lit(4)) == 2).alias("held_out"), F.col(text).alias("text"))
    return map_batches(docs, fn, f"doc_id {dict(df.dtypes)[key]}, held_out boolean, lang_pred string, score double")
