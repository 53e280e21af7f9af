"""Media columns: payloads as 8-bit WAV, and spectral fingerprints of them."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqweave.llm.common import map_batches, materialise

UNIT = 64
RATE = 8000
WINDOW, HOP = 128, 64  # a hop is a unit: no payload ends within one
BLOCK = 2048  # frames transformed at once, whatever the length of a payload
PEAKS, FAN_OUT, REACH = 2, 2, 32


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """Bytes 0 up to a positive multiple of the unit."""
    return raw + b"\0" * (-len(raw) % unit if raw else unit)


def to_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples, a sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def encode(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes and media (a WAV of the UTF-8 text, padded with bytes 0).

    A text of null is an empty text, whose payload is 64 bytes of 0. Rows are
    mapped one for one; equal texts give equal media; an empty table stays empty.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
        media = pa.array([to_wav(pad(x)) for x in raw], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), media], ["doc_id", "n_bytes", "media"])

    kind = dict(df.dtypes)[key]
    return map_batches(df.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text"), fn, f"doc_id {kind}, n_bytes long, media binary")


_TAPER = np.hanning(WINDOW + 1)[:-1].astype(np.float32)  # periodic: the windows over a sample add up to 1


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frame, frequency bin and level of spectral peaks, by frame and bin.

    Silence is set before and after the samples, so each one is within two frames,
    never at the very edge of both. A peak is a bin that no neighbour of its frame
    exceeds; the strongest PEAKS of a frame count. A level is in 1024ths of an octave
    of power. Frames go through the transform in blocks.
    """
    n = len(samples) // HOP + 1 + (len(samples) % HOP > 0)
    wave_ = np.zeros((n - 1) * HOP + WINDOW, np.float32)
    wave_[HOP : HOP + len(samples)] = samples.astype(np.float32) - 128.0
    frames = np.lib.stride_tricks.sliding_window_view(wave_, WINDOW)[::HOP]
    found = []
    for at in range(0, n, BLOCK):
        spectrum = np.fft.rfft(frames[at : at + BLOCK] * _TAPER, axis=1)[:, 1:]
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        edge = np.full((len(power), 1), -1, np.float32)
        top = (power >= np.hstack((edge, power[:, :-1]))) & (power > np.hstack((power[:, 1:], edge))) & (power > 1)
        held = np.where(top, power, np.float32(0))
        best = np.argsort(-held, axis=1, kind="stable")[:, :PEAKS]
        best.sort(axis=1)
        strength = np.take_along_axis(held, best, 1)
        row, column = np.nonzero(strength)
        found.append((row + at, best[row, column] + 1, np.rint(1024 * np.log2(strength[row, column].astype(np.float64))).astype(np.int32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times and hashes of peak pairs, each peak with the next FAN_OUT of later frames within REACH; and the peaks' levels.

    A hash holds the two bins and the distance in frames, as 8 + 8 + 8 bits.
    """
    times, bins, levels = peaks(samples)
    at, code = [], []
    later = np.searchsorted(times, times, "right")  # the first peak of a later frame
    for step in range(FAN_OUT):
        to = later + step
        ok = np.flatnonzero(to < len(times))
        ok = ok[times[to[ok]] - times[ok] <= REACH]
        at.append(times[ok])
        code.append((bins[ok] << 16) | (bins[to[ok]] << 8) | (times[to[ok]] - times[ok]))
    t, c = np.concatenate(at), np.concatenate(code)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32), levels


def features(df: DataFrame) -> DataFrame:
    """Reads stored media and derives digests and time-coded fingerprint arrays.

    feature sums them up: the number of peak pairs and a digest of the pairs and of
    all peaks' levels, so every byte of the payload counts. A payload of bytes 128
    alone is silent and has no peaks. Equal media give equal features; repeated rows
    a row each; an empty table stays empty.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {x: [] for x in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pair_times", "pair_codes")}
        for media in batch.column(2).to_pylist():
            payload = from_wav(media)
            t, c, levels = fingerprint(np.frombuffer(payload, np.uint8))
            rows["payload_bytes"].append(len(payload))
            rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            rows["tail_crc32"].append(zlib.crc32(payload[-UNIT:]))
            rows["media_bytes"].append(len(media))
            rows["media_sha256"].append(hashlib.sha256(media).hexdigest())
            rows["feature"].append(f"pairs={len(t)};{hashlib.blake2b(t.tobytes() + c.tobytes() + levels.tobytes(), digest_size=12).hexdigest()}")
            rows["pair_times"].append(t)
            rows["pair_codes"].append(c)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        made = [pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "n_bytes", *rows])

    kind = dict(df.dtypes)["doc_id"]
    return map_batches(df.select("doc_id", "n_bytes", "media"), fn, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pair_times array<int>, pair_codes array<int>")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every text as WAV in the shared folder, reads it back and fingerprints it.

    Texts of null are empty, long ones are stored whole, rows that repeat give a row
    each, no rows none; columns other than the two named aren't looked at.
    """
    return features(materialise(encode(df, key, text), "media"))
