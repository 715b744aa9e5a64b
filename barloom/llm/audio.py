"""Chroma audio fingerprints and the alignment of recordings.

A recording's frames are folded into twelve pitch classes; sixteen filters over the integral image of these frames are
quantised to two bits each and packed into one integer a frame. Recordings are linked if they share a landmark, a hash of
`run` successive integers; landmarks are thinned by taking the least of every `window` (the same ones wherever the same
integers stand). All holders of a landmark are tied to the least of them, which links what all their pairs would link,
without the pairs. For each recording the offset histogram of its landmarks against each such partner gives the best
offset, and the bits of the overlapping integers give the error rate there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, join_hot, joined, mixed, pieces, span_hashes, spans, written
from barloom.llm.graph import components

FILTERS = 16


@dataclass(frozen=True)
class Chroma:
    """Analysis settings: samples a second, samples of a frame and between frames, and the range of frequencies."""

    rate: int = 2000
    frame: int = 256
    hop: int = 128
    lowest: float = 110.0
    highest: float = 990.0
    step: float = 0.1  # the quantiser parts at -step, step / 4 and step

    def filters(self) -> list[tuple[int, int, int, int]]:
        """(kind, first class, classes, frames) of each filter, spread over kinds, places and widths by a rule."""
        return [(i % 6, 5 * i % 7, 3 + i % 3, 2 + 5 * i % 7) for i in range(FILTERS)]

    @property
    def width(self) -> int:
        return max(f[3] for f in self.filters())


def classes(chroma: Chroma) -> np.ndarray:
    """(bins, 12): the pitch class of each frequency bin within the range."""
    f = np.fft.rfftfreq(chroma.frame, 1 / chroma.rate)
    out = np.zeros((len(f), 12), np.float32)
    for i, x in enumerate(f):
        if chroma.lowest <= x <= chroma.highest:
            out[i, round(12 * np.log2(x / 440.0)) % 12] = 1
    return out


def codes(chroma: Chroma, samples: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed integers of several recordings laid end to end, and where each recording's begin (and the last end)."""
    size = np.diff(starts)
    frames = np.where(size >= chroma.frame, (size - chroma.frame) // chroma.hop + 1, 0)
    at = np.concatenate(([0], np.cumsum(frames)))
    begin = np.repeat(starts[:-1] - chroma.hop * at[:-1], frames) + chroma.hop * np.arange(int(at[-1]))
    window, fold = np.hanning(chroma.frame).astype(np.float32), classes(chroma)
    image = np.zeros((int(at[-1]), 12))
    for i in range(0, len(begin), 4096):
        part = samples[begin[i : i + 4096, None] + np.arange(chroma.frame)].astype(np.float32) * window
        image[i : i + 4096] = (np.abs(np.fft.rfft(part, axis=1)) ** 2) @ fold
    image /= np.maximum(image.sum(axis=1, keepdims=True), 1e-9)  # loudness does not matter
    integral = np.zeros((len(image) + 1, 13))
    np.cumsum(np.cumsum(image, axis=0), axis=1, out=integral[1:, 1:])
    n = np.maximum(frames - chroma.width + 1, 0)
    to = np.concatenate(([0], np.cumsum(n)))
    first = np.repeat(at[:-1] - to[:-1], n) + np.arange(int(to[-1]))
    out = np.zeros(len(first), np.uint32)

    def area(x: int, y: int, w: int, h: int) -> np.ndarray:
        """Energy of w frames from x and h classes from y on, at every place."""
        i = first + x
        return integral[i + w, y + h] - integral[i, y + h] - integral[i + w, y] + integral[i, y]

    for k, (kind, y, h, w) in enumerate(chroma.filters()):
        whole = area(0, y, w, h)
        if kind == 0:
            a, b = whole, area(0, (y + h) % (12 - h), w, h)
        elif kind == 1:
            a = area(0, y, w, h // 2)
            b = whole - a
        elif kind == 2:
            a = area(0, y, w // 2, h)
            b = whole - a
        elif kind == 3:
            a = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
            b = whole - a
        elif kind == 4:
            a = area(0, y + h // 3, w, max(1, h // 3))
            b = whole - a
        else:
            a = area(w // 3, y, max(1, w // 3), h)
            b = whole - a
        value = np.log1p(a) - np.log1p(b)
        level = (value > -chroma.step).astype(np.uint32) + (value > chroma.step / 4) + (value > chroma.step)  # silence, at 0, is off all thresholds
        out |= (level ^ (level >> np.uint32(1))) << np.uint32(2 * k)  # Gray code: neighbouring levels differ in one bit
    return out, to


def pcm(raw: bytes, kind: int, channels: int, bits: int) -> np.ndarray | None:
    """Samples of one channel, the mean of all, on the scale of 16 bits; None for what is no such coding."""
    size = bits // 8
    n = len(raw) // (size * channels) * channels if size and channels else 0
    raw = raw[: n * size]
    if kind == 1 and bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) * 256
    elif kind == 1 and bits == 16:
        x = np.frombuffer(raw, "<i2").astype(np.float64)
    elif kind == 1 and bits == 24:
        x = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((x[:, 0] << 8 | x[:, 1] << 16 | x[:, 2] << 24) / 65536.0).astype(np.float64)
    elif kind == 1 and bits == 32:
        x = np.frombuffer(raw, "<i4") / 65536.0
    elif kind == 3 and bits in (32, 64):
        x = np.nan_to_num(np.frombuffer(raw, f"<f{size}").astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0) * 32768
    else:
        return None
    return x.reshape(-1, channels).mean(axis=1)


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """x at another rate: each new sample is the mean of the old ones it stands for, or lies between two of them."""
    if rate == to or not len(x):
        return x
    at = np.arange(int(len(x) * to / rate)) * (rate / to)
    if rate < to:
        return np.interp(at, np.arange(len(x)), x)
    sums = np.concatenate(([0.0], np.cumsum(x)))
    edge = np.interp(np.append(at, at[-1] + rate / to) if len(at) else at, np.arange(len(sums)), sums)
    return np.diff(edge) * to / rate


def wav_samples(column: pa.Array, chroma: Chroma = Chroma()) -> tuple[np.ndarray, np.ndarray]:
    """Samples of WAV bytes laid end to end, and where each recording begins: integers of 8 to 32 bits or floats, any number of
    channels (mixed to one) and any rate (brought to chroma.rate). What is no such file is silent and has no samples."""
    out = []
    for raw in column.cast(pa.binary()).to_pylist():
        raw = raw or b""
        at, got, form = 12, b"", None
        while raw[:4] == b"RIFF" and raw[8:12] == b"WAVE" and at + 8 <= len(raw):
            name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
            body = raw[at + 8 : at + 8 + size]
            if name == b"fmt " and len(body) >= 16:
                number = lambda i, j: int.from_bytes(body[i:j], "little")  # noqa: B023, E731
                kind = number(24, 26) if number(0, 2) == 0xFFFE and len(body) >= 26 else number(0, 2)
                form = kind, number(2, 4), number(14, 16), number(4, 8)
            elif name == b"data":
                got = body
            at += 8 + size + size % 2
        x = pcm(got, *form[:3]) if form and form[1] and form[3] else None
        if x is None:
            out.append(np.zeros(0, np.int16))
        else:
            out.append(np.rint(np.clip(resampled(x, form[3], chroma.rate), -32768, 32767)).astype(np.int16))
    return np.concatenate([np.zeros(0, np.int16), *out]), np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)


def melody(column: pa.Array, chroma: Chroma = Chroma()) -> tuple[np.ndarray, np.ndarray]:
    """Texts played as music, for tables without recordings: each word is two notes of two octaves, picked by its hash,
    that sound for one hop. A null text is silent and has no samples."""
    data, starts = joined(column)
    raw = np.frombuffer(data, np.uint8)
    begin, end, first = spans(~SPACE[raw], starts)
    t = np.arange(chroma.hop) / chroma.rate
    tones = np.sin(2 * np.pi * (220.0 * 2 ** (np.arange(24) / 12))[:, None] * t)
    chords = np.rint(8000 * (tones[:, None] + tones[None])).astype(np.int16).reshape(24 * 24, chroma.hop)
    return chords[(span_hashes(raw, begin, end) % np.uint64(24 * 24)).astype(np.int64)].ravel(), first * chroma.hop


def fingerprints(df: DataFrame, id_col: str, media_col: str, chroma: Chroma = Chroma(), decode: Callable = wav_samples, most: int = 256 << 10) -> DataFrame:
    """(rec_id, n_codes, codes, digest) of every row: the packed integers as little-endian bytes, and a hash of them.

    decode: from the media column and the settings to samples and starts. most: bytes of media decoded at a time. Media that are null,
    empty, or too short for one integer have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "media", most):
            values, at = codes(chroma, *decode(b.column(1), chroma))
            blobs = [values[i:j].astype("<u4").tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(np.diff(at)), pa.array(blobs, pa.binary())], names=["rec_id", "n_codes", "codes"])

    return df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(media_col).alias("media")).mapInArrow(run, "rec_id long, n_codes long, codes binary").withColumn("digest", F.xxhash64("codes"))


def landmarks(values: np.ndarray, run: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of a recording's landmarks: of every `window` successive hashes of `run` integers the least, once."""
    n = len(values) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(run):
        h = mixed((h ^ values[k : k + n].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    if n <= window:
        at = np.array([int(h.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, window)
        at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return h[at], at


def aligned(prints: DataFrame, run: int = 8, window: int = 4) -> DataFrame:
    """One row for each row of fingerprints(): rec_id, n_codes, codes_crc32, class_id (the least recording that links
    reach), and its best partner: partner_id, offset, votes and bit_error, null without one.

    Recordings of the same integers are copies: they share a class and only the least of them is aligned, for all. Rows of one
    id and different recordings are recordings of their own. Those
    without integers are copies of each other only if they have no integers at all and then form no class: each is its
    own. Rows with a null id keep their own columns and take the class of their copies.
    """
    prints = written(prints)
    some = prints.where("n_codes > 0 and rec_id is not null")
    reps = written(some.groupBy("digest").agg(F.min_by(F.struct("n_codes", "codes"), "rec_id").alias("x"), F.min("rec_id").alias("rep")).select("digest", "rep", "x.codes"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, recs, places, reps = [], [], [], []
            for rec, rep, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                key, at = landmarks(np.frombuffer(raw, "<u4"), run, window)
                keys.append(key)
                places.append(at)
                recs.append(np.full(len(at), rec))
                reps.append(np.full(len(at), rep))
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(recs)), pa.array(np.concatenate(reps)), pa.array(np.concatenate(places).astype(np.int32))], names=["key", "rec", "rep", "place"])

    # recordings go by their digest, as one id may have several; "least" is by id
    marked = written(reps.select("digest", "rep", "codes").mapInArrow(marks, "key long, rec long, rep long, place int"))
    least = marked.groupBy("key").agg(F.min(F.struct("rep", "rec", "place")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "n", F.col("hub.rec").alias("hub"), F.col("hub.rep").alias("hub_rep"), F.col("hub.place").alias("hub_place"))
    total = marked.count()
    votes = written(join_hot(marked, least, "key", "n", total).where("rec <> hub").groupBy("rec", "hub", "hub_rep", (F.col("place") - F.col("hub_place")).alias("offset")).agg(F.count("*").alias("votes")))
    best = votes.groupBy("rec").agg(F.max(F.struct("votes", (-F.col("hub_rep")).alias("h"), (-F.abs("offset")).alias("a"), "offset", "hub")).alias("x")).select("rec", F.col("x.hub").alias("hub"), (-F.col("x.h")).alias("partner_id"), F.col("x.offset").alias("offset"), F.col("x.votes").alias("votes"))

    @F.arrow_udf("double")
    def bit_error(mine: pa.Array, other: pa.Array, offset: pa.Array) -> pa.Array:
        return pa.array([bit_errors(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), o) for a, b, o in zip(mine.to_pylist(), other.to_pylist(), offset.to_pylist(), strict=True)], pa.float64())

    mine, other = reps.select(F.col("digest").alias("rec"), F.col("codes").alias("own")), reps.select(F.col("digest").alias("hub"), F.col("codes").alias("theirs"))
    scored = best.join(mine, "rec").join(other, "hub").select("rec", "partner_id", "offset", "votes", bit_error("own", "theirs", "offset").alias("bit_error"))
    comp = components(votes.select(F.col("rec").alias("a"), F.col("hub").alias("b")))
    tied = written(reps.select("digest", "rep").join(comp, F.col("digest") == F.col("node"), "left").select("digest", "rep", F.coalesce("component", "digest").alias("component")))
    firsts = tied.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("n"))
    classed = join_hot(tied, firsts, "component", "n", tied.count())
    named = written(classed.join(scored, classed["digest"] == scored["rec"], "left").select("digest", "class_id", "partner_id", "offset", "votes", "bit_error"))
    crc = F.crc32("codes").alias("codes_crc32")
    full = prints.where("n_codes > 0").join(named, "digest", "left").select("rec_id", "n_codes", crc, "class_id", "partner_id", "offset", "votes", "bit_error")
    none = prints.where("n_codes = 0").select("rec_id", "n_codes", crc, F.col("rec_id").alias("class_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("partner_id", "long"), ("offset", "int"), ("votes", "long"), ("bit_error", "double"))])
    return full.unionByName(none)


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> float | None:
    """The share of bits that differ where a, moved left by offset, overlaps b; None without an overlap."""
    low, high = max(0, -offset), min(len(b), len(a) - offset)
    if high <= low:
        return None
    return float(np.bitwise_count(a[low + offset : high + offset] ^ b[low:high]).sum()) / (32 * (high - low))
