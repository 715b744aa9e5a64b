"""Toxicity: a linear classifier of character n-grams, their presence scaled by naive Bayes log-count ratios.

N-grams are of bytes of the ASCII-lower-cased text, hashed into 2**bits features. A feature's value in a text is its
log-count ratio r if the text has it, else 0; logistic regression over these values gives the score. Only the features
whose class frequencies differ most surely are kept, so the rest of a text, however long, adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import LOWER, SPACE, joined, pieces, written

SIZES = (4, 5, 6, 7)
CHUNK = 1 << 18  # characters of training texts that are looked at at a time


@dataclass(frozen=True)
class NgramModel:
    """weight (2**bits): classifier weight times r, 0 for features left out; intercept."""

    bits: int
    weight: np.ndarray
    intercept: float


def features(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram size: the hashed feature at every byte, whether it lies within its text, and the texts' starts."""
    data, starts = joined(column)
    raw = LOWER[np.frombuffer(data, np.uint8)]
    raw = np.where(SPACE[raw], np.uint8(32), raw)
    raw[starts[1:] - 1] = 10  # only the ends of texts have it now
    left = np.repeat(starts[1:] - 1, np.diff(starts)) - np.arange(len(raw))  # bytes from here to the text's end
    h = np.zeros(len(raw), np.uint32)
    for k in range(max(SIZES)):
        live = h[: max(0, len(raw) - k)]
        live[:] = (live ^ raw[k:]) * np.uint32(0x01000193) + np.uint32(0x9E3779B9)
        if k + 1 in SIZES:
            mixed = h ^ (h >> np.uint32(15))
            yield (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits), left > k, starts


def present(column: pa.Array, bits: int, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, as two arrays; only features that are kept, if given."""
    found = []
    for f, inside, starts in features(column, bits):
        at = np.flatnonzero(inside if kept is None else inside & kept[f])
        text = np.searchsorted(starts, at, "right") - 1
        found.append(text.astype(np.int64) << bits | f[at])
    pairs = np.unique(np.concatenate(found))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray | None = None, bits: int = 20, keep: int = 20_000, alpha: float = 1.0, least: int = 4, penalty: float = 1e-3, steps: int = 200) -> NgramModel:
    """Naive Bayes ratios, a choice of `keep` features, then logistic regression by gradient steps.

    weight: how many rows each text stands for. keep, least: the features of the highest z score of the difference in
    class frequency, among those in `least` texts or more. With fewer than two classes the score is the share of toxic rows.
    """
    toxic = np.asarray(toxic, bool)
    weight = np.ones(len(toxic)) if weight is None else np.asarray(weight, float)
    prior = np.clip(float((weight * toxic).sum() + 0.5) / float(weight.sum() + 1), 1e-4, 1 - 1e-4)
    none = NgramModel(bits, np.zeros(1 << bits, np.float32), float(np.log(prior / (1 - prior))))
    if not toxic.any() or toxic.all():
        return none
    size = np.cumsum([len(x) + 100 for x in texts])
    edges = np.unique(np.concatenate(([0], np.searchsorted(size, np.arange(CHUNK, size[-1], CHUNK), "right"), [len(texts)]))).tolist()
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    count = np.zeros((2, 1 << bits), np.int64)
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        t, f = present(pa.array(texts[i:j], pa.string()), bits)
        for c in (0, 1):
            count[c] += np.bincount(f[toxic[i + t] == bool(c)], minlength=1 << bits)
    ratio = np.log((count[1] + alpha) / (n1 + 2 * alpha)) - np.log((count[0] + alpha) / (n0 + 2 * alpha))
    share = (count[0] + count[1]) / (n1 + n0)
    z = (count[1] / n1 - count[0] / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    z[count.sum(axis=0) < least] = 0
    kept = np.zeros(1 << bits, bool)
    kept[np.argsort(-np.abs(z), kind="stable")[:keep]] = True
    kept &= z != 0
    rows, cols, place = [], [], (np.cumsum(kept) - 1).astype(np.int32)
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        t, f = present(pa.array(texts[i:j], pa.string()), bits, kept)
        rows.append((i + t).astype(np.int32))
        cols.append(place[f])
    names = np.flatnonzero(kept)
    r, w, b = ratio[names], np.zeros(len(names)), none.intercept
    share = weight / weight.sum()
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for k in range(1, steps + 1):
        # a chunk of texts at a time: a feature's value is r, so neither values nor products are kept for all
        rw, logit, slope = r * w, np.full(len(texts), b), np.zeros(len(names))
        for row, col in zip(rows, cols, strict=True):
            logit += np.bincount(row, rw[col], len(texts))
        wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic) * share
        for row, col in zip(rows, cols, strict=True):
            slope += np.bincount(col, wrong[row], len(names))
        g = np.append(r * slope + penalty * w, wrong.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = 0.02 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    out = np.zeros(1 << bits, np.float32)
    out[names] = w * r
    return NgramModel(bits, out, float(b))


def training_rows(docs: DataFrame, labels: DataFrame, where: Column, per_class: int = 2000, most_chars: int = 40_000_000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """A bounded sample of labelled rows: whole texts, classes, and how many rows each stands for.

    Bounds: about per_class rows of either class, and fewer if their texts have more than most_chars characters in all;
    drawn by a hash of the id, whatever the text. Exact copies within a class count once. A null label is no label; a
    document labelled both ways counts as toxic.
    """
    known = labels.where(where & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return [], np.zeros(0, bool), np.zeros(0)
    u = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) / F.lit(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / counts.get(1, per_class)))).otherwise(F.lit(min(1.0, per_class / counts.get(0, per_class))))
    some = known.where(u < share)
    rows = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id").select("toxic", "text", (u / share).alias("u")))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    drawn_rows = rows.where(F.col("u") < most_chars / max(chars, 1)).select("toxic", "text").distinct().orderBy("toxic", F.xxhash64("text"), "text").collect()
    toxic = np.array([r["toxic"] == 1 for r in drawn_rows], bool)
    drawn = {c: max(1, int((toxic == bool(c)).sum())) for c in (0, 1)}
    weight = np.array([counts[r["toxic"]] / drawn[r["toxic"]] for r in drawn_rows], float)
    return [r["text"] for r in drawn_rows], toxic, weight


def score(df: DataFrame, model: NgramModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row; null and empty texts score the intercept alone. Repeats stay repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 4 << 20):
            p = probabilities(model, b.column(1))
            yield pa.record_batch([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def probabilities(model: NgramModel, column: pa.Array) -> np.ndarray:
    text, f = present(column, model.bits, model.weight != 0)
    logit = model.intercept + np.bincount(text, model.weight[f], len(column))
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def is_accepted(model: NgramModel, threshold: float = 0.3, text_col: str = "text") -> Column:
    """Whether a text's score is below the threshold; computed beside the row, without a join."""

    @F.arrow_udf("boolean")
    def accepted(column: pa.Array) -> pa.Array:
        parts = [probabilities(model, b.column(0)) < threshold for b in pieces(iter([pa.record_batch([column], names=["text"])]), "text", 4 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return accepted(F.col(text_col).cast("string"))
