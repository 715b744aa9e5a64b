"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

Both directions read windows of the text's bytes; each position gets a softmax over the languages from the two hidden
states, and a text's probabilities are the means over all its positions. Every byte of every text is read: windows
follow one another, and the last one is moved back to the text's end and counted only where it is new.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import pieces, written

UNDETERMINED = "und"


@dataclass
class ByteGRU:
    """labels, and the arrays: table (2, 256, 3 h) of input terms, inner (2, h, 3 h), bias (2, h), out (2, h, k), shift (k)."""

    labels: list[str]
    table: np.ndarray
    inner: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias, self.out, self.shift]

    def forward(self, windows: np.ndarray, keep: bool = False) -> tuple[list[np.ndarray], list]:
        """Hidden states (t, n, h) of each direction over byte windows (n, t), in reading order; keep: what BPTT needs.

        Reset, update and candidate: r, z = sigmoid; c = tanh(x + r (h U + b)); h = c + z (h - c).
        """
        n, t = windows.shape
        h = self.inner.shape[1]
        half = np.float32(0.5)  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        out, steps = [], []
        for d in (0, 1):
            x_gate, x_new = self.table[d, :, : 2 * h] * half, np.ascontiguousarray(self.table[d, :, 2 * h :])
            u_gate, u_new, bias = self.inner[d, :, : 2 * h] * half, np.ascontiguousarray(self.inner[d, :, 2 * h :]), self.bias[d]
            rows = np.ascontiguousarray(windows.T if d == 0 else windows.T[::-1])
            states = np.empty((t, n, h), self.table.dtype)
            state = np.zeros((n, h), self.table.dtype)
            for i in range(t):
                gates = state @ u_gate
                gates += x_gate.take(rows[i], axis=0)
                np.tanh(gates, out=gates)
                gates += 1
                gates *= half
                c_in = state @ u_new
                c_in += bias
                r, z = gates[:, :h], gates[:, h:]
                c = r * c_in
                c += x_new.take(rows[i], axis=0)
                np.tanh(c, out=c)
                if keep:
                    steps.append((state, r, z, c, c_in, rows[i]))
                new = states[i if d == 0 else t - 1 - i]
                np.subtract(state, c, out=new)
                new *= z
                new += c
                state = new
            out.append(states)
        return out, steps

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(k, t, n) probabilities of every position."""
        states, _ = self.forward(windows)
        return self._softmax(states)

    def _softmax(self, states: list[np.ndarray]) -> np.ndarray:
        """Hidden values are within 1 of 0, so that the exponents stay small without taking a maximum off."""
        t, n, h = states[0].shape
        x = self.out[0].T @ states[0].reshape(-1, h).T
        x += self.out[1].T @ states[1].reshape(-1, h).T
        x += self.shift[:, None]
        np.exp(x, out=x)
        total = x[0].copy()
        for row in x[1:]:
            total += row
        x /= total
        return x.reshape(-1, t, n)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        states, steps = self.forward(windows, keep=True)
        n, t = windows.shape
        p = self._softmax(states).transpose(1, 2, 0).copy()
        loss = -float(np.log(p[:, np.arange(n), target] + 1e-9).mean())
        p[:, np.arange(n), target] -= 1
        p /= n * t
        grads = [np.zeros_like(x) for x in self.arrays]
        d_table, d_inner, d_bias, d_out, _ = grads
        for d in (0, 1):
            d_out[d] = np.einsum("tnh,tnk->hk", states[d], p)
            d_state = p @ self.out[d].T
            carry = np.zeros_like(d_state[0])
            for i in reversed(range(t)):
                before, r, z, c, c_in, byte = steps[d * t + i]
                dh = carry + d_state[i if d == 0 else t - 1 - i]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (before - c) * z * (1 - z)
                dr = dc * c_in * r * (1 - r)
                d_in = np.concatenate((dr, dz, dc * r), axis=-1)
                carry = dh * z + d_in @ self.inner[d].T
                d_inner[d] += before.T @ d_in
                d_bias[d] += (dc * r).sum(axis=0)
                np.add.at(d_table[d], byte, np.concatenate((dr, dz, dc), axis=-1))
        grads[4] = p.sum(axis=(0, 1))
        return loss, grads


def fresh(labels: list[str], hidden: int, seed: int) -> ByteGRU:
    rng = np.random.default_rng(seed)
    k = len(labels)
    make = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return ByteGRU(labels, make(2, 256, 3 * hidden), make(2, hidden, 3 * hidden), np.zeros((2, hidden), np.float32), make(2, hidden, k), np.zeros(k, np.float32))


def train(texts: list[bytes], labels: list[str], hidden: int = 6, window: int = 64, batch: int = 128, steps: int = 300, rate: float = 0.02, seed: int = 7) -> ByteGRU:
    """Fits the network by Adam on random windows of the texts, each language as often as any other."""
    names = sorted(set(labels))
    model = fresh(names, hidden, seed)
    if len(names) < 2:
        return model
    rng = np.random.default_rng(seed)
    groups = [[t for t, x in zip(texts, labels, strict=True) if x == name] for name in names]
    first = [np.zeros_like(x) for x in model.arrays]
    second = [np.zeros_like(x) for x in model.arrays]
    for step in range(1, steps + 1):
        target = rng.integers(0, len(names), batch)
        rows = np.full((batch, window), 32, np.uint8)
        for i, k in enumerate(target):
            text = groups[k][rng.integers(len(groups[k]))]
            at = int(rng.integers(0, max(1, len(text) - window + 1)))
            part = np.frombuffer(text[at : at + window], np.uint8)
            rows[i, : len(part)] = part
        _, grads = model.gradients(rows, target)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for x, g, m, v in zip(model.arrays, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def training_texts(df: DataFrame, where: Column, per_label: int = 300, most_chars: int = 20_000_000, text_col: str = "text", label_col: str = "lang") -> tuple[list[bytes], list[str]]:
    """A bounded sample of labelled rows: whole texts and their labels, in order of label and hash.

    Bounds: per_label rows a label, and fewer of a label if its drawn texts have more than an equal share of most_chars
    characters; drawn by a hash of the text. Labels are counted first so that rare ones are sampled as well as common
    ones. Exact copies within a label count once; the first
    text of a label stays, however long. Null labels, and null or blank texts, teach nothing.
    """
    good = df.where(where & F.col(label_col).isNotNull() & (F.length(F.trim(text_col)) > 0)).select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    counts = {r["label"]: r["count"] for r in good.groupBy("label").count().collect()}
    if not counts:
        return [], []
    u = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.5 * per_label / n))])
    rows = written(good.where(u < share[F.col("label")]).distinct().select("label", "text", (u / share[F.col("label")]).alias("u")))
    sizes = rows.groupBy("label").agg(F.sum(F.length("text")).alias("chars"), F.min("u").alias("first")).collect()
    if not sizes:
        return [], []
    # the first text of a label stays, however long
    room = F.create_map(*[F.lit(x) for r in sizes for x in (r["label"], max(most_chars / len(sizes) / r["chars"], r["first"] + 1e-12))])
    drawn = rows.where(F.col("u") < room[F.col("label")]).select("label", "text").orderBy("label", F.xxhash64("text"), "text").collect()
    texts, labels, seen = [], [], {}
    for r in drawn:
        seen[r["label"]] = seen.get(r["label"], 0) + 1
        if seen[r["label"]] <= per_label:
            texts.append(r["text"].encode())
            labels.append(r["label"])
    return texts, labels


def pooled(model: ByteGRU, column: pa.Array, window: int = 128, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Mean probabilities (texts, k) over all bytes of each text, and the share of its positions labelled k."""
    data = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    n, k = len(data), len(model.labels)
    size = np.array([len(x) for x in data], np.int64)
    # texts shorter than a window are filled up with spaces
    room = np.maximum(size, window)
    start = np.concatenate(([0], np.cumsum(room)))
    flat = np.frombuffer(b"".join([x if len(x) >= window else x.ljust(window) for x in data]), np.uint8)
    count = np.where(size > 0, -(-size // window), 0)
    owner = np.repeat(np.arange(n), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(number * window, (room - window)[owner])
    fresh_from = number * window - at  # positions before it were in the window before
    to = np.minimum(size[owner] - at, window)
    total, hits = np.zeros((n, k)), np.zeros((n, k))
    places = np.arange(window)
    for i in range(0, len(owner), block):
        o = owner[i : i + block]
        rows = flat[(start[o] + at[i : i + block])[:, None] + places]
        p = model.probabilities(rows)
        live = (places[:, None] >= fresh_from[i : i + block]) & (places[:, None] < to[i : i + block])
        best = p[0].copy()
        for row in p[1:]:
            np.maximum(best, row, out=best)
        for j in range(k):
            np.add.at(hits[:, j], o, ((p[j] >= best) & live).sum(axis=0))
            p[j] *= live
            np.add.at(total[:, j], o, p[j].sum(axis=0))
    return total / np.maximum(size, 1)[:, None], hits / np.maximum(size, 1)[:, None]


def identify(df: DataFrame, model: ByteGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and share (of positions so labelled) of every row.

    A null text or one without a letter gets `und`, score 0 and share 0, as does every text if no label was learned.
    Equal probabilities go to the first label in order. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 4 << 20):
            yield pa.record_batch([b.column(0), *predict(model, b.column(1))], names=["doc_id", "lang_pred", "score", "share"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, share double")


def predict(model: ByteGRU, column: pa.Array) -> list[pa.Array]:
    """Label, probability and share of each text."""
    texts = column.to_pylist()
    ok = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool) & bool(model.labels)
    if model.labels:
        p, share = pooled(model, column)
        best, at = p.argmax(axis=1), np.arange(len(p))
        names, score, part = np.array(model.labels, object)[best], p[at, best], share[at, best]
    else:
        names, score, part = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts))
    return [pa.array(np.where(ok, names, UNDETERMINED).tolist(), pa.string()), pa.array(np.where(ok, np.clip(score, 0, 1), 0.0)), pa.array(np.where(ok, part, 0.0))]


def is_accepted(model: ByteGRU, least: float = 0.3, text_col: str = "text") -> Column:
    """Whether a text has a language, of this probability at least; computed beside the row, without a join."""

    @F.arrow_udf("boolean")
    def accepted(column: pa.Array) -> pa.Array:
        parts = []
        for b in pieces(iter([pa.record_batch([column], names=["text"])]), "text", 4 << 20):
            names, score, _ = predict(model, b.column(0))
            parts.append(pc.and_(pc.not_equal(names, UNDETERMINED), pc.greater_equal(score, least)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())

    return accepted(F.col(text_col).cast("string"))
