import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import language as L
from barloom.llm.common import held


def test_gradients_match_differences():
    model = L.fresh(["a", "b", "c"], 3, 1)
    for name in ("table", "inner", "bias", "out", "shift"):
        setattr(model, name, getattr(model, name).astype(float) + 0.05)
    rows = np.random.default_rng(0).integers(0, 256, (4, 7)).astype(np.uint8)
    target = np.array([0, 1, 2, 1])
    _, grads = model.gradients(rows, target)
    for x, g in zip(model.arrays, grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, sides = x[at], []
        for step in (1e-3, -1e-3):
            x[at] = old + step
            sides.append(model.gradients(rows, target)[0])
        x[at] = old
        assert abs((sides[0] - sides[1]) / 2e-3 - g[at]) < 1e-6


def plain(model, window):
    """The network on one window, position by position."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h = model.inner.shape[1]
    states = []
    for d, order in ((0, range(len(window))), (1, reversed(range(len(window))))):
        state, seen = np.zeros(h), {}
        for i in order:
            x, u = model.table[d, window[i]], state @ model.inner[d]
            r, z = sigmoid(x[:h] + u[:h]), sigmoid(x[h : 2 * h] + u[h : 2 * h])
            c = np.tanh(x[2 * h :] + r * (u[2 * h :] + model.bias[d]))
            state = c + z * (state - c)
            seen[i] = state
        states.append(np.array([seen[i] for i in range(len(window))]))
    e = np.exp(states[0] @ model.out[0] + states[1] @ model.out[1] + model.shift)
    return e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("n", [1, 9, 10, 11, 25, 30])
def test_every_byte_counts_once(n):
    model = L.fresh(["a", "b", "c"], 4, 3)
    text = bytes(np.random.default_rng(n).integers(65, 90, n, dtype=np.uint8))
    if n < 10:
        want = plain(model, text.ljust(10))[:n].mean(axis=0)
    else:
        full = [plain(model, text[i : i + 10]) for i in range(0, n - 9, 10)]
        rest = n % 10
        want = np.concatenate([*full, *([plain(model, text[-10:])[10 - rest :]] if rest else [])]).mean(axis=0)
    got, share = L.pooled(model, pa.array(["", text.decode(), None, "x"]), window=10, block=2)
    assert np.allclose(got[1], want, atol=1e-5) and abs(share[1].sum() - 1) < 1e-9 and not got[0].any() and not got[2].any()


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts, labels = L.training_texts(docs, ~held("doc_id", 5, 0), per_label=120)
    assert all(labels.count(x) <= 120 for x in set(labels)) and {x.decode() for x in texts} <= {r["text"] for r in docs.collect()}
    few, names = L.training_texts(docs, ~held("doc_id", 5, 0), per_label=120, most_chars=200_000)
    assert set(names) == set(labels) and sum(len(x.decode()) for x in few) < 300_000 < sum(map(len, texts))
    model = L.train(texts, labels)
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 +- 3 \n"), (-4, "x"), (-4, "x"), (None, "the " * 50000)], "doc_id long, text string")
    got = L.identify(docs.select("doc_id", "text").union(extra).withColumn("score", F.lit("clash")), model).toPandas()
    edge = got[~(got.doc_id >= 0)].sort_values("doc_id")
    assert list(edge.lang_pred[:5]) == [edge.lang_pred.iloc[0], edge.lang_pred.iloc[0], "und", "und", "und"] and edge.lang_pred.iloc[0] != "und"
    assert got.score.between(0, 1).all() and len(got) == docs.count() + 6
    both = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    both = both[[zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in both.doc_id]]
    assert (both.lang == both.lang_pred).mean() > 0.97


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = L.train(*L.training_texts(docs, ~held("doc_id", 5, 0)))
    assert L.identify(docs, model).first()["lang_pred"] == "und"
    assert L.identify(docs.limit(0), model).count() == 0
