import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import toxicity as X
from barloom.llm.common import held


def hashed(gram, bits):
    h = 0
    for b in gram:
        h = ((h ^ b) * 0x01000193 + 0x9E3779B9) % 2**32
    h = ((h ^ h >> 15) * 0x85EBCA6B) % 2**32
    return h >> (32 - bits)


def test_features_are_the_byte_ngrams_of_each_text():
    texts = ["Abc DEF\tgh", "", None, "ab", "ünïcode ünïcode"]
    row, col = X.present(pa.array(texts), 16)
    want = set()
    for i, t in enumerate(texts):
        raw = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in (t or "").encode())
        want |= {(i, hashed(raw[k : k + n], 16)) for n in X.SIZES for k in range(len(raw) - n + 1)}
    assert sorted(zip(row.tolist(), col.tolist())) == sorted(want)


def test_score_is_the_sum_of_present_features(spark):
    rng = np.random.default_rng(0)
    model = X.NgramModel(12, np.where(rng.random(1 << 12) < 0.3, rng.standard_normal(1 << 12), 0).astype(np.float32), -1.0)
    texts = ["hello hello hello", "", None, "x", "Some Words", "Some Words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in X.score(df, model).collect()}
    for i, t in enumerate(texts):
        row, col = X.present(pa.array([t], pa.string()), 12)
        p = 1 / (1 + np.exp(1.0 - model.weight[col].astype(float).sum()))
        assert abs(got[i]["score"] - p) < 1e-6 and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    texts, toxic, weight = X.training_rows(docs, labels, ~held("doc_id", 4, 2), per_class=1500)
    assert len(texts) <= 3300
    model = X.fit(texts, toxic, weight)
    some = docs.join(labels.where(held("doc_id", 4, 2)), "doc_id").limit(600)
    got = X.score(some, model).toPandas().merge(labels.toPandas(), on="doc_id")
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id)
    right = (got.predicted == got.toxic).mean()
    assert right > 0.95, right
    assert got.score.between(0, 1).all()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = X.fit(*X.training_rows(docs, labels, ~held("doc_id", 4, 2)))
    assert X.score(docs, model).first()["predicted"] in (0, 1)
    assert X.score(docs.limit(0), model).count() == 0
    assert X.fit(["a", "b"], np.array([1, 1])).intercept > 0


def test_fit_equals_a_dense_version():
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "nasty", "vile", "kind", "warm"]
    toxic = rng.random(60) < 0.4
    texts = [" ".join(rng.choice(words[4:6] if t and rng.random() < 0.8 else words[:4] + words[6:], 8)) for t in toxic]
    weight = np.where(toxic, 1.0, 3.0)
    model = X.fit(texts, toxic, weight, bits=12, keep=40, steps=60)
    has = np.zeros((60, 1 << 12), bool)
    for i, t in enumerate(texts):
        for n in X.SIZES:
            for k in range(len(t) - n + 1):
                has[i, hashed(t[k : k + n].encode(), 12)] = True
    n1, n0 = toxic.sum(), (~toxic).sum()
    c1, c0 = has[toxic].sum(axis=0), has[~toxic].sum(axis=0)
    ratio = np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))
    p = (c1 + c0) / 60
    z = np.where(c1 + c0 >= 4, (c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12), 0)
    kept = np.sort(np.argsort(-np.abs(z), kind="stable")[:40])
    kept = kept[z[kept] != 0]
    x, share = has[:, kept] * ratio[kept], weight / weight.sum()
    prior = ((weight * toxic).sum() + 0.5) / (weight.sum() + 1)
    w, b = np.zeros(len(kept)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for k in range(1, 61):
        wrong = (1 / (1 + np.exp(-(b + x @ w))) - toxic) * share
        g = np.append(x.T @ wrong + 1e-3 * w, wrong.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    want = np.zeros(1 << 12)
    want[kept] = w * ratio[kept]
    assert np.abs(model.weight - want).max() < 1e-4 and abs(model.intercept - b) < 1e-6


def test_long_texts_count_whole_and_conflicts_are_toxic(spark):
    long = "calm words only " * 2000 + "vile nasty end"
    docs = spark.createDataFrame([(i, long if i % 2 else "calm words only " * 5) for i in range(1, 41)] + [(1, long)], "doc_id long, text string").withColumn("toxic", F.lit("clash")).withColumn("u", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)] + [(1, 0), (2, None)], "doc_id long, toxic int")
    texts, toxic, weight = X.training_rows(docs, labels, F.lit(True))
    assert dict(zip(texts, toxic.tolist())) == {long: True, "calm words only " * 5: False} and weight.tolist() == [20.0, 20.0]
    few, _, _ = X.training_rows(docs, labels, F.lit(True), most_chars=100_000)
    assert all(t in texts for t in few)
    model = X.fit(*X.training_rows(docs.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string"))), labels, F.lit(True)))
    p = X.probabilities(model, pa.array([long, "calm words only " * 9000, "vile nasty end", None]))
    assert p[0] > 0.5 and p[2] > 0.5 > p[1]
