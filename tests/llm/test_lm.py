import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from barloom.llm import lm
from test_common import made_up, twins


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(train, asked):
    """Modified Kneser-Ney trigrams and the add-one base with plain dictionaries."""
    triples, count, raw = Counter(), Counter(), Counter()
    for text in train:
        seq = ["<s>", "<s>", *words(text), "</s>"]
        triples.update(zip(seq, seq[1:], seq[2:]))
        count.update(seq[2:])
        raw.update(zip(seq[1:], seq[2:]))
    pairs = Counter((v, w) for _, v, w in triples)
    pairs.update({k: raw[k] - pairs[k] for k in pairs if k[0] == "<s>"})
    left = Counter(w for _, w in pairs)
    d3, d2, d1 = (lm.discounts(*(sum(c == k for c in x.values()) for k in (1, 2, 3, 4))) for x in (triples, pairs, left))
    total, spare = Counter(), defaultdict(float)
    for level, d in ((triples, d3), (pairs, d2)):
        for key, c in level.items():
            total[key[:-1]] += c
            spare[key[:-1]] += d[min(c, 3)]
    lefts, types, n = sum(left.values()), len(left), sum(count.values())
    back = sum(d1[min(c, 3)] for c in left.values()) / lefts
    out = []
    for text in asked:
        seq = ["<s>", "<s>", *words(text), "</s>"]
        score = base = 0
        for u, v, w in zip(seq, seq[1:], seq[2:]):
            p = (left[w] - d1[min(left[w], 3)]) / lefts + back / (types + 1)
            for key, level, d in (((v, w), pairs, d2), ((u, v, w), triples, d3)):
                if t := total[key[:-1]]:
                    p = (level[key] - d[min(level[key], 3)]) / t + spare[key[:-1]] / t * p
            score += math.log10(p)
            base += math.log10((count[w] + 1) / (n + types + 1))
        out.append((len(seq) - 2, sum(count[w] > 0 for w in seq[2:]), n, base, score))
    return out


@pytest.mark.parametrize("range_bytes", [32 << 20, 5_000])  # the small one splits frequent words
def test_scores_equal_brute_force(spark, range_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(900001, None), (900002, ""), (900003, "The THE the\tthe"), (900003, "The THE the\tthe"), (None, "of " * 9000), (900004, " ".join(twins())), (900005, twins()[0]), *((900010 + 2 * k + j, w) for k, pair in enumerate(made_up(4)) for j, w in enumerate(pair))], "doc_id long, text string")
    rows = docs.union(extra).collect()
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    want = Counter((i, *(round(x, 6) for x in y)) for (i, _), y in zip(rows, brute(train, [t for _, t in rows])))
    all_rows = docs.union(extra).withColumn("score", F.lit("clash")).repartition(3)
    from barloom.llm.common import held

    model = lm.count_model(all_rows.where(~held("doc_id", 7, 2)), most=5000, range_bytes=range_bytes)
    assert (len(model.split.words) > 3) == (range_bytes < 1 << 20)
    got = Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in lm.score_texts(all_rows, model).drop("perplexity").collect())
    assert got == want


def test_probabilities_sum_to_one(spark):
    import numpy as np

    df = spark.createDataFrame([("a b a c a b",), ("b a",), (None,)], "text string")
    model = lm.count_model(df)
    import pyarrow as pa

    token = lm.tokens(pa.array(["a b c", "zzz"]), model.key)[0]
    vocabulary = np.unique(token)
    for before in (token[0], token[1], lm.BEGIN, np.uint64(12345)):
        for twice in (token[0], token[2], lm.BEGIN, np.uint64(12345)):
            p = 10 ** lm.log_probabilities(model, vocabulary, *(np.full(len(vocabulary), x) for x in (before, twice)))[0]
            assert abs(p.sum() - 1) < 1e-9  # the five known types' mass and that of one unknown word


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_texts(df, lm.count_model(df)).count() == 0


def test_discounts_without_counts():
    assert list(lm.discounts(0, 0, 0, 0)) == [0, 0.5, 1.0, 1.5]
    with pytest.raises(ValueError):
        lm.KneserNey("x", 1, None, {})


def test_contexts_are_looked_up_once(spark, monkeypatch):
    """Rows of one context share its search and its totals: what is asked of the model's files does not follow the followers."""
    import numpy as np
    import pyarrow as pa

    text = " ".join(f"a b w{k}" for k in range(500))
    model = lm.count_model(spark.createDataFrame([(text,)], "text string"))
    asked, find = [], lm._find_within
    monkeypatch.setattr(lm, "_find_within", lambda *args: asked.append(len(args[3])) or find(*args))
    token = lm.tokens(pa.array(["a b"]), model.key)[0]
    words = lm.tokens(pa.array([" ".join(f"w{k}" for k in range(500))]), model.key)[0]
    p = 10 ** lm.log_probabilities(model, words, *(np.full(len(words), token[k]) for k in (1, 0)))[0]
    assert np.ptp(p[:500]) < 1e-12 and p[500] < p[0]  # 500 followers, equally often; the end does not follow
    ranges = len(asked) // 3  # in each: pairs, contexts, followers
    assert sum(asked) == 2 * len(words) + ranges


@pytest.mark.parametrize("n", [50, 5 << 20])  # rows of three of the large numbers are wider than 64 bits
def test_distinct_rows_and_counts(n):
    import numpy as np

    columns = [np.random.default_rng(k).choice([0, 1, 7, n - 2, n - 1], 2000) for k in range(3)]
    want, count = np.unique(np.array(columns), axis=1, return_counts=True)
    for found, often in (lm._counted(n, *columns), (lambda x, order, cut: (x, np.diff(np.append(cut, len(order)))))(*lm._distinct(n, *columns))):
        assert np.array_equal(np.array(found), want) and np.array_equal(often, count)
    values, at = lm.numbered(columns[0].astype(np.uint64))
    assert np.array_equal(values, np.unique(columns[0])) and np.array_equal(values[at], columns[0])
    for low, high in ((0, 0), (0, 5), (2, 4)):
        at, found = lm._find_within(values, *(np.full(6, x) for x in (low, high)), np.append(values, lm.NONE).astype(np.uint32))
        assert found.tolist() == [low <= k < high for k in range(5)] + [False] and np.array_equal(at[found], np.flatnonzero(found))
