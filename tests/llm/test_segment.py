import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from barloom.llm import segment as S
from test_common import twins

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tiny():
    """A small vocabulary, so that all segmentations can be listed."""
    surface = [b" ", b"a", b"b", b" a", b"ab", b"ba", b"aba", b" ab", b"bb"]
    return S.Vocabulary(surface, np.arange(300, 300 + len(surface)), -np.log(np.arange(2.0, 2.0 + len(surface))), np.arange(256), -5.0)


def listed(v, text):
    """Every segmentation of the text with its probability, by recursion."""
    piece = {x: (int(i), float(s)) for x, i, s in zip(v.surface, v.ids, v.score)}
    chain = b" " + text.encode()

    def go(i):
        if i == len(chain):
            return [((), 0.0)]
        out = [((k,) + rest, s + t) for x, (k, s) in piece.items() if chain.startswith(x, i) for rest, t in go(i + len(x))]
        n = next(n for n in (1, 2, 3, 4) if i + n == len(chain) or chain[i + n] & 0xC0 != 0x80)
        if chain[i : i + n] not in piece:
            out += [(tuple(chain[i : i + n]) + rest, v.byte_score * n + t) for rest, t in go(i + n)]
        return out

    every = go(0)
    z = math.log(sum(math.exp(s) for _, s in every))
    return {ids: s - z for ids, s in every}


def drawn(v, text, keys, k):
    """For each key the draws, best first, with log probability and perturbed value, and the threshold."""
    *draws, (rest,) = list(S.sample(v, pa.array([text] * len(keys), pa.string()), keys, k, 1))
    out = [[] for _ in keys]
    for live, logp, value, at, ids in draws:
        for j, d in enumerate(live.tolist()):
            out[d].append((tuple(ids[at[d] : at[d + 1]].tolist()), logp[j], value[j]))
    return out, rest


@pytest.mark.parametrize("text", ["a", "ab", "abab", "ab ba", "aé", "a\nb", "  ba"])
def test_draws_are_distinct_segmentations_in_order(tiny, text):
    want = listed(tiny, text)
    got, rest = drawn(tiny, text, np.arange(40, dtype=np.uint64), 5)
    for one, threshold in zip(got, rest):
        ids = [x[0] for x in one]
        assert len(set(ids)) == len(ids) == min(5, len(want)) and set(ids) <= set(want)
        assert all(abs(p - want[i]) < 1e-9 for i, p, _ in one)
        values = [x[2] for x in one]
        assert values == sorted(values, reverse=True) and threshold <= values[-1]
        assert (threshold == -np.inf) == (len(want) <= 5)
        assert all(tiny.decode(np.array(i)) == text.encode() for i in ids)


def test_frequencies_are_those_of_sampling_without_replacement(tiny):
    want = listed(tiny, "aba")
    n = 30_000
    got, _ = drawn(tiny, "aba", np.arange(n, dtype=np.uint64), 2)
    first, pair = Counter(x[0][0] for x in got), Counter((x[0][0], x[1][0]) for x in got)
    for a, p in want.items():
        assert abs(first[a] / n - math.exp(p)) < 4 * math.sqrt(0.25 / n)
        for b, q in want.items():
            if a != b:
                assert abs(pair[a, b] / n - math.exp(p) * math.exp(q) / (1 - math.exp(p))) < 4 * math.sqrt(0.25 / n)
    best = np.array([x[0][2] for x in got])
    assert abs(best.mean() - 0.5772) < 0.03  # the largest value is a standard Gumbel


def test_query_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    texts = [None, "", " ", "same text", "same text", "日本語 ▁ \u0001\n\n tab\t ünï 🎉", "x" * 3000, "long words " * 9000, " ".join(twins())]
    ids = [-1, -2, -3, -4, -4, -5, None, -6, -7]
    extra = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = S.segmentations(docs.union(extra), MODEL, 3, with_ids=True).collect()
    again = S.segmentations(docs.union(extra).repartition(7), MODEL, 3).collect()
    close = lambda rows: sorted(str([f"{x:.6f}" if isinstance(x, float) else x for x in r[:8]]) for r in rows)
    assert close(got) == close(again)
    assert all(r["round_trip"] and r["log_inclusion"] <= 0 and r["log_prob"] <= 0 and len(r["ids"]) == r["n_pieces"] for r in got)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    by = Counter(r["doc_id"] for r in got)
    assert by[-1] == by[-2] == 1 and by[-4] == 6 and by[-5] == 3 and by[None] == 3
    assert len({(r["doc_id"], tuple(r["ids"])) for r in got if r["doc_id"] == -6}) == 3
    assert S.segmentations(docs.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        S.segmentations(docs, MODEL, 0)


def test_copies_of_a_row_draw_anew(spark):
    import public_tokenizers
    from pyspark.sql import functions as F

    text = "the quick brown foxes were jumping over unbelievably lazy dogs in the international neighbourhood " * 3
    rows = [(1, text, c) for c in (1, 2, 3)] + [(2, text, 1), (None, text, 1), (None, text, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {(r["doc_id"], r["copy"], r["rank"]): r["ids_crc32"] for r in S.segmentations(df, path, copy_col="n").collect()}
    plain = {(r["doc_id"], r["rank"]): r["ids_crc32"] for r in S.segmentations(df.where("n = 1"), path).collect()}
    assert all(got[i, 1, rank] == x for (i, rank), x in plain.items())  # the first copy draws as ever
    assert len({got[1, c, 1] for c in (1, 2, 3)}) == 3 and got[None, 1, 1] != got[None, 2, 1]
    assert S.segmentations(df.limit(0).withColumn("copy", F.lit(1)), path, copy_col="copy").count() == 0
