import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from barloom.llm import simhash as S
from barloom.llm.graph import components


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def linked(prints, budget=2):
    """The least id that chains of fingerprints within the budget reach, by all pairs."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ v) <= budget):
            a, b = find(ids[k]), find(ids[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_xxh64_of_spans():
    rng = np.random.default_rng(1)
    data = bytes(rng.integers(32, 120, 5000, dtype=np.uint8))
    begin = rng.integers(0, 4900, 400)
    end = begin + rng.integers(0, 100, 400)
    assert [int(x) for x in S.xxh64(data, begin, end)] == [xxhash.xxh64_intdigest(data[i:j], 42) for i, j in zip(begin, end)]


@pytest.mark.parametrize("n", [2, 50, 600])
def test_trie_join_finds_each_pair_once(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 1 << 64, max(1, n // 5), dtype=np.uint64)
    value = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)) for _ in range(5)]))
    zero, size = np.array([0]), np.array([len(value)])
    a, b = S.trie_links(value, zero, size, zero, size, zero, zero)
    pairs = [(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())]
    want = {(i, j) for i in range(len(value)) for j in range(i + 1, len(value)) if (int(value[i]) ^ int(value[j])).bit_count() <= 2}
    assert set(pairs) == want and len(pairs) == len(want)


@pytest.mark.parametrize("leaf", [50_000, 5])
def test_groups_equal_brute_force(spark, leaf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = [(10_000_001, None), (10_000_002, " \n"), (10_000_003, "Two words"), (10_000_004, "two WORDS"), (10_000_005, "a b " * 40_000), (10_000_006, ""), (10_000_003, "Two words")]
    table = docs.union(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1))
    got = S.simhash_groups(table, leaf=leaf).collect()
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in table.collect()}
    want = linked(prints)
    assert len(got) == table.count()
    assert all((r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]]) for r in got)


def test_a_crowded_start_node_is_split(spark):
    rng = random.Random(5)
    center = rng.getrandbits(64)
    values = {center} | {center ^ 1 << i for i in range(64)} | {center ^ 1 << i ^ 1 << j ^ 1 << k for i in range(0, 40, 4) for j in range(1, 40, 5) for k in range(2, 40, 7)}
    prints = {i: v for i, v in enumerate(sorted(values))}
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in prints.items()]
    links = S.near_links(spark.createDataFrame(rows, "fp long, rep long"), leaf=20)
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert {i: got.get(i, i) for i in prints} == linked(prints)


def test_components_of_random_links(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(0, i) for i in range(1, 60)] + [(300 + i, 301 + i) for i in range(30)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    label = {x: x for e in links for x in e}
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in links)}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_groups(empty).count() == 0 and S.one_of_each(empty).count() == 0
    rows = spark.createDataFrame([(None, "same text here"), (7, "same text here"), (4, "same text here"), (4, "same text here")], "doc_id long, text string")
    assert sorted(map(str, S.simhash_groups(rows).select("doc_id", "component_id").collect())) == sorted(map(str, [r for r in spark.createDataFrame([(None, 4), (7, 4), (4, 4), (4, 4)], "doc_id long, component_id long").collect()]))
    assert [r["doc_id"] for r in S.one_of_each(rows).where("doc_id is not null").collect()] == [4, 4]
    with pytest.raises(ValueError):
        S.near_links(rows, budget=3)
