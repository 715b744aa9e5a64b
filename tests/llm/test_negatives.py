import numpy as np
import pandas as pd
import pytest

from barloom.llm import negatives as N
from barloom.llm.queries import op12_hard_negatives
from oracle import check, connection

SCHEMA = "vec_id long, label int, embedding array<double>, score string"


def brute(data, every=100, scale=256):
    """All pairs with Python integers."""
    rows = sorted({(i, c, tuple(int(np.floor(scale * x)) for x in v)) for i, c, v in data})
    out = []
    for a, c, v in rows:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, d == c) for i, d, w in rows if i != a]
        for p, i, _ in sorted(x for x in scored if x[2])[:5]:
            fit = sorted((s, j) for s, j, same in scored if not same and 80 * -p <= 100 * -s <= 100 * -p)[:5]
            out += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(fit, start=1)]
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame([(i, c, v, "clash") for i, c, v in data], SCHEMA)


def clustered(rng, n, dim=6, labels=4):
    centers = rng.normal(size=(5, dim))
    x = centers[rng.integers(0, 5, n)] + rng.normal(scale=0.15, size=(n, dim))
    return [(i, int(rng.integers(labels)), row.tolist()) for i, row in enumerate(x)]


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.01"
    assert check(op12_hard_negatives(spark, path), connection(path), N.hard_negatives_sql()) > 0


@pytest.mark.parametrize(("part", "chunk", "references"), [(4096, 8192, 16), (40, 3, 8), (7, 2, 1)])
def test_equals_brute_force_however_it_is_cut(spark, part, chunk, references):
    data = clustered(np.random.default_rng(1), 600)
    got = N.hard_negatives(frame(spark, data), every=30, part=part, chunk=chunk, most_references=references).collect()
    assert sorted(map(tuple, got)) == brute(data, 30) and len(got) > 100


def test_ties_copies_zeros_nulls_and_large_numbers(spark):
    rng = np.random.default_rng(2)
    data = clustered(rng, 120, 3, 2) + [(1000 + k, k % 2, [1.0, 2.0, 3.0]) for k in range(60)] + [(2000 + k, k % 2, [0.0, 0.0, 0.0]) for k in range(20)] + [(3000, 0, [-1.0, 0.5, 0.0]), (3100, 1, [5.0])]
    bad = [(None, 1, [1.0, 2.0, 3.0]), (4000, None, [1.0, 2.0, 3.0]), (4100, 1, None), (4200, 1, [1.0, None, 2.0]), (4300, 0, [float("nan"), 1.0, 1.0]), (4400, 0, [float("inf"), 1.0, 1.0])]
    full = [(i, c, (v + [0.0, 0.0])[:3]) for i, c, v in data]
    got = N.hard_negatives(frame(spark, data + bad + data[:30]), every=10, part=50, chunk=5).collect()
    assert sorted(map(tuple, got)) == brute(full, 10)
    big = [(k, k % 2, [float(rng.integers(1 << 17, 1 << 21)) for _ in range(8)]) for k in range(60)]
    assert sorted(map(tuple, N.hard_negatives(frame(spark, big), every=10, part=20).collect())) == brute(big, 10) != []
    assert N.hard_negatives(frame(spark, [])).count() == 0 and N.hard_negatives(frame(spark, data[:1])).count() == 0
    with pytest.raises(Exception, match="beyond 64 bits"):
        N.hard_negatives(frame(spark, [(0, 1, [1e15, 1.0]), (1, 1, [1e15, 2.0]), (2, 0, [1.0, 1.0])])).count()
    with pytest.raises(Exception, match="too large"):
        N.hard_negatives(frame(spark, [(0, 1, [1e307])])).count()


def block(data, references):
    v = np.floor(256 * np.array([x for _, _, x in data]))
    norm, theta = N.angles(v, references)
    return N.Block(pd.DataFrame({"vec_id": [i for i, _, _ in data], "label": [c for _, c, _ in data], "vec": [x.tobytes() for x in v], "norm": norm, "angles": [x.tobytes() for x in theta]}), v.shape[1])


def test_bounds_hold_and_exclude_most_of_what_lies_in_clusters():
    rng = np.random.default_rng(3)
    data = clustered(rng, 800) + [(900, 0, [0.0] * 6)] + [(901 + k, 0, (np.ones(6) * (k + 1)).tolist()) for k in range(5)]
    references = N.norms_and_units(rng.normal(size=(16, 6)))[1]
    b = block(data, references)
    low, high = b.bounds(b, slice(None))
    scores = b.vectors @ b.vectors.T
    assert (low <= scores).all() and (scores <= high).all()
    top = np.sort(scores[:800, :800], axis=1)[:, -6][:, None]
    asked = (high[:800, :800] >= 0.8 * top) & (low[:800, :800] <= top)
    assert asked.mean() < 0.6, asked.mean()


def test_bounds_of_nearly_parallel_vectors_are_safe():
    base = np.random.default_rng(4).normal(size=8) * 1000
    data = [(k, 0, (base * (1 + k / 7)).tolist()) for k in range(50)] + [(100 + k, 0, (-base * (1 + k / 9)).tolist()) for k in range(50)]
    b = block(data, N.norms_and_units(np.stack((base, -base, np.roll(base, 1))))[1])
    low, high = b.bounds(b, slice(None))
    exact = np.array([[float(sum(int(x) * int(y) for x, y in zip(v, w))) for w in b.vectors] for v in b.vectors])
    assert (low <= exact).all() and (exact <= high).all()
