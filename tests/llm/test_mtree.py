import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import mtree as M


def brute(ids, x, k):
    v = np.floor(64 * x.astype(float)).astype(np.int64)
    out = []
    for q in range(len(ids)):
        if ids[q] % 20 == 0:
            rows = sorted((-int(v[q] @ v[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != ids[q])[:k]
            out += [(int(ids[q]), r, i, -s) for r, (s, i) in enumerate(rows, start=1)]
    return sorted(out)


def test_tree_equals_brute_force_and_saves_distances():
    rng = np.random.default_rng(1)
    x = np.rint(np.repeat(rng.normal(0, 40, (30, 8)), 50, axis=0) + rng.normal(0, 2, (1500, 8)))
    x = np.unique(x, axis=0)
    m = float((x * x).sum(axis=1).max())
    tree = M.MTree(M.lifted(x, m), page=16)
    ids = [np.array([i]) for i in range(len(x))]
    for q in x[::100]:
        got = tree.search(np.append(q, 0.0), m, 7, -np.inf, ids)
        assert got == sorted(((float(x[j] @ q), j) for j in range(len(x))), key=lambda e: (-e[0], e[1]))[:7]
    assert tree.computed < 0.8 * len(x) * len(x[::100])


def test_query_equals_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = M.top_inner_products(df.withColumn("score", F.lit("clash")), part=60, block=7).collect()
    assert sorted(map(tuple, got)) == brute(ids, x, 20)


def test_query_equals_sql(spark):
    from barloom.llm.queries import op7_mtree
    from oracle import check, connection

    path = "/root/testdata/sf0.01"
    assert check(op7_mtree(spark, path), connection(path), M.top_inner_products_sql()) == 500


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((np.tile(rng.normal(size=(1, 4)), (90, 1)), np.round(rng.normal(size=(60, 4)))))
    ids = np.arange(150) * 2
    data = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x)]
    bad = [(1000, None), (1020, [1.0, None, 2.0, 3.0]), (1040, [float("nan")] * 4), (1060, [float("inf")] * 4), (None, [9.0] * 4), data[0], data[100]]
    df = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>")
    got = M.top_inner_products(df, part=20, block=3).collect()
    assert sorted(map(tuple, got)) == brute(ids, x, 20)
    few = spark.createDataFrame(data[:3], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, M.top_inner_products(few).collect())) == brute(ids[:3], x[:3], 20)
    assert M.top_inner_products(df.limit(0)).count() == 0


def exact(data, k, scale=64):
    """All pairs with Python integers."""
    v = {i: [int(np.floor(scale * c)) for c in x] for i, x in data}
    out = []
    for q in v:
        if q % 20 == 0:
            rows = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(rows, start=1)]
    return sorted(out)


def test_large_numbers_are_neither_dropped_nor_rounded(spark):
    rng = np.random.default_rng(3)
    small = [(i, rng.normal(size=2).tolist()) for i in range(40)]
    data = [*small, (100, [4e7, 1.0]), (101, [-4e7, 3.0]), (120, [4e7, 1.015625])]
    assert sorted(map(tuple, M.top_inner_products(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=5).collect())) == exact(data, 5)
    # sums beyond 2**53 that differ in their last bits only
    close = [(i, (rng.integers(1 << 20, 1 << 24, 16) / 64 * 16).tolist()) for i in range(200)]
    close += [(200 + i, [c + (j == i % 16) / 64 for j, c in enumerate(close[i][1])]) for i in range(60)]
    got = M.top_inner_products(spark.createDataFrame(close, "vec_id long, embedding array<double>"), part=50, page=16)
    assert sorted(map(tuple, got.collect())) == exact(close, 20)
    assert max(r[3] for r in exact(close, 20)) > 1 << 53
    with pytest.raises(Exception, match="too large"):
        M.top_inner_products(spark.createDataFrame([(20, [1e300])], "vec_id long, embedding array<double>")).count()


@pytest.mark.parametrize("page", [16, 128])
def test_small_pages_prune_where_there_are_clusters(page):
    rng = np.random.default_rng(4)
    x = np.unique(np.concatenate((np.rint(np.repeat(rng.normal(0, 40, (40, 32)), 50, axis=0) + rng.normal(0, 1, (2000, 32))), np.rint(rng.normal(0, 40, (500, 32))))), axis=0)
    m = float((x * x).sum(axis=1).max())
    tree = M.MTree(M.lifted(x, m), page=page)
    ids = [np.array([i]) for i in range(len(x))]
    for q in x[::100]:
        got = tree.search(np.append(q, 0.0), m, 7, -np.inf, ids)
        assert got == sorted(((int(x[j] @ q), j) for j in range(len(x))), key=lambda e: (-e[0], e[1]))[:7]
    share = tree.computed / len(x) / len(x[::100])
    assert share < (0.75 if page == 16 else 1.1), share


@pytest.mark.parametrize("spread", [0.5, 40])
def test_queries_of_a_block_share_pages_and_equal_brute_force(spread):
    rng = np.random.default_rng(6)
    x = np.unique(np.rint(np.repeat(rng.normal(0, 30, (30, 6)), 60, axis=0) + rng.normal(0, spread, (1800, 6))), axis=0)
    m = float((x * x).sum(axis=1).max())
    tree = M.MTree(M.lifted(x, m), page=32)
    many = rng.integers(1, 4, len(x))  # copies, whose ids are not in the points' order
    starts = np.concatenate(([0], np.cumsum(many)))
    ids = np.concatenate([np.sort(y) for y in np.split(rng.permutation(int(many.sum())), starts[1:-1])])
    q = x[::10]
    asked = np.concatenate((q, np.zeros((len(q), 1))), axis=1)
    everything = [sorted(((int(s), int(i)) for p, s in enumerate(x @ one) for i in ids[starts[p] : starts[p + 1]]), key=lambda e: (-e[0], e[1])) for one in q]
    for floor in (np.full(len(q), -np.inf), np.array([float(e[9][0]) for e in everything])):
        best = M.Best(floor, 7)
        tree.search_many(asked, m, best, np.arange(1, len(q)), starts, ids)
        assert not (best.rows == 0).any()
        for j in range(1, len(q)):
            assert list(zip(best.scores[best.rows == j].astype(int).tolist(), best.ids[best.rows == j].tolist())) == everything[j][:7]
    if spread < 1:
        assert tree.computed < 0.8 * 2 * len(x) * len(q)


def test_equal_scores_keep_the_smaller_ids_however_many_there_are():
    x = np.zeros((300, 3))
    x[:, 0], x[:, 1] = 1, np.arange(300)
    m = float((x * x).sum(axis=1).max())
    tree, ids = M.MTree(M.lifted(x, m), page=8), np.arange(300)[::-1].copy()
    best = M.Best(np.full(40, -np.inf), 5)
    tree.search_many(np.tile([2.0, 0.0, 0.0, 0.0], (40, 1)), m, best, np.arange(40), np.arange(301), ids)
    assert best.ids.reshape(40, 5).tolist() == [[0, 1, 2, 3, 4]] * 40 and set(best.scores.tolist()) == {2.0}


def test_pages_are_not_exchanged_and_the_driver_gets_few_candidates(spark):
    df = spark.range(20000).select(F.col("id").alias("vec_id"), F.array(*[F.hash("id", F.lit(j)) % 100 / 64.0 for j in range(6)]).alias("embedding"))
    found = M.top_inner_products(df, k=3, every=2500, part=400)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "asked" in x]
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in df.collect()]
    v = np.floor(64 * np.array([x for _, x in rows])).astype(int)
    ids = np.array([i for i, _ in rows])
    expected = []
    for q in np.flatnonzero(ids % 2500 == 0):
        order = [j for j in np.lexsort((ids, -(v @ v[q]))) if j != q][:3]
        expected += [(int(ids[q]), r, int(ids[j]), int(v[j] @ v[q])) for r, j in enumerate(order, start=1)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    # in many tasks, of which each would send the wanted number
    entries = M.quantised(df, 64, "vec_id", "embedding").repartition(32)
    few = M.low_hashes(entries, 50, 20000)
    assert 50 <= few.count() < 330
    least = [tuple(r) for r in entries.select("vec", F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(50).collect()]
    assert [tuple(r) for r in few.orderBy("h", "vec").limit(50).collect()] == least


def test_long_vectors_make_smaller_trees_and_the_tasks_of_pairs_stay_few(spark, monkeypatch):
    monkeypatch.setattr(M, "WIDE", 8 * 5 * 30)
    rng = np.random.default_rng(7)
    ids, x = np.arange(900), rng.normal(size=(900, 5))
    kept = []
    monkeypatch.setattr(M, "written", lambda df, write=M.written: kept.append(write(df)) or kept[-1])
    found = M.top_inner_products(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"), k=4)
    assert found._jdf.queryExecution().executedPlan().toString().count("Coalesce") >= 1
    assert sorted(map(tuple, found.collect())) == brute(ids, x, 4)
    forest = next(df for df in kept if "pages" in df.columns).collect()
    assert len(forest) >= 30 and max(len(pickle.loads(r["pages"])[1]) for r in forest) < 90


def test_trees_travel_in_few_bytes():
    x = np.rint(np.random.default_rng(8).normal(0, 8, (1000, 64)))
    m = float((x * x).sum(axis=1).max())
    tree = M.MTree(M.lifted(x, m))
    sent = pickle.dumps(tree)
    assert len(sent) < 120 * len(x)
    again, ids, q = pickle.loads(sent), [np.array([i]) for i in range(len(x))], np.append(x[3], 0.0)
    assert again.search(q, m, 9, -np.inf, ids) == tree.search(q, m, 9, -np.inf, ids)
    half = M.MTree(M.lifted(x / 2 + 0.25, m))
    assert (pickle.loads(pickle.dumps(half)).nodes[-1]["vectors"] == half.nodes[-1]["vectors"]).all()


def test_quantised_rows_of_any_kind(spark):
    data = [(1, [1.0, -0.01]), (2, []), (3, None), (None, [1.0]), (4, [None]), (5, [float("nan"), 1e300]), (6, [0.5, 2.0, -3.0]), (7, [float("inf")]), (6, [0.5, 2.0, -3.0])]
    got = M.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>").coalesce(1), 64, "vec_id", "embedding").collect()
    assert sorted((r[0], np.frombuffer(r[1], "<i8").tolist()) for r in got) == [(1, [64, -1]), (2, []), (6, [32, 128, -192])]
    with pytest.raises(Exception, match="vector 9: a component is too large"):
        M.quantised(spark.createDataFrame([(8, [1.0]), (9, [1.0, -1e30]), (10, [2.0])], "vec_id long, embedding array<double>").coalesce(1), 64, "vec_id", "embedding").count()
