import random

from pyspark.sql import functions as F

from barloom.llm import common, graph


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(5000, k) for k in range(6000, 9000)] + [(None, 1), (4, 4)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in label}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_links_of_hubs_are_not_joined_by_key(spark):
    """A path of hubs with thousands of neighbours each, hub ids at both ends of their neighbours' ids."""
    hubs = [7, 900_000, 40_000, 800_000]
    links = [(hub, 100_000 * (k + 1) + j) for k, hub in enumerate(hubs) for j in range(2000)] + list(zip(hubs, hubs[1:]))
    table = spark.createDataFrame(links + links[:50], "a long, b long").repartition(8)
    out = graph.components(table)
    assert out.count() == 8004 and out.where("component <> 7").count() == 0 and out.select("node").distinct().count() == 8004
    star = graph._stars(table, True, 2 * len(links))
    near = star._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in near


def test_hot_keys_are_joined_by_broadcast(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    facts = rows.where("k is not null and k <> 4500").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    out = common.join_hot(rows, facts, "k", "n", 5001)
    assert out.columns == ["k", "id", "v"] and out.count() == 4999 and out.where("v <> 2 * k").count() == 0
    assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
