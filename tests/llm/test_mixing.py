import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing as M
from barloom.llm.queries import MIX

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import check, connection  # noqa: E402


def test_query_equals_sql(spark):
    from barloom.llm.queries import op6_mixing

    path = "/root/testdata/sf0.01"
    assert check(op6_mixing(spark, path), connection(path), M.mix_sql(MIX)) == 1000


KNOWN = {"s0": 0.5, "s1": 0.3, "s2": 0.2}


@pytest.mark.parametrize("few", [True, False])
def test_marginals(spark, few):
    rows = [(f"s{i % 3}", f"l{i % 2}", f"t{i % 5}", float(10 + 37 * i % 101)) for i in range(30)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, mass double").groupBy("source", "lang", "topic").agg(F.sum("mass").alias("mass"))
    targets = {"source": KNOWN | {"missing": 9.0}, "lang": {"l0": 1, "l1": 1}, "topic": 1.0}
    out = M.rake(cells, targets, 20 if few else 3, few).toPandas()
    for name, share in out.groupby("source").weight.sum().items():
        assert abs(share - KNOWN[name]) < (1e-3 if few else 0.05)
    share = out.groupby("lang").weight.sum()
    assert abs(share["l0"] - share["l1"]) < (1e-3 if few else 0.05)


def test_both_branches_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (M.mix(docs, {"source": 0.5, "lang": {"en": 2.0, "fr": 1.0}, "topic": 0.5}, rounds=2, few_cells=n).toPandas().sort_values("doc_id") for n in (M.FEW_CELLS, 0))
    assert np.allclose(one.rate, two.rate) and (one.copies == two.copies).all() and (one.copies > 1).any()
    assert (one[~one.lang.isin(["en", "fr"])].copies == 0).all()


def test_the_sample_reaches_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for keep in (0.5, 0.8):
        mixed = M.mix(docs, MIX, keep).persist()
        got = M.report(mixed, MIX).toPandas()
        assert len(got) > 10 and (got.residual.abs() < 0.01).all(), got
        # what was drawn of each category is within 4.5 standard deviations of what was expected
        rows = mixed.toPandas()
        part = rows.rate % 1
        rows["expected"], rows["drawn"], rows["variance"] = rows.rate * rows.n_tokens, rows.copies * rows.n_tokens, part * (1 - part) * rows.n_tokens**2
        for d in M.DIMENSIONS:
            sums = rows.groupby(d)[["expected", "drawn", "variance"]].sum()
            assert ((sums.drawn - sums.expected).abs() <= 4.5 * np.sqrt(sums.variance) + 1).all(), sums
        tokens = mixed.agg(F.sum(F.col("n_tokens") * F.col("rate")) / F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("copies")) / F.sum("n_tokens")).first()
        assert abs(tokens[0] - keep) < 1e-6 and abs(tokens[1] / keep - 1) < 0.1
        # each document has the whole part of its rate, or one more
        assert mixed.where("copies < floor(rate) or copies > floor(rate) + 1").count() == 0
        mixed.unpersist()


def test_rows_are_drawn_as_often_as_mix_says(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("own_n", F.lit(7)).withColumn("OWN_rate", F.lit("x")).withColumn("own_copy", F.lit(3))
    got = M.selected(docs, MIX, 0.8)
    assert got.columns == docs.columns and got.select("own_n", "OWN_rate", "own_copy").distinct().collect() == [(7, "x", 3)]
    want = {r["doc_id"]: r["copies"] for r in M.mix(docs, MIX, 0.8).where("copies > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == want


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "one two", None, None), (3, "one two", None, None), (None, "x @ y", "en", "a"), (5, "w " * 90000, "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("topic", F.lit("clash")).withColumn("mass", F.lit(1))
    got = M.mix(docs, {"source": 0.5, "lang": 0.5, "topic": 0.5}, keep=1.0).collect()
    assert len(got) == 6 and {r["doc_id"]: (r["topic"], r["n_tokens"], r["copies"] > 0) for r in got} == {1: ("empty", 0, False), 2: ("empty", 0, False), 3: ("prose-short", 2, True), None: ("contact", 3, True), 5: ("prose-long", 90000, True)}
    assert M.mix(docs.limit(0), {"source": 1, "lang": 1, "topic": 1}).count() == 0


def test_words_match_the_rule():
    assert re.findall(M.WORDS, "a\x0bb\x1cc\xa0d  e") == ["a", "b\x1cc\xa0d", "e"]


def test_copies_are_numbered(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "a"), (None, None)]
    got = sorted(((r["doc_id"] or -1, r["text"] or "", r["n"]) for r in M.copy_numbers(spark.createDataFrame(rows, "doc_id long, text string"), "n").collect()))
    assert got == [(-1, "", 1), (-1, "a", 1), (-1, "a", 2), (1, "a", 1), (1, "a", 2), (1, "b", 1), (2, "a", 1)]
