import re

import pytest
from pyspark.sql import functions as F

from barloom import queries as Q
from barloom.functions.ranges import spread
from barloom.plans.accounting import Account
from barloom.sources import bars as B
from barloom.sources.store import write_buckets
from oracle import check, connection
from test_bars import closes, frame

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["step1_buckets", "step3_atr_buckets", "labels_500_rows", "step1_one_symbol", "asof_one_symbol", "prior_low_20", "prior_low_250", "stored_step2_buckets", "files_preamble", "step_accounts", "purge_table", "standin_permutation"])
def test_query_equals_sql(spark, name):
    make, sql = Q.FOUND[name]
    assert check(make(spark, SF), connection(SF), sql) > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    bucketed = plan(Q.FOUND["stored_step2_buckets"][0](spark, SF))
    assert "Exchange" not in bucketed and "Bucketed: true" in bucketed and "Window" in bucketed
    metrics = plan(Q.FOUND["fold_metrics"][0](spark, SF))
    assert len(re.findall(r"Scan parquet", metrics)) <= 2
    for window in re.findall(r"windowspecdefinition\(fold#\d+,([^)]*)", metrics):
        assert "__part" in window  # nothing orders a whole fold
    many = spread(Q.one_symbol(spark, SF), before=300, size=256)
    assert many.select("symbol").distinct().count() >= 7  # buckets of one symbol, each a key of its own


def test_sheets_have_preamble_and_junk(spark, tmp_path):
    bars = frame(spark, closes(80)).unionByName(frame(spark, closes(3), "Y"))
    path = B.write_sheets(bars, str(tmp_path / "s"), days=32)
    raw = spark.read.text(path)
    assert raw.where("value like '%--------%'").count() > 0 and raw.where("value = 'price data'").count() >= 4
    got = B.clean(B.read_vendor(spark, path, skip=3))
    key = lambda df: sorted(tuple(r) for r in df.select(B.BARS.fieldNames()).collect())
    assert key(got) == key(bars)


def test_bucketed_tables_do_not_depend_on_the_number_of_symbols(spark):
    df = frame(spark, list(range(1, 200))).withColumn("symbol", F.concat(F.lit("s"), F.col("close").cast("int").cast("string")))
    out = write_buckets(df, "many_symbols", ["symbol"], ["symbol", "dt"], 3)
    assert out.count() == 199 and len(out.inputFiles()) == 3
    again = write_buckets(df.limit(5), "many_symbols", ["symbol"], ["symbol", "dt"], 3)
    assert again.count() == 5


def test_account_of_an_empty_step(spark):
    account = Account()
    kept = account.keep("s")(frame(spark, [1]).limit(0), ["close", "open"])
    assert kept.count() == 0
    assert {r["reason"]: r["n"] for r in account.table(spark).collect()} == {"rows_in": 0, "rows_out": 0, "dropped": 0, "missing close": 0, "missing open": 0}
