from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import language, mixing, similar, toxicity
from barloom.llm.common import held, written
from barloom.llm.queries import MIX

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_each_stage_applies_its_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(900001, "... 12", "en", "s", 6), (900002, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    first = written(corpus_pipeline.identified(spark, docs, SF))
    model = language.train(*language.training_texts(docs, ~held("doc_id", 5, 0)))
    assert first.columns == docs.columns
    assert ids(first) == ids(language.identify(docs, model).where("lang_pred <> 'und' and score >= 0.3")) and len(ids(first)) == docs.count() - 2
    second = written(corpus_pipeline.civil(spark, first, SF))
    tox = toxicity.fit(*toxicity.training_rows(first, spark.read.parquet(f"{SF}/labels.parquet"), ~held("doc_id", 4, 2)))
    assert ids(second) == ids(toxicity.score(first, tox).where("predicted = 0")) and second.columns == docs.columns
    third = written(corpus_pipeline.distinct(spark, second, SF))
    groups = similar.similar_groups(second)
    assert ids(third) == ids(groups.where("component_id = doc_id")) and third.columns == docs.columns
    assert third.count() == groups.select("component_id").distinct().count()
    fourth = written(corpus_pipeline.mixed(spark, third.withColumn("own_n", F.lit(1)), SF))
    drawn = mixing.mix(third, MIX, corpus_pipeline.KEEP).where("copies > 0")
    assert ids(fourth) == sorted(i for i, n in drawn.select("doc_id", "copies").collect() for _ in range(n))
    last = corpus_pipeline.segmented(spark, fourth, SF)
    assert sorted(set(ids(last))) == sorted(set(ids(fourth))) and last.where("not round_trip").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 50 and "ids" in out.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near-dedup", "mixing", "segmentation"]


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_copies_that_mixing_makes_draw_each_their_own(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").limit(5)
    drawn = docs.unionByName(docs).unionByName(docs)
    out = corpus_pipeline.segmented(spark, drawn, SF).collect()
    assert sorted({(r["copy"], r["rank"]) for r in out}) == [(c, k) for c in (1, 2, 3) for k in (1, 2)]
    for i in {r["doc_id"] for r in out}:
        mine = [tuple(r["ids"]) for r in out if r["doc_id"] == i]
        assert len(mine) == 6 == len(set(mine))


def test_stages_take_null_ids_long_texts_repeats_and_clashing_names(spark):
    text = "The cat sat on the mat and looked at the dog. " * 3
    long = " ".join(f"word{k % 977} of the house and the garden" for k in range(20000))
    rows = [(None, text, "en", "s", 1), (None, None, None, None, None), (1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, long, "en", "t", 1), (3, "", "en", "t", 0), (4, "12 34 !!", "en", "t", 3)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumns({c: F.lit(1) for c in ("score", "rank", "own_n", "component_id", "copy")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, docs, SF))
        assert kept.columns == docs.columns, name
        assert kept.where("doc_id = 2").count() >= (1 if name != "mixing" else 0)
        docs = kept
    assert docs.where("coalesce(text, '') = ''").count() == 0
    last = corpus_pipeline.segmented(spark, docs, SF)
    assert last.where("not round_trip").count() == 0 and last.count() > 50
