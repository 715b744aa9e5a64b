import random
import re

import pytest

import corpus_pipeline
from barloom.llm import similar


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def grouped(texts):
    """The least id that links reach, by all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    label, by = {i: i for i in sets}, {}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for group in by.values() for k, a in enumerate(group) for b in group[k + 1 :]}
    linked = [(a, b) for a, b in pairs if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {i: find(i) for i in sets}


def edited(words, rng, edits):
    out = list(words)
    for k in rng.sample(range(len(out)), edits):
        out[k] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    texts, vocabulary = {}, [f"w{k}" for k in range(500)]
    for base in range(25):
        words = rng.choices(vocabulary, k=rng.choice((6, 40, 120, 400)))
        for edits in (0, 0, 1, 2, 3, 5, 8):
            texts[len(texts)] = edited(words, rng, min(edits, len(words) // 4)) + (" this line stands in many of the texts here" if base % 2 else "")
    words = rng.choices(vocabulary, k=150)  # a large group, whose members are linked by their base
    for _ in range(120):
        texts[len(texts)] = edited(words, rng, 2)
    texts |= {k + 10_000: t for k, t in enumerate((None, "", " \n", "Two words", "two WORDS", "a b " * 3000))}
    want = grouped(texts)
    got = similar.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(texts)
    assert len(set(want.values())) < len(texts) - 150


@pytest.mark.parametrize("block", [8, 64])
def test_groups_of_many_blocks_equal_brute_force(spark, monkeypatch, block):
    """Near-copies of one text, a chain whose ends are unlike, two parts of one group of candidates, and all of them small."""
    monkeypatch.setattr(similar, "BLOCK_DOCS", block)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(500)]
    base, long = rng.choices(vocabulary, k=150), rng.choices(vocabulary, k=700)
    made = [edited(base, rng, 2) for _ in range(90)] + [" ".join(long[3 * k : 3 * k + 150]) for k in range(120)]
    other = edited(base, rng, 5).split()
    made += [edited(other, rng, 2) for _ in range(60)] + ["", None, "one two"]
    rng.shuffle(made)
    texts = dict(enumerate(made))
    got = similar.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == grouped(texts)


def test_stage_drops_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = grouped({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    got = corpus_pipeline.distinct(spark, docs, "/root/testdata/sf0.01")
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(set(want.values())) and got.columns == docs.columns


def test_edges(spark):
    assert similar.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "same text here"), (7, "same text here"), (4, "same text here"), (4, "same text here")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in similar.one_of_each(rows).collect()) == ["4", "4", "None"]
    with pytest.raises(ValueError):
        similar.similar_groups(rows, least="0")


def test_shingles_of_words_of_equal_hash_differ(spark):
    from test_common import made_up

    pairs = made_up(8)
    rows = [(k, " ".join(p[j] for p in pairs)) for k, j in enumerate((0, 1))]
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1}
