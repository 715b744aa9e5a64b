import random
import re

import pyarrow as pa

from barloom.llm import licences as A


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w = words(text)
    places = [(i, label) for p, label in A.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def statistics(words_, templates):
    """The longest run ending at each word that stands in a template, by trying every length."""
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    return [max((n for n in range(1, i + 2) if tuple(words_[i + 1 - n : i + 1]) in runs), default=0) for i in range(len(words_))]


def test_automaton_gives_matching_statistics():
    rng = random.Random(3)
    for _ in range(60):
        templates = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 5))]
        auto = A.Automaton()
        for t in templates:
            auto.add(t)
        text = [rng.randrange(4) for _ in range(40)]
        state, n, got = 0, 0, []
        for w in text:
            while state and w not in auto.moves[state]:
                state = auto.link[state]
                n = auto.length[state]
            state, n = (auto.moves[state][w], n + 1) if w in auto.moves[state] else (0, 0)
            got.append(n)
        assert got == statistics(text, templates)


def test_base_columns_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [None, "", "...", "cc by cc by", "MIT-License mit license", "gnu general public apache license", "apache\nLICENSE gnu General Public, License cc", "by cc", "x", "x", "cc " * 5000 + "by"]
    extra = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = dict(docs.union(extra).collect())
    got = A.scan(docs.union(extra)).collect()
    assert len(got) == len(rows) and sum(r["n_base"] for r in got) > 5
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(rows[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_spans():
    s = A.Scanner(A.TEMPLATES, A.PHRASES)
    text = "Foo bar. Permission is hereby granted, free of charge, to any odd person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software. Baz"
    n, found = A.scan_texts(s, pa.array([text, "released under the MIT license", "permission is hereby refused"]))
    spans = s.chain(found[0]["matches"])
    assert [x[0] for x in spans] == ["mit-notice"] and spans[0][1] == 2 and spans[0][2] == n[0] - 1 and spans[0][3] > 0.95
    assert [x[::3] for x in s.chain(found[1]["matches"])] == [("mit-notice", 1.0)]
    assert s.chain(found.get(2, {"matches": []})["matches"]) == []


def test_empty_table(spark):
    assert A.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
