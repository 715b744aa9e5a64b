import itertools
import random

import pyarrow as pa
import pytest

from barloom.llm.licences import PHRASES, TEMPLATES, Scanner, scan_texts


def spans_of(scanner, text):
    _, found = scan_texts(scanner, pa.array([text]))
    return scanner.chain(found[0]["matches"]) if 0 in found else []


def test_every_occurrence_of_a_notice_is_a_span():
    scanner = Scanner(TEMPLATES, PHRASES)
    bsd = next(t for label, t in TEMPLATES if label == "bsd-notice")
    n = len(bsd.split())
    for between in (0, 2, 50):
        text = " ".join([bsd, *["zzz"] * between, bsd, *["zzz"] * between, bsd])
        found = [s for s in spans_of(scanner, text) if s[0] == "bsd-notice"]
        assert [(s[1], s[2], s[3]) for s in found] == [(k * (n + between), k * (n + between) + n, 1.0) for k in range(3)]


def test_a_run_that_recurs_in_a_template_is_chained_at_its_later_place():
    template = "a b c d e f g h a b c i j k l"
    scanner = Scanner([("own", template)], {})
    assert spans_of(scanner, "d e f g h zzz a b c zzz i j k l") == [("own", 0, 14, 12 / 15)]


def matches_by_hand(words, templates, least):
    """All runs of `least` words or more that text and template share and that go on in neither direction."""
    out = set()
    for k, t in enumerate(templates):
        for i in range(len(words)):
            for j in range(len(t)):
                if words[i] == t[j] and (i == 0 or j == 0 or words[i - 1] != t[j - 1]):
                    n = 1
                    while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                        n += 1
                    if n >= least:
                        out.add((i + n, n, k, j + n))
    return out


def best_chain(runs, gap):
    """The most words that runs (first, place, words) can cover one after the other, over all ways to choose them."""
    best = 0
    for size in range(1, len(runs) + 1):
        for some in itertools.combinations(sorted(runs), size):
            if all(a[0] + a[2] <= b[0] <= a[0] + a[2] + gap and a[1] + a[2] <= b[1] for a, b in zip(some, some[1:])):
                best = max(best, sum(n for _, _, n in some))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_matches_and_chains_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(60):
        shared = [[rng.choice("abcde") for _ in range(rng.randint(3, 6))] for _ in range(3)]
        make = lambda parts: [w for _ in range(parts) for w in (rng.choice(shared) if rng.random() < 0.7 else [rng.choice("abcdefgh")])]
        templates = [make(rng.randint(1, 4)) for _ in range(4)]
        words = make(rng.randint(1, 6))
        scanner = Scanner([(f"t{k}", " ".join(t)) for k, t in enumerate(templates)], {})
        _, found = scan_texts(scanner, pa.array([" ".join(words)]))
        got = found[0]["matches"] if 0 in found else []
        known = {w for t in templates for w in t}
        runs, at = [], 0
        for is_known, run in itertools.groupby(words, lambda w: w in known):
            run = list(run)
            if is_known:
                runs += [(end + at, n, k, place) for end, n, k, place in matches_by_hand(run, templates, 3)]
            at += len(run)
        assert sorted(got) == sorted(runs)
        spans = scanner.chain(got)
        for k, t in enumerate(templates):
            mine = [(end - n, place - n, n) for end, n, j, place in got if j == k]
            if len(mine) > 9:
                continue
            best = best_chain(mine, scanner.gap) / len(t)
            shares = [s[3] for s in spans if s[0] == f"t{k}"]
            assert max(shares, default=0) == (best if best >= scanner.cover else 0)


def test_a_template_within_a_run_of_another_is_found():
    scanner = Scanner([("k", "a b c d e"), ("long", "x a b c d e y z p q r t u v w")], {})
    assert spans_of(scanner, "x a b c d e") == [("k", 1, 6, 1.0)]
    assert ("k", 1, 6, 1.0) in spans_of(scanner, "x a b c d e y z p q r t u v w")


def test_whole_licences_are_found_in_files(spark):
    from pyspark.sql import functions as F

    from barloom.llm.licence_texts import TEXTS
    from barloom.llm.licences import scan

    rows = [(k, f"# file {k}\n{text}\nint main() {{ return {k}; }}", 1) for k, text in enumerate(TEXTS.values())] + [(99, TEXTS["mit-text"] + "\n\n" + TEXTS["zlib-text"], 1), (99, TEXTS["mit-text"] + "\n\n" + TEXTS["zlib-text"], 1), (100, None, 1)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, spans int").withColumn("labels", F.lit("clash"))).collect()
    for r in got:
        if r["doc_id"] < 99:
            assert list(TEXTS)[r["doc_id"]] in r["labels"].split(",") and r["score"] == 1.0
    both = [r for r in got if r["doc_id"] == 99]
    assert len(both) == 2 and both[0] == both[1] and {"mit-text", "zlib-text"} <= set(both[0]["labels"].split(","))
