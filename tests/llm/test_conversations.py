import hashlib
import random
import zlib

import pytest

from barloom.llm import conversations as C
from barloom.llm.queries import op11_prefix_trie
from oracle import check, connection

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def brute(rows):
    own = {}
    for c, t, r, x, _ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    new = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        new[c] = own.get(base, [])[:h] + v[h:]
    nodes = {}
    for c, v in new.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for n in nodes:
        if n:
            kids[n[:-1]] = kids.get(n[:-1], 0) + 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(members) - 1) * (len(n[-1][1]) if n else 0)
    key = lambda c: ",".join(map(str, sorted(c)))
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else -1, len(m), kids.get(n, 0), leaves[n], saved[n], hashlib.sha256(key([c for c in m if len(new[c]) == len(n)]).encode()).hexdigest()) for n, m in nodes.items())


def got(spark, rows):
    out = C.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in out)


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.01"
    assert check(op11_prefix_trie(spark, path), connection(path), C.prefix_trie_sql()) > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 3)
    monkeypatch.setattr(C, "BAND", 2 if seed == 1 else 8)
    monkeypatch.setattr(C, "STEP", 3)
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(95, 130), 200, 201, 305, -3, -100, 1 << 40]:
        length = rng.choice((1, 2, 3, 6, 7, 20))
        rows += [(c, t - 4, rng.choice(("user", "assistant")), rng.choice(("a", "é", "😀b")), 1) for t in range(length)]
    rows += [(c, t, "user", "same" * (t + 1), 1) for c in range(500, 560) for t in range(9)]  # copies
    rows += [(7, None, None, None, 1), (7, None, None, None, 1), (7, 1, "user", None, 1), (7, 1, None, "x", 1), (7, 1, None, "x", 1), (None, 1, "user", "lost", 1)]
    assert got(spark, rows) == brute(rows)


def test_long_conversations_and_texts_cross_many_bands(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 50)
    monkeypatch.setattr(C, "BAND", 4)
    rows = [(c, t, "user", f"{t}" if t < 70 else f"{t} {c % 2}", 1) for c in (1000, 1001, 1002) for t in range(150)] + [(1100, 0, "user", "x" * 300000, 1), (1101, 9, "user", "y", 1)]
    assert got(spark, rows) == brute(rows)


def test_empty_and_turnless(spark):
    assert got(spark, []) == []
    alone = [(c, 0, "user", "x", 1) for c in range(1, 60)]  # base 0 is absent: some have no turn left
    out = got(spark, alone)
    assert out == brute(alone) and out[0][3] == 59
    assert got(spark, alone[3:4]) == brute(alone[3:4])


def test_parts_of_role_and_text_are_not_mixed_up(spark):
    rows = [(0, 0, "ab", "c", 1), (100, 0, "a", "bc", 1), (200, 0, "", "abc", 1), (300, 0, "1:a", "bc", 1)]
    assert got(spark, rows) == brute(rows) and len(brute(rows)) == 5


def test_a_common_parent_is_looked_up_by_broadcast(spark):
    rows = [(100 * c, 0, "user", f"{c}", 1) for c in range(1200)] + [(100 * c, 1, "user", "next", 1) for c in range(5)]
    assert got(spark, rows) == brute(rows)
