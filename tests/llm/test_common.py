import random

import numpy as np

from barloom.llm import common


def twins(n=10):
    """Two words of 2**n letters that a running polynomial modulo 2**64 cannot tell apart, whatever its base."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_span_hashes_depend_on_bytes_alone():
    rng = random.Random(1)
    words = [bytes(rng.randrange(97, 100) for _ in range(rng.choice((0, 1, 2, 7, 8, 9, 16, 17, 511, 512, 513, 3000)))) for _ in range(3000)] + [w.encode() for w in twins()] * 2
    data = np.frombuffer(b"".join(words) + b"x", np.uint8)
    end = np.cumsum([len(w) for w in words])
    hashes = common.span_hashes(data, end - [len(w) for w in words], end)
    by = {}
    for w, h in zip(words, hashes.tolist()):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    alone = [int(common.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words[:200]]
    assert alone == hashes[:200].tolist()


LETTER = np.frombuffer(bytes(range(97, 123)), np.uint8)


def made_up(n=20, samples=1 << 17):
    """Pairs of different words of 16 letters to which span_hashes gives one hash, for a key that is known (0): a change of the
    first lane is taken back by the second, which has to stay letters."""
    rng = np.random.default_rng(7)
    first = LETTER[rng.integers(0, 26, (samples, 8))].copy().view("<u8")[:, 0]
    with np.errstate(over="ignore"):
        y = (np.uint64(16) * common.BASE ^ first) * np.uint64(0x9FB21C651E98DF25)
        state = (y ^ (y >> np.uint64(28))) * common.BASE
    order = np.argsort(state & np.uint64(0xE0E0E0E0E0E0E0E0), kind="stable")
    out = []
    for i, j in zip(order[:-1].tolist(), order[1:].tolist()):
        change = int(state[i] ^ state[j])
        if change & 0xE0E0E0E0E0E0E0E0 or first[i] == first[j]:
            continue
        second = [next((c for c in range(97, 123) if 97 <= c ^ d < 123), 0) for d in change.to_bytes(8, "little")]
        if all(second):
            other = bytes(c ^ d for c, d in zip(second, change.to_bytes(8, "little")))
            out.append(((int(first[i]).to_bytes(8, "little") + bytes(second)).decode(), (int(first[j]).to_bytes(8, "little") + other).decode()))
        if len(out) == n:
            break
    return out


def test_made_up_pairs_share_a_hash_only_for_a_known_key():
    pairs = [*made_up(), ("qnaghhjtaaadaaaa", "dsojfdwhbkkzriad")]
    assert len(pairs) > 5
    data = np.frombuffer("".join(a + b for a, b in pairs).encode(), np.uint8)
    begin = np.arange(0, len(data), 16)
    plain, keyed = (common.span_hashes(data, begin, begin + 16, k).reshape(-1, 2) for k in (0, 123456789))
    assert (plain[:, 0] == plain[:, 1]).all() and (keyed[:, 0] != keyed[:, 1]).all()
    same = common.same_spans(data, begin[::2], begin[::2] + 16, data, begin[1::2], begin[1::2] + 16)
    assert not same.any()


def test_keys_depend_on_all_texts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "text string")
    key = lambda x: common.key_of(x.agg(common.text_key(x, "text")).first()[0])
    assert key(df) == key(df.repartition(3)) != key(df.limit(2)) and key(df.limit(0)) == 1


def test_short_words_of_equal_hash_and_length_are_equal():
    """One lane: an exhaustive look at three letters, and random ones of eight."""
    rng = np.random.default_rng(3)
    words = {bytes((a, b, c)) for a in range(97, 123) for b in range(97, 123) for c in range(97, 123)} | {rng.integers(0, 256, 8, np.uint8).tobytes() for _ in range(50_000)}
    data = np.frombuffer(b"".join(sorted(words)), np.uint8)
    size = np.array([len(w) for w in sorted(words)])
    end = np.cumsum(size)
    hashes = common.span_hashes(data, end - size, end)
    for n in (3, 8):
        assert len(np.unique(hashes[size == n])) == (size == n).sum()
    assert common.same_words(data, end - size, end, data, end - size, end).all()
    assert not common.same_words(data, end[:1] - 3, end[:1], data, end[1:2] - size[1], end[1:2] + 1).any()
