"""Interpolated modified Kneser-Ney trigram model, counted in Spark and read by workers as memory-mapped sorted arrays.

Counting is three passes of one job. Each task turns its texts into distinct trigrams of 64-bit word hashes with counts,
laid out by the hash range of the middle word: there both what follows (first, middle) and how many words come before
(middle, last) are complete, so one exchange serves both levels. Each range is merged and written as one file of sorted
arrays, and passes on what it says of single words; each word range is merged and written the same way. What the driver
gets is some sums.

A middle word of many tokens is split by its last words over several ranges. The counts of such trigrams and pairs stay
complete, and the totals of their contexts are sums over the ranges, which readers add up. Which words are split is
estimated on a bounded sample of rows; it decides where rows go and has no part in results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import LOWER, SPACE, file_names, joined, key_of, map_file, mixed, pieces, put_file, shared_dir, span_hashes, spans, sum_by, text_key

BEGIN, END = np.uint64(1), np.uint64(2)  # stand for the borders of a text
WORD = np.dtype([("word", "<u8"), ("count", "<u8"), ("left", "<u4")])
BLOBS = "bucket int, words binary, size int, rows binary"
STATS = ["t1", "t2", "t3", "t4", "p1", "p2", "p3", "p4", "w1", "w2", "w3", "w4", "types", "lefts", "train_tokens"]
FACTS = STATS[:8]
NONE = 0xFFFFFFFF  # the place of a word that a range does not have
FEW = 4  # contexts and heads of more followers have their totals stored
BLOCK = 64  # contexts that share the place from which theirs are counted

# Arrays of a range's file in the order they are stored; words are places in `words` everywhere else. The long arrays of
# places are stored as their lower 16 bits and, in _high, the rest: a byte unless there are more than 2**24 words. Where a
# context's followers begin is stored as steps of 16 bits from the block's first, larger ones apart (far).
ARRAYS = {
    "words": "<u8", "big_total": "<u8", "many_total": "<u8", "over": "<u8", "pair_over": "<u8",
    "head": "<u4", "head_from": "<u4", "head_pairs": "<u4", "big": "<u4", "big_n1": "<u4", "big_n2": "<u4", "big_n3": "<u4",
    "context_base": "<u4", "far": "<u4", "far_at": "<u4", "many": "<u4", "many_n1": "<u4", "many_n2": "<u4", "many_n3": "<u4",
    "over_at": "<u4", "pair_over_at": "<u4", "context_step": "<u2", "context": "<u2", "next": "<u2", "pair_next": "<u2",
    "context_high": "high", "next_high": "high", "pair_next_high": "high", "count": "u1", "pair_count": "u1",
}
LONG = ["context", "next", "pair_next"]


def tokens(column: pa.Array, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then one end for each text), and each text's first token, with all tokens' count."""
    data, starts = joined(column)
    raw = LOWER[np.frombuffer(data, np.uint8)]
    begin, end, first = spans(~SPACE[raw], starts)
    hashes = span_hashes(raw, begin, end, key)
    texts = len(first) - 1
    at = first + np.arange(texts + 1)
    token = np.empty(len(hashes) + texts, np.uint64)
    token[np.arange(len(hashes)) + np.repeat(np.arange(texts), np.diff(first))] = hashes
    token[at[1:] - 1] = END
    return token, at


def previous(token: np.ndarray, at: np.ndarray, begin: int | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two before each one; begin stands for the border of a text."""
    before, twice = np.empty_like(token), np.empty_like(token)
    before[1:] = token[:-1]
    before[at[:-1]] = begin
    twice[1:] = before[:-1]
    twice[at[:-1]] = begin
    return before, twice


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place in them: np.unique by a hash table, which sorts distinct values only."""
    coded = pa.array(values).dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(words)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return words[order], rank[coded.indices.to_numpy(zero_copy_only=False)]


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The hash range (equal parts of the upper 32 bits) that h is in."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class Split:
    """The middle words whose trigrams go to several ranges, sorted, and the number of parts of each."""

    words: np.ndarray
    parts: np.ndarray

    def of(self, middle: np.ndarray) -> np.ndarray:
        """Each word's parts; 0 for words that are not split."""
        if not len(self.words):
            return np.zeros(len(middle), np.int64)
        at, ok = _find(self.words, middle)
        return np.where(ok, self.parts[at], 0)

    def ranges(self, middle: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
        """The range of each word's part (0 for words that are not split)."""
        return bucket_of(mixed(mixed(middle) + part.astype(np.uint64)), buckets)

    def route(self, words: np.ndarray, middle: np.ndarray, last: np.ndarray, buckets: int) -> np.ndarray:
        """The ranges of rows of places in words."""
        where = self.ranges(words, np.zeros(len(words), np.uint64), buckets)[middle]
        if len(self.words):
            parts = self.of(words)[middle]
            cut = np.flatnonzero(parts)
            where[cut] = self.ranges(words[middle[cut]], mixed(words[last[cut]]) % parts[cut].astype(np.uint64), buckets)
        return where


def _runs(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    for y in more:
        new[1:] |= y[1:] != y[:-1]
    return np.flatnonzero(new)


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether what is asked stands there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _find_within(keys: np.ndarray | _Places, low: np.ndarray, high: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same within keys[low:high] of each asked row, where the keys are sorted; NONE is not found."""
    at, found = np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    rows = np.flatnonzero((low < high) & (asked != NONE))
    low, high, asked = low[rows].astype(np.int64), high[rows].astype(np.int64), asked[rows]
    while rows.size:
        # narrowed to the last key that is not larger, if any is: each row still has a key, and one key ends it
        one = high - low == 1
        if one.any():
            end = np.flatnonzero(one)
            at[rows[end]] = low[end]
            found[rows[end]] = keys[low[end]] == asked[end]
            on = np.flatnonzero(~one)
            rows, low, high, asked = rows[on], low[on], high[on], asked[on]
        middle = (low + high) >> 1
        less = keys[middle] <= asked
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return at, found


def _pack(n: int, columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray | None, int]:
    """Columns (two or more) of numbers below n as one number a row, the first column uppermost, and the bits of each; None if 64 do not hold them."""
    bits = max(1, int(n - 1).bit_length())
    if bits * len(columns) > 64:
        return None, bits
    key = columns[0].astype(np.uint64)
    for x in columns[1:]:
        key <<= np.uint64(bits)
        key |= x.astype(np.uint64)
    return key, bits


def _unpack(key: np.ndarray, bits: int, columns: int) -> list[np.ndarray]:
    return [(key >> np.uint64(bits * k) & np.uint64((1 << bits) - 1)).astype(np.uint32) for k in reversed(range(columns))]


def _distinct(n: int, *columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct rows of columns of numbers below n in order (by the first column first), the order of all rows, and where
    in it each distinct row begins."""
    key, bits = _pack(n, columns)
    if key is None:
        order = np.lexsort(columns[::-1])
        cut = _runs(*(x[order] for x in columns))
        return [x[order[cut]] for x in columns], order, cut
    order = np.argsort(key)
    key = key[order]
    cut = _runs(key)
    return _unpack(key[cut], bits, len(columns)), order, cut


def _counted(n: int, *columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows in order, and how often each occurs."""
    key, bits = _pack(n, columns)
    if key is None:
        found, _, cut = _distinct(n, *columns)
    else:
        key.sort()
        cut = _runs(key)
        found = _unpack(key[cut], bits, len(columns))
    return found, np.diff(np.append(cut, len(columns[0])))


def _seen(n: int, *columns: np.ndarray) -> np.ndarray:
    """The numbers below n that the columns hold, in order."""
    seen = np.zeros(n, bool)
    for x in columns:
        seen[x] = True
    return np.flatnonzero(seen)


def _by_range(where: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each range that has rows, and these; 16 bits are sorted by digits."""
    order = np.argsort(where.astype(np.uint16) if buckets <= 1 << 16 else where, kind="stable")
    edges = np.append(_runs(where[order]), len(where))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(where[order[a]]), order[a:b]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2**32, compressed byte by byte: all lowest bytes, then all next ones, and so on."""
    planes = [x.astype("<u4").view(np.uint8).reshape(-1, 4).T for x in columns]
    return pa.Codec("zstd").compress(np.concatenate(planes).tobytes(), asbytes=True)


def _unpacked(raw: bytes, columns: int, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw, 4 * columns * size, asbytes=True), np.uint8).reshape(columns, 4, size)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4").reshape(columns, size)


def _packed_trigrams(first: np.ndarray, middle: np.ndarray, last: np.ndarray, count: np.ndarray) -> bytes:
    """Rows in order: middle as steps, first as steps among rows of one middle."""
    step = np.diff(middle, prepend=0)
    within = np.diff(first, prepend=0)
    head = _runs(middle)
    within[head] = first[head]
    return _packed(step, within, last, count)


def _unpacked_trigrams(raw: bytes, size: int) -> tuple[np.ndarray, ...]:
    step, within, last, count = _unpacked(raw, 4, size)
    middle, first = np.cumsum(step, dtype=np.int64), np.cumsum(within, dtype=np.int64)
    head = _runs(middle)
    first -= np.repeat(first[head] - within[head], np.diff(np.append(head, size)))
    return first, middle, last, count


def _trigrams(token: np.ndarray, at: np.ndarray, buckets: int, split: Split) -> Iterator[pa.RecordBatch]:
    """Distinct trigrams with counts, one row for each range that has some, as places in the row's own words."""
    words, ids = numbered(np.append(token, BEGIN))
    by = np.argsort(-np.bincount(ids), kind="stable")  # frequent words get small numbers, which compress
    rank = np.empty(len(words), np.int64)
    rank[by] = np.arange(len(words))
    words, ids = words[by], rank[ids]
    last = ids[:-1]
    middle, first = previous(last, at, ids[-1])
    (middle, first, last), count = _counted(len(words), middle, first, last)
    place = np.empty(len(words), np.int64)
    for bucket, rows in _by_range(split.route(words, middle, last, buckets), buckets):
        m, f, w = middle[rows], first[rows], last[rows]
        own = _seen(len(words), m, f, w)
        place[own] = np.arange(len(own))
        yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([words[own].tobytes()], pa.binary()), pa.array([len(rows)], pa.int32()), pa.array([_packed_trigrams(place[f], place[m], place[w], count[rows])], pa.binary())], names=["bucket", "words", "size", "rows"])


def _count(batches: Iterator[pa.RecordBatch], buckets: int, split: Split, most: int, key: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def whole() -> tuple[np.ndarray, np.ndarray]:
        sizes = np.concatenate([np.diff(at) for _, at in held])
        return np.concatenate([token for token, _ in held]), np.append(0, np.cumsum(sizes))

    for b in pieces(batches, "text"):
        held.append(tokens(b.column(0), key))
        n += len(held[-1][0])
        if n >= most:
            token, at = whole()
            held, n = [], 0
            yield from _trigrams(token, at, buckets, split)
    if n:
        yield from _trigrams(*whole(), buckets, split)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    found: dict[int, list[dict]] = {}
    for b in batches:
        for row in b.to_pylist():
            found.setdefault(row["bucket"], []).append(row)
    return found


def _sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, cut) if len(cut) else values[:0]


def _classes(counts: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """How many counts are 1, 2, and 3 or more, by runs."""
    return [_sums(x.astype(np.uint32), cut) for x in (counts == 1, counts == 2, counts >= 3)]


def _bytes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as bytes, with the places and values of those of 255 or more."""
    over = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), over.astype("<u4"), counts[over]


def _kind(kind: str, words: int) -> str:
    return kind if kind != "high" else "u1" if words <= 1 << 24 else "<u2"


class _Places:
    """An array stored as lower and higher bits."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low, self.high = low, high

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.low[at] | self.high[at].astype(np.uint32) << np.uint32(16)


class _Starts:
    """Where the followers of contexts begin, by blocks of contexts."""

    def __init__(self, t: dict[str, np.ndarray]) -> None:
        self.base, self.step, self.far_at, self.far = (t[x] for x in ("context_base", "context_step", "far_at", "far"))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        step = self.step[at].astype(np.int64)
        if len(self.far_at):
            full = np.flatnonzero(step == 0xFFFF)
            step[full] = self.far[_find(self.far_at, at[full])[0]]
        return self.base[at // BLOCK] + step

    @staticmethod
    def stored(starts: np.ndarray) -> dict[str, np.ndarray]:
        base = starts[::BLOCK]
        step = starts - np.repeat(base, BLOCK)[: len(starts)]
        far = np.flatnonzero(step >= 0xFFFF)
        return {"context_base": base, "context_step": np.minimum(step, 0xFFFF), "far_at": far, "far": step[far]}


def _merge_trigrams(batches: Iterator[pa.RecordBatch], folder: str, buckets: int) -> Iterator[pa.RecordBatch]:
    """Writes each range's arrays and yields what they say of single words, by the words' ranges."""
    for bucket, rows in _by_bucket(batches).items():
        local = [np.frombuffer(r["words"], "<u8") for r in rows]
        words = np.sort(np.concatenate(local))
        words = words[_runs(words)]
        parts = []
        for r, own in zip(rows, local, strict=True):
            to = np.searchsorted(words, own).astype(np.uint32)
            f, m, w, c = _unpacked_trigrams(r["rows"], r["size"])
            parts.append((to[f], to[m], to[w], c))
        rows.clear()
        f, m, w, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        c = c.astype(np.uint64)
        del parts, local
        (m, f, w), order, cut = _distinct(len(words), m, f, w)
        c = _sums(c[order], cut)
        del order, cut
        out: dict[str, np.ndarray] = {"words": words, "next": w}
        out["count"], out["over_at"], out["over"] = _bytes(c)
        context = _runs(m, f)
        starts = np.append(context, len(m))
        out["context"] = f[context]
        out |= _Starts.stored(starts)
        big = np.flatnonzero(np.diff(starts) > FEW)
        out["many"], out["many_total"] = big, _sums(c, context)[big]
        for name, x in zip(("many_n1", "many_n2", "many_n3"), _classes(c, context), strict=True):
            out[name] = x[big]
        head = _runs(m)
        out["head"], out["head_from"] = m[head], np.append(np.searchsorted(context, head), len(context))
        # pairs of middle and last word count the words before them; those at a text's beginning, their occurrences
        (pm, pw), order, pair = _distinct(len(words), m, w)
        left, pc = np.diff(np.append(pair, len(m))).astype(np.uint64), _sums(c[order], pair)
        left = np.where(words[pm] == BEGIN, pc, left)
        out["pair_next"] = pw
        out["pair_count"], out["pair_over_at"], out["pair_over"] = _bytes(left)
        heads = _runs(pm)
        out["head_pairs"] = np.append(heads, len(pm))
        big = np.flatnonzero(np.diff(out["head_pairs"]) > FEW)
        out["big"], out["big_total"] = big, _sums(left, heads)[big]
        for name, x in zip(("big_n1", "big_n2", "big_n3"), _classes(left, heads), strict=True):
            out[name] = x[big]
        for name in LONG:
            out[f"{name}_high"], out[name] = out[name] >> 16, out[name] & 0xFFFF
        stored = [out[name].astype(_kind(kind, len(words))) for name, kind in ARRAYS.items()]
        put_file(f"{folder}/trigrams-{bucket}", [np.array([len(x) for x in stored], "<u8"), *stored])
        of = [int((x == k).sum()) for x in (c, left) for k in (1, 2, 3, 4)]
        left = np.bincount(pw)
        at = np.flatnonzero(left)
        facts = np.zeros(len(at), WORD)
        facts["word"], facts["left"] = words[at], left[at]
        facts["count"] = np.bincount(pw, pc)[at]  # added as doubles, exact up to 2**53
        for to, at in _by_range(bucket_of(mixed(facts["word"]), buckets), buckets):
            yield pa.record_batch(
                [pa.array([to], pa.int32()), *(pa.array([facts[x][at].tobytes()], pa.binary()) for x in WORD.names), *(pa.array([x], pa.int64()) for x in of)],
                names=["bucket", *WORD.names, *FACTS],
            )
            of = [0] * len(of)


def _merge_words(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _by_bucket(batches).items():
        x = {name: np.concatenate([np.frombuffer(r[name], WORD[name]) for r in rows]) for name in WORD.names}
        of = [sum(r[k] for r in rows) for k in FACTS]
        order = np.argsort(x["word"], kind="stable")
        cut = _runs(x["word"][order])
        out = np.zeros(len(cut), WORD)
        out["word"] = x["word"][order[cut]]
        for name in WORD.names[1:]:
            out[name] = _sums(x[name][order], cut)
        put_file(f"{folder}/words-{bucket}", [out])
        left = out["left"]
        values = [*of, *(int((left == k).sum()) for k in (1, 2, 3, 4)), len(left), int(left.sum(dtype=np.int64)), int(out["count"].sum())]
        yield pa.record_batch([pa.array([v], pa.int64()) for v in values], names=STATS)


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more; where counts of counts are lacking, k - 1/2 k."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = [0.0]
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), start=1):
        d = k - (k + 1) * y * b / a if a and b else k / 2
        out.append(min(max(d, 0.05), k - 0.05))
    return np.array(out)


@dataclass(frozen=True)
class KneserNey:
    """A counted model: its folder, the number of hash ranges, the split words, the sums that make its discounts, the words' hash key, and which ranges have files."""

    folder: str
    buckets: int
    split: Split
    stats: dict[str, int]
    key: int = 0
    has: dict[str, np.ndarray] | None = None

    def __post_init__(self) -> None:
        if set(self.stats) != set(STATS):
            raise ValueError(f"stats must be {STATS}")


def frequent_words(texts: DataFrame, size: int, range_bytes: int, key: int, sample_bytes: int = 64 << 20) -> Split:
    """The words of at least range_bytes of the texts' size bytes, by a sample of rows of about sample_bytes, with a part
    for each range_bytes: at most size / range_bytes words."""
    share = range_bytes / max(size, 1)
    if share >= 1:
        return Split(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            token, at = tokens(b.column(0), key)
            before, _ = previous(token, at, BEGIN)
            word, n = np.unique(before, return_counts=True)
            keep = n >= share / 4 * len(before)
            yield pa.record_batch([pa.array(np.append(word[keep], np.uint64(0)).view(np.int64)), pa.array(np.append(n[keep], len(before)))], names=["word", "n"])

    fraction = min(1.0, sample_bytes / size)
    rows = texts if fraction == 1 else texts.sample(fraction, seed=11)
    counted = rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    whole = counted.where("word = 0").agg(F.sum("n")).first()[0] or 0
    found = counted.where((F.col("word") != 0) & (F.col("n") >= share * whole)).collect() if whole else []
    words, n = np.array([r["word"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(words)
    return Split(words[order], np.ceil(n[order] / (share * max(whole, 1))).astype(np.int64))


def count_model(texts: DataFrame, text_col: str = "text", most: int = 4_000_000, range_bytes: int = 32 << 20) -> KneserNey:
    """Counts all texts (null: empty). most: tokens that a task gathers before it passes distinct trigrams on. range_bytes:
    text for each hash range, which is what one task merges, so that no task grows with the input."""
    spark = texts.sparkSession
    texts = texts.select(F.col(text_col).cast("string").alias("text"))
    size, key = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), text_key(texts, "text")).first()
    key = key_of(key)
    folder, buckets = shared_dir(spark), max(1, spark.sparkContext.defaultParallelism, -(-size // range_bytes))
    split = frequent_words(texts, size, max(1, range_bytes // 2), key)
    rows = texts.mapInArrow(lambda it: _count(it, buckets, split, most, key), BLOBS)
    facts = ", ".join(["bucket int", *(f"{x} binary" for x in WORD.names), *(f"{x} long" for x in FACTS)])
    words = rows.repartitionById(buckets, F.col("bucket")).mapInArrow(lambda it: _merge_trigrams(it, folder, buckets), facts)
    sums = words.repartitionById(buckets, F.col("bucket")).mapInArrow(lambda it: _merge_words(it, folder), ", ".join(f"{x} long" for x in STATS))
    row = sums.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in STATS]).first()
    names = file_names(folder)
    has = {kind: np.array([f"{kind}-{k}" in names for k in range(buckets)]) for kind in ("trigrams", "words")}
    if row["types"] and not (has["trigrams"].any() and has["words"].any()):
        raise FileNotFoundError(f"the model's files are not in {folder}; driver and executors must share that folder")
    return KneserNey(folder, buckets, split, row.asDict(), key, has)


_MAPPED: dict[str, np.ndarray | dict[str, np.ndarray]] = {}


def _opened(model: KneserNey, file: str, bucket: int) -> np.ndarray | dict[str, np.ndarray] | None:
    """The arrays of a range's file; None where no training text has anything of this range."""
    if not model.has[file][bucket]:
        return None
    uri = f"{model.folder}/{file}-{bucket}"
    if uri not in _MAPPED:
        if len(_MAPPED) > 20_000:
            _MAPPED.clear()
        raw = map_file(uri)
        if raw is None:
            raise FileNotFoundError(uri)
        raw = np.asarray(raw)  # plain views of the mapped bytes, which index faster
        if file == "words":
            _MAPPED[uri] = raw.view(WORD)
        else:
            arrays, at = {}, 8 * len(ARRAYS)
            sizes = raw[:at].view("<u8").tolist()
            for (name, kind), n in zip(ARRAYS.items(), sizes, strict=True):
                dtype = np.dtype(_kind(kind, sizes[0]))
                end = at + n * dtype.itemsize
                arrays[name] = raw[at:end].view(dtype)
                at = end
            arrays |= {name: _Places(arrays[name], arrays[f"{name}_high"]) for name in LONG}
            arrays["context_from"] = _Starts(arrays)
            _MAPPED[uri] = arrays
    return _MAPPED[uri]


def _counts_at(t: dict[str, np.ndarray], name: str, at: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Exact counts at the places that are ok, else 0; name: "" of trigrams, "pair_" of pairs."""
    out = np.zeros(len(at), np.int64)
    out[ok] = t[f"{name}count"][at[ok]]
    full = np.flatnonzero(out == 255)
    place, _ = _find(t[f"{name}over_at"], at[full])
    out[full] = t[f"{name}over"][place]
    return out


def _totals(t: dict[str, np.ndarray], kind: str, big: str, at: np.ndarray, low: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Of each row the total and how many are 1, 2, and 3 or more of the counts from low to up: few of them are added up here,
    totals of more are stored, by place `at`."""
    out = np.zeros((len(at), 4), np.int64)
    size = up - low
    for k in range(FEW):
        live = np.flatnonzero((size > k) & (size <= FEW))
        one = _counts_at(t, kind, low[live] + k, np.ones(len(live), bool))
        out[live, 0] += one
        out[live, np.minimum(one, 3)] += 1
    large = np.flatnonzero(size > FEW)
    to, _ = _find(t[big], at[large])
    for k, name in enumerate(("total", "n1", "n2", "n3")):
        out[large, k] = t[f"{big}_{name}"][to]
    return out


@dataclass
class _Shared:
    """Totals that many rows share: of each row the place of its own, the first of which are zeros."""

    of: np.ndarray
    totals: list[np.ndarray]
    size: int = 1

    def put(self, rows: np.ndarray, at: np.ndarray, totals: np.ndarray) -> None:
        self.of[rows] = self.size + at
        self.totals.append(totals)
        self.size += len(totals)

    def whole(self) -> np.ndarray:
        return np.concatenate(self.totals)


def _spread(cut: np.ndarray, n: int) -> np.ndarray:
    """The number of the run that each of n rows is in, from where runs begin."""
    return np.repeat(np.arange(len(cut)), np.diff(np.append(cut, n)))


def _look_up(model: KneserNey, words: np.ndarray, first: np.ndarray, middle: np.ndarray, last: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, _Shared, _Shared]:
    """Of each row in its range: the counts of the trigram and of the pair, and of their contexts (first, middle) and
    middle the total and how many counts are 1, 2, and 3 or more. Rows hold places in the sorted words; rows in order
    make the reading of a file's arrays go forwards, and contexts and middle words are looked up once each."""
    n = len(where)
    high, mid = np.zeros(n, np.int64), np.zeros(n, np.int64)
    contexts, heads = (_Shared(np.zeros(n, np.int64), [np.zeros((1, 4), np.int64)]) for _ in range(2))
    place = np.zeros(len(words), np.uint32)
    for bucket, rows in _by_range(where, model.buckets):
        t = _opened(model, "trigrams", bucket)
        if t is None:
            continue
        f, m, w = first[rows], middle[rows], last[rows]
        asked = _seen(len(words), f, m, w)
        at, ok = _find(t["words"], words[asked])
        place[asked] = np.where(ok, at, NONE)
        f, m, w = place[f], place[m], place[w]
        cut = _runs(m)
        h, ok = _find(t["head"], m[cut])
        low, up = (np.where(ok, t["head_pairs"][h + k], 0).astype(np.int64) for k in (0, 1))
        of = _spread(cut, len(m))
        heads.put(rows, of, _totals(t, "pair_", "big", h, low, up))
        at, found = _find_within(t["pair_next"], low[of], up[of], w)
        mid[rows] = _counts_at(t, "pair_", at, found)
        low, up = (np.where(ok, t["head_from"][h + k], 0).astype(np.int64) for k in (0, 1))
        cut = _runs(m, f)
        at, ok = _find_within(t["context"], low[of[cut]], up[of[cut]], f[cut])
        low, up = (np.where(ok, t["context_from"][at + k], 0) for k in (0, 1))
        of = _spread(cut, len(m))
        contexts.put(rows, of, _totals(t, "", "many", at, low, up))
        at, found = _find_within(t["next"], low[of], up[of], w)
        high[rows] = _counts_at(t, "", at, found)
    return high, mid, contexts, heads


def _totals_of_split(model: KneserNey, words: np.ndarray, first: np.ndarray, middle: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and head totals of split middle words, summed over their ranges."""
    row = np.repeat(np.arange(len(parts)), parts)
    where = model.split.ranges(words[middle[row]], np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts), model.buckets)
    _, once = np.unique(row * model.buckets + where, return_index=True)  # two parts may share a range
    row, where = row[once], where[once]
    _, _, contexts, heads = _look_up(model, words, first[row], middle[row], middle[row], where)
    cut = _runs(row)
    c, h = (np.add.reduceat(x.whole()[x.of], cut) for x in (contexts, heads))
    return c, h


def _step(count: np.ndarray, shared: _Shared, d: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The interpolated probability of one level above `below`."""
    total, *of = shared.whole().T
    spare = np.where(total > 0, sum(x * y for x, y in zip(of, d[1:], strict=True)) / np.maximum(total, 1), 1.0)
    return (count - d[np.minimum(count, 3)]) / np.maximum(total, 1)[shared.of] + spare[shared.of] * below


def log_probabilities(model: KneserNey, token: np.ndarray, before: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's interpolated probability after the two tokens before it, and its training count."""
    words, ids = numbered(np.concatenate((twice, before, token)))
    return _log_probabilities(model, words, *ids.reshape(3, -1))


def _log_probabilities(model: KneserNey, words: np.ndarray, first: np.ndarray, middle: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by places in the sorted words."""
    s = model.stats
    d3, d2, d1 = (discounts(*(s[f"{x}{k}"] for k in (1, 2, 3, 4))) for x in "tpw")
    found = np.zeros(len(words), WORD)
    for bucket, rows in _by_range(bucket_of(mixed(words), model.buckets), model.buckets):
        if (table := _opened(model, "words", bucket)) is not None:
            place, ok = _find(table["word"], words[rows])
            found[rows[ok]] = table[place[ok]]
    times = found["count"].astype(np.int64)[last]
    left, lefts = found["left"], max(1, s["lefts"])
    w3 = s["types"] - s["w1"] - s["w2"]
    spare = (d1[1] * s["w1"] + d1[2] * s["w2"] + d1[3] * w3) / lefts if s["lefts"] else 1.0
    low = (left - d1[np.minimum(left, 3)]) / lefts + spare / (s["types"] + 1)
    (middle, first, last), order, cut = _distinct(len(words), middle, first, last)
    back = np.empty(len(order), np.int64)
    back[order] = _spread(cut, len(order))
    high, mid, contexts, heads = _look_up(model, words, first, middle, last, model.split.route(words, middle, last, model.buckets))
    parts = model.split.of(words)[middle]
    if (cut := np.flatnonzero(parts)).size:
        one = _runs(middle[cut], first[cut])
        c, h = _totals_of_split(model, words, first[cut[one]], middle[cut[one]], parts[cut[one]])
        again = _spread(one, len(cut))
        contexts.put(cut, again, c)
        heads.put(cut, again, h)
    p = _step(high, contexts, d3, _step(mid, heads, d2, low[last]))
    return np.log10(p)[back], times


def score_texts(df: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row; a null text is empty (one end token).
    Null ids and repeated rows are scored like any row; other columns are left out."""
    n, v = model.stats["train_tokens"], model.stats["types"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            token, at = tokens(b.column(1), model.key)
            words, ids = numbered(np.append(token, BEGIN))
            before, twice = previous(ids[:-1], at, ids[-1])
            logp, count = _log_probabilities(model, words, twice, before, ids[:-1])
            size, score = np.diff(at), sum_by(logp, at)
            base = sum_by(np.log10((count + 1) / (n + v + 1)), at)
            known = sum_by(count > 0, at).astype(np.int64)
            yield pa.record_batch(
                [b.column(0), pa.array(size), pa.array(known), pa.array(np.full(len(size), n)), pa.array(base), pa.array(score), pa.array(10 ** (-score / size))],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    )
