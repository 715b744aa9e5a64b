"""SimHash near-duplicates: shingle fingerprints, then a binary-trie self-join within a Hamming budget.

The fingerprints of all texts are distinct-ed first, so copies cost one trie entry. Two fingerprints within 2 bits
agree in one of three blocks of 21 bits at least; each fingerprint is entered in three tries, one for each block turned
to the front, and a traversal starts at the node pairs (node, node) that share the block. A start node with more than
`leaf` fingerprints is first split in Spark into pairs of deeper nodes, as often as needed, so that no task holds an
unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import LOWER, SPACE, joined, pieces, spans, written
from barloom.llm.graph import components

BLOCK = 21  # bits that start nodes share
STEP = 6  # bits by which Spark splits a large node pair
ROWS = 1_000_000  # values of a task that walks tries
PAIRS = 1 << 20  # values compared outright at a time

# Constants of the public XXH64 specification (fixed values)
P1, P2, P3, P4, P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: bytes, begin: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte spans of data at once: one numpy step for each lane, over the spans that have it."""
    buffer = data + bytes(8)
    lane8 = np.ndarray(len(data) + 1, "<u8", buffer, strides=(1,))
    lane4 = np.ndarray(len(data) + 1, "<u4", buffer, strides=(1,))
    size, at = end - begin, begin.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        h = np.full(len(size), np.uint64(seed) + P5, np.uint64)
        if (long := np.flatnonzero(size >= 32)).size:
            acc = [np.full(len(long), np.uint64((seed + k) % (1 << 64)), np.uint64) for k in (int(P1) + int(P2), int(P2), 0, -int(P1))]
            for k in range(int(size[long].max()) // 32):
                live = np.flatnonzero(size[long] >= 32 * (k + 1))
                for i in range(4):
                    acc[i][live] = _rotl(acc[i][live] + lane8[at[long[live]] + 8 * i] * P2, 31) * P1
                at[long[live]] += 32
            total = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for x in acc:
                total = (total ^ (_rotl(x * P2, 31) * P1)) * P1 + P4
            h[long] = total
        h += size.astype(np.uint64)
        while (live := np.flatnonzero(end - at >= 8)).size:
            h[live] = _rotl(h[live] ^ (_rotl(lane8[at[live]] * P2, 31) * P1), 27) * P1 + P4
            at[live] += 8
        if (live := np.flatnonzero(end - at >= 4)).size:
            h[live] = _rotl(h[live] ^ (lane4[at[live]].astype(np.uint64) * P1), 23) * P2 + P3
            at[live] += 4
        raw = np.frombuffer(buffer, np.uint8)
        while (live := np.flatnonzero(end > at)).size:
            h[live] = _rotl(h[live] ^ (raw[at[live]].astype(np.uint64) * P5), 11) * P1
            at[live] += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def shingle_hashes(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each word shingle of all texts, repeats included, and where each text's begin, with the end of all."""
    data, starts = joined(column)
    raw = LOWER[np.frombuffer(data, np.uint8)]
    begin, end, first = spans(~SPACE[raw], starts)
    # the words of all texts, each followed by one space
    size = end - begin
    place = np.concatenate(([0], np.cumsum(size + 1)))
    flat = np.full(int(place[-1]), 32, np.uint8)
    keep = ~SPACE[raw]
    flat[np.arange(int(keep.sum())) + np.repeat(np.arange(len(size)), size)] = raw[keep]
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    at = np.concatenate(([0], np.cumsum(count)))
    head = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], count)
    tail = np.minimum(head + shingle, np.repeat(first[1:], count))
    return xxh64(flat.tobytes(), place[head], place[tail] - 1), at


def fingerprints(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text's word shingles, repeats included; 0 if it has no word."""
    hashes, at = shingle_hashes(column, shingle)
    count = np.diff(at)
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if not some.size:
        return out
    ones = np.zeros((len(some), 64), np.int64)
    step = 1 << 17  # hashes whose bits are laid out at a time
    owner = np.repeat(np.arange(len(some)), count[some])
    for k in range(0, len(hashes), step):
        part = owner[k : k + step]
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        bits = np.unpackbits(hashes[k : k + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[part[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    out[some] = np.packbits(ones * 2 > count[some, None], axis=1).view(">u8").ravel()
    return out


def trie_links(
    value: np.ndarray,
    low: np.ndarray,
    high: np.ndarray,
    low2: np.ndarray,
    high2: np.ndarray,
    errors: np.ndarray,
    depth: np.ndarray,
    budget: int = 2,
    leaf: int = 4,
    width: int = 64,
    near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None,
    label: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of `value` that differ in `budget` of the upper `width` bits at most, by walking pairs of trie nodes together.

    value is sorted within each node's range, so a node is a range and its children are the ranges left and right of a
    searched split. Each start pair is ([low, high), [low2, high2)) with the bits above `depth` done and `errors` of
    them different; a node paired with itself has both ranges equal. A pair splits into its children's pairs, of which those on different bits cost one error, and is dropped when the
    budget is passed. Pairs of at most `leaf` values a side, or without bits left, are compared outright; near(a, b)
    may be a stricter rule for them. label: groups known already; node pairs that lie within one are dropped.
    """
    left, right = [], []
    one, top, unused = np.uint64(1), np.uint64(63), np.uint64(64 - width)
    changes = None if label is None else np.cumsum(np.concatenate(([0], label[1:] != label[:-1]))) if len(label) else np.zeros(0, int)

    def compare(l1: np.ndarray, h1: np.ndarray, l2: np.ndarray, h2: np.ndarray) -> None:
        many = (h1 - l1) * (h2 - l2)
        at = 0
        while at < len(many):  # a bounded number of pairs at a time
            to = max(at + 1, int(np.searchsorted(np.cumsum(many[at:]), PAIRS, "right")) + at)
            size = many[at:to]
            if to == at + 1 and size[0] > PAIRS and h1[at] - l1[at] > 1:
                rows = max(1, PAIRS // int(h2[at] - l2[at]))
                for i in range(int(l1[at]), int(h1[at]), rows):
                    pairs(np.array([i]), np.array([min(i + rows, h1[at])]), l2[at:to], h2[at:to])
            else:
                pairs(l1[at:to], h1[at:to], l2[at:to], h2[at:to])
            at = to

    def pairs(l1: np.ndarray, h1: np.ndarray, l2: np.ndarray, h2: np.ndarray) -> None:
        wide = h2 - l2
        size = (h1 - l1) * wide
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        a, b = np.repeat(l1, size) + inner // np.repeat(wide, size), np.repeat(l2, size) + inner % np.repeat(wide, size)
        ok = a < b
        if label is not None:
            ok &= label[a] != label[b]
        a, b = a[ok], b[ok]
        ok = np.bitwise_count((value[a] ^ value[b]) >> unused) <= budget
        a, b = a[ok], b[ok]
        if near is not None:
            ok = near(a, b)
            a, b = a[ok], b[ok]
        left.append(a)
        right.append(b)

    while len(low):
        if changes is not None:
            mixed_ = (changes[low] != changes[high - 1]) | (changes[low2] != changes[high2 - 1]) | (label[low] != label[low2])
            low, high, low2, high2, errors, depth = (x[mixed_] for x in (low, high, low2, high2, errors, depth))
        small = ((high - low <= leaf) & (high2 - low2 <= leaf)) | (depth >= width)
        if small.any():
            compare(low[small], high[small], low2[small], high2[small])
            go = ~small
            low, high, low2, high2, errors, depth = (x[go] for x in (low, high, low2, high2, errors, depth))
            continue
        bit = top - depth.astype(np.uint64)

        def split(lo: np.ndarray, hi: np.ndarray, bit: np.ndarray = bit) -> np.ndarray:
            """Where the node's values begin to have the bit, by one binary search for all nodes."""
            lo, hi = lo.copy(), hi.copy()
            while (live := np.flatnonzero(lo < hi)).size:
                mid = (lo[live] + hi[live]) >> 1
                has = (value[mid] >> bit[live]) & one == one
                hi[live[has]] = mid[has]
                lo[live[~has]] = mid[~has] + 1
            return lo

        same = low == low2
        cut, cut2 = split(low, high), split(low2, high2)
        every = np.ones(len(low), bool)
        both = ((low, cut, low2, cut2, errors, every), (cut, high, cut2, high2, errors, every), (low, cut, cut2, high2, errors + 1, every), (cut, high, low2, cut2, errors + 1, ~same))
        parts = [[], [], [], [], [], []]
        for a, b, c, d, e, ok in both:
            ok = ok & (a < b) & (c < d) & (e <= budget) & ((a != c) | (b - a > 1))
            for store, x in zip(parts, (a, b, c, d, e, depth + 1), strict=True):
                store.append(x[ok])
        low, high, low2, high2, errors, depth = (np.concatenate(x) for x in parts)
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes the least node of each one's component."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _solve(batches: Iterator[pa.RecordBatch], budget: int, width: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Links among the node pairs of one partition, as stars: no more rows than fingerprints came in.

    limit: links must also differ in no more bits of the print columns after the six of NODES. Neighbours in a node's
    order are compared first, so that the walk passes over groups of copies that they tie together.
    """
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    node, side, value, rep, errors, depth, *prints = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(got[0].num_columns))
    value = value.view(np.uint64)
    order = np.lexsort((value, side, node))
    node, side, value, rep, errors, depth = (x[order] for x in (node, side, value, rep, errors, depth))
    prints = [x[order].view(np.uint64) for x in prints]
    names, number = np.unique(rep, return_inverse=True)  # a text may stand in several nodes of the partition

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if limit is None:
            return np.ones(len(a), bool)
        return sum(np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in prints) <= limit

    first = np.concatenate(([True], (node[1:] != node[:-1]) | (side[1:] != side[:-1])))
    new = np.flatnonzero(first)
    end = np.append(new[1:], len(node))
    beside = np.flatnonzero(~first)
    beside = beside[np.bitwise_count((value[beside] ^ value[beside - 1]) >> np.uint64(64 - width)) <= budget]
    beside = beside[near(beside, beside - 1)]
    label = _forest(number[beside], number[beside - 1], len(names))
    alone = side[new] == 0
    paired = np.flatnonzero((side[new][:-1] == 1) & (side[new][1:] == 2) & (node[new][:-1] == node[new][1:]))
    low = np.concatenate((new[alone], new[paired]))
    high = np.concatenate((end[alone], end[paired]))
    low2 = np.concatenate((new[alone], new[paired + 1])) if len(new) else low
    high2 = np.concatenate((end[alone], end[paired + 1])) if len(new) else high
    more = (high - low > 1) | (low != low2)
    low, high, low2, high2 = (x[more] for x in (low, high, low2, high2))
    a, b = trie_links(value, low, high, low2, high2, errors[low], depth[low], budget, width=width, near=near, label=label[number])
    label = _forest(np.concatenate((number[a], number[beside])), np.concatenate((number[b], number[beside - 1])), len(names))
    far = np.flatnonzero(label != np.arange(len(names)))
    yield pa.record_batch([pa.array(names[far]), pa.array(names[label[far]])], names=["a", "b"])


NODES = "node long, side int, value long, rep long, errors int, depth int"


def trie_join(nodes: DataFrame, budget: int, leaf: int = 50_000, width: int = 64, limit: int | None = None) -> DataFrame:
    """Links (a, b) that connect whatever reps the start nodes (columns of NODES, then prints) connect within the budget.

    Start nodes of more than `leaf` values are split in Spark, STEP bits at a time, while bits are left; tasks get about
    `ROWS` values each, however many there are.
    """
    conf = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = []
    while True:
        sizes = written(nodes.groupBy("node").agg(F.count("*").alias("n"), F.max("depth").alias("d")))
        large = sizes.where(f"n > {leaf} and d + {STEP} <= {width}").select("node")
        total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        parts = max(conf, -(-total // ROWS))
        last = large.isEmpty()
        done.append((nodes if last else nodes.join(large, "node", "left_anti"), parts))
        if last:
            break
        nodes = written(_deeper(nodes.join(large, "node", "left_semi"), budget))
    out = None
    for x, parts in done:
        part = x.repartition(parts, "node").mapInArrow(lambda it: _solve(it, budget, width, limit), "a long, b long")
        out = part if out is None else out.unionByName(part)
    return out


def near_links(prints: DataFrame, budget: int = 2, leaf: int = 50_000) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints prints(fp long, rep long) within `budget` <= 2 bits connect."""
    if not 0 <= budget <= 2:
        raise ValueError("three blocks find differences of up to 2 bits")
    turn = lambda r: F.shiftleft("fp", r).bitwiseOR(F.shiftrightunsigned("fp", 64 - r)) if r else F.col("fp")
    nodes = prints.select("rep", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), turn(r).alias("value")) for k, r in enumerate((0, BLOCK, 2 * BLOCK))])).alias("t")).select(
        F.xxhash64("t.k", F.shiftrightunsigned("t.value", 64 - BLOCK)).alias("node"), F.lit(0).alias("side"), "t.value", "rep", F.lit(0).alias("errors"), F.lit(BLOCK).alias("depth")
    )
    return trie_join(nodes, budget, leaf)


def _deeper(nodes: DataFrame, budget: int) -> DataFrame:
    """Each value under the pairs of nodes STEP bits deeper in which it can still have a partner."""
    own = F.shiftrightunsigned(F.expr("shiftleft(value, depth)"), 64 - STEP).cast("int")
    flips = F.array(*[F.lit(x) for x in range(1 << STEP) if x.bit_count() <= budget])
    x = nodes.withColumn("own", own).withColumn("flip", F.explode(flips)).withColumn("other", F.col("own").bitwiseXOR(F.col("flip"))).withColumn("errors", (F.col("errors") + F.bit_count("flip")).cast("int")).where(f"errors <= {budget}")
    first = (F.col("side") == 1) | ((F.col("side") == 0) & (F.col("own") <= F.col("other")))
    side = F.when((F.col("side") == 0) & (F.col("flip") == 0), 0).when(first, 1).otherwise(2)
    one, two = F.when(first, F.col("own")).otherwise(F.col("other")), F.when(first, F.col("other")).otherwise(F.col("own"))
    return x.select(F.xxhash64("node", one, two, "errors").alias("node"), side.cast("int").alias("side"), "value", "rep", "errors", (F.col("depth") + STEP).cast("int").alias("depth"), *nodes.columns[6:])


def simhash_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; null and word-less texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield pa.record_batch([b.column(0), pa.array(fingerprints(b.column(1), shingle).view(np.int64))], names=["doc_id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2, leaf: int = 50_000) -> DataFrame:
    """One row for each row of df: doc_id, fingerprint (16 hex digits), component_id (least doc_id that links reach).

    Null and word-less texts have fingerprint zero and link like any other. Repeated rows give repeated rows. A row
    with a null id keeps its fingerprint and takes its component from the others. Other columns are not read.
    """
    table = written(simhash_table(df, id_col, text_col, shingle))
    prints = written(table.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = components(near_links(prints.where("rep is not null"), budget, leaf))
    named = prints.join(comp, prints["rep"] == comp["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return table.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """The rows of df without near-duplicates: of each group the row of the least id stays, with all its columns.

    Ids are keys: rows that repeat an id share one fate. Rows with a null id stay.
    """
    groups = simhash_groups(df, id_col, text_col, shingle, budget)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return df.join(gone, df[id_col].cast("long") == gone["__gone"], "left_anti")
