"""Near-copies by the Jaccard similarity of word shingles: candidates by the trie self-join of simhash.py, then exact checks.

Each text gets a SimHash of 512 bits whose bits vote over one shingle each, the least-hashed one of a bin: two texts then
differ in (1 - J) / 2 of the bits, 10 % at J = 0.8, where SimHash bits that all shingles vote on differ in 15 %. The bits
are dealt to `TABLES` tries of `BITS` bits; a pair is found if one of these differs in 2 bits at most (99.99 % of pairs of J
= 0.8, more of closer ones), and kept if no more than `LIMIT` of the first 256 bits do. Groups of candidates are then checked
on the whole shingle sets, in blocks of a bounded size, so no link is made below the similarity asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import LOWER, SPACE, join_hot, joined, key_of, mixed, pieces, span_hashes, spans, text_key, written
from barloom.llm.graph import components
from barloom.llm.simhash import _forest, trie_join

BINS = 512
WORDS, COMPARED = BINS // 64, 4  # 64-bit words of a print, and those that candidates are compared on
PRINT = [f"f{k}" for k in range(WORDS)]
TABLES, BITS, BUDGET = 18, 28, 2
STARTS = (0, 10, 19)  # start blocks of a table's bits: 10, 9 and 9, of which one is equal if 2 bits differ
LIMIT = 44  # of 256 bits, those of the words compared; at J = 0.8 the mean is 25.6 and the deviation 4.8
LEAST = 32  # least-hashed shingles that stand in for those of empty bins
MASK = np.uint64((1 << 48) - 1)
PRIME = np.uint64(0x9E3779B97F4A7C15)
BLOCK_DOCS, BLOCK_ITEMS = 2048, 2_000_000  # bounds of a block of texts that are checked together
FEW = 1_000_000  # up to so many candidates (24 bytes each) are broadcast


def shingle_sets(column: pa.Array, shingle: int = 5, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes (48 bits) of up to 65,536 texts and where each text's begin, with the end of all.

    A text under `shingle` words is one shingle; a word-less text has one of its own.
    """
    data, starts = joined(column)
    raw = LOWER[np.frombuffer(data, np.uint8)]
    begin, end, first = spans(~SPACE[raw], starts)
    word = span_hashes(raw, begin, end, key)
    words = np.diff(first)
    count = np.maximum(words - shingle + 1, 1)
    at = np.concatenate(([0], np.cumsum(count)))
    owner = np.repeat(np.arange(len(words)), count)
    head = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], count)
    tail = first[1:][owner]
    padded = np.concatenate((word, np.zeros(shingle, np.uint64)))
    total = np.zeros(len(head), np.uint64)
    for k in range(shingle):
        total = mixed(total * PRIME + np.where(head + k < tail, padded[head + k], np.uint64(0)))
    keys = np.sort(owner.astype(np.uint64) << np.uint64(48) | total >> np.uint64(16))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    return keys & MASK, np.searchsorted(keys >> np.uint64(48), np.arange(len(words) + 1, dtype=np.uint64))


def digests(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes + np.uint64(1)), dtype=np.uint64)))
    return mixed(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64))


def sampled_prints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """WORDS 64-bit words of BINS bits for each set: bit j is a hash bit of the least shingle in bin j (by the upper 9 bits).

    An empty bin takes the shingle that is least by a hash of its own, among the set's LEAST least shingles.
    """
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    bin_ = (hashes >> np.uint64(48 - BINS.bit_length() + 1)).astype(np.int64)
    place = owner * BINS + bin_
    head = np.flatnonzero(np.diff(place, prepend=-1))
    value = np.zeros(n * BINS, np.uint64)
    value[place[head]] = mixed(hashes[head] + bin_[head].astype(np.uint64) * PRIME)
    full = np.zeros(n * BINS, bool)
    full[place[head]] = True
    value, full = value.reshape(n, BINS), full.reshape(n, BINS)
    lacking = np.flatnonzero(~full.all(axis=1))
    some = at[lacking][:, None] + np.minimum(np.arange(LEAST), (np.diff(at)[lacking] - 1)[:, None])
    few = hashes[some] if len(lacking) else np.zeros((0, LEAST), np.uint64)
    salts = np.arange(BINS, dtype=np.uint64) * PRIME
    for j in range(BINS):
        rows = np.flatnonzero(~full[lacking, j])
        if rows.size:
            value[lacking[rows], j] = mixed(few[rows] + salts[j]).min(axis=1)
    return np.packbits((value & np.uint64(1)).astype(np.uint8), axis=1).view(">u8").astype(np.uint64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", 4 << 20):
        for i in range(0, b.num_rows, 4096):
            yield b.slice(i, 4096)


def prints(docs: DataFrame, shingle: int, key: int) -> DataFrame:
    """(doc_id, digest, size, *PRINT) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            hashes, at = shingle_sets(b.column(1), shingle, key)
            f = sampled_prints(hashes, at).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(digests(hashes, at).view(np.int64)), pa.array(np.diff(at).astype(np.int64)), *(pa.array(f[:, k]) for k in range(WORDS))], names=["doc_id", "digest", "size", *PRINT])

    return docs.mapInArrow(run, f"doc_id long, digest long, size long, {', '.join(f'{c} long' for c in PRINT)}")


def start_nodes(reps: DataFrame) -> DataFrame:
    """The trie entries of reps(rep, *PRINT): one for each table and start block, for trie_join()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            f = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(1, WORDS + 1)], axis=1).view(np.uint64)
            bits = np.unpackbits(f.astype(">u8").view(np.uint8).reshape(len(f), -1), axis=1)
            for t in range(TABLES):
                own = bits[:, t * BITS : (t + 1) * BITS]
                for k, (start, stop) in enumerate(zip(STARTS, (*STARTS[1:], BITS), strict=True)):
                    wide = np.zeros((len(f), 64), np.uint8)
                    wide[:, :BITS] = np.roll(own, -start, axis=1)
                    value = np.packbits(wide, axis=1).view(">u8").ravel().astype(np.uint64)
                    block = value >> np.uint64(64 - (stop - start))
                    node = mixed(block * np.uint64(64) + np.uint64(3 * t + k)).view(np.int64)
                    same = lambda x: pa.array(np.full(len(f), x, np.int32))  # noqa: B023, E731
                    yield pa.record_batch([pa.array(node), same(0), pa.array(value.view(np.int64)), b.column(0), same(0), same(stop - start), *b.columns[1:5]], names=["node", "side", "value", "rep", "errors", "depth", "f0", "f1", "f2", "f3"])

    return reps.select("rep", *PRINT).mapInArrow(run, "node long, side int, value long, rep long, errors int, depth int, f0 long, f1 long, f2 long, f3 long")


def _similar(items: list[np.ndarray], least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets whose Jaccard similarity is `least` or more; sets as sorted distinct arrays."""
    size = np.array([len(x) for x in items])
    owner = np.repeat(np.arange(len(items)), size)
    _, item, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[item] > 1)  # others are in no intersection
    order = shared[np.argsort(item[shared], kind="stable")]
    column = np.cumsum(np.diff(item[order], prepend=-1) != 0) - 1
    row, wide = owner[order], max(64, (1 << 22) // len(items))
    both = np.zeros((len(items), len(items)), np.float32)
    for k in range(0, int(column.max(initial=-1)) + 1, wide):
        a, b = np.searchsorted(column, (k, k + wide))
        there = np.zeros((len(items), int(column[b - 1]) + 1 - k), np.float32)
        there[row[a:b], column[a:b] - k] = 1
        both += there @ there.T
    every = size[:, None] + size[None] - both
    one, two = np.nonzero(np.triu(both * least.denominator >= every * least.numerator, 1))
    return one, two


def _checked(batches: Iterator[pa.RecordBatch], least: Fraction) -> Iterator[pa.RecordBatch]:
    """Links among each block's texts, as stars; blocks come one after the other."""

    def solve(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        rep = np.concatenate([b.column(1).to_numpy() for b in block])
        order = np.argsort(rep)
        items = [x for b in block for x in np.split(b.column(2).flatten().to_numpy(), np.cumsum(b.column(2).value_lengths().to_numpy())[:-1])]
        a, b = _similar([items[i] for i in order], least)
        label, rep = _forest(a, b, len(rep)), rep[order]
        far = np.flatnonzero(label != np.arange(len(rep)))
        return pa.record_batch([pa.array(rep[far]), pa.array(rep[label[far]])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if held and held[0].column(0)[0].as_py() != key[i]:
                yield solve(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield solve(held)


def _blocks(texts: Column, items: Column) -> Column:
    """How many blocks so many texts with so many shingles are dealt into."""
    return F.ceil(F.greatest(texts / BLOCK_DOCS, items / BLOCK_ITEMS)).cast("int")


def _each(count: Column, *of: Callable[[Column], Column]) -> Column:
    """The keys of the blocks 0 to count - 1."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.xxhash64(*[f(k) for f in of]))


def _linked(docs: DataFrame, wanted: DataFrame, at: Column, shingle: int, least: Fraction, key: int) -> DataFrame:
    """Links among the texts of wanted(doc_id, size, ...) that go to a block together; `at` holds the keys of a text's blocks."""
    spark = docs.sparkSession
    n, items = wanted.agg(F.count("*"), F.coalesce(F.sum(F.col("size") * F.size(at)), F.lit(0))).first()
    texts = docs.join(F.broadcast(wanted) if n <= FEW else wanted, "doc_id").groupBy(*wanted.columns).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            hashes, starts = shingle_sets(b.column(2), shingle, key)
            sets = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.record_batch([b.column(0), b.column(1), sets], names=["doc_id", "at", "items"])

    sets = texts.select("doc_id", at.alias("at"), "text").mapInArrow(run, "doc_id long, at array<long>, items array<long>")
    dealt = sets.select(F.explode("at").alias("block"), F.col("doc_id").alias("rep"), "items")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items // BLOCK_ITEMS))
    return dealt.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(lambda it: _checked(it, least), "a long, b long")


def checked_links(docs: DataFrame, reps: DataFrame, groups: DataFrame, shingle: int, least: Fraction, key: int) -> DataFrame:
    """Links (a, b) that connect all texts of a group (node, component) that links of similarity `least` or more connect.

    A group is dealt into blocks of bounded size. First each block is checked for itself, with the group's least text: near-copies
    of that text are settled by it, and sent once. Where a group of several blocks is in more than one part after that, whatever else
    links two parts has an end outside the largest one: texts outside it are checked with each other and with it, each two
    blocks together. No task holds more than two blocks, or a block and the least text.
    """
    sized = written(groups.join(reps.groupBy(F.col("rep").alias("node")).agg(F.max("size").alias("size")), "node").select(F.col("node").alias("doc_id"), "component", "size"))
    total = sized.count()
    dealt = sized.groupBy("component").agg(F.count("*").alias("n"), _blocks(F.count("*"), F.sum("size")).alias("blocks"))
    members = written(join_hot(sized, dealt, "component", "n", total))
    group, own = (lambda _: F.col("component")), lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    home = F.when(F.col("doc_id") == F.col("component"), _each(F.col("blocks"), group, lambda k: k)).otherwise(F.array(F.xxhash64("component", own("blocks"))))
    links = written(_linked(docs, members, home, shingle, least, key))

    large = members.where("blocks > 1").drop("blocks")
    if large.isEmpty():
        return links
    known = written(components(links.join(large.select(F.col("doc_id").alias("a")), "a", "left_semi")))
    parted = written(large.join(known.select(F.col("node").alias("doc_id"), F.col("component").alias("part")), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id")))
    parts = parted.groupBy("component", "part").agg(F.count("*").alias("n"), F.sum("size").alias("items"))
    most = F.max(F.struct("n", (-F.col("part")).alias("low"), "items"))
    facts = parts.groupBy("component").agg(F.sum("n").alias("n"), F.sum("items").alias("items"), most.alias("most")).where("n > most.n")
    facts = facts.select("component", "n", (-F.col("most.low")).alias("largest"), _blocks(F.col("most.n"), F.col("most.items")).alias("inner"), _blocks(F.col("n") - F.col("most.n"), F.col("items") - F.col("most.items")).alias("outer"))
    open_ = written(join_hot(parted, facts, "component", "n", total))
    if open_.isEmpty():
        return links
    outside = F.array_remove(F.sequence(F.lit(0), F.col("outer") - 1), own("outer"))
    pairs = F.transform(outside, lambda k: F.xxhash64("component", F.least(k, own("outer")), F.greatest(k, own("outer"))))
    with_inner = _each(F.col("inner"), group, lambda _: own("outer"), lambda k: -1 - k)
    with_outer = _each(F.col("outer"), group, lambda k: k, lambda _: -1 - own("inner"))
    cells = F.when(F.col("part") == F.col("largest"), with_outer).otherwise(F.concat(pairs, with_inner))
    return links.unionByName(_linked(docs, open_, cells, shingle, least, key))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: str = "0.8") -> DataFrame:
    """(doc_id, component_id) of every row with an id: the least id that links of Jaccard similarity `least` or more reach.

    A link is missed only if the tries miss it, which the module's docstring puts at under 1 % for J of 0.8 or more;
    none is made that is not similar enough. Texts under `shingle` words are one shingle; null and word-less texts are
    copies of each other. Repeats stay repeats; of differing texts with one id the least is compared. Sets are told apart by 64-bit hashes,
    shingles by 48 bits, keyed by all texts together.
    """
    t = Fraction(least)
    if not 0 < t <= 1:
        raise ValueError("the similarity must be above 0 and at most 1")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    key = key_of(docs.agg(text_key(docs, "text")).first()[0])
    table = written(prints(docs, shingle, key))
    reps = written(table.groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in ("size", *PRINT)]))
    groups = written(components(trie_join(start_nodes(reps), BUDGET, width=BITS, limit=LIMIT)))
    comp = written(components(checked_links(docs, reps, groups, shingle, t, key)))
    named = reps.join(comp, reps["rep"] == comp["node"], "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return table.select("doc_id", "digest").join(named, "digest").select("doc_id", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: str = "0.8") -> DataFrame:
    """The rows of df without near-copies: of each group the row of the least id stays, with all its columns.

    Ids are keys: rows that repeat an id share one fate. Rows with a null id stay.
    """
    gone = written(similar_groups(df, id_col, text_col, shingle, least).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct())
    return df.join(gone, df[id_col].cast("long") == gone["__gone"], "left_anti")
