"""Token ids on disk: frequency-ranked, in byte-aligned variable-length coding with control bytes apart from data bytes.

A folder holds `codebook` (the id of each rank, most frequent first) and files `ids-<part>`, which hold the documents in
ascending doc_id order, part by part. A file is a run of frames; a frame has a header of four 8-byte integers (documents,
ids, control bytes, data bytes), then doc_ids, lengths, control bytes and data bytes. A control byte has the byte lengths
(less one, two bits each, first value lowest) of four values; data bytes are little-endian ranks. A null doc_id is
written as the least 64-bit integer.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from string import ascii_letters
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import LOWER, SPACE, as_uri, joined, map_file, pieces, put_file, same_words, shared_dir, span_hashes, spans, written

NULL_ID = np.iinfo(np.int64).min
MARK = "\x01"  # stands between words that are encoded in one call
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)  # of the values of each control byte
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values; the last control byte is filled up with lengths of 1."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    raw = values.view(np.uint8).reshape(-1, 4)
    return control, raw[np.arange(4) < size[:, None]]


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n values that pack() coded: lengths by table lookup, places by a running sum, values by unaligned loads."""
    size = LENGTHS[control].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    padded = np.concatenate((data, np.zeros(4, np.uint8)))
    loads = np.ndarray(len(data) + 1, "<u4", padded, strides=(1,))
    return loads[at] & MASKS[size]


FILE_IDS = 16 << 20  # ids of a file, about, where there are many


class WordEncoder:
    """Encodes whole texts with a tokenizer that drops white space, one distinct word at a time.

    Pieces of such a tokenizer never cross white space, so a text's ids are its words' ids. Ids of words seen before
    come from sorted arrays, which are emptied at `most` words; that bounds memory and changes no result.
    """

    def __init__(self, path: str, most: int = 600_000) -> None:
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        if len(mark) != 1 or self.tokenizer.encode(f"a {MARK}\n\tb", add_special_tokens=False).ids != [*self._ids("a"), *mark, *self._ids("b")]:
            raise ValueError("the tokenizer does not treat white space as a mere separator")
        self.mark = mark[0]
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # whether the tokenizer parts a full stop or comma from a letter before it
        marks = [m for m in ".," if all([x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"{a}{c}{m}")][-1:] == [m] for c in ascii_letters for a in ("", "x"))]
        self.apart = np.zeros(256, bool)
        self.apart[[ord(m) for m in marks]] = True
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.bytes, self.begin, self.end = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.keys) + len(keys) > self.most:
            self._clear()
        size, parts, order = np.zeros(len(words), np.int64), [], []
        plain = [w.isalpha() and w == w.lower() and is_normalized("NFC", w) for w in words]
        for tokenizer, now in ((self.plain, True), (self.tokenizer, False)):
            some = [k for k, p in enumerate(plain) if p is now and MARK not in words[k]]
            texts = [f" {MARK} ".join(words[k] for k in some[i : i + 400]) + f" {MARK}" for i in range(0, len(some), 400)]
            flat = np.array([i for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.uint32)
            marks = np.flatnonzero(flat == self.mark)
            if len(marks) != len(some):
                raise ValueError("a word's ids hold the mark")
            size[some] = np.diff(np.concatenate(([-1], marks))) - 1
            parts.append(flat[flat != self.mark])
            order += some
        odd = [k for k, w in enumerate(words) if MARK in w]
        other = [self._ids(words[k]) for k in odd]
        size[odd] = [len(x) for x in other]
        parts.append(np.array([i for x in other for i in x], np.uint32))
        order = np.array(order + odd, np.int64)
        at = np.zeros(len(words), np.int64)
        at[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        raw = [w.encode() for w in words]
        length = np.array([len(x) for x in raw], np.int64)
        ends = len(self.bytes) + np.cumsum(length)
        self.bytes = np.concatenate((self.bytes, np.frombuffer(b"".join(raw), np.uint8)))
        keys = np.concatenate((self.keys, keys))
        by = np.argsort(keys, kind="stable")
        self.keys, self.at, self.size = keys[by], np.concatenate((self.at, at))[by], np.concatenate((self.size, size))[by]
        self.begin, self.end = np.concatenate((self.begin, ends - length))[by], np.concatenate((self.end, ends))[by]
        self.ids = np.concatenate((self.ids, *parts))

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with end_id after it, and where each text's ids begin (and the last end)."""
        data, starts = joined(column)
        raw = np.frombuffer(data, np.uint8)
        if b"<|" not in data:  # special tokens are matched before lower-casing
            raw = LOWER[raw]
            data = raw.tobytes()
        begin, end, first = spans(~SPACE[raw], starts)
        # a full stop or comma after a letter is a piece of its own, if the tokenizer has it so
        last = np.flatnonzero(self.apart[raw[end - 1]] & (end - begin > 1) & LETTER[raw[np.maximum(end - 2, 0)]])
        begin, end = np.sort(np.concatenate((begin, end[last] - 1))), np.sort(np.concatenate((end, end[last] - 1)))
        first = np.searchsorted(begin, starts)
        keys, one, back = np.unique(span_hashes(raw, begin, end), return_index=True, return_inverse=True)
        new = keys if not len(self.keys) else keys[self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys]
        if len(new):
            if len(self.keys) + len(new) > self.most:
                self._clear()
                new = keys
            pick = one[np.searchsorted(keys, new)]
            self._learn(new, [data[a:b].decode() for a, b in zip(begin[pick].tolist(), end[pick].tolist(), strict=True)])
        place = np.searchsorted(self.keys, keys)
        at, size = self.at[place][back], self.size[place][back]
        # words of equal hash and other bytes than the kept ones stand for themselves
        word = place[back]
        odd = np.flatnonzero(~same_words(raw, begin, end, self.bytes, self.begin[word], self.end[word]))
        own = [self._ids(data[a:b].decode()) for a, b in zip(begin[odd].tolist(), end[odd].tolist(), strict=True)]
        size[odd] = [len(x) for x in own]
        at[odd] = len(self.ids) + np.cumsum(size[odd]) - size[odd]
        known = np.concatenate((self.ids, np.array([i for x in own for i in x], np.uint32))) if len(odd) else self.ids
        texts = len(first) - 1
        # the ends are one more "word" after each text's words
        slot = np.arange(len(back)) + np.repeat(np.arange(texts), np.diff(first))
        sizes = np.ones(len(back) + texts, np.int64)
        sizes[slot] = size
        to = np.concatenate(([0], np.cumsum(sizes)))
        out = np.full(int(to[-1]), end_id, np.uint32)
        target = np.repeat(to[slot] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        source = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[target] = known[source]
        return out, to[first + np.arange(texts + 1)]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text's ids as compressed little-endian integers of 2 bytes if the vocabulary fits, else 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        for b in pieces(batches, "text", 3 << 20):
            ids, at = encoder.encode(b.column(1), end_id)
            ids = ids.astype(f"<u{width}")
            blobs = [packed(ids[i:j].tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(np.diff(at)), pa.array(np.full(b.num_rows, width, np.int32)), pa.array(blobs, pa.binary())], names=["doc_id", "n", "width", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, width int, ids binary")


def packed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _ids_of(n: pa.Array, width: pa.Array, blobs: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(pa.decompress(x, k * w, codec="zstd", asbytes=True), f"<u{w}") for k, w, x in zip(n.to_pylist(), width.to_pylist(), blobs.to_pylist(), strict=True)]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        if b.num_rows:
            flat = np.concatenate(_ids_of(*b.columns))
            more = np.bincount(flat, minlength=len(total))
            more[: len(total)] += total
            total = more
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["id", "count"])


def _frame(ids: list[int], lengths: list[int], ranks: np.ndarray) -> list[np.ndarray]:
    control, data = pack(ranks)
    return [np.array([len(ids), len(ranks), len(control), len(data)], "<i8"), np.array(ids, "<i8"), np.array(lengths, "<i8"), control, data]


def _write(batches: Iterator[pa.RecordBatch], folder: str, rank: np.ndarray, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    docs = total = 0

    def frames() -> Iterator[np.ndarray]:
        """The arrays of the frames, each of which is given to the open file before the next one is made."""
        nonlocal docs, total
        ids, lengths, held, pending = [], [], [], 0
        for b in itertools.chain([first], batches):
            for doc, one in zip(b.column(0).to_pylist(), _ids_of(*b.columns[1:]), strict=True):
                ids.append(NULL_ID if doc is None else doc)
                lengths.append(len(one))
                held.append(one)
                docs, total, pending = docs + 1, total + len(one), pending + len(one)
                if pending >= most:
                    yield from _frame(ids, lengths, rank[np.concatenate(held)])
                    ids, lengths, held, pending = [], [], [], 0
        if ids:
            yield from _frame(ids, lengths, rank[np.concatenate(held)])

    first = next((b for b in batches if b.num_rows), None)
    if first is not None:
        put_file(f"{folder}/ids-{part}", frames())
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([docs]), pa.array([total])], names=["part", "docs", "ids"])


def write_token_files(table: DataFrame, folder: str | None = None) -> tuple[str, list[tuple[int, int]]]:
    """Writes encoded() rows to files in ascending doc_id order; the folder, and each file's part and ids before it.

    Equal doc_ids are ordered by their ids' bytes. The driver gets one row for each rank of the vocabulary and one for
    each file.
    """
    spark = table.sparkSession
    folder = as_uri(folder) if folder else shared_dir(spark)
    table = written(table, "none")
    counts = table.select("n", "width", "ids").mapInArrow(_tally, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).collect()
    book = np.array([r["id"] for r in sorted(counts, key=lambda r: (-r["count"], r["id"]))], "<u4")
    put_file(f"{folder}/codebook", [book])
    rank = np.zeros(int(book.max(initial=0)) + 1, np.uint32)
    rank[book] = np.arange(len(book))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["count"] for r in counts) // FILE_IDS))
    files = table.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids").mapInArrow(lambda it: _write(it, folder, rank), "part int, docs long, ids long").collect()
    before, out = 0, []
    for r in sorted(files):
        out.append((r["part"], before))
        before += r["ids"]
    return folder, out


def read_frames(folder: str, part: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """doc_ids, where each document's ids begin (and the last end), and all ids, frame by frame."""
    book, raw = map_file(f"{folder}/codebook").view("<u4"), map_file(f"{folder}/ids-{part}")
    at = 0
    while at < len(raw):
        docs, ids, control, data = raw[at : at + 32].view("<i8").tolist()
        at += 32
        doc_ids, lengths = raw[at : at + 8 * docs].view("<i8"), raw[at + 8 * docs : at + 16 * docs].view("<i8")
        at += 16 * docs
        values = unpack(raw[at : at + control], raw[at + control : at + control + data], ids)
        at += control + data
        yield doc_ids, np.concatenate(([0], np.cumsum(lengths))), book[values]


def read_token_files(spark, folder: str, parts: list[tuple[int, int]]) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32, ids (array of long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for docs, at, ids in read_frames(folder, part):
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.record_batch(
                        [pa.array(docs, mask=docs == NULL_ID), pa.array(at[:-1] + before), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    before += int(at[-1])

    rows = spark.createDataFrame(parts, "part int, before long")
    return rows.repartitionById(max(1, len(parts)), F.col("part") % max(1, len(parts))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, writes and reads back: doc_id, start, n_tokens, ids_crc32 of every row, from the files.

    A null text is empty and has the end id alone. Repeated rows give repeated documents. Null ids come first.
    """
    folder, parts = write_token_files(encoded(df, tokenizer, end_id, id_col, text_col))
    return read_token_files(df.sparkSession, folder, parts)
