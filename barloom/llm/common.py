"""Shared folder, written tables and vectorised tokenising for the text operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.store import until_exit

# ASCII white space of the word rule [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# ASCII A-Z to a-z, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; only an unset setting gets a local one. It
    lasts until the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.environ.get("BARLOOM_SHARED_DIR") or os.environ.setdefault("BARLOOM_SHARED_DIR", tempfile.mkdtemp(prefix="barloom-"))
    return until_exit(as_uri(f"{base.rstrip('/')}/barloom-{uuid.uuid4().hex}"))


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_hot(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, least: int = 1000) -> DataFrame:
    """rows joined with facts, which has one row a key and in n how many of the rows have it (total: all of them).

    Keys of more than one in a thousand of the rows, a thousand keys at most, go to the rows by broadcast, so that no task
    gets all rows of such a key; the others are joined by key. Rows without facts, and null keys, are left out.
    """
    often = F.col(n) > max(least, total // 1000)
    hot, rest = facts.where(often), facts.where(~often)
    names = [F.col(key).alias("__key"), F.lit(True).alias("__hot")]
    marked = rows.join(F.broadcast(hot.select(*names)), F.col(key) == F.col("__key"), "left").drop("__key")
    common = marked.where("__hot").drop("__hot").join(F.broadcast(hot.drop(n)), key)
    return common.unionByName(marked.where("__hot is null").drop("__hot").join(rest.drop(n), key))


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % n


def held(column: str, n: int, is_held: int) -> Column:
    """True if crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(crc_mod(column, n) == is_held, F.lit(False))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of text, or one longer row; bounds a task's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)).cumsum()
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0.0
            to = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts (null: empty), each followed by a line feed, and where each begins, with the end of all."""
    texts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return b"\n".join([*texts, b""]), starts


def spans(is_word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end byte of each run of word bytes, and for each text its first word's number, with all words' count."""
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return begin, end, np.searchsorted(begin, starts)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


LANES = 64  # spans of more 8-byte lanes are hashed one by one


def text_key(df: DataFrame, text: str) -> Column:
    """An aggregate over all texts that keys span_hashes(): whoever writes some of the texts cannot foresee it, so cannot choose
    words that it makes equal. The same texts give the same key in any order."""
    return F.sum(F.xxhash64(F.col(text), F.lit(17)).cast("decimal(38,0)"))


def key_of(value: object) -> int:
    """The key of an aggregated text_key(), 64 bits and not 0."""
    return int(value or 0) % ((1 << 64) - 1) + 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span: its length and the key, then its 8-byte lanes, each multiplied and mixed in, all spans at once.

    With a known key, spans of equal hash can be made up: either the key depends on all texts (text_key), or whoever uses
    the hashes compares the bytes of those that are equal (same_spans).
    """
    buffer = np.concatenate((data, np.zeros(8, np.uint8)))
    lane = np.ndarray(len(data) + 1, "<u8", buffer, strides=(1,))
    size = (end - begin).astype(np.int64)
    h = size.astype(np.uint64) * BASE
    if key:
        h = mixed(h ^ np.uint64(key)) + np.uint64(key)
    long = np.flatnonzero(size > 8 * LANES)
    live, at, left = np.flatnonzero((size > 0) & (size <= 8 * LANES)), begin, size
    at, left = at[live], left[live]
    with np.errstate(over="ignore"):
        while live.size:
            x = lane[at] & (FULL >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64))
            y = (h[live] ^ x) * np.uint64(0x9FB21C651E98DF25)
            h[live] = (y ^ (y >> np.uint64(28))) * BASE
            on = left > 8
            live, at, left = live[on], at[on] + 8, left[on] - 8
    h[long] = [xxhash.xxh3_64_intdigest(buffer[a:b].data, seed=key) for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
    return mixed(h)


def same_spans(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray, begin2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether the spans of two arrays hold the same bytes."""
    size = end - begin
    out = size == end2 - begin2
    at = np.flatnonzero(out & (size > 0))
    cut = np.cumsum(size[at]) - size[at]
    inner = np.arange(int(size[at].sum()))
    same = raw[np.repeat(begin[at] - cut, size[at]) + inner] == other[np.repeat(begin2[at] - cut, size[at]) + inner]
    if len(at):
        out[at] = np.logical_and.reduceat(same, cut)
    return out


def same_words(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, other: np.ndarray, begin2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """same_spans() of spans whose hashes are equal: with one lane and one length the hash has an inverse, so that only longer
    spans need their bytes compared."""
    out = end - begin == end2 - begin2
    long = np.flatnonzero(out & (end - begin > 8))
    out[long] = same_spans(raw, begin[long], end[long], other, begin2[long], end2[long])
    return out


def sum_by(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive ranges that begin at starts[:-1]; 0 for empty ranges."""
    sums = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return sums[starts[1:]] - sums[starts[:-1]]


def put_file(uri: str, arrays: Iterable[np.ndarray]) -> None:
    """Writes the arrays one after the other, as they come; a repeated task replaces the file by an equal one."""
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(part) as out:
        for x in arrays:
            out.write(np.ascontiguousarray(x).data.cast("B") if x.size else b"")
    files.move(part, path)


def map_file(uri: str) -> np.memmap | None:
    """The file's bytes, memory-mapped; None if there is none. A file in a store is copied and unlinked once mapped."""
    files, path = fs.FileSystem.from_uri(uri)
    info = files.get_file_info(path)
    if info.type == fs.FileType.NotFound or not info.size:
        return None
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with tempfile.NamedTemporaryFile() as copy:
        with files.open_input_stream(path) as source:
            shutil.copyfileobj(source, copy)
        copy.flush()
        return np.memmap(copy.name, np.uint8, "r")


def file_names(uri: str) -> set[str]:
    """The names of a folder's files."""
    files, path = fs.FileSystem.from_uri(uri)
    return {x.base_name for x in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.type == fs.FileType.File}


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"
