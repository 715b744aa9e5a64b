"""Hard negatives: for each anchor and each of its nearest rows of the same label, rows of other labels that score a little less.

Angles obey the triangle inequality. Each row stores its norm and its angles to a few reference directions; for two rows
each direction gives an interval of the angle between them, the norms make of it an interval of their inner product, and
only rows whose interval meets what is still asked for are scored, in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import written

ROOM = 1e-7  # of angles: arccos of a cosine near 1 that is off by a few units in the last place is off by about 3e-8
SLACK = 1e-9  # of bounds, in parts of the norms' product
SURE = float(1 << 53)  # under this, doubles hold every sum of products exactly
ROWS, ANCHORS = 4096, 8192  # rows and anchors that meet in one task's group
STRIP = 128  # anchors whose bounds are held at a time


def quantised(df: DataFrame, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, vec): floor(scale * x) of each component as doubles, which hold it exactly.

    Rows with a null id, label or vector, or a null or non-finite component, are left out; equal rows count once. A
    component that overflows when scaled is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for k, x in enumerate(b.column(2).to_pylist()):
                v = np.array(x, float)  # a null becomes NaN
                if np.isfinite(v).all():
                    with np.errstate(over="ignore"):
                        v = np.floor(scale * v)
                    if not np.isfinite(v).all():
                        raise ValueError(f"vector {b.column(0)[k]}: a component is too large")
                    keep.append(k)
                    out.append((v + 0.0).astype("<f8").tobytes())  # no negative zeros
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(out, pa.binary())], names=["vec_id", "label", "vec"])

    plain = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return plain.dropna().mapInArrow(run, "vec_id long, label long, vec binary").distinct()


def matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    """The vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(blobs), dim))
    for row, x in zip(out, blobs, strict=True):
        row[: len(x) // 8] = np.frombuffer(x, "<f8")
    return out


def norms_and_units(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and the vectors divided by them; zeros stay zeros. Scaled first, so that no square overflows."""
    top = np.maximum(np.abs(v).max(axis=1, initial=0.0), np.finfo(float).tiny)[:, None]
    small = v / top
    size = np.sqrt((small * small).sum(axis=1))[:, None]
    with np.errstate(over="ignore"):
        return (size * top)[:, 0], small / np.maximum(size, np.finfo(float).tiny)


def angles(v: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The norm of each row and its angle to each reference direction (unit rows)."""
    norm, unit = norms_and_units(v)
    return norm, np.arccos(np.clip(unit @ references.T, -1.0, 1.0))


def score_bounds(least: np.ndarray, most: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of inner products from bounds of the angle and of what the norms' product can be.

    product has the least and the greatest product of norms on its last axis."""
    down, up = np.cos(np.minimum(most + ROOM, np.pi)), np.cos(np.maximum(least - ROOM, 0.0))
    with np.errstate(over="ignore", invalid="ignore"):
        low = np.minimum(down * product[..., 0], down * product[..., 1])
        high = np.maximum(up * product[..., 0], up * product[..., 1])
        room = SLACK * product[..., 1] + SLACK
        return np.nan_to_num(low - room, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(high + room, nan=np.inf, posinf=np.inf, neginf=-np.inf)


class Block:
    """Rows with ids, labels, vectors, norms and angles."""

    def __init__(self, rows: pd.DataFrame, dim: int) -> None:
        self.ids, self.labels = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.vectors, self.norms = matrix(list(rows["vec"]), dim), rows["norm"].to_numpy(float)
        self.angles = np.frombuffer(b"".join(rows["angles"]), "<f8").reshape(len(rows), -1)

    def bounds(self, other: Block, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the scores of these rows (columns) with the other's rows at a slice."""
        mine, theirs = self.angles, other.angles[at]
        least, most = np.zeros((len(theirs), len(mine))), np.full((len(theirs), len(mine)), np.pi)
        for k in range(mine.shape[1]):
            a, b = theirs[:, k, None], mine[None, :, k]
            np.maximum(least, np.abs(a - b), out=least)
            both = a + b
            np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
        with np.errstate(over="ignore"):
            product = np.multiply.outer(other.norms[at], self.norms)
        return score_bounds(least, most, np.stack((product, product), axis=-1))

    def scores(self, other: Block, k: int, at: np.ndarray) -> np.ndarray | list[int]:
        """Exact inner products of the other's row k with these rows."""
        if other.norms[k] * self.norms[at].max(initial=0.0) < SURE:
            return np.rint(self.vectors[at] @ other.vectors[k]).astype(np.int64)
        whole = [int(x) for x in other.vectors[k]]
        return np.array([sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in self.vectors[at].tolist()], object)


def first_by_score(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the smaller id."""
    return np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k], np.int64) if scores.dtype == object else np.lexsort((ids, -scores))[:k]


def as_long(value: int) -> int:
    if not -(1 << 63) <= value < 1 << 63:
        raise ValueError("a score is beyond 64 bits")
    return int(value)


def table_value(values: list[int], at: Column) -> Column:
    """values[at], of a list that grows only with the reference directions."""
    return F.element_at(F.array(*[F.lit(int(x)) for x in values]), at + 1)


def hard_negatives(
    df: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 5, least_percent: int = 80, most_percent: int = 100, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    most_references: int = 16, part: int = ROWS, chunk: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `every`. An anchor's positives are its n_positives best other rows of
    its label, by the inner product of floor(scale * x), ties by the smaller id. For each of them: the first n_negatives
    rows of other labels with least_percent * positive_score <= 100 * negative_score <= most_percent * positive_score.

    Reference directions are a bounded sample; results do not depend on it. Rows lie in cells by their nearest
    direction, cells are split by hash into blocks of about `part` rows, and a cell is left out for an anchor if its
    bounds over all directions and norms exclude it. A block meets at most about `chunk` anchors in one group. Rows
    with nulls or non-finite components take no part, an empty table gives none, a positive's score beyond 64 bits is
    an error. Vectors shorter than the longest are filled up with zeros.
    """
    plain = quantised(df, scale, id_col, label_col, vector_col)
    n, width = plain.agg(F.count("*"), F.coalesce(F.max(F.length("vec")), F.lit(0))).first()
    dim = max(1, width // 8)
    picked = plain.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(int(min(most_references, max(1, n)))).collect()
    references = norms_and_units(matrix([r["vec"] for r in picked] or [b""], dim))[1]
    count = len(references)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                norm, theta = angles(matrix(b.column(2).to_pylist(), dim), references)
                cells = theta.argmin(axis=1).astype(np.int32)
                yield pa.record_batch([*b.columns, pa.array(norm), pa.array([x.tobytes() for x in theta], pa.binary()), pa.array(cells), pa.array(list(theta), pa.list_(pa.float64()))], names=[*b.schema.names, "norm", "angles", "cell", "theta"])

    everything = written(plain.mapInArrow(place, "vec_id long, label long, vec binary, norm double, angles binary, cell int, theta array<double>"))
    seen = {r["cell"]: r for r in everything.groupBy("cell").agg(F.count("*").alias("n"), F.min("norm").alias("thin"), F.max("norm").alias("thick"), *[f(F.col("theta")[k]).alias(f"{f.__name__}{k}") for k in range(count) for f in (F.min, F.max)]).collect()}
    splits = [-(-seen[c]["n"] // part) if c in seen else 1 for c in range(count)]
    near = np.array([[seen[c][f"min{k}"] if c in seen else 0.0 for k in range(count)] for c in range(count)])
    far = np.array([[seen[c][f"max{k}"] if c in seen else 0.0 for k in range(count)] for c in range(count)])
    thin, thick = (np.array([seen[c][x] if c in seen else 0.0 for c in range(count)]) for x in ("thin", "thick"))
    data = everything.drop("theta")
    anchors = written(data.where(F.col("vec_id") % every == 0))
    rows = data.withColumn("split", F.pmod(F.xxhash64("vec_id"), table_value(splits, F.col("cell"))).cast("int"))
    own = ["vec_id", "label", "vec", "norm", "angles"]

    def cell_bounds(norm: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each anchor's scores with a row of each cell."""
        least, most = np.zeros((len(norm), count)), np.full((len(norm), count), np.pi)
        for k in range(count):
            a = theta[:, k, None]
            least = np.maximum(least, np.maximum(near[None, :, k] - a, a - far[None, :, k]))
            low, high = a + near[None, :, k], a + far[None, :, k]
            # the angle is at most x and at most 2 pi - x for each row's own x between low and high
            most = np.minimum(most, np.minimum(high, 2 * np.pi - low))
        with np.errstate(over="ignore"):
            product = norm[:, None, None] * np.stack((thin, thick), axis=-1)[None]
        return score_bounds(least, most, product)

    def meet(asked: DataFrame, extra: list[str], run, schema: str) -> DataFrame:
        """run(rows of a block, anchors that ask for its cell) for asked(cell, *own, *extra), a chunk of anchors at a time."""
        chunks = [1] * count
        for r in asked.groupBy("cell").count().collect():
            chunks[r["cell"]] = -(-r["count"] // chunk)
        of = table_value(chunks, F.col("cell"))
        side = asked.select("cell", F.pmod(F.xxhash64("vec_id"), of).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), table_value(splits, F.col("cell")) - 1)).alias("split"), *own, *extra)
        block = rows.select("cell", F.explode(F.sequence(F.lit(0), of - 1)).alias("chunk"), "split", *own)
        keys = ["cell", "chunk", "split"]
        return side.groupBy(*keys).cogroup(block.groupBy(*keys)).applyInPandas(run, schema)

    def positives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block, ask = Block(right, dim), Block(left, dim)
            floors = left["floor"].to_numpy(float)
            for begin in range(0, len(left), STRIP):
                at = slice(begin, min(begin + STRIP, len(left)))
                high = block.bounds(ask, at)[1]
                wanted = (high >= floors[at, None]) & (block.labels[None] == ask.labels[at, None]) & (block.ids[None] != ask.ids[at, None])
                for k in np.flatnonzero(wanted.any(axis=1)).tolist():
                    j = np.flatnonzero(wanted[k])
                    s = block.scores(ask, begin + k, j)
                    best = first_by_score(s, block.ids[j], n_positives)
                    out += [(int(ask.ids[begin + k]), int(block.ids[j[b]]), as_long(s[b])) for b in best.tolist()]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "score"])

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each anchor and cell that can hold a score between its limits, but for the block it has seen."""
        for b in batches:
            if not b.num_rows:
                continue
            column = {x: b.column(k) for k, x in enumerate(b.schema.names)}
            theta = np.frombuffer(b"".join(column["angles"].to_pylist()), "<f8").reshape(b.num_rows, -1)
            low, high = cell_bounds(column["norm"].to_numpy(zero_copy_only=False), theta)
            first, last = (column[x].to_numpy(zero_copy_only=False)[:, None] for x in ("floor", "ceiling"))
            ok = (high >= first) & (low <= last)
            ok[:, [c for c in range(count) if c not in seen]] = False
            k, cell = np.nonzero(ok)
            at = pa.array(k)
            yield pa.record_batch([pa.array(cell.astype(np.int32)) if x == "cell" else column[x].take(at) for x in b.schema.names], names=b.schema.names)

    def ranked(found: DataFrame, keys: list[str], other: str, most: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), other)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    schema = "anchor_id long, positive_id long, score long"
    infinite = F.lit(float("inf"))
    # one block of the anchor's own cell gives a floor, then all cells that can reach it are asked
    home = rows.groupBy("cell", "split").agg(F.count("*").alias("n")).groupBy("cell").agg(F.min_by("split", -F.col("n")).alias("split"))
    first_block = {r["cell"]: r["split"] for r in home.collect()}
    begun_rows = rows.where(F.col("split") == table_value([first_block.get(c, 0) for c in range(count)], F.col("cell"))).select("cell", F.lit(0).alias("chunk"), *own)
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // (every * chunk)))))
    chunked = anchors.withColumns({"floor": -infinite, "chunk": spread.cast("int")})
    begun_side = begun_rows.drop("chunk").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // (every * chunk))) - 1))))
    begun = written(chunked.groupBy("cell", "chunk").cogroup(begun_side.groupBy("cell", "chunk")).applyInPandas(positives, schema))
    floors = begun.groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
    known = anchors.join(floors, anchors["vec_id"] == floors["anchor_id"], "left").select("cell", *own, F.when(F.col("n") >= n_positives, F.col("least")).otherwise(-infinite).alias("floor"), infinite.alias("ceiling"))
    layout = "cell int, vec_id long, label long, vec binary, norm double, angles binary"
    asked = written(known.mapInArrow(targets, f"{layout}, floor double, ceiling double"))
    found = meet(asked.drop("ceiling"), ["floor"], positives, schema)
    best = written(ranked(found, ["anchor_id"], "positive_id", n_positives).drop("rank"))

    def negatives(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block, ask = Block(right, dim), Block(left, dim)
            windows = [sorted({(-(-least_percent * p // 100), most_percent * p // 100, p) for p in map(int, x)}, reverse=True) for x in left["wanted"]]
            first, last = (np.array([f(w[k] for w in x) for x in windows], float) for f, k in ((min, 0), (max, 1)))
            for begin in range(0, len(left), STRIP):
                at = slice(begin, min(begin + STRIP, len(left)))
                low, high = block.bounds(ask, at)
                wanted = (high >= first[at, None]) & (low <= last[at, None]) & (block.labels[None] != ask.labels[at, None])
                for k in np.flatnonzero(wanted.any(axis=1)).tolist():
                    j, windows_k = np.flatnonzero(wanted[k]), windows[begin + k]
                    s = block.scores(ask, begin + k, j)
                    for small, large, p in windows_k:
                        inside = np.flatnonzero((s >= small) & (s <= large))
                        best = first_by_score(s[inside], block.ids[j[inside]], n_negatives)
                        out += [(int(ask.ids[begin + k]), p, int(block.ids[j[i]]), as_long(s[i])) for i in inside[best].tolist()]
        return pd.DataFrame(out, columns=["anchor_id", "positive_score", "negative_id", "score"])

    # windows of one anchor and positive score are searched once; limits of all its windows decide which cells are asked
    wanted = best.where(F.col("score") >= 0 if least_percent < most_percent else F.lit(True)).groupBy("anchor_id").agg(F.sort_array(F.collect_set("score")).alias("wanted"))
    limits = anchors.join(wanted, anchors["vec_id"] == wanted["anchor_id"]).select(
        "cell", *own, "wanted", F.floor(F.array_min("wanted") * (least_percent / 100) * (1 - SLACK) - 1).cast("double").alias("floor"), F.ceil(F.array_max("wanted") * (most_percent / 100) * (1 + SLACK) + 1).cast("double").alias("ceiling")
    )
    asked = written(limits.mapInArrow(targets, f"{layout}, wanted array<long>, floor double, ceiling double"))
    near_ones = meet(asked.drop("floor", "ceiling"), ["wanted"], negatives, "anchor_id long, positive_score long, negative_id long, score long")
    few = ranked(near_ones, ["anchor_id", "positive_score"], "negative_id", n_negatives)
    pairs = best.withColumnRenamed("score", "positive_score").join(few, ["anchor_id", "positive_score"])
    return pairs.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def hard_negatives_sql(every: int = 100, scale: int = 256, relabelled: int = 7, labels: int = 10, table: str = "embeddings") -> str:
    """The query by brute force in SQL, for vectors of one length."""
    return f"""WITH v AS (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % {relabelled} = 0 THEN (label + 1) % {labels} ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e
  FROM {table} WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
