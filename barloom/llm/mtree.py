"""Exact top-k inner products by best-first search of M-trees.

Inner products are turned into distances: a vector x gets one more component sqrt(M - |x|^2), M being the largest squared
norm, and a query gets 0 there; then the squared distance is |q|^2 + M - 2 q.x, so the nearest are the highest. Spark
deals the distinct vectors to the nearest of a bounded sample of pivots, and splits crowded pivots by hash; each part is
a tree of paged nodes with routing objects, covering radii and parent distances. A query first searches one part near it;
the score it then has bounds what other pivots it must visit. Within a tree, nodes come from a queue by the least
distance they can hold, and stored parent distances rule entries out before their own distances are computed.

Queries travel in packs and are searched a block at a time, each page with the queries of the block that it can still
serve. Packs meet trees by reading both tables, without an exchange, so that disk follows the rows, not queries times trees.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import written

PAGE = 512  # entries of a leaf page
SLACK = 1e-6  # room for rounding in distances, in parts of the largest norms; scores themselves are exact integers
SURE = 2.0**52  # up to such products of norms, sums of products are exact in doubles
SHORT = 2.0**23  # and in floats
WIDE = 16 << 20  # bytes of 8-byte components that a tree, a pack or the pivots hold at most: fewer of them where vectors are long
SHARES = 4  # of the packs: so many tasks read each part of the forest


def lifted(x: np.ndarray, m: float) -> np.ndarray:
    """Vectors with the component that makes all squared norms m."""
    return np.concatenate((x, np.sqrt(np.maximum(m - (x * x).sum(axis=1, keepdims=True), 0.0))), axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0.0))


class Best:
    """The k best (score, id) of each of many queries, ties by smaller id."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        """floor: of each query; scores under it may be left out."""
        self.k, self.worst, self.last = k, floor.astype(float), np.full(len(floor), np.iinfo(np.int64).max)
        self.rows, self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """rows: numbers of queries."""
        if len(rows):
            self.new.append((rows, scores, ids))
            self.waiting += len(rows)
            if self.waiting > self.k * len(self.worst):
                self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        rows, scores, ids = (np.concatenate(x) for x in zip((self.rows, self.scores, self.ids), *self.new, strict=True))
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(self.worst)))[rows]
        head = place == self.k - 1
        self.worst[rows[head]], self.last[rows[head]] = scores[head], ids[head]
        keep = place < self.k
        self.rows, self.scores, self.ids = rows[keep], scores[keep], ids[keep]
        self.new, self.waiting = [], 0


class MTree:
    """Nodes in lists: routing object, covering radius, distance to the parent's routing object, children or leaf entries."""

    def __init__(self, points: np.ndarray, page: int = PAGE, exact: np.ndarray | None = None) -> None:
        """points: lifted. exact: the vectors as 8-byte integers, if doubles may not hold their products."""
        self.points, self.page, self.exact = points, page, exact
        self.nodes: list[dict] = []
        self.kind = np.float32 if len(points) and float(points[0] @ points[0]) <= SHORT else np.float64
        self.root = self._build(np.arange(len(points)), points[0]) if len(points) else None
        self.points = None  # leaves hold their own
        self.computed = 0  # distances and inner products that searches computed

    def __getstate__(self) -> dict:
        """Vectors of whole numbers travel in as few bytes as hold them."""
        return self.__dict__ | {"nodes": [x | {"vectors": _small(x["vectors"])} if "vectors" in x and (x["vectors"] == np.rint(x["vectors"])).all() else x for x in self.nodes]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        for x in self.nodes:
            if "vectors" in x:
                x["vectors"] = x["vectors"].astype(self.kind)

    def _build(self, members: np.ndarray, center: np.ndarray) -> int:
        d = _distances(self.points[members], center[None])[:, 0]
        node = {"center": center, "radius": float(d.max()), "parent": 0.0}
        self.nodes.append(node)
        number = len(self.nodes) - 1
        if len(members) <= self.page or d.max() == 0:
            node["leaf"], node["far"], node["vectors"] = members, d, np.ascontiguousarray(self.points[members, :-1], self.kind)
            return number
        # random seeds, then each member to its nearest seed; distances are let go before the children are built
        seeds = np.random.default_rng(len(members)).choice(len(members), min(16, -(-2 * len(members) // self.page)), replace=False)
        owner = _distances(self.points[members], self.points[members[seeds]]).argmin(axis=1)
        parts = [(members[owner == k], members[s], float(d[s])) for k, s in enumerate(seeds.tolist()) if (owner == k).any()]
        del owner, d
        children = []
        for part, seed, far in parts:
            child = self._build(part, self.points[seed])
            self.nodes[child]["parent"] = far
            children.append(child)
        node["children"] = np.array(children)
        node["centers"] = np.stack([self.nodes[c]["center"] for c in children])
        node["radii"] = np.array([self.nodes[c]["radius"] for c in children])
        node["far"] = np.array([self.nodes[c]["parent"] for c in children])
        return number

    def search(self, query: np.ndarray, m: float, k: int, floor: float, ids: list[np.ndarray], exact: np.ndarray | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) among the points' ids, highest score first, ties by smaller id; all scores under
        `floor` may be left out. query: lifted; exact: its integers, if the tree has them. ids: of each point, ascending,
        k at most."""
        if self.root is None:
            return []
        q2, plain = float(query @ query), np.ascontiguousarray(query[:-1])
        room = SLACK * (np.sqrt(m) + np.sqrt(q2)) + SLACK  # of a distance
        doubt = 0.0 if self.exact is None else 2.0**-50 * (len(query) + 2) * np.sqrt(m * q2)  # of a score in doubles
        whole = None if self.exact is None else exact.astype(object)
        bound = lambda: np.sqrt(max(q2 + m - 2 * (worst - doubt), 0.0)) + room
        best: list[tuple[int, int]] = []  # heap of (score, -id): its head is the k-th
        worst = floor
        root = self.nodes[self.root]
        d = float(np.linalg.norm(query - root["center"]))
        self.computed += 1
        queue = [(max(0.0, d - root["radius"]), self.root, d)]
        while queue:
            least, number, d = heapq.heappop(queue)
            reach = bound() if worst > -np.inf else np.inf
            if least > reach:
                break
            node = self.nodes[number]
            if "leaf" in node:
                live = np.abs(d - node["far"]) <= reach
                n = int(live.sum())
                members, vectors = node["leaf"], node["vectors"]
                if 2 * n < len(live):  # else one product over the whole page is cheaper than copying rows out of it
                    members, vectors = members[live], vectors[live]
                self.computed += len(members)
                scores = vectors @ plain
                hopeful = np.flatnonzero(scores >= worst - doubt)
                if whole is None:
                    values = np.rint(scores[hopeful]).astype(np.int64).tolist()
                else:
                    values = [int(x) for x in self.exact[members[hopeful]].astype(object) @ whole]
                for value, j in sorted(zip(values, hopeful.tolist(), strict=True), key=lambda x: -x[0]):
                    for one in ids[members[j]].tolist():
                        entry = (value, -one)
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                        else:
                            break
                if len(best) == k:
                    worst = max(worst, float(best[0][0]))
            else:
                live = np.flatnonzero(np.abs(d - node["far"]) - node["radii"] <= reach)
                self.computed += len(live)
                far = np.sqrt(((node["centers"][live] - query) ** 2).sum(axis=1))
                low = np.maximum(far - node["radii"][live], 0.0)
                for c, x, y in zip(node["children"][live].tolist(), low.tolist(), far.tolist(), strict=True):
                    if x <= reach:
                        heapq.heappush(queue, (x, c, y))
        return [(s, -i) for s, i in sorted(best, key=lambda e: (-e[0], -e[1]))]

    def search_many(self, queries: np.ndarray, m: float, best: Best, rows: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        """Enters what the points have for many queries into `best`. queries: lifted, of norms up to sqrt(m); rows: which of
        them to search for. The ids of point p are ids[starts[p] : starts[p + 1]]. Not for trees with `exact`."""
        if self.root is None or not len(rows):
            return
        q2, plain = (queries * queries).sum(axis=1), np.ascontiguousarray(queries[:, :-1], self.kind)
        room = SLACK * (np.sqrt(m) + np.sqrt(q2)) + SLACK
        reach = lambda at: np.sqrt(np.maximum(q2[at] + m - 2 * best.worst[at], 0.0)) + room[at]
        root = self.nodes[self.root]
        d = _distances(queries[rows], root["center"][None])[:, 0]
        self.computed += len(rows)
        low = np.maximum(d - root["radius"], 0.0)
        queue = [(float(low.min()), self.root, rows, d, low)]
        while queue:
            _, number, rows, d, low = heapq.heappop(queue)
            node, bound = self.nodes[number], reach(rows)
            if "leaf" in node:
                far = node["far"]
                live = np.maximum(low, np.maximum(d - far.max(), far.min() - d)) <= bound
                if live.any():
                    self._page(node, plain, rows[live], best, starts, ids)
                continue
            live = low <= bound
            if not live.any():
                continue
            rows, d, bound = rows[live], d[live], bound[live]
            serves = np.abs(d[:, None] - node["far"]) - node["radii"] <= bound[:, None]
            children = np.flatnonzero(serves.any(axis=0))
            far = _distances(queries[rows], node["centers"][children])
            self.computed += far.size
            for j, c in enumerate(children.tolist()):
                x = np.maximum(far[:, j] - node["radii"][c], 0.0)
                on = serves[:, c] & (x <= bound)
                if on.any():
                    heapq.heappush(queue, (float(x[on].min()), int(node["children"][c]), rows[on], far[on, j], x[on]))
        best.settle()

    def _page(self, node: dict, plain: np.ndarray, rows: np.ndarray, best: Best, starts: np.ndarray, ids: np.ndarray) -> None:
        scores = plain[rows] @ node["vectors"].T
        self.computed += scores.size
        worst, n = best.worst[rows], scores.shape[1]
        if n > best.k and np.isneginf(worst).any():  # each point has an id, so the k-th point bounds the k-th entry
            worst = np.maximum(worst, np.partition(scores, n - best.k, axis=1)[:, n - best.k])
        at, j = np.nonzero(scores >= worst.astype(self.kind)[:, None])
        values, points, at = scores[at, j].astype(float), node["leaf"][j], rows[at]
        many = starts[points + 1] - starts[points]
        which = np.repeat(np.arange(len(points)), many)
        found = ids[starts[points][which] + np.arange(len(which)) - (np.cumsum(many) - many)[which]]
        at, values = at[which], values[which]
        keep = (values > best.worst[at]) | (found <= best.last[at])
        best.add(at[keep], values[keep], found[keep])


def quantised(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of each component as little-endian 8-byte integers.

    Rows with a null id, a null vector, or a null or non-finite component are left out, repeated rows once. A finite
    component of 2**62 or more after scaling is an error: no score with it would be a long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.filter(pc.and_(pc.is_valid(b.column(0)), pc.is_valid(b.column(1))))
            v = pc.fill_null(rows.column(1).flatten(), np.nan).to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(rows.column(1).value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
            ok = np.diff(np.concatenate(([0], np.cumsum(~np.isfinite(v))))[at]) == 0
            own = np.repeat(ok, np.diff(at))
            if (large := np.flatnonzero(own & (np.abs(v) >= 2.0**62 / scale))).size:
                raise ValueError(f"vector {rows.column(0)[int(np.searchsorted(at, large[0], 'right')) - 1]}: a component is too large for scores of 64 bits")
            ends = np.concatenate(([0], np.cumsum(8 * np.diff(at)[ok]))).astype(np.int32)
            vec = pa.Array.from_buffers(pa.binary(), int(ok.sum()), [None, pa.py_buffer(ends), pa.py_buffer(np.floor(scale * v[own]).astype("<i8"))])
            yield pa.record_batch([rows.column(0).filter(pa.array(ok)), vec], names=["vec_id", "vec"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, vec binary").distinct()


def _matrix(blobs: list[bytes], dim: int, kind: type = np.float64) -> np.ndarray:
    if len({len(x) for x in blobs}) == 1 and len(blobs[0]) == 8 * dim:
        return np.frombuffer(b"".join(blobs), "<i8").reshape(-1, dim).astype(kind)
    out = np.zeros((len(blobs), dim), kind)
    for row, x in zip(out, blobs, strict=True):
        v = np.frombuffer(x, "<i8")
        row[: len(v)] = v
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """Integers in as few bytes as hold them."""
    return x.astype(next(kind for kind in (np.int8, np.int16, np.int32, np.int64) if not x.size or np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max))


def low_hashes(entries: DataFrame, wanted: int, n: int) -> DataFrame:
    """(vec, h) of the n entries with about the 2 * wanted lowest hashes h. Each task of an ordered limit sends the driver as
    many rows as are wanted; with no more candidates than these, what it gets does not follow the tasks."""
    hashed = entries.select("vec", F.xxhash64("vec").alias("h"))
    share = (2 * wanted + 64) / max(1, n)
    return hashed.where(F.col("h") <= int((share - 0.5) * 2.0**64)) if share < 0.5 else hashed


def top_inner_products(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", most_pivots: int = 1024, part: int = 4096, block: int = 256, page: int = PAGE, pack: int = 4096) -> DataFrame:
    """For each row whose id is divisible by `every`: its k highest inner products with all other rows, after
    floor(scale * x): query_id, rank (from 1), vec_id, score. Ties go to the smaller vec_id; fewer rows give fewer.

    Exact for every row, however large its numbers; a score among the results beyond 64 bits is an error. most_pivots bounds the sample of pivots, part the vectors of one tree, pack the queries of one
    row, block those searched at once. Shorter vectors are filled up with zeros. A vector's copies beyond the k + 1 smallest
    ids cannot be among anyone's k highest and are not entered.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = written(quantised(df, scale, id_col, vector_col))
    copies = Window.partitionBy("vec").orderBy("vec_id")
    entries = written(table.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n, dim = entries.agg(F.count("*"), F.coalesce(F.max(F.length("vec")), F.lit(0))).first()
    dim = max(1, dim // 8)

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array([float((_matrix(b.column(0).to_pylist(), dim) ** 2).sum(axis=1).max())])], names=["m"])

    m = entries.select("vec").mapInArrow(norm, "m double").agg(F.max("m")).first()[0] or 0.0
    part, pack, most_pivots = (max(1, min(x, WIDE // (8 * dim))) for x in (part, pack, most_pivots))
    wanted = int(min(most_pivots, max(1, n // part)))
    pivots = low_hashes(entries, wanted, n).orderBy("h", "vec").limit(wanted).collect() or entries.select("vec").limit(1).collect()
    centers = lifted(_matrix([r["vec"] for r in pivots], dim), m)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                rows = b.slice(at, 1024)
                d = _distances(lifted(_matrix(rows.column(0).to_pylist(), dim), m), centers)
                best = d.argmin(axis=1)
                yield pa.record_batch([*rows.columns, pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(best)), best])], names=[*rows.schema.names, "pivot", "d"])

    placed = written(entries.mapInArrow(nearest, "vec binary, ids array<long>, pivot int, d double"))
    radius, splits = np.zeros(len(pivots)), np.ones(len(pivots), int)
    for r in placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("d").alias("d")).collect():
        radius[r["pivot"]], splits[r["pivot"]] = r["d"], -(-r["n"] // part)
    first = np.concatenate(([0], np.cumsum(splits)))  # trees of each pivot

    def of_pivot(numbers: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in numbers]) if len(numbers) else F.array(F.lit(1)), F.col("pivot") + 1)

    tree_of = of_pivot(first) + F.pmod(F.xxhash64("vec"), of_pivot(splits)).cast("int")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        blobs, ids = list(rows["vec"]), list(rows["ids"])
        tree = MTree(lifted(_matrix(blobs, dim), m), page, _matrix(blobs, dim, np.int64) if m > SURE else None)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "pages": [pickle.dumps((tree, starts, np.concatenate(ids)))]})

    forest = written(placed.withColumn("tree", tree_of.cast("int")).select("tree", "vec", "ids").repartition(parts, "tree").groupBy("tree").applyInPandas(build, "tree int, pages binary"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nearest pivot of each query."""
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                rows = b.slice(at, 1024)
                pivot = _distances(np.concatenate((_matrix(rows.column(0).to_pylist(), dim), np.zeros((rows.num_rows, 1))), axis=1), centers).argmin(axis=1)
                yield pa.record_batch([*rows.columns, pa.array(pivot.astype(np.int32))], names=["vec", "q", "pivot"])

    # a query goes by the least of its rows' ids
    asked = written(table.where(F.col("vec_id") % every == 0).groupBy("vec").agg(F.min("vec_id").alias("q")).mapInArrow(near, "vec binary, q long, pivot int"))
    counts = np.zeros(len(pivots), int)
    for r in asked.groupBy("pivot").count().collect():
        counts[r["pivot"]] = r["count"]

    def packed(rows: pd.DataFrame, home: bool) -> tuple:
        """The ids, integers, floors and home trees (-1: search there too) of a pack's queries."""
        at = first[rows["pivot"].to_numpy()]
        return rows["q"].to_numpy(), _small(_matrix(list(rows["vec"]), dim, np.int64)), rows["floor"].to_numpy() if home else np.full(len(rows), -np.inf), at if home else np.full(len(rows), -1)

    def at_home(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"pack": rows["pack"].iloc[:1], "tree": [int(first[rows["pivot"].iloc[0]])], "asked": [pickle.dumps(packed(rows, False))]})

    def abroad(rows: pd.DataFrame) -> pd.DataFrame:
        """A pack with all trees, besides a query's home, that can hold a score of the floor or more for one of its queries."""
        _, x, floor, home = data = packed(rows, True)
        ok = np.zeros(int(first[-1]), bool)
        for at in range(0, len(x), block):
            q = np.concatenate((x[at : at + block].astype(float), np.zeros((len(x[at : at + block]), 1))), axis=1)
            q2 = (q * q).sum(axis=1)[:, None]
            low = np.maximum(_distances(q, centers) - radius - SLACK * (np.sqrt(m) + np.sqrt(q2)) - SLACK, 0.0)
            serves = np.repeat((q2 + m - low**2) / 2 >= floor[at : at + block, None] - SLACK * (m + q2) - SLACK, splits, axis=1)
            serves[np.arange(len(q)), home[at : at + block]] = False
            ok |= serves.any(axis=0)
        return pd.DataFrame({"pack": rows["pack"].iloc[:1], "asked": [pickle.dumps(data)], "trees": [np.flatnonzero(ok).astype(np.int32)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each pack's best in the trees that come with it."""

        def out(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate([x[j] for x in found]), pa.int64()) for j in range(3)], names=["q", "score", "id"])

        number, q, x, floor, home, held = None, *[np.zeros(0)] * 4, []
        for b in batches:
            for which, asked, t, pages in zip(*(b.column(j) for j in range(4)), strict=True):
                if which.as_py() != number:
                    if held:
                        yield out([(q[at][h.rows], h.scores.astype(np.int64), h.ids) for at, h in held])
                    number, (q, x, floor, home) = which.as_py(), pickle.loads(asked.as_py())
                    held = [(slice(at, at + block), Best(floor[at : at + block], k + 1)) for at in range(0, len(q), block)] if m <= SURE else []
                tree, starts, ids = pickle.loads(pages.as_py())
                for at, best in held:
                    tree.search_many(np.concatenate((x[at].astype(float), np.zeros((len(x[at]), 1))), axis=1), m, best, np.flatnonzero(home[at] != t.as_py()), starts, ids)
                if m > SURE:
                    each = np.split(ids, starts[1:-1])
                    some = [(i, s, j) for i, one, least, h in zip(q.tolist(), x.astype(np.int64), floor, home, strict=True) if h != t.as_py() for s, j in tree.search(np.append(one.astype(float), 0.0), m, k + 1, least, each, one)]
                    if any(not -(1 << 63) <= s < 1 << 63 for _, s, _ in some):
                        raise ValueError("a score is beyond 64 bits")
                    if some:
                        yield out([tuple(np.array(y, np.int64) for y in zip(*some, strict=True))])
        if held:
            yield out([(q[at][h.rows], h.scores.astype(np.int64), h.ids) for at, h in held])

    kinds = "q long, score long, id long"
    # rows of pages and packs are large, and files tell little of how large: no join may choose to broadcast them
    needed = -(-counts // pack)
    own_pack = asked.withColumn("pack", (of_pivot(np.cumsum(needed) - needed) + F.pmod(F.xxhash64("vec"), of_pivot(np.maximum(needed, 1)))).cast("int"))
    homes = own_pack.groupBy("pack").applyInPandas(at_home, "pack int, tree int, asked binary")
    begun = written(homes.join(forest.hint("merge"), "tree").select("pack", "asked", "tree", "pages").repartition(parts, "pack").mapInArrow(run, kinds))
    floors = begun.groupBy("q").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least"))
    floor = F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("floor")
    place = of_pivot(np.cumsum(counts) - counts) + F.pmod(F.xxhash64("vec"), of_pivot(np.maximum(counts, 1)))
    waiting = asked.join(floors.hint("merge"), "q", "left").select("vec", "q", "pivot", floor).withColumn("pack", F.floor(place / pack).cast("int"))
    packs = written(waiting.repartition(parts, "pack").groupBy("pack").applyInPandas(abroad, "pack int, asked binary, trees array<int>"))
    pairs = packs.coalesce(SHARES).join(forest.hint("shuffle_replicate_nl"), F.expr("array_contains(trees, tree)")).select("pack", "asked", "tree", "pages")

    order = (F.desc("score"), F.asc("id"))
    found = begun.unionByName(pairs.mapInArrow(run, kinds))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("n") <= k + 1).drop("n")
    own = table.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id").join(asked.select("vec", "q").hint("merge"), "vec").select("query_id", "q")
    ranked = own.join(best, "q").where("id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def top_inner_products_sql(k: int = 20, every: int = 20, scale: int = 64, table: str = "embeddings") -> str:
    """The same by brute force in SQL, for vectors of one length without nulls inside."""
    return f"""WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM {table} WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
