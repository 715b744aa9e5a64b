"""A prefix trie of conversations as a table, with totals of every node's subtree, rolled up in bands of depth.

A node is a distinct sequence of leading turns. Its id is a hash over the turns' digests, a band of depths at a time, so
that no conversation is read by one task as a whole. For totals a node is exploded to its ancestors within its band
only; the bands' roots, with what their band gave them, form a trie that is BAND times lower and is treated in the same
way; the completed total of each band root then goes to its ancestors in the band above. A trie of depth d takes
log(d) / log(BAND) such rounds, and each gives a node at most BAND rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import written

BAND = 8  # depths of a band
SLICE = 1024  # successive turn numbers that are put in order by one task
STEP = 16  # bits: ids that share all higher bits are joined to one string by one task


def short_hash(x: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.unhex(F.substring(F.sha2(x, 256), 1, 32))


def together(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def positions(df: DataFrame) -> DataFrame:
    """df(conv, turn, role, text) with `slot`, a range of turn numbers, and `pos`, from 0: the turn's place in its conversation,
    by turn (null first), role and text. Slots are put in order apart from each other and moved on by the rows before."""
    slotted = df.withColumn("slot", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 62))))
    before = Window.partitionBy("conv").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slotted.groupBy("conv", "slot").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("conv", "slot").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return slotted.withColumn("place", F.row_number().over(inside)).join(offsets.drop("n"), ["conv", "slot"]).withColumn("pos", F.col("offset") + F.col("place") - 1).drop("offset", "place")


def paths(items: DataFrame, deepest: int) -> DataFrame:
    """items(conv, depth, digest), depths from 0 without gaps, with `id`, a hash of all digests up to the row, and
    `parent`, the id one row higher (null at depth 0)."""
    band = F.expr(f"depth div {BAND}")
    rows = items.withColumn("band", band)
    inside = Window.partitionBy("conv", "band").orderBy("depth")
    if deepest < BAND:
        rows = rows.withColumns({"up": F.lit(b""), "last": F.lit(None).cast("binary")})
    else:
        lists = rows.groupBy("conv", "band").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "digest"))), lambda x: x["digest"]).alias("digests"))
        full = written(lists.where(F.size("digests") == BAND).select("conv", F.col("band").alias("depth"), short_hash(together(F.col("digests"))).alias("digest"), "digests"))
        above = paths(full.drop("digests"), (deepest + 1) // BAND - 1).select("conv", "depth", F.col("id").alias("up"))
        # what goes before a band: the hash of all whole bands, and the id of the last row
        ended = full.select("conv", "depth", "digests").join(above.select("conv", (F.col("depth") + 1).alias("depth"), "up"), ["conv", "depth"], "left")
        last = ended.select("conv", "depth", short_hash(F.concat(F.coalesce("up", F.lit(b"")), together(F.col("digests")))).alias("last"))
        heads = above.join(last, ["conv", "depth"]).select("conv", (F.col("depth") + 1).alias("band"), "up", "last")
        rows = rows.join(heads, ["conv", "band"], "left").withColumn("up", F.coalesce("up", F.lit(b"")))
    rows = rows.withColumn("id", short_hash(F.concat("up", together(F.collect_list("digest").over(inside.rowsBetween(Window.unboundedPreceding, 0))))))
    return rows.withColumn("parent", F.coalesce(F.lag("id").over(inside), "last")).drop("up", "last", "band")


def rolled_up(path: DataFrame, nodes: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """(id, *sums): totals over the subtree of each of nodes(id, conv, depth, *sums), itself included.

    path(conv, depth, id) has the ids of the conversations named by nodes, at all depths.
    """
    bands = path.groupBy("conv", F.expr(f"depth div {BAND}").alias("band")).agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "id"))), lambda x: x["id"]).alias("ids"))
    placed = nodes.withColumn("band", F.expr(f"depth div {BAND}")).join(bands, ["conv", "band"])
    up = F.explode(F.slice("ids", F.lit(1), (F.col("depth") % BAND + 1).cast("int"))).alias("id")
    local = placed.drop("id").select(up, *sums).groupBy("id").agg(*[F.sum(c).alias(c) for c in sums])
    if deepest < BAND:
        return local
    local = written(local)
    lower = nodes.where(F.col("depth") % BAND == 0).select("id", "conv", F.expr(f"depth div {BAND}").alias("depth"))
    high = path.where(F.col("depth") % BAND == 0).select("conv", F.expr(f"depth div {BAND}").alias("depth"), "id")
    done = rolled_up(high, lower.join(local, "id"), sums, deepest // BAND)
    above = lower.join(done, "id").select("conv", (F.col("depth") - 1).alias("band"), *sums).join(bands, ["conv", "band"])
    lifted = above.select(F.explode("ids").alias("id"), *sums)
    return local.unionByName(lifted).groupBy("id").agg(*[F.sum(c).alias(c) for c in sums])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of ends(id, conv): the ids of conversations in ascending order, joined by commas and hashed.

    Spark sorts and joins ranges of ids to strings; the hash of a node, which can only be taken in order, then reads
    these strings one after the other and holds none of them.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",")
    strings = ends.groupBy("id", F.shiftright("conv", STEP).alias("range")).agg(text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            ids, out = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != node:
                    if state is not None:
                        ids.append(node)
                        out.append(state.hexdigest())
                    node, state = i, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(out, pa.string())], names=["id", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["id", "ends_sha256"])

    ordered = strings.repartition("id").sortWithinPartitions("id", "range").select("id", "text")
    return ordered.mapInArrow(run, "id binary, ends_sha256 string")


def rebuilt(df: DataFrame, stride: int = 100, most: int = 6) -> DataFrame:
    """(conv, depth, digest, chars, is_end) of conversations rebuilt from df(conv, turn, role, text), which has no nulls but in turn.

    Conversation c takes its first h = crc32(c) % most turns from conversation c - c % stride (all, if there are fewer) and its own
    turns after the first h. Every conversation has a row of depth 0 with an empty digest; turns follow from depth 1.
    """
    digest = short_hash(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    own = written(positions(df).select("conv", "slot", "pos", digest.alias("digest"), F.length("text").cast("long").alias("chars")))
    counts = own.groupBy("conv", "slot").agg(F.count("*").alias("n")).groupBy("conv").agg(F.sum("n").alias("n"))
    base, h = F.col("conv") - F.col("conv") % stride, F.crc32(F.col("conv").cast("string")) % most
    each = counts.withColumns({"base": base, "h": h})
    sources = each.where(F.col("conv") == F.col("base")).select(F.col("conv").alias("base"), F.col("n").alias("held"))
    each = each.join(sources, "base", "left").withColumn("taken", F.when(F.col("conv") == F.col("base"), 0).otherwise(F.least("h", F.coalesce("held", F.lit(0)))))
    each = each.withColumn("h", F.when(F.col("conv") == F.col("base"), 0).otherwise(F.col("h")))
    each = written(each.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv", "base", "h", "taken", "length"))
    roots = each.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("chars"), (F.col("length") == 0).alias("is_end"))
    first = own.where((F.col("conv") % stride == 0) & (F.col("pos") < most - 1)).select(F.col("conv").alias("base"), "pos", "digest", "chars")
    heads = each.where("taken > 0").join(first, "base").where(F.col("pos") < F.col("taken")).select("conv", (F.col("pos") + 1).alias("depth"), "digest", "chars", (F.col("pos") + 1 == F.col("length")).alias("is_end"))
    # lengths come to the rows by slot, so that the rows of a long conversation are not joined by one task
    slots = own.groupBy("conv", "slot").agg(F.count("*").alias("__n")).drop("__n").join(each, "conv")
    depth = F.col("pos") - F.col("h") + F.col("taken") + 1
    tails = own.join(slots, ["conv", "slot"]).where(F.col("pos") >= F.col("h")).select("conv", depth.alias("depth"), "digest", "chars", (depth == F.col("length")).alias("is_end"))
    return roots.unionByName(heads).unionByName(tails)


def parents(nodes: DataFrame, total: int) -> DataFrame:
    """nodes with parent_conv_id. Parents of more than one in a thousand of the nodes are looked up in a broadcast table of at
    most a thousand rows, all others by a join on the parent."""
    often = F.col("n_children") > max(1000, total // 1000)
    known = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("__conv"), "n_children")
    hot = known.where(often).select("parent", F.col("__conv").alias("__hot"))
    marked = nodes.join(F.broadcast(hot), "parent", "left")
    # a child of such a parent goes by its own id, which is nobody's parent here
    key = F.when(F.col("__hot").isNotNull() | F.col("parent").isNull(), F.concat(F.lit(b"-"), "id")).otherwise(F.col("parent"))
    rest = known.where(~often).select(F.col("parent").alias("__key"), "__conv")
    return marked.withColumn("__key", key).join(rest, "__key", "left").withColumn("parent_conv_id", F.coalesce("__hot", "__conv")).drop("__key", "__hot", "__conv")


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stride: int = 100, most: int = 6) -> DataFrame:
    """A row for each distinct sequence of leading turns of the rebuilt conversations (see rebuilt()), the empty one included:
    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves and
    saved_tokens (summed over the subtree: childless nodes, and (n_convs - 1) times the characters of the last text),
    ends_sha256 (of the members that end here).

    Turns are ordered by number (null first), then role, then text; repeated rows are turns of their own. A null role or
    text is empty; rows with a null conversation are left out. An empty table has no conversation and gives no row.
    """
    plain = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("conv is not null")
    items = written(rebuilt(plain, stride, most))
    deepest = items.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    path = written(paths(items, deepest))
    found = path.groupBy("id").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.first("parent", ignorenulls=True).alias("parent"))
    children = found.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "id")
    nodes = written(found.join(children, "id", "left").fillna(0, ["n_children"]))
    values = nodes.select("id", F.col("conv_id").alias("conv"), "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = rolled_up(path.select("conv", "depth", "id"), values, ["n_leaves", "saved_tokens"], deepest)
    ends = ends_digest(path.where("is_end").select("id", "conv"))
    whole = parents(nodes, nodes.count()).join(totals, "id").join(ends, "id", "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def crc32_sql(text: str) -> str:
    """The CRC-32 of an ASCII string in SQL, bit by bit."""
    step = "list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda crc, byte: {step}), 4294967295)"


def prefix_trie_sql(table: str = "conversations", stride: int = 100, most: int = 6) -> str:
    """The same by lists of whole prefixes in SQL."""
    return f"""WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
  {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM {table} WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % {stride} AS base, {crc32_sql('CAST(c AS VARCHAR)')} % {most} AS h FROM (SELECT DISTINCT c FROM own)),
parts AS (SELECT h.c, 0 AS side, o.pos, o.t FROM h JOIN own o ON o.c = h.base AND o.pos < h.h UNION ALL SELECT h.c, 1, o.pos, o.t FROM h JOIN own o ON o.c = h.c AND o.pos >= h.h),
lists AS (SELECT h.c, coalesce(p.l, []) AS l FROM h LEFT JOIN (SELECT c, list(t ORDER BY side, pos) AS l FROM parts GROUP BY 1) p USING (c)),
prefixes AS (SELECT c, d, l[1:d] AS l, d = len(l) AS is_end FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM lists)),
nodes AS (SELECT l, d AS depth, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends_sha256,
  (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(l[d].text) END AS saved FROM prefixes GROUP BY 1, 2),
kids AS (SELECT l[1:depth - 1] AS l, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
plus AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (l, depth)),
totals AS (SELECT l[1:e] AS l, e AS depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS e FROM plus) GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, t.n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM plus n JOIN totals t USING (l, depth) LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.l = n.l[1:n.depth - 1]"""
