"""Mixing documents to target weights: iterative proportional fitting of token weights, then sampling.

Only DataFrame functions. Documents are counted into cells (source, language, topic); the cells' token weights are raked
to the three target marginals in turn; each cell's documents are drawn at one rate, calibrated so that the expected
tokens are the wanted share of all tokens. A rate of 2.3 gives two copies and, by probability 0.3, a third one: scarce
cells reach their weight by repetition, as no probability up to 1 could. What is raked is the table of cells, however
many documents there are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import unused, written

DIMENSIONS = ("source", "lang", "topic")
WORDS = r"[^\x20\x09-\x0D]+"
FEW_CELLS = 100_000  # up to so many cells are raked in one partition, which spares the exchanges
NONE = "(none)"


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A coarse topic by form: licensed, contact, table, or prose by length; a null or word-less text is empty."""
    return (
        F.when(n_tokens == 0, "empty")
        .when(F.lower(text).contains("license"), "licensed")
        .when(text.contains("@"), "contact")
        .when(text.contains(" | "), "table")
        .when(n_tokens >= 400, "prose-long")
        .otherwise("prose-short")
    )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and n_tokens (words) of every document; null categories are '(none)'."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    named = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in ("source", "lang")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *named, n.alias("n_tokens")).select("doc_id", "source", "lang", topic_of(F.col("text"), F.col("n_tokens")).alias("topic"), "n_tokens")


def _weight(d: str, wanted: Mapping[str, float] | float, own: Column) -> Column:
    """What a category counts for: its weight in the mapping (else 0), or its tokens `own` to the power given."""
    if not isinstance(wanted, Mapping):
        return F.pow(own, F.lit(float(wanted)))
    return F.coalesce(F.create_map(*[F.lit(x) for k, v in wanted.items() for x in (k, float(v))])[F.col(d)], F.lit(0.0)) if wanted else F.lit(0.0)


def _ratio(x: Column, total: Column) -> Column:
    return F.coalesce(x / F.nullif(total, F.lit(0.0)), F.lit(0.0))


def _total(df: DataFrame, column: str) -> float:
    return float(df.agg(F.sum(column)).first()[0] or 0.0)


def target_shares(cells: DataFrame, d: str, wanted: Mapping[str, float] | float) -> DataFrame:
    """(d, t_<d>): the target share of each category that has tokens.

    A number is an exponent: shares in proportion to the categories' tokens to that power. A mapping gives weights; a
    category without one gets 0, and weights of categories without tokens go to the others in proportion.
    """
    own = cells.groupBy(d).agg(F.sum("mass").alias("mass")).select(d, _weight(d, wanted, F.col("mass")).alias("t"))
    return own.select(d, _ratio(F.col("t"), F.lit(_total(own, "t"))).alias(f"t_{d}"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], rounds: int = 8, few: bool = True) -> DataFrame:
    """cells(source, lang, topic, mass > 0) with weight: the masses' shares, fitted to each marginal in turn, `rounds` times.

    few: the cells fit one task, and are fitted there by windows in one job; else every sum is a distributed
    aggregation that is joined back, and each step is a written table. Weights are the same.
    """
    if few:
        out = cells.coalesce(1)
        for d in DIMENSIONS:
            own = Window.partitionBy(d)
            once = F.row_number().over(own.orderBy(*DIMENSIONS)) == 1  # each category once, though it has many cells
            out = out.withColumn("t", _weight(d, targets[d], F.sum("mass").over(own))).withColumn("once", once)
            out = out.withColumn(f"t_{d}", _ratio(F.col("t"), F.sum(F.when(F.col("once"), F.col("t"))).over(Window.partitionBy()))).drop("t", "once")
        out = out.withColumn("weight", F.col("mass") / F.sum("mass").over(Window.partitionBy()))
        for _ in range(rounds):
            for d in DIMENSIONS:
                out = out.withColumn("weight", _ratio(F.col("weight") * F.col(f"t_{d}"), F.sum("weight").over(Window.partitionBy(d))))
        return out
    out = cells
    for d in DIMENSIONS:
        out = out.join(target_shares(cells, d, targets[d]), d)
    out = written(out.withColumn("weight", _ratio(F.col("mass"), F.lit(_total(cells, "mass")))))
    for _ in range(rounds):
        for d in DIMENSIONS:
            sums = out.groupBy(d).agg(F.sum("weight").alias("sum"))
            out = written(out.join(sums, d).withColumn("weight", _ratio(F.col("weight") * F.col(f"t_{d}"), F.col("sum"))).drop("sum"))
    return out


def uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed, the same wherever it is computed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(NONE)))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def copies_of(rate: Column, id_col: str, seed: int) -> Column:
    """The rate's whole part, and one more by the probability of the rest; the same wherever the id is."""
    return (F.floor(rate) + (uniform(id_col, seed) < rate - F.floor(rate)).cast("int")).cast("int")


def fitted_cells(rows: DataFrame, targets: Mapping[str, Mapping[str, float] | float], keep: float, rounds: int, few_cells: int = FEW_CELLS) -> tuple[DataFrame, bool]:
    """The rate of each cell of measured() rows, as a written table, and whether it is small enough to broadcast."""
    cells = written(rows.where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("mass")))
    count, tokens = cells.agg(F.count("*"), F.coalesce(F.sum("mass"), F.lit(0.0))).first()
    few = count <= few_cells
    rate = F.lit(keep * tokens) * F.col("weight") / F.col("mass")
    return written(rake(cells, targets, rounds, few).select(*DIMENSIONS, "weight", rate.alias("rate"))), few


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], keep: float = 0.5, rounds: int = 8, seed: int = 6, few_cells: int = FEW_CELLS) -> DataFrame:
    """Every document with its topic, tokens, the rate of its cell (its expected copies), and how many copies it has.

    Documents without words are never drawn. Equal rows share one fate. An empty table gives an empty one. few_cells:
    up to so many cells are raked in one task; it changes no result.
    """
    rows = written(measured(docs))
    fitted, few = fitted_cells(rows, targets, keep, rounds, few_cells)
    out = rows.join(F.broadcast(fitted) if few else fitted, list(DIMENSIONS), "left")
    rate = F.when(F.col("n_tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0)
    return out.select("doc_id", *DIMENSIONS, "n_tokens", rate.alias("rate")).withColumn("copies", copies_of(F.col("rate"), "doc_id", seed))


def report(mixed: DataFrame, targets: Mapping[str, Mapping[str, float] | float]) -> DataFrame:
    """What mix() reached: dimension, category, its shares of all tokens, of the target, of expected and of drawn tokens,
    and residual (expected less target)."""
    cells = mixed.where("n_tokens > 0").groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("mass"), F.sum(F.col("n_tokens") * F.col("rate")).alias("expected"), F.sum(F.col("n_tokens") * F.col("copies")).cast("double").alias("drawn"))
    cells = written(cells)
    total = {c: F.lit(_total(cells, c)) for c in ("mass", "expected", "drawn")}
    out = None
    for d in DIMENSIONS:
        own = cells.groupBy(d).agg(*[F.sum(c).alias(c) for c in ("mass", "expected", "drawn")]).join(target_shares(cells, d, targets[d]), d)
        shares = [_ratio(F.col(c), total[c]).alias(n) for c, n in (("mass", "source_share"), ("expected", "expected_share"), ("drawn", "drawn_share"))]
        part = own.select(F.lit(d).alias("dimension"), F.col(d).alias("category"), F.col(f"t_{d}").alias("target"), *shares).withColumn("residual", F.col("expected_share") - F.col("target"))
        out = part if out is None else out.unionByName(part)
    return out


def selected(docs: DataFrame, targets: Mapping[str, Mapping[str, float] | float], keep: float = 0.5, rounds: int = 8, seed: int = 6, few_cells: int = FEW_CELLS) -> DataFrame:
    """The rows of docs that mix() draws, each as often as it has copies, with all their columns.

    Ids repeat: the rows of an id are copies of one document, which copy_numbers() tells apart. Equal rows of docs, and
    rows of one id, share one fate."""
    fitted, few = fitted_cells(measured(docs), targets, keep, rounds, few_cells)
    name = {x: unused(docs, f"own_{x}") for x in ("n", "rate", "copy", *DIMENSIONS)}
    cells = fitted.select(*[F.col(d).alias(name[d]) for d in DIMENSIONS], F.col("rate").alias(name["rate"]))
    n = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    own = docs.withColumn(name["n"], n).where(F.col(name["n"]) > 0)
    named = {"source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)), "lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)), "topic": topic_of(F.col("text"), F.col(name["n"]))}
    own = own.withColumns({name[d]: x for d, x in named.items()})
    drawn = own.join(F.broadcast(cells) if few else cells, [name[d] for d in DIMENSIONS])
    return drawn.withColumn(name["copy"], F.explode(F.array_repeat(F.lit(1), copies_of(F.col(name["rate"]), "doc_id", seed)))).select(*docs.columns)


def copy_numbers(drawn: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows with the number of each among those of its id and text, from 1; a null id counts as one. Texts move once, to their id."""
    return drawn.withColumn(out, F.row_number().over(Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(1))))


def mix_sql(exponents: Mapping[str, float], keep: float = 0.5, rounds: int = 8, seed: int = 6, table: str = "documents") -> str:
    """The same in SQL, for targets given as exponents."""
    steps = [
        f"""n AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, text,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0) AS n_tokens FROM {table})""",
        """m AS (SELECT doc_id, source, lang, CASE WHEN n_tokens = 0 THEN 'empty' WHEN contains(lower(text), 'license') THEN 'licensed'
  WHEN contains(text, '@') THEN 'contact' WHEN contains(text, ' | ') THEN 'table' WHEN n_tokens >= 400 THEN 'prose-long'
  ELSE 'prose-short' END AS topic, CAST(n_tokens AS BIGINT) AS n_tokens FROM n)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM m WHERE n_tokens > 0 GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        steps.append(f"own_{d} AS (SELECT {d}, power(sum(mass), {exponents[d]}) AS t FROM cells GROUP BY {d})")
        steps.append(f"share_{d} AS (SELECT {d}, t / sum(t) OVER () AS t_{d} FROM own_{d})")
    steps.append("w0 AS (SELECT cells.*, t_source, t_lang, t_topic, mass / sum(mass) OVER () AS weight FROM cells JOIN share_source USING (source) JOIN share_lang USING (lang) JOIN share_topic USING (topic))")
    k = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            steps.append(f"w{k + 1} AS (SELECT source, lang, topic, mass, t_source, t_lang, t_topic, weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight FROM w{k})")
            k += 1
    steps += [
        f"p AS (SELECT source, lang, topic, {keep} * sum(mass) OVER () * weight / mass AS rate FROM w{k})",
        f"""d AS (SELECT m.*, coalesce(rate, 0.0) AS q, CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '{NONE}')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM m LEFT JOIN p ON m.n_tokens > 0 AND m.source = p.source AND m.lang = p.lang AND m.topic = p.topic)""",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, topic, n_tokens, round(q, 6) AS rate, CAST(floor(q) + CAST(u < q - floor(q) AS INTEGER) AS INTEGER) AS copies FROM d"
