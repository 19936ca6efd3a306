"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size. Within a
source the documents stand in order of size class (the whole part of the square root of the size),
then of a hash of their id; expected copies are summed along that order, one random offset is added,
and a document is emitted once for every whole number that its stretch of the sum crosses. Standing
in order of size, documents of all sizes are drawn evenly, so a source's words come near its target.

The sum needs no sorting of a whole source in one task: rows are counted by (source, class, slot),
slot being two hex digits of the hash, the counts are summed up within a class and the classes within
a source, and only the few rows of one slot are numbered by a window. All ranks are exact.

Nulls: a null text has size 0; a null source is a source of its own, after all others; documents of
equal id and size are interchangeable. A source of size 0 has target 0 and gives no copies.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def offset(seed: int) -> float:
    """The one random offset of a run, from 0 to below 1."""
    return random.Random(seed).random()


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so windows over all rows.

    Weights repeat over sources by code point, null last. A target stops at ``most`` times its source's
    size; what is above goes to the others by weight, again and again. That is min(weight * level,
    most * size) for one level: in order of most * size / weight, the first level that its own source
    can still take."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array([F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("room"))
    by_room = W.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.partitionBy())
    full = F.coalesce(F.sum("room").over(by_room.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by_room.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("level", (total - full) / left)
    level = F.max(F.when(F.col("level") <= F.col("room") / F.col("w"), F.col("level"))).over(W.partitionBy())
    return rows.select("source", "source_size", F.least(F.col("w") * level, F.col("room")).alias("target"))


def copies(
    df: DataFrame, size: str, doc_id: str = "doc_id", source: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 42, carry: Sequence[str] | None = None, once: bool = True
) -> DataFrame:
    """carried columns of df with source_size, target and copies; ``size`` names a long column of df.

    A carried column of one of these names gives way. Rows are written once to the checkpoint folder;
    with ``once`` false they are read twice instead, which suits rows that carry whole texts."""
    made = ["source_size", "target", "copies"]
    keep = common.carried(df, carry, made)
    key = F.md5(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")))
    # no key of a join or a window is null, so that both can share one exchange
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), named.alias("named"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    rows = rows.withColumn("class", F.floor(F.sqrt("size"))).withColumn("slot", F.substring("key", 1, 2))
    rows = common.cut(rows) if once else rows
    cells = common.cut(rows.groupBy("named", "class", "slot").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    classes = cells.groupBy("named", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sizes = classes.groupBy("named").agg(F.sum("words").alias("source_size"))
    aims = targets(sizes.select(F.nullif(F.col("named"), F.lit("")).alias("source"), "source_size"), weights, most)
    aims = aims.select(F.coalesce("source", F.lit("")).alias("named"), "source_size", "target")
    before = F.coalesce(F.sum("n").over(W.partitionBy("named").orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ahead = classes.select("named", "class", before.alias("ahead"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("named", "class").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("named", "class", "slot", before.alias("within")).join(ahead, ["named", "class"]).join(aims, "named")
    cells = common.cut(cells.select("named", "class", "slot", (F.col("within") + F.col("ahead")).alias("start"), "source_size", "target"))
    place = F.row_number().over(W.partitionBy("named", "class", "slot").orderBy("key", "size"))
    ranked = rows.withColumn("place", place).join(cells, ["named", "class", "slot"])
    rank, rate, u = F.col("start") + F.col("place"), F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)), F.lit(offset(seed))
    n = F.floor(u + rate * rank) - F.floor(u + rate * (rank - 1))
    return ranked.select("row.*", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), n.cast("int").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of ``copies`` as often as it says."""
    return mixed.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "source_size", "target")


def mix_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes) of every document."""
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(text).alias("size"))
    mixed = copies(rows, "size", "doc_id", "source", carry=["doc_id", "size"], **options)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: The same over documents, for DuckDB.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS room,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE
             - coalesce(sum(room) OVER (ORDER BY room / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY room / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
aims AS (
  SELECT source, source_size, least(w * (SELECT max(level) FROM levels WHERE level <= room / w), room) AS target FROM levels),
ranked AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
         row_number() OVER (PARTITION BY s.source ORDER BY floor(sqrt(s.size::DOUBLE)), s.key, s.size) AS place
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
counted AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor({offset(42)!r}::DOUBLE + target / source_size * place) - floor({offset(42)!r}::DOUBLE + target / source_size * (place - 1)) AS BIGINT) END AS n
  FROM ranked)
SELECT doc_id, size, source_size, target, size * n AS taken, CAST(n AS INTEGER) AS copies FROM counted
"""
