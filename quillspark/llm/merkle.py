"""Merkle manifest of a dataset: a tree of hashes for each group of rows, and one over the groups.

Rows are put in order by a range sort, without a window over a whole group: a row's place is its place in its
partition and the rows of its group in partitions before. Runs of ``block`` consecutive leaves are gathered, and
each block is reduced to its root in a task of its own. While that leaves more than ``top`` roots, blocks of roots
are reduced in the same way, so what comes to the driver has a fixed bound. The driver builds the tree above, over
the groups' trees and on to the root, and broadcasts the rest of the path for each root it was given. From there
paths are completed downwards, block by block, and each row folds its own path to a root.

Leaves are ordered by group (null first, then by bytes), by key (null first), and among equal keys by the leaf itself;
rows equal in all fields have equal leaves, so their order does not matter to the tree. Null fields are ``-``, which no
value is, as values begin with their length. An empty table gives no rows. Texts of any length are hashed
by the JVM where they stand; only leaves move. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import common

BLOCK, TOP = 1024, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = T.ArrayType(T.StringType())


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as a leaf has it: its bytes, counted, or - for null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The hash of the values one after another, in lowercase hex."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (with a column tree) with place, from 0 in their tree in the given order, and total, rows of the tree.

    Equal rows may lie in different partitions, so that no key gathers its rows in one task."""
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    keys = ["tree", *order, "salt"]
    ordered = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    placed = common.written(ordered.withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33).alias("part")
    runs = placed.groupBy("tree", part).agg(F.min("id").alias("first"), F.count("*").alias("n"))  # a row for each partition and tree that meet
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(W.partitionBy("tree")))
    runs = common.cut(runs)
    few = common.few(runs)
    found = placed.withColumn("part", F.shiftright("id", 33)).join(runs if few is None else few, ["tree", "part"])
    return found.withColumn("place", F.col("id") - F.col("first") + F.col("before")).drop("id", "part", "first", "n", "before")


def levels(digests: list[str], stop: int | None = None) -> list[list[str]]:
    """The nodes of each level from the given ones up to one node, or ``stop`` levels up."""
    made = [digests]
    while len(made) <= stop if stop is not None else len(made[-1]) > 1:
        last = made[-1]
        made.append([sha(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return made


def path(made: list[list[str]], i: int) -> list[str]:
    """What stands beside node i and the nodes above it: "l" or "r" for its side and the digest; "" where it is alone."""
    steps = []
    for nodes in made[:-1]:
        beside = i ^ 1
        steps.append(("r" if i % 2 == 0 else "l") + nodes[beside] if beside < len(nodes) else "")
        i >>= 1
    return steps


def height(count: int, block: int, whole: int) -> int | None:
    """Levels to reduce a block by: all of a full one's if the tree has more blocks, else up to one node (None)."""
    return None if whole <= block else block.bit_length() - 1


def blocks(nodes: DataFrame, block: int) -> DataFrame:
    """(tree, block, total, digest, items): runs of consecutive nodes of a tree, with all columns of nodes as items,
    and the digest that each is reduced to."""
    items = F.array_sort(F.collect_list(F.struct("place", "digest", *[c for c in nodes.columns if c not in ("tree", "place", "digest", "total")])))
    # "place" leads the structs, so they are in order of it
    made = nodes.groupBy("tree", F.floor(F.col("place") / block).cast("long").alias("block")).agg(F.first("total").alias("total"), items.alias("items"))

    def run(batches):
        for batch in batches:
            out = []
            for total, items in zip(batch.column(2).to_pylist(), batch.column(3)):
                digests = items.values.field("digest").to_pylist()
                out.append(levels(digests, height(len(digests), block, total))[-1][0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "digest"])

    return common.written(common.map_batches(made, run, T.StructType([*made.schema.fields, T.StructField("digest", T.StringType())])))


def opened(blocks_: DataFrame, suffixes: DataFrame, block: int) -> DataFrame:
    """The items of blocks with their path (those of the block and, from suffixes, those above), subroot and root."""
    few = common.few(suffixes, TOP)
    whole = blocks_.join(suffixes if few is None else few, ["tree", "block"])
    kind = blocks_.schema["items"].dataType.elementType
    keep = [f for f in kind.fields if f.name not in ("place", "digest")]
    schema = T.StructType([T.StructField("tree", T.StringType()), T.StructField("place", T.LongType()), T.StructField("digest", T.StringType()), *keep,
                           T.StructField("path", PATH), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])

    def run(batches):
        for batch in batches:
            for tree, total, items, above, sub, root in zip(*(batch.column(i).to_pylist() if i != 2 else batch.column(i) for i in range(6))):
                digests = items.values.field("digest").to_pylist()
                made = levels(digests, height(len(digests), block, total))
                n = len(digests)
                paths = pa.array([path(made, i) + above for i in range(n)], pa.list_(pa.string()))
                own = [items.values.field(f.name) for f in keep]
                same = [pa.array([x] * n, pa.string()) for x in (sub, root)]
                yield pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.string()), items.values.field("place"), items.values.field("digest"), *own, paths, *same], names=schema.names)

    return common.map_batches(whole.select("tree", "total", "items", "path", "subroot", "root"), run, schema)


def summit(roots: list[tuple[str, int, str]]) -> list[tuple[str, int, list[str], str, str]]:
    """(tree, place, path, subroot, root) of the topmost roots (tree, place, digest), which are all of them."""
    trees: dict[str, list[str]] = {}
    for tree, _, digest in sorted(roots):
        trees.setdefault(tree, []).append(digest)
    own = {tree: levels(digests) for tree, digests in trees.items()}
    order = sorted(own, key=str.encode)
    above = levels([own[tree][-1][0] for tree in order])
    out = []
    for at, tree in enumerate(order):
        rest = path(above, at)
        out += [(tree, i, path(own[tree], i) + rest, own[tree][-1][0], above[-1][0]) for i in range(len(trees[tree]))]
    return out


def proven(leaves: DataFrame, order: Sequence[str] = ("key", "digest"), block: int = BLOCK, top: int = TOP) -> DataFrame:
    """leaves (tree, digest and more) with place, path, subroot and root. tree orders the trees, by its bytes."""
    spark = leaves.sparkSession
    nodes, done = ranked(leaves, order), []
    while True:
        done.append(blocks(nodes, block))
        roots = done[-1].select("tree", F.col("block").alias("place"), "digest", F.ceil(F.col("total") / block).cast("long").alias("total"))
        if roots.count() <= top or roots.where("total > 1").isEmpty():
            break
        nodes = roots
    sides = [T.StructField("tree", T.StringType()), T.StructField("block", T.LongType()), T.StructField("path", PATH), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())]
    if roots.count() <= top:
        above = spark.createDataFrame(summit([(r.tree, r.place, r.digest) for r in roots.collect()]), T.StructType(sides))
    else:  # more trees than come to the driver: their roots are the leaves of one tree
        single = roots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("key"))
        whole = proven(single, ("key",), block, top)
        above = common.written(whole.select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root"))
    for lower in reversed(done[1:]):
        found = opened(lower, above, block)
        above = common.written(found.select("tree", F.col("place").alias("block"), "path", "subroot", "root"))
    return opened(done[0], above, block)


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf's digest gives with the digests along its path."""
    join = lambda now, step: F.when(step.startswith("l"), F.concat(F.substr(step, F.lit(2)), now)).otherwise(F.concat(now, F.substr(step, F.lit(2))))
    return F.aggregate(steps, digest, lambda now, step: F.sha2(join(now, step), 256))


def proof(steps: Column) -> Column:
    """The digests along a path, one after another."""
    return F.array_join(F.transform(steps, lambda s: F.substr(s, F.lit(2))), "")


def manifest(df: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", also: dict[str, Column] | None = None, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """Of each row of df: key, leaf, path (see ``path``), subroot (its group's), root, and what ``also`` computes of it."""
    own = F.col(f"`{group}`").cast("string")
    rows = df.select(
        F.coalesce(F.concat(F.lit("1"), own), F.lit("0")).alias("tree"), F.col(f"`{key}`").alias("key"), leaf([F.col(f"`{f}`") for f in fields]).alias("digest"),
        *[value.alias(f"also_{name}") for name, value in (also or {}).items()],
    )
    found = proven(common.written(rows), block=block, top=top)  # the range sort reads its input twice
    return found.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "path", "subroot", "root", *[F.col(f"also_{name}").alias(name) for name in also or {}])


def changed(df: DataFrame, fields: Sequence[str], replaced: dict[str, Column]) -> Column:
    """The leaf of a row of df with some of its fields replaced."""
    return leaf([replaced.get(f, F.col(f"`{f}`")) for f in fields])


def report(df: DataFrame, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """The check of a manifest by tampered rows: where 7 divides the CRC-32 of doc_id, one is added to n_chars.

    doc_id, leaf, subroot, root, proof_sha256 (all untampered), folded_root (from the tampered, else the original leaf)
    and verified. A row without doc_id is not tampered with; one without n_chars stays as it is, and so verifies."""
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(picked, changed(df, FIELDS, {"n_chars": F.col("n_chars").cast("decimal(38,0)") + 1}))
    made = manifest(df, also={"tampered": tampered}, block=block, top=top)
    made = made.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _said(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


_CRC = """xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b:
  list_reduce(list_transform(range(8), lambda k: 0::BIGINT), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(a, b)),
  4294967295::BIGINT), 4294967295)"""

#: ``report`` over documents, for DuckDB: the levels of all trees, each row's path through them, and a fold along it.
SQL = f"""
WITH RECURSIVE
d AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS tree,
    sha256({" || ".join(_said(f) for f in FIELDS)}) AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN sha256({" || ".join(_said("n_chars + 1" if f == "n_chars" else f) for f in FIELDS)}) END AS other
  FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d),
lv AS (
  SELECT tree, 0 AS l, place, leaf AS digest, n FROM o
  UNION ALL
  SELECT tree, l + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY tree, l, place // 2, n),
t AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM lv WHERE n = 1),
up AS (
  SELECT 0 AS l, place, subroot AS digest, n FROM t
  UNION ALL
  SELECT l + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY l, place // 2, n),
low AS (SELECT DISTINCT tree, l FROM lv WHERE n > 1),
high AS (SELECT DISTINCT l FROM up WHERE n > 1),
steps AS (
  SELECT o.rid, low.l AS step, CASE WHEN b.digest IS NULL THEN '' WHEN (o.place >> low.l) & 1 = 1 THEN 'l' || b.digest ELSE 'r' || b.digest END AS beside
  FROM o JOIN low ON o.tree = low.tree LEFT JOIN lv AS b ON b.tree = o.tree AND b.l = low.l AND b.place = xor(o.place >> low.l, 1)
  UNION ALL
  SELECT o.rid, 100 + high.l, CASE WHEN b.digest IS NULL THEN '' WHEN (t.place >> high.l) & 1 = 1 THEN 'l' || b.digest ELSE 'r' || b.digest END
  FROM o JOIN t ON o.tree = t.tree CROSS JOIN high LEFT JOIN up AS b ON b.l = high.l AND b.place = xor(t.place >> high.l, 1)),
p AS (SELECT rid, list(beside ORDER BY step) AS path FROM steps GROUP BY rid),
f AS (
  SELECT o.doc_id, o.leaf, t.subroot, (SELECT digest FROM up WHERE n = 1) AS root, coalesce(p.path, []) AS path, coalesce(o.other, o.leaf) AS now
  FROM o JOIN t ON o.tree = t.tree LEFT JOIN p ON o.rid = p.rid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(list_reduce(list_transform(path, lambda x: substr(x, 2)), lambda a, b: a || b, ''), '')) AS proof_sha256,
  list_reduce(path, lambda a, b: sha256(CASE WHEN b[1] = 'l' THEN substr(b, 2) || a ELSE a || substr(b, 2) END), now) AS folded_root,
  list_reduce(path, lambda a, b: sha256(CASE WHEN b[1] = 'l' THEN substr(b, 2) || a ELSE a || substr(b, 2) END), now) = root AS verified
FROM f
"""
