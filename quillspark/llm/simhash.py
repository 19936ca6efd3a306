"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint has 64 bits, one for each bit position that is set in over half of the XXH64 hashes
(seed 42) of a text's word shingles. Fingerprints that differ in at most ``radius`` bits are linked.

The index has a table for every choice of blocks of bits. Of ``blocks`` blocks, two linked fingerprints
agree in all but ``radius`` at least, so a table's upper nodes are the values of that many blocks: difference
0 under their mask. There are as many blocks as keep upper nodes small for the number of fingerprints, so
work grows about as they do. Below, fingerprints stand in order of the Gray rank of their other bits, a
range sort, and every run of ``leaf`` of them is a leaf with the mask and the pattern of the bits that all
of it shares; every ``FAN`` nodes in order have a node above them, with what these share, up to FAN nodes
below an upper node. From the top, pairs of nodes whose patterns differ in more than ``radius`` bits under both
masks are pruned with all below them; only the fingerprints of pairs of leaves that remain are compared. A hot
upper node spreads over as many leaves and partitions as its rows need.

Nulls: a null text is an empty one; empty texts have fingerprint 0 and are linked like any other. Rows
with equal doc_id stay rows of their own, as do repeated rows. A component's id is its smallest doc_id that
is not null. An empty table gives no rows. A long text is a step of its own, read as a whole. Columns of df
other than doc_id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RADIUS, LEAF, FAN, CROWD, RUN = 3, 1024, 32, 64, 1 << 14


def fingerprint_of(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of documents that have counts of the hashes (uint64) each, in order; bits are counted
    for a run of hashes at a time, so that memory does not grow with a text."""
    sums = np.zeros((len(counts), 64), np.int32)
    owner = np.repeat(np.arange(len(counts)), counts)
    for i in range(0, len(hashes), RUN):
        own = owner[i : i + RUN]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        bits = np.unpackbits(hashes[i : i + RUN].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every run of so many words, joined by one space; of all words if they are fewer."""
    found = text.lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, 42)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]


def fingerprints(df: DataFrame, text: str = "text", words: int = 3, carry=None, name: str = "fp") -> DataFrame:
    """carried columns and ``name``, the fingerprint as a (signed) long."""

    def make():
        def work(texts: pa.Array) -> list:
            lists = [shingle_hashes(x, words) for x in texts.cast(pa.binary()).to_pylist()]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            hashes = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
            return [fingerprint_of(hashes, counts).view(np.int64)]

        return work

    return common.map_text(df, text, [T.StructField(name, T.LongType())], make, carry)


def block_masks(blocks: int) -> list[int]:
    """The bits of each of so many blocks of 64 bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def blocks_for(count: int, radius: int, crowd: int = CROWD) -> int:
    """How many blocks keep upper nodes to about ``crowd`` of so many fingerprints, of those with at most 64 tables."""
    blocks = radius + 1
    while blocks < 64 and comb(blocks + 1, radius) <= 64 and count > crowd << ((64 // blocks) * (blocks - radius)):
        blocks += 1
    return blocks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs of a and b that differ in at most radius bits; rows of a, few at a time."""
    left, right = [], []
    for i in range(0, len(a), 256):
        x, y = np.nonzero(np.bitwise_count(a[i : i + 256, None] ^ b[None, :]) <= radius)
        left.append(x + i)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given ones do, at most one a node: each node and its smallest reachable one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


NODE = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "shift", "key", "rank")] + [T.StructField("fps", T.BinaryType())])


def batch(a, b, node=None, fps=None) -> pa.RecordBatch:
    """A batch of NODE: edges, or (shift, key, rank) of a leaf with its mask, its first fingerprint and all of them."""
    rest = [pa.nulls(len(a), pa.int64())] * 3 if node is None else [pa.array([x], pa.int64()) for x in node]
    last = pa.nulls(len(a), pa.binary()) if fps is None else pa.array(fps, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *rest, last], names=NODE.names)


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def links(distinct: DataFrame, fp: str = "fp", radius: int = RADIUS, leaf: int = LEAF, blocks: int | None = None, fan: int = FAN) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints just as all links of at most radius bits do."""
    if radius == 0:
        return distinct.sparkSession.createDataFrame([], LINK)
    blocks = blocks or blocks_for(distinct.count(), radius)
    masks = [signed(sum(some)) for some in combinations(block_masks(blocks), blocks - radius)]
    # shift numbers the tables; key holds the bits under a table's mask, gray is the rank of the others
    rows = distinct.select(F.posexplode(F.array([F.lit(m) for m in masks])).alias("shift", "mask"), F.col(fp).alias("fp"))
    rows = rows.select(F.col("shift").cast("long").alias("shift"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("gray"))
    for k in (1, 2, 4, 8, 16, 32):
        rows = rows.withColumn("gray", F.col("gray").bitwiseXOR(F.shiftrightunsigned("gray", k)))
    rows = rows.withColumn("gray", F.col("gray").bitwiseXOR(F.lit(-(1 << 63))))  # in order as unsigned
    ordered = rows.repartitionByRange("shift", "key", "gray").sortWithinPartitions("shift", "key", "gray")

    def build(batches):
        """Compares inside upper nodes and leaves; passes on leaves of nodes that have, or may have, others.

        Rows come in order, so an upper node is a run of them. One that stands first or last in its
        partition may go on in the next, and one of more than ``leaf`` rows has several leaves. A leaf is
        known by its table and its first fingerprint, wherever it is made."""
        rest, split = None, True

        def leaves(shift, key, fps, gray, outer: bool):
            for i in range(0, len(fps), leaf):
                own = fps[i : i + leaf]
                x, y = near(own, own, radius)
                yield batch(*forest(own[x[x < y]].view(np.int64), own[y[x < y]].view(np.int64)))
                if outer:
                    mask = ~np.bitwise_or.reduce(own ^ own[0])
                    yield batch(np.array([mask]).view(np.int64), own[:1].view(np.int64), (shift[0], key[0], gray[i]), [own.astype("<u8").tobytes()])

        def whole(shift, key, fps, gray):
            """Upper nodes of which all rows are here."""
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (shift[1:] != shift[:-1])]))
            sizes = np.diff(starts, append=len(key))
            for k in range(1, min(int(sizes.max()), 64)):  # all pairs of the many small nodes at once
                at = np.flatnonzero((key[k:] == key[:-k]) & (shift[k:] == shift[:-k]) & (np.bitwise_count(fps[k:] ^ fps[:-k]) <= radius))
                yield batch(fps[at].view(np.int64), fps[at + k].view(np.int64))
            for at in np.flatnonzero(sizes > 64).tolist():
                own = slice(starts[at], starts[at] + sizes[at])
                yield from leaves(shift[own], key[own], fps[own], gray[own], sizes[at] > leaf)

        for got in batches:
            now = tuple(got.column(i).to_numpy() for i in range(4))
            now = (*now[:2], now[2].view(np.uint64), now[3])
            rows = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now))
            if not len(rows[0]):
                continue
            alike = lambda i: (rows[0] == rows[0][i]) & (rows[1] == rows[1][i])  # noqa: B023, E731
            n = int(np.argmin(alike(0))) or len(rows[0])
            if split and n < len(rows[0]):  # the first upper node of the partition, or one begun before
                yield from leaves(*(x[:n] for x in rows), True)
                rows, split = tuple(x[n:] for x in rows), False
            n = int(np.argmax(alike(-1)))
            if n:
                yield from whole(*(x[:n] for x in rows))
                rows = tuple(x[n:] for x in rows)
            if len(rows[0]) >= 2 * leaf:
                n = len(rows[0]) - len(rows[0]) % leaf
                yield from leaves(*(x[:n] for x in rows), True)
                rows, split = tuple(x[n:] for x in rows), True
            rest = rows
        if rest is not None and len(rest[0]):
            yield from leaves(*rest, True)

    built = common.cut(ordered.mapInArrow(build, NODE))
    inside = built.where("key is null").select("a", "b")
    own = built.where("key is not null")
    kept = pruned(own.select("shift", "key", "rank", F.col("b").alias("node"), F.col("a").alias("mask"), F.col("b").alias("pattern")), radius, fan)
    rows = own.select("shift", F.col("b").alias("node"), "fps")
    pairs = kept.join(rows, ["shift", "node"]).join(rows.toDF("shift", "node2", "fps2"), ["shift", "node2"]).select("fps", "fps2")

    def across(batches):
        for got in batches:
            for x, y in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                x, y = np.frombuffer(x, "<u8").astype(np.uint64), np.frombuffer(y, "<u8").astype(np.uint64)
                i, j = near(x, y, radius)
                a, b = forest(x[i].view(np.int64), y[j].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return inside.union(pairs.mapInArrow(across, LINK))


def pruned(leaves: DataFrame, radius: int, fan: int = FAN) -> DataFrame:
    """(shift, node, node2): the pairs of leaves of one upper node that may hold linked fingerprints.

    leaves: shift, key, rank, node, mask, pattern. Nodes are put below others, ``fan`` by ``fan`` in order of rank,
    until no upper node has more than fan of them; pairs are then followed down from there."""
    key = ["shift", "key"]
    alone = F.count("*").over(W.partitionBy(*key)) > 1
    levels = [common.cut(leaves.withColumn("more", alone).where("more").drop("more"))]
    while (levels[-1].groupBy(*key).count().agg(F.max("count")).first()[0] or 0) > fan:
        place = F.floor((F.row_number().over(W.partitionBy(*key).orderBy("rank")) - 1) / fan).alias("above")
        below = common.cut(levels[-1].select("*", place))
        agree = F.bitwise_not(F.bit_or("pattern").bitwiseXOR(F.bit_and("pattern")))
        above = below.groupBy(*key, "above").agg(F.min("rank").alias("rank"), F.bit_and("mask").bitwiseAND(agree).alias("mask"), F.min("pattern").alias("pattern"))
        levels[-1:] = [below, common.cut(above.select(*key, "rank", F.col("above").alias("node"), "mask", "pattern"))]
    apart = F.bit_count(F.col("pattern").bitwiseXOR(F.col("pattern2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))
    again = lambda df: df.select(*key, *(F.col(c).alias(f"{c}2") for c in df.columns if c not in key))
    pairs = levels[-1].join(again(levels[-1]), key).where((F.col("rank") <= F.col("rank2")) & (apart <= radius)).select(*key, "node", "node2")
    for below in reversed(levels[:-1]):
        pairs = pairs.select(*key, F.col("node").alias("above"), F.col("node2").alias("above2"))
        pairs = pairs.join(below, [*key, "above"]).join(again(below), [*key, "above2"])
        pairs = common.cut(pairs.where((F.col("rank") <= F.col("rank2")) & (apart <= radius)).select(*key, "node", "node2"))
    return pairs.where("node != node2").select("shift", "node", "node2")


def rooted(distinct: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(fp, root): for each distinct fingerprint the smallest that links of at most radius bits reach."""
    roots = common.cut(common.components(links(distinct, "fp", radius, leaf)))
    found = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    return common.cut(found.select("fp", F.coalesce("root", "fp").alias("root")))


def clusters(prints: DataFrame, doc_id: str = "doc_id", fp: str = "fp", radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """(fp, component_id): for each distinct fingerprint the smallest doc_id that links of at most radius bits reach."""
    each = common.cut(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")))
    roots = common.cut(common.components(links(each, "fp", radius, leaf)))
    linked = each.join(roots, each["fp"] == roots["node"]).select("fp", "least", "root")
    least = common.cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    linked = linked.join(least, "root").select("fp", "component_id")
    single = each.join(roots, each["fp"] == roots["node"], "left_anti").select("fp", F.col("least").alias("component_id"))
    return common.cut(linked.union(single))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id."""
    prints = common.cut(fingerprints(df, text, words, [doc_id]))
    known = clusters(prints, doc_id, "fp", radius, leaf)
    out = prints.join(known, "fp")
    return out.select(F.col(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def identified(df: DataFrame, doc_id: str, text: str) -> tuple[str, str, DataFrame]:
    """Names of two columns and df with them: doc_id, and a number of the text, by which different texts differ."""
    ident, hashed = common.free_name(df, "ident"), common.free_name(df, "hashed")
    return ident, hashed, common.text_key(df, text, hashed).withColumn(ident, F.col(f"`{doc_id}`"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """The rows of df without all but one row of each component: the one with the smallest doc_id (null last),
    then the smallest hash of its text. Of rows equal in both, one stays."""
    ident, hashed, keyed = identified(df, doc_id, text)
    prints = common.cut(fingerprints(keyed, text, words, [ident, hashed], "fp").toDF("ident", "hashed", "fp"))
    known = rooted(common.cut(prints.select("fp").distinct()), radius, leaf)
    each = prints.groupBy("ident", "hashed", "fp").count()
    each = common.cut(each.join(known, "fp").select("ident", "hashed", "count", "root"))
    return first_of_each(df, keyed, ident, hashed, each)


def first_of_each(df: DataFrame, keyed: DataFrame, ident: str, hashed: str, each: DataFrame) -> DataFrame:
    """The rows of df, which ``identified`` keyed, that stay of the components in each: ident, hashed, count, root."""
    first = F.struct(F.col("ident").isNull().alias("none"), "ident", "hashed")
    best = common.cut(each.groupBy("root").agg(F.min(first).alias("best")))
    marked = each.join(best, "root").withColumn("stays", F.col("ident").eqNullSafe(F.col("best.ident")) & (F.col("hashed") == F.col("best.hashed")))
    mark = common.free_name(keyed, "mark")
    marked = marked.where(~F.col("stays") | (F.col("count") > 1)).select(F.struct("ident", "hashed", "stays").alias(mark))
    marked = common.cut(marked)
    few = common.few(marked)
    joined = keyed.join(marked if few is None else few, F.col(ident).eqNullSafe(F.col(f"{mark}.ident")) & (F.col(hashed) == F.col(f"{mark}.hashed")), "left")
    stays = F.col(f"{mark}.stays")
    alone = joined.where(stays.isNull())
    repeated = joined.where(stays).dropDuplicates([ident, hashed])
    return alone.union(repeated).select(*[F.col(f"`{c}`") for c in df.columns])
