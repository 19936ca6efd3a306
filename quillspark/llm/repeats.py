"""Removal of long repeated byte strings by bucket-pointer refinement over Spark.

Every position of a text belongs to a bucket of equal q-grams (q = 25). Bucket identifiers are a
function of content, so they need no numbering. They are refined by the identifiers at later offsets, and
what comes out is refined again: (bucket at p, bucket at p + 25) is the bucket of 50 bytes at p, from these
come those of 100, 200 and 400 bytes, the full length, and again those of runs and blocks of windows. Two
windows of 400 bytes are equal if and only if their identifiers are (hashes of 64 bits, together with the 64
of their 200 bytes). Only positions that can still have an equal are sorted, on these identifiers:

each window of 400 bytes has an anchor, the least bucket of 200 bytes in it, the
leftmost if several are least. Equal windows have equal anchors at equal places, so

1. anchors alone are sorted into buckets, and those with a bucket to themselves are dropped;
2. the run of windows that share an anchor is refined as a whole, by the buckets of its first and its
   last window: runs that occur twice are repeated throughout;
3. the windows of what is left are refined one by one, in blocks first, against each other and one run
   of every kind from step 2.

Buckets are Spark aggregates with partial sums, never lists, so a hot bucket is one row for each task.
Texts that occur more than once are repeated throughout, and count once in all other comparisons.

A null text is an empty one; nothing of texts below 400 bytes is removed. Rows of equal text have equal results,
whatever their other columns, and doc_ids that are null or repeated stay as they are. An empty table gives no rows.
A text of any length is worked on in segments. Texts are told apart by 64 bits; where these do not suffice, which is
looked for in all texts, by others.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH, Q, GRAM, SEGMENT, BLOCK = 400, 200, 25, 1 << 21, 16
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def refined(bucket: np.ndarray, gap: int) -> np.ndarray:
    """Buckets of longer strings: each bucket by the one that stands gap positions later."""
    later = bucket[gap:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(bucket[: len(later)] * np.uint64(0x9FB21C651E98DF25) + (later ^ (later >> np.uint64(31))))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, the powers of the base and those of its inverse, modulo 2^64."""
    n = SEGMENT + 8 * LENGTH
    inverse = pow(BASE, -1, 1 << 64)
    up, down = (np.cumprod(np.array([1] + [b] * n, np.uint64)) for b in (BASE, inverse))
    return np.random.default_rng(7).integers(0, 1 << 64, 256, np.uint64), up, down


def buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of Q bytes at each position where so many begin: that of GRAM bytes, refined again and again."""
    table, up, down = powers()
    n = len(data)
    if n < Q:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * up[:n], out=total[1:])
    bucket, size = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1]), GRAM
    while size < Q:
        bucket, size = refined(bucket, size), 2 * size
    return bucket


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of width values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(offsets: np.ndarray):
    """(first row, last row + 1, start byte, end byte) of stretches to work on: whole rows, or part of a long one.

    Parts of one row overlap in LENGTH - 1 bytes, so that each window is whole in just one of them."""
    sizes = np.diff(offsets)
    for a, b in common.steps(sizes, SEGMENT):
        start, end = int(offsets[a]), int(offsets[b])
        while end - start > SEGMENT + LENGTH:
            yield a, b, start, start + SEGMENT + LENGTH - 1
            start += SEGMENT
        yield a, b, start, end


def runs(data: np.ndarray, offsets: np.ndarray):
    """For each segment (row, lo, n, h, r, p) of its runs: windows lo to lo + n - 1 of the row have one anchor,
    whose bucket is h; r is the bucket of all that these windows hold; p is the anchor's place."""
    bits = np.uint64((1 << 22) - 1)
    for a, b, start, end in segments(offsets):
        part = data[start:end]
        if len(part) < LENGTH:
            continue
        q = buckets(part)
        anchor = (least((q & ~bits) | np.arange(len(q), dtype=np.uint64), LENGTH - Q + 1) & bits).astype(np.int64)
        whole = np.zeros(len(anchor) + 1, bool)
        own = np.clip(offsets[a : b + 1] - start, 0, len(part))
        for x, y in zip(own[:-1].tolist(), own[1:].tolist()):
            whole[x : max(x, y - LENGTH + 1)] = True
        at = np.flatnonzero(whole[:-1])
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(anchor[at]) != 0) | (np.diff(at) != 1)
        first = np.flatnonzero(new)
        lo, n = at[first], np.diff(first, append=len(at))
        full = refined(q, LENGTH - Q)
        place = anchor[lo]
        r = mix(full[lo] * np.uint64(3) + full[lo + n - 1] * np.uint64(0x165667B19E3779F9) + ((place - lo) << 20 | n).astype(np.uint64))
        row = np.searchsorted(offsets, lo + start, "right") - 1
        row = np.minimum(row, b - 1)
        yield row, lo + start - offsets[row], n, q[place], r, place + start - offsets[row]


def longs(*names: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in names])


RUN = longs("id", "h", "r", "lo", "n", "p")
BLOCKS = T.StructType([*longs("id", "h", "core", "big", "lo", "at").fields, T.StructField("windows", T.ArrayType(T.LongType()))])
OPEN = "struct<lo: bigint, n: bigint, p: bigint, h: bigint>"


def anchors(texts: DataFrame) -> DataFrame:
    """RUN rows of (id, text), and one row without h for each text, with its length as n."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = common.byte_view(batch.column(1))
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids), none, none, none, pa.array(np.diff(offsets)), none], names=RUN.names)
            for row, lo, n, h, r, p in runs(data, offsets):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[row], h.view(np.int64), r.view(np.int64), lo, n, p)], names=RUN.names)

    return common.map_batches(texts, run, RUN)


def block_rows(text: np.ndarray, lo: np.ndarray, n: np.ndarray, p: np.ndarray):
    """(run, first window, windows in the run, core, big, place, window buckets) of the blocks of runs of a text.

    Blocks of windows are counted from the anchor, so equal runs have equal blocks. core is the bucket of
    what all windows of a block share, big that of all they hold; 0 if the text has not the whole block."""
    q = buckets(text)
    full, shared = refined(q, LENGTH - Q), refined(q, LENGTH - BLOCK + 1 - Q)
    least_x, most_x = p - lo - n + 1, p - lo
    first, last = least_x // BLOCK, most_x // BLOCK
    run = np.repeat(np.arange(len(lo)), last - first + 1)
    k = np.arange(len(run)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[run]
    s = p[run] - BLOCK * k - BLOCK + 1  # the block's first window, should the run and the text have it
    core = mix(shared[s + BLOCK - 1] + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    whole = (s >= 0) & (s + BLOCK - 1 < len(full))
    big = np.zeros(len(s), np.uint64)
    big[whole] = mix(full[s[whole]] + np.uint64(31) * full[s[whole] + BLOCK - 1]) | np.uint64(1)
    a, b = np.maximum(s, lo[run]), np.minimum(s + BLOCK, lo[run] + n[run])
    return run, a, b - a, core, big, s, full


def blocks(opened: DataFrame) -> DataFrame:
    """BLOCKS rows of (id, text, open runs)."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offsets = common.byte_view(batch.column(1))
            for i, some in enumerate(batch.column(2)):
                lo, n, p, h = (some.values.field(c).to_numpy() for c in ("lo", "n", "p", "h"))
                text = data[offsets[i] : offsets[i + 1]]
                for at in range(0, len(text), SEGMENT):  # a long text in parts that overlap
                    own = (lo >= at) & (lo < at + SEGMENT)
                    if not own.any():
                        continue
                    start = max(0, at - 2 * LENGTH)
                    part = text[start : at + SEGMENT + 3 * LENGTH]
                    of, a, size, core, big, s, full = block_rows(part, lo[own] - start, n[own], p[own] - start)
                    ends = np.concatenate([[0], np.cumsum(size)])
                    place = np.arange(ends[-1]) + np.repeat(a - ends[:-1], size)
                    big = np.where(big > 0, big, mix((a + start).astype(np.uint64) * np.uint64(2) + np.uint64(ids[i] & 0xFFFFFFFFFFFFFFFF)) & ~np.uint64(1))
                    windows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(full[place].view(np.int64)))
                    columns = [pa.array(np.full(len(a), ids[i], np.int64)), *(pa.array(x) for x in (h[own][of], core.view(np.int64), big.view(np.int64), a + start, s + start)), windows]
                    yield pa.RecordBatch.from_arrays(columns, names=BLOCKS.names)

    return common.map_batches(opened, run, BLOCKS)


def twice(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The buckets, by keys, that stand at two places g or more."""
    return common.cut(rows.groupBy(*keys).agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a < b").select(*keys))


def split(rows: DataFrame, coarse: list[str], fine: str) -> DataFrame:
    """rows (with a place g) of repeated coarse buckets, refined: ``same`` marks those whose fine bucket is
    repeated too, ``open`` those to refine further: rows alone in their fine bucket, and with them one row of
    each repeated fine bucket of the same coarse one, which they may still equal in part."""
    each = rows.groupBy(*coarse, fine).agg(F.min("g").alias("one"), F.max("g").alias("b"))
    each = each.withColumn("same", F.col("one") < F.col("b"))
    above = common.cut(each.groupBy(*coarse).agg(F.min("one").alias("a"), F.max("b").alias("b"), F.bool_and("same").alias("done")))
    kinds = each.select(*coarse, fine, "one", "same").join(above.where("a < b").select(*coarse, "done"), coarse)
    found = rows.join(common.cut(kinds), [*coarse, fine])
    return found.withColumn("open", ~F.col("same") | (~F.col("done") & (F.col("g") == F.col("one"))))


def removed(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, lo, n) of repeated windows in texts of (id, text), and the ids of texts that occur twice or more."""
    place = F.xxhash64("id", "lo").alias("g")
    found = common.written(anchors(texts))
    copies = common.cut(found.where("h is null").groupBy("id").count().where("count > 1").select("id"))
    found = found.where("h is not null").select("*", place)
    found = common.written(found.join(twice(found, ["h"]), "h"))
    level = common.cut(split(found, ["h"], "r").select("id", "h", "lo", "n", "p", "same", "open"))
    spans = level.where("same").select("id", "lo", "n")
    opened = common.cut(level.where("open").groupBy("id").agg(F.collect_set(F.struct("lo", "n", "p", "h")).alias("runs")))
    few = common.few(opened.select("id"))
    own = texts if few is None else texts.join(few, "id", "left_semi")
    opened = own.dropDuplicates(["id"]).join(opened, "id").select("id", "text", "runs")
    # the place of a block is where it begins, even if its run, cut at a segment, begins later
    block = common.written(blocks(opened).withColumn("g", F.xxhash64("id", "at")).drop("at"))
    level = split(block, ["h", "core"], "big").select("id", "h", "lo", "windows", "same", "open")
    level = common.written(level)
    spans = spans.union(level.where("same").select("id", "lo", F.size("windows").cast("long")))
    single = level.where("open").select("id", "h", "lo", F.posexplode("windows").alias("i", "w"))
    single = common.written(single.select("h", "w", "id", (F.col("lo") + F.col("i")).alias("lo")).select("*", place))
    spans = spans.union(single.join(twice(single, ["h", "w"]), ["h", "w"]).select("id", "lo", F.lit(1).cast("long")))
    return spans.toDF("id", "lo", "n"), copies


def cut_out(text: bytes, lo: np.ndarray, n: np.ndarray) -> tuple[int, int, str]:
    """(bytes removed, maximal runs of them, SHA-256 of the rest) of a text whose windows lo to lo + n - 1 go."""
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], np.maximum.accumulate((lo + n - 1 + LENGTH)[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    start, end = start[new], np.append(end[np.flatnonzero(new)[1:] - 1], end[-1])
    digest, at = hashlib.sha256(), 0
    for a, b in zip(start.tolist(), end.tolist()):
        digest.update(text[at:a])
        at = b
    digest.update(text[at:])
    return int((end - start).sum()), len(start), digest.hexdigest()


def identified(rows: DataFrame, ident=lambda text: F.xxhash64(text)) -> DataFrame:
    """doc_id, id and text: ids differ if texts do. Of texts that share one, all but the least get others."""
    digest = F.sha2("text", 256)
    rows = rows.select("doc_id", ident("text").alias("id"), "text")
    several = rows.groupBy("id").agg(F.min(digest).alias("least"), F.max(digest).alias("most")).where("least != most").select("id", "least")
    several = common.cut(several)
    few = common.few(several)
    if several.isEmpty():
        return rows
    found = rows.join(several if few is None else few, "id", "left")
    own = F.when(F.col("least").isNotNull() & (digest != F.col("least")), F.xxhash64(digest, F.lit(1))).otherwise(F.col("id"))
    return found.select("doc_id", own.alias("id"), "text")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    rows = identified(rows)
    spans, copies = removed(rows.select("id", "text").where(F.octet_length("text") >= LENGTH))
    spans = common.cut(spans.join(copies, "id", "left_anti").groupBy("id").agg(F.collect_list("lo").alias("lo"), F.collect_list("n").alias("n")))
    flags = common.cut(spans.select("id", F.lit(False).alias("all")).union(copies.select("id", F.lit(True))))
    few = common.few(flags)
    touched = rows.join(flags if few is None else few, "id", "left")
    size, digest = F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256)
    gone = F.coalesce(F.col("all"), F.lit(False))
    plain = touched.where(F.col("all").isNull() | F.col("all")).select(
        "doc_id", size, F.when(gone, F.octet_length("text")).otherwise(0).cast("long").alias("n_removed"), gone.cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(digest).alias("kept_sha256"),
    )
    names, schema = plain.columns, plain.schema
    part = touched.where(~F.col("all")).select("doc_id", "text", "id").join(spans, "id").select("doc_id", "text", "lo", "n")

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            made = [cut_out(t, lo.values.to_numpy(), n.values.to_numpy()) for t, lo, n in zip(texts, batch.column(2), batch.column(3))]
            count, parts, kept = zip(*made) if made else ((), (), ())
            sizes = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, count, parts)), pa.array(kept, pa.string())], names=names)

    return plain.union(common.map_batches(part, run, schema))
