"""Token ids as binary files: canonical length-limited Huffman codes, in blocks that are read independently.

Writing. Texts are encoded once and their ids kept beside the checkpoints. Ids are counted over all texts, and the
counts, one a token of the vocabulary at most, give code lengths by package-merge, none above ``limit``. Rows are
put in ascending order of doc_id (null first; equal ids by a hash of their ids) by a range sort that no key can gather in one task. Each of its
partitions is a shard, whose rows are put into blocks of whole documents with about ``block`` ids.

Files (Parquet, written and committed by Spark): ``codes`` has the code length of each id, from which canonical codes
follow: shorter ones first, then smaller ids first. ``blocks`` has one row a block: shard, start (ids of the shard
before it), keys and sizes (doc_id and ids of its documents), bits (its codes, most significant bit first, with
zeros to the end of the last byte) and points (the bit offset of every ``POINT``-th id).

Reading. A table of 2^limit entries gives the id and the length of the code that any limit bits begin with. From the
points of a block, or of many blocks, one id each is decoded at a time, for all points at once.

A null text is an empty one: its end id alone. A document is never cut; the block of a very long one is as long as
the document, and is decoded in bounded steps. Rows of equal doc_id are documents each. Empty tables give no blocks and
no rows. Only doc_id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, packing

END_ID, LIMIT, BLOCK, POINT, LANES = 2, 18, 1 << 16, 128, 1 << 14
KEPT = 300_000  # words whose ids a worker remembers: see packing


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most limit bits for the counts; 0 for what never occurs.

    Package-merge: at each of limit levels the packages of the level below are merged with the single symbols in order
    of weight, and paired; a symbol's length is the number of levels at which it is among the cheapest that are needed."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids have no codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    single = counts[order].astype(np.float64)
    packages, merged = np.zeros(0), []
    for _ in range(limit):
        weights = np.concatenate([single, packages])
        at = np.argsort(weights, kind="stable")
        merged.append(at < n)
        weights = weights[at]
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
    need = 2 * n - 2
    lengths = np.zeros(n + 1, np.int64)
    for own in reversed(merged):  # of the first ``need`` at a level, the singles are the cheapest symbols
        symbols = int(own[:need].sum())
        lengths[0] += 1
        lengths[symbols] -= 1
        need = 2 * (need - symbols)
    out[order] = np.cumsum(lengths)[:n]
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes by id, ids in order of their codes)."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    size = lengths[ids].astype(np.int64)
    top = int(size[-1]) if len(ids) else 0
    starts = np.concatenate([[0], np.cumsum(np.int64(1) << (top - size))])[:-1]  # as if all codes had top bits
    codes = np.zeros(len(lengths), np.uint32)
    codes[ids] = starts >> (top - size)
    return codes, ids


def decoder(lengths: np.ndarray, limit: int) -> np.ndarray:
    """For every limit bits, the id whose code they begin with, times 32, and the code's length."""
    _, ids = canonical(lengths)
    size = lengths[ids].astype(np.int64)
    table = np.repeat(ids.astype(np.uint32) << np.uint32(5) | size.astype(np.uint32), np.int64(1) << (limit - size))
    return np.concatenate([table, np.zeros((1 << limit) - len(table), np.uint32)])


def encoded(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of the ids as bytes, and the bit offset of every POINT-th."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    word, shift = starts >> 5, (64 - size - (starts & 31)).astype(np.uint64)
    value = codes[ids].astype(np.uint64) << shift  # in 64 bits from the 32-bit word where the code begins
    first = np.flatnonzero(np.diff(word, prepend=-1))  # codes have less than 32 bits, so one begins in every word
    both = np.add.reduceat(value, first) if len(ids) else np.zeros(0, np.uint64)
    out = np.zeros(len(both) + 1, np.uint64)
    out[:-1] = both >> np.uint64(32)
    out[1:] += both & np.uint64(0xFFFFFFFF)
    bits = int(ends[-1]) if len(ids) else 0
    return out.astype(">u4").tobytes()[: -(-bits // 8)], starts[::POINT]


def decoded(data: np.ndarray, points: np.ndarray, counts: np.ndarray, table: np.ndarray, limit: int) -> np.ndarray:
    """ids from each of the points (bit offsets in data), counts of them (POINT at most), one after another."""
    view = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    words = view[:-3] << np.uint32(24) | view[1:-2] << np.uint32(16) | view[2:-1] << np.uint32(8) | view[3:]
    out = np.empty((POINT, len(points)), np.uint32)
    at, drop = points.copy(), np.uint32(32 - limit)
    last = len(words) - 1
    for k in range(int(counts.max(initial=0))):
        found = table[(words[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> drop]
        out[k] = found >> np.uint32(5)
        at += found & np.uint32(31)
    return out.T[np.arange(POINT) < counts[:, None]]


BLOCKS = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("start", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType()), T.StructField("points", T.ArrayType(T.LongType())),
])


def id_kind(path: str, end_id: int) -> str:
    """The integers in which ids are kept until they are coded: of 16 bits, or of 32 for large vocabularies."""
    most = max(end_id, tokenizers.Tokenizer.from_file(path).get_vocab_size(True) - 1)
    return "<u2" if most < 1 << 16 else "<u4"


def ids_of(df: DataFrame, path: str, text: str, key: str, end_id: int, kind: str) -> DataFrame:
    """(key, ids, hash): the ids of every text and the end id, as bytes of integers of a kind."""

    def make():
        def work(texts: pa.Array) -> list:
            ids, counts = packing.encode(path, texts.cast(pa.binary()).to_pylist(), KEPT)
            ends = np.cumsum(counts)
            whole = np.insert(ids.astype(kind), ends, end_id)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * whole.itemsize
            return [pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole)]).cast(pa.binary())]

        return work

    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return common.map_text(rows, "text", [T.StructField("ids", T.BinaryType())], make, ["key"]).withColumn("hash", F.xxhash64("ids"))


def id_counts(rows: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in the ids of rows; by position, as long as the largest id needs."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            data = batch.column(0).cast(pa.large_binary())
            for a, b in common.steps(np.diff(np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1])):
                some = np.bincount(np.frombuffer(b"".join(data[a:b].to_pylist()), kind))
                if len(some) > len(total):
                    total = np.concatenate([total, np.zeros(len(some) - len(total), np.int64)])
                total[: len(some)] += some
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    found = common.map_batches(rows.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r.id for r in found), default=-1) + 1, np.int64)
    for r in found:  # a row for each token of the vocabulary at most
        out[r.id] = r.n
    return out


def write_ids(df: DataFrame, folder: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = END_ID, limit: int = LIMIT, block: int = BLOCK) -> None:
    """Writes the ids of the texts of df to a folder that all executors reach."""
    spark = df.sparkSession
    kind = id_kind(tokenizer, end_id)
    rows = common.written(ids_of(df, tokenizer, text, key, end_id, kind))
    lengths = code_lengths(id_counts(rows, kind), limit)
    codes, _ = canonical(lengths)
    spark.createDataFrame([(lengths.tobytes(), limit)], "lengths binary, code_limit int").coalesce(1).write.parquet(f"{folder}/codes")
    held = spark.sparkContext.broadcast((codes, lengths))  # one entry a token of the vocabulary
    order = ["key", "hash", "salt"]
    ordered = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions("key", "hash", "ids", "salt")

    def run(batches):
        (codes, lengths), size = held.value, np.dtype(kind).itemsize
        start, keys, parts, total = 0, [], [], 0

        def made(shard):
            ids = np.frombuffer(b"".join(parts), kind)
            bits, points = encoded(ids, codes, lengths)
            return [shard], [start], [keys], [[len(x) // size for x in parts]], [bits], [points]

        shard = None
        for batch in batches:
            shard = batch.column(0)[0].as_py() if len(batch) else shard
            for k, ids in zip(batch.column(1).to_pylist(), batch.column(2)):
                keys.append(k)
                parts.append(ids.as_py())
                total += len(parts[-1]) // size
                if total >= block:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(made(shard), KINDS)], names=BLOCKS.names)
                    start, keys, parts, total = start + total, [], [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(made(shard), KINDS)], names=BLOCKS.names)

    sharded = ordered.select(F.spark_partition_id().cast("long").alias("shard"), "key", "ids")
    common.map_batches(sharded, run, BLOCKS).write.parquet(f"{folder}/blocks")


KINDS = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]


def documents(keys: list, sizes: list[int], data: bytes, points: np.ndarray, table: np.ndarray, limit: int) -> Iterator[tuple]:
    """(key, place of its first id in the block, pieces of its ids) of each document of a block, decoded in steps."""
    data, total = np.frombuffer(data, np.uint8), sum(sizes)
    counts = np.full(len(points), POINT, np.int64)
    if len(points):
        counts[-1] = total - POINT * (len(points) - 1)

    def pieces():
        for i in range(0, len(points), LANES):
            own, end = points[i : i + LANES], points[i + LANES] if i + LANES < len(points) else 8 * len(data)
            low = int(own[0]) >> 3
            yield decoded(data[low : -(-int(end) // 8)], own - 8 * low, counts[i : i + LANES], table, limit)

    source, held = pieces(), np.zeros(0, np.uint32)
    at = 0
    for key, size in zip(keys, sizes):
        own, left = [], size
        while left:
            if not len(held):
                held = next(source)
            own.append(held[:left])
            held, left = held[left:], left - len(own[-1])
        yield key, at, own
        at += size


def read_blocks(spark: SparkSession, folder: str, schema: T.StructType, make) -> DataFrame:
    """What ``make`` gives, as arrays of the schema, of (shard, start, documents) of each block."""
    row = spark.read.parquet(f"{folder}/codes").first()
    lengths, limit = np.frombuffer(row.lengths, np.uint8), row.code_limit
    held = spark.sparkContext.broadcast(bytes(lengths))

    def run(batches):
        table = decoder(np.frombuffer(held.value, np.uint8), limit)
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for i in range(len(batch)):
                shard, start, keys, sizes, data = (c[i].as_py() for c in columns[:5])
                points = columns[5][i].values.to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays(make(shard, start, documents(keys, sizes, data, points, table, limit)), schema=schema_of(schema))

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    return common.map_batches(blocks.select(*BLOCKS.names), run, schema)


def schema_of(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType: pa.int64(), T.ArrayType: pa.list_(pa.int32())}
    return pa.schema([(f.name, kinds[type(f.dataType)]) for f in schema.fields])


def starts(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, before): the ids of all shards before each; one row a shard, summed up in the driver."""
    last = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    found, before, total = sorted(map(tuple, last.collect())), [], 0
    for shard, n in found:
        before.append((shard, total))
        total += n
    return F.broadcast(spark.createDataFrame(before, "shard long, before long"))  # as many rows as the writer had partitions


def placed(found: DataFrame, spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return found.join(starts(spark, folder), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), *more)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (an array) of every document of a folder."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("shard", "doc_id", "start")] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def make(shard, start, docs):
        docs = list(docs)
        ids = [np.concatenate(own).astype(np.int32) if own else [] for _, _, own in docs]
        return [pa.array([shard] * len(docs), pa.int64()), pa.array([k for k, _, _ in docs], pa.int64()), pa.array([start + at for _, at, _ in docs], pa.int64()), pa.array(ids, pa.list_(pa.int32()))]

    return placed(read_blocks(spark, folder, schema, make), spark, folder, "ids")


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of a folder, from its decoded ids."""
    names = ("shard", "doc_id", "start", "n_tokens", "ids_crc32")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in names])

    def make(shard, start, docs):
        rows = []
        for key, at, own in docs:
            crc = 0
            for some in own:
                crc = zlib.crc32(some.astype("<u4").tobytes(), crc)
            rows.append((shard, key, start + at, sum(map(len, own)), crc))
        return [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)]

    return placed(read_blocks(spark, folder, schema, make), spark, folder, "n_tokens", "ids_crc32")


def report(df: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes the ids of df to a folder (else a new one beside the checkpoints) and gives ``digest`` of it."""
    folder = folder or common.folder(df.sparkSession)
    write_ids(df, folder, tokenizer, **options)
    return digest(df.sparkSession, folder)
