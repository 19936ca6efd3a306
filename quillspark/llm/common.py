"""What several operators share: cutting lineage, text batches in Arrow, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one vectorised step handles; a longer document is a step of its own. Bytes of a batch that a
#: Python worker is sent, by the setting that says so, unless the session sets it.
STEP_BYTES, BATCH_BYTES, BATCH_SETTING = 1 << 20, 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a checkpoint's file, so that small tables are few files, and of a table that is broadcast.
FILE_BYTES, BROADCAST_BYTES = 8 << 20, 32 << 20


def width(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes up, by its type and its length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value)
    elif isinstance(kind, T.StructType):
        size = sum((width(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        size = F.octet_length(F.array_join(value, "", "")) + 16 * F.size(value)
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        size = 32 * F.size(value) if not isinstance(kind, T.ArrayType) or isinstance(kind.elementType, T.StructType) else 8 * F.size(value)
    else:
        size = F.lit(0)
    return F.coalesce(size, F.lit(0)).cast("long") + 8


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, about their bytes)."""
    size = sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    n, total = df.select(size.alias("size")).agg(F.count("*"), F.sum("size")).first()
    return n, total or 0


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of spark.checkpoint.dir; a temporary one is set only in local mode.

    Its files are of FILE_BYTES, measured, or of one partition each. Rows must not depend on which task makes them, as
    the blocks that a lost executor held are made again by tasks of other partitions."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-checkpoint-"))
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.coalesce(measured(held)[1] // FILE_BYTES + 1).checkpoint(eager=True)
    held.unpersist()
    return out


def folder(spark: SparkSession) -> str:
    """A new folder's path beside the checkpoints. What is there goes when the program ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        cut(spark.range(0))
        root = spark.sparkContext.getCheckpointDir()
    path = f"{root}/quillspark-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet beside the checkpoints and read again: smaller on disk than a checkpoint, and
    later steps read only the columns that they use."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def few(keys: DataFrame, most: int = 1_000_000) -> DataFrame | None:
    """keys to be broadcast, if they are at most so many rows and BROADCAST_BYTES (both measured); None beyond that."""
    n, size = measured(keys.limit(most + 1))
    return F.broadcast(keys) if n <= most and size <= BROADCAST_BYTES else None


def free_name(df: DataFrame, base: str) -> str:
    """base, with underscores added until no column of df has that name in either case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_key(df: DataFrame, text: str, name: str, ident: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """df with a number of its texts (null as empty): their hash, and where different texts share one, which is
    looked for by their SHA-256, another hash for all but one of them."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed, digest = df.withColumn(name, ident(value)), F.sha2(value, 256)
    least, most = F.min(digest).alias("least"), F.max(digest).alias("most")
    several = cut(keyed.groupBy(F.col(name).alias("key")).agg(least, most).where("least != most").select("key", "least"))
    if several.isEmpty():
        return keyed
    clash = free_name(keyed, "clash")
    small, other = few(several), F.xxhash64(digest, F.lit(1))
    found = keyed.join((several if small is None else small).select(F.struct("key", "least").alias(clash)), F.col(name) == F.col(f"{clash}.key"), "left")
    own = F.when(F.col(f"{clash}.least").isNotNull() & (digest != F.col(f"{clash}.least")), other).otherwise(F.col(name))
    return found.withColumn(name, own).drop(clash)


def carried(df: DataFrame, carry: Sequence[str] | None, made: Sequence[str]) -> list[str]:
    """The columns of df to pass on: all (None) or those named, without those that share a made column's name."""
    made_lower = {m.lower() for m in made}
    return [c for c in (df.columns if carry is None else carry) if c.lower() not in made_lower]


def steps(sizes: np.ndarray, budget: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most budget bytes together (or of one row)."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow for rows with texts: batches are bounded by bytes, which row counts do not do."""
    conf = df.sparkSession.conf
    if BATCH_SETTING not in conf.getAll:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def map_text(
    df: DataFrame, text: str, fields: Sequence[T.StructField], fn: Callable[[], Callable[[pa.Array], list]], carry: Sequence[str] | None = None, step: int = STEP_BYTES
) -> DataFrame:
    """carried columns of df plus fields, which the function that fn() makes (once a task) computes
    from runs of rows of the text column: it takes a string array without nulls, gives one array a field."""
    made = [f.name for f in fields]
    keep = carried(df, carry, made)
    own = [F.col(f"`{c}`") for c in keep]
    at = keep.index(text) if text in keep and isinstance(df.schema[text].dataType, T.StringType) else len(keep)
    whole = df.select(*own) if at < len(keep) else df.select(*own, F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches):
        work = fn()
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0, np.int64)
            for a, b in steps(sizes, step):
                new = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(texts[a:b])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(keep))), *new], names=[*keep, *made])

    return map_batches(whole, run, schema)


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values within rows that offsets delimit; empty rows give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable over edges, for every node that has one.

    Large-star and small-star steps alternate until nothing changes; each is a grouped minimum and a
    join, so a hub's edges are never gathered. Null ends and loops are dropped."""
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = cut(ends.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    while True:
        both = now.union(now.select("v", "u"))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.union(least).distinct())
        if after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty():
            roots = after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return after.toDF("node", "root").union(roots)
        now = after

