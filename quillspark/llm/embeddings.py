"""Near-duplicate embeddings by a PCA-ordered tiled comparison.

Vectors are normalised and rotated onto the principal axes of all vectors (their second moments are
summed by Spark; the upper half of a d x d matrix reaches the driver for each length of vectors, as columns). Two unit vectors of cosine c are sqrt(2 - 2c)
apart, so no pair that links differs by more in any coordinate: vectors fall into cells of that width
along the leading axes, and only neighbouring cells of one label are compared. Cells are dealt into
tiles of at most about ``tile`` vectors, by a hash, so that a hot label or cell is many tiles. Pairs of tiles
are compared twice. First only sketches move: the leading ``SKETCH`` coordinates in single precision and the
norm of the others. Leading coordinates are multiplied, what the others can add is at most the product of
those norms, and vectors that can reach the threshold with none of the other tile go no further. Then the
whole vectors of those left move, once for each pair of tiles in which they may have links: dimensions are
accumulated step by step, and rows and columns that cannot reach the threshold any more, by their suffix norms,
are left out of the next. The pairs that remain are decided by the cosine of the original vectors in double
precision, scaled by powers of two, so that no component over- or underflows. Equal vectors are compared once,
with their number.

A vector that is null, zero, or holds a null or a component that is not finite links with nothing, as
does one without label; it is its own component. Vectors of different lengths never link. Rows of equal
vec_id are rows of their own, as are repeated rows; a component's id is its smallest vec_id that is not null. An
empty table gives no rows. Columns of df other than the three are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

COSINE, AXES, TILE, STEP, SKETCH = 0.98, 2, 1024, 8, 16
SLACK, SINGLE = 1e-7, 1e-5  # of rotated products in double and in single precision, far above their rounding


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(key, label, v, d, n, least): the distinct vectors of a label that can link, with their rows counted."""
    numbers = F.transform("vector", lambda x: x.cast("double"))
    fine = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).select("id", "label", numbers.alias("v"))
    fine = fine.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    fine = fine.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # -0.0 is 0.0
    key = F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))
    return fine.withColumn("key", key).groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least")).withColumn("d", F.size("v"))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors the rotation onto their principal axes, largest first."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, x in stacked(batch.column(0)):
                total[d] = total.get(d, 0) + x.T @ x
        for d, m in total.items():
            upper = m[np.triu_indices(d)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(upper), d, np.int32)), pa.array(np.arange(len(upper), dtype=np.int32)), pa.array(upper)], names=["d", "i", "x"])

    sums = vectors.select("v").mapInArrow(run, "d int, i int, x double").groupBy("d", "i").agg(F.sum("x").alias("x")).toArrow()
    lengths, places, values = (sums.column(c).to_numpy() for c in ("d", "i", "x"))
    out = {}
    for d in np.unique(lengths).tolist():
        own = lengths == d
        upper = np.zeros(d * (d + 1) // 2)
        upper[places[own]] = values[own]
        m = np.zeros((d, d))
        m[np.triu_indices(d)] = upper
        out[d] = np.linalg.eigh(m, UPLO="U")[1][:, ::-1].copy()
    return out


def stacked(column: pa.Array):
    """(length, unit vectors as rows) for each length of vector in a list column, row order kept within one."""
    for d, at, x in by_length(column):
        yield d, x / norms(x)[:, None]


def by_length(column: pa.Array):
    sizes = np.diff(column.offsets.to_numpy())
    values, start = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, values[start[at][:, None] + np.arange(d)]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, which changes no digit, so that their largest components are from 0.5 to 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths, safe for components whose squares over- or underflow."""
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(np.square(x / top[:, None]).sum(axis=1))


def cells(vectors: DataFrame, rotation: dict[int, np.ndarray], cosine: float, lead: int) -> DataFrame:
    """vectors with cell, the place of a vector along the leading axes in widths of the largest distance, and
    sketch: its leading coordinates, zeros if it has fewer, and the norm of the others."""
    width = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("v"))
            out, sketch = np.zeros((len(column), lead), np.int64), np.zeros((len(column), SKETCH + 1), "<f4")
            for d, at, x in by_length(column):
                x = scaled(x)
                y = (x / norms(x)[:, None]) @ rotation[d]
                out[at, : min(d, lead)] = np.floor(y[:, :lead] / width)
                sketch[at, : min(d, SKETCH)] = y[:, :SKETCH]
                sketch[at, SKETCH] = np.sqrt(np.square(y[:, SKETCH:]).sum(axis=1))
            cell = pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * lead, pa.array(out.ravel()))
            yield batch.append_column("cell", cell).append_column("sketch", pa.array([x.tobytes() for x in sketch], pa.binary()))

    more = [T.StructField("cell", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, *more]))


def may_link(a: np.ndarray, b: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which sketches of a, and which of b, may reach the threshold with one of the other (not with themselves)."""
    rows, columns = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for i in range(0, len(a), 512):
        own = a[i : i + 512]
        fit = own[:, :-1] @ b[:, :-1].T + own[:, -1:] * b[:, -1] >= cosine - SINGLE
        if same:
            fit[np.arange(len(own)), np.arange(i, i + len(own))] = False
        rows[i : i + 512] = fit.any(axis=1)
        columns |= fit.any(axis=0)
    return rows, columns


def compare(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, cosine: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of rows of a and b whose cosine reaches the threshold."""
    a, b = scaled(a), scaled(b)
    na, nb = norms(a), norms(b)
    ua, ub = a / na[:, None], b / nb[:, None]
    x, y = ua @ rotation, ub @ rotation
    rest = [np.sqrt(np.maximum(0, np.cumsum(np.square(z)[:, ::-1], axis=1)[:, ::-1])) for z in (x, y)]  # suffix norms
    i, j, dims = np.arange(len(a)), np.arange(len(b)), a.shape[1]
    part = np.zeros((len(a), len(b)))
    for k in range(0, dims, step):
        part += x[i, k : k + step] @ y[j, k : k + step].T
        if k + step >= dims:
            break
        possible = part + rest[0][i, k + step, None] * rest[1][j, k + step] >= cosine - SLACK
        rows, columns = possible.any(axis=1), possible.any(axis=0)
        if not rows.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j, part = i[rows], j[columns], part[rows][:, columns]
    p, q = np.nonzero(part >= cosine - SLACK)
    p, q = i[p], j[q]
    keep = np.concatenate([np.einsum("ij,ij->i", a[s], b[t]) / (na[s] * nb[t]) >= cosine for s, t in zip(np.array_split(p, len(p) // 4096 + 1), np.array_split(q, len(q) // 4096 + 1))])
    return p[keep], q[keep]


def forest(x: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what x-y do, at most one for each of size nodes."""
    root = np.arange(size)
    while len(x):
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(size))
    return at, root[at]


def tiled_links(vectors: DataFrame, rotation: dict[int, np.ndarray], cosine: float, lead: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """(key, links to rows of other vectors) of vectors with any, and edges (a, b) that connect them."""
    sizes = vectors.groupBy("label", "d", "cell").agg(F.count("*").alias("size")).withColumn("tiles", F.ceil(F.col("size") / tile))
    sizes = common.cut(sizes)
    placed = vectors.join(sizes.select("label", "d", "cell", "tiles"), ["label", "d", "cell"])
    placed = common.cut(placed.withColumn("tile", F.pmod(F.xxhash64("key"), "tiles")).select("key", "label", "d", "cell", "tile", "v", "n", "sketch"))
    # pairs of tiles in the same or neighbouring cells, each pair once
    mine = sizes.select("label", "d", "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    moves = F.array(*[F.array(*[F.lit(x) for x in m]) for m in product((-1, 0, 1), repeat=lead)])
    there = mine.withColumn("m", F.explode(moves)).withColumn("cell2", F.zip_with("cell", "m", lambda x, y: x + y)).drop("m")
    other = mine.select("label", "d", F.col("cell").alias("cell2"), F.col("tile").alias("tile2"))
    order = F.struct("cell", "tile") <= F.struct(F.col("cell2").alias("cell"), F.col("tile2").alias("tile"))
    pairs = there.join(other, ["label", "d", "cell2"]).where(order)
    pairs = common.cut(pairs.withColumn("pair", F.xxhash64("label", "d", "cell", "tile", "cell2", "tile2")))
    thin = placed.select("label", "d", "cell", "tile", "key", "sketch")
    left = pairs.join(thin, ["label", "d", "cell", "tile"]).select("pair", "key", "sketch", F.lit(0).alias("side"))
    right = thin.toDF("label", "d", "cell2", "tile2", "key", "sketch")
    same = (F.col("cell") == F.col("cell2")) & (F.col("tile") == F.col("tile2"))
    right = pairs.where(~same).join(right, ["label", "d", "cell2", "tile2"]).select("pair", "key", "sketch", F.lit(1).alias("side"))

    def sift(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        x = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<f4").reshape(-1, SKETCH + 1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        rows, columns = may_link(x[a], x[b] if len(b) else x[a], cosine, not len(b))
        keep = np.zeros(len(x), bool)
        keep[a] = rows if len(b) else rows | columns
        keep[b] = columns if len(b) else False
        return table.select(["pair", "key", "side"]).filter(pa.array(keep))

    open_ = common.cut(left.union(right).groupBy("pair").applyInArrow(sift, "pair long, key string, side int"))
    whole = open_.join(placed.select("key", "d", "n", "v"), "key")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        key = np.array(table.column("key").to_pylist(), object)
        n = table.column("n").to_numpy()
        ((d, at, x),) = by_length(table.column("v").chunk(0))
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if (side == 1).any() else a
        p, q = compare(x[a], x[b], rotation[d], cosine)
        if b is a:
            p, q = p[p < q], q[p < q]
        p, q = a[p], b[q]
        links = np.bincount(p, n[q], len(key)).astype(np.int64) + np.bincount(q, n[p], len(key)).astype(np.int64)
        some = np.flatnonzero(links)
        s, t = forest(p, q, len(key))
        return pa.table({"a": pa.array([*key[some], *key[s]], pa.string()), "b": pa.array([*[None] * len(some), *key[t]], pa.string()), "links": pa.array([*links[some].tolist(), *[None] * len(s)], pa.int64())})

    found = common.cut(whole.groupBy("pair").applyInArrow(run, "a string, b string, links long"))
    return found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links")), found.where("b is not null").select("a", "b")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, lead: int = AXES, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = df.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    vectors = common.cut(distinct_vectors(rows))
    rotation = axes(vectors)
    celled = cells(vectors.select("key", "label", "v", "d", "n"), rotation, cosine, lead)
    links, edges = tiled_links(celled, rotation, cosine, lead, tile)
    roots = common.cut(common.components(edges))
    known = vectors.select("key", "n", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = common.cut(known.groupBy("root").agg(F.min("least").alias("component_id")))
    known = known.join(least, "root").join(links, "key", "left").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    known = common.cut(known)
    keyed = rows.withColumn("v", F.transform("vector", lambda x: x.cast("double") + F.lit(0.0)))
    key = F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))
    fine = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("v", lambda x: x.isNotNull())
    keyed = keyed.select("id", F.when(fine, key).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("key"))
    out = keyed.join(known, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).cast("long")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


#: The same over embeddings, for DuckDB; vec_id is taken as a key there.
SQL = f"""
WITH RECURSIVE fine AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, r.component_id::BIGINT AS component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON e.vec_id = r.a
LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) n ON e.vec_id = n.a
"""
