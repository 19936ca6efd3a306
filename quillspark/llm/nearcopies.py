"""Near copies of a corpus: texts whose sets of word shingles have a Jaccard similarity of ``share`` or more.

Links are found in two rounds, and every link is verified on whole texts:

1. Pairs that fingerprints of the same shingles link by the Gray-order index of ``simhash``, and texts that share
   a shingle of their prefixes: if two sets are that similar, the prefixes of both, in any one order of all shingles,
   have one in common, so no pair is lost. The places of that shingle in both prefixes bound the overlap, and pairs
   that this bound rules out are not made. Where few texts share a shingle all pairs are taken; where many do, each
   text is paired with two of its size only.
2. Where many share a shingle, pairs that the first round has not connected. The smaller text of a pair has the
   shingle early in its prefix, so only such texts are paired with others.

Shingles that are frequent in a sample of texts stand last in the order; the sample changes the cost, not the
result. Before texts are compared, a pair must pass an upper bound of its overlap, from counts of shingles in bins.

Equal texts count as one. Texts without words are copies of each other. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, simhash

#: Words of a shingle, the least similarity as a fraction, texts that share a shingle and are paired at once.
WORDS, SHARE, CROWD = 5, (4, 5), 32
BINS, SAMPLE, HOT, PIECE = 256, 16, 100_000, 1 << 16


def shingles(text: bytes, words: int) -> list[int]:
    """Hashes of the shingles; a text without words has one of its own."""
    return simhash.shingle_hashes(text, words) or [0]


def fits(a, b, share=SHARE):
    """Whether sets of so many shingles (numbers, arrays or columns) can be similar."""
    return (a * share[1] >= b * share[0]) & (b * share[1] >= a * share[0])


def enough(overlap, sizes, share=SHARE):
    """Whether an overlap of two sets, of so many shingles together, is similar."""
    return overlap * (share[0] + share[1]) >= share[0] * sizes


def possible(a, i, b, j, share=SHARE):
    """Whether sets of a and b shingles, the smaller first, that have their first shingle in common at places i and
    j (from 0) can be similar (arrays or columns)."""
    return enough(b - j, a + b, share) & enough(a - i, a + b, share) & fits(a, b, share)


def features(df: DataFrame, text: str, words: int, share, hot, carry) -> DataFrame:
    """carried columns, fp, n (different shingles), bins (how many in each; null if over 255), tokens (the prefix)."""

    def make():
        frequent = hot.value if hot is not None else None

        def work(texts: pa.Array) -> list:
            lists = [simhash.shingle_hashes(x, words) for x in texts.cast(pa.binary()).to_pylist()]
            counts = np.fromiter(map(len, lists), np.int64, len(lists))
            hashes = np.fromiter((h for x in lists for h in x), np.uint64, int(counts.sum()))
            sizes, bins, tokens = [], [], []
            for own in np.split(hashes, np.cumsum(counts)[:-1]) if len(lists) else []:
                own = np.unique(own) if len(own) else np.zeros(1, np.uint64)
                n = len(own)
                held = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=BINS)
                bins.append(held.astype(np.uint8).tobytes() if held.max() < 256 else None)
                if frequent is not None:
                    often = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
                    own = np.concatenate([own[~often], own[often]])[: n - -(-share[0] * n // share[1]) + 1]
                sizes.append(n)
                tokens.append(own.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            return [simhash.fingerprint_of(hashes, counts).view(np.int64), pa.array(sizes, pa.int64()), pa.array(bins, pa.binary()), held]

        return work

    fields = [T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bins", T.BinaryType()), T.StructField("tokens", T.ArrayType(T.LongType()))]
    return common.map_text(df, text, fields, make, carry)


def frequent(df: DataFrame, text: str, key: str, words: int) -> np.ndarray:
    """Shingles of several texts of a sample, at most HOT, in order (uint64; one at least)."""
    some = df.where(F.pmod(F.col(key), F.lit(SAMPLE)) == 0)
    rows = features(some, text, words, SHARE, None, [key]).dropDuplicates([key]).select(F.explode("tokens").alias("token"))
    rows = rows.groupBy("token").count().where("count >= 3").orderBy(F.desc("count"), "token").limit(HOT)
    return np.unique(np.array([r.token for r in rows.collect()] + [0], np.int64).view(np.uint64))


SHARED = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "token", "at")])


def shared(tokens: DataFrame, share, crowd: int) -> DataFrame:
    """(a, b, token, at) of rows (token, n, key, at): pairs of keys that share a token (token null), and the
    rows, as key, n, token and at, of tokens that more than ``crowd`` keys share."""

    def run(batches):
        rest, crowded, last = None, None, None

        def out(a, b, token=None, at=None):
            more = [pa.nulls(len(a), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (token, at)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *more], names=SHARED.names)

        def many(token, n, key, at):
            """Of one token, in order of n, the rows, and pairs that can be similar: each key and the one before it,
            and each key and that of its sizes which has the token earliest, as an unaltered text does."""
            nonlocal last
            a, b = [], []
            for x, k, i in zip(n.tolist(), key.tolist(), at.tolist()):
                if last is not None:
                    before, hub = last
                    for m, h, j in {before, hub}:
                        if possible(m, j, x, i, share):
                            a.append(h)
                            b.append(k)
                    hub = hub if i >= hub[2] and fits(hub[0], x, share) else (x, k, i)
                    last = (x, k, i), hub
                else:
                    last = (x, k, i), (x, k, i)
            yield out(a, b)
            yield out(key, n, token, at)

        def few(token, n, key, at):
            """Of whole tokens: all pairs of those that few share."""
            nonlocal last
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            sizes = np.diff(starts, append=len(token))
            small = np.repeat(sizes <= crowd, sizes)
            for k in np.flatnonzero(sizes > crowd).tolist():
                last, own = None, slice(starts[k], starts[k] + sizes[k])
                yield from many(token[own], n[own], key[own], at[own])
            token, n, key, at = token[small], n[small], key[small], at[small]
            for k in range(1, int(sizes[sizes <= crowd].max(initial=0))):
                fit = np.flatnonzero((token[k:] == token[:-k]) & possible(n[:-k], at[:-k], n[k:], at[k:], share))
                yield out(key[fit], key[fit + k])

        for got in batches:
            now = tuple(got.column(i).to_numpy() for i in range(4))
            rows = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now))
            if not len(rows[0]):
                continue
            if crowded is not None:  # a token begun before
                end = int(np.searchsorted(rows[0], crowded, "right"))
                yield from many(*(x[:end] for x in rows))
                rows = tuple(x[end:] for x in rows)
                crowded = crowded if not len(rows[0]) else None
            end = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if end:
                yield from few(*(x[:end] for x in rows))
                rows = tuple(x[end:] for x in rows)
            if len(rows[0]) >= PIECE:
                crowded, last = int(rows[0][0]), None
                yield from many(*rows)
                rows = tuple(x[:0] for x in rows)
            rest = rows
        if rest is not None and len(rest[0]):
            yield from few(*rest)

    ordered = tokens.select("token", "n", "key", "at").repartition("token").sortWithinPartitions("token", "n", "at")
    return ordered.mapInArrow(run, SHARED)


def verified(pairs: DataFrame, known: DataFrame, texts: DataFrame, words: int, share) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar. known: key, n, bins; texts: key, text, maybe repeated."""
    pairs = pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = [known.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("bins").alias(f"bins_{c}")) for c in "ab"]
    bounded = pairs.join(sides[0], "a").join(sides[1], "b").where(fits(F.col("n_a"), F.col("n_b"), share)).select("a", "b", "n_a", "n_b", "bins_a", "bins_b")
    pair = T.StructType([T.StructField(c, T.LongType()) for c in "ab"])

    def bound(batches):
        for got in batches:
            total = got.column(2).to_numpy() + got.column(3).to_numpy()
            keep = np.ones(len(total), bool)
            x, y = got.column(4), got.column(5)
            at = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                x, y = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, BINS) for c in (x, y))
                keep[at] = enough(np.minimum(x, y).sum(axis=1, dtype=np.int64), total[at], share)
            yield got.select(["a", "b"]).filter(pa.array(keep))

    left = common.cut(bounded.mapInArrow(bound, pair))
    need = left.select(F.col("a").alias("key")).union(left.select("b")).distinct()
    few = common.few(need)
    held = texts.join(need if few is None else few, "key", "left_semi").dropDuplicates(["key"])
    held = common.written(shingle_sets(held, words))
    both = left.join(held.toDF("a", "set_a"), "a").join(held.toDF("b", "set_b"), "b")
    overlap = F.size(F.array_intersect("set_a", "set_b"))  # a pair at a time, in the JVM
    return common.cut(both.where(enough(overlap, F.size("set_a") + F.size("set_b"), share)).select("a", "b"))


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(key, hashes): the different shingles of each text of (key, text)."""

    def make():
        def work(found: pa.Array) -> list:
            sets = [np.unique(np.array(shingles(x, words), np.uint64)).view(np.int64) for x in found.cast(pa.binary()).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))]

        return work

    return common.map_text(texts, "text", [T.StructField("hashes", T.ArrayType(T.LongType()))], make, ["key"])


def roots(rows: DataFrame, texts: DataFrame, words: int = WORDS, share=SHARE, radius: int = simhash.RADIUS, crowd: int = CROWD) -> DataFrame:
    """(key, root): the smallest key that links reach, for keys that have one. rows: key, fp, n, bins, tokens."""
    known = rows.select("key", "n", "bins")
    prints = rows.select("key", "fp")
    least = common.cut(prints.groupBy("fp").agg(F.min("key").alias("least")))
    edges = simhash.links(least.select("fp"), "fp", radius)
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"key_{c}")) for c in "ab"]
    linked = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    equal = prints.join(least, "fp").select(F.col("key").alias("a"), F.col("least").alias("b"))
    tokens = rows.select("key", "n", F.posexplode("tokens").alias("at", "token")).withColumn("at", F.col("at").cast("long"))
    found = common.written(shared(tokens, share, crowd))
    first = verified(found.where("token is null").select("a", "b").union(linked).union(equal), known, texts, words, share)
    joined = common.cut(common.components(first)).toDF("key", "root")
    rest = found.where("token is not null").select("token", F.col("a").alias("key"), F.col("b").alias("n"), "at")
    rest = common.cut(rest.join(joined, "key", "left").select("token", "key", "n", "at", F.coalesce("root", "key").alias("root")))
    early = enough(F.col("n") - F.col("at"), 2 * F.col("n"), share)  # else it can only be the larger of two
    # of each group all that a pair of its texts with others depends on: sizes, and how early the token stands
    ends = [(F.min, "n", "low"), (F.max, "n", "high"), (F.min, "at", "first")]
    small = [(F.min, "n", "least"), (F.max, "n", "most"), (F.min, "at", "soonest")]
    groups = rest.groupBy("token", "root").agg(*(f(c).alias(name) for f, c, name in ends), *(f(F.when(early, F.col(c))).alias(name) for f, c, name in small))
    groups = common.cut(groups)
    other = groups.select("token", F.col("root").alias("root2"), *(F.col(name).alias(f"{name}2") for _, _, name in ends))
    low, high, most, least = (F.col(c) for c in ("low2", "high2", "most", "least"))
    # the best that any two of them could do: ``possible`` where groups are of one text
    reach = (high >= least) & enough(most - F.col("soonest"), most + low, share) & enough(high - F.col("first2"), least + high, share)
    apart = groups.where("least is not null").join(other, "token").where((F.col("root") != F.col("root2")) & reach).select("token", "root", "root2")
    mine = rest.where(early).select("token", "root", F.col("key").alias("a"), F.col("n").alias("n1"), F.col("at").alias("at1"))
    theirs = rest.select("token", F.col("root").alias("root2"), F.col("key").alias("b"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    fit = (F.col("n1") <= F.col("n2")) & possible(F.col("n1"), F.col("at1"), F.col("n2"), F.col("at2"), share)
    pairs = apart.join(mine, ["token", "root"]).join(theirs, ["token", "root2"]).where(fit)
    second = verified(pairs.select("a", "b"), known, texts, words, share)
    if second.isEmpty():
        return joined
    return common.cut(common.components(first.union(second))).toDF("key", "root")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, share=SHARE, radius: int = simhash.RADIUS, crowd: int = CROWD) -> DataFrame:
    """The rows of df without all but one row of each group of near copies, which ``simhash.first_of_each`` chooses."""
    ident, hashed, keyed = simhash.identified(df, doc_id, text)
    hot = df.sparkSession.sparkContext.broadcast(frequent(keyed, text, hashed, words))
    made = features(keyed, text, words, share, hot, [ident, hashed]).toDF("ident", "key", "fp", "n", "bins", "tokens")
    made = common.written(made)
    each = made.groupBy("ident", "key").count()
    rows = made.select("key", "fp", "n", "bins", "tokens").dropDuplicates(["key"])
    texts = keyed.select(F.col(hashed).alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    known = roots(common.written(rows), texts, words, share, radius, crowd)
    few = common.few(known)
    each = each.join(known if few is None else few, "key", "left")
    each = each.select("ident", F.col("key").alias("hashed"), "count", F.coalesce("root", "key").alias("root"))
    return simhash.first_of_each(df, keyed, ident, hashed, common.cut(each))
