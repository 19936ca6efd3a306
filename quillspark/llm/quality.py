"""Quality rules and a hashed n-gram log-likelihood ratio.

The rules count words, symbols, repeated lines and words in repeated 5-word windows of every text. The
verdict on texts that pass them is a ratio of two multinomials over n-grams of 4 bytes, hashed into
2^16 buckets, and n-grams over words that tell only whether each equals the one before (so that a text
of doubled words shows), 256 buckets more: one of trusted texts, labelled as good, one of the whole raw corpus. The mean log ratio
of a text's n-grams (per n-gram of bytes) is its score, whatever its length, and each text with a score of at least the
threshold is kept: no chance is involved. The threshold is set where labelled good and bad texts are
told apart best, a lost good text counting ``care`` times a kept bad one.

The raw multinomial counts every n-gram of every text, the trusted one those of every text that is
labelled as good, and the threshold is the best of all cuts between scores of labelled rows that pass the rules:
nothing is sampled. Counts up to each score are exact, summed up in cells of scores and over the cells. The
model is 2^16 + 256 numbers, whatever the corpus. Ratios are added up as whole numbers, so that equal texts have equal scores.

Null texts count as empty and fail the rules. Labels of a doc_id that disagree count as bad; null ids and
other labels than 0 and 1 count as no label. Without good or without bad labels the threshold is the lowest,
so the rules alone decide. Rows of equal text have equal results; an empty table gives no rows. A long text
is a step of its own, read as a whole. A column of df that shares a made column's name gives way.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

GRAM, BITS, CARE, WINDOW, CELLS = 4, 16, 5.0, 5, 256
BUCKETS = (1 << BITS) + 256
SYMBOLS = "#*$%&|<>"
UNIT = 1 << 20  # parts of 1 in which log ratios are added up


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log ratio of each bucket
    threshold: float


def grams(data: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram at each byte where one begins."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint32)
    x = data.astype(np.uint32)
    value = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    return (value * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def within(offsets: np.ndarray) -> np.ndarray:
    """For each place of an n-gram in texts put together, whether it lies in one of them."""
    inside = np.ones(max(0, int(offsets[-1]) - GRAM + 1), bool)
    for k in range(1, GRAM):
        at = offsets[1:-1] - k
        inside[at[(at >= 0) & (at < len(inside))]] = False
    return inside


class Numbers(dict):
    """word -> its number, by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words of the texts, one after another, as numbers, and how many each text has."""
    number = Numbers()
    codes = [[number[w] for w in x.split()] for x in texts]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    return np.fromiter(chain.from_iterable(codes), np.int64, int(sizes.sum())), sizes


def doubling(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word the bucket of the n-gram that ends with it: which of 8 words equal the one before."""
    same = np.zeros(len(codes), np.int64)
    same[1:] = codes[1:] == codes[:-1]
    first = np.cumsum(sizes)[:-1]
    same[first[first < len(codes)]] = 0
    out = same.copy()
    for k in range(1, 8):
        out[k:] |= same[:-k] << k
    return out + (1 << BITS)


def counts(texts: DataFrame) -> np.ndarray:
    """Counts of n-grams of (text, trusted) by bucket: in all texts, and in trusted ones."""

    def run(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            data, offsets = common.byte_view(batch.column(0))
            trusted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in common.steps(np.diff(offsets)):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                found, inside = grams(part), within(own)
                codes, sizes = coded(batch.column(0)[a:b].cast(pa.binary()).to_pylist())
                doubled = doubling(codes, sizes)
                total[0] += np.bincount(found[inside], minlength=BUCKETS) + np.bincount(doubled, minlength=BUCKETS)
                if trusted[a:b].any():
                    inside &= np.repeat(trusted[a:b], np.diff(own))[: len(inside)]
                    total[1] += np.bincount(found[inside], minlength=BUCKETS) + np.bincount(doubled[np.repeat(trusted[a:b], sizes)], minlength=BUCKETS)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["bucket", "raw", "trusted"])

    rows = common.map_batches(texts, run, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    out = np.zeros((2, BUCKETS), np.int64)
    for bucket, raw, trusted in rows.collect():  # as many rows as buckets, at most
        out[:, bucket] = raw, trusted
    return out


def agreed(labels: DataFrame, column: str, doc_id: str = "doc_id", lowest: bool = True) -> DataFrame:
    """(__id, __label): one label, 0 or 1, a document."""
    one = F.min if lowest else F.max
    return labels.where(F.col(doc_id).isNotNull() & F.col(column).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(one(F.col(column)).alias("__label"))


def sample(labels: DataFrame, column: str, most: int, doc_id: str = "doc_id", lowest: bool = True) -> DataFrame:
    """(doc_id, label) of at most ``most`` documents a class, those with the smallest hashes of their ids."""
    rows = agreed(labels, column, doc_id, lowest)
    by = F.xxhash64("__id", F.lit(column))
    return common.cut(rows.where("__label = 1").orderBy(by).limit(most).union(rows.where("__label = 0").orderBy(by).limit(most)))


def fit(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", care: float = CARE) -> Model:
    known = agreed(labels, label, doc_id)
    few = common.few(known)
    rows = df.select(F.col(f"`{doc_id}`").alias("__id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    marked = rows.join(known if few is None else few, "__id", "left").select("text", "__label")
    raw, trusted = counts(marked.select("text", F.coalesce(F.col("__label") == 1, F.lit(False)).alias("trusted"))).astype(float)
    ratio = np.log((trusted + 1) / (trusted.sum() + len(trusted))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    model = Model(ratio.astype(np.float32), 0.0)
    scored = verdicts(marked.where("__label is not null"), model, "text", ["__label"]).where("not base_failed")
    return Model(model.ratio, threshold(scored.select(F.col("__label").alias("label"), "score"), care))


def threshold(scored: DataFrame, care: float, cells: int = CELLS) -> float:
    """Where care times the share of lost good scores and that of kept bad ones together are least, amid the gap; of
    rows (label, score).

    A cut stands above each different score, and one below all. The driver gets a row for each cell of scores at most."""
    each = common.cut(scored.groupBy("score").agg(F.sum("label").cast("long").alias("good"), F.sum(1 - F.col("label")).cast("long").alias("bad")))
    good, bad, lowest, borders = each.agg(F.sum("good"), F.sum("bad"), F.min("score"), F.percentile_approx("score", [i / cells for i in range(1, cells)])).first()
    if not good or not bad:
        return float("-inf")
    cell = F.size(F.filter(F.array(*map(F.lit, sorted(set(borders)))), lambda x: x < F.col("score")))
    each = common.cut(each.withColumn("cell", cell))
    sums = each.groupBy("cell").agg(F.sum("good").alias("good_in"), F.sum("bad").alias("bad_in"))
    before = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # over a row a cell
    sums = sums.select("cell", *(F.coalesce(F.sum(f"{c}_in").over(before), F.lit(0)).alias(f"{c}_before") for c in ("good", "bad")))
    up_to = W.partitionBy("cell").orderBy("score")
    lost, gone = (F.sum(c).over(up_to) + F.col(f"{c}_before") for c in ("good", "bad"))
    cost = (care * lost / F.lit(good) + 1 - gone / F.lit(bad)).alias("cost")
    cuts = common.cut(each.join(F.broadcast(sums), "cell").select("cell", "score", cost))
    least = min(1.0, cuts.agg(F.min("cost")).first()[0])  # the cut below all costs 1
    best = cuts.where(F.col("cost") <= least + 1e-12)
    at = dict(best.groupBy("cell").count().collect())
    below = int(least > 1 - 1e-12)
    place = (below + sum(at.values())) // 2 - below  # of the best cuts the one in the middle
    if place < 0:
        return lowest - 1
    for one in sorted(at):
        if place < at[one]:
            break
        place -= at[one]
    number = F.row_number().over(W.orderBy("score"))  # over the best cuts of one cell
    low = best.where(F.col("cell") == one).select("score", number.alias("number")).where(F.col("number") == place + 1).first()[0]
    high = each.where(F.col("score") > low).agg(F.min("score")).first()[0]
    return low + 1 if high is None else (low + high) / 2


def repeated_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            n += line in seen
            seen.add(line)
    return n


def repeated_words(codes: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text (codes one after another) that lie in a window found twice or more in the text."""
    ends = np.cumsum(sizes)
    key = np.zeros(max(0, len(codes) - window + 1), np.uint64)
    if not len(key):
        return np.zeros(len(sizes), np.int64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - window + 1 + k].astype(np.uint64)
        key ^= key >> np.uint64(29)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[: len(key)] == text[window - 1 :]
    key = (key * np.uint64(0xD6E8FEB86659FD93)) ^ (text[: len(key)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    at = np.flatnonzero(inside)
    order = np.argsort(key[at], kind="stable")
    same = key[at][order][1:] == key[at][order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + window, -1)
    return common.per_row((np.cumsum(step[:-1]) > 0).astype(np.int64), np.concatenate([[0], ends]))


def verdicts(df: DataFrame, model: Model, text: str = "text", carry=None) -> DataFrame:
    """carried columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    ratio, least = np.rint(model.ratio.astype(float) * UNIT).astype(np.int64), model.threshold

    def make():
        symbol, char = np.zeros(256, bool), np.ones(256, bool)
        symbol[list(SYMBOLS.encode())] = True
        char[[32, *range(9, 14), *range(0x80, 0xC0)]] = False  # white space and bytes that continue a character

        def work(texts: pa.Array) -> list:
            raw = texts.cast(pa.binary()).to_pylist()
            data, offsets = common.byte_view(texts)
            codes, n = coded(raw)
            repeats = repeated_words(codes, n)
            chars, symbols = (common.per_row(t[data].astype(np.int64), offsets) for t in (char, symbol))
            lines = np.fromiter(map(repeated_lines, raw), np.int64, len(raw))
            value = np.zeros(len(data), np.int64)
            value[: max(0, len(data) - GRAM + 1)] = ratio[grams(data)] * within(offsets)
            words = common.per_row(ratio[doubling(codes, n)], np.concatenate([[0], np.cumsum(n)]))
            score = (common.per_row(value, offsets) + words) / (UNIT * np.maximum(1, np.diff(offsets) - GRAM + 1))
            failed = (n < 10) | (100 * repeats > 20 * n)
            return [n, chars, symbols, lines, repeats, failed, ~failed & (score >= least), score]

        return work

    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [T.StructField(c, T.LongType()) for c in longs] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]
    return common.map_text(df, text, [*fields, T.StructField("score", T.DoubleType())], make, carry)


def rate(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", carry=None, **options) -> DataFrame:
    """verdicts by a model fitted to the same documents and their labels."""
    return verdicts(df, fit(df, labels, doc_id, text, **options), text, carry)
