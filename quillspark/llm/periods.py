"""Runs in the words of a text: stretches that repeat themselves with a period, found by counting lags.

A run of period q and some length has length - q places in a row where a word equals the one q words on. So a lag can
only be the period of a run in a piece of text if the piece has enough such places, and these are counted for all
lags at once, exactly: for words that are frequent in the piece from the sum of their autocorrelations, by one FFT each
and one back; for all others from the differences of each two of their places. Only lags with enough matches, beside those that
runs of shorter periods account for, are scanned for islands: matches in a row.

Pieces. Lags up to ``reach`` are counted in pieces of 4 * reach words, which overlap in 2 * reach, so that
every run lies in pieces with enough of its matches; then reach doubles, until a piece holds the whole text. So chance
matches of a long text do not add up, and no lag is scanned far from where it matches. Islands of one lag are put
together over pieces.

An island whose stretch is that of a shorter period is no run of its own, by the periodicity lemma: if a stretch of at
least 2q words has periods q and p < q, the smallest one divides q, and both stretches are the same.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and no runs. Each row is worked on by itself,
so ties, repeated rows and null ids do not matter. A row is one task's; several short ones are one step. Time grows
a little faster than the words of a text; only where two or three different words make up a whole long text do
so many lags have enough matches that it grows with the square. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LEAST, REACH, PIECE = 12, 256, 4
WORD = r"[^\x20\x09-\x0D]+"


def needed(lag):
    """Matches in a row that a run of this period has at least (numbers or arrays)."""
    return np.maximum(LEAST - lag, lag)


def lag_counts(ids: np.ndarray, start: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ends): for each piece ids[start : start + size] the places where a word equals the one lag words on, for
    the lags low + 1 to high; those of piece k are counts[ends[k] : ends[k + 1]]."""
    ends = np.concatenate([[0], np.cumsum(high - low)])
    counts = np.zeros(int(ends[-1]), np.int64)
    piece = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
    key = piece * (int(ids.max(initial=0)) + 1) + ids[start[piece] + place]
    order = np.argsort(key, kind="stable")
    key, piece, place = key[order], piece[order], place[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    many = np.diff(first, append=len(key))  # how often each word of each piece occurs
    own = piece[first]
    fft = np.exp2(np.ceil(np.log2(np.maximum(size + high, 2))))[own]
    heavy = many.astype(np.float64) ** 2 * (high[own] / np.maximum(size[own], 1)) > fft * np.log2(fft)
    spectrum: dict[int, np.ndarray] = {}
    for k in np.flatnonzero(heavy).tolist():
        n = int(fft[k])
        x = np.zeros(n)
        x[place[first[k] : first[k] + many[k]]] = 1
        y = np.fft.rfft(x)
        spectrum[int(own[k])] = spectrum.get(int(own[k]), 0) + (y.real**2 + y.imag**2)
    for k, power in spectrum.items():
        counts[ends[k] : ends[k + 1]] += np.rint(np.fft.irfft(power)[low[k] + 1 : high[k] + 1]).astype(np.int64)
    active, step = np.flatnonzero(~np.repeat(heavy, many)), 1
    while len(active):
        active = active[active + step < len(key)]
        later = active + step
        gap = place[later] - place[active]
        near = (key[later] == key[active]) & (gap <= high[piece[active]])
        active, gap = active[near], gap[near]
        beyond = gap > low[piece[active]]
        counts += np.bincount(ends[piece[active[beyond]]] + gap[beyond] - low[piece[active[beyond]]] - 1, minlength=len(counts))
        step += 1
    return counts, ends


def islands(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of at least so many places in a row that match at the lag."""
    match = np.zeros(len(ids) - lag + 2, np.int8)
    match[1:-1] = ids[lag:] == ids[:-lag]
    turns = np.flatnonzero(np.diff(match))
    return [(a, b) for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()) if b - a >= least]


def explained(run: tuple[int, int, int], a: int, b: int, low: int, high: int) -> tuple[slice, np.ndarray] | None:
    """Matches at lags low + 1 to high in words a to b - 1 that a run (start, end, period) accounts for, whose period
    divides the lag: at which lags (from 0), and how many each; None if at none.

    Two runs of periods that divide a lag overlap in less than the lag, so no match is counted twice."""
    held, p = min(run[1], b) - max(run[0], a), run[2]
    lags = np.arange((low // p + 1) * p, min(high, held) + 1, p)
    return (slice(int(lags[0]) - low - 1, int(lags[-1]) - low, p), held - lags) if len(lags) else None


class Known:
    """The runs of a text that are known so far."""

    def __init__(self):
        self.runs: list[tuple[int, int, int]] = []  # (start, end, period)
        self.by_period: dict[int, list[tuple[int, int]]] = {}

    def add(self, start: int, end: int, period: int) -> None:
        self.runs.append((start, end, period))
        insort(self.by_period.setdefault(period, []), (start, end))

    def covers(self, start: int, end: int, lag: int) -> bool:
        """Whether a run whose period divides the lag holds the words start to end - 1."""
        for period, own in self.by_period.items():
            if lag % period == 0 and lag > period:
                at = bisect_right(own, (start, 1 << 62))
                if any(e >= end for _, e in own[max(at - 2, 0) : at]):  # two that begin before may reach so far
                    return True
        return False


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, which is given as an array of numbers, by start and period."""
    found = [Known() for _ in texts]
    ids = np.concatenate([np.zeros(0, np.int64), *texts])
    sizes = np.array([len(x) for x in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    todo, below, reach = np.flatnonzero(sizes >= LEAST), 0, REACH
    while len(todo):
        whole = sizes[todo] <= PIECE * reach
        stride = np.where(whole, PIECE * reach, (PIECE - 2) * reach)
        pieces = np.where(whole, 1, -(-(sizes[todo] - 2 * reach) // stride))
        of = np.repeat(todo, pieces)
        at = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * np.repeat(stride, pieces)
        size = np.minimum(PIECE * reach, sizes[of] - at)
        high = np.where(np.repeat(whole, pieces), sizes[of] // 2, reach)
        low = np.minimum(below, high)
        counts, ends = lag_counts(ids, begins[of] + at, size, low, high)
        lags = np.arange(len(counts)) - np.repeat(ends[:-1] - low - 1, high - low)
        enough = (counts >= needed(lags)) & (lags + needed(lags) <= np.repeat(size, high - low))
        hits: dict[int, list[int]] = {}
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(enough), "right") - 1).tolist():
            hits.setdefault(int(of[k]), []).append(k)
        for text, own in hits.items():
            table = np.array([counts[ends[k] : ends[k + 1]] for k in own])
            scan(found[text], texts[text], at[own].tolist(), int(size[own].max()), int(low[own[0]]), table)
        todo, below, reach = todo[~whole], reach, 2 * reach
    return [sorted((s, e - s, p) for s, e, p in own.runs) for own in found]


def scan(known: Known, ids: np.ndarray, at: list[int], size: int, low: int, counts: np.ndarray) -> None:
    """Adds to the known runs of a text those whose periods are among the lags, from low + 1, that are counted (a row a
    piece) in pieces of so many words (the last may have fewer) which begin at the given places, in order."""

    def account(run: tuple[int, int, int]) -> None:
        for k in range(bisect_right(at, run[0] - size), bisect_left(at, run[1])):
            if part := explained(run, at[k], min(at[k] + size, len(ids)), low, low + counts.shape[1]):
                counts[k, part[0]] -= part[1]

    for run in [r for r in known.runs if r[1] - r[0] > low]:
        account(run)
    least = needed(np.arange(low + 1, low + 1 + counts.shape[1]))
    for i in np.flatnonzero((counts >= least).any(axis=0)).tolist():
        lag, stretches = low + 1 + i, []
        for k in np.flatnonzero(counts[:, i] >= least[i]).tolist():
            for a, b in islands(ids[at[k] : at[k] + size], lag, int(least[i])):
                if stretches and a + at[k] <= stretches[-1][1]:  # one island, in two pieces
                    stretches[-1][1] = max(stretches[-1][1], b + at[k])
                else:
                    stretches.append([a + at[k], b + at[k]])
        for a, b in stretches:
            if not known.covers(a, b + lag, lag):
                known.add(a, b + lag, lag)
                account((a, b + lag, lag))


def dropped(size: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of so many words stand in a run behind its first period."""
    change = np.zeros(size + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def collapse(df: DataFrame, text: str = "text", carry=None, names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """carried columns with the runs of the text's words, by start and then by period, and the text of the words that
    are left if of each run only the first period stays, joined by one blank."""

    def make():
        def work(texts: pa.Array) -> list:
            numbers: dict[bytes, int] = {}
            words = [x.split() for x in texts.cast(pa.binary()).to_pylist()]
            ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in ws), np.int64, len(ws)) for ws in words]
            found = runs_of(ids)
            left = [b" ".join([w for w, gone in zip(ws, dropped(len(ws), own).tolist()) if not gone] if own else ws).decode() for ws, own in zip(words, found)]
            flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
            values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=RUN.names)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(own) for own in found], dtype=np.int64)]).astype(np.int32))
            return [pa.ListArray.from_arrays(ends, values), pa.array(left, pa.string())]

        return work

    return common.map_text(df, text, [T.StructField(names[0], T.ArrayType(RUN)), T.StructField(names[1], T.StringType())], make, carry)


def rehearsed(text: Column, number: Column) -> Column:
    """The text with its words from some place on replaced by repetitions of the first of them, where 10 divides the
    number; where and how often follows from the number. Words are then joined by one blank."""

    def of(words: Column, g: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i >= a, a + (i - a) % p).otherwise(i))), " ")

    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    made = F.element_at(F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, of(ws, F.floor(number / 10))).otherwise("")), 1)
    return F.when(number % 10 == 0, made).otherwise(text)


def report(df: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run, runs_sha256 and collapsed_sha256, of
    texts that are rehearsed by the CRC-32 of doc_id (those without doc_id stay as they are)."""
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    value = F.col("text").cast("string")
    rows = df.select("doc_id", F.coalesce(rehearsed(value, number), value, F.lit("")).alias("text"))
    made = collapse(rows, carry=["doc_id"])
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    made = made.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, start, period = F.col("best.length"), -F.col("best.start"), -F.col("best.period")
    milli = F.floor(1000 * length / period).cast("long")
    return made.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
