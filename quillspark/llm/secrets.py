"""Secret scans with linking of multipart credentials.

Base spans are what three fixed patterns find: assignments of a password, token or key, access
identifiers, and long hexadecimal strings. Beside them there are weak candidates, which say little by
themselves: short access identifiers and values of user or client names (access), short values of an
assignment and strings of mixed characters with much entropy (secret), and addresses of services
(endpoint). Parts are linked by an interval join: parts of one text whose distance is at most ``scope``
code points. A weak secret is reported if an access identifier, weak or not, or an endpoint stands in
its scope; a weak access identifier if a secret, weak or not, does. Endpoints are no spans themselves.

The join works on parts, not on texts: each part stands in all cells of ``scope`` code points that it touches,
and a weak one meets the parts of all cells that its scope touches, before its start and after its end, so neither a text with very many parts nor copies of a text
(which count as one) gather in one task.

Null texts count as empty. Offsets are code points, ends exclusive. Rows of equal text have equal spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCOPE = 300

# The base patterns (letters of the words in either case), the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "weak_access", "weak_secret"]
WORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]

# Patterns of weak parts.
WEAK_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA|AGPA|AIDA|AROA)[A-Z0-9]{8,}")
NAMED = re.compile(r"""(?<![A-Za-z])(?:access_?key_?id|client_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.I | re.A)
ENTROPIC = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
ENDPOINT = re.compile(r"""(?:https?|ftp|jdbc:[a-z]+|mongodb|postgres(?:ql)?|redis|amqp)://[^\s"'<>]{4,}|(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""", re.I | re.A)

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.LongType())])
PART = T.StructType([T.StructField("part", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("weak", T.BooleanType())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end), in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def mixed(value: str) -> bool:
    """Whether a string has small and capital letters and digits, and 3.5 bits of entropy a character."""
    if not (re.search("[a-z]", value) and re.search("[A-Z]", value) and re.search("[0-9]", value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= 3.5


def parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int, int, bool]]:
    """(part, start, end, weak) of a text: its base spans and the weak candidates outside them."""
    found = [("access" if rank == 1 else "secret", start, end, False) for start, rank, end in base]
    covered: list[list[int]] = []  # base spans put together, apart from each other
    for start, _, end in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    begins = [a for a, _ in covered]

    def free(a: int, b: int) -> bool:
        k = bisect_left(begins, b)
        return k == 0 or covered[k - 1][1] <= a

    weak = [("secret", m.start(), m.end()) for m in ASSIGN.finditer(text) if 4 <= len(m[2]) < 12]
    weak += [("secret", m.start(), m.end()) for m in ENTROPIC.finditer(text) if mixed(m[0])]
    weak += [("access", m.start(), m.end()) for m in WEAK_ACCESS.finditer(text)] + [("access", m.start(1), m.end(1)) for m in NAMED.finditer(text)]
    weak = [(part, a, b, True) for part, a, b in weak if free(a, b)]
    if not any(part != "endpoint" for part, *_ in weak):
        return []  # nothing that linking could add
    return found + weak + [("endpoint", m.start(), m.end(), True) for m in ENDPOINT.finditer(text)]


def long_runs(column: pa.Array, allowed: str, least: int) -> np.ndarray:
    """Whether each text has a run of so many of the (ASCII) characters."""
    data, offsets = common.byte_view(column)
    table = np.zeros(256, bool)
    table[list(allowed.encode())] = True
    inside = np.concatenate([[False], table[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    # a run may go on from one text into the next: such texts are looked at once more
    start, end = edge[::2], edge[1::2]
    keep = end - start >= least
    hit = np.zeros(len(column) + 1, bool)
    for a, b in zip(start[keep].tolist(), end[keep].tolist()):
        hit[np.searchsorted(offsets, a, "right") - 1 : np.searchsorted(offsets, b, "left")] = True
    return hit[: len(column)]


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"


def scan(df: DataFrame, text: str = "text", carry=None) -> DataFrame:
    """carried columns with key (of the text), n_assign, n_access, n_hex, base_sha256, base and parts."""

    def make():
        def work(texts: pa.Array) -> list:
            raw = texts.cast(pa.binary()).to_pylist()
            hexes, entropic = long_runs(texts, DIGITS + "abcdef", 16), long_runs(texts, LETTERS + DIGITS + "+/_-", 20)
            rows = []
            for x, has_hex, has_long in zip(raw, hexes.tolist(), entropic.tolist()):
                low = x.lower()
                if not (has_hex or has_long or b"akia" in low or b"asia" in low or any(w in low for w in WORDS) or b"user" in low or b"login" in low or b"client" in low or b"access" in low or b"agpa" in low or b"aida" in low or b"aroa" in low):
                    rows.append((0, 0, 0, NOTHING, [], []))
                    continue
                value = x.decode()
                base = base_spans(value)
                counts = Counter(rank for _, rank, _ in base)
                said = ",".join(f"{KINDS[rank]}:{start}:{end}" for start, rank, end in base)
                rows.append((counts[0], counts[1], counts[2], hashlib.sha256(said.encode()).hexdigest(), base, parts(value, base)))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            flat = [pa.array(c, t) for c, t in zip(columns, types)]
            base = pa.array([[dict(zip(("start", "rank", "end"), s)) for s in x] for x in columns[4]], pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())])))
            part = pa.array([[dict(zip(("part", "start", "end", "weak"), s)) for s in x] for x in columns[5]], pa.list_(pa.struct([("part", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("weak", pa.bool_())])))
            return [*flat, base, part]

        return work

    fields = [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")] + [T.StructField("base_sha256", T.StringType())]
    fields += [T.StructField("base", T.ArrayType(SPAN)), T.StructField("parts", T.ArrayType(PART))]
    keep = common.carried(df, carry, ["key", *(f.name for f in fields)])
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__scanned"))
    rows = rows.withColumn("key", F.md5("__scanned"))
    return common.map_text(rows, "__scanned", fields, make, [*keep, "key"])


NOTHING = hashlib.sha256(b"").hexdigest()


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, added): the weak spans of each text that complementary parts support."""
    every = scanned.where(F.size("parts") > 0).select("key", F.explode("parts").alias("p")).select("key", "p.*").distinct()
    cell = F.floor(F.col("start") / scope)
    # all cells that a part in scope, before the start or after the end, can touch
    reach = F.sequence(F.floor((F.col("start") - scope - 1) / scope), F.floor((F.col("end") + scope) / scope))
    mine = every.where("weak and part != 'endpoint'").select("key", "part", "start", "end", F.explode(reach).alias("cell"))
    # a part longer than a cell stands in every cell that it touches
    other = every.select("key", F.col("part").alias("other"), F.col("start").alias("a"), F.col("end").alias("b"), F.explode(F.sequence(cell, F.floor((F.col("end") - 1) / scope))).alias("cell"))
    near = (F.col("a") - F.col("end") <= scope) & (F.col("start") - F.col("b") <= scope)
    fits = ((F.col("part") == "secret") & F.col("other").isin("access", "endpoint")) | ((F.col("part") == "access") & (F.col("other") == "secret"))
    apart = (F.col("a") >= F.col("end")) | (F.col("start") >= F.col("b"))
    found = mine.join(other, ["key", "cell"]).where(near & fits & apart).select("key", "start", F.when(F.col("part") == "access", 3).otherwise(4).alias("rank"), "end").distinct()
    return found.groupBy("key").agg(F.collect_list(F.struct("start", "rank", "end")).alias("added"))


def find(df: DataFrame, text: str = "text", carry=None, scope: int = SCOPE) -> DataFrame:
    """carried columns, key, the counts and base_sha256, and all spans as an array in order.

    The scan, without texts, is written once to the checkpoint folder."""
    scanned = common.cut(scan(df, text, carry))
    found = scanned.join(common.cut(linked(scanned, scope)), "key", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(T.ArrayType(SPAN)))))
    return found.withColumn("every", every).drop("base", "parts", "added")


def spans_text(every: str = "every"):
    kinds = F.array([F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(every, one), ",")


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    found = find(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", ["doc_id"], scope)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans_text().alias("spans"))


def blotted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with mark in place of each span, or of spans that overlap; spans are in order of their starts."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """df with every span of its texts replaced by mark; null texts stay null."""
    found = find(df.select(F.col(f"`{text}`").alias("text")), "text", [], scope).where(F.size("every") > 0)
    spans = common.cut(found.groupBy("key").agg(F.first("every").alias("every")))
    key, name = common.free_name(df, "key"), common.free_name(df, "every")
    rows = df.withColumn(key, F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    spans = spans.select(F.col("key").alias(key), F.col("every").alias(name))
    small = common.few(spans.select(F.explode(name)), 500_000) is not None  # spans, each of a few dozen bytes
    rows = rows.join(F.broadcast(spans) if small else spans, key, "left")
    own = [F.col(f"`{c}`").cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    at, place = df.columns.index(text), len(df.columns)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in df.schema.fields])

    def run(batches):  # of rows with spans, a part at a time
        for batch in batches:
            sizes = pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0, np.int64)
            for a, b in common.steps(sizes):
                part = batch.slice(a, b - a)
                made = [blotted(x, [(s["start"], s["end"]) for s in spans], mark) for x, spans in zip(part.column(at).to_pylist(), part.column(place).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if i == at else part.column(i) for i in range(place)], names=schema.names)

    plain = rows.where(F.col(name).isNull()).select(*own)
    return plain.union(common.map_batches(rows.where(F.col(name).isNotNull()).select(*own, name), run, schema))
