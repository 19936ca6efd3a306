"""Packing token sequences by sum of squares.

Texts are encoded, get one end token, and only those longer than the capacity are cut, into pieces of
the capacity. Pieces are dealt at random into groups of about ``group`` rows, and each group is packed
by itself, longest piece first: a piece goes where the sum, over all residual gaps, of the squared
number of open sequences with that gap becomes smallest; a new sequence is opened only if no open one
has room, which keeps sequences few. A group wastes about one sequence in thousands; its size is
fixed, so more rows mean more groups, not larger ones.

Encoding: white space parts words that no token spans (the tokenizer drops it), so words are encoded by the library
one by one, those that come again are remembered, and their ids are put together again per text.

Nulls: a null text is an empty one, which is its end token alone. Rows of equal doc_id are packed each.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CAPACITY, END_ID, GROUP, STEP = 4096, 1, 20_000, 4 << 20
PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


#: Words that need no more of the tokenizer than its model: letters of which lower case and composition are
#: plain, digits, which stand by themselves, and ASCII punctuation other than apostrophes, with no mark of a special token.
PLAIN = re.compile(r"(?!.*<\|)[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]+").fullmatch
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
#: Words by which a tokenizer is tried: whether it makes of plain words what its model makes of their parts.
PROBES = [w + m for w in ("a", "Z", "the", "Hello", "UPPER", "mixedCase", "unbelievableness", "ÉCOLE", "straße", "x1", "2024", "a1b22", *LETTERS) for m in ("", ".", ",", "!", "?", ";", ":", "...", "?!", "-x", ")", "#*$")]
#: Words that are kept for good, and as many in turn; of parts of words half as many.
KEPT = 150_000


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Stems(dict):
    """Letters, a digit or punctuation -> ids as bytes, as the tokenizer's model alone gives them."""

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        split = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer is not None else lambda x: [(x, None)]
        self.letters = {ord(c): "".join(part for part, _ in split(c)) for c in LETTERS}  # as the model sees them

    def __missing__(self, stem: str) -> bytes:
        own = stem if stem.isascii() else stem.translate(self.letters)
        self[stem] = ids = pack_ids([t.id for t in self.model.tokenize(own)])
        return ids


class Words(dict):
    """word (bytes without white space) -> its ids as bytes of unsigned 32-bit integers.

    A plain word is what the tokenizer's model makes of its parts, if none of the tokenizer's other steps changes them,
    as probes tell when it is loaded. All other words, and with other tokenizers all words, go through the
    whole tokenizer."""

    def __init__(self, path: str, kept: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer, self.kept = tokenizers.Tokenizer.from_file(path), kept
        self.stems, self.short = Stems(self.tokenizer), True
        self.short = all(self[w.encode()] == self.whole(w) for w in PROBES)
        self.clear()

    def whole(self, word: str) -> bytes:
        return pack_ids(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if self.short and PLAIN(text):
            text, stems = text.lower(), self.stems
            ids = stems[text] if text.isalpha() else b"".join([stems[x] for x in PARTS(text)])
        else:
            ids = self.whole(text)
        self[word] = ids
        return ids

    def trim(self) -> None:
        """Forgets all but the first words, among which are the frequent ones, so that memory is bounded."""
        for table, kept in ((self, self.kept), (self.stems, self.kept // 2)):
            if len(table) > 2 * kept:
                for word in list(islice(table, kept, None)):
                    del table[word]


@lru_cache(maxsize=2)
def words_of(path: str, kept: int = KEPT) -> Words:
    return Words(path, kept)


def encode(path: str, texts: list[bytes], kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts): the tokens of the texts one after another, and how many each has."""
    words = words_of(path, kept)
    made = []
    for text in texts:
        made.append(b"".join([words[w] for w in text.split()]))
        words.trim()
    counts = np.fromiter(map(len, made), np.int64, len(made)) // 4
    return np.frombuffer(b"".join(made), "<u4"), counts


def pieces(df: DataFrame, path: str, text: str = "text", carry=None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """carried columns with one row a piece: piece, start, length and ids_crc32."""

    def make():
        def work(texts: pa.Array) -> list:
            ids, counts = encode(path, texts.cast(pa.binary()).to_pylist())
            end, rows, sizes, at = np.array([end_id], "<u4"), [], [], 0
            for n in counts.tolist():
                own = np.concatenate([ids[at : at + n], end])
                at += n
                cuts = range(0, n + 1, capacity)
                sizes.append(len(cuts))
                rows += [(k, min(capacity, n + 1 - s), zlib.crc32(own[s : s + capacity].tobytes())) for k, s in enumerate(cuts)]
            piece, length, crc = (np.array(x, t) for x, t in zip(zip(*rows), (np.int32, np.int64, np.int64)))
            values = pa.StructArray.from_arrays([pa.array(piece), pa.array(length), pa.array(crc)], names=PIECE.names)
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)]

        return work

    made = ["piece", "start", "length", "ids_crc32"]
    keep = common.carried(df, carry, made)
    name = common.free_name(df, "pieces")
    cut = common.map_text(df, text, [T.StructField(name, T.ArrayType(PIECE))], make, keep, STEP)
    cut = cut.select(*[F.col(f"`{c}`") for c in keep], F.explode(name).alias(name))
    own = [F.col(f"{name}.{c}").alias(c) for c in ("piece", "length", "ids_crc32")]
    start = (F.col(f"{name}.piece").cast("long") * capacity).alias("start")
    return cut.select(*[F.col(f"`{c}`") for c in keep], own[0], start, own[1], own[2])


def place(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each size, packed by sum of squares, longest first."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences by gap; a full one is not open
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        w = int(sizes[i])
        before = counts[w:]
        change = 2 * (counts[: capacity + 1 - w] - before) + 2  # of the sum, with a sequence moved to the gap that is left
        change[:1] = 1 - 2 * before[:1]  # one filled up leaves the sum
        change[before == 0] = 4 * len(sizes) + 4
        best = int(np.argmin(change)) if w <= capacity else 0
        if before[best] > 0:
            gap = best + w
            k = open_by_gap[gap].pop()
            counts[gap] -= 1
        else:
            gap, k, made = capacity, made, made + 1
        sequence[i], offset[i] = k, capacity - gap
        if gap > w:
            open_by_gap[gap - w].append(k)
            counts[gap - w] += 1
    return sequence, offset


def pack(cut_pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """cut_pieces with sequence_id and offset (columns of these names give way).

    Rows are numbered, written once to the checkpoint folder with their numbers, counted, and dealt to groups
    by a hash of the number, so no value of any column can gather rows. A sequence's id is its group's number
    and its own there, and a group is packed in order of size and number: where and how often a task runs
    changes nothing. No rows give no rows."""
    keep = common.carried(cut_pieces, None, ["sequence_id", "offset"])
    number, dealt = common.free_name(cut_pieces, "number"), common.free_name(cut_pieces, "dealt")
    rows = common.cut(cut_pieces.select(*[F.col(f"`{c}`") for c in keep], F.monotonically_increasing_id().alias(number)))
    groups = -(-rows.count() // group) or 1
    at = rows.columns.index(length)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(table.column(number).to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        sequence, offset = place(table.column(at).to_numpy(), capacity)
        sequence += table.column(dealt)[0].as_py() << 32
        return table.drop_columns([number, dealt]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    fields = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    own = rows.withColumn(dealt, F.pmod(F.xxhash64(number), F.lit(groups)))
    return own.groupBy(dealt).applyInArrow(run, T.StructType([*(rows.schema[c] for c in keep), *fields]))
