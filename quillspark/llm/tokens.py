"""Exact token counts of a SentencePiece model, with huge documents in overlapping chunks.

A document of more than ``chunk`` characters is encoded in chunks that overlap. Each chunk is encoded
with the offsets of its pieces, and two neighbours are spliced at a boundary inside their overlap that
is proven stable: no piece of the vocabulary holds the space mark after another character (checked
when the model is loaded), so no merge spans the place between a character that is no space and a
space, whatever stands around it. Such a place must show as a boundary in both encodings. If an
overlap has none, as in a long run without spaces, it is widened, twofold each time, up to the rest of
the document. So counts equal those of the whole text, and only one chunk's pieces are in memory.

Nulls and empty texts have 0 tokens. Only the text is read; other columns are passed on as they are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

CHUNK, OVERLAP, LIMIT = 16_384, 256, 4096
MARK = "▁"


@lru_cache(maxsize=4)
def model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model and whether places before a space are stable in it."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    splits = not any(MARK in p.lstrip(MARK) for p in pieces)
    same = all(sp.encode(x, return_type=str) == y for x, y in (("a  b", [MARK + "a", MARK, MARK + "b"]), (" ", [MARK * 2])))
    plain = sp.decode(sp.encode("ﬁ\u3000a\ta")) == "ﬁ\u3000a\ta"
    return sp, splits and same and plain  # the text is neither changed, nor its spaces joined, before encoding


def bounds(sp, text: str) -> np.ndarray:
    """Ends of the pieces of a text, in characters: counts up to any boundary are exact."""
    offsets = sp.encode(text, return_type="offset_mapping")["offsets"]
    return np.fromiter((end for _, end in offsets), np.int64, len(offsets))


def stable(text: str, low: int, high: int) -> int:
    """The first place in [low, high) that has a space after and no space before it; -1 if there is none."""
    at = text.find(" ", max(low, 1), high)
    while at >= 0 and text[at - 1] in (" ", MARK):
        at = text.find(" ", at + 1, high)
    return at


def count_long(sp, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a long text, chunk by chunk.

    A chunk begins at a splice, where the space mark that the library puts before any text stands for
    the space that is left out, and ends ``overlap`` characters beyond the next chunk's begin."""
    total, begin, size = 0, 0, len(text)
    lead = 0  # characters of text that the library's own space mark replaces
    while begin < size:
        nominal, wide = begin + chunk, overlap
        if nominal + overlap >= size:
            return total + len(sp.encode(text[begin + lead :]))
        while True:
            end = min(size, nominal + wide)
            if end == size:
                return total + len(sp.encode(text[begin + lead :]))
            cut = stable(text, nominal, end)
            if cut >= 0:
                left = bounds(sp, text[begin + lead : end])
                right = bounds(sp, text[cut + 1 : min(size, end + overlap)])  # begins at the splice
                n = int(np.searchsorted(left, cut - begin - lead, "right"))
                aligned = n > 0 and left[n - 1] == cut - begin - lead
                shared = left[n:] + (begin + lead) - (cut + 1)  # the overlap's boundaries as either sees them
                k = min(len(shared), len(right), 4)
                if aligned and (k == 0 or end == size or np.array_equal(shared[: k - 1], right[: k - 1])):
                    total, begin, lead = total + n, cut, 1
                    break
            wide *= 2
    return total


def count_tokens(df: DataFrame, path: str, text: str = "text", carry=None, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """carried columns with n_bytes, n_tokens and over_limit; ``path`` is the model's file on every executor."""

    def make():
        sp, splits = model(path)

        def work(texts: pa.Array) -> list:
            values = texts.to_pylist()
            counts = np.zeros(len(values), np.int64)
            short = [i for i, x in enumerate(values) if len(x) <= chunk or not splits]
            for i, ids in zip(short, sp.encode([values[i] for i in short], num_threads=1)):
                counts[i] = len(ids)
            for i in set(range(len(values))).difference(short):
                counts[i] = count_long(sp, values[i], chunk, overlap)
            return [pa.compute.binary_length(texts).cast(pa.int64()), counts, counts > limit]

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return common.map_text(df, text, fields, make, carry)
