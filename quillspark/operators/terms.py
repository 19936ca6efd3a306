"""Fixed terms, spoken punctuation, and single words with numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import first, let, look_up, only, put, trimmed, words
from ..functions.numbers import single
from .counts import cardinal

# Terms replaced wherever they stand, in this order, and terms that are a whole input.
ANYWHERE = {
    "l g a eleven fifty": "LGA 1150",
    "s and p five hundred": "S&P 500",
    "seven eleven": "7-eleven",
    "for example": "e.g.",
    "doctor": "dr.",
    "misses": "mrs.",
    "mister": "mr.",
    "saint": "st.",
}
WHOLE = {"p c i e x eight": "PCIe x8", "cat five e": "CAT5e", "c u d n n": "cuDNN", "r t x": "RTX"}
# Punctuation.
PUNCTUATION = {
    "exclamation point": "!", "exclamation mark": "!", "question mark": "?",
    "open parenthesis": "(", "close parenthesis": ")", "left parenthesis": "(", "right parenthesis": ")",
    "open bracket": "[", "close bracket": "]", "left bracket": "[", "right bracket": "]",
    "open brace": "{", "close brace": "}", "left brace": "{", "right brace": "}",
    "double quote": '"', "single quote": "'", "forward slash": "/", "back slash": "\\",
    "period": ".", "dot": ".", "comma": ",", "colon": ":", "semicolon": ";", "hyphen": "-", "dash": "-",
    "ellipsis": "...", "ampersand": "&", "asterisk": "*", "at sign": "@", "hash": "#", "percent": "%", "plus": "+",
    "equals": "=", "tilde": "~", "underscore": "_", "pipe": "|", "slash": "/",
}


def term(value: Column) -> Column:
    """The text with the first place of each term replaced, with a capital where the place has one."""
    steps = F.array(*[F.struct(F.lit(a).alias("said"), F.lit(b).alias("written")) for a, b in ANYWHERE.items()])

    def step(text: Column, t: Column) -> Column:
        def put_at(at: Column) -> Column:
            capital = F.substr(text, at, F.lit(1)).rlike(r"^\p{Lu}")
            written = F.when(capital, put(F.upper(F.left(t["written"], F.lit(1))), F.substr(t["written"], F.lit(2)))).otherwise(t["written"])
            return F.when(at == 0, text).otherwise(put(F.left(text, at - 1), written, F.substr(text, at + F.length(t["said"]))))

        return F.when(F.lower(value).contains(t["said"]), let(F.position(t["said"], F.lower(text)), put_at)).otherwise(text)

    anywhere = only(F.lower(value).rlike("|".join(ANYWHERE)), F.aggregate(steps, value, step))
    return first(look_up(WHOLE, trimmed(F.lower(value))), anywhere)


def punctuation(value: Column) -> Column:
    return look_up(PUNCTUATION, trimmed(F.lower(value)))


def word(value: Column) -> Column:
    """Single letters and a number word put together; a number with punctuation behind it."""
    letters = lambda ws: F.slice(ws, 1, F.size(ws) - 1)
    number_of = lambda ws: single(F.lower(F.try_element_at(ws, F.lit(-1)))).cast("string")
    joined = let(words(value), lambda ws: only(F.size(ws) >= 2, only(F.forall(letters(ws), lambda w: w.rlike("^[A-Za-z]$")), put(F.array_join(letters(ws), ""), number_of(ws)))))
    marked = put(cardinal(F.left(value, F.length(value) - 1)), " ", F.right(value, F.lit(1)))
    return first(joined, only((F.length(value) > 1) & value.rlike(r"[!-/:-@\[-`{-~]$"), marked))
