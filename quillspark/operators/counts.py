"""Cardinals, ordinals and decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import after, before, first, let, look_up, only, put, trimmed, words
from ..functions.numbers import SCALES, TENS, digits, number

# Ordinal words.
ORDINALS = dict(zip(
    "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth "
    "fifteenth sixteenth seventeenth eighteenth nineteenth".split(), range(20)
)) | {w[:-1] + "ieth": n for w, n in TENS.items()}
ORDINAL_SCALES = {"hundredth": 10**2, "thousandth": 10**3, "millionth": 10**6, "billionth": 10**9}
BIG_SCALES = ["trillion", "billion", "million", "thousand"]
_ZEROS = {w: len(str(SCALES[w])) - 1 for w in BIG_SCALES}
#: A scale at the end of a number that a larger scale has begun, as in "one million two hundred thousand".
_BEGUN = "(?U)" + "|".join(
    rf"(?:^|\s)(?:{'|'.join(w for w, n in SCALES.items() if n > SCALES[scale])})\s(?:.*\s)?(?!(?:{'|'.join(SCALES)})\s)\S+\s+{scale}$" for scale in BIG_SCALES
)


def signed(value: Column, signs: list[str], then) -> Column:
    """``then`` of what follows a sign word, behind a minus, or of the value itself."""
    pattern = "^(?:" + "|".join(signs) + ") "
    return let(value.rlike(pattern), lambda s: let(F.regexp_replace(value, pattern, ""), lambda x: put(F.when(s, "-").otherwise(""), then(x))))


def cardinal(value: Column) -> Column:
    plain = lambda low: signed(low, ["minus", "negative"], lambda x: number(x).cast("string"))
    return let(trimmed(F.lower(value)), lambda low: F.when(low == "zero", "zero").otherwise(plain(low)))


def with_ending(n: Column) -> Column:
    rest = n % 10
    teen = (n % 100).between(11, 13)
    ending = F.when(teen, "th").when(rest == 1, "st").when(rest == 2, "nd").when(rest == 3, "rd").otherwise("th")
    return put(n.cast("string"), ending)


def ordinal_number(value: Column) -> Column:
    """The number of an ordinal, as decimal."""

    def of(ws: Column) -> Column:
        last = F.try_element_at(ws, F.lit(-1))
        ahead = number(F.array_join(F.slice(ws, 1, F.size(ws) - 1), " "))
        scale, own = look_up(ORDINAL_SCALES, last), look_up(ORDINALS | ORDINAL_SCALES, last)
        more = let(ahead, lambda a: F.when(scale.isNotNull(), F.try_multiply(a, scale)).otherwise(F.try_add(a, own)))
        return only(own.isNotNull(), F.when(F.size(ws) == 1, own).otherwise(more)).cast("decimal(38,0)")

    return let(words(F.lower(value)), of)


def ordinal(value: Column) -> Column:
    return let(ordinal_number(value), with_ending)


def point(low: Column) -> Column:
    """Digits around the word point."""

    def unsigned(x: Column) -> Column:
        lead = x.startswith("point ")
        rest = F.when(lead, F.substr(x, F.lit(7))).when(x.contains(" point "), after(x, " point "))
        return put(F.when(lead, "").otherwise(number(before(x, " point ")).cast("string")), ".", digits(rest))

    return only(low.rlike("(?:^| )point "), signed(low, ["minus", "negative"], unsigned))


def decimal(value: Column) -> Column:
    """A number with a point, or in front of a scale. Where a larger scale has begun the number, it is counted by the last
    one as a whole: "one million two hundred thousand" are 1200 thousand."""

    def scaled(original: Column, low: Column) -> Column:
        scale = F.regexp_extract(low, f"({'|'.join(BIG_SCALES)})$", 1)
        return only(scale != "", let(F.length(scale), lambda n: of(low, trimmed(F.left(low, F.length(low) - n)), F.right(original, n))))

    def of(low: Column, head: Column, scale: Column) -> Column:
        whole = lambda begun: let(number(F.when(begun, low).otherwise(head)).cast("string"), lambda n: F.when(begun, counted(n, scale)).otherwise(n))
        return F.when(head.contains(" point "), put(point(head), " ", scale)).otherwise(put(let(low.rlike(_BEGUN), whole), " ", scale))

    def counted(n: Column, scale: Column) -> Column:
        zeros = look_up(_ZEROS, F.lower(scale))
        return only(F.right(n, zeros) == F.repeat(F.lit("0"), zeros), F.left(n, F.length(n) - zeros))

    return let(trimmed(value), lambda o: let(F.lower(o), lambda low: first(scaled(o, low), point(low))))


