"""Numbers as English words, in column expressions: what queries and tests feed to the taggers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import look_up
from ..functions.numbers import SMALL, TENS, UNITS
from ..operators.counts import ORDINALS

_SMALL = list(SMALL)[:20]
_GROUPS = [(10**9, "billion"), (10**6, "million"), (10**3, "thousand")]
_ORDINAL_OF = {w: o for o, n in ORDINALS.items() for w, m in SMALL.items() if m == n} | {"hundred": "hundredth", "thousand": "thousandth", "million": "millionth"}
_DIGIT = {"0": "zero"} | {str(n): w for w, n in UNITS.items()}


def _pick(options: list[str], at: Column) -> Column:
    return F.element_at(F.split(F.lit(" ".join(options)), " "), at.cast("int") + 1)


def below_hundred(n: Column) -> Column:
    tens = _pick(["-", "-", *TENS], F.floor(n / 10))
    return F.when(n < 20, _pick(_SMALL, n)).when(n % 10 == 0, tens).otherwise(F.concat(tens, F.lit(" "), _pick(_SMALL, n % 10)))


def below_thousand(n: Column) -> Column:
    hundreds = F.when(n >= 100, F.concat(_pick(_SMALL, F.floor(n / 100)), F.lit(" hundred")))
    return F.concat_ws(" ", hundreds, F.when(n % 100 > 0, below_hundred(n % 100)))


def cardinal_words(n: Column) -> Column:
    """The words of a whole number from 0 to below 10^12."""
    n = n.cast("long")
    parts = []
    for size, name in _GROUPS:
        part = F.floor(n / size) % 1000
        parts.append(F.when(part > 0, F.concat(below_thousand(part), F.lit(f" {name}"))))
    return F.when(n == 0, "zero").otherwise(F.concat_ws(" ", *parts, F.when(n % 1000 > 0, below_thousand(n % 1000))))


def ordinal_words(n: Column) -> Column:
    words = cardinal_words(n)
    last = F.substring_index(words, " ", -1)
    return F.concat(F.left(words, F.length(words) - F.length(last)), look_up(_ORDINAL_OF, last))


def digit_words(digits: Column) -> Column:
    """The digits of a text, each by its word."""
    return F.array_join(F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d: look_up(_DIGIT, d)), " ")


def year_words(year: Column) -> Column:
    """A year from 1100 on in two halves."""
    rest = year % 100
    second = F.when(rest == 0, "hundred").when(rest < 10, F.concat(F.lit("oh "), _pick(_SMALL, rest))).otherwise(below_hundred(rest))
    return F.concat(below_hundred(F.floor(year / 100)), F.lit(" "), second)


def date_words(date: Column) -> Column:
    return F.concat_ws(" ", F.lower(F.date_format(date, "MMMM")), ordinal_words(F.dayofmonth(date)), year_words(F.year(date)))


def time_words(ts: Column) -> Column:
    """Hour, minutes and half of the day."""
    hour, minute = F.hour(ts), F.minute(ts)
    said = F.when(minute == 0, "").when(minute < 10, F.concat(F.lit(" oh "), _pick(_SMALL, minute))).otherwise(F.concat(F.lit(" "), below_hundred(minute)))
    return F.concat(cardinal_words((hour + 11) % 12 + 1), said, F.when(hour < 12, " a m").otherwise(" p m"))
