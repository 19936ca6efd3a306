"""Dates, years, quarters and decades; results are texts, as no calendar is involved."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import after, among, before, drop_begin, first, let, look_up, one_of, only, put, tail, trimmed, words
from ..functions.numbers import TEENS, TENS, number
from .counts import ordinal

# Months, quarters, decades, centuries.
MONTHS = "january february march april may june july august september october november december".split()
QUARTERS = {"first": "Q1", "second": "Q2", "third": "Q3", "fourth": "Q4"}
DECADES = {"twenties": "20", "thirties": "30", "forties": "40", "fifties": "50", "sixties": "60", "seventies": "70", "eighties": "80", "nineties": "90"}
CENTURIES = {w: str(n) for w, n in TEENS.items()} | {"twenty": "20", "twenty one": "21"}
LATE_TEENS = {w: n for w, n in TEENS.items() if n > 10}
YEAR_STARTS = LATE_TEENS | {"twenty": 20}
BIG = "decimal(38,0)"


def _text(n: Column) -> Column:
    return n.cast("string")


def year_number(value: Column) -> Column:
    """A year of two halves, of thousands, or a number of three or four digits."""

    def thousands(v: Column) -> Column:
        two = v.startswith("two")
        rest = trimmed(F.substr(v, F.lit(13)))
        rest = F.when(two, trimmed(drop_begin(rest, "and "))).otherwise(rest)
        return let(rest, lambda r: (F.when(r == "", F.lit(0)).otherwise(number(r)) + F.when(two, 2000).otherwise(1000)).cast(BIG))

    def halves(ws: Column, spelled: Column) -> Column:
        rest = let(tail(ws, 1), lambda r: number(F.when(spelled, F.regexp_replace(r, "^(?:oh|o) ", "")).otherwise(r)))
        return let(rest, lambda n: only(spelled | n.between(0, 99), (n + look_up(YEAR_STARTS, ws[0]) * 100).cast(BIG)))

    def of(v: Column, ws: Column) -> Column:
        century = (F.size(ws) >= 2) & among(F.try_element_at(ws, F.lit(1)), *YEAR_STARTS)
        # "oh five" behind a century decides, even if no number follows
        spelled = (F.size(ws) >= 3) & among(F.try_element_at(ws, F.lit(2)), "oh", "o")
        bare = let(number(v), lambda n: only(n.between(100, 9999) & ~(century & spelled), n))
        return F.when(v.rlike("^(?:two|one) thousand"), thousands(v)).when(F.size(ws) > 0, first(only(century, halves(ws, spelled)), bare))

    return let(value, lambda v: let(words(v), lambda ws: of(v, ws)))


def _with_year(original: Column, low: Column) -> Column:
    """A quarter of a year, a day of a month, or a year alone: what comes before the year, and the year.

    Their beginnings exclude each other, so the year is read in one place."""
    quarter = f"(?s)^({'|'.join(QUARTERS)}) quarter of (.*)$"
    part = lambda ahead, year: F.struct(ahead.alias("ahead"), year.alias("year"))
    rest = F.substr(low, F.lit(5))

    def of_month(ws: Column) -> Column:
        as_written = F.try_element_at(F.filter(words(original), lambda w: F.lower(w) == ws[0]), F.lit(1))
        ahead = put(_day(before(rest, " of ")), " ", first(as_written, ws[0]), F.when(F.size(ws) == 1, "").otherwise(" "))
        return only(among(F.try_element_at(ws, F.lit(1)), *MONTHS), part(ahead, F.when(F.size(ws) > 1, tail(ws, 1))))

    teen, tens, late, starts = (one_of(list(x)) for x in (TEENS, TENS, LATE_TEENS, YEAR_STARTS))
    alone = rf"(?U)^(?:(?:two|one) thousand|(?:twenty\s+{teen}|{late}\s+(?:{teen}|{tens}))$|{starts}\s+\S+\s+\S)"
    found = (
        F.when(low.rlike(quarter), part(put(look_up(QUARTERS, F.regexp_extract(low, quarter, 1)), " "), F.regexp_extract(low, quarter, 2)))
        .when(low.startswith("the ") & rest.contains(" of "), let(words(after(rest, " of ")), of_month))
        .when(low.rlike(alone), part(F.lit(""), low))
    )
    return let(found, lambda f: put(f["ahead"], F.when(f["ahead"].isNotNull() & f["year"].isNull(), "").otherwise(_text(year_number(f["year"])))))


def _era(low: Column) -> Column:
    """A year before or after Christ."""

    def old(head: Column) -> Column:
        pair = lambda ws: let(number(ws[0]), lambda c: let(number(tail(ws, 1)), lambda y: only(c.between(1, 99) & y.between(0, 99), (c * 100 + y).cast(BIG))))
        return let(words(head), lambda ws: only(F.size(ws) >= 2, pair(ws)))

    pattern = " (b c|bc|a d|ad)$"
    head = F.regexp_replace(low, pattern, "")
    return only(low.rlike(pattern), put(_text(first(old(head), number(head))), F.upper(F.replace(F.regexp_extract(low, pattern, 1), F.lit(" "), F.lit("")))))


def _decade(low: Column) -> Column:
    pattern = f"({'|'.join(DECADES)})$"
    of = lambda head, d: F.when(head == "", put(d, "s")).otherwise(put(look_up(CENTURIES, head), d, "s"))
    return only(low.rlike(pattern), let(trimmed(F.regexp_replace(low, pattern, "")), lambda h: of(h, look_up(DECADES, F.regexp_extract(low, pattern, 1)))))


def _day(value: Column) -> Column:
    return F.regexp_replace(ordinal(value), "[^0-9]", "")


def _month_first(original: Column, low: Column) -> Column:
    """A month with a year, a day, or both, in that order of preference."""

    def of(ws: Column, month: Column) -> Column:
        n = F.size(ws)

        def way(words_of_day: Column, plain: bool, rest: int) -> Column:
            return only(n >= rest, F.struct(words_of_day.alias("day"), F.lit(plain).alias("plain"), (n == rest).alias("last"), tail(ws, rest).alias("year")))

        days = [way(F.array_join(F.slice(ws, 2, k - 1), " "), False, k) for k in (2, 3, 4)]
        ways = F.array(way(F.lit(""), True, 1), *days, way(F.try_element_at(ws, F.lit(2)), True, 2))

        def written(c: Column) -> Column:
            plain = let(number(c["day"]), lambda d: only(d.between(1, 31), put(" ", _text(d))))
            day = F.when(c["day"] == "", "").when(c["plain"], plain).otherwise(put(" ", _day(c["day"])))
            return put(month, day, F.when(c["last"], "").otherwise(put(" ", _text(year_number(c["year"])))))

        return F.try_element_at(F.filter(F.transform(ways, written), lambda x: x.isNotNull()), F.lit(1))

    return let(words(low), lambda ws: only((F.size(ws) >= 2) & among(F.try_element_at(ws, F.lit(1)), *MONTHS), of(ws, words(original)[0])))


GUARD = f"quarter of| of |{one_of(MONTHS)}|ies$| (?:b c|bc|a d|ad)$|thousand|{one_of(list(YEAR_STARTS))}"


def date(value: Column) -> Column:
    def of(original: Column, low: Column) -> Column:
        ways = first(_era(low), _decade(low), _with_year(original, low), _month_first(original, low))
        return only(low.rlike(GUARD), ways)

    return let(trimmed(value), lambda o: let(F.lower(o), lambda low: of(o, low)))


