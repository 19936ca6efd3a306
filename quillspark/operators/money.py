"""Amounts of money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import after, among, before, drop_end, first, let, look_up, one_of, only, pad2, put, tail, trimmed, without, words
from ..functions.numbers import UNITS, number, strict_digits

SCALE = one_of(["trillion", "billion", "million"])
SEPARATORS = [" united states dollars and ", " dollar and ", " dollars and "]


def _said(n: Column) -> Column:
    return n.cast("string")


def _foreign(low: Column) -> Column:
    """Won, yen and yuan, which need a scale word."""

    def of(scale: Column, currency: Column) -> Column:
        head = F.regexp_replace(low, f"(?: {SCALE} (?:won|yen|yuan))+$", "")
        halves = F.split(head, " point ")
        exact = (currency == "yuan") & (F.size(halves) == 2)
        whole = _said(number(F.when(exact, halves[0]).otherwise(head)))
        sign = look_up({"won": "₩", "yen": "¥", "yuan": ""}, currency)
        return put(sign, whole, F.when(exact, put(".", strict_digits(F.try_element_at(halves, F.lit(2))))).otherwise(""), " ", scale, F.when(currency == "yuan", " yuan").otherwise(""))

    pattern = f" ({SCALE}) (won|yen|yuan)$"
    return only(low.rlike(pattern), let(F.regexp_extract(low, pattern, 1), lambda s: of(s, F.regexp_extract(low, pattern, 2))))


def _large(original: Column, low: Column) -> Column:
    """Millions and more of dollars: the scale word stays as it was written."""
    pattern = f" ({SCALE}) dollars$"

    def of(n: Column) -> Column:
        head = F.left(low, F.length(low) - 9 - n)
        scale = F.substr(original, F.length(original) - 7 - n, n)
        halves = F.split(head, " point ")
        exact = F.when(F.size(halves) == 1, "").when(F.size(halves) == 2, put(".", strict_digits(F.try_element_at(halves, F.lit(2)))))
        return put("$", _said(number(halves[0])), exact, " ", scale)

    return only(low.rlike(pattern), let(F.length(F.regexp_extract(low, pattern, 1)), of))


def _decimal(low: Column) -> Column:
    head = drop_end(low, " dollars")
    split = let(head, lambda h: let(before(h, " point "), lambda a: put("$", F.when(a == "", "").otherwise(_said(number(a))), ".", strict_digits(after(h, " point ")))))
    bare = put("$.", strict_digits(F.substr(without(low, 8), F.lit(7))))
    return only(low.endswith(" dollars"), F.when(low.contains(" point ") & head.contains(" point "), split).when(low.startswith("point "), bare))


def _with_cents(low: Column) -> Column:
    """The first separator that fits decides; without "cents", only 1 to 99 are cents."""
    part = lambda dollars, cents, sure: F.struct(dollars.alias("dollars"), cents.alias("cents"), F.lit(sure).alias("sure"))
    rest = after(low, " dollars ")
    of = lambda c, sure: part(before(low, " dollars "), c, sure)
    found = only(low.contains(" dollars "), F.when(rest.endswith(" cents"), of(drop_end(rest, " cents"), True)).otherwise(of(rest, False)))
    for mark in reversed(SEPARATORS):
        part_ = after(low, mark)
        fits = low.contains(mark) & part_.rlike(" cents?$")
        found = F.when(fits, part(before(low, mark), drop_end(drop_end(part_, " cents"), " cent"), True)).otherwise(found)
    written = lambda p: let(number(p["cents"]), lambda n: only(p["sure"] | n.between(1, 99), put("$", _said(number(p["dollars"])), ".", pad2(n))))
    return let(found, written)


def shorthand(value: Column) -> Column:
    """A number of dollars: "ninety nine hundred", "one fifty five", or any number."""

    def of(ws: Column) -> Column:
        hundreds = only((F.size(ws) >= 2) & (F.try_element_at(ws, F.lit(-1)) == "hundred"), number(F.array_join(F.slice(ws, 1, F.size(ws) - 1), " ")) * 100)
        rest = let(number(tail(ws, 1)), lambda n: only(n.between(10, 99), look_up(UNITS, ws[0]) * 100 + n))
        pair = only((F.size(ws) >= 2) & among(ws[0], *UNITS), rest)
        return first(hundreds.cast("decimal(38,0)"), pair.cast("decimal(38,0)"), number(value))

    return let(words(value), of)


def _dollars(low: Column) -> Column:
    return F.when(low == "one dollar", "$1").when(low.rlike(" dollars?$"), put("$", _said(shorthand(F.when(low.endswith("s"), drop_end(low, " dollars")).otherwise(drop_end(low, " dollar"))))))


def _cents(low: Column) -> Column:
    return F.when(low == "one cent", "$0.01").when(low.endswith(" cents"), put("$0.", pad2(number(drop_end(low, " cents")))))


def money(value: Column) -> Column:
    def of(original: Column, low: Column) -> Column:
        ways = first(_foreign(low), _large(original, low), _decimal(low), _with_cents(low), _dollars(low), _cents(low))
        return only(low.rlike("dollar|cent|won$|yen$|yuan$") & (low != "one dollars"), ways)

    return let(trimmed(value), lambda o: let(F.lower(o), lambda low: of(o, low)))
