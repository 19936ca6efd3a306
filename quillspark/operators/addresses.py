"""E-mail and web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import after, before, first, let, look_up, only, put, trimmed, words
from ..functions.numbers import DIGITS

# Protocols and signs as said.
PROTOCOLS = {
    "h t t p s colon slash slash ": "https://",
    "h t t p colon slash slash ": "http://",
    "https colon slash slash ": "https://",
    "http colon slash slash ": "http://",
    "w w w dot ": "www.",
}
DOMAIN_SIGNS = {"dot": ".", "slash": "/", "colon": ":", "hyphen": "-", "dash": "-"}
LOCAL_SIGNS = {"dot": ".", "underscore": "_", "dash": "-", "hyphen": "-"}


def domain(value: Column) -> Column:
    """Words put together, signs and digits written; a letter stays one, even o."""
    one = lambda w: first(look_up(DOMAIN_SIGNS | {k: v for k, v in DIGITS.items() if len(k) > 1}, w), w)
    return F.array_join(F.transform(words(value), one), "")


def _local(value: Column) -> Column:
    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        other = F.when(F.octet_length(w) == 1, w).otherwise(low)
        return F.when((low == "dot") & (i == 0), put(w, " ")).otherwise(first(look_up(LOCAL_SIGNS | DIGITS, low), other))

    return F.array_join(F.transform(words(value), one), "")


def _email(original: Column, low: Column) -> Column:
    ahead = F.when(original.contains(" at "), before(original, " at ")).otherwise(F.left(original, F.locate(" at ", low) - 1))
    return only(low.contains(" at ") & after(low, " at ").contains(" dot "), put(_local(ahead), "@", domain(after(low, " at "))))


def _url(low: Column) -> Column:
    found = F.lit(None).cast("string")
    for said, written in reversed(PROTOCOLS.items()):
        found = F.when(low.startswith(said), put(written, domain(F.substr(low, F.lit(len(said) + 1))))).otherwise(found)
    return found


def electronic(value: Column) -> Column:
    def of(original: Column, low: Column) -> Column:
        return first(_email(original, low), _url(low), let(only(low.contains(" dot "), domain(low)), lambda d: only(d.contains("."), d)))

    return let(trimmed(value), lambda o: let(F.lower(o), lambda low: of(o, low)))
