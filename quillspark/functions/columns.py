"""Small column helpers that the taggers are built from."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)^\s+|\s+$"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


def text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, BLANK, "")


def words(value: Column) -> Column:
    return F.filter(F.split(value, r"(?U)\s+"), lambda w: w != "")


def joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def tail(parts: Column, start: int) -> Column:
    """The words from place start (from 0) on, joined."""
    return joined(F.slice(parts, text(start) + 1, F.greatest(F.size(parts) - start, F.lit(0))))


@lru_cache(maxsize=None)
def _literal(kind: str, content: tuple) -> Column:
    """A table as a foldable expression of a few nodes, which the optimizer turns into one literal."""
    if kind == "map":
        return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in content)), F.lit("\x01"), F.lit("\x02"))
    return F.split(F.lit("\x01".join(content)), "\x01")


def look_up(table: Mapping[str, object], key: Column) -> Column:
    """The table's entry for a text: an int or a string, null for other texts."""
    found = F.try_element_at(_literal("map", tuple(table.items())), key)
    return found.cast("int") if all(isinstance(v, int) for v in table.values()) else found


def among(value: Column, *options: str) -> Column:
    return F.array_contains(_literal("set", tuple(options)), value)


def drop_end(value: Column, suffix: str) -> Column:
    """value without the suffix, as often as it stands at the end."""
    return F.regexp_replace(value, f"(?:{suffix})+$", "")


def drop_begin(value: Column, prefix: str) -> Column:
    return F.regexp_replace(value, f"^(?:{prefix})+", "")


def without(value: Column, n: int) -> Column:
    """value without its last n characters."""
    return F.left(value, F.length(value) - n)


def before(value: Column, mark: str) -> Column:
    return F.substring_index(value, mark, 1)


def after(value: Column, mark: str) -> Column:
    """What follows the first mark."""
    return F.substr(value, F.locate(mark, value) + len(mark))


def pad2(number: Column) -> Column:
    return let(number.cast("string"), lambda s: F.when(F.length(s) < 2, F.lpad(s, 2, "0")).otherwise(s))


def put(*parts) -> Column:
    """The parts put together; null if one is."""
    return F.concat(*[text(p) for p in parts])


def first(*choices: Column) -> Column:
    return F.coalesce(*choices)


def only(condition: Column, value: Column) -> Column:
    """value where the condition holds, else null."""
    return F.when(condition, value)


PLAIN = re.compile(r"[\w '%°²³]+").fullmatch


def one_of(options: Sequence[str]) -> str:
    """A pattern for any of the options. Plain words are put together by their beginnings, longest first, so that a
    place in a text is given up after its first letters instead of being tried for one word after another."""
    if not all(map(PLAIN, options)):
        return "(?:" + "|".join(options) + ")"

    def tree(endings: set[str]) -> str:
        by: dict[str, set[str]] = {}
        for e in endings - {""}:
            by.setdefault(e[0], set()).add(e[1:])
        made = [re.escape(c) + tree(rest) for c, rest in sorted(by.items())]
        return "" if not made else "(?:" + "|".join(made) + ")" + "?" * ("" in endings)

    return tree(set(options))
