"""English number words as numbers, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import among, let, look_up, one_of, only, words

# Number words.
UNITS = dict(zip("one two three four five six seven eight nine".split(), range(1, 10)))
TEENS = dict(zip("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(10, 20)))
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))
SCALES = {
    "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12, "quadrillion": 10**15,
    "quintillion": 10**18, "sextillion": 10**21, "lakh": 10**5, "crore": 10**7,
}
SMALL = {"zero": 0} | UNITS | TEENS | TENS
DIGITS = {"zero": "0", "o": "0", "oh": "0"} | {w: str(n) for w, n in UNITS.items()}
#: A word that is a number by itself, as text.
ALONE = {w: str(n) for w, n in (SMALL | {"hundred": 100} | SCALES).items()}
ALONE_DIGITS = ALONE | DIGITS

HUNDREDS = one_of([w for w in TEENS if w != "ten"] + list(TENS)) + " hundred"
NUMBER = f"^{one_of([*ALONE, 'and', 'a'])}(?: {one_of([*ALONE, 'and', 'a'])})*$"
DECIMAL = "decimal(38,0)"


def _table(entries: dict[str, int]) -> str:
    """SQL for a map of texts, which the optimizer makes one literal."""
    return "str_to_map('{}', ',', ':')".format(",".join(f"{w}:{n}" for w, n in entries.items()))


def _in(options) -> str:
    return "({})".format(", ".join(f"'{w}'" for w in options))


#: SQL for a lambda function from a text to the number that its words say. It is one text, and not columns, as the
#: taggers use it in many places: Spark reads it in a moment, where putting it together from columns takes far longer.
#: Small numbers add up; hundred multiplies what has come; a larger scale closes a group.
_KERNEL = rf"""
said -> transform(array(array_join(filter(split(lower(said), r'(?U)\s+'), w -> w NOT IN ('', 'and', 'a')), ' ')), s ->
  CASE WHEN s RLIKE r'{NUMBER}' THEN
    transform(array(regexp_extract(s, r'^((?:{HUNDREDS}(?: |$))*)', 1)), lead ->
      try_add(
        aggregate(filter(split(lead, ' '), w -> w NOT IN ('', 'hundred')), CAST(0 AS DECIMAL(38, 0)), (sum, w) -> CAST(sum + CAST(try_element_at({_table(SMALL)}, w) AS INT) * 100 AS DECIMAL(38, 0))),
        aggregate(filter(split(substr(s, length(lead) + 1), ' '), w -> w <> ''), named_struct('done', CAST(0 AS DECIMAL(38, 0)), 'now', CAST(0 AS DECIMAL(38, 0))), (state, w) ->
          CASE WHEN w = 'hundred' THEN named_struct('done', state.done, 'now', CAST(try_multiply(IF(state.now = 0, CAST(1 AS DECIMAL(38, 0)), state.now), 100BD) AS DECIMAL(38, 0)))
               WHEN w IN {_in(SCALES)} THEN named_struct('done', CAST(try_add(state.done, CAST(try_multiply(IF(state.now = 0, CAST(1 AS DECIMAL(38, 0)), state.now),
                 CAST(try_element_at({_table(SCALES)}, w) AS DECIMAL(38, 0))) AS DECIMAL(38, 0))) AS DECIMAL(38, 0)), 'now', CAST(0 AS DECIMAL(38, 0)))
               ELSE named_struct('done', state.done, 'now', CAST(state.now + CAST(try_element_at({_table(SMALL)}, w) AS INT) AS DECIMAL(38, 0))) END,
          state -> CAST(try_add(state.done, state.now) AS DECIMAL(38, 0)))))[0]
  END)[0]
"""


def number(value: Column) -> Column:
    """The number that words say, as decimal(38,0); null if one is no number word or it is too large.

    "and" and "a" are passed over. Leading pairs such as "eleven hundred" stand for themselves, and what
    follows is added."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(_KERNEL)), 1).cast(DECIMAL)


def single(value: Column) -> Column:
    """The number that one word says."""
    return look_up(ALONE, value).cast(DECIMAL)


def spelled(value: Column, table: dict[str, str]) -> Column:
    """The texts of all words put together; null if a word is not in the table."""
    return let(words(value), lambda ws: only(F.forall(ws, lambda w: among(w, *table)), F.array_join(F.transform(ws, lambda w: look_up(table, w)), "")))


def digits(value: Column) -> Column:
    """Digits after a decimal point: any single number words; null for none."""
    return let(spelled(value, ALONE_DIGITS), lambda d: only(d != "", d))


def strict_digits(value: Column) -> Column:
    """Digits after a decimal point, each a word; may be none."""
    return spelled(value, DIGITS)
