"""Rules that users add: a spoken text and what is written for it, before all other taggers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..functions.columns import joined, look_up, only, text, trimmed, words


@dataclass(frozen=True)
class RuleSet:
    """An immutable set of rules. Adding or removing gives a new set, so jobs that run are not changed.

    Spoken texts are kept in lower case but not trimmed, so one with blanks around it never matches. They
    become part of the plan, which suits some thousands; for more there is ``normalize_with_rules``."""

    rules: Mapping[str, str] = field(default_factory=dict)

    def add(self, spoken: str, written: str) -> RuleSet:
        return RuleSet({**self.rules, spoken.lower(): written})

    def remove(self, spoken: str) -> tuple[RuleSet, bool]:
        """The set without the rule, and whether there was one."""
        low = spoken.lower()
        return RuleSet({k: v for k, v in self.rules.items() if k != low}), low in self.rules

    def clear(self) -> RuleSet:
        return RuleSet()

    def count(self) -> int:
        return len(self.rules)

    def tag(self, value: Column) -> Column:
        return look_up(self.rules, trimmed(F.lower(value))) if self.rules else F.lit(None).cast("string")

    def within(self, low: Column) -> Column:
        """Whether a text, in lower case, holds the spoken text of a rule anywhere."""
        found = F.lit(False)
        for spoken in self.rules:
            found = found | low.contains(spoken)
        return found

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rules.items()), "spoken string, written string")

    @staticmethod
    def of(pairs: Iterable[tuple[str, str]]) -> RuleSet:
        made = RuleSet()
        for spoken, written in pairs:
            made = made.add(spoken, written)
        return made


@dataclass(frozen=True)
class RowRules:
    """Rules that a column has for each row: a map of spoken texts to written ones, null for none."""

    found: Column

    def tag(self, value: Column) -> Column:
        return F.try_element_at(self.found, trimmed(F.lower(value)))

    def within(self, low: Column) -> Column:
        return F.coalesce(F.exists(F.map_keys(self.found), lambda spoken: low.contains(spoken)), F.lit(False))

    def words(self) -> Column:
        """All words of the row's rules."""
        return F.coalesce(F.array_distinct(F.flatten(F.transform(F.map_keys(self.found), lambda spoken: F.split(spoken, " ")))), F.array().cast("array<string>"))


def distinct_rules(rules: DataFrame) -> DataFrame:
    """(spoken, written): rules with spoken texts in lower case, of those for one text that with the greatest written one."""
    return rules.groupBy(F.lower("spoken").alias("spoken")).agg(F.max("written").alias("written"))


def text_key(value: Column) -> Column:
    """A number that stands for a text, null for null. Texts that share one have the rules of both, which changes nothing: ``RowRules``
    compares spoken texts themselves."""
    return only(value.isNotNull(), F.xxhash64(value))


def rules_within(texts: DataFrame, column: str, rules: DataFrame, most: int, few: int = 200_000) -> DataFrame:
    """(key, found): for the ``text_key`` of each text of a column in which rules apply, the map of these, for ``RowRules``.

    Runs of one to ``most`` words of a text, of the sizes that rules have, are joined with the rules by equality, so the
    plan does not grow with them; no text goes with its runs. Where rules begin with few different words, by a sketch, runs that begin with others
    are left out before. Up to ``few`` rules, counted, are broadcast; more are joined by an exchange."""
    own = rules.select(F.lower("spoken").alias("spoken"), "written").where(F.col("spoken") == joined(words(F.col("spoken"))))
    own = own.withColumns({"size": F.size(words(F.col("spoken"))), "first": F.substring_index("spoken", " ", 1)}).where(F.col("size").between(1, most))
    known = own.groupBy("size").agg(F.count("*").alias("n"), F.approx_count_distinct("first").alias("firsts")).collect()  # most rows at most
    said = texts.select(text_key(F.col(f"`{column}`")).alias("key"), words(F.lower(F.col(f"`{column}`"))).alias("ws")).where("key is not null")

    def runs(n: int) -> Column:
        run = lambda i: F.struct(text(n).alias("size"), F.get("ws", i).alias("first"), joined(F.slice("ws", i + 1, text(n))).alias("spoken"))
        return F.when(F.size("ws") >= n, F.transform(F.sequence(F.lit(0), F.size("ws") - n), run))

    none = F.array().cast("array<struct<size: int, first: string, spoken: string>>")
    every = F.array_distinct(F.flatten(F.array_compact(F.array(*[runs(n) for n in sorted(r.size for r in known)])))) if known else none
    pairs = said.select("key", F.inline(every))
    if sum(r.firsts for r in known) <= few:
        pairs = pairs.join(F.broadcast(own.select("size", "first").distinct()), ["size", "first"], "left_semi")
    own = distinct_rules(own)
    pairs = pairs.select("key", "spoken").join(F.broadcast(own) if sum(r.n for r in known) <= few else own, "spoken")
    return pairs.groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("spoken", "written"))).alias("found"))


# A log of changes to a set of rules: (seq, op, spoken, written) with a different seq in each row, and op one of
# add (which replaces), remove, and clear (of all rules; spoken is null).


def rules_in_force(log: DataFrame) -> DataFrame:
    """(spoken, written): the rules after all changes of a log. The last change of a spoken text counts, if it is not before
    the last clear; one grouped maximum, with partial sums, and one row that is broadcast."""
    changes = log.select("seq", "op", F.lower("spoken").alias("spoken"), "written")
    cleared = changes.where("op = 'clear'").agg(F.max("seq").alias("cleared")).withColumn("all", F.lit(1))
    last = changes.where("op in ('add', 'remove') and spoken is not null").groupBy("spoken").agg(F.max_by(F.struct("seq", "op", "written"), "seq").alias("last"))
    kept = last.withColumn("all", F.lit(1)).join(F.broadcast(cleared), "all", "left").where("last.op = 'add' and (cleared is null or last.seq > cleared)")
    return kept.select("spoken", "last.written")


def _slices(df: DataFrame, column: str, most: int = 256) -> tuple[int, Callable[[Column], Column]]:
    """A number of slices of a column's values, in order and of some equal size, and the slice (from 0) of a value."""
    ordered = isinstance(df.schema[column].dataType, (NumericType, DateType, TimestampType, TimestampNTZType))
    found = df.agg(F.percentile_approx(column, [k / most for k in range(1, most)])).first()[0] if ordered else None
    cuts = sorted(set(found or []))

    def of(value: Column, lower: int, upper: int) -> Column:
        middle = (lower + upper) // 2
        return F.lit(lower) if lower == upper else F.when(value < F.lit(cuts[middle]), of(value, lower, middle)).otherwise(of(value, middle + 1, upper))

    return len(cuts) + 1, lambda value: of(value, 0, len(cuts))


def _after(values: Column, value: Column) -> Column:
    """The first of sorted values, fewer than 4096, that is greater, by halving; null if there is none."""
    steps = F.array(*[F.lit(2**k) for k in range(11, -1, -1)])
    return F.get(values, F.aggregate(steps, F.lit(0), lambda i, s: F.when(F.get(values, i + s - 1) <= value, i + s).otherwise(i)))


def rule_versions(log: DataFrame, few: int = 200_000) -> DataFrame:
    """(spoken, written, since, until): each rule that a log adds, in force from its seq until, and not at, the next change of
    its spoken text or the next clear; until is null if there is none.

    Clears may be any number: each rule meets those of its own slice of the log, in order of seq, and of the later slices only the first.
    Up to ``few``, counted, are broadcast by slice; more are put in order with the rules of a slice. A spoken text's changes are put in
    order in one task."""
    changes = log.select("seq", "op", F.lower("spoken").alias("spoken"), "written")
    clears = changes.where("op = 'clear'").select(F.col("seq").alias("clear"))
    n_clears = clears.count()
    n, part = _slices(clears, "clear")
    near = n_clears <= min(few, 1000 * n)
    if not near:
        n, part = _slices(changes, "seq")
    following = F.lead("seq").over(Window.partitionBy("spoken").orderBy("seq"))
    own = changes.where("op in ('add', 'remove') and spoken is not null").select("seq", "spoken", (F.col("op") == "add").alias("add"), "written")
    each = own.withColumn("next", following).where("add").drop("add").withColumn("part", part(F.col("seq")))
    clears = clears.withColumn("part", part(F.col("clear")))
    firsts = clears.groupBy("part").agg(F.min("clear").alias("later")).withColumnRenamed("part", "behind")
    later = log.sparkSession.range(n).select(F.col("id").cast("int").alias("part")).join(F.broadcast(firsts), F.col("behind") > F.col("part"), "left").groupBy("part").agg(F.min("later").alias("later"))
    if near:
        inside = clears.groupBy("part").agg(F.array_sort(F.collect_list("clear")).alias("clears"))
        slices = later.join(inside, "part", "left").select("part", F.array_compact(F.array_append(F.coalesce("clears", F.array()), F.col("later"))).alias("clears"))
        met = each.join(F.broadcast(slices), "part", "left").withColumn("clear", _after(F.col("clears"), F.col("seq")))
    else:
        ahead = Window.partitionBy("part").orderBy(F.desc("seq"), F.asc_nulls_first("clear")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        both = each.unionByName(clears.withColumn("seq", F.col("clear")), allowMissingColumns=True).withColumn("clear", F.last("clear", ignorenulls=True).over(ahead))
        met = both.where("spoken is not null").join(F.broadcast(later), "part", "left").withColumn("clear", F.coalesce("clear", "later"))
    return met.select("spoken", "written", F.col("seq").alias("since"), F.least("next", "clear").alias("until"))
