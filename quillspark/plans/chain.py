"""Chains of named taggers, to which users add their own, and sentences as a table of spans.

``normalize_sentence`` searches each row by itself, in one expression. Here the spans are rows: each different span of
a batch is tagged once, in one projection, wherever and however often it is said."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first, joined, let, only, trimmed, words
from ..operators.counts import cardinal
from .normalize import MAX_SPAN, NO_RULES, SPAN_ORDER, WHOLE_ORDER, may_change, runs

_NAMES = {"term": "whitelist"}


@dataclass(frozen=True)
class Tagger:
    """A name and a function from a text column to its written form, or null where it has none.

    ``trigger``, which a user's tagger needs for sentences, is a pattern that every text which it changes holds, in lower
    case and with a blank on either side. ``most``: spans of more words are not for it."""

    name: str
    tag: Callable[[Column], Column]
    trigger: str | None = None
    most: int | None = None


def _built_in(order: Sequence) -> tuple[Tagger, ...]:
    return tuple(Tagger(_NAMES.get(f.__name__, f.__name__), f) for f in order)


@dataclass(frozen=True)
class Chain:
    """Taggers for whole values and for spans of sentences, each in order of preference. Immutable, as ``RuleSet`` is."""

    whole: tuple[Tagger, ...] = _built_in(WHOLE_ORDER)
    spans: tuple[Tagger, ...] = (*_built_in(SPAN_ORDER), Tagger("cardinal", cardinal, most=4))

    def add(self, tagger: Tagger, before: str | None = None, whole: bool = True, spans: bool = True) -> Chain:
        """The chain with one more tagger, before the named one, or last, in either or both of the orders."""
        if spans and tagger.trigger is None:
            raise ValueError(f"tagger {tagger.name} needs a trigger to be used in sentences")

        def put(order: tuple[Tagger, ...]) -> tuple[Tagger, ...]:
            names = [t.name for t in order]
            if tagger.name in names:
                raise ValueError(f"there is a tagger {tagger.name} already")
            if before is not None and before not in names:
                raise ValueError(f"there is no tagger {before}")
            at = len(order) if before is None else names.index(before)
            return (*order[:at], tagger, *order[at:])

        return replace(self, whole=put(self.whole) if whole else self.whole, spans=put(self.spans) if spans else self.spans)

    def without(self, name: str) -> Chain:
        drop = lambda order: tuple(t for t in order if t.name != name)
        return Chain(drop(self.whole), drop(self.spans))

    def tag(self, value: Column | str) -> Column:
        """struct(tagger, written) of a whole value by the first tagger that has a form for it; null if none has."""
        value = F.col(value) if isinstance(value, str) else value
        return let(trimmed(value), lambda x: first(*(_named(t, t.tag(x)) for t in self.whole)))

    def normalize(self, value: Column | str) -> Column:
        """As ``normalize``, by this chain."""
        value = F.col(value) if isinstance(value, str) else value
        return let(trimmed(value), lambda x: first(*(t.tag(x) for t in self.whole), x))

    def within(self, low: Column) -> Column:
        """Whether a text, in lower case, holds what a user's tagger for spans looks for."""
        found = F.lit(False)
        for t in self.spans:
            if t.trigger is not None:
                found = found | F.concat(F.lit(" "), low, F.lit(" ")).rlike(t.trigger)
        return found


def _named(tagger: Tagger, written: Column) -> Column:
    return let(written, lambda w: only(w.isNotNull(), F.struct(F.lit(tagger.name).alias("tagger"), w.alias("written"))))


@dataclass(frozen=True)
class _Gate:
    """A chain in the place of rules, for ``may_change`` and ``runs``."""

    chain: Chain

    def within(self, low: Column) -> Column:
        return self.chain.within(low)


def _spaced(part: Column) -> Column:
    return F.concat(F.lit(" "), part, F.lit(" "))


def _key(part: Column) -> Column:
    return F.sha2(part, 256)


def _gate(chain: Chain):
    """Rules for ``may_change``: none at all if all taggers are built in, so the plan stays as small as it can be."""
    return _Gate(chain) if any(t.trigger is not None for t in chain.spans) else NO_RULES


def tagged_spans(parts: DataFrame, chain: Chain = Chain(), max_span: int = MAX_SPAN) -> DataFrame:
    """(key, hits): for each different text in the column ``part`` (words with one blank between) in which taggers change
    something, the SHA-256 of it and its hits in order: start and size in words, tagger, span, written, and ``free``,
    the end of the hit before. From the left, the longest span that a tagger changes is a hit.

    Windows that hold a trigger are cut out in a projection, so what is shuffled are spans of max_span words at most, never texts.
    One part's hits are put in order in one task."""
    most, rules = max(1, max_span), _gate(chain)

    def windows(ws: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.struct(i.alias("start"), F.slice(ws, i + 1, F.lit(most)).alias("ws")))
        return F.filter(cut, lambda w: may_change(_spaced(joined(w["ws"])), rules))

    def beginnings(ws: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(ws)), lambda n: F.struct(n.alias("size"), joined(F.slice(ws, F.lit(1), n)).alias("span")))
        return F.filter(cut, lambda s: may_change(_spaced(s["span"]), rules))

    # small tables would be read by one task, and taggers take far longer than an exchange
    tasks = max(parts.sparkSession.sparkContext.defaultParallelism, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    said = parts.where(F.col("part") != "").select("part").distinct().repartition(tasks)
    opened = said.select(_key(F.col("part")).alias("key"), F.explode(windows(F.split("part", " "))).alias("w"))
    each = opened.select("key", "w.start", F.explode(beginnings(F.col("w.ws"))).alias("s")).select("key", "start", "s.size", "s.span")
    spans = each.select("size", "span").distinct().repartition(tasks)
    limited = lambda t: t.tag(F.col("span")) if t.most is None else only(F.col("size") <= t.most, t.tag(F.col("span")))
    told = first(*(_named(t, limited(t)) for t in chain.spans))
    differs = lambda t: (trimmed(t["written"]) != "") & (trimmed(t["written"]) != F.col("span"))
    # a generator, since a filter would be pushed below the taggers and hold all of them once more
    changed = spans.select("span", F.inline(F.filter(F.array(told), differs)))
    longest = each.join(changed, "span").groupBy("key", "start").agg(F.max_by(F.struct("start", "size", "tagger", "span", "written"), "size").alias("hit"))
    ordered = longest.groupBy("key").agg(F.array_sort(F.collect_list("hit")).alias("hits"))

    hit_type = "struct<start: int, size: int, tagger: string, span: string, written: string, free: int>"
    start = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<{hit_type}>").alias("kept"))

    def step(s: Column, h: Column) -> Column:
        own = F.struct(h["start"].alias("start"), h["size"].alias("size"), h["tagger"].alias("tagger"), h["span"].alias("span"), h["written"].alias("written"), s["free"].alias("free"))
        taken = F.struct((h["start"] + h["size"]).alias("free"), F.array_append(s["kept"], own).alias("kept"))
        return F.when(h["start"] < s["free"], s).otherwise(taken)

    return ordered.select("key", F.aggregate("hits", start, step, lambda s: s["kept"]).alias("hits"))


def _parted(df: DataFrame, column: str, chain: Chain, carried: Column) -> tuple[DataFrame, Callable[[Column], Column]]:
    """df as (row, parts, open): the runs of a column's words, and whether any may change; and the test of one run."""
    rules = _gate(chain)
    test = lambda part: may_change(_spaced(part), rules)
    parts = let(words(F.col(f"`{column}`").cast("string")), lambda ws: only(ws.isNotNull(), runs(ws, rules)))
    rows = df.select(carried.alias("row"), parts.alias("parts"))
    return rows.withColumn("open", F.coalesce(F.exists("parts", test), F.lit(False))), test


def span_report(df: DataFrame, column: str, keep: Sequence[str], chain: Chain = Chain(), max_span: int = MAX_SPAN) -> DataFrame:
    """keep, start, end, tagger, span, written: one row for each span of a column's sentences that a tagger changes.

    Words are counted from 0, ends are exclusive. Null and empty texts, and those without a span that changes, have no rows; equal rows of df
    have their rows each. Rows that may change are shuffled by row, for the places of their runs, and by run."""
    rows, test = _parted(df, column, chain, F.struct(*(F.col(f"`{c}`") for c in keep)))
    said = rows.where("open").select(F.explode("parts").alias("part")).where(test(F.col("part")))
    known = tagged_spans(said, chain, max_span)
    each = rows.where("open").withColumn("id", F.monotonically_increasing_id()).select("id", "row", F.posexplode("parts").alias("at", "part"))
    each = each.select("id", "row", "at", F.size(F.split("part", " ")).alias("n"), only(test(F.col("part")), _key(F.col("part"))).alias("key"))
    earlier = F.sum("n").over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    placed = each.withColumn("first", F.coalesce(earlier, F.lit(0))).where("key is not null")
    hits = placed.join(known, "key").select("row", "first", F.explode("hits").alias("h"))
    at = (F.col("first") + F.col("h.start")).cast("long")
    return hits.select("row.*", at.alias("start"), (at + F.col("h.size")).alias("end"), "h.tagger", "h.span", "h.written")


def write_by_spans(df: DataFrame, column: str, output: str = "written", chain: Chain = Chain(), max_span: int = MAX_SPAN) -> DataFrame:
    """df with ``output``, what ``normalize_sentence`` makes of a column, by a chain, for batches: from the table of spans.

    Null stays null; a column of df with the name of the output gives way. Rows that cannot change are not shuffled."""
    rows, test = _parted(df, column, chain, F.struct(*(F.col(f"`{c}`") for c in df.columns if c.lower() != output.lower())))
    said = rows.where("open").select(F.explode("parts").alias("part")).where(test(F.col("part")))
    known = tagged_spans(said, chain, max_span)
    each = rows.where("open").withColumn("id", F.monotonically_increasing_id()).select("id", "row", F.posexplode("parts").alias("at", "part"))
    each = each.select("id", F.when(F.col("at") == 0, F.col("row")).alias("row"), "at", "part", only(test(F.col("part")), _key(F.col("part"))).alias("key")).join(known, "key", "left")

    def put_together(ws: Column) -> Column:
        between = F.flatten(F.transform("hits", lambda h: F.array(joined(F.slice(ws, h["free"] + 1, h["start"] - h["free"])), h["written"])))
        end = let(F.element_at("hits", -1), lambda h: h["start"] + h["size"])
        rest = let(end, lambda e: joined(F.slice(ws, e + 1, F.greatest(F.size(ws) - e, F.lit(0)))))
        return joined(F.filter(F.array_append(between, rest), lambda p: p != ""))

    made = F.when(F.col("hits").isNull(), F.col("part")).otherwise(let(F.split("part", " "), put_together))
    texts = each.select("id", "row", "at", made.alias("text")).groupBy("id").agg(F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    done = texts.select("row.*", joined(F.col("parts")["text"]).alias(output))
    return rows.where("not open").select("row.*", joined(F.col("parts")).alias(output)).union(done)
