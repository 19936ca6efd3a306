"""The two ways to normalize: a whole value as one expression, and a sentence with spans in it.

Both are column expressions without Python workers: they run inside a projection, keep the row's other
columns and its partition, need no shuffle, and work on streams as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first, let, one_of, only, text, trimmed, words
from ..functions.numbers import ALONE, DIGITS
from ..operators.addresses import electronic
from ..operators.codes import telephone
from ..operators.counts import ORDINAL_SCALES, ORDINALS, cardinal, decimal, ordinal
from ..operators.dates import DECADES, MONTHS, date
from ..operators.measure import NAMED, SPOKEN, measure
from ..operators.money import money
from ..operators.rules import RowRules, RuleSet, distinct_rules, rules_within, text_key
from ..operators.terms import ANYWHERE, PUNCTUATION, WHOLE, punctuation, term, word
from ..operators.times import PERIODS, ZONES, time

MAX_SPAN = 16
NO_RULES = RuleSet()

#: Taggers in order of preference, after the user's rules.
WHOLE_ORDER = (term, punctuation, word, time, date, money, measure, decimal, telephone, electronic, ordinal, cardinal)
SPAN_ORDER = (term, punctuation, money, measure, date, time, electronic, decimal, ordinal)


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize(value: Column | str, rules: RuleSet = NO_RULES) -> Column:
    """The written form of a whole value; the trimmed value if it has none; null for null."""
    return let(trimmed(_column(value)), lambda x: first(rules.tag(x), *(tag(x) for tag in WHOLE_ORDER), x))


def normalize_with_lang(value: Column | str, lang: str, rules: RuleSet = NO_RULES) -> Column:
    """As ``normalize``; there is English only, whatever the language given."""
    return normalize(value, rules)


def tag_span(span: Column, size: Column, rules: RuleSet = NO_RULES) -> Column:
    """The written form of a span of a sentence, or null. Plain cardinals are of four words at most."""
    return first(rules.tag(span), *(tag(span) for tag in SPAN_ORDER), only(size <= 4, cardinal(span)))


# A span can only change if it holds one of these: number words, by themselves or with a scale, a decade or
# a zone written on to them, ordinals, decades, punctuation, "point o", spelled terms, " dot ", or a term.
_GLUED = ["thousand", "million", "billion", "trillion", *DECADES, "gmt", "est", "pst", "cst", "mst", "g", "e", "p", "c", "m"]
_TOKENS = one_of([*ALONE, *(w + e for w in ALONE for e in _GLUED), *ORDINALS, *ORDINAL_SCALES, *DECADES, *PUNCTUATION, "point o", "point oh", *WHOLE, "w w w"])
TRIGGER = f"(?: (?:{_TOKENS}|hundred[^ ]*) )|(?: dot )|{one_of(list(ANYWHERE))}"


def may_change(padded: Column, rules: RuleSet = NO_RULES) -> Column:
    """Whether text with a blank on either side holds anything that a tagger could change."""
    return F.lower(padded).rlike(TRIGGER) | rules.within(F.lower(padded))


# Words that a span which changes can hold, if it has no term, address or rule in it: every tagger but those reads
# all words of a span, so other words part a sentence into runs that have nothing to do with each other.
_BASE = [*ALONE, *DIGITS, "and", "a"]
_ZONES = ["gmt", "est", "pst", "cst", "mst", "g", "e", "p", "c", "m"]
_ENDS = ["thousand", "million", "billion", "trillion", *DECADES, *_ZONES]
_PARTS = "m am pm morning afternoon evening o'clock oclock"
_PHRASES = [
    *PUNCTUATION, *WHOLE, *NAMED, *SPOKEN, *ORDINALS, *ORDINAL_SCALES, *DECADES, *MONTHS, *ZONES, *PERIODS, "minus negative point",
    "dollar dollars cent cents won yen yuan united states", "per square cubic kilograms force centimeter", "quarter half past to of the in",
    "b c bc a d ad", "min mins minute minutes", "h t t p s http https w", _PARTS,
]
RUN_WORDS = {w for p in _PHRASES for w in p.split()} | {*_BASE} | {b + e for b in _BASE for e in _ENDS} | {b + z for b in _PARTS.split() for z in _ZONES}
#: Such a word, in any letter case; numbers may be glued to thousand and hundred.
RUN_WORD = f"(?iu)(?<![^ ])({one_of(list(RUN_WORDS))}|(?:thousand|hundred)[^ ]*+)(?![^ ])"


def runs(ws: Column, rules: RuleSet = NO_RULES) -> Column:
    """The words as an array of texts, which together are the sentence and can be written one by one: runs of words
    that taggers read, and what stands between them; one text if a term, an address or a rule may span anything. A row's
    own rules are known by their words, which are read as well."""
    flat = F.lower(F.array_join(ws, " "))
    whole = flat.rlike(one_of(list(ANYWHERE))) | flat.contains(" dot ") | flat.contains(" colon slash slash ")
    said = F.array_join(ws, " ")
    if isinstance(rules, RowRules):
        said = let(rules.words(), lambda own: F.array_join(F.transform(ws, lambda w: F.when(F.array_contains(own, F.lower(w)), F.concat(F.lit("\x01"), w, F.lit("\x01"))).otherwise(w)), " "))
    else:
        whole = whole | rules.within(flat)
    marked = F.replace(F.regexp_replace(said, RUN_WORD, "\x01$1\x01"), F.lit("\x01 \x01"), F.lit(" "))
    parts = F.split(marked, " ?\x01 ?")
    return F.when(whole, F.array(F.array_join(ws, " "))).otherwise(F.filter(parts, lambda p: p != ""))


def normalize_sentence(value: Column | str, max_span: int = MAX_SPAN, rules: RuleSet = NO_RULES, by_runs: bool = True) -> Column:
    """The sentence with its spans written: from the left, the longest span of at most max_span words that a
    tagger changes. Words are joined by one blank. A max_span of 0 counts as 1. Without by_runs, spans are looked
    for in the sentence as a whole, with the same result."""
    most = max(1, max_span)
    spaced = lambda part: F.concat(F.lit(" "), part, F.lit(" "))

    def longest(ws: Column, i: Column) -> Column:
        """(size, written) of the longest span from word i on that changes, else null."""
        none = F.lit(None).cast("struct<size: int, written: string>")

        def try_size(best: Column, n: Column) -> Column:
            span = F.array_join(F.slice(ws, i + 1, n), " ")
            tagged = let(span, lambda s: let(only(may_change(spaced(s), rules), tag_span(s, n, rules)), lambda w: only((trimmed(w) != "") & (trimmed(w) != s), w)))
            return F.when(best.isNotNull(), best).otherwise(let(tagged, lambda w: only(w.isNotNull(), F.struct(n.alias("size"), w.alias("written"))).cast("struct<size: int, written: string>")))

        def search(room: Column) -> Column:
            return F.aggregate(F.sequence(room, F.lit(1)), none, try_size)

        window = F.array_join(F.slice(ws, i + 1, F.lit(most)), " ")
        return only(may_change(spaced(window), rules), let(F.least(F.size(ws) - i, F.lit(most)), search))

    def emitted(ws: Column) -> Column:
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, i: Column) -> Column:
            def take(best: Column) -> Column:
                plain = F.struct((i + 1).alias("next"), F.array_append(s["out"], F.element_at(ws, i + 1)).alias("out"))
                return F.when(best.isNull(), plain).otherwise(F.struct((i + best["size"]).alias("next"), F.array_append(s["out"], best["written"]).alias("out")))

            return F.when(i < s["next"], s).otherwise(let(longest(ws, i), take))

        return F.aggregate(F.sequence(F.lit(0), F.size(ws) - 1), start, step, lambda s: F.array_join(s["out"], " "))

    def of(ws: Column) -> Column:
        write = lambda part: F.when(may_change(spaced(part), rules), let(F.split(part, " "), emitted)).otherwise(part)
        parts = runs(ws, rules) if by_runs else F.array(F.array_join(ws, " "))
        return F.when(F.size(ws) == 0, "").otherwise(F.array_join(F.transform(parts, write), " "))

    return let(words(_column(value)), lambda ws: only(ws.isNotNull(), of(ws)))


def write_sentences(df: DataFrame, column: str, output: str = "written", max_span: int = MAX_SPAN, rules: RuleSet = NO_RULES) -> DataFrame:
    """df with ``output``, what ``normalize_sentence`` makes of a column, for batches: each different run of words that may
    change is written once, wherever and however often it stands, and dealt to all tasks.

    Only rows with such a run are shuffled, by run and then by row; joins have plain exchanges on both sides, so a run
    that many rows share is split. A column of df with the name of the output gives way."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != output.lower()]
    gate = lambda part: may_change(F.concat(F.lit(" "), part, F.lit(" ")), rules)
    rows = df.select(F.struct(*kept).alias("row"), let(words(F.col(f"`{column}`")), lambda ws: only(ws.isNotNull(), runs(ws, rules))).alias("parts"))
    rows = rows.withColumn("open", F.coalesce(F.exists("parts", gate), F.lit(False)))
    said = rows.where("open").select(F.explode("parts").alias("part")).where(gate(F.col("part"))).distinct()
    known = said.select("part", normalize_sentence("part", max_span, rules, by_runs=False).alias("made"))
    each = rows.where("open").withColumn("id", F.monotonically_increasing_id()).select("id", "row", F.posexplode("parts").alias("at", "part"))
    each = each.withColumn("row", F.when(F.col("at") == 0, F.col("row"))).join(known, "part", "left")
    made = each.groupBy("id").agg(F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_list(F.struct("at", F.coalesce("made", "part").alias("text")))).alias("parts"))
    made = made.select("row.*", F.array_join(F.col("parts")["text"], " ").alias(output))
    return rows.where("not open").select("row.*", F.array_join("parts", " ").alias(output)).union(made)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is read in fewer partitions than there are: taggers take far longer than a row's
    exchange. A table of many files or row groups is left as it is, without an exchange."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def normalize_with_rules(df: DataFrame, column: str, rules: DataFrame, output: str) -> DataFrame:
    """df with ``output``, the written form of a column, by rules (spoken, written) that are a table.

    Spoken texts are compared in lower case; of rules for one text, the greatest written one counts. The
    table is joined by text, so it may be of any size."""
    own = distinct_rules(rules).toDF("__spoken", "__written")
    joined = df.withColumn("__spoken", trimmed(F.lower(df[column]))).join(own, "__spoken", "left")
    return joined.withColumn(output, F.coalesce("__written", normalize(column))).drop("__spoken", "__written")


def write_sentences_with_rules(df: DataFrame, column: str, rules: DataFrame, output: str = "written", max_span: int = MAX_SPAN) -> DataFrame:
    """df with ``output``, what ``normalize_sentence`` makes of a column by rules (spoken, written) that are a table of any
    size. As there, rules come before the taggers for a span, and the longest span from the left counts; rules
    of more than max_span words, or with other white space than one blank between words, are never met."""
    # by the key's hash: with the key itself, which groups are dealt by, Spark would not part a text of many rows
    found = rules_within(df, column, rules, max(1, max_span)).select(text_key(F.col("key")).alias("__said"), F.col("found").alias("__found"))
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != output.lower()]
    both = df.join(found, text_key(text_key(F.col(f"`{column}`"))) == F.col("__said"), "left")
    return both.select(*kept, normalize_sentence(F.col(f"`{column}`"), max_span, RowRules(F.col("__found"))).alias(output))


def normalize_by_versions(df: DataFrame, column: str, at: str, versions: DataFrame, output: str = "written") -> DataFrame:
    """df, batch or stream, with ``output``, the written form of a column by the rules in force at each row's own
    time: versions (spoken, written, since, until), as ``rule_versions`` makes them of a log, have one at most.

    In batches, rows and versions of a spoken text are put in order in one task, so that each row meets the version before it and no
    other. Rows of a stream are joined with all versions of their text."""
    own = versions.where("spoken is not null").select(*(F.col(c).alias(f"__{c}") for c in ("spoken", "written", "since", "until")))
    kept = [c for c in df.columns if c.lower() != output.lower()]
    key, time_of = trimmed(F.lower(F.col(f"`{column}`"))), F.col(f"`{at}`")
    if df.isStreaming:
        valid = (time_of >= F.col("__since")) & (F.col("__until").isNull() | (time_of < F.col("__until")))
        both = df.withColumn("__key", key).join(own, (F.col("__key") == F.col("__spoken")) & valid, "left")
        return both.select(*(F.col(f"`{c}`") for c in kept), F.coalesce("__written", normalize(F.col(f"`{column}`"))).alias(output))
    # rows without a text meet no version, and are dealt by their time
    rows = df.select(key.alias("key"), time_of.alias("at"), F.lit(1).alias("kind"), F.when(key.isNull(), F.xxhash64(time_of) % 1024).alias("deal"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    rules = own.select(F.col("__spoken").alias("key"), F.col("__since").alias("at"), F.lit(0).alias("kind"), F.struct("__written", "__until").alias("rule"))
    before = Window.partitionBy("key", "deal").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.unionByName(rules, allowMissingColumns=True).withColumn("rule", F.last("rule", ignorenulls=True).over(before)).where("kind = 1")
    valid = F.col("rule.__until").isNull() | (F.col("at") < F.col("rule.__until"))
    return met.select(*(F.col("row")[c].alias(c) for c in kept), F.coalesce(only(valid, F.col("rule.__written")), normalize(F.col("row")[column])).alias(output))


__all__ = ["RowRules", "RuleSet", "may_change", "normalize", "normalize_by_versions", "normalize_sentence", "normalize_with_lang", "normalize_with_rules", "spread", "tag_span", "text", "write_sentences", "write_sentences_with_rules"]
