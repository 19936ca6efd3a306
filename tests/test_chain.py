"""Chains with users' taggers, the table of spans, and sentences written from it."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.api import TAGGERS, normalize, normalize_sentence
from quillspark.plans.chain import Chain, Tagger, span_report, write_by_spans
from quillspark.sources.pairs import write_pairs

WORDS = "five twenty dollars and cents may first two thirty p m period hash doctor dot com at a green the kilometers per hour point o one hundred thousand lot b".split()
LOT = Tagger("lot", lambda x: F.when(x.rlike("^lot [a-z]$"), F.upper(x)), trigger=" lot [a-z] ")
FIVE = Tagger("mine", lambda x: F.when(x == "five", "V"), trigger=" five ")


def test_orders():
    chain = Chain()
    assert {t.name for t in chain.whole} == set(TAGGERS) and [t.name for t in chain.spans][-1] == "cardinal"
    longer = chain.add(LOT, before="time").add(FIVE, spans=False)
    assert [t.name for t in longer.whole].index("lot") == [t.name for t in longer.whole].index("time") - 1
    assert longer.whole[-1].name == "mine" and "mine" not in [t.name for t in longer.spans] and len(chain.whole) == 12
    assert longer.without("lot").without("mine") == chain
    for wrong in (lambda: longer.add(LOT), lambda: chain.add(LOT, before="none"), lambda: chain.add(Tagger("x", F.upper))):
        with pytest.raises(ValueError):
            wrong()


def test_precedence(spark):
    df = spark.createDataFrame([("five",), (" five dollars ",), ("lot b",), ("green",), (None,), ("",)], "s string")
    before, last = Chain().add(FIVE, before="cardinal"), Chain().add(FIVE)
    rows = df.select("s", before.tag("s").alias("b"), last.tag("s").alias("l"), before.normalize("s").alias("n"), Chain().normalize("s").alias("plain"), normalize("s").alias("want")).collect()
    assert [(r.b and tuple(r.b), r.l and tuple(r.l), r.n) for r in rows] == [
        (("mine", "V"), ("cardinal", "5"), "V"), (("money", "$5"), ("money", "$5"), "$5"), (None, None, "lot b"), (None, None, "green"), (None, None, None), (None, None, ""),
    ]
    assert all(r.plain == r.want for r in rows)


def test_spans_give_what_rows_give(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 16)))) for i in range(60)]
    rows += [(-1, None), (-2, ""), (-3, "  "), (-4, "five"), (-4, "five"), (-5, "see\tTwenty  five  hash"), (-6, "green " * 3000 + "five " + "hash blue " * 500)]
    df = spark.createDataFrame(rows, "id int, s string").withColumns({c: F.lit("k") for c in ("key", "hits", "row", "parts", "open", "at")})
    want = sorted((r.id, str(r.w)) for r in df.select("id", normalize_sentence("s", 5).alias("w")).collect())
    out = write_by_spans(df, "s", "w", max_span=5)
    assert out.columns == [*df.columns, "w"]
    assert sorted((r.id, str(r.w)) for r in out.collect()) == want
    spans = span_report(df, "s", ["id", "key"], max_span=5).collect()
    by_id, texts = {}, dict(rows)
    for r in spans:
        assert r.key == "k" and " ".join(texts[r.id].split()[r.start : r.end]) == r.span and 1 <= r.end - r.start <= 5
        by_id.setdefault(r.id, set()).add((r.start, r.end, r.written))
    for i, text in texts.items():  # the spans, put in their places, are the sentence
        ws, out_words, at = (text or "").split(), [], 0
        for start, end, written in sorted(by_id.get(i, ())):
            assert start >= at
            out_words += [*ws[at:start], written]
            at = end
        assert text is None or (i, " ".join(out_words + ws[at:])) in want
    assert sum(r.id == -4 for r in spans) == 2 and sum(r.id == -6 for r in spans) == 501


def test_empty_table_and_users_taggers(spark):
    df = spark.createDataFrame([("take lot b or five",), ("Lot b",)], "s string")
    chain = Chain().add(LOT, before="money").add(FIVE, before="whitelist")
    assert sorted(r.written for r in write_by_spans(df, "s", chain=chain).collect()) == ["Lot b", "take LOT B or V"]
    report = span_report(df, "s", ["s"], chain).select("start", "end", "tagger", "span", "written").collect()
    assert sorted(map(tuple, report)) == [(1, 3, "lot", "lot b", "LOT B"), (4, 5, "mine", "five", "V")]
    none = df.limit(0)
    assert write_by_spans(none, "s").isEmpty() and span_report(none, "s", ["s"]).isEmpty()


def test_pairs_that_no_line_can_hold(spark, tmp_path):
    for i, bad in enumerate(("a~b", "#a", "a\nb")):
        with pytest.raises(Exception, match="no line of a file of pairs"):
            write_pairs(spark.createDataFrame([(bad, "x")], "spoken string, written string"), str(tmp_path / f"bad{i}"))
