"""Sentences, rules, files of pairs and streams."""

import random
import re
import time

from pyspark.sql import functions as F

from quillspark.api import RuleSet, normalize, normalize_sentence, normalize_with_rules, normalized_view, with_written
from quillspark.functions.columns import one_of
from quillspark.plans.normalize import may_change, tag_span, write_sentences
from quillspark.sources.pairs import read_pairs

SENTENCES = [
    ("we met  on may fifth and paid five dollars", "we met on may 5 and paid $5"),
    ("doctor jones has twenty three cats", "dr. jones has twenty three cats"),
    ("see example dot org now", "seeexample.orgnow"),
    ("call nine one one", "call 11"),
    ("pears and five plums", "pears 5 plums"),
    ("one second please", "3rd please"),
    ("the commander left period", "the commander left ."),
    ("thirty six beats eleven", "36 beats 11"),
    ("Zero", "zero"),
    ("nothing here", "nothing here"),
    (" \t ", ""),
    ("", ""),
    (None, None),
]


def test_sentences(spark):
    df = spark.createDataFrame(SENTENCES, "said string, written string")
    assert not [tuple(r) for r in df.select("*", normalize_sentence("said").alias("got")).collect() if r.got != r.written]


def test_rules(spark):
    rules = RuleSet.of([("Gee Pee", "GP"), ("five", "V"), (" padded ", "no")])
    assert rules.count() == 3
    again = rules.add("GEE pee", "G.P.")
    assert again.count() == 3 and rules.rules["gee pee"] == "GP"
    fewer, there = again.remove("Five")
    assert there and fewer.remove("five") == (fewer, False) and fewer.clear().count() == 0
    df = spark.createDataFrame([("gee pee",), ("five",), ("padded",), ("six",)], "s string")
    assert [r[0] for r in df.select(normalize("s", rules)).collect()] == ["GP", "V", "padded", "6"]
    assert [r[0] for r in df.select(normalize_sentence(F.concat(F.lit("my "), "s"), rules=rules)).collect()] == ["my GP", "my V", "my padded", "my 6"]
    joined = normalize_with_rules(df, "s", rules.frame(spark), "out")
    assert {r.s: r.out for r in joined.collect()} == {"gee pee": "GP", "five": "V", "padded": "padded", "six": "6"}


def test_gate_misses_nothing(spark):
    """Every span that a tagger changes passes the gate."""
    words = "a and o oh point hash dot five onepst twothousand eighties hundredth x r t saint pm".split()
    spans = [(f"{a} {b}",) for a in words for b in words] + [(w,) for w in words]
    df = spark.createDataFrame(spans, "s string").repartition(4)
    gate = may_change(F.concat(F.lit(" "), F.col("s"), F.lit(" ")))
    size = F.size(F.split("s", " "))
    missed = df.select("s", gate.alias("gate"), tag_span(F.col("s"), size).alias("w")).where("not gate and w is not null and w != s").collect()
    assert not missed


def test_runs_and_batches_give_the_same(spark):
    """Runs of words that taggers read, written one by one or once for all rows, are what the whole sentence gives."""
    rng = random.Random(4)
    words = "five twenty hundred thousand and a the of to at sign point oh minus dollars cents kilograms per hour may fifth quarter past p m gmt e s t dot com slash https colon doctor period hash blue sold in morning eighties onepst thousandfive mgmt seven eleven".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(150)] + [(-1, None), (-2, "")]
    df = spark.createDataFrame(rows, "id long, s string").repartition(4)
    whole = {r.id: r.w for r in df.select("id", normalize_sentence("s", by_runs=False).alias("w")).collect()}
    assert {r.id: r.w for r in df.select("id", normalize_sentence("s").alias("w")).collect()} == whole
    assert {r.id: r.w for r in write_sentences(df, "s", "w").collect()} == whole


def test_patterns_of_words():
    words = ["ten", "teen", "t", "nine", "ninety", "o'clock", "a b", "a c"]
    assert all(re.fullmatch(one_of(words), w) for w in words) and not any(re.fullmatch(one_of(words), w) for w in ("te", "", "a", "ninet"))


def test_pairs_view_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "numbers.txt").write_text("# said~written\n\ntwenty two~22\nfive~~5\nno mark\n")
    pairs = read_pairs(spark, str(tmp_path / "in"))
    assert sorted((r.file, r.spoken, r.written) for r in pairs.collect()) == [("numbers.txt", "five", "~5"), ("numbers.txt", "twenty two", "22")]
    normalized_view(pairs, "spoken", "said", sentences=False)
    assert sorted(r[0] for r in spark.sql("SELECT written FROM said").collect()) == ["22", "5"]
    stream = with_written(spark.readStream.text(str(tmp_path / "in")), "value", sentences=False)
    run = stream.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    time.sleep(0.5)
    assert "22" not in {r.written for r in spark.table("streamed").collect()} and spark.table("streamed").count() == 5
