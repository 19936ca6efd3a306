"""Rules as tables: in sentences, as a log of changes, as versions in time, and under a stream."""

import datetime
import random
import time

from pyspark.sql import functions as F

from quillspark.api import RuleSet, normalize_by_versions, normalize_sentence, rule_versions, rules_in_force, write_sentences_with_rules
from quillspark.operators.rules import rules_within

PAIRS = [("Gee Pee", "GP"), ("five", "V"), ("may fifth and", "MF"), (" padded ", "no"), ("two  blanks", "no"), ("blue", "blue"), ("empty", ""), ("doctor", "DOC"), ("İx", "IX"), ("a b c d", "ABCD")]
WORDS = "gee pee five may fifth and padded two blanks blue empty doctor İx i̇x a b c d twenty dollars hash green period".split()


def test_rule_table_gives_what_the_same_rules_in_the_plan_give(spark):
    rng = random.Random(8)
    rows = [(i, "  ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9)))) for i in range(120)] + [(-1, None), (-2, ""), (-3, "Gee\tPEE five"), (-3, "Gee\tPEE five")]
    df = spark.createDataFrame(rows, "id int, s string").withColumn("__key", F.lit("k")).withColumn("found", F.lit(1))
    rules = spark.createDataFrame([*PAIRS, ("FIVE", "A")], "spoken string, written string")  # the greater written one counts
    for most in (16, 2, 0):
        want = df.select("id", normalize_sentence("s", most, RuleSet.of(PAIRS)).alias("w")).collect()
        got = write_sentences_with_rules(df, "s", rules, "w", most)
        assert got.columns == ["id", "s", "__key", "found", "w"]
        assert sorted((r.id, str(r.w)) for r in got.collect()) == sorted((r.id, str(r.w)) for r in want)
    assert write_sentences_with_rules(df, "s", rules.limit(0), "w").where("id = -3").first().w == "Gee PEE 5"


def test_rule_table_does_not_grow_the_plan(spark):
    df = spark.createDataFrame([("see lot 7 now",)], "s string")
    sizes = []
    for n in (10, 5000):
        rules = spark.range(n).select(F.concat(F.lit("lot "), F.col("id").cast("string")).alias("spoken"), F.concat(F.lit("#"), F.col("id").cast("string")).alias("written"))
        out = write_sentences_with_rules(df, "s", rules)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        assert out.first().written == "see #7 now"
    assert abs(sizes[0] - sizes[1]) < 200


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_not_shuffled_once_a_run(spark):
    rng = random.Random(3)
    texts = [" ".join(f"lot {rng.randrange(10**6)} w{rng.randrange(10**9)}" for _ in range(700)) for _ in range(4)]
    df = spark.createDataFrame([(t,) for t in texts], "s string").repartition(2)
    said = sorted({" ".join(r) for t in texts for r in zip(t.split()[::3], t.split()[1::3])})
    rules = spark.createDataFrame([(r, f"#{r}") for r in said[::2]], "spoken string, written string")
    before, limit = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [dict(r.found) for r in rules_within(df, "s", rules, 16, few=0).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert shuffled(spark) - before < 20 * sum(map(len, texts))
    want = [{r: f"#{r}" for r in said[::2] if r in {" ".join(p) for p in zip(t.split()[::3], t.split()[1::3])}} for t in texts]
    assert {frozenset(g.items()) for g in got} == {frozenset(w.items()) for w in want}
    assert {frozenset(r.found.items()) for r in rules_within(df, "s", rules, 16).collect()} == {frozenset(g.items()) for g in got}


def test_own_rules_part_a_sentence_at_their_words(spark):
    rows = [("we saw Lot 7 twenty five of  lot 8 in may fifth",), ("lot seven dot com lot 7",), ("five lot 7 five",), ("lot",), (" lot\t7 ",), (None,)]
    df = spark.createDataFrame(rows * 2, "s string")
    pairs = [("Lot 7", "#7"), ("lot 8", "#8 x"), ("saw", "SAW"), ("of", "OF"), ("7 twenty", "no")]
    got = write_sentences_with_rules(df, "s", spark.createDataFrame(pairs, "spoken string, written string"), "w")
    assert not got.where(~F.col("w").eqNullSafe(normalize_sentence("s", rules=RuleSet.of(pairs), by_runs=False))).collect()
    assert got.count() == 12 and got.where("s like 'five%'").first().w == "5 #7 5"


def folded(changes, until=None):
    """The rules after the changes, one by one."""
    rules = RuleSet()
    for seq, op, spoken, written in sorted(changes):
        if until is not None and seq > until:
            break
        if op == "clear":
            rules = rules.clear()
        elif spoken is not None:
            rules = rules.add(spoken, written) if op == "add" else rules.remove(spoken)[0]
    return dict(rules.rules)


def made(n, seed, clears=3):
    rng = random.Random(seed)
    changes = [(i, rng.choice(["add", "add", "remove"]), rng.choice(["Van xa", "van Xa", "b", "c c", "d", None]), f"w{i}") for i in range(n)]
    for i in rng.sample(range(n), clears):
        changes[i] = (i, "clear", None, None)
    return changes


LOG = "seq long, op string, spoken string, written string"


def test_log_of_changes(spark):
    for seed, clears in ((1, 3), (2, 0), (3, 1)):
        changes = made(60, seed, clears)
        log = spark.createDataFrame(changes, LOG).repartition(3)
        assert {r.spoken: r.written for r in rules_in_force(log).collect()} == folded(changes)
        versions = rule_versions(log).collect()
        for at in range(-1, 61):
            assert {r.spoken: r.written for r in versions if r.since <= at and (r.until is None or at < r.until)} == folded(changes, at)
    empty = spark.createDataFrame([], LOG)
    assert rules_in_force(empty).isEmpty() and rule_versions(empty).isEmpty()


def test_clears_by_slices_and_in_order_give_the_same(spark):
    changes = made(300, 6, 60)
    log = spark.createDataFrame(changes, LOG).repartition(3)
    got = [sorted(map(tuple, rule_versions(log, few).collect())) for few in (200_000, 0)]
    assert got[0] == got[1]
    for at in range(-1, 301, 7):
        assert {spoken: written for spoken, written, since, until in got[1] if since <= at and (until is None or at < until)} == folded(changes, at)
    moment = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i)
    want = [(a, b, moment(c), d if d is None else moment(d)) for a, b, c, d in got[0]]
    times = spark.createDataFrame([(moment(i), *x) for i, *x in changes], LOG.replace("long", "timestamp_ntz"))
    names = spark.createDataFrame([(f"{i:04}", *x) for i, *x in changes], LOG.replace("long", "string"))
    assert sorted(map(str, map(tuple, rule_versions(times).collect()))) == sorted(map(str, want))
    assert sorted(map(str, map(tuple, rule_versions(names).collect()))) == sorted(str((a, b, f"{c:04}", d if d is None else f"{d:04}")) for a, b, c, d in got[0])


def test_time_does_not_grow_with_the_square_of_clears(spark):
    n, key = 200_000, F.col("id")
    log = spark.range(n).select(key.alias("seq"), F.when(key % 2 == 1, "clear").otherwise("add").alias("op"), F.when(key % 2 == 0, F.concat(F.lit("u"), key % 1000)).alias("spoken"), F.lit("w").alias("written"))
    began = time.time()
    assert tuple(rule_versions(log).agg(F.count("*"), F.count_if(F.col("until") == F.col("since") + 1)).first()) == (n / 2, n / 2)
    assert time.time() - began < 40  # 7 s when written


def test_versions_met_in_batches(spark):
    versions = spark.createDataFrame([("a", "A1", 2, 5), ("a", "A2", 7, None), ("b", "B", 3, 4), (None, "no", 0, None)], "spoken string, written string, since long, until long")
    rows = [(at, s, "x") for at in (None, 1, 2, 4, 5, 6, 7, 9) for s in ("a", " A ", "b", "five", None)] * 2
    df = spark.createDataFrame(rows, "at int, s string, Written string")
    got = normalize_by_versions(df, "s", "at", versions)
    in_force = lambda at, s: next((w for k, w, a, b in (("a", "A1", 2, 5), ("a", "A2", 7, 99), ("b", "B", 3, 4)) if at is not None and k == s and a <= at < b), None)
    want = [(at, s, s and (in_force(at, s.strip().lower()) or ("5" if s == "five" else s.strip()))) for at, s, _ in rows]
    assert got.columns == ["at", "s", "written"] and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_rules_that_change_under_a_stream(spark, tmp_path):
    """Rows are written by the rules of their own time, in two runs with a change between, or in one."""
    early, late = made(30, 4, 1), [(i + 30, *x) for i, *x in made(30, 5, 1)]
    said = lambda a, b: [(i, ["Van Xa", " b ", "c c", "five", "d", None][i % 6]) for i in range(a, b)]
    versions = lambda changes: rule_versions(spark.createDataFrame(changes, LOG))
    schema = "at long, s string"

    def run(changes, state, out):
        rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        written = normalize_by_versions(rows, "s", "at", versions(changes))
        stream = written.writeStream.format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start()
        assert stream.awaitTermination(180)
        return sorted(map(str, spark.read.parquet(str(tmp_path / out)).collect()))

    spark.createDataFrame(said(0, 30), schema).write.parquet(str(tmp_path / "in"))
    first = run(early, "state", "out")
    spark.createDataFrame(said(30, 60), schema).write.mode("append").parquet(str(tmp_path / "in"))
    both = run(early + late, "state", "out")
    assert run(early + late, "state", "out") == both and set(first) < set(both)  # nothing new: nothing changes
    assert run(early + late, "fresh", "other") == both  # all at once gives the same
    whole = spark.createDataFrame(said(0, 60), schema)
    assert sorted(map(str, normalize_by_versions(whole, "s", "at", versions(early + late)).collect())) == both
    for at, s, w in [(r.at, r.s, r.written) for r in spark.read.parquet(str(tmp_path / "out")).collect()]:
        rules = folded(early + late, at)
        assert w == (None if s is None else rules.get(s.strip().lower(), "5" if s == "five" else s.strip()))
