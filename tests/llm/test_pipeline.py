"""The pipeline's stages on the smallest table, and on rows made to be odd."""

import re

import pytest
from pyspark.sql import functions as F
from test_nearcopies import groups

import corpus_pipeline
from quillspark.llm import common, mixing, secrets, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    docs = common.table(spark, SF, "documents").withColumn("copies", F.lit(1)).withColumn("score", F.lit("s"))
    more = [(None, None, None, None, None, 1, "s"), (None, None, None, None, None, 1, "s"), (10**6, "", "en", "x", 0, 1, "s"), (10**6, "", "en", "x", 0, 1, "s")]
    return docs.union(docs.limit(3)).union(spark.createDataFrame(more, docs.schema))


def sizes(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]


def test_stages(spark, odd):
    """Each stage on what the one before kept, against plain Python where its rule is not a model's."""
    labels = common.table(spark, SF, "labels")
    kept = common.cut(corpus_pipeline.drop_toxic(spark, odd, SF))
    assert kept.columns == odd.columns
    rejected = toxicity.score(odd, toxicity.fit(odd, labels), names=("a", "b")).where("b = 1").count()
    assert kept.count() == odd.count() - rejected
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean_ids = {r.doc_id for r in labels.where("toxic = 0").collect()} - toxic
    before, after = ({r.doc_id for r in df.collect()} for df in (odd, kept))
    assert len(clean_ids & before - after) <= 0.05 * len(clean_ids & before)  # recall is not told by the 11 toxic documents here; see test_toxicity

    one = common.cut(corpus_pipeline.drop_near_copies(spark, kept, SF))
    count, want = groups([(r.doc_id, r.text) for r in kept.collect()])
    assert one.columns == odd.columns and one.count() == count
    assert sorted((r.doc_id for r in one.collect()), key=repr) == sorted(want.values(), key=repr)

    clean = common.cut(corpus_pipeline.blot_out_secrets(spark, one, SF))
    assert clean.count() == one.count() and clean.columns == odd.columns
    spans = {r.doc_id: [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x] for r in secrets.report(one).collect()}
    own = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        text = own[r.doc_id]
        for a, b in reversed(merged(spans[r.doc_id])):
            text = text[:a] + "[SECRET]" + text[b:]
        assert r.text == text and r.n_chars == (None if text is None else len(text))

    mixed = common.cut(corpus_pipeline.mix_sources(spark, clean, SF))
    rows, taken = clean.collect(), mixed.collect()
    assert mixed.columns == odd.columns and {r.doc_id for r in taken} <= {r.doc_id for r in rows}
    for source in {r.source for r in rows}:
        words = sum(sizes([r for r in taken if r.source == source]))
        ((target,),) = mixing.mix_report(clean.where(F.col("source").eqNullSafe(F.lit(source)))).join(mixing.mix_report(clean).select("doc_id", F.col("target").alias("t")), "doc_id").select("t").distinct().collect() or [(0.0,)]
        most = max(sizes([r for r in rows if r.source == source]), default=0)
        assert abs(words - target) <= 3 * most

    packed = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    assert sum(r.piece == 0 for r in packed) == len(taken)
    at = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096 and len(at) <= sum(at.values()) / 4096 * 1.05 + 1


def merged(spans):
    """Spans put together as they are blotted out: one that begins inside another goes with it."""
    out = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def test_stages_on_empty_tables(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
