"""Near copies against plain Python: every pair of texts, by the Jaccard similarity of five-word shingles."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import common, nearcopies


def groups(rows):
    """Rows that stay, by brute force, as (doc_id, text)."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if 5 * o >= 4 * (len(sets[i]) + len(sets[j]) - o) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    of = dict(zip(texts, root))
    return len(set(root)), {of[t or ""]: min((d for d, u in rows if of[u or ""] == of[t or ""] and d is not None), default=None) for _, t in rows}


def made():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    said = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(said(rng.randint(0, 60))) for _ in range(60)]
    for n in (30, 60, 90, 150):  # copies with 1 to 6 words altered: on both sides of 0.8, far beyond 3 bits
        for altered in range(1, 7):
            base = said(n)
            copy = list(base)
            for at in rng.sample(range(n), altered):
                copy[at] = "other"
            texts += [" ".join(base), " ".join(copy)]
    common_part = said(12)  # a passage of many, so that its shingles are crowded
    texts += [" ".join(said(10) + common_part + said(10)) for _ in range(40)]
    chain = said(120)  # near copies of near copies
    for k in range(40):
        chain = chain[1:] + [f"c{k}"]
        texts.append(" ".join(chain))
    texts += ["", " ", None, "one", "One", "a b c d", "A  b c d"]
    return [(i, t) for i, t in enumerate(texts)] + [(999, texts[0]), (None, texts[70])]


@pytest.mark.parametrize("crowd", [2, 32])
def test_near_copies(spark, crowd):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    count, want = groups(rows)
    got = nearcopies.one_of_each(df, crowd=crowd).collect()
    assert len(got) == count and sorted(r.doc_id for r in got) == sorted(want.values())


def test_stage(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    edited = [(10**6 + d, " ".join(t.split()[:-2] + ["edited"])) for d, t in rows if t and 60 < len(t.split()) < 200]
    more = docs.limit(0).select("doc_id", "text").union(spark.createDataFrame(edited, "doc_id long, text string"))
    df = docs.select("doc_id", "text").union(more).withColumn("kept", F.lit(1))
    count, want = groups(rows + edited)
    got = corpus_pipeline.drop_near_copies(spark, df, "/root/testdata/sf0.001").collect()
    assert edited and len(got) == count and sorted(r.doc_id for r in got) == sorted(want.values())


def test_clashing_columns(spark):
    """Columns that are called as the operator's own are passed on, and equal rows count as one."""
    names = "h i stays ident hashed tokens fp n bins key root mark a b at token clash count".split()
    rows = [(d, t, *(f"{c}{d}" for c in names)) for d, t in ((1, "one two three four five six"), (2, "one two three four five six"), (3, "other words"), (None, None))]
    df = spark.createDataFrame(rows + rows[2:3], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = sorted(map(tuple, nearcopies.one_of_each(df).collect()), key=repr)
    assert got == sorted((rows[0], rows[2], rows[3]), key=repr)
