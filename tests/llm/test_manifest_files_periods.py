"""The manifest, the token files and the periodic runs against plain Python, on odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from quillspark.llm import idfiles, merkle, packing, periods

rng = random.Random(12)
WORDS = "alpha Béta gamma of the 日本 x1 word. Ω <|endoftext|> it's 3,000 a b".split(" ")
NAMES = "tree key digest place total path root block items salt hash ids shard start runs text_ collapsed number".split()


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", " \n\t ", "one", "x " * 500, "a b c " * 90, *(prose(rng.randrange(1, 80)) for _ in range(150)), prose(3000), "ab" * 40_000]
    rows = [(i * 7 % 997, t, ["en", "de", None, "fr", "Ω"][i % 5] if i != 9 else "lone", ["a", None, "c"][i % 3], len(t or "") if i % 4 else None, *NAMES) for i, t in enumerate(texts)]
    rows += [(None, "none", "en", "a", 4, *NAMES), (None, "none", "en", "a", 4, *NAMES), (None, None, None, None, None, *NAMES), rows[20], rows[21], (rows[22][0], "other", *rows[22][2:])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES)).repartition(3)


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    made = [nodes]
    while len(made[-1]) > 1:
        made.append([sha(*made[-1][i : i + 2]) for i in range(0, len(made[-1]), 2)])
    return made


def manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: sha(*map(said, (r.doc_id, r.source, r.lang, n, r.text)))
    langs = {}
    for r in rows:
        langs.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: levels([v[2] for v in sorted(langs[x], key=lambda v: v[:3])]) for x in order}
    top = levels([own[x][-1][0] for x in order])
    for k, x in enumerate(order):
        for i, (_, _, digest, r) in enumerate(sorted(langs[x], key=lambda v: v[:3])):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            now, proof = leaf(r, r.n_chars + 1) if tampered else digest, ""
            for made, at in ((own[x], i), (top, k)):
                for nodes in made[:-1]:
                    beside = nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
                    now, proof, at = sha(beside + now if at % 2 else now + beside), proof + beside, at // 2
            yield r.doc_id, digest, own[x][-1][0], top[-1][0], sha(proof), now, now == top[-1][0]


def test_manifest(spark, docs):
    want = sorted(manifest(docs.collect()), key=repr)
    for block, top in ((1024, 4096), (4, 8), (2, 3)):  # one level of blocks; several; more trees than come to the driver
        assert listed(merkle.report(docs, block, top)) == want
    assert {r[-1] for r in want} == {True, False}
    lone = docs.where("doc_id = 7")
    assert listed(merkle.report(lone)) == list(manifest(lone.collect())) and merkle.report(docs.limit(0)).count() == 0


def test_manifest_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    assert sorted(con.execute(merkle.SQL).fetchall(), key=repr) == sorted(manifest(docs.collect()), key=repr)


def test_codes():
    r = np.random.default_rng(0)
    for n, limit in ((1, 18), (2, 18), (5, 3), (300, 9), (300, 18), (5000, 13)):
        counts = np.zeros(n + 7, np.int64)
        counts[r.choice(n + 7, n, replace=False)] = np.maximum(1, 1e6 / np.arange(1, n + 1) ** 1.3)
        lengths = idfiles.code_lengths(counts, limit)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= limit and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
        heap, cost = [int(x) for x in counts if x], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            heapq.heappush(heap, made := heapq.heappop(heap) + heapq.heappop(heap))
            cost += made
        total = int((lengths * counts).sum())
        assert total >= cost and (limit < 18 or n == 1 or total == cost)  # without the limit's force it is Huffman's
        codes, _ = idfiles.canonical(lengths)
        table = idfiles.decoder(lengths, limit)
        for size in (0, 1, 127, 128, 129, 3000):
            ids = r.choice(np.flatnonzero(counts), size).astype(np.uint32)
            bits, points = idfiles.encoded(ids, codes, lengths)
            said = "".join(format(codes[i], f"0{lengths[i]}b") for i in ids)
            assert bits == bytes(int(said[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(said), 8))
            many = np.minimum(idfiles.POINT, size - idfiles.POINT * np.arange(len(points)))
            assert (idfiles.decoded(np.frombuffer(bits, np.uint8), points, many, table, limit) == ids).all()


def test_token_files(spark, docs, tmp_path, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = tokenizers.Tokenizer.from_file(path)
    ids = {t: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in {r.text or "" for r in docs.collect()}}
    for n, (block, points) in enumerate(((1 << 16, idfiles.LANES), (40, 2))):
        monkeypatch.setattr(idfiles, "LANES", points)  # long documents are decoded in several steps
        folder = str(tmp_path / f"ids{n}")
        got = idfiles.report(docs, path, folder, block=block).collect()
        whole = {(r.doc_id, r.start): r.ids for r in idfiles.read_ids(spark, folder).collect()}
        assert len(got) == docs.count() == len(whole)
        at, last = 0, None
        left = sorted(((r.doc_id is not None, r.doc_id or 0), ids[r.text or ""]) for r in docs.collect())
        for r in sorted(got, key=lambda r: r.start):
            key = (r.doc_id is not None, r.doc_id or 0)
            own = whole[r.doc_id, r.start]
            assert r.start == at and (last is None or key >= last) and (key, own) in left
            left.remove((key, own))
            assert (r.n_tokens, r.ids_crc32) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
            at, last = at + r.n_tokens, key
        assert not left
    assert idfiles.report(docs.limit(0), path).count() == 0
    assert packing.encode(path, [b""])[1].tolist() == [0]


def runs(x):
    """All runs by the definition, as (start, length, period)."""
    out, spans = [], set()
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i < len(x) - q:
            j = i
            while j < len(x) - q and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q) and (i, j + q) not in spans:
                out.append((i, j - i + q, q))
                spans.add((i, j + q))
            i = max(j, i + 1)
    return sorted(out)


@pytest.mark.parametrize("reach", [16, 256])
def test_runs(monkeypatch, reach):
    monkeypatch.setattr(periods, "REACH", reach)
    some = 0
    for _ in range(60):
        texts = []
        for _ in range(6):
            n, k = rng.choice([0, 5, 12, 30, 100, 300, 700]), rng.choice([1, 2, 3, 10, 200])
            x = [rng.randrange(k) for _ in range(n)]
            for _ in range(rng.randrange(4)):
                if n > 20:
                    a, e = rng.randrange(n), rng.randrange(n)
                    p = rng.randrange(1, max(2, (n - a) // 2 + 1))
                    for i in range(a, e):
                        x[i] = x[a + (i - a) % p]
            texts.append(np.array(x, np.int64))
        got = periods.runs_of(texts)
        assert [[tuple(map(int, r)) for r in own] for own in got] == [runs(x.tolist()) for x in texts]
        some += sum(map(len, got))
    assert some > 200


def test_long_texts_have_all_runs():
    x = np.random.default_rng(3).integers(0, 5000, 60_000)
    x[1000:31_000] = x[1000 + np.arange(30_000) % 9000]  # a period longer than most pieces
    x[40_000:40_050] = 7
    x[50_000:50_400] = x[50_000 + np.arange(400) % 130]
    got = [tuple(map(int, r)) for r in periods.runs_of([x])[0]]
    assert [r[2] for r in got] == [9000, 1, 130] and got == sorted(got)
    for start, length, q in got:
        own = x[start : start + length]
        assert (own[q:] == own[:-q]).all() and x[start - 1] != x[start - 1 + q] and x[start + length] != x[start + length - q]


def test_periodic_runs(docs):
    want = []
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        own = runs(w)
        gone = {i for s, length, q in own for i in range(s + q, s + length)}
        best = min(own, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in own)
        shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((r.doc_id, len(own), *shown, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert listed(periods.report(docs)) == sorted(want, key=repr) and any(r[1] for r in want)
    whole = periods.collapse(docs.withColumn("runs", F.lit("k")), names=("runs_", "left"))
    assert whole.columns == [*docs.columns, "runs_", "left"] and whole.count() == docs.count()
    assert periods.report(docs.limit(0)).count() == 0
