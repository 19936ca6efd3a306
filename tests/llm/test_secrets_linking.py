"""Linking of weak parts against the definition, for parts of any length at all alignments."""

from quillspark.llm import secrets


def test_linked_at_all_alignments(spark):
    rows, want = [], set()
    for start in range(300, 600):
        for length in (4, 20, 300, 700):
            for gap in (0, 299, 300, 301):
                for after in (True, False):
                    end = start + length
                    a = end + gap if after else start - gap - 10
                    if a < 0:
                        continue
                    key = f"{start}:{length}:{gap}:{after}"
                    rows.append((key, [("secret", start, end, True), ("endpoint", a, a + 10, True)]))
                    if gap <= 300:
                        want.add((key, start, 4, end))
    schema = "key string, parts array<struct<part: string, start: bigint, end: bigint, weak: boolean>>"
    found = secrets.linked(spark.createDataFrame(rows, schema)).collect()
    assert {(r.key, x.start, x.rank, x.end) for r in found for x in r.added} == want
