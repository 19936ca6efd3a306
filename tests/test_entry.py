"""The driver's contract: names, oracles, and that the library works without the corpus operators."""

import os
import subprocess
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_oracles_belong_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(name in entry.oracle_sql() for name in entry.queries() if name.startswith("itn_"))


@pytest.mark.parametrize("name", ["itn_cardinal", "itn_money_scale", "itn_measure", "itn_date", "itn_time", "itn_ip_address", "itn_electronic", "itn_punctuation", "itn_sentence_mixed"])
def test_query_equals_oracle(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values))
    assert rows(got) == rows(want)


def test_works_without_corpus_operators(tmp_path):
    """A copy without the subpackage and the pipeline still imports and has the other queries."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    count, has = said.stdout.split()[-2:]
    assert int(count) > 20 and has == "False"
