"""Files of pairs as a data source, in batches and as a stream; and published pairs, where a folder of them is given."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.api import normalize
from quillspark.sources.pairs import read_pairs
from quillspark.sources.pairs_source import register

FILES = {
    "count.txt": "# numbers\n\ntwenty one~21\r\nno mark\n~nothing said\nfive~V~5\nempty~",
    "count_cased.txt": "Twenty One~21\n",
    "late.txt": "zwölf~12\n" * 25_000,
    "void.txt": "",
    "_hidden.txt": "a~b\n",
}
ROWS = [("count", False, 3, "twenty one", "21"), ("count", False, 5, "", "nothing said"), ("count", False, 6, "five", "V~5"), ("count", False, 7, "empty", ""), ("count_", True, 1, "Twenty One", "21")]


def filled(folder, *names):
    folder.mkdir(exist_ok=True)
    for name in names:
        (folder / name).write_text(FILES[name], encoding="utf-8", newline="")
    return str(folder)


def test_batches(spark, tmp_path):
    register(spark)
    folder = filled(tmp_path / "in", *FILES)
    df = spark.read.format("spoken_pairs").load(folder)
    assert df.schema.simpleString() == "struct<category:string,cased:boolean,line_no:int,spoken:string,written:string>"
    small = sorted((r.category + "_" * r.cased, *r[1:]) for r in df.where("category <> 'late'").collect())
    assert small == sorted(ROWS)
    late = df.where("category = 'late'").agg(F.count("*"), F.countDistinct("line_no"), F.max("line_no"), F.min("spoken"), F.max("written")).first()
    assert tuple(late) == (25_000, 25_000, 25_000, "zwölf", "12")
    assert df.rdd.getNumPartitions() == 4  # a file each, the empty one too
    plain = read_pairs(spark, folder + "/count.txt").count()
    assert spark.read.format("spoken_pairs").load("file://" + folder + "/count.txt").count() == plain == 4
    assert spark.read.format("spoken_pairs").option("mark", "V").load(folder + "/count.txt").select("written").collect()[0].written == "~5"


def test_empty_folder_and_none(spark, tmp_path):
    register(spark)
    assert spark.read.format("spoken_pairs").load(filled(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="missing"):
        spark.read.format("spoken_pairs").load(str(tmp_path / "missing")).count()


def test_stream_reads_each_file_once(spark, tmp_path):
    register(spark)
    folder, out, state = filled(tmp_path / "in", "count.txt"), str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        rows = spark.readStream.format("spoken_pairs").load(folder)
        stream = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert stream.awaitTermination(120)
        return sorted((r.category + "_" * r.cased, *r[1:]) for r in spark.read.parquet(out).collect())

    assert run() == sorted(ROWS[:4])
    filled(tmp_path / "in", "count_cased.txt")
    assert run() == sorted(ROWS) and run() == sorted(ROWS)


@pytest.mark.skipif("PAIRS_DIR" not in os.environ, reason="PAIRS_DIR names no folder of published pairs")
def test_published_pairs(spark):
    register(spark)
    rows = spark.read.format("spoken_pairs").load(os.environ["PAIRS_DIR"]).repartition(8)
    right = rows.select("category", F.coalesce(normalize("spoken") == F.col("written"), F.lit(False)).alias("same"))
    made = {r.category: (r.same, r.n) for r in right.groupBy("category").agg(F.count_if("same").alias("same"), F.count("*").alias("n")).collect()}
    assert (sum(s for s, _ in made.values()), sum(n for _, n in made.values())) == (1200, 1217), made
