"""Files of pairs: one spoken text and its written form a line."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pairs(spark: SparkSession, path: str, mark: str = "~") -> DataFrame:
    """(file, spoken, written) of lines ``spoken~written``, split at the first mark. Empty lines and lines that
    begin with # are passed over, as are those without a mark."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    at = F.locate(mark, F.col("value"))
    lines = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#") & (at > 0))
    return lines.select("file", F.left("value", at - 1).alias("spoken"), F.substr("value", at + len(mark)).alias("written"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a new one of this machine only where all of Spark runs on it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-pairs-")


def write_pairs(pairs: DataFrame, folder: str, mark: str = "~") -> str:
    """Writes (spoken, written) as files of pairs, and gives the folder. Pairs with a null are left out; texts that hold
    line breaks, or spoken ones that hold the mark or begin with #, could not be read again and end the job."""
    bad = F.col("spoken").contains(mark) | F.col("spoken").startswith("#") | F.concat("spoken", "written").rlike("[\\r\\n]")
    line = F.when(bad, F.raise_error(F.concat(F.lit("no line of a file of pairs: "), F.col("spoken")))).otherwise(F.concat("spoken", F.lit(mark), "written"))
    pairs.where("spoken is not null and written is not null").select(line.alias("value")).write.text(folder)
    return folder
