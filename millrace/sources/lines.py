"""Lines of text files with their places, whatever way the files are split.

Two passes, without a sort or a shuffle of lines: the first counts the lines of each split and adds the counts up, the
second reads the lines again and puts each at its split's offset plus its place within the split.
A split's rows stand together in a partition, so that place is a difference of running numbers.

If the second pass splits the files otherwise than the first (as when the cluster has grown in between and
``spark.sql.files.minPartitionNum`` is unset), a line falls outside its split's count and the query fails; it never gets another number.

Handling: blank lines are left out and not counted; an empty folder gives no lines; files follow each other by path.
Compressed files are one split each. A file has one row in the tables of counts for each of its splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared


def numbered(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """seq (0, 1, ... over all files by path), file, line (0, 1, ... in the file; of lines that aren't blank, or with ``blank`` of all), value."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = (text if blank else text.where(F.col("value").rlike("\\S"))).withColumn("running", F.monotonically_increasing_id())
    splits = shared.saved(rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("running").alias("first")), "splits")
    in_file = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    by_file = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("file").agg(F.sum("n").alias("n")).select("file", F.coalesce(F.sum("n").over(by_file), F.lit(0)).alias("before"))
    offsets = splits.withColumn("offset", F.coalesce(F.sum("n").over(in_file), F.lit(0))).join(files, "file")
    at = F.col("running") - F.col("first")
    moved = F.raise_error(F.lit("files were split otherwise when they were read again"))
    placed = rows.join(shared.saved(offsets, "offsets"), ["file", "start"], "left").withColumn("at", F.when((at >= 0) & (at < F.col("n")), at).otherwise(moved.cast("long")))
    return placed.select((F.col("before") + F.col("offset") + F.col("at")).alias("seq"), "file", (F.col("offset") + F.col("at")).alias("line"), "value")


def records(spark: SparkSession, path: str, schema: str, n: int | None = None) -> DataFrame:
    """seq and the fields of the JSON lines, or of the first ``n`` (a limit that is the feature); a malformed line raises."""
    rows = numbered(spark, path)
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return (rows if n is None else rows.where(F.col("seq") < n)).select("seq", parsed.alias("r")).select("seq", "r.*")


def first_asked(rows: DataFrame, n: int, column: str = "question") -> DataFrame:
    """The first ``n`` of numbered records whose question isn't blank."""
    return rows.where(F.col(column).rlike("\\S")).orderBy("seq").limit(n)
