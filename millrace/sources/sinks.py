"""Sinks and caches, on any Hadoop file system, through Spark's own writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of an audit record, with the two that transfers need.
AUDIT = ("event", "thread_id", "user_id", "risk_level", "node", "redacted", "redaction_count", "user_input", "draft", "action", "revised_answer", "reviewer", "final_answer", "comment", "from_department", "to_department")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_collection(rows: DataFrame, path: str, collection: str, clear: bool = False) -> None:
    """Adds (document, source and more) to a collection, ids from the content: what is there already isn't written again.
    ``clear`` replaces the collection alone."""
    spark = rows.sparkSession
    new = rows.withColumn("id", F.sha2(F.concat_ws("\x1f", F.lit(collection), F.coalesce("source", F.lit("")), "document").cast("binary"), 256)).dropDuplicates(["id"]).withColumn("collection", F.lit(collection))
    if not clear and exists(spark, f"{path}/collection={collection}"):
        new = new.join(spark.read.parquet(f"{path}/collection={collection}").select("id"), "id", "left_anti")
    new.drop("collection").write.mode("overwrite" if clear else "append").parquet(f"{path}/collection={collection}")


def append_lines(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON lines."""
    rows.write.mode("append").json(path)


def audit_records(rows: DataFrame, event: str, at: Column | None = None) -> DataFrame:
    """The rows as audit records: every column there is, nulls (and 0, false) for the others."""
    default = {"redacted": F.lit(False), "redaction_count": F.lit(0)}
    value = lambda c: F.lit(event) if c == "event" else F.col(c) if c in rows.columns else default.get(c, F.lit(None).cast("string"))
    return rows.select(F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), *(value(c).alias(c) for c in AUDIT))


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one JSON file of a folder."""
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def store_objects(rows: DataFrame, path: str) -> None:
    """A small table as one JSON array."""
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def preview(rows: DataFrame, n: int = 2) -> DataFrame:
    """A few parsed rows, without writing any (an operator whose purpose is the limit)."""
    return rows.limit(n)


def cached(spark: SparkSession, path: str, build: Callable[[], dict[str, DataFrame]], force: bool = False) -> dict[str, DataFrame]:
    """The tables of ``build`` (a graph's nodes and edges, say), from ``path`` if they were written there before, else built and written."""
    done = f"{path}/_TABLES"
    if force or not exists(spark, done):
        tables = build()
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        spark.createDataFrame([(n,) for n in tables], "name string").coalesce(1).write.mode("overwrite").parquet(done)
    return {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in spark.read.parquet(done).collect()}


def cached_vectors(names: DataFrame, path: str, embed: Callable[[Column], Column]) -> DataFrame:
    """name, vector of the distinct names, computed again only if the names have changed."""
    spark, names = names.sparkSession, names.select("name").distinct()
    now = names.agg(F.count("*").alias("n"), F.sum(F.xxhash64("name").cast("decimal(38,0)")).cast("string").alias("h"), F.bit_xor(F.xxhash64("name", F.lit(1))).alias("x")).first()
    return cached(spark, f"{path}/{now.n}-{now.h}-{now.x}", lambda: {"vectors": names.select("name", embed(F.col("name")).alias("vector"))})["vectors"]
