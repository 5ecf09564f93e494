"""A model, service or tool as a stage over a table: a callable per batch, with failures caught row by row and results kept.

``model(batch)`` takes a list of dictionaries of the input columns and gives a list of as many results, each a
dictionary of the declared fields or an exception. Equal inputs are asked once. A batch that raises, or gives a
list of another length, is tried again, then row by row; what still fails is that row's error, and so is a result
that lacks a field or has one of another type. Results go to ``store`` by a hash of version and input, in portions that are
committed one by one: a restart, or a lost executor, asks again only what was under way, and a further run over
more rows only what is new. Errors are kept too; ``again`` asks them once more.

Handling: null inputs are handed on as None; repeated rows get the same result; an empty table gives an empty
one, without a call; the columns ``result`` and ``error`` of the rows are an error, as results would hide them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources import shared, sinks

#: Rows of a call, calls of a task, and inputs of a portion that is committed at once.
BATCH, CALLS, PORTION = 32, 64, 1_000_000
#: Rows of one input that a task joins to its result; inputs with more are dealt out, and at most one in so many rows is such an input.
HOT = 200_000


def _tried(model: Callable, batch: list[dict], attempts: int) -> tuple[list, int]:
    """Results, or the last exception in their place, and how often the model was asked."""
    error, asked = None, 0
    for asked in range(1, attempts + 1):
        try:
            out = list(model(batch))
            if len(out) == len(batch):
                return out, asked
            error = ValueError(f"{len(out)} results for {len(batch)} rows")
        except Exception as e:  # noqa: BLE001: whatever a model raises is the rows' error
            error = e
    return [error] * len(batch), asked


def _fitting(result, schema: StructType) -> tuple[str | None, str | None]:
    """The result as JSON, or why it is none."""
    if isinstance(result, BaseException):
        return None, f"{type(result).__name__}: {result}"
    try:
        row = {f.name: result[f.name] for f in schema.fields}
        text = json.dumps(row, ensure_ascii=False, allow_nan=False)
        pa.array([row], to_arrow_type(schema), from_pandas=False)
        return text, None
    except Exception as e:  # noqa: BLE001: whatever is wrong with a result is the row's error
        return None, f"{type(e).__name__}: {e}"


def _asking(model: Callable, schema: StructType, attempts: int, size: int) -> Callable:
    def ask(batches: Iterator) -> Iterator:
        for arrow in batches:
            keys, inputs = arrow.column("key").to_pylist(), arrow.column("input").to_pylist()
            for at in range(0, len(keys), size):
                rows = [json.loads(x) for x in inputs[at:at + size]]
                results, tries = _tried(model, rows, attempts)
                if len(rows) > 1 and all(isinstance(r, BaseException) for r in results):
                    alone = [_tried(model, [r], attempts) for r in rows]
                    results, tries = [r[0] for r, _ in alone], tries + max(n for _, n in alone)
                fit = [_fitting(r, schema) for r in results]
                yield pa.RecordBatch.from_pydict(
                    {"key": keys[at:at + size], "value": pa.array([v for v, _ in fit], pa.string()), "error": pa.array([e for _, e in fit], pa.string()), "tries": pa.array([tries] * len(rows), pa.int32())}
                )

    return ask


def _kept(spark: SparkSession, store: str) -> DataFrame | None:
    """key, value, error: one row of each input that was asked, the success if there is one."""
    if not sinks.exists(spark, f"{store}/results"):
        return None
    rows = spark.read.schema("key string, value string, error string, tries int").parquet(f"{store}/results")
    return rows.groupBy("key").agg(F.min(F.struct(F.col("value").isNull().alias("bad"), "value", "error")).alias("r")).select("key", "r.value", "r.error")


def applied(rows: DataFrame, inputs: Sequence[str], model: Callable[[list[dict]], list], schema: str, store: str, version: str, attempts: int = 3, again: bool = False) -> DataFrame:
    """The rows with ``result``, a struct of ``schema``, and ``error``: null, or why there is no result.

    ``inputs`` are the columns that the model sees, as JSON holds them. ``store`` is a folder that all executors share.
    """
    spark, fields = rows.sparkSession, StructType.fromDDL(schema)
    if clash := {"result", "error"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"the rows have columns of the stage's own names: {sorted(clash)}")
    given = F.to_json(F.struct(*inputs), {"ignoreNullFields": "false"})
    key = F.sha2(F.concat_ws("\x1f", F.lit(version), given).cast("binary"), 256)
    counts = shared.saved(rows.select(key.alias("key"), given.alias("input")).groupBy("key").agg(F.count("*").alias("n"), F.any_value("input").alias("input")), "inputs")
    _ask(spark, counts, model, fields, store, attempts, again)
    kept = _kept(spark, store)
    if kept is None:
        kept = spark.createDataFrame([], "key string, value string, error string")
    # one input may hold a third of all rows: its rows are dealt out over copies of its result
    hot = counts.where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).cast("long").alias("copies"))
    copies = F.coalesce("copies", F.lit(1))
    dealt = rows.withColumn("_key", key).withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.join(F.broadcast(hot), F.col("_key") == F.col("key"), "left").withColumn("_copy", F.pmod("_row", copies)).drop("key", "copies", "_row")
    answers = kept.join(F.broadcast(hot), "key", "left").select(F.col("key").alias("_key"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("_copy"), F.from_json("value", fields).alias("result"), "error")
    return dealt.join(answers, ["_key", "_copy"], "left").select(*rows.columns, "result", "error")


def _ask(spark: SparkSession, counts: DataFrame, model: Callable, fields: StructType, store: str, attempts: int, again: bool) -> None:
    """Asks the model for every input without a result, portion by portion."""
    kept, todo = _kept(spark, store), counts.select("key", "input")
    if kept is not None:
        todo = todo.join(kept.where("error is null") if again else kept, "key", "left_anti")
    # a portion is a range of the hash, so that each is about as large and none needs a sort
    todo = shared.saved(todo.withColumn("at", F.conv(F.substring("key", 1, 8), 16, 10).cast("long")), "to-ask")
    n = todo.count()
    portions = -(-n // PORTION)
    for p in range(portions):
        low, high = (p << 32) // portions, ((p + 1) << 32) // portions
        part = todo.where((F.col("at") >= low) & (F.col("at") < high)).select("key", "input")
        tasks = max(1, -(-n // (portions * BATCH * CALLS)), min(n // BATCH, spark.sparkContext.defaultParallelism))
        answers = part.repartition(tasks, "key").mapInArrow(_asking(model, fields, attempts, BATCH), "key string, value string, error string, tries int")
        answers.write.mode("append").option("compression", "zstd").parquet(f"{store}/results")


def audited(samples: DataFrame, model: Callable[[list[dict]], list], store: str, version: str, original: str = "original_label", inputs: Sequence[str] = ("question", "original_label", "corrected_label"), **more) -> DataFrame:
    """The samples with approved, authoritative_label, reason, failed. A judge that fails doesn't hold up the rest: the sample is rejected, keeps its
    label, and the failure is the reason."""
    out = applied(samples, inputs, model, "approved boolean, authoritative_label string, reason string", store, version, **more)
    failed = F.col("error").isNotNull()
    pick = lambda field, other: F.when(failed, other).otherwise(F.col(f"result.{field}")).alias(field)
    return out.select(*samples.columns, pick("approved", F.lit(False)), pick("authoritative_label", F.col(original)), pick("reason", F.concat(F.lit("审核异常: "), "error")), failed.alias("failed"))

