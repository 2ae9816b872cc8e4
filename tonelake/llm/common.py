"""Shared-folder tables and small column helpers for the operators."""

from __future__ import annotations

import atexit
import gc
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session does not name one, a local session (tests) gets a folder
    of its own; a cluster session is refused, since a machine-local folder
    would not be visible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_tonelake_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="tonelake-")
        spark.sparkContext._tonelake_shared = own
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python functions that run inside get at most so many rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, batch_rows: int = 1000) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with batches_of(spark, batch_rows):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tonelake_path = path
    return back


def discard(df: DataFrame | None) -> None:
    """Delete a table that :func:`materialize` wrote and nothing reads any more."""
    path = getattr(df, "_tonelake_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def text_of(col: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows from a literal, made in the JVM alone; ``schema`` as ``name type, ...``."""
    names = [f.split()[0] for f in schema.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(':'.join(f.split()) for f in schema.split(','))}>>")))


def id_bounds(df: DataFrame, name: str, n: int, cells: int) -> list[float]:
    """At most ``cells - 1`` ascending bounds that part the ids of ``n`` rows about evenly.

    Quantiles of the distinct ids in a share of their hashes, about 64 a cell,
    so the same ids always give the same bounds.
    """
    if cells < 2:
        return []
    share = max(1, n // (64 * cells))
    ids = df.select(F.col(name).cast("long").alias("x")).where(F.col("x").isNotNull() & (F.pmod(F.xxhash64("x"), F.lit(share)) == 0)).distinct()
    seen = sorted({float(r["x"]) for r in ids.collect()})
    return sorted({seen[i * len(seen) // cells] for i in range(1, cells)} - {seen[0]}) if seen else []


def cell_of(df: DataFrame, name: str, bounds: list[float], out: str) -> DataFrame:
    """Adds ``out``: which of the spans between ``bounds`` an id lies in, from 0; null ids lie behind the last."""
    last = len(bounds) + 1
    if not bounds:
        return df.withColumn(out, F.when(F.col(name).isNull(), F.lit(last)).otherwise(F.lit(0)).cast("int"))
    from pyspark.ml.feature import Bucketizer

    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_at", outputCol="_cell")
    placed = cut.transform(df.withColumn("_at", F.coalesce(F.col(name).cast("double"), F.lit(0.0))))
    return placed.withColumn(out, F.when(F.col(name).isNull(), F.lit(last)).otherwise(F.col("_cell")).cast("int")).drop("_at", "_cell")


def hot_keys(sizes: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``(*keys, salts)`` of the keys of ``sizes (*keys, n)`` with more than ``most`` rows.

    A table, at most one row for ``most`` rows of the input, so Spark knows its
    size and broadcasts it only below its threshold.
    """
    hot = sizes.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("salts"))
    return materialize(hot, "hot-keys")


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """``rows`` with ``salt``: rows of a hot key are dealt over its salts by a hash of ``by``."""
    rows = rows.join(hot, keys, "left")
    return rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")), F.lit(0)).cast("int")).drop("salts")


def spread(table: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``salt``: the row of a hot key once for each of its salts, to join with :func:`salted` rows."""
    table = table.join(hot, keys, "left")
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
