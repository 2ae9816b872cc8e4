"""Counts of imports, batch and streaming, against the tables they made."""

import time

from pyspark.sql import functions as F

from tonelake.sources import files, progress

TUNE = "X:1\nL:1/8\nK:C\n"
ROWS = [("a.abc", TUNE + "CDE"), ("b.abc", TUNE + "G"), ("c.mid", "no midi"), ("d.abc", TUNE), ("e.pdf", "%PDF")]


def as_files(spark, rows):
    return spark.createDataFrame([(p, bytearray(t.encode())) for p, t in rows], "path string, content binary")


def test_counts_of_an_import(spark):
    table, seen = progress.imported(files.parsed(as_files(spark, ROWS).repartition(3)))
    t = files.tables(table)
    assert (seen["files"], seen["failures"], seen["scores"]) == (5, table.where("error is not null").count(), t["scores"].count()) == (5, 2, 3)
    assert (seen["tracks"], seen["notes"]) == (t["tracks"].count(), t["notes"].count()) and seen["notes"] == 4
    assert seen["warnings"] == sum(len(r["warnings"]) for r in t["scores"].collect()) > 0


def test_an_import_of_nothing(spark):
    table, seen = progress.imported(files.parsed(as_files(spark, [])))
    assert table.count() == 0 and seen == dict.fromkeys(progress.METRICS, 0)


def test_progress_of_a_stream(spark, tmp_path):
    for k in range(3):
        as_files(spark, [(f"{k}-{p}", t) for p, t in ROWS]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = progress.Progress()
    spark.streams.addListener(listener)
    try:
        found = files.parsed(spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")).observe("import", *progress.counts())
        stream = found.writeStream.queryName("tunes").format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        stream.awaitTermination()
        for _ in range(100):
            if listener.total.get("tunes", {}).get("files") == 15:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    out = spark.read.schema(found.schema).parquet(f"{tmp_path}/out")
    assert listener.total["tunes"]["files"] == out.count() == 15 and listener.total["tunes"]["notes"] == 12
    assert listener.total["tunes"]["failures"] == out.where(F.col("error").isNotNull()).count() == 6 and len([b for b in listener.batches if b[2]["files"]]) == 3
