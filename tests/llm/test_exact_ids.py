"""Ids above 2**53 stay exact beside nulls, and columns of any type travel along."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import prose
from tonelake.llm import language, mixing, neardup, packing, queries, warc

BIG = 2**53
IDS = [BIG + 1, BIG + 3, BIG + 5, -(BIG + 7), 2**63 - 1, 4]


def docs(spark, ids, texts=None):
    import random

    rng = random.Random(1)
    rows = [(i, texts[k] if texts else prose(rng, 60), "ab"[k % 2] * 2, "s", k) for k, i in enumerate(ids)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    # A time before Python's and pandas' clocks, an interval, a map, and names that operators use themselves.
    return table.withColumns({"at": F.expr("timestamp'1500-03-04 05:06:07'"), "span": F.expr("interval 3 days 2 hours"), "m": F.expr("map('k', doc_id)"), "_language": F.lit(1), "key": F.lit("k"), "node": F.lit(2), "class_id": F.lit("c"), "a.b": F.lit(5)})


@pytest.mark.parametrize("ids", [IDS, [*IDS, None], [None, *IDS, None]])
def test_ids_stay_exact(spark, ids):
    table = docs(spark, ids)
    langs, net = language.fit(table)
    want = Counter(ids)
    assert Counter(r["doc_id"] for r in language.predict(table, langs, net, keep=("doc_id", "n_chars")).collect()) == want
    assert Counter(r["doc_id"] for r in packing.pack(table).where("start = 0").collect()) == want
    assert Counter(r["doc_id"] for r in neardup.classes(table).where("doc_id <=> class_id").collect()) == want
    assert Counter(r["doc_id"] for r in mixing.mix(table).collect()) == want


@pytest.mark.parametrize("ids", [IDS, [*IDS, None]])
def test_near_dedup_keeps_one_of_each(spark, ids):
    texts = [f"text {k} of five and more words each its own {k}" for k in range(len(ids))]
    table = docs(spark, ids * 2, texts * 2)
    kept = corpus_pipeline.near_dedup(spark, table, "")
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(zip(ids, texts)) and kept.columns == table.columns


@pytest.mark.parametrize("more", [[], [(None, "http://n", "alone")]])
def test_warc_refers_to_exact_ids(spark, tmp_path, more):
    rows = [(i, f"http://h/{k}", "same page") for k, i in enumerate(IDS[:4])] + [(7, "http://o", "other"), *more]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in queries.op9_warc(spark, str(tmp_path)).collect()}
    top = max(IDS[:4])
    assert got == {i: ("response", None) if i == top else ("revisit", top) for i in IDS[:4]} | {7: ("response", None)} | {i: ("response", None) for i, *_ in more}
    manifest = warc.write(spark.read.parquet(f"{tmp_path}/pages.parquet"), f"file://{tmp_path}/w", shard_bytes=5)
    assert {r["refers_to"] for r in warc.read(manifest, f"file://{tmp_path}/w").collect()} == {None, top}


def test_pipeline_with_any_columns(spark, tmp_path):
    ids = [*IDS, None]
    table = docs(spark, ids)
    kept = corpus_pipeline.language_id(spark, table, "")
    assert kept.schema == table.schema
    shown = lambda df: sorted(map(repr, df.withColumn("at", F.col("at").cast("string")).withColumn("span", F.col("span").cast("string")).collect()))
    assert shown(kept) == shown(table)
    table.drop("a.b").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(ids)
