"""The pipeline's stages against what each is to do, and all queries with an oracle."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tonelake.llm import mixing, packing, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    clean = {r["doc_id"] for r in docs.collect()}
    first = {r["doc_id"] for r in kept.collect()}
    assert first <= clean and len(first) > 0.95 * len(clean)
    odd = docs.limit(1).unionByName(spark.createDataFrame([(10**6, "12 34 !", None, None, 7), (10**6 + 1, None, None, None, 0)], docs.schema))
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, odd, SF).collect()} <= clean

    more = docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)).withColumn("key", F.lit(2)).limit(20)
    for stage in (corpus_pipeline.language_id, corpus_pipeline.near_dedup, corpus_pipeline.mix):
        assert stage(spark, more, SF).columns == more.columns

    one = corpus_pipeline.near_dedup(spark, docs, SF)
    from tests.llm.test_operators import plain_classes

    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    roots = plain_classes([t for _, t in rows])
    assert {r["doc_id"] for r in one.collect()} == {rows[i][0] for i in set(roots)} and one.columns == docs.columns


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    seen = {}
    for r in got:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "mix", "packing"]

    # The same by brute force: what the first stage keeps, one of each class, taken as often as a single list says, with the tokenizer's own ids.
    from tokenizers import Tokenizer

    from tests.llm.test_operators import plain_classes, plain_mix, plain_targets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"], None, r["source"]) for r in corpus_pipeline.language_id(spark, docs, SF).collect())
    rows = [rows[i] for i in sorted(set(plain_classes([t for _, t, _, _ in rows])))]
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t))
    taken = {i: n for (i, _, _, n), _ in plain_mix(rows, plain_targets(sizes, mixing.WEIGHTS, 3)).items() if n}
    tokens, text = Tokenizer.from_file(packing.tokenizer_path()), {i: t for i, t, _, _ in rows}
    want = {i: n * (len(tokens.encode(text[i], add_special_tokens=False).ids) + 1) for i, n in taken.items()}
    packed = {}
    for r in got:
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == want


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, 0), (2, None, "aa", None, 0)], [(3, "a few words of text", "aa", "s", 19)] * 5 + [(4, "ein paar Worte", None, None, 14)]])
def test_run_of_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {i for i, t, *_ in rows if t} and (got or not any(t for _, t, *_ in rows))


def test_packing_stage_with_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    more = docs.withColumn("ids", F.lit(1)).withColumn("start", F.lit("x")).withColumn("offset", F.lit(2)).withColumn("_text", F.lit("y"))
    assert sorted(map(tuple, corpus_pipeline.pack(spark, more.coalesce(1), SF).collect())) == sorted(map(tuple, corpus_pipeline.pack(spark, docs.coalesce(1), SF).collect()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = con.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    want = sorted(map(repr, r.fetchall()))
    got = sorted(repr(tuple(x[c] for c in columns)) for x in queries.queries()[name](spark, SF).collect())
    assert got == want
