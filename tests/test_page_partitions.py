"""Drawn pages are dealt over many tasks, also where the rows lie in few partitions by the same key already."""

import pytest
from pyspark.sql import functions as F

from tonelake.plans import q_pages, q_tuplets, q_words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module", [q_pages, q_words, q_tuplets])
def test_pages_are_dealt(spark, module):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * spark.sparkContext.defaultParallelism))
    try:
        assert module.pages(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
