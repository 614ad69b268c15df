import tracemalloc

from pyspark.sql import functions as F

from echosieve.llm import common


def test_filter_stays_small_on_driver(spark):
    """The filter of 100,000 ids is 0.3 MB; its words as Row objects took over 15 MB."""
    rows = spark.range(0, 1_000_000, 5).withColumn("text", F.lit("x"))
    ids = spark.range(0, 1_000_000, 10)
    tracemalloc.start()
    try:
        kept = common.keep_ids(rows, ids)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert kept.join(ids, "id", "left_semi").count() == 100_000
    assert kept.count() < 110_000
    assert most < 4_000_000
