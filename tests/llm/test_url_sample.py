"""Trees are trained on both labels, however rare one is and however often a URL is repeated."""

from pyspark.sql import functions as F

from pairwell.llm import urls


def test_rare_label_and_repeated_url(spark):
    n = F.col("id").cast("string")
    allowed = spark.range(2000).select("id", F.concat(F.lit("http://h"), n, F.lit(".com/a/"), n).alias("url"))
    blocked = spark.range(2000, 2008).select("id", F.concat(F.lit("http://h"), n, F.lit(".net/es/"), n).alias("url"))
    first = allowed.orderBy(F.xxhash64("url")).first()["url"]
    again = spark.range(3000, 3200).select("id", F.lit(first).alias("url"))
    # No rule fits these; their suffix is that of the blocked ones.
    other = spark.range(4000, 4020).select("id", F.concat(F.lit("http://h"), n, F.lit(".net/de/"), n).alias("url"))
    pages = allowed.union(blocked).union(again).union(other).withColumnRenamed("id", "page_id")
    got = urls.judge_urls(pages, training_rows=50).where("page_id >= 4000").groupBy("verdict").count().collect()
    assert [tuple(r) for r in got] == [("block", 20)]
