"""Cross-fitting runs the plans of its rows and folds once, however often it reads them."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.plans import crossfit


def test_folds_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(fold):
        made.add(1)
        return fold

    ids = spark.range(60).select(F.col("id").alias("person"))
    rows = ids.select("person", (F.col("person") % 2).cast("int").alias("y"), F.lit(1.0).alias("w"), F.array((F.col("person") % 7).cast("double"), (F.col("person") % 5).cast("double")).alias("v"))
    fold = F.udf(counted, T.IntegerType()).asNondeterministic()((F.floor(F.col("person") / 2) % 2).cast("int"))
    folds = ids.select("person", F.lit(0).alias("repeat"), fold.alias("fold"))
    scores = crossfit.cross_fit(rows, "person", folds, crossfit.Recipe("LogisticRegression", "v", (2,)), [{"C": 1.0}])
    assert scores.count() == 60
    assert made.value <= 60
