"""Draws of the bootstrap."""


def test_bootstrap_draws_are_random(spark):
    """Blocks drawn with replacement: about 1 - 1/e of them are met, the means vary as independent draws do."""
    import numpy as np
    from pyspark.sql import functions as F

    from tickloom.operators.resampling import uniform

    for n in (8, 16, 37):
        runs = spark.range(1000).withColumnRenamed("id", "sim").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rows = runs.select("sim", F.floor(uniform(F.lit("AAA"), F.col("sim"), F.col("slot")) * n).alias("b")).groupBy("sim").agg(F.countDistinct("b").alias("d"), F.avg("b").alias("m")).toPandas()
        assert abs(rows.d.mean() / n - (1 - (1 - 1 / n) ** n)) < 0.02
        assert abs(rows.m.var() / ((n * n - 1) / 12 / n) - 1) < 0.2 and rows.d.nunique() > 2
        assert np.isclose(rows.m.mean(), (n - 1) / 2, rtol=0.05)
