from pyspark.sql import functions as F

from fluxloom import plans
from fluxloom.plans.scenes import stack

SF = "/root/testdata/sf0.001"


def test_kalman_smooths_to_the_last_day_of_the_stack(spark):
    last = stack(spark, SF).agg(F.max("day")).first()[0]
    got = plans.QUERIES["w03_kalman"](spark, SF).groupBy("x", "y").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count("evi").alias("n")).collect()
    assert last > 730 and {(r["lo"], r["hi"], r["n"]) for r in got} == {(0, last, last + 1)}
