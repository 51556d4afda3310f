"""Run a salted join while the first attempt of a map task fails; print
whether the result equals the plain join. Started by test_fault_tolerance in
its own process, because the master (with task retries) differs from the
shared test session's."""

import sys

from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, sys.argv[1])
MARKER = sys.argv[2]
from custodia.operators import SkewPolicy, salted_join  # noqa: E402

spark = (SparkSession.builder.master("local[2,3]")  # up to 3 attempts per task
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.autoBroadcastJoinThreshold", "-1")
         .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
         .getOrCreate())
spark.sparkContext.setLogLevel("OFF")


@F.udf(T.BooleanType())
def fail_first_attempt(k):
    ctx = TaskContext.get()
    if ctx.partitionId() == 0 and ctx.attemptNumber() == 0:
        with open(MARKER, "a") as fh:
            fh.write("failed once\n")
        raise RuntimeError("injected executor failure")
    return True


fact = spark.range(3000, numPartitions=4).select(
    F.col("id").alias("rowId"),
    F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).cast("long").alias("k"))
keyed = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
flaky = fact.where(fail_first_attempt(F.col("k")))
policy = SkewPolicy(buckets=4, max_hot=4, rows_per_task=100)
salted = sorted(map(tuple, salted_join(flaky, keyed, "k", "inner", policy).collect()))
plain = sorted(map(tuple, fact.join(keyed, "k", "inner").collect()))
print("RESULT", salted == plain, len(salted))
spark.stop()
