"""Short ranges of a packed folder are read many to a task."""

from pyspark.sql import functions as F

from matloom import SparseMatrix
from matloom.sources import binary_format


def test_short_ranges_share_a_task(spark, ws):
    n = 5_000
    path = ws.new_path("packed")
    df = spark.range(n).select(F.col("id").alias("i"), (F.col("id") * 7 % 13).alias("j"), (F.col("id") / 4).alias("v"))
    binary_format.write_coo(SparseMatrix(df.repartition(3), n, 13), path)
    back = binary_format.load_coo(spark, path, chunk=10)
    assert back.rdd.getNumPartitions() <= 2 * binary_format.PARTITIONS
    assert sorted(map(tuple, back.collect())) == [(i, i * 7 % 13, i / 4) for i in range(n)]
