"""A batch's totals are summed and written by as many tasks as the shuffle has."""

from pyspark.sql import functions as F

from matloom.llm.token_rollup import TokenRollup


def test_totals_of_many_groups_are_not_one_task(spark, ws):
    folder = ws.new_path("rollup")
    rollup = TokenRollup(spark, folder)
    source = F.concat(F.lit("host"), F.col("id").cast("string"))
    rows = spark.range(2000).select(F.lit("insert").alias("op"), F.col("id").alias("doc_id"), source.alias("source"), F.lit("en").alias("lang"), F.lit("w").alias("tokenizer"), F.lit(2).cast("long").alias("tokens"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        rollup.apply("load", rows)
    finally:
        spark.conf.set(setting, before)
    parts = spark.read.parquet(f"{folder}/totals/load").groupBy(F.input_file_name()).count().count()
    assert parts > 1
    assert rollup.totals().agg(F.count("source"), F.sum("docs"), F.sum("tokens")).first()[:] == (2000, 2000, 4000)
