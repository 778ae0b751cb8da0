"""A key holding a third of all rows: results stay whole, reductions run map-side first."""

from pyspark.sql import functions as F

from tessera.binding import DEFAULT as B
from tessera.operators import aggregates as ag
from tessera.operators.ranking import dedup_keep_first, leader_per_measure


def _skewed(spark, n=30000):
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("K"), (F.col("id") % 997).cast("string"))).alias("clave"),
        (F.col("id") % 40).cast("int").alias("estado_id"), F.concat(F.lit("G"), (F.col("id") % 40).cast("string")).alias("estado"),
        (F.col("id") % 5).cast("int").alias("situacion"), (F.col("id") % 50).alias("cn_inicial"),
        (F.col("id") % 7).alias("cn_prim"), (F.col("id") % 11).alias("cn_sec"), F.col("id").alias("seq"))
    return df


def test_first_per_key_hot_key(spark):
    df = _skewed(spark)
    kept, dups = dedup_keep_first(df.select("clave", "seq", "cn_inicial"), "clave", ["seq"])
    rows = {r.clave: r.seq for r in kept.collect()}
    assert rows["HOT"] == 0 and len(rows) == 1 + df.where("clave != 'HOT'").select("clave").distinct().count()
    assert dups.first()[0] == df.count() - len(rows)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan  # reduced before the shuffle: the hot key moves one row per task


def test_leader_and_status_pivot_hot_key(spark):
    df = _skewed(spark)
    lead = {r.measure: r.leader for r in leader_per_measure(df, ["cn_inicial"], B).collect()}
    assert lead["cn_inicial"] in {r.clave for r in df.where("cn_inicial = 49").select("clave").collect()}
    pv = ag.status_pivot(df, B)
    assert pv.agg(F.sum("total")).first()[0] == df.select("estado", "situacion", "clave").distinct().count()
