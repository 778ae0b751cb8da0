"""Binding of the driver's TPC-H-like tables to the facility panel shape.

Panel = one row per (order year, order month, customer). The same derivation exists as a
DataFrame plan (``panel``) and as SQL text (``PANEL_SQL``) used by the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import bounded_broadcast, table

_PANELS: dict = {}

# Fixed derivation shared with the oracle text below (keep both in step).
PANEL_SQL = """
WITH f AS (
  SELECT CAST(year(o.o_orderdate) AS INT) AS anio, CAST(month(o.o_orderdate) AS INT) AS mes,
         o.o_custkey AS custkey,
         CAST(SUM(CAST(l.l_quantity AS BIGINT)) AS BIGINT) AS inc_total,
         COUNT(*) AS aten_total,
         CAST(SUM(CASE WHEN l.l_returnflag = 'N' THEN CAST(l.l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS cn_inicial,
         CAST(SUM(CASE WHEN l.l_returnflag = 'A' THEN CAST(l.l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS cn_prim,
         CAST(SUM(CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS cn_sec,
         MAX(CASE o.o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 0 ELSE 2 END) AS situacion
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  GROUP BY 1, 2, 3)
SELECT f.anio, f.mes, f.anio * 100 + f.mes AS period_key,
       concat('I-', lpad(CAST(n.n_nationkey + 1 AS STRING), 2, '0'), '-',
              lpad(CAST(c.c_custkey // 100 AS STRING), CAST(greatest(length(CAST(c.c_custkey // 100 AS STRING)), 3) AS INT), '0'), '-',
              lpad(CAST(c.c_custkey % 100 AS STRING), 2, '0')) AS clave,
       c.c_name AS nombre, n.n_nationkey AS estado_id, n.n_name AS estado, r.r_name AS zona,
       CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Construcción' WHEN 'MACHINERY' THEN 'Máquinas'
            WHEN 'FURNITURE' THEN ' Muebles ' ELSE c.c_mktsegment END AS municipio,
       concat('L', CAST(c.c_custkey % 7 AS STRING)) AS localidad,
       CAST(f.situacion AS INT) AS situacion,
       CASE c.c_custkey % 6 WHEN 0 THEN 'no' WHEN 1 THEN 'SI' WHEN 2 THEN 'Fibra'
            WHEN 3 THEN NULL WHEN 4 THEN '0' ELSE ' NaN ' END AS conectividad,
       CASE WHEN c.c_custkey % 50 = 0 THEN CAST(0 AS DOUBLE) WHEN c.c_custkey % 53 = 0 THEN CAST(40 AS DOUBLE)
            ELSE CAST(14.5 AS DOUBLE) + CAST((c.c_custkey * 37) % 18200 AS DOUBLE) / 1000 END AS lat,
       CAST(-118.5 AS DOUBLE) + CAST((c.c_custkey * 61) % 31800 AS DOUBLE) / 1000 AS lng,
       CASE f.custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('$ ', CAST(f.inc_total AS STRING))
            WHEN 2 THEN 'n/d' ELSE CAST(f.inc_total AS STRING) END AS inc_total_raw,
       f.inc_total, f.aten_total, f.cn_inicial, f.cn_prim, f.cn_sec,
       f.cn_inicial + f.cn_prim + f.cn_sec AS cn_total
FROM f JOIN customer c ON c.c_custkey = f.custkey
       JOIN nation n ON n.n_nationkey = c.c_nationkey
       JOIN region r ON r.r_regionkey = n.n_regionkey
"""

# Query points for the nearby search: suppliers placed with the same arithmetic.
POINTS_SQL = """
SELECT s.s_suppkey AS point_id, s.s_name AS point_name,
       CAST(14.5 AS DOUBLE) + CAST((s.s_suppkey * 37) % 18200 AS DOUBLE) / 1000 AS lat,
       CAST(-118.5 AS DOUBLE) + CAST((s.s_suppkey * 61) % 31800 AS DOUBLE) / 1000 AS lng
FROM supplier s
"""


def oracle(select_sql: str, *, points: bool = False) -> str:
    """Wrap an oracle SELECT over ``panel`` (and ``points``) with the binding CTEs."""
    ctes = f"panel AS ({PANEL_SQL})"
    if points:
        ctes += f", points AS ({POINTS_SQL})"
    return f"WITH {ctes}\n{select_sql}"


def _qty(c: str = "l_quantity") -> Column:
    return F.col(c).cast("bigint")


def facility_key(nation: Column, customer: Column) -> Column:
    """'I-<nation>-<customer / 100>-<customer % 100>', padded and never shortened: distinct
    customers have distinct keys at every size."""
    high = F.floor(customer / 100).cast("bigint").cast("string")
    return F.concat(F.lit("I-"), F.lpad((nation + 1).cast("string"), 2, "0"), F.lit("-"),
                    F.lpad(high, F.greatest(F.length(high), F.lit(3)), F.lit("0")), F.lit("-"),
                    F.lpad((customer % 100).cast("string"), 2, "0"))


#: Rows that one task of a shuffle below takes in, whatever the session's number of shuffle partitions.
ROWS_PER_TASK = 200_000


def derive_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a DataFrame plan.

    Lineitem is aggregated per order before it meets orders, in the same tasks. It is dealt by order first:
    the lines of an order are spread over all files, so that an aggregate of each file would save next to
    nothing and hold all orders of its file. All shuffles are sized by the rows in the footers of the tables,
    so what a task takes in from them stays the same as they grow; a task that deals out a split of a file
    may buffer its rows, and so grows with the splits.
    """
    tasks = lambda t: max(-(-table(spark, sf_dir, t).count() // ROWS_PER_TASK), 1)
    n_lines, n_orders = tasks("lineitem"), tasks("orders")
    li = (table(spark, sf_dir, "lineitem")
          .select("l_orderkey", "l_quantity", "l_returnflag").repartition(n_lines, "l_orderkey")
          .groupBy("l_orderkey")
          .agg(F.sum(_qty()).alias("q"), F.count(F.lit(1)).alias("n"),
               F.sum(F.when(F.col("l_returnflag") == "N", _qty()).otherwise(0)).alias("qn"),
               F.sum(F.when(F.col("l_returnflag") == "A", _qty()).otherwise(0)).alias("qa"),
               F.sum(F.when(F.col("l_returnflag") == "R", _qty()).otherwise(0)).alias("qr")))
    o = (table(spark, sf_dir, "orders")
         .select(F.year("o_orderdate").cast("int").alias("anio"),
                 F.month("o_orderdate").cast("int").alias("mes"),
                 F.col("o_custkey").alias("custkey"), "o_orderkey",
                 F.when(F.col("o_orderstatus") == "O", 1)
                  .when(F.col("o_orderstatus") == "F", 0).otherwise(2).alias("st"))
         .repartition(n_lines, "o_orderkey"))
    # by period too: a customer with very many orders is cut by month
    f = (o.join(li, o.o_orderkey == li.l_orderkey)
         .repartition(n_orders, "anio", "mes", "custkey").groupBy("anio", "mes", "custkey")
         .agg(F.sum("q").cast("bigint").alias("inc_total"),
              F.sum("n").cast("bigint").alias("aten_total"),
              F.sum("qn").cast("bigint").alias("cn_inicial"),
              F.sum("qa").cast("bigint").alias("cn_prim"),
              F.sum("qr").cast("bigint").alias("cn_sec"),
              F.max("st").cast("int").alias("situacion")))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # nation and region are small dimensions: broadcast after the size check
    n = bounded_broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    r = bounded_broadcast(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    j = (f.repartition(n_orders, "custkey").join(c.repartition(n_orders, "c_custkey"), f.custkey == c.c_custkey)
         .join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    ck = F.col("c_custkey")
    key = facility_key(F.col("n_nationkey"), ck)
    seg = F.col("c_mktsegment")
    municipio = (F.when(seg == "BUILDING", "Construcción").when(seg == "MACHINERY", "Máquinas")
                 .when(seg == "FURNITURE", " Muebles ").otherwise(seg))
    m6 = ck % 6
    conect = (F.when(m6 == 0, "no").when(m6 == 1, "SI").when(m6 == 2, "Fibra")
              .when(m6 == 3, F.lit(None).cast("string")).when(m6 == 4, "0").otherwise(" NaN "))
    lat = (F.when(ck % 50 == 0, F.lit(0.0)).when(ck % 53 == 0, F.lit(40.0))
           .otherwise(F.lit(14.5) + ((ck * 37) % 18200).cast("double") / 1000))
    lng = F.lit(-118.5) + ((ck * 61) % 31800).cast("double") / 1000
    fk = F.col("custkey") % 7
    raw = (F.when(fk == 0, F.lit(None).cast("string"))
           .when(fk == 1, F.concat(F.lit("$ "), F.col("inc_total").cast("string")))
           .when(fk == 2, F.lit("n/d")).otherwise(F.col("inc_total").cast("string")))
    return j.select(
        "anio", "mes", (F.col("anio") * 100 + F.col("mes")).alias("period_key"),
        key.alias("clave"), F.col("c_name").alias("nombre"), F.col("n_nationkey").alias("estado_id"),
        F.col("n_name").alias("estado"), F.col("r_name").alias("zona"), municipio.alias("municipio"),
        F.concat(F.lit("L"), (ck % 7).cast("string")).alias("localidad"),
        "situacion", conect.alias("conectividad"), lat.alias("lat"), lng.alias("lng"),
        raw.alias("inc_total_raw"), "inc_total", "aten_total", "cn_inicial", "cn_prim", "cn_sec",
        (F.col("cn_inicial") + F.col("cn_prim") + F.col("cn_sec")).alias("cn_total"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        s.alias("point_id"), F.col("s_name").alias("point_name"),
        (F.lit(14.5) + ((s * 37) % 18200).cast("double") / 1000).alias("lat"),
        (F.lit(-118.5) + ((s * 61) % 31800).cast("double") / 1000).alias("lng"))


PANEL_VERSION = "3"  # bump when the derivation changes, so stored panels are rebuilt


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Of the input files as their own file system reports them (path, size, time), so that a
    changed table on any store gives another panel. A missing status is an error."""
    import hashlib
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha1(PANEL_VERSION.encode())
    for t in ("orders", "lineitem", "customer", "nation", "region"):
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        fs = p.getFileSystem(conf)
        status = fs.getFileStatus(p)
        for x in sorted(fs.listStatus(p), key=lambda x: x.getPath().toString()) if status.isDirectory() else [status]:
            h.update(f"{x.getPath()}:{x.getLen()}:{x.getModificationTime()}\n".encode())
    return h.hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a completed table (``_SUCCESS`` marker) exists at ``path``."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    except Exception:  # noqa: BLE001 - no JVM handle (e.g. Spark Connect): probe by reading
        try:
            spark.read.text(path + "/_SUCCESS").limit(1).collect()
            return True
        except Exception:  # noqa: BLE001
            return False


def write_panel(df: DataFrame, path: str, tasks: int | None = None, rows: int | None = None) -> None:
    """Write a panel partitioned by period (the reports prune on it); range-partitioned
    writers sized by their rows (see ``sources.panel.sink_panel_partitioned``)."""
    from .panel import sink_panel_partitioned
    sink_panel_partitioned(df, path, ("period_key",), "clave", tasks, rows)


def panel(spark: SparkSession, sf_dir: str, rebuild: bool = False) -> DataFrame:
    """The panel as a written table under the shared checkpoint folder (built once per input
    fingerprint, then read back): the prepared, period-partitioned dataset every report reads."""
    mark = _fingerprint(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, mark)
    if key in _PANELS and not rebuild:
        return _PANELS[key]
    path = scratch_path(spark, f"panel-{mark}")
    if rebuild:
        import uuid
        path = scratch_path(spark, f"panel-{mark}-{uuid.uuid4().hex[:8]}")
    if rebuild or not _exists(spark, path):
        # a panel row stands for at least one order: their number, from the footers, sizes the writers
        write_panel(derive_panel(spark, sf_dir), path, rows=table(spark, sf_dir, "orders").count())
    df = spark.read.parquet(path)
    _PANELS[key] = df
    return df
