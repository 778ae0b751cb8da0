"""Incremental loads: rows survive any file layout, late files add, replays and new loads do not double."""

import uuid

from pyspark.sql import functions as F

from tessera.binding import DEFAULT as B
from tessera.plans import testqueries as tq
from tessera.session import scratch_path
from tessera.streaming.image_changes import images_at, incremental_image_sync, intervals
from tessera.streaming.incremental import current_panel, incremental_period_load, period_summary

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def _run(spark, base, schema, ck, n):
    incremental_period_load(spark, f"{base}/landing", schema, f"{base}/panel", f"{base}/summary", f"{base}/{ck}", B, files_per_trigger=n)


def test_stream_equals_batch_in_any_layout_and_a_new_load_replaces(spark):
    base = scratch_path(spark, f"test-stream-{uuid.uuid4().hex[:8]}")
    p = tq.panel(spark, SF)
    p.repartition(4).write.parquet(f"{base}/landing")  # every period in every file
    schema = spark.read.parquet(f"{base}/landing").schema
    _run(spark, base, schema, "ck1", 1)
    assert _rows(spark.read.parquet(f"{base}/summary")) == _rows(period_summary(p, B))
    assert current_panel(spark, f"{base}/panel").count() == p.count()
    late = p.limit(30).withColumn("clave", F.lit("late"))
    late.coalesce(1).write.mode("append").parquet(f"{base}/landing")
    _run(spark, base, schema, "ck1", 1)  # the same load: the late file adds
    both = p.unionByName(late)
    assert _rows(spark.read.parquet(f"{base}/summary")) == _rows(period_summary(both, B))
    _run(spark, base, schema, "ck2", 2)  # a new load of the same files replaces
    assert _rows(spark.read.parquet(f"{base}/summary")) == _rows(period_summary(both, B))
    assert current_panel(spark, f"{base}/panel").count() == both.count()


def test_one_period_is_written_by_many_tasks(spark):
    base = scratch_path(spark, f"test-spread-{uuid.uuid4().hex[:8]}")
    p = tq.panel(spark, SF)
    p = p.where(F.col("period_key") == p.groupBy("period_key").count().orderBy(F.col("count").desc(), "period_key").first()[0])
    p.coalesce(1).write.parquet(f"{base}/landing")
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        _run(spark, base, spark.read.parquet(f"{base}/landing").schema, "ck", 1)
    finally:
        spark.conf.set(conf, before)
    got = spark.read.parquet(f"{base}/panel")
    assert got.count() == p.count() and got.select(F.input_file_name()).distinct().count() > 1


def test_a_large_batch_is_cut_by_its_rows(spark, monkeypatch):
    """As many writers as the rows need, whatever the session's shuffle partitions and however small the rows pack."""
    from tessera.sources import panel
    monkeypatch.setattr(panel, "ROWS_PER_WRITER", 100)
    base = scratch_path(spark, f"test-cut-{uuid.uuid4().hex[:8]}")
    rows = spark.range(3000).select(F.lit(202401).alias("period_key"), F.format_string("I-%05d", "id").alias("clave"),
                                    F.lit(1).alias("estado_id"), F.lit(1).alias("situacion"),
                                    *[F.lit(1).cast("long").alias(c) for c in (*B.levels, "cn_total")])
    rows.coalesce(1).write.parquet(f"{base}/landing")
    _run(spark, base, spark.read.parquet(f"{base}/landing").schema, "ck", 1)
    got = spark.read.parquet(f"{base}/panel")
    sizes = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) > 20 and max(sizes) <= 200
    assert _rows(got.select(rows.columns)) == _rows(rows)
    assert spark.read.parquet(f"{base}/summary").first()["rows"] == 3000


def test_image_snapshots_of_many_parts(spark):
    base = scratch_path(spark, f"test-snap-{uuid.uuid4().hex[:8]}")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("file_id"), F.lit("a").alias("file_name"),
                                    F.lit(1).alias("size"), F.when(F.col("id") % 10 > 0, F.lit("2020")).alias("modified"))
    rows.repartition(4).write.parquet(f"{base}/snap/s1")
    rows.where("file_id % 2 = 0").withColumn("file_name", F.lit("b")).repartition(3).write.parquet(f"{base}/snap/s2")
    schema = spark.read.parquet(f"{base}/snap/s1").schema
    incremental_image_sync(spark, f"{base}/snap", schema, f"{base}/table", f"{base}/ck")
    counts = {(r.snapshot, r.status): r.files for r in spark.read.parquet(f"{base}/table_counts").collect()}
    assert counts == {("s1", "new"): 1000, ("s2", "unchanged"): 500, ("s2", "removed"): 500}
    last = images_at(spark, f"{base}/table", schema, "s2")
    assert last.count() == 500 and last.where("file_name = 'a'").count() == 500  # cached names stay
    rows.where("file_id = 1").coalesce(1).write.mode("append").parquet(f"{base}/snap/s2")  # a late part
    incremental_image_sync(spark, f"{base}/snap", schema, f"{base}/table", f"{base}/ck")
    assert images_at(spark, f"{base}/table", schema, "s2").count() == 501


def test_loaded_rows_are_not_read_again_for_the_summary(spark):
    # the summary comes from partial aggregates: it is right even when the rows themselves are gone
    base = scratch_path(spark, f"test-partials-{uuid.uuid4().hex[:8]}")
    p = tq.panel(spark, SF)
    p.repartition(3).write.parquet(f"{base}/landing")
    schema = spark.read.parquet(f"{base}/landing").schema
    _run(spark, base, schema, "ck", 1)
    want = _rows(period_summary(p, B))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{base}/panel")
    root.getFileSystem(conf).rename(root, jvm.org.apache.hadoop.fs.Path(f"{base}/panel_away"))
    late = p.limit(20).withColumn("clave", F.lit("late"))
    late.coalesce(1).write.mode("append").parquet(f"{base}/landing")
    _run(spark, base, schema, "ck", 1)
    assert _rows(spark.read.parquet(f"{base}/summary")) == _rows(period_summary(p.unionByName(late), B)) != want


def test_a_refresh_that_broke_off_is_done_by_the_next_run(spark, monkeypatch):
    from tessera.streaming import incremental
    base = scratch_path(spark, f"test-broken-{uuid.uuid4().hex[:8]}")
    p = tq.panel(spark, SF)
    p.coalesce(1).write.parquet(f"{base}/landing")
    schema = spark.read.parquet(f"{base}/landing").schema
    with monkeypatch.context() as m:
        m.setattr(incremental, "refresh_summary", lambda *a, **k: None)  # as if the driver died here
        _run(spark, base, schema, "ck", 1)
    _run(spark, base, schema, "ck", 1)  # nothing new arrives
    assert _rows(spark.read.parquet(f"{base}/summary")) == _rows(period_summary(p, B))


def test_an_older_load_does_not_come_back(spark):
    # load 1 has two periods, load 2 one of them: its period is load 2's alone, the other stays load 1's
    base = scratch_path(spark, f"test-older-{uuid.uuid4().hex[:8]}")
    p = tq.panel(spark, SF)
    first, second = [r[0] for r in p.select("period_key").distinct().orderBy("period_key").limit(2).collect()]
    both, one = p.where(F.col("period_key").isin(first, second)), p.where(F.col("period_key") == second).limit(3)
    for name, df in (("a", both), ("b", one)):
        df.coalesce(1).write.parquet(f"{base}/{name}")
        incremental_period_load(spark, f"{base}/{name}", spark.read.parquet(f"{base}/{name}").schema, f"{base}/panel", f"{base}/summary", f"{base}/ck-{name}", B)
    rows = spark.read.parquet(f"{base}/{'a'}").where(F.col("period_key") == first).unionByName(spark.read.parquet(f"{base}/b"))
    assert current_panel(spark, f"{base}/panel").count() == rows.count()
    assert _rows(spark.read.parquet(f"{base}/summary")) == _rows(period_summary(rows, B))


IMG = "file_id string, file_name string, size int, modified string"


def _sync_brute(scans):
    """Rescans merged one after the other: the files and status counts of each."""
    state, out, counts = {}, {}, {}
    for name in sorted(scans):
        now, c = {}, {}
        for k, n, s, m in scans[name]:
            status = "new" if k not in state else "unchanged" if state[k][2] == m else "updated"
            now[k] = state[k] if status == "unchanged" else (n, s, m)
            c[status] = c.get(status, 0) + 1
        gone = len(state.keys() - now.keys())
        counts.update({(name, k): v for k, v in c.items()} | ({(name, "removed"): gone} if gone else {}))
        state, out[name] = now, now
    return out, counts


def test_rescans_parts_and_order_match_a_plain_merge(spark):
    import random
    r = random.Random(3)
    names = [f"s{i}" for i in range(1, 6)]
    scans = {n: [(f"f{k}", f"{n}-{k}", r.randrange(9), r.choice(["a", "b", None])) for k in range(40) if r.random() < 0.7] for n in names}
    parts = {(n, j): scans[n][j::3] for n in names for j in range(3)}
    # two rescans at once; one in order; a late part; one out of order; the rest
    runs = [[("s1", 0), ("s1", 1), ("s1", 2), ("s2", 0)], [("s4", 0), ("s4", 1)], [("s2", 1)], [("s3", 0), ("s3", 2)], [("s2", 2), ("s4", 2), ("s5", 0)], [("s3", 1), ("s5", 1), ("s5", 2)]]
    base = scratch_path(spark, f"test-order-{uuid.uuid4().hex[:8]}")
    schema, there = spark.createDataFrame([], IMG).schema, {}
    for run in runs:
        for n, j in run:
            there.setdefault(n, []).extend(parts[n, j])
            spark.createDataFrame(parts[n, j], IMG).coalesce(1).write.mode("append").parquet(f"{base}/snap/{n}")
        incremental_image_sync(spark, f"{base}/snap", schema, f"{base}/table", f"{base}/ck")
        state, counts = _sync_brute(there)
        for n in there:
            got = {x.file_id: (x.file_name, x.size, x.modified) for x in images_at(spark, f"{base}/table", schema, n).collect()}
            assert got == state[n], (run, n)
        assert {(x.snapshot, x.status): x.files for x in spark.read.parquet(f"{base}/table_counts").collect()} == counts, run
    for x in intervals(spark, f"{base}/table", schema).collect():
        held = [n for n in names if x.valid_from <= n and (x.valid_to is None or n < x.valid_to)]
        assert held and all(state[n][x.file_id] == (x.file_name, x.size, x.modified) for n in held)


def test_a_late_part_appends_its_keys_only(spark):
    base = scratch_path(spark, f"test-late-{uuid.uuid4().hex[:8]}")
    rows = spark.range(500).select(F.col("id").cast("string").alias("file_id"), F.lit("a").alias("file_name"), F.lit(1).alias("size"), F.lit("m").alias("modified"))
    schema = rows.schema
    for n in ("s1", "s2", "s3"):
        rows.coalesce(1).write.parquet(f"{base}/snap/{n}")
    incremental_image_sync(spark, f"{base}/snap", schema, f"{base}/table", f"{base}/ck")
    assert spark.read.parquet(f"{base}/table").where("status <> 'scanned'").count() == 500  # no copy of s2 and s3
    rows.limit(1).withColumn("file_id", F.lit("late")).write.mode("append").parquet(f"{base}/snap/s1")
    incremental_image_sync(spark, f"{base}/snap", schema, f"{base}/table", f"{base}/ck")
    late = spark.read.parquet(f"{base}/table").where("batch = 1 AND status <> 'scanned'").collect()
    assert {(r.file_id, r.snapshot, r.status) for r in late} == {("late", "s1", "new"), ("late", "s2", "removed"), ("late", "s3", "absent")}
