"""Nothing is cut: keys stay distinct, empty dates stay, small documents and short queries work."""

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.binding import DEFAULT as B
from tessera.functions import numbers as nb
from tessera.operators.images import image_lookup_cascade, image_sync_merge
from tessera.operators.nearby import nearest_facility
from tessera.plans.search import search_scored
from tessera.sources import testbind
from tessera.sources.delimited import scan_delimited
from tessera.sources.json_sources import scan_period_index


def test_keys_of_many_customers_are_distinct(spark):
    k = spark.range(1, 1_500_001).select(testbind.facility_key(F.lit(4), F.col("id")).alias("k"))
    assert k.distinct().count() == 1_500_000
    assert spark.range(1).select(testbind.facility_key(F.lit(4), F.lit(7))).first()[0] == "I-05-000-07"


def test_files_without_a_date_are_not_removed(spark):
    rows = spark.createDataFrame([("a", "n", 1, None), ("b", "n", 2, "2020")], "file_id string, file_name string, size int, modified string")
    merged, counts = image_sync_merge(rows, rows)
    assert merged.count() == 2 and {r.status: r.files for r in counts.collect()} == {"unchanged": 2}


def test_equal_image_queries_stay_one_row_each(spark):
    images = spark.createDataFrame([("i-01-002-03", "Alias X", (0, 0))], "key string, alias string, folder_order struct<s:long,f:long>")
    q = spark.createDataFrame([("I-01-002-03",), ("I-01-002-03",), ("alias x",), ("nothing",)], "query string")
    got = sorted((r.query, r.key, r.method) for r in image_lookup_cascade(q, images).fillna("-").collect())
    assert got == [("I-01-002-03", "i-01-002-03", "exact")] * 2 + [("alias x", "i-01-002-03", "alias"), ("nothing", "-", "-")]


def test_nearest_ties_by_rounded_distance(spark):
    fac = spark.createDataFrame([("Z", 20.0, -100.0), ("A", 20.0, -99.98085)], "clave string, lat double, lng double")
    km = 111.19492664455873
    pts = spark.createDataFrame([(1, 20.0 + 2.0 / km, -99.990425)], "point_id int, lat double, lng double")
    assert [r.facility for r in nearest_facility(pts, fac, b=B).collect()] == ["A"]


def test_empty_period_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text('{"index": {"2024-01": {"name": "x", "url": "u"}, "2024-02": {"name": "y"}}}')
    entries, discarded = scan_period_index(spark, str(tmp_path))
    assert [r.period for r in entries.collect()] == ["2024-01"] and tuple(discarded.first()) == (1, 1)


def test_short_queries_have_the_columns_of_long_ones(spark):
    df = spark.createDataFrame([("k", "n", "g", "m", "l")], "clave string, nombre string, estado string, municipio string, localidad string")
    a, b = search_scored(df, "x", B), search_scored(df, "nn", B)
    assert a.columns == b.columns and a.count() == 0


def test_large_percentages(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_001)], "a long, b long")
    assert tuple(df.select(nb.pct_int("a", "b"), nb.pct_int(F.col("a"), F.col("b"))).first()) == (100.0, 100.0)


def test_latin_1_files(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("Año,Estado\n2024,México\n".encode("latin-1"))
    (tmp_path / "y.csv").write_bytes("Año,Estado\n2024,México\n".encode("utf-8"))
    for name in ("x.csv", "y.csv"):
        df = scan_delimited(spark, str(tmp_path / name))
        assert df.columns == ["Año", "Estado"] and df.first()["Estado"] == "México"


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app-x"

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_a_changed_table_gives_another_panel(spark, tmp_path):
    import shutil
    for t in ("orders", "lineitem", "customer", "nation", "region"):
        shutil.copyfile(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    first = testbind._fingerprint(spark, str(tmp_path))
    assert first == testbind._fingerprint(spark, str(tmp_path))
    spark.read.parquet("/root/testdata/sf0.001/region.parquet").limit(2).toPandas().to_parquet(tmp_path / "region2.parquet")
    shutil.copyfile(tmp_path / "region2.parquet", tmp_path / "region.parquet")
    assert testbind._fingerprint(spark, str(tmp_path)) != first


def test_trees_in_one_document(spark, tmp_path):
    import json
    from tessera.operators.images import flatten_tree_v1
    from tessera.sources.json_sources import scan_file_catalog
    catalog = {"structure": {"children": [{"name": "Y2024", "type": "folder", "children": [
        {"name": "a.parquet", "path": "Y2024/a.parquet", "size": "5", "year": "2024", "month": "01"}]}]}}
    (tmp_path / "c.json").write_text(json.dumps(catalog, indent=1))
    files, stats = scan_file_catalog(spark, str(tmp_path / "c.json"), whole_document=True)
    assert [(r.folder, r.name, r.size) for r in files.collect()] == [("Y2024", "a.parquet", 5)] and stats.first()["files"] == 1
    tree = {"structure": {"children": [{"name": "S", "type": "folder", "children": [
        {"name": "K1", "type": "folder", "children": [{"name": "x.jpg", "type": "file", "mimeType": "image/jpeg", "id": "1"}]}]}]}}
    (tmp_path / "t.json").write_text(json.dumps(tree, indent=1))
    rows = flatten_tree_v1(spark, str(tmp_path / "t.json"), whole_document=True).collect()
    assert sorted((r.folder, r.name) for r in rows) == [("k1", "x.jpg"), ("s", "K1")]


def test_the_newest_period_is_read_from_the_listing(spark):
    from tessera.operators.filters import latest_period_filter, latest_value
    from tessera.sources.tables import partition_values
    p = testbind.panel(spark, "/root/testdata/sf0.001")
    periods = sorted(r[0] for r in p.select("period_key").distinct().collect())
    assert sorted(partition_values(p, "period_key")) == periods and sorted(partition_values(p.select("clave", "period_key"), "period_key")) == periods
    plan = latest_period_filter(p)._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" not in plan and "Aggregate" not in plan and f"(period_key#" in plan and f"= {periods[-1]})" in plan
    for as_of in (None, periods[3], periods[3] + 0, 190001):
        want = [x for x in periods if as_of is None or x <= as_of]
        got = {r[0] for r in latest_period_filter(p, as_of=as_of).select("period_key").distinct().collect()}
        assert got == ({want[-1]} if want else set())
    # a filtered table, another column or a table without partitions is aggregated, as before
    part = p.where(f"period_key < {periods[5]}")
    assert partition_values(part, "period_key") is None and partition_values(p, "mes") is None
    assert {r[0] for r in latest_period_filter(part).select("period_key").distinct().collect()} == {periods[4]}
    rows = spark.createDataFrame([(202401,), (202403,)], "period_key int")
    assert [r[0] for r in latest_period_filter(rows).collect()] == [202403]
    assert spark.range(1).select(latest_value(rows).alias("v")).first()[0] == 202403
