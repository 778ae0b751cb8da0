"""Raw sources: files of mixed encodings, records over lines, coordinate documents, file times."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.binding import DEFAULT as B
from tessera.plans.reports import coordinate_table, report_coordinates
from tessera.sources.delimited import describe_files, scan_delimited
from tessera.sources.freshness import file_freshness, first_source
from tessera.sources.json_sources import scan_coordinate_documents
from tessera.sources.panel import first_load_materialise


def test_each_file_has_its_own_encoding_and_line_breaks(spark, tmp_path):
    d = tmp_path / "raw folder"
    d.mkdir()
    (d / "a.csv").write_bytes("Año,Estado\n2024,México\n2025,Yucatán\n".encode("utf-8"))
    (d / "b.csv").write_bytes("Año,Estado\n2024,México\n".encode("latin-1"))
    (d / "c.csv").write_bytes('Año,Estado\n2023,"Nuevo\nLeón"\n2022,"a ""b"", c"\n'.encode("utf-8"))
    (d / "d e.csv").write_bytes('Año,Estado\r\n2021,"San Luis\r\nPotosí"\r\n'.encode("latin-1"))
    (d / "f.csv").write_bytes("﻿Estado,Extra,Año\nJalisco,x,2020\n".encode("utf-8"))
    df = scan_delimited(spark, str(d))
    got = sorted((r["Año"], r["Estado"].replace("\r\n", "\n"), r["Extra"]) for r in df.collect())
    assert got == sorted([("2024", "México", None), ("2025", "Yucatán", None), ("2024", "México", None), ("2023", "Nuevo\nLeón", None),
                          ("2022", 'a "b", c', None), ("2021", "San Luis\nPotosí", None), ("2020", "Jalisco", "x")])
    kinds = {os.path.basename(r.file): (r.encoding, r.spans) for r in describe_files(spark, str(d)).collect()}
    assert kinds == {"a.csv": ("utf-8", False), "b.csv": ("iso-8859-1", False), "c.csv": ("utf-8", True),
                     "d%20e.csv": ("iso-8859-1", True), "f.csv": ("utf-8", False)}


def test_one_plain_file_and_a_tab_file(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("a\tb\n1\t2\n")
    (tmp_path / "y.csv").write_text("a,b\n\\,2\n")
    assert scan_delimited(spark, str(tmp_path / "x.tsv")).collect() == [("1", "2")]
    assert scan_delimited(spark, str(tmp_path / "y.csv")).collect() == [("\\", "2")]


def test_the_cleaning_job_takes_a_mixed_folder(spark, tmp_path):
    from tessera.plans.jobs import job_clean_panel
    d = tmp_path / "raw"
    d.mkdir()
    (d / "a.csv").write_bytes('Clave Plaza,Estado,Año,Cve-mes,Nombre\nI-01-001-01,México,2024,1,"Uno\ndos"\n'.encode("utf-8"))
    (d / "b.csv").write_bytes("Clave Plaza,Estado,Año,Cve-mes,Nombre\nI-01-001-02,Yucatán,2024,2,Tres\n".encode("latin-1"))
    panel, _ = job_clean_panel(spark, str(d))
    assert sorted((r.clave, r.estado, r.nombre, r.period_key) for r in panel.collect()) == [
        ("I-01-001-01", "México", "Uno\ndos", 202401), ("I-01-001-02", "Yucatán", "Tres", 202402)]


GOOD = [{"clave": "k1", "nombre": "n", "lat": 19.1234567, "lng": "-99.5"}, {"clave": None, "lat": "x", "lng": 1}, {"lat": 1},
        {"clave": 7, "nombre": 0, "estado": False, "municipio": "0", "localidad": True, "lat": True, "lng": " 2.5 "},
        {"clave": "k3", "lat": None, "lng": 1}, {"clave": "", "lat": 0, "lng": 0}]


def test_coordinate_documents(spark, tmp_path):
    put = lambda name, doc: (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=1)) and str(tmp_path / name)
    texts = ["nombre", "estado", "municipio", "localidad", "situacion"]
    rows = lambda path: sorted(tuple(r) for r in scan_coordinate_documents(spark, path, texts).collect())
    assert rows(put("good.json", GOOD)) == sorted([("k1", 19.123457, -99.5, "n", "", "", "", ""), ("7", 1.0, 2.5, "", "", "0", "True", ""),
                                                   ("", 0.0, 0.0, "", "", "", "", "")])
    for name, doc in (("object.json", {"a": GOOD}), ("empty.json", []), ("first.json", [{"clave": "k"}, *GOOD]), ("text.json", "nothing [ here"),
                      ("broken.json", json.dumps(GOOD)[:-5]), ("numbers.json", [GOOD[0], 5]), ("null.json", "null")):
        assert rows(put(name, doc)) == [], name
    assert rows(str(tmp_path / "absent.json")) == []


@pytest.mark.parametrize("doc, from_document", [(GOOD, True), ({"a": 1}, False), ([{"clave": "k"}], False), (None, False)])
def test_coordinates_come_from_the_document_first(spark, tmp_path, doc, from_document):
    path = tmp_path / "c.json"
    if doc is not None:
        path.write_text(json.dumps(doc))
    latest = spark.createDataFrame([("p1", "P", "E", "M", None, 1, 20.0000001, -100.0), ("p2", "Q", "E", "M", "L", 0, None, 1.0)],
                                   "clave string, nombre string, estado string, municipio string, localidad string, situacion int, lat double, lng double")
    rows = sorted(tuple(r) for r in coordinate_table(latest, B, str(path)).collect())
    if from_document:
        assert [r[0] for r in rows] == ["", "7", "k1"]
    else:
        assert rows == [("p1", 20.0, -100.0, "P", "E", "M", "", "1")]
    assert report_coordinates(latest, B, str(path))[1].agg(F.sum("points")).first()[0] == len(rows)


def test_file_times(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    stamps = {"a.parquet": dt.datetime(2024, 3, 31, 12), "b.csv": dt.datetime(2023, 12, 15, 1), "sub/c.csv": dt.datetime(2024, 1, 31, 23)}
    for name, t in stamps.items():
        (tmp_path / name).write_text("x" * len(name))
        os.utime(tmp_path / name, (t.replace(tzinfo=dt.timezone.utc).timestamp(),) * 2)
    got = {r.file: (r.bytes, r.shown, r.shown_reference, r.stale) for r in file_freshness(spark, [str(tmp_path)], "2025-04-30", 400).collect()}
    assert got == {"a.parquet": (9, "29/02/2024", "29/02/2024", False), "b.csv": (5, "15/11/2023", "15/12/2023", True), "c.csv": (9, "31/12/2023", "31/12/2023", True)}
    assert first_source(spark, [str(tmp_path / "none.parquet"), str(tmp_path / "b.csv")]).endswith("b.csv")
    assert first_source(spark, [str(tmp_path / "none.parquet")]) is None


def test_file_times_of_the_given_tables(spark):
    from tessera.plans import testqueries as tq
    sf = "/root/testdata/sf0.001"
    got = {r.file: (r.bytes, r.modified.replace(tzinfo=None)) for r in tq.QUERIES["source_file_freshness"][0](spark, sf).select(
        "file", "bytes", F.col("modified").cast("timestamp_ntz").alias("modified")).collect()}
    for name, (size, when) in got.items():
        s = os.stat(f"{sf}/{name}")
        assert size == s.st_size and abs((when - dt.datetime.fromtimestamp(s.st_mtime, dt.timezone.utc).replace(tzinfo=None)).total_seconds()) < 1
    assert len(got) == sum(n.endswith(".parquet") for n in os.listdir(sf))


def test_a_first_load_of_one_period_is_spread(spark, tmp_path, monkeypatch):
    from tessera.sources import panel
    monkeypatch.setattr(panel, "writer_tasks", lambda df, *a: 8)
    df = spark.range(4000).select(F.lit(202401).alias("period_key"), F.col("id").cast("string").alias("clave"))
    out = first_load_materialise(spark, df, str(tmp_path / "t"))
    assert out.count() == 4000 and out.select(F.input_file_name()).distinct().count() == 8


def _files(spark, path):
    return spark.read.parquet(path).select(F.input_file_name()).distinct().count()


def test_writers_are_as_many_as_their_rows_need(spark, tmp_path, monkeypatch):
    from tessera.sources import panel, testbind
    monkeypatch.setattr(panel, "ROWS_PER_WRITER", 500, raising=False)
    spark.range(4000).select(F.lit(202401).alias("period_key"), F.col("id").cast("string").alias("clave")).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))  # some kB
    panel.sink_panel_partitioned(df, str(tmp_path / "a"), ("period_key",), "clave", tasks=3)
    testbind.write_panel(df, str(tmp_path / "b"))
    first_load_materialise(spark, df, str(tmp_path / "c"))
    for name in "abc":
        got = spark.read.parquet(str(tmp_path / name))
        assert _files(spark, str(tmp_path / name)) == 8 and got.select("clave").distinct().count() == got.count() == 4000, name
    testbind.write_panel(df, str(tmp_path / "d"), rows=2000)
    panel.sink_panel_partitioned(df, str(tmp_path / "e"), ("period_key",), "clave", tasks=12)
    assert (_files(spark, str(tmp_path / "d")), _files(spark, str(tmp_path / "e"))) == (4, 12)


def test_panel_shuffles_are_sized_by_rows(spark, tmp_path, monkeypatch):
    import datetime as dt
    import re
    from tessera.sources import testbind
    d, day = str(tmp_path / "t"), lambda i: dt.datetime(2024, 1 + i % 3, 1)
    rows = {
        "orders": ([(i if i != 7 else None, i % 4 if i != 5 else None, "OFP"[i % 3], day(i)) for i in range(40)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp"),
        "lineitem": ([(i % 50 if i % 9 else None, float(i), "NAR"[i % 3] if i % 11 else None) for i in range(300)], "l_orderkey long, l_quantity double, l_returnflag string"),
        "customer": ([(i, f"c{i}", i % 2, "BUILDING") for i in (0, 1, 2, 3, 3)], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "nation": ([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "R")], "r_regionkey int, r_name string")}
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{d}/{name}.parquet")
    whole = sorted(testbind.derive_panel(spark, d).collect(), key=str)
    monkeypatch.setattr(testbind, "ROWS_PER_TASK", 2, raising=False)
    df = testbind.derive_panel(spark, d)
    dealt = re.findall(r"hashpartitioning\(([a-z_]+)[^)]*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())
    assert sorted(set(dealt)) == [("anio", "20"), ("c_custkey", "20"), ("custkey", "20"), ("l_orderkey", "150"), ("o_orderkey", "150")]
    assert sorted(df.collect(), key=str) == whole
    lines = {}
    for k, q, _ in rows["lineitem"][0]:
        lines.setdefault(k, []).append(q)
    want = {}
    for k, c, _, when in rows["orders"][0]:
        if k is not None and c is not None and k in lines:
            want.setdefault((f"c{c}", when.month), []).extend(lines[k])
    assert sorted((r.nombre, r.mes, r.inc_total, r.aten_total) for r in whole) == sorted(
        (c, m, sum(map(int, q)), len(q)) for (c, m), q in want.items() for _ in range(2 if c == "c3" else 1))
