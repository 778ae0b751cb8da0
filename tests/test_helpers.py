"""Driver-side helpers and JSON goldens (FIXTURES.md §2, §4, §5)."""

from pyspark.sql import functions as F

from tessera.operators.clean import resolve_aliases, standardise_types
from tessera.operators.images import image_lookup_cascade, key_alias
from tessera.operators.schema import (detect_period_columns, detect_schema_variant, rename_long_to_short,
                                      rename_short_to_long, resolve_role)
from tessera.functions.text import normalise_facility_key


def test_resolve_aliases_golden():
    mapping, report = resolve_aliases(["Clave Plaza", "  ENTIDAD federativa ", "CODIGO POSTAL", "Foo"])
    rep = {f: (s, m) for f, s, m in report}
    assert rep["clave"] == ("Clave Plaza", "exact")
    assert rep["estado"] == ("  ENTIDAD federativa ", "normalised")
    assert rep["cp"] == ("CODIGO POSTAL", "normalised")
    assert rep["lat"] == (None, "not_found")
    assert "Foo" not in mapping


def test_standardise_defaults(spark):
    df = spark.createDataFrame([(" K1 ", "2.5", "x", "19.43°", "En operación")],
                               "clave string, inc_total string, mes string, lat string, situacion string")
    r = standardise_types(df).first()
    assert (r.clave, r.inc_total, r.mes, r.lat, r.situacion, r.nombre, r.cn_total) == ("K1", 2, 1, 19.43, 1, None, None)


def test_schema_detection(spark):
    assert detect_schema_variant(["clave", "lat", "lng"]) == "short"
    assert detect_schema_variant(["Clave_Plaza", "Latitud", "Longitud"]) == "long"
    df = spark.createDataFrame([("Enero", "3", "2024")], "Mes string, `Cve-mes` string, `Año` string")
    assert detect_period_columns(df) == ("Cve-mes", "Año")
    df2 = spark.createDataFrame([("Enero", "2024")], "Mes string, year string")
    assert detect_period_columns(df2) == (None, "year")
    roles = resolve_role(["Clave Plaza", "LATITUD", "longitud"],
                         {"key": ("clave_plaza", "clave"), "lat": ("latitud",), "lng": ("longitud",), "name": ("nombre",)},
                         required=("key", "lat", "lng"))
    assert roles == {"key": "Clave Plaza", "lat": "LATITUD", "lng": "longitud", "name": None}


def test_rename_round_trip(spark):
    df = spark.createDataFrame([("K", 1.0, 2024)], "clave string, lat double, anio int")
    long = rename_short_to_long(df)
    assert long.columns == ["Clave_Plaza", "Latitud", "Año"]
    assert rename_long_to_short(long).columns == df.columns


def test_key_alias_golden(spark):
    names = ["MEXICO_I-15-086-02", "i-21-061-02", "I-021-001-16", "PLAZA CROC MAZATLAN"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    k = normalise_facility_key("n")
    got = [tuple(r) for r in df.select(k.alias("k"), key_alias(F.col("n"), k).alias("a")).collect()]
    assert got == [("i-15-086-02", "MEXICO_I-15-086-02"), ("i-21-061-02", None), ("i-021-001-16", None),
                   ("plaza croc mazatlan", "PLAZA CROC MAZATLAN")]


def test_image_lookup_golden(spark):
    imgs = spark.createDataFrame(
        [("i-15-086-02", None, "f1", (0, 0)), ("plaza croc mazatlan", "PLAZA CROC MAZATLAN", "f2", (0, 1)),
         ("i-15-086-021", None, "f3", (0, 2))],
        "key string, alias string, file_id string, folder_order struct<a:int,b:int>")
    q = spark.createDataFrame([("i-15-086-02",), ("PLAZA CROC MAZATLAN",), ("i-15-086",), ("zz",)], "query string")
    got = {r.query: (r.key, r.method) for r in image_lookup_cascade(q, imgs).collect()}
    assert got["i-15-086-02"] == ("i-15-086-02", "exact")
    assert got["PLAZA CROC MAZATLAN"] == ("plaza croc mazatlan", "exact")
    assert got["i-15-086"] == ("i-15-086-02", "partial")
    assert got["zz"] == (None, None)


def test_latest_filter_prunes_partitions(spark):
    from tessera.plans import testqueries as tq
    plan = tq._latest(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "period_key" in plan and "CartesianProduct" not in plan


def test_dim_encode_decode_golden(spark):
    from tessera.operators import dims
    df = spark.createDataFrame([(" jalisco ",), ("Mexico",), ("México",)], "t string")
    exact = {r.t: r.i for r in dims.dim_encode(df, "t", "i", spark, accent_insensitive=False).collect()}
    folded = {r.t: r.i for r in dims.dim_encode(df, "t", "i", spark, accent_insensitive=True).collect()}
    assert exact == {" jalisco ": 14, "Mexico": 15, "México": 0}
    assert folded == {" jalisco ": 14, "Mexico": 15, "México": 15}
    ids = spark.createDataFrame([(14,), (99,), (None,)], "g int")
    got = {r.g: r.name for r in dims.dim_decode(ids, "g", dims.states_dim(spark), "name", "Estado_").collect()}
    assert got == {14: "Jalisco", 99: "Estado_99", None: ""}


def test_fixed_dictionaries_do_not_shuffle_the_rows(spark, tmp_path):
    from tessera.operators import dims
    spark.range(100).select((F.col("id") % 3).cast("int").alias("g"), (F.col("id") % 40).cast("int").alias("e")).write.parquet(str(tmp_path / "t"))
    df = dims.dim_decode(spark.read.parquet(str(tmp_path / "t")), "g", dims.statuses_dim(spark), "status", "S_")
    df = dims.dim_decode(df, "e", dims.states_dim(spark), "state", "E_")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan
    assert {r["g"]: r["status"] for r in df.collect()} == dict(dims.STATUSES[:3])
    names = dict(dims.STATES)
    assert {r["e"]: r["state"] for r in df.collect()} == {i: names.get(i, f"E_{i}") for i in range(40)}
    assert dims.states_dim(spark).dtypes == dims.statuses_dim(spark).dtypes == [("dim_id", "int"), ("dim_name", "string")]


def test_period_index_forms(spark, tmp_path):
    import json
    from tessera.sources.json_sources import scan_period_index
    a = tmp_path / "a.json"
    a.write_text(json.dumps({"index": {"2025-01": {"name": "x", "id": "1", "download_url": "u1"},
                                       "2025-02": {"name": "y", "id": "2"}}}))
    b = tmp_path / "b.json"
    b.write_text(json.dumps({"2026-10": {"name": "z", "id": "3", "view_url": "v3"}}))
    entries, disc = scan_period_index(spark, [str(a), str(b)])
    assert sorted((r.period, r.url) for r in entries.collect()) == [("2025-01", "u1"), ("2026-10", "v3")]
    assert tuple(disc.first()) == (1, 2)


def test_cleaning_keeps_month_code_and_month_name_apart(spark, tmp_path):
    from tessera.plans.jobs import job_clean_panel
    (tmp_path / "a.csv").write_bytes("CCT,Year,Cve mes,Mes,Entidad,Otra\nK1,2024,3,Marzo,Jalisco,z\nK2,2024,4,Abril,México,z\n".encode("latin-1"))
    panel, report = job_clean_panel(spark, str(tmp_path / "a.csv"))
    got = sorted((r.clave, r.period_key, r.estado_id, r.mes) for r in panel.collect())
    assert got == [("K1", 202403, 14, 3), ("K2", 202404, 15, 4)]
    assert (None, "Otra", "unknown") in report
    (tmp_path / "b.csv").write_text("Clave,Ejercicio,Estado\nK1,2024,Nowhere\n")
    row = job_clean_panel(spark, str(tmp_path / "b.csv"))[0].first()
    assert (row.mes, row.period_key, row.estado_id) == (1, 202401, 0)


def test_every_field_has_its_headers():
    from tessera.operators.clean import ALIASES, FLOAT_FIELDS, INT_FIELDS, STRING_FIELDS
    assert {*STRING_FIELDS, *INT_FIELDS, *FLOAT_FIELDS, "mes", "situacion"} <= set(ALIASES) and len(ALIASES) == 49 + 1 - 1
    assert ALIASES["inc_prim"][:5] == ("Inc_Prim", "Inscripciones Primaria", "Inc. Prim", "Inscritos Primaria", "Inscripciones Nivel Primaria")
    assert ALIASES["aten_sec"][:4] == ("Aten_Sec", "Atenciones Secundaria", "Aten. Sec", "Atenciones Nivel Secundaria")


def test_competing_spellings_of_every_field():
    # of two columns, both spelled as accepted, the one further up goes first, whatever their order in the file
    from tessera.operators.clean import ALIASES, HEADERS, resolve_aliases
    assert len(HEADERS) == 49
    for field, names in HEADERS:
        only, names = {field: ALIASES[field]}, list(dict.fromkeys(names))
        for first, second in zip(names[:-1], names[1:]):
            for columns in ([first, second], [second, first]):
                assert resolve_aliases(columns, only)[0] == {first: field}, (field, first, second)


def test_upper_case_headers_beside_others():
    from tessera.operators.clean import resolve_aliases
    for taken, left in (("CLAVE", "CCT"), ("ESTADO", "Entidad"), ("SITUACION", "Status"), ("NUM", "Número"), ("MUNICIPIO", "Delegación"),
                        ("LATITUD", "Lat"), ("LONGITUD", "Lon"), ("AÑO", "Year"), ("LOCALIDAD", "Ciudad"), ("COLONIA", "Barrio"),
                        ("CALLE", "Avenida"), ("COORD. ZONA", "Zona"), ("CLAVE_EDO", "Cve_Edo"), ("MES", "Month"), ("Número Exterior", "No Ext"),
                        ("Examenes aplicados", "Exámenes")):
        mapping = resolve_aliases([left, taken])[0]
        assert taken in mapping and left not in mapping, (taken, left)


def test_numeric_columns_are_read_as_numbers(spark):
    df = spark.createDataFrame([(12345678.0, 1.5e7, "1,234")], "inc_total double, lat double, inc_prim string")
    r = standardise_types(df).first()
    assert (r.inc_total, r.lat, r.inc_prim) == (12345678, 1.5e7, 1234)


def test_first_spelling_per_level(spark):
    from tessera.binding import DEFAULT as B
    from tessera.operators.hierarchy import hierarchy_index
    rows = [("E", "Z", "Bácum", "L1", "k1", 2), ("E", "Z", "BACUM", "L2", "k2", 1), ("E", "Z", "Bacum", "L3", "k3", 3)]
    out = hierarchy_index(spark.createDataFrame(rows, "estado string, zona string, municipio string, localidad string, clave string, o int"), B, "o").collect()
    assert {r.municipality for r in out} == {"BACUM"} and {r.group_rows for r in out} == {3} and len(out) == 3


def test_dictionary_threshold(spark):
    from tessera.operators.aggregates import column_distinct_ratio
    df = spark.range(10).selectExpr("id % 6 as c")
    flag = lambda t: column_distinct_ratio(df, ["c"], t).first()["dictionary_candidate"]
    assert flag(0.75) and not flag(0.5) and not flag(0.25)


def test_sketches_merge_over_periods_and_come_near_the_exact_counts(spark):
    from tessera.operators.aggregates import column_distinct_ratio, column_sketches, sketched_distinct_ratio
    df = spark.range(60_000).selectExpr("cast(id % 7 as int) as period_key", "cast(id % 20011 as string) as a", "id % 5 as b", "cast(null as string) as c")
    whole = column_sketches(df, ["a", "b", "c"])
    assert whole.count() == 21
    exact = {r.column: (r.rows, r.distinct, r.dictionary_candidate) for r in column_distinct_ratio(df, ["a", "b", "c"]).collect()}
    for source in (whole, column_sketches(df.where("period_key < 3"), ["a", "b", "c"]).unionByName(column_sketches(df.where("period_key >= 3"), ["a", "b", "c"]))):
        for r in sketched_distinct_ratio(source).collect():
            rows, n, flag = exact[r.column]
            assert r.rows == rows and abs(r.distinct - n) <= 0.03 * n and r.dictionary_candidate == flag
    assert sketched_distinct_ratio(column_sketches(df.limit(0), ["a"])).count() == 0
