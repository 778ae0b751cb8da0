"""The prefix table of the hierarchy: places of every level, their spellings and children."""

from tessera.binding import DEFAULT as B
from tessera.operators.hierarchy import children_of, hierarchy_index, prefix_table, write_prefix_table
from tessera.session import scratch_path

SCHEMA = "estado string, zona string, municipio string, localidad string, clave string, o int"
ROWS = [("México", "Zona 1", "Abc", "Uno", "K1", 2), ("MEXICO", "zona 1", "ABC", "uno", "k1", 1), ("mexico ", "Zona 1", "Abc", "Dos", "K2", 3),
        ("México", "Zona 2", "Abc", "Uno", "K3", 1), ("Jalisco", "Zona 1", "Def", "Tres", "K4", 5), ("Jalisco", "Zona 1", None, "Tres", "K5", 1),
        ("Jalisco", " ", "Def", "Tres", "K6", 1)]


def test_places_of_every_level(spark):
    got = {(r.level, *[p for p in r[1:6] if p is not None]): (r.name, r.rows) for r in prefix_table(spark.createDataFrame(ROWS, SCHEMA), B, "o").collect()}
    assert got[1, "MEXICO"] == ("MEXICO", 4) or got[1, "MEXICO"] == ("México", 4)
    assert got[2, "MEXICO", "ZONA 1"] == ("zona 1", 3) and got[2, "MEXICO", "ZONA 2"] == ("Zona 2", 1)
    assert got[3, "MEXICO", "ZONA 1", "ABC"] == ("ABC", 3) and got[5, "MEXICO", "ZONA 1", "ABC", "UNO", "K1"] == ("k1", 2)
    assert got[1, "JALISCO"] == ("Jalisco", 1) and sum(k[0] == 5 for k in got) == 4
    for level in range(1, 6):
        assert sum(v[1] for k, v in got.items() if k[0] == level) == 5  # every level holds all complete rows


def test_children_read_their_level_only(spark):
    table = write_prefix_table(spark.createDataFrame(ROWS, SCHEMA), scratch_path(spark, "test-prefix"), B, "o")
    names = lambda *path: [r.name for r in children_of(table, *path).collect()]
    assert names() == ["Jalisco", names()[1]] and names("México") == ["Zona 2", "zona 1"]
    assert names("mexico", "ZONA 1") == ["ABC"] and names("mexico", "zona 1", "abc") == ["Dos", "uno"] and names("nowhere") == []
    plan = children_of(table, "mexico")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in plan


def test_the_panel_is_scanned_once(spark):
    from tessera.plans import testqueries as tq
    plan = hierarchy_index(tq.panel(spark, "/root/testdata/sf0.001"), B, "period_key")._jdf.queryExecution().optimizedPlan().toString()
    assert "period_key" not in plan and plan.count("Relation") == 5  # levels of the prefix table
