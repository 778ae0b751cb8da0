"""The prepared image index: same look-ups as a plain search, written once, read by key."""

import json
import random

from pyspark.sql import functions as F

from tessera.operators.image_index import image_index, images_of_key, lookup, write_lookup
from tessera.session import scratch_path


def _brute(query, keys, aliases):
    q = query.strip().lower()
    if q in keys:
        return q, "exact"
    if q in aliases:
        return aliases[q], "alias"
    near = [(abs(len(k) - len(q)), k) for k in keys if q and (q in k or k in q)]
    return (min(near)[1], "partial") if near else (None, None)


def test_lookups_match_a_plain_search(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ab-01") for _ in range(n))
    keys = sorted({word(r.randrange(1, 9)) for _ in range(150)})
    rows = [(k, f"Alias {i % 40}" if i % 3 == 0 else None, i) for i, k in enumerate(keys)]
    aliases = {}
    for k, a, i in rows:
        if a:
            aliases[a.lower()] = k  # the last folder wins
    images = spark.createDataFrame([(k, a, (0, i)) for k, a, i in rows], "key string, alias string, folder_order struct<s:long,f:long>")
    queries = [word(r.randrange(1, 14)) for _ in range(200)] + [k.upper() + " " for k in keys[:20]] + ["ALIAS 3", "alias 39", "", "  ", "zzz", "zzz"]
    index = write_lookup(images, scratch_path(spark, "test-lookup"))
    got = sorted((x.query, x.key or "-", x.method or "-") for x in lookup(spark.createDataFrame([(q,) for q in queries], "query string"), index).collect())
    want = sorted((q, *(x or "-" for x in _brute(q, set(keys), aliases))) for q in queries)
    assert got == want


def _tree(path, keys):
    state = {"pos": 0, "id": 1, "estado": "E", "type": "folder", "children": [
        {"k": k, "name": k, "alias": f"old {k}", "type": "folder", "children": [{"i": f"{k}-{j}", "n": f"{j}.jpg"} for j in range(3)]} for k in keys]}
    path.write_text(json.dumps(state) + "\n")


def test_an_index_is_written_once_and_again_when_the_tree_changes(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    tree = tmp_path / "tree" / "a.json"
    _tree(tree, ["i-01-001-01", "i-01-001-02"])
    first = image_index(spark, str(tmp_path / "tree"))
    again = image_index(spark, str(tmp_path / "tree"))
    assert again.path == first.path
    _tree(tree, ["i-01-001-01", "i-01-001-02", "i-01-001-03"])
    changed = image_index(spark, str(tmp_path / "tree"))
    assert changed.path != first.path and changed.keys().count() == 3 and first.keys().count() == 2


def test_one_key_reads_one_partition(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    _tree(tmp_path / "tree" / "a.json", [f"i-01-{i:03d}-01" for i in range(200)])
    index = image_index(spark, str(tmp_path / "tree"))
    df = images_of_key(index, " I-01-007-01 ")
    assert sorted(r.file_id for r in df.collect()) == [f"i-01-007-01-{j}" for j in range(3)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "EqualTo(key,i-01-007-01)" in plan
    assert df.select(F.input_file_name()).distinct().count() == 1
    assert images_of_key(index, "OLD i-01-009-01").count() == 3 and images_of_key(index, "x i-01-011-01 y").count() == 3
    assert images_of_key(index, "nothing").count() == 0


def test_files_meet_the_replaced_folders_only(spark, tmp_path):
    from tessera.operators.images import read_state_nodes, scan_image_tree
    folder = lambda k, *files: {"k": k, "name": k, "type": "folder", "children": [{"i": i, "n": i} for i in files]}
    nodes = [{"pos": 1, "id": 1, "estado": "E", "type": "folder", "children": [folder("a", "a1", "a2"), folder("b", "b1"), folder("a", "a3", None)]},
             {"pos": 2, "id": 2, "estado": "F", "type": "folder", "children": [folder("a"), folder("b", None), folder("c", "c1")]},
             {"pos": 2, "id": 3, "estado": "G", "type": "folder", "children": [folder("", "x"), folder("d", "d1"), folder("c", "c2")]}]
    (tmp_path / "tree.json").write_text("".join(json.dumps(n) + "\n" for n in nodes))
    df = scan_image_tree(read_state_nodes(spark, str(tmp_path / "tree.json")))
    # the last folder with files has the key; folders of equal place both have it
    assert sorted(r.file_id for r in df.collect()) == ["a3", "b1", "c1", "c2", "d1"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "LeftAnti" in plan  # files are not reduced again to find the last folders


def test_gram_counts_are_summed_before_the_shuffle(spark):
    from tessera.operators.image_index import _all_grams, _gram_freq
    grams = _all_grams(spark.createDataFrame([("aab",), ("ab",), ("b",)], "key string"), "key")
    freq = _gram_freq(grams, "key")
    assert {r.g: r.df for r in freq.collect()} == {"a": 2, "b": 3, "aa": 1, "ab": 2, "aab": 1}
    plan = freq._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1


def test_image_tree_is_dealt_by_its_rows(spark, tmp_path, monkeypatch):
    """More tasks than the session's shuffle partitions where the rows need them; every image is in the tree."""
    from tessera.operators.images import read_state_nodes, scan_image_tree
    from tessera.plans import testqueries as tq
    from tessera.sources import panel
    rows = (spark.range(40 * 20 * 3)  # 40 states of 20 facilities, three periods each
            .select((F.col("id") % 40).cast("int").alias("estado_id"), (F.floor(F.col("id") / 40) % 20).alias("k"),
                    F.lit(2024).alias("anio"), (F.floor(F.col("id") / 800) + 1).cast("int").alias("mes"))
            .select("estado_id", F.format_string("NATION_%d", "estado_id").alias("estado"), "anio", "mes",
                    F.format_string("I-%02d-%03d-00", "estado_id", "k").alias("clave"),
                    (F.col("anio") * 100 + F.col("mes")).alias("period_key"), F.lit(1).cast("long").alias("cn_total")))
    monkeypatch.setattr(tq, "panel", lambda *a: rows)
    monkeypatch.setattr(panel, "ROWS_PER_WRITER", 50)
    tq._write_image_tree(spark, "", str(tmp_path / "tree"))
    assert len(list((tmp_path / "tree").glob("part-*"))) > 16
    got = scan_image_tree(read_state_nodes(spark, str(tmp_path / "tree")))
    assert (got.count(), got.select("key").distinct().count(), got.select("file_id").distinct().count()) == (2400, 800, 2400)
