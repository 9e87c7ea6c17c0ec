"""Steps that grow with the tables: dealt over the cores, computed once, from the smaller side."""

import os
import random

from pyspark.sql import functions as F

from pageloom.operators import marks, reading
from pageloom.operators.nodes import shred_pages
from pageloom.plans import QUERIES
from pageloom.plans.tables import table

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"
CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"


def written(spark, path, rows, schema):
    """Rows as one file, which is read as one part."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return str(path)


def parts(spark, folder, n=6000):
    names = random.Random(5)
    rows = [(i, f"n{names.random()}", f"B{i % 7}", f"T{names.random()}", i % 50) for i in range(n)]
    written(spark, folder / "part.parquet", rows, PART)
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_json_bodies_are_dealt_over_the_cores(spark, tmp_path):
    bodies = table(spark, parts(spark, tmp_path), "fx_json_bodies")
    assert bodies.select("body_id").distinct().count() == bodies.count() == 6000
    used = bodies.select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 3


def test_lookups_parse_a_body_once(spark, tmp_path):
    out = QUERIES["e12_lookup_verdict"](spark, parts(spark, tmp_path, 60))
    optimized = plan(out).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimized.count("parseJson(") == 1
    got = {r["body_id"]: (r["verdict"], r["broken"], r["filtered"], r["deep"]) for r in out.collect()}
    assert got[1] == ("empty_values", "bad_path", "no_match", "values")
    assert got[2] == ("no_match", "bad_path", "values", "no_match")
    assert got[5] == ("no_match", "bad_path", "no_match", "no_match")


def test_forms_of_paths_come_to_the_bodies(spark, tmp_path):
    out = QUERIES["e4_json_forms"](spark, parts(spark, tmp_path, 60))
    physical = plan(out).split("== Physical Plan ==")[1]
    assert "SortMergeJoin" not in physical and "BroadcastHashJoin" in physical
    rows = {(r["form"], r["ix"]): r["text"] for r in out.filter("body_id = 7").collect()}
    assert rows[1, 0] == "8" and rows[9, 0] == "8" and rows[9, 1] == "7"


def test_pages_of_a_small_file_are_shredded_in_many_parts(spark, tmp_path):
    noise = random.Random(3)
    rows = [(i, f"<p>{noise.random()}{noise.random()}</p>") for i in range(3000)]
    pages = spark.read.parquet(written(spark, tmp_path / "pages", rows, "page_id long, html string"))
    assert shred_pages(pages).rdd.getNumPartitions() > 3


def test_collections_lie_in_one_folder(spark, tmp_path, monkeypatch):
    from pageloom.plans import q_library

    rows = [(i, f"C{i}", i % 25, "BUILDING") for i in range(200)]
    written(spark, tmp_path / "customer.parquet", rows, CUSTOMER)
    read = []
    whole = q_library.coll.read_collection
    monkeypatch.setattr(q_library.coll, "read_collection", lambda s, path: (read.append(path), whole(s, path))[1])
    out = QUERIES["a1_read_collection"](spark, str(tmp_path))
    files = [n for n in os.listdir(read[0].removeprefix("file:")) if n.startswith("part-")]
    assert len(files) == 20  # ten records each
    good = [i for i in range(200) if i // 10 % 5 < 3 and i % 19 and i % 17 and i % 13]
    assert sorted(r["url"] for r in out.collect()) == sorted(f"https://site{i}.example/" for i in good)


def test_ids_of_highlights_are_computed_once(spark):
    shape = "user_id long, id string, url string, text string, note string, created_s long"
    stored = spark.createDataFrame([(1, "hx", "u", "old", "n", 1)], shape)
    batch = spark.createDataFrame([(1, "", "u", " new ", "", 2), (1, "", "u", "old", "", 3), (1, "", "u", "new", "", 4)], shape)
    added, _ = marks.add_highlights(stored, batch, "created_s")
    assert "aggregate(" not in plan(marks.update_notes(added, added.select("user_id", "id", F.lit("x").alias("new_note")))[0]).lower()
    assert {(r["text"], r["created_s"]) for r in added.collect()} == {("old", 1), ("new", 2)}


def test_readers_are_looked_up_from_their_smaller_side(spark, monkeypatch):
    # Long lists on the shelves of readers with few positions, and a link on very many lists for a reader of short lists.
    items = [("long", "c", f"l{i}") for i in range(500)] + [(f"s{i}", "c", "hot") for i in range(500)] + [("s1", "c", "own"), ("s1", "c", "own")]
    shelf = [(u, "long", "c") for u in range(30)] + [(99, "s1", "c"), (None, "long", "c")]
    progress = [(u, f"l{u}", 0.99) for u in range(30)] + [(99, "hot", 0.5), (99, "own", 0.99), (None, "l1", 0.99)]
    sent = []
    whole = reading.join_skewed
    monkeypatch.setattr(reading, "join_skewed", lambda *a: (sent.append(whole(*a)), sent[-1])[1])
    out = reading._items_read(
        spark.createDataFrame(shelf, "user_id long, source_id string, category string"),
        spark.createDataFrame(items, "source_id string, category string, link string"),
        spark.createDataFrame(progress, "user_id long, url string, ratio float"))
    want = sorted((u, s, c, round(r, 2)) for u, s, c in shelf if u is not None for t, d, link in items if (s, c) == (t, d) for v, m, r in progress if (u, link) == (v, m))
    assert sorted((r[0], r[1], r[2], round(r[3], 2)) for r in out.collect()) == want
    assert max(rows.count() for rows in sent) < 100
