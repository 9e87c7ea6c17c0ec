"""Sources and sinks, and what is registered for the driver."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from pageloom.operators.nodes import shred_pages
from pageloom.plans.tables import DERIVED, GIVEN
from pageloom.session import Scratch, materialize
from pageloom.sources import collections as coll
from pageloom.sources import index as idx
from pageloom.sources import tables as tabs

MODERN = {"sourceName": "Site", "sourceUrl": "https://a/", "ruleArticles": "class.item@all", "ruleTitle": "a@text", "ruleLink": "a@href",
          "sortUrl": "All::/{{page}}", "weird": [1, 2]}
LEGACY = {"title": "Old", "sourceUrl": "https://b/", "articleUrl": "https://b/{{page}}", "itemTitle": "t", "itemDescription": "d", "itemContent": ""}


def normalized(spark, *records, wrap=lambda r: json.dumps(r)):
    files = spark.createDataFrame([(1, wrap(list(records)))], "file int, body string")
    good, rejects = coll.split_collections(files, "file")
    return coll.normalize_sources(good).orderBy("ix").collect(), rejects.collect()


def test_both_generations_of_records(spark):
    (a, b), rejects = normalized(spark, MODERN, LEGACY)
    assert (a["source_name"], a["rule_articles"], a["sort_url"], a["enabled_cookie_jar"], a["extra"]) == (
        "Site", "class.item@all", "All::/{{page}}", True, {"weird": "[1,2]"})
    assert (b["rule_link"], b["rule_title"], b["rule_content"], b["rule_articles"]) == ("https://b/{{page}}", "t", "d", "body")
    assert rejects == []


def test_new_names_win_over_legacy_ones(spark):
    (a,), _ = normalized(spark, {**LEGACY, "ruleLink": "", "ruleArticles": "x"})
    assert (a["rule_link"], a["rule_articles"]) == ("", "x")


@pytest.mark.parametrize("key", ["data", "sources", "list", "items", "result"])
def test_wrapped_collections(spark, key):
    rows, _ = normalized(spark, MODERN, wrap=lambda r: json.dumps({"count": 1, key: r}))
    assert len(rows) == 1


def test_bad_records_are_set_aside(spark):
    rows, rejects = normalized(spark, MODERN, 5, {"sourceUrl": " "}, {"sourceUrl": "https://c", "enableJs": "yes"})
    assert len(rows) == 1 and sorted(r["reason"] for r in rejects) == ["bad_type:enableJs", "not_an_object"]


def test_files_with_nothing_usable_are_errors(spark, tmp_path):
    for name, text in {"a": json.dumps([MODERN]), "b": "[1, 2]", "c": "{nope", "d": '{"x": 1}'}.items():
        (tmp_path / name).write_text(text)
    good, rejects = coll.read_collection(spark, str(tmp_path))
    whole = {r["file"][-1]: r["reason"] for r in rejects.filter("ix = -1").collect()}
    assert good.count() == 1 and whole == {"b": "no_usable_source", "c": "not_json", "d": "no_source_array"}


CARDS = """<div class="ylist"><h2><a href="/r/content/id/203.html">Own</a><p class="m"> 4 days</p></h2><span>用户: JB</span><span>源数量:71</span><span>下载:11958</span></div>
<div class="ylist"><h2><a href="/c/7">Bare</a></h2></div><div class="ylist">none</div>"""
TABLE = """<table><tbody class="layui-table-tbody"><tr><td><a href="/r/content/id/5.html">T</a></td><td>4 days</td><td>用户：U</td><td>源数量: 6</td><td>下载: 18,485</td></tr></tbody></table>
<table><tbody><tr><td><a href="/r/content/id/6.html">other table</a></td></tr></tbody></table>"""


def test_index_pages(spark):
    pages = spark.createDataFrame([(1, "https://s.example/r/index.html", CARDS), (2, "https://s.example/r/index.html", TABLE)], "page_id long, url string, html string")
    rows = idx.read_collection_index(shred_pages(pages), pages, idx.IndexPaths(json="/r/json/id/{id}.json")).orderBy("page_id", "id").collect()
    got = [(r["id"], r["title"], r["author"], r["source_count"], r["downloads"], r["date"], r["download_url"], r["error"]) for r in rows]
    assert got == [
        ("203", "Own", "JB", 71, 11958, "4 days", "https://s.example/r/json/id/203.json", None),
        ("7", "Bare", "", 0, 0, "", None, "no_download_address"),
        ("5", "T", "U", 6, 18485, "T", "https://s.example/r/json/id/5.json", None)]


def test_tables_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    tabs.save_table(spark.range(100).withColumn("user_id", F.col("id") % 3), path, "user_id")
    tabs.save_table(tabs.load_table(spark, path).filter("id < 10"), path, "user_id")
    assert tabs.load_table(spark, path).count() == 10
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


@pytest.mark.parametrize("failing", [".old-", ".staging-"])
def test_a_failed_rename_leaves_the_old_table(spark, tmp_path, monkeypatch, failing):
    path, real = str(tmp_path / "t"), tabs._renamed
    tabs.save_table(spark.range(5), path)

    def refuse(fs, source, target):
        moved = target if failing == ".old-" else source
        return False if failing in moved.toString() else real(fs, source, target)

    monkeypatch.setattr(tabs, "_renamed", refuse)
    with pytest.raises(OSError):
        tabs.save_table(spark.range(9), path)
    assert tabs.load_table(spark, path).count() == 5


def test_materialized_tables_keep_pruning_and_scratch_is_removed(spark):
    df = materialize(spark.range(10).withColumn("b", F.lit("x")), "t")
    plan = df.filter("id = 3").select("id")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "PushedFilters: [IsNotNull(id), EqualTo(id,3)]" in plan
    with Scratch(spark) as scratch:
        folder = scratch.folder
        assert scratch.keep(spark.range(5), "x").count() == 5
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_bucketed_nodes_are_joined_in_place(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}") for i in range(20)], "page_id long, url string, html string")
    nodes = tabs.save_nodes(shred_pages(pages), "bucketed_nodes", str(tmp_path / "n"), 4)
    kids = nodes.select("page_id", F.col("parent_id").alias("up"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = nodes.groupBy("page_id").agg(F.max("depth").alias("d")).join(kids.groupBy("page_id").agg(F.count("*").alias("n")), "page_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_nodes")


def test_registered_queries_and_sql_belong_together():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120
    for text in DERIVED.values():
        assert any("{" + t + "}" in text for t in [*GIVEN, *DERIVED]), "a derived table that reads nothing"


def test_entry_runs(spark):
    assert driver.entry(spark).limit(5).count() == 5
