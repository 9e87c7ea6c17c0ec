"""Sources and sinks (A) and the source library (B) over derived records."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pageloom.functions.hashing import source_id
from pageloom.operators import audit, library
from pageloom.operators.nodes import shred_pages
from pageloom.plans.registry import query
from pageloom.plans.tables import DENSE_PART_BYTES, duck_sql, table
from pageloom.session import materialize, shared_dir, spread
from pageloom.sources import collections as coll
from pageloom.sources import index as idx
from pageloom.sources import tables as tabs

RECORDS = duck_sql("fx_source_records")
SOURCES = duck_sql("fx_sources")


def _record_json(rows):
    """Source records as JSON text: modern and legacy ones, some broken."""
    n = F.col("rec_no")
    modern = F.to_json(F.struct(
        F.when(n % 13 != 0, F.col("url")).alias("sourceUrl"), F.col("name").alias("sourceName"), F.col("source_group").alias("sourceGroup"),
        F.col("custom_order").alias("customOrder"), F.col("header").alias("header"), F.col("sort_url").alias("sortUrl"),
        F.col("rule_articles").alias("ruleArticles"), F.col("rule_title").alias("ruleTitle"), F.col("rule_link").alias("ruleLink"),
        F.col("rule_content").alias("ruleContent"), F.col("search_url").alias("searchUrl"), F.col("enable_js").alias("enableJs"),
        F.struct(n.alias("a")).alias("strange")))
    legacy = F.to_json(F.struct(
        F.when(n % 13 != 0, F.col("url")).alias("sourceUrl"), F.col("name").alias("sourceName"), F.col("rule_link").alias("articleUrl"),
        F.col("rule_title").alias("itemTitle"), F.lit("").alias("itemContent"), F.col("rule_content").alias("itemDescription"),
        F.when(n % 4 == 1, F.lit("x@src")).alias("itemImage"), F.lit(False).alias("enabledCookieJar")))
    bad_type = F.concat(F.lit('{"sourceUrl":"https://x.example","customOrder":"'), F.col("name"), F.lit('"}'))
    return rows.select("rec_no", F.when(n % 19 == 0, F.lit("7")).when(n % 17 == 0, bad_type).when(n % 2 == 0, modern).otherwise(legacy).alias("text"))


def _files(spark, sf):
    """Collection files of at most ten records each, in four shapes."""
    rows = _record_json(table(spark, sf, "fx_source_records")).withColumn("file_no", F.floor(F.col("rec_no") / 10))
    rows = spread(rows, "file_no", DENSE_PART_BYTES)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_no", "text"))), lambda x: x["text"]), ",")
    files = rows.groupBy("file_no").agg(body.alias("list"))
    k = F.col("file_no") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("["), F.col("list"), F.lit("]")))
        .when(k == 1, F.concat(F.lit('{"data":7,"list":['), F.col("list"), F.lit("]}")))
        .when(k == 2, F.concat(F.lit('{"result":[1],"sources":['), F.col("list"), F.lit("]}")))
        .when(k == 3, F.concat(F.lit("["), F.col("list"))).otherwise(F.concat(F.lit('{"other":['), F.col("list"), F.lit("]}"))))
    return files.select("file_no", text.alias("body"))


GOOD = """good AS (SELECT rec_no, CAST(floor(rec_no / 10) AS BIGINT) AS file_no, r.* EXCLUDE (rec_no) FROM fx_source_records r
  WHERE floor(rec_no / 10) % 5 < 3 AND rec_no % 19 <> 0 AND rec_no % 17 <> 0)"""


@query("a1_split_collections", RECORDS + f""", {GOOD}
SELECT file_no, 'record' AS part, url AS detail FROM good WHERE rec_no % 13 <> 0
UNION ALL SELECT CAST(floor(rec_no / 10) AS BIGINT), 'reject', CASE WHEN rec_no % 19 = 0 THEN 'not_an_object' ELSE 'bad_type:customOrder' END
  FROM fx_source_records WHERE floor(rec_no / 10) % 5 < 3 AND (rec_no % 19 = 0 OR rec_no % 17 = 0)
UNION ALL SELECT DISTINCT CAST(floor(rec_no / 10) AS BIGINT), 'reject', CASE WHEN floor(rec_no / 10) % 5 = 3 THEN 'not_json' ELSE 'no_source_array' END
  FROM fx_source_records WHERE floor(rec_no / 10) % 5 >= 3""")
def a1(spark, sf):
    good, rejects = coll.split_collections(_files(spark, sf), "file_no")
    urls = good.select("file_no", F.lit("record").alias("part"), F.try_variant_get("record", F.lit("$.sourceUrl"), "string").alias("detail"))
    return urls.unionByName(rejects.select("file_no", F.lit("reject").alias("part"), F.col("reason").alias("detail")))


@query("a1_read_collection", RECORDS + f", {GOOD} SELECT url FROM good WHERE rec_no % 13 <> 0")
def a1_files(spark, sf):
    """The same files written out one by one and read back as a folder of collections."""
    folder = os.path.join(shared_dir(spark), "tables", f"collections-{spark.sparkContext.applicationId}")
    # A file for each row, all in one folder: a folder for each file would be listed by a task of its own.
    _files(spark, sf).select("body").write.mode("overwrite").option("maxRecordsPerFile", 1).text(folder)
    good, _ = coll.read_collection(spark, folder)
    return good.select(F.try_variant_get("record", F.lit("$.sourceUrl"), "string").alias("url"))


@query("b1_normalize_sources", RECORDS + f""", {GOOD}
SELECT url AS source_url, name AS source_name, CASE WHEN rec_no % 2 = 0 THEN custom_order ELSE 0 END AS custom_order,
  CASE WHEN rec_no % 2 = 0 THEN search_url ELSE '' END AS search_url, rec_no % 2 = 0 AND enable_js AS enable_js, rec_no % 2 = 0 AS enabled_cookie_jar,
  true AS load_with_base_url, CASE WHEN rec_no % 2 = 0 THEN '{{"a":' || CAST(rec_no AS STRING) || '}}' END AS strange, CASE WHEN rec_no % 2 = 0 THEN 1 ELSE 3 + CAST(rec_no % 4 = 1 AS INT) END AS n_extra
FROM good WHERE rec_no % 13 <> 0""")
def b1(spark, sf):
    out = coll.normalize_sources(coll.split_collections(_files(spark, sf), "file_no")[0])
    return out.select("source_url", "source_name", "custom_order", "search_url", "enable_js", "enabled_cookie_jar", "load_with_base_url",
                      F.col("extra")["strange"].alias("strange"),
                      F.size(F.map_filter("extra", lambda k, v: ~k.isin("itemContent"))).alias("n_extra"))


@query("b2_upgrade_legacy", RECORDS + f""", {GOOD}
SELECT url, rule_link, rule_title, rule_content, CASE WHEN rec_no % 4 = 1 THEN 'x@src' ELSE '' END AS rule_image,
  CASE WHEN rec_no % 2 = 0 THEN rule_articles WHEN rule_link = '' OR contains(rule_link, '{{{{page}}}}') OR contains(rule_link, 'java.') THEN 'body' ELSE '' END AS rule_articles
FROM good WHERE rec_no % 13 <> 0""")
def b2(spark, sf):
    out = coll.upgrade_legacy(coll.split_collections(_files(spark, sf), "file_no")[0])
    return out.select(F.try_variant_get("record", F.lit("$.sourceUrl"), "string").alias("url"), "rule_link", "rule_title", "rule_content", "rule_image", "rule_articles")


def _index_pages(spark, sf):
    s = table(spark, sf, "supplier")
    n = F.col("s_suppkey")
    key = n.cast("string")
    card = F.concat(
        F.lit('<html><body><div class="box ylist"><h2><a href="/x/content/id/'), key, F.lit('.html">'), F.col("s_name"), F.lit('</a><p> 4 days</p></h2><span>用户: U'), key,
        F.lit("</span><span>源数量:"), (n % 90).cast("string"), F.lit("</span><span>下载:1"), key, F.lit('</span></div><div class="ylist">no link</div><div class="ylist"><a href="/dl/9'),
        key, F.lit('.json?x=1">Direct</a><a href="/c/'), key, F.lit('">page</a></div></body></html>'))
    row = F.concat(
        F.lit('<table><tbody class="layui-table-tbody"><tr><td><a href="/x/content/id/'), key, F.lit('.html">'), F.col("s_name"),
        F.lit("</a><td>09/15<td>用户：U"), key, F.lit("<td>源数量: "), (n % 90).cast("string"), F.lit("<td>下载: 1"), key, F.lit("<tr><td>no link</table>"))
    return s.select(n.alias("page_id"), F.lit("https://repo.example/x/index.html").alias("url"), F.when(n % 3 == 0, row).otherwise(card).alias("html"))


@query("a2_read_collection_index", """
SELECT CAST(s_suppkey AS STRING) AS id, s_name AS title, 'U' || CAST(s_suppkey AS STRING) AS author, CAST(s_suppkey % 90 AS BIGINT) AS source_count,
  CAST('1' || CAST(s_suppkey AS STRING) AS BIGINT) AS downloads, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '4 days' END AS date,
  'https://repo.example/x/content/id/' || CAST(s_suppkey AS STRING) || '.html' AS page_url, 'https://repo.example/x/json/id/' || CAST(s_suppkey AS STRING) || '.json' AS download_url FROM supplier
UNION ALL SELECT CAST(s_suppkey AS STRING), 'Direct', '', 0, 0, '', 'https://repo.example/c/' || CAST(s_suppkey AS STRING),
  'https://repo.example/dl/9' || CAST(s_suppkey AS STRING) || '.json?x=1' FROM supplier WHERE s_suppkey % 3 <> 0""")
def a2(spark, sf):
    pages = _index_pages(spark, sf)
    nodes = materialize(shred_pages(pages), "index-nodes")
    return idx.read_collection_index(nodes, pages).drop("coll_key", "page_id", "error")


@query("a3_index_urls", """
SELECT s_suppkey, CAST(p AS INT) AS page, 'https://r' || CAST(s_suppkey AS STRING) || '.example' || CASE WHEN p = 1 THEN '/index.html' ELSE '/index_' || CAST(p AS STRING) || '.html' END AS index_page_url
FROM supplier, (SELECT unnest([1, 2, 3, 4]) AS p) n""")
def a3(spark, sf):
    sites = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("https://r"), F.col("s_suppkey").cast("string"), F.lit(".example//")).alias("base"))
    return idx.index_urls(sites, 4, idx.IndexPaths()).drop("base")


@query("a4_discover_download_url", """
SELECT page_id AS coll_key, CASE page_id % 5 WHEN 0 THEN 'https://repo.example/f/' || CAST(page_id AS STRING) || '.json' WHEN 1 THEN 'https://repo.example/f/other.json?v=2'
  WHEN 2 THEN 'https://repo.example/a/b/json/id/' || CAST(page_id AS STRING) || '.json' WHEN 3 THEN 'https://repo.example/json/id/' || CAST(page_id AS STRING) || '.json' END AS download_url,
  CASE WHEN page_id % 5 = 4 THEN 'no_download_address' END AS error FROM pages""")
def a4(spark, sf):
    k = F.col("page_id")
    text = k.cast("string")
    page = F.when(k % 5 == 2, F.concat(F.lit("https://repo.example/a/b/content/id/"), text, F.lit(".html"))).when(
        k % 5 == 3, F.concat(F.lit("https://repo.example/content/id/"), text, F.lit(".html"))).otherwise(F.concat(F.lit("https://repo.example/c/"), text))
    colls = table(spark, sf, "pages").select(k.alias("coll_key"), page.alias("page_url"), F.lit("https://repo.example/i.html").alias("base"))
    hrefs = F.when(k % 5 == 0, F.array(F.lit("f/other.json?v=2"), F.concat(F.lit("/f/"), text, F.lit(".json")), F.lit("/style.css"))).when(
        k % 5 == 1, F.array(F.lit("/c/1"), F.lit("f/other.json?v=2"))).otherwise(F.array(F.lit("/about.html")))
    links = table(spark, sf, "pages").select(k.alias("coll_key"), F.posexplode(hrefs).alias("ix", "href"))
    return idx.discover_download_url(links, colls, idx.IndexPaths()).select("coll_key", "download_url", "error")


@query("a6_read_pages", "SELECT page_id, url FROM pages")
def a6(spark, sf):
    return tabs.read_pages(spark, f"{sf}/pages.parquet", ["page_id", "url"])


@query("a7_save_table", duck_sql("fx_progress") + "SELECT user_id, url, ratio FROM fx_progress WHERE ratio > 0.5")
def a7(spark, sf):
    """Positions saved by reader, then replaced by a part of themselves and read back."""
    path = os.path.join(shared_dir(spark), "tables", f"progress-{spark.sparkContext.applicationId}")
    rows = table(spark, sf, "fx_progress").select("user_id", "url", "ratio")
    tabs.save_table(rows, path, "user_id")
    tabs.save_table(tabs.load_table(spark, path).filter("ratio > 0.5"), path, "user_id")
    return tabs.load_table(spark, path).select("user_id", "url", "ratio")


@query("a8_export_report", duck_sql("fx_stages") + """, v AS (SELECT run_no, bool_or(state = 'fail') AS f, bool_or(state = 'warn') AS w, max(usable) AS u FROM fx_stages GROUP BY run_no),
l AS (SELECT run_no, string_agg('- ' || CASE state WHEN 'ok' THEN '✓' WHEN 'warn' THEN '!' WHEN 'fail' THEN '✕' ELSE '–' END || ' ' || key || ': ' || detail || ' ('
  || CASE WHEN run_no * stage_no = 0 THEN '' WHEN run_no * stage_no < 1000 THEN CAST(run_no * stage_no AS STRING) || 'ms' ELSE CAST((run_no * stage_no + 50) // 100 // 10 AS STRING) || '.' || CAST((run_no * stage_no + 50) // 100 % 10 AS STRING) || 's' END || ')', chr(10) ORDER BY stage_no) AS t FROM fx_stages GROUP BY run_no)
SELECT '## ' || CAST(p.page_id AS STRING) || chr(10) || p.url || chr(10) || CASE WHEN p.page_id % 10 = 3 THEN 'not checked' ELSE
  CASE WHEN f THEN '✕ fail' WHEN w OR u = 0 THEN '! warn' ELSE '✓ ok' END || chr(10) || t END AS text
FROM pages p JOIN v ON p.page_id = v.run_no JOIN l ON p.page_id = l.run_no""")
def a8(spark, sf):
    s = table(spark, sf, "fx_stages").withColumn("source_id", F.col("run_no").cast("string"))
    folded = s.groupBy("source_id").agg(F.bool_or(F.col("state") == "fail").alias("f"), F.bool_or(F.col("state") == "warn").alias("w"), F.max("usable").alias("u"))
    kind = F.when(F.col("source_id").cast("bigint") % 10 == 3, "none").when(F.col("f"), "fail").when(F.col("w") | (F.col("u") == 0), "warn").otherwise("ok")
    pages = table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("source_id"), "url")
    verdicts = folded.withColumn("overall", kind).join(pages, "source_id").select(
        "source_id", F.col("source_id").alias("name"), "url", "overall", F.col("overall").alias("status"))
    stages = s.select("source_id", "stage_no", F.col("key").alias("label"), "state", "detail", (F.col("run_no") * F.col("stage_no")).alias("ms"))
    return tabs.export_report(verdicts, stages)


def _library_and_batch(spark, sf):
    r = table(spark, sf, "fx_source_records").select(
        "rec_no", F.col("name").alias("source_name"), F.col("url").alias("source_url"), "rule_articles")
    old = r.filter("rec_no % 7 = 0").groupBy("source_name", "source_url").agg(F.min_by("rule_articles", "rec_no").alias("rule_articles"))
    lib = old.select(source_id(F.col("source_name"), F.col("source_url")).alias("source_id"), "source_name", "source_url", "rule_articles",
                     F.lit(True).alias("enabled"), F.lit("old").alias("collection"))
    return lib, r.filter("rec_no % 7 <> 0")


MERGE = RECORDS + """, lib AS (SELECT name, url, min_by(rule_articles, rec_no) AS rule_articles FROM fx_source_records WHERE rec_no % 7 = 0 GROUP BY ALL),
fresh AS (SELECT name, url, min_by(rule_articles, rec_no) AS rule_articles FROM fx_source_records r WHERE rec_no % 7 <> 0
  AND NOT EXISTS (SELECT 1 FROM lib WHERE lib.name = r.name AND lib.url = r.url) GROUP BY ALL) """


@query("b3_merge_sources", MERGE + """SELECT name AS source_name, url AS source_url, rule_articles, 'old' AS collection FROM lib
UNION ALL SELECT name, url, rule_articles, 'batch' FROM fresh""")
def b3(spark, sf):
    lib, batch = _library_and_batch(spark, sf)
    merged, _ = library.merge_sources(lib, batch, "batch", F.lit(0), "rec_no")
    return merged.select("source_name", "source_url", "rule_articles", "collection")


@query("b3_merge_counts", MERGE + "SELECT (SELECT count(*) FROM fresh) AS added, (SELECT count(*) FROM fx_source_records WHERE rec_no % 7 <> 0) - (SELECT count(*) FROM fresh) AS skipped")
def b3_counts(spark, sf):
    lib, batch = _library_and_batch(spark, sf)
    return library.merge_sources(lib, batch, "batch", F.lit(0), "rec_no")[1]


@query("b4_source_id", RECORDS + "SELECT rec_no, substr(sha256(name || '|' || url), 1, 16) AS source_id FROM fx_source_records")
def b4(spark, sf):
    return table(spark, sf, "fx_source_records").select("rec_no", source_id(F.col("name"), F.col("url")).alias("source_id"))


CATEGORIES = SOURCES + r""", lines AS (SELECT source_id, i - 1 AS ln, l[i] AS line FROM (SELECT source_id, l, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT source_id, string_split(sort_url, chr(10)) AS l FROM fx_sources) a) b),
cells AS (SELECT source_id, ln, j - 1 AS cn, trim(c[j]) AS cell FROM (SELECT source_id, ln, c, unnest(range(1, len(c) + 1)) AS j
    FROM (SELECT source_id, ln, string_split(trim(line), '$$$') AS c FROM lines) d) e),
named AS (SELECT source_id, trim(regexp_extract(cell, '^(.*)::', 1)) AS n, trim(regexp_extract(cell, '^.*::(.*)$', 1)) AS category_url, CAST(ln * 100 + cn AS INT) AS "row"
  FROM cells WHERE contains(cell, '::') AND trim(regexp_extract(cell, '^.*::(.*)$', 1)) <> ''),
cats AS (SELECT source_id, CASE WHEN n = '' THEN '默认' ELSE n END AS name, category_url, "row" FROM named
  UNION ALL SELECT source_id, '首页', source_url, 0 FROM fx_sources WHERE source_id NOT IN (SELECT source_id FROM named)) """


@query("b5_explode_categories", CATEGORIES + """SELECT source_id, name, category_url, "row", contains(category_url, '{{page}}') AS paged FROM cats""")
def b5(spark, sf):
    return library.explode_categories(table(spark, sf, "fx_sources"))


@query("b7_patch_sources", SOURCES + """
SELECT source_id, CASE WHEN custom_order = 3 THEN false ELSE enabled END AS enabled, CASE WHEN custom_order IN (3, 4) THEN true ELSE favorite END AS favorite,
  CASE WHEN custom_order = 4 THEN 99 ELSE custom_order END AS custom_order FROM fx_sources""")
def b7(spark, sf):
    s = table(spark, sf, "fx_sources")
    o = F.col("custom_order")
    patches = s.filter(o.isin(3, 4)).select("source_id", F.when(o == 3, False).alias("new_enabled"), F.lit(True).alias("new_favorite"),
                                            F.when(o == 4, F.lit(99).cast("bigint")).alias("new_custom_order"))
    return library.patch_sources(s, patches).select("source_id", "enabled", "favorite", "custom_order")


@query("b8_remove_sources", SOURCES + "SELECT source_id, (SELECT count(*) FROM fx_sources WHERE custom_order = 5) AS removed FROM fx_sources WHERE custom_order <> 5")
def b8(spark, sf):
    s = table(spark, sf, "fx_sources")
    ids = s.filter("custom_order = 5").select("source_id").unionByName(spark.range(1).select(F.lit("unknown").alias("source_id")))
    kept, gone = library.remove_sources(s, ids)
    return kept.select("source_id").crossJoin(gone)  # one row


@query("b9_list_sources", SOURCES + """SELECT source_id, source_name FROM fx_sources WHERE lower(source_name) LIKE '%uto%' OR lower(source_url) LIKE '%uto%'
OR lower(source_group) LIKE '%uto%' OR lower(collection) LIKE '%uto%'""")
def b9(spark, sf):
    return library.list_sources(table(spark, sf, "fx_sources"), " UTO ").select("source_id", "source_name")


@query("b10_group_by_collection", SOURCES + """
SELECT CASE WHEN collection = '' THEN '其他' ELSE collection END AS group_name, count(*) OVER (PARTITION BY collection) AS group_size, source_id,
  source_name AS display_name, custom_order FROM fx_sources""")
def b10(spark, sf):
    return library.group_by_collection(table(spark, sf, "fx_sources"))


@query("b11_source_summary", CATEGORIES + """SELECT s.source_id, source_name AS display_name, count(*) AS category_count, search_url <> '' AS has_search, enable_js AS js_enabled
FROM fx_sources s JOIN cats c ON s.source_id = c.source_id GROUP BY ALL""")
def b11(spark, sf):
    return library.source_summary(table(spark, sf, "fx_sources"))


@query("b12_library_stats", duck_sql("fx_sources", "fx_history") + """
SELECT count(*) AS sources, count(CASE WHEN enabled THEN 1 END) AS enabled, count(CASE WHEN favorite THEN 1 END) AS favorites,
  count(CASE WHEN has_health THEN 1 END) AS checked, count(CASE WHEN has_health AND health_ok THEN 1 END) AS working,
  (SELECT count(DISTINCT collection) FROM fx_sources) AS collections, (SELECT count(*) FROM fx_history) AS history FROM fx_sources""")
def b12(spark, sf):
    s = table(spark, sf, "fx_sources")
    return library.library_stats(s, s.select("collection").distinct(), table(spark, sf, "fx_history"))


@query("b13_upsert_collections", """
SELECT url, name, added_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY added_at DESC) AS rn FROM (
  SELECT 'c' || CAST(o_custkey AS STRING) AS url, o_orderpriority AS name, o_orderdate + to_seconds(o_orderkey) AS added_at FROM orders) a) b WHERE rn = 1
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), c_name, TIMESTAMP '2020-01-01' FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), s_name, TIMESTAMP '2020-01-01' FROM supplier""")
def b13(spark, sf):
    """Customers and suppliers are there already; orders come in, for customers only."""
    there = lambda name, mark, key, label: table(spark, sf, name).select(
        F.concat(F.lit(mark), F.col(key).cast("string")).alias("url"), F.col(label).alias("name"), F.lit("2020-01-01").cast("timestamp_ntz").alias("added_at"))
    c = there("customer", "c", "c_custkey", "c_name").union(there("supplier", "s", "s_suppkey", "s_name"))
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("url"), F.col("o_orderpriority").alias("name"),
        F.timestamp_add("SECOND", F.col("o_orderkey").cast("int"), F.col("o_orderdate")).cast("timestamp_ntz").alias("added_at"))
    return library.upsert_collections(c, o)


@query("b14_largest_collections", "SELECT o_custkey AS id, count(*) AS source_count FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def b14(spark, sf):
    sizes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("source_count"))
    return library.largest_collections(sizes)


@query("b15_rule_construct_census", RECORDS + """, b AS (SELECT collection, concat_ws(chr(10), rule_articles, rule_title, rule_link, rule_content) AS blob FROM fx_source_records),
h AS (SELECT collection, c, (length(blob) - length(replace(blob, c, ''))) // length(c) AS n FROM b,
  (SELECT unnest([':matches(', ':contains(', ':starts-with(', ':ends-with(', ':regex(', '@XPath', '$.', '$$.']) AS c) k)
SELECT collection, c AS construct, count(CASE WHEN n > 0 THEN 1 END) AS sources, CAST(sum(n) AS BIGINT) AS hits FROM h GROUP BY ALL""")
def b15(spark, sf):
    return library.rule_construct_census(
        table(spark, sf, "fx_source_records"), ["rule_articles", "rule_title", "rule_link", "rule_content"], by=("collection",))


@query("b17_find_sources", duck_sql("fx_sources", "fx_history") + """
SELECT source_id, source_url FROM fx_sources WHERE source_id IN (SELECT source_id FROM fx_history)
UNION ALL SELECT source_id, source_url FROM fx_sources WHERE source_url IN (SELECT 'https://site' || CAST(page_id AS STRING) || '.example/' FROM pages)""")
def b17(spark, sf):
    s = table(spark, sf, "fx_sources").select("source_id", "source_url")
    urls = table(spark, sf, "pages").select(F.concat(F.lit("https://site"), F.col("page_id").cast("string"), F.lit(".example/")).alias("source_url"))
    return library.find_sources(s, table(spark, sf, "fx_history").select("source_id")).unionByName(library.find_sources(s, urls, "source_url"))


@query("g2_probe_category", CATEGORIES + """, r AS (SELECT c.source_id, c.name, c.category_url, s.source_url, c."row",
  CASE WHEN rtrim(c.category_url, '/') = '' OR rtrim(c.category_url, '/') = rtrim(s.source_url, '/') THEN 0 WHEN NOT regexp_matches(lower(c.name), '搜索|搜|search|keyword') THEN 1 ELSE 2 END AS k
  FROM cats c JOIN fx_sources s ON c.source_id = s.source_id)
SELECT source_id, CASE WHEN k = 2 THEN '首页' ELSE name END AS category, CASE WHEN k = 2 THEN source_url ELSE category_url END AS category_url
FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY k, "row") AS rn FROM r) t WHERE rn = 1""")
def g2(spark, sf):
    return audit.probe_category(table(spark, sf, "fx_sources"))


@query("g3_stage_rule", CATEGORIES + """, n AS (SELECT source_id, count(*) AS n FROM cats GROUP BY 1)
SELECT s.source_id, 'rule' AS key, 'ok' AS state, CASE WHEN rule_articles = '' AND rule_title = '' AND rule_link = '' THEN 'bare_address' WHEN rule_articles = 'body' AND rule_link = '' THEN 'single_page'
  WHEN rule_articles = '' AND rule_content = '' THEN 'missing:ruleArticles,ruleContent' WHEN rule_articles = '' THEN 'missing:ruleArticles'
  WHEN rule_content = '' THEN 'missing:ruleContent' ELSE 'complete' END AS code, 'categories=' || CAST(n AS STRING) AS detail FROM fx_sources s JOIN n ON s.source_id = n.source_id""")
def g3(spark, sf):
    return audit.stage_rule(table(spark, sf, "fx_sources"))


NOW_S = 1704067200 + 7 * 86400


@query("g1_audit_scope", SOURCES + f"""
SELECT 'failed' AS scope, source_id FROM fx_sources WHERE has_health AND NOT health_ok UNION ALL SELECT 'unchecked', source_id FROM fx_sources WHERE NOT has_health
UNION ALL SELECT 'stale', source_id FROM fx_sources WHERE NOT has_health OR NOT health_ok OR {NOW_S} - checked_s > 259200
UNION ALL SELECT 'all', source_id FROM fx_sources WHERE source_id IN (SELECT 's' || CAST(page_id AS STRING) FROM pages)""")
def g1(spark, sf):
    s = table(spark, sf, "fx_sources")
    ids = table(spark, sf, "pages").select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("source_id"))
    parts = [audit.audit_scope(s, scope, NOW_S).select(F.lit(scope).alias("scope"), "source_id") for scope in ("failed", "unchecked", "stale")]
    parts.append(audit.audit_scope(s, "all", NOW_S, ids).select(F.lit("all").alias("scope"), "source_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
