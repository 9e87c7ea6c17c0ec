"""List extraction (D) over the given pages under twelve rule shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.urls import resolve_link
from pageloom.operators import lists
from pageloom.operators import select as sel
from pageloom.operators.rulesets import plan_steps, rule_values, run_rules
from pageloom.plans import duck
from pageloom.plans.registry import query
from pageloom.plans.tables import duck_sql, nodes_table, rule_pages, rule_sources, table, web_pages
from pageloom.session import is_there, materialize

ALL = f"""{duck.ANCHORS},
links AS (SELECT page_id, ix, t AS title, link, {duck.kind('t', 'link')} AS kind FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY ix) AS rn FROM (
    SELECT page_id, ix, {duck.clean(duck.parsed('title'))} AS t, {duck.absolute('href', 'url')} AS link FROM anchors) a
  WHERE length(t) BETWEEN 2 AND 120) b WHERE rn = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ix) AS n FROM links)"""
LINKS = f"WITH {ALL} "

# The text of a whole page, titles and scripts included; a paragraph's end inside quotes is text of a script.
PAGE_TEXT = "replace(" + duck.clean(duck.parsed(
    "regexp_replace(regexp_replace(replace(html, '\"</p>\"', '\"' || chr(2) || '\"'), '<!--.*?-->', '', 'g'), '</?[a-zA-Z!][^>]*>', '', 'g')")) + ", chr(2), '</p>')"

# What each rule shape makes of a page whose list is nav > ul > li > a. Source 3 has no rules: its list is inferred, its items have no address.
ITEMS = f""", raw AS (SELECT a.page_id, a.page_id % 12 AS source_no, a.ix, {duck.clean(duck.parsed('a.title'))} AS t, {duck.resolve('a.href', 'a.url')} AS link,
  max(a.ix) OVER (PARTITION BY a.page_id) AS last FROM anchors a),
texts AS (SELECT p.page_id, p.page_id % 12 AS source_no, {PAGE_TEXT} AS t, coalesce(n, 0) AS n FROM pages p
  LEFT JOIN (SELECT page_id, count(*) AS n FROM anchors GROUP BY page_id) c ON p.page_id = c.page_id),
shaped AS (
  SELECT page_id, source_no, ix, t AS title, link FROM raw WHERE source_no IN (0, 4, 5, 6, 10) OR (source_no = 9 AND last >= 3)
  UNION ALL SELECT page_id, source_no, ix, t, '' FROM raw WHERE source_no = 8 OR (source_no = 3 AND last >= 3)
  UNION ALL SELECT page_id, source_no, ix, t, link FROM raw WHERE source_no = 11 AND ix > 1
  UNION ALL SELECT page_id, source_no, 0, t, '' FROM texts WHERE source_no = 2 OR (source_no = 3 AND n < 3)),
items AS (SELECT page_id, source_no, ix, CASE WHEN title = '' THEN link ELSE title END AS title, link, {duck.kind('title', 'link')} AS kind FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY ix) AS rn FROM shaped) s WHERE (link = '' OR rn = 1) AND (title <> '' OR link <> ''))"""

# What the listing shows: items, or the page's links in their place.
SHOWN = """, n AS (SELECT page_id, count(*) AS n_links FROM numbered GROUP BY page_id),
o AS (SELECT page_id, count(CASE WHEN link <> '' THEN 1 END) AS n_open FROM items GROUP BY page_id),
choice AS (SELECT p.page_id, p.page_id % 12 AS source_no, CASE p.page_id % 12 WHEN 3 THEN coalesce(n_links, 0) > 0 WHEN 7 THEN false
  ELSE coalesce(n_open, 0) = 0 AND coalesce(n_links, 0) >= 3 END AS by_links FROM pages p LEFT JOIN n USING (page_id) LEFT JOIN o USING (page_id)),
shown AS (SELECT c.page_id, CAST(c.source_no AS INT) AS source_no, l.n AS ix, l.title, l.link, true AS fallback FROM choice c JOIN numbered l USING (page_id) WHERE by_links
  UNION ALL SELECT c.page_id, CAST(c.source_no AS INT), i.ix, i.title, i.link, false FROM choice c JOIN items i USING (page_id) WHERE NOT by_links) """

# The bodies by the kind they are of, and what each JSON rule shape takes of which kind.
JSON_BODIES = f""", jb AS (SELECT body_id, 12 + CAST(floor(body_id / 6) AS BIGINT) % 7 AS s, body_id % 6 AS kind, 'https://api.example/list/' || CAST(body_id AS STRING) AS url,
  CASE WHEN json_valid(body) AND regexp_matches(body, '^\\s*[{{\\[]') THEN json(body) END AS v, body FROM fx_json_bodies)"""
JSON_ITEMS = JSON_BODIES + """, je AS (SELECT *, v->('$.data.list[' || CAST(i AS STRING) || ']') AS e FROM jb, (SELECT unnest([0, 1]) AS i) x WHERE kind = 1),
jraw AS (
  SELECT body_id, s, url, i AS ix, coalesce(nullif(e->>'$.title', ''), e->>'$.vod_name') AS title, CASE WHEN s = 12 THEN '/v/' || (e->>'$.aid') ELSE '' END AS href,
    coalesce(e->>'$.vod_pic', '') AS pic, '' AS date FROM je WHERE s = 12 OR (s = 16 AND i = 1)
  UNION ALL SELECT body_id, s, url, 0, coalesce(v->>'$[0].book.title', v->>'$.book.title'), '', '', '' FROM jb WHERE s = 13 AND kind IN (3, 4)
  UNION ALL SELECT body_id, s, url, 1, v->>'$.box.rows2[0].book.title', '', '', '' FROM jb WHERE s = 13 AND kind = 4
  UNION ALL SELECT body_id, s, url, 0, regexp_replace(v->>'$.data[0].name', '[aeiou]', '_', 'g'), v->>'$.data[0].id', '', '2024' FROM jb WHERE s = 14 AND kind = 2
  UNION ALL SELECT body_id, s, url, 0, v->>'$.data[0].name', 'https://x.example/' || (v->>'$.data[0].id') || '?t=2!02!4', '', '2024' FROM jb WHERE s = 15 AND kind = 2 AND body_id > 50
  UNION ALL SELECT body_id, s, url, 0, v->>'$[0].book.title', v->>'$[0].url', '', '' FROM jb WHERE s = 18 AND kind = 3
  UNION ALL SELECT body_id, s, url, 0, CASE WHEN kind = 2 THEN v->>'$.data[0].name' ELSE 'top' END, '', '', CASE WHEN kind = 2 THEN '2024' ELSE '' END FROM jb WHERE s = 18 AND kind IN (2, 4))
"""

_MEMO: dict[tuple[str, str], tuple] = {}


def extracted(spark, sf):
    """Containers and items of all pages, HTML and JSON, extracted in one plan, once per session, and written."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MEMO or not all(map(is_there, _MEMO[key])):
        sources = rule_sources(spark, sf)
        pages, nodes = web_pages(spark, sf)
        rules = lists.page_rules(pages, nodes, sources)
        boxes = materialize(lists.extract_containers(pages, nodes, sources, rules), "containers")
        values = materialize(lists.json_containers(pages, rules), "values")
        items = materialize(lists.extract_list(pages, nodes, sources, boxes, rules, values), "items")
        _MEMO[key] = materialize(lists.all_containers(rules, boxes, values), "all_containers"), items
    return _MEMO[key]


def shown(spark, sf):
    """What the listing of each given page shows."""
    pages, nodes, sources = rule_pages(spark, sf), nodes_table(spark, sf), rule_sources(spark, sf)
    return lists.link_fallback(pages, extracted(spark, sf)[1], lists.content_links(nodes, pages), sources)


@query("d1_extract_list", duck_sql("fx_json_bodies") + ", " + ALL + ITEMS + JSON_ITEMS + f"""
SELECT page_id, CAST(source_no AS INT) AS source_no, title, link, '' AS image, '' AS date, kind FROM items
UNION ALL SELECT -1 - body_id, CAST(s AS INT), title, link, image, date, {duck.kind('title', 'link')} FROM (
  SELECT body_id, s, {duck.clean('title')} AS title, {duck.resolve('href', 'url')} AS link, {duck.absolute('pic', 'url')} AS image, date FROM jraw) j""")
def d1(spark, sf):
    """The items of all pages, HTML and JSON, under all rule shapes."""
    return extracted(spark, sf)[1].select("page_id", "source_no", "title", "link", "image", "date", "kind")


@query("d1_extract_json_list", duck_sql("fx_json_bodies") + f""", v AS (SELECT body_id, json(body) AS v FROM fx_json_bodies WHERE json_valid(body) AND body LIKE '{{"data":{{%'),
e AS (SELECT body_id, i AS ix, v->('$.data.list[' || CAST(i AS STRING) || ']') AS e FROM v, (SELECT unnest([0, 1]) AS i) n)
SELECT body_id, CAST(ix AS INT) AS ix, CASE WHEN coalesce(e->>'$.title', '') <> '' THEN e->>'$.title' ELSE coalesce(e->>'$.vod_name', '') END AS title,
  'https://api.example/v/' || (e->>'$.aid') AS link, CASE WHEN e->>'$.vod_pic' IS NULL THEN '' ELSE 'https://api.example' || (e->>'$.vod_pic') END AS image, '' AS date, 'article' AS kind FROM e""")
def d1_json(spark, sf):
    out = lists.extract_json_list(
        table(spark, sf, "fx_json_bodies"), "$.data.list", {"ruleTitle": "$.title", "ruleLink": "/v/{{$.aid}}"}, F.lit("https://api.example/list?p=1"))
    return out


@query("d2_single_page_items", f"""
SELECT page_id, CAST(page_id % 12 AS INT) AS source_no, title, {duck.kind('title', "''")} AS kind FROM (
  SELECT page_id, {PAGE_TEXT} AS title FROM pages) t WHERE page_id % 12 IN (2, 3, 9)""")
def d2(spark, sf):
    out = lists.single_page_items(rule_pages(spark, sf), nodes_table(spark, sf), rule_sources(spark, sf))
    return out.select("page_id", "source_no", "title", "kind")


@query("d3_field_value", f"WITH {duck.ANCHORS} SELECT page_id, min_by(t, ix) AS value FROM (SELECT page_id, ix, trim({duck.clean(duck.parsed('title'))}) AS t FROM anchors) a WHERE t <> '' GROUP BY page_id")
def d3(spark, sf):
    values = sel.select(nodes_table(spark, sf), "nav@a@text")
    return lists.field_value(values, ["page_id"])


@query("d7_dedup_items", f"WITH {duck.ANCHORS} SELECT host, link, min_by(page_id, page_id * 1000 + ix) AS page_id FROM (SELECT page_id, ix, {duck.origin('url')} AS host, {duck.resolve('href', 'url')} AS link FROM anchors) a GROUP BY host, link")
def d7(spark, sf):
    """The same link on later pages of one host is listed once, at its first page."""
    from pageloom.functions.urls import origin_of

    nodes, pages = nodes_table(spark, sf), table(spark, sf, "pages")
    hrefs = sel.select(nodes, "nav@a@href").join(pages.select("page_id", "url"), "page_id")
    rows = hrefs.select("page_id", origin_of(F.col("url")).alias("host"), resolve_link(F.col("value"), F.col("url")).alias("link"),
                        F.struct("page_id", "node_id").alias("ix"))
    return lists.dedup_items(rows, ["host"]).select("host", "link", "page_id")


@query("d8_content_links", LINKS + "SELECT page_id, CAST(n AS INT) AS ix, title, link, kind FROM numbered WHERE n <= 200")
def d8(spark, sf):
    return lists.content_links(nodes_table(spark, sf), table(spark, sf, "pages"))


@query("d9_link_fallback", LINKS + ITEMS + SHOWN + "SELECT page_id, source_no, title, link, fallback FROM shown")
def d9(spark, sf):
    return shown(spark, sf).select("page_id", "source_no", "title", "link", "fallback")


@query("d10_infer_list_rule", f"WITH {duck.ANCHORS} SELECT page_id, 'ul li@all' AS rule, count(*) AS matches FROM anchors GROUP BY page_id HAVING count(*) >= 3")
def d10(spark, sf):
    return lists.infer_list_rule(nodes_table(spark, sf))


@query("d11_diagnose_list", LINKS + ITEMS + """, n AS (SELECT page_id, count(*) AS n_links FROM numbered GROUP BY page_id),
o AS (SELECT page_id, count(CASE WHEN link <> '' THEN 1 END) AS openable FROM items GROUP BY page_id),
b AS (SELECT page_id, count(*) AS lis FROM anchors GROUP BY page_id),
s AS (SELECT p.page_id, p.page_id % 12 AS k, coalesce(n_links, 0) AS l, coalesce(openable, 0) AS o, coalesce(lis, 0) AS b FROM pages p
  LEFT JOIN n USING (page_id) LEFT JOIN o USING (page_id) LEFT JOIN b USING (page_id)),
f AS (SELECT *, CASE k WHEN 2 THEN l >= 3 WHEN 3 THEN l >= 1 ELSE false END AS shown,
  CASE WHEN k IN (1, 7) THEN 0 WHEN k = 2 THEN 1 WHEN k IN (3, 9) THEN CASE WHEN b >= 3 THEN b ELSE 1 END WHEN k = 11 THEN greatest(b - 1, 0) ELSE b END AS boxes FROM s)
SELECT page_id, CAST(k AS INT) AS source_no, k NOT IN (3, 9) AND NOT shown AS has_rule, CASE WHEN shown THEN 0 ELSE boxes END AS containers,
  CASE WHEN shown THEN l ELSE o END AS openable, CASE WHEN shown OR (o = 0 AND k <> 7 AND l >= 3) THEN l ELSE 0 END AS fallback_links,
  CASE WHEN k IN (3, 9) OR shown THEN NULL WHEN boxes = 0 AND o = 0 AND k <> 7 AND l >= 3 THEN 'rule_matched_nothing' WHEN boxes > 0 AND o = 0 THEN 'nothing_openable' END AS diagnosis FROM f""")
def d11(spark, sf):
    pages, nodes, sources = rule_pages(spark, sf), nodes_table(spark, sf), rule_sources(spark, sf)
    boxes, items = extracted(spark, sf)
    return lists.diagnose_list(lists.list_shape(pages, sources, boxes, items, lists.content_links(nodes, pages)))


@query("d12_next_page", f"""WITH {duck.ANCHORS}, lab AS (SELECT page_id, min_by(href, ix) AS href FROM anchors WHERE lower({duck.clean(duck.parsed('title'))}) LIKE '%en%' GROUP BY page_id),
second AS (SELECT page_id, href FROM anchors WHERE ix = 2 AND page_id % 2 = 0)
SELECT page_id, {duck.absolute('h', 'url')} AS next_url FROM (SELECT p.page_id, p.url, coalesce(s.href, l.href) AS h FROM pages p
  LEFT JOIN second s ON p.page_id = s.page_id LEFT JOIN lab l ON p.page_id = l.page_id) t WHERE h IS NOT NULL""")
def d12(spark, sf):
    nodes, pages = nodes_table(spark, sf), table(spark, sf, "pages")
    # Half of the sources have a rule for the next page, the others go by label.
    ruled = sel.select(nodes, "nav@tag.a.1@href").filter("page_id % 2 = 0").select("page_id", "value")
    return lists.next_page(pages, nodes, ruled, ["en"])


@query("d13_expand_page_urls", duck_sql("fx_source_records") + """
SELECT rec_no, CAST(page AS INT) AS page, CASE WHEN rec_no % 3 = 2 THEN replace(search_url, '{{page<0>}}', CAST(page - 1 AS STRING))
  ELSE replace(search_url, '{{page}}', CAST(page AS STRING)) END AS page_url FROM fx_source_records, (SELECT unnest([1, 2, 3]) AS page) p""")
def d13(spark, sf):
    rows = table(spark, sf, "fx_source_records").select("rec_no", F.col("search_url").alias("template"))
    return lists.expand_page_urls(rows, 1, 3).drop("template")


@query("d14_search_urls", duck_sql("fx_sources") + """
SELECT source_id, n_name AS keyword, CASE WHEN search_url = '' THEN source_url || 'search?keyword=' || q || '&wd=' || q
  WHEN search_url LIKE '/%' THEN rtrim(source_url, '/') || replace(replace(search_url, '{{keyWord}}', replace(n_name, ' ', '%20')), '{{page}}', '1')
  ELSE source_url || replace(replace(search_url, '{{keyWord}}', replace(n_name, ' ', '%20')), '{{page<0>}}', '0') END AS search_page
FROM fx_sources s JOIN customer c ON s.source_id = 's' || CAST(c.c_custkey AS STRING) JOIN (SELECT *, replace(n_name, ' ', '+') AS q FROM nation) n ON c_nationkey = n_nationkey""")
def d14(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("keyword"))
    requests = table(spark, sf, "customer").join(nation, "c_nationkey").select(
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source_id"), "keyword")
    return lists.search_urls(table(spark, sf, "fx_sources"), requests)


@query("d15_needs_render", "SELECT page_id, url, CAST(page_id % 12 AS INT) AS source_no FROM pages WHERE page_id % 12 IN (7, 8) OR (page_id % 12 = 6 AND html NOT LIKE '%<a href=%')")
def d15(spark, sf):
    return lists.needs_render(rule_pages(spark, sf), extracted(spark, sf)[1], rule_sources(spark, sf))


@query("d16_needs_refetch", f"""
SELECT page_id, {duck.absolute("'/moved/' || CAST(page_id AS STRING)", 'url')} AS target FROM pages WHERE page_id % 4 = 1""")
def d16(spark, sf):
    """Every fourth page is served as the empty shell that sends the reader on."""
    shell = F.concat(F.lit('<html><meta http-equiv="refresh" content="0; url=/moved/'), F.col("page_id").cast("string"), F.lit('"></html>'))
    pages = table(spark, sf, "pages").withColumn("html", F.when(F.col("page_id") % 4 == 1, shell).otherwise(F.col("html")))
    return lists.needs_refetch(pages)


@query("rules_over_all_pages", f"""WITH {duck.ANCHORS}
SELECT page_id, 'nav@li@a@href' AS rule_id, href AS value FROM anchors UNION ALL
SELECT page_id, 'ul li@a.0@text', {duck.clean(duck.parsed('title'))} FROM anchors UNION ALL
SELECT page_id, 'li@next@a@href', href FROM anchors WHERE ix > 1 UNION ALL
SELECT page_id, 'ul@child.0@children@href', href FROM anchors WHERE ix = 1""")
def rules_over_all_pages(spark, sf):
    """Four rules over every page in one run (rules are rows, not operators)."""
    nodes = nodes_table(spark, sf)
    texts = ["nav@li@a@href", "ul li@a.0@text", "li@next@a@href", "ul@child.0@children@href"]
    rule_rows = spark.createDataFrame([(t, t) for t in texts], "rule_id string, rule string")
    start = nodes.filter("node_id = 0").select(
        "page_id", F.explode(F.array(*[F.lit(t) for t in texts])).alias("rule_id"), F.lit(0).alias("ctx"), "node_id",
        F.array().cast("array<int>").alias("ord"))
    return rule_values(run_rules(nodes, start, plan_steps(rule_rows)), nodes).select("page_id", "rule_id", "value")
