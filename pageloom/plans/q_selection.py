"""Element selection (C) over the given pages.

The pages are regular enough for regular expressions to say what a selection
must find, which is what the SQL side does.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.user import register_rule_function, rule_function
from pageloom.operators import select as sel
from pageloom.plans import duck
from pageloom.plans.registry import query
from pageloom.plans.tables import duck_sql, nodes_table, table

LI = """lis AS (SELECT page_id, i AS ix, a AS li, regexp_extract(a, '<a href="([^"]*)">', 1) AS href, regexp_replace(a, '<[^>]*>', '', 'g') AS txt
  FROM (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS l FROM pages) p) q)"""
TXT = duck.clean(duck.parsed("txt"))


def _nodes(spark, sf):
    return nodes_table(spark, sf)


def _ranked(values):
    """Values with their place in the result list of their page."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("ord")
    return values.select("page_id", F.row_number().over(w).cast("bigint").alias("ix"), "value")


@query("c1_shred_pages", """
SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(
  regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<script[^>]*>).*?</script>', '\\1', 'g')), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) t GROUP BY page_id, tag""")
def c1(spark, sf):
    """Elements by name: each page writes every start tag that it means, also those of html, head and body."""
    return _nodes(spark, sf).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("c1_node_texts", f"""
SELECT page_id, {duck.clean(duck.parsed("regexp_replace(regexp_extract(html, '(?s)<article>.*</article>'), '<[^>]*>', '', 'g')"))} AS value FROM pages""")
def c1_text(spark, sf):
    return sel.select(_nodes(spark, sf), "article@text").select("page_id", "value")


@query("c2_compile_rules", duck_sql("fx_source_records") + """,
rules AS (SELECT CAST(rec_no AS STRING) || f AS rule_id, trim(r) AS rule FROM (SELECT rec_no, 't' AS f, rule_title AS r FROM fx_source_records
  UNION ALL SELECT rec_no, 'a', rule_articles FROM fx_source_records UNION ALL SELECT rec_no, 'e', 'p.' || name || '\\@x@all@tag.a.1@text.' || name || '@parent@child.2@b-attr' FROM fx_source_records) u),
toks AS (SELECT rule_id, i - 1 AS step_no, trim(replace(l[i], chr(1), '@')) AS tok FROM (SELECT rule_id, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT rule_id, string_split(replace(rule, '\\@', chr(1)), '@') AS l FROM rules) a) b),
ops AS (SELECT *, CASE WHEN step_no = 0 AND regexp_matches(tok, '^(//|\\./)|text\\(\\)$|\\[@') THEN 'xpath' WHEN step_no = 0 THEN 'select'
  WHEN tok IN ('all', 'parent') THEN tok WHEN tok = 'text' THEN 'text' WHEN tok = 'html' THEN 'html' WHEN tok LIKE 'child.%' THEN 'child'
  WHEN regexp_matches(tok, '^(//|\\./)|text\\(\\)$|\\[@') THEN 'xpath' WHEN regexp_matches(tok, '^.*\\S.*\\.[0-9]+$') THEN 'indexed'
  WHEN regexp_matches(tok, '^(tag|id|class)\\.') THEN 'select' WHEN tok LIKE 'text.%' THEN 'text_match' WHEN tok IN ('a', 'h2') THEN 'select' ELSE 'attr' END AS op FROM toks)
SELECT rule_id, CAST(step_no AS INT) AS step_no, op, CASE op WHEN 'indexed' THEN regexp_replace(tok, '\\.[0-9]+$', '') WHEN 'text_match' THEN trim(substr(tok, 6))
  WHEN 'select' THEN tok WHEN 'attr' THEN tok WHEN 'xpath' THEN tok ELSE '' END AS arg,
  CAST(CASE WHEN op IN ('indexed', 'child') THEN regexp_extract(tok, '\\.([0-9]+)$', 1) ELSE '0' END AS INT) AS n FROM ops""")
def c2(spark, sf):
    r = table(spark, sf, "fx_source_records")
    extra = F.concat(F.lit("p."), F.col("name"), F.lit("\\@x@all@tag.a.1@text."), F.col("name"), F.lit("@parent@child.2@b-attr"))
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), c.alias("r")) for f, c in [("t", F.col("rule_title")), ("a", F.col("rule_articles")), ("e", extra)]])
    rows = r.select("rec_no", F.explode(pairs).alias("p")).select(F.concat(F.col("rec_no").cast("string"), F.col("p.f")).alias("rule_id"), F.col("p.r").alias("rule"))
    return sel.compile_rules(rows)


@query("c3_match_simple", """
SELECT page_id, CAST(len(regexp_extract_all(html, '<div class="ad">')) AS BIGINT) AS n_ad, CAST(len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_links FROM pages""")
def c3(spark, sf):
    nodes = _nodes(spark, sf)
    return nodes.groupBy("page_id").agg(
        F.count_if(sel.match_simple("div.ad")).alias("n_ad"), F.count_if(sel.match_simple("[href]")).alias("n_links"))


@query("c4_select_within", f"WITH {LI} SELECT page_id, ix, href AS value FROM lis")
def c4(spark, sf):
    nodes = _nodes(spark, sf)
    nav = sel.select_within(sel.roots(nodes), nodes, "tag.nav")
    # "li" keeps the list items, then "li" again must keep them and not descend.
    li = sel.select_within(sel.select_within(nav, nodes, "li"), nodes, "tag.li")
    return _ranked(sel.extract_attr(sel.select_within(li, nodes, "a"), nodes, "href"))


@query("c5_select_path", f"WITH {LI} SELECT page_id, ix, {TXT} AS value FROM lis")
def c5(spark, sf):
    nodes = _nodes(spark, sf)
    return _ranked(sel.extract_text(sel.select_path(sel.roots(nodes), nodes, ["nav", "ul li"]), nodes))


@query("c6_xpath", f"WITH {LI} SELECT page_id, {TXT} AS value, href FROM lis WHERE ix = 2")
def c6(spark, sf):
    nodes = _nodes(spark, sf)
    texts = sel.select(nodes, "//nav/ul/li[2]/a[\\@href]/text()").select("page_id", "value")
    return texts.join(sel.select(nodes, "//li[2]/a@href").select("page_id", F.col("value").alias("href")), "page_id")


@query("c7_children", f"WITH {LI} SELECT page_id, count(*) AS n FROM lis GROUP BY page_id")
def c7(spark, sf):
    nodes = _nodes(spark, sf)
    return sel.children(sel.select_nodes(nodes, "ul"), nodes).groupBy("page_id").agg(F.count("*").alias("n"))


@query("c8_child_at", f"WITH {LI} SELECT page_id, href AS value FROM lis WHERE ix = 3")
def c8(spark, sf):
    nodes = _nodes(spark, sf)
    third = sel.child_at(sel.select_nodes(nodes, "ul"), nodes, 2)
    return sel.extract_attr(sel.select_within(third, nodes, "a"), nodes, "href").select("page_id", "value")


@query("c9_siblings", f"WITH {LI} SELECT a.page_id, a.ix + 1 AS ix, b.href AS value, a.href AS before FROM lis a JOIN lis b ON a.page_id = b.page_id AND b.ix = a.ix + 1")
def c9(spark, sf):
    nodes = _nodes(spark, sf)
    li = sel.select_nodes(nodes, "nav@li")
    at = lambda f: sel.extract_attr(sel.select_within(f, nodes, "a"), nodes, "href")
    nexts = _ranked(at(sel.sibling(li, nodes, 1)))
    befores = _ranked(at(sel.sibling(li, nodes, -1))).withColumnRenamed("value", "before")
    return nexts.join(befores, ["page_id", "ix"]).withColumn("ix", F.col("ix") + 1)


@query("c10_parent_of", f"WITH {LI} SELECT page_id, 'ul' AS tag, count(*) AS children FROM lis GROUP BY page_id")
def c10(spark, sf):
    nodes = _nodes(spark, sf)
    up = sel.dedup_nodes(sel.parent_of(sel.select_nodes(nodes, "li"), nodes))
    kids = nodes.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    return up.join(nodes.select("page_id", "node_id", "tag"), ["page_id", "node_id"]).join(kids, ["page_id", "node_id"]).select("page_id", "tag", "children")


@query("c11_indexed", f"WITH {LI} SELECT page_id, ix, href AS value FROM lis UNION ALL SELECT page_id, 1000, href FROM lis WHERE ix = 4")
def c11(spark, sf):
    nodes = _nodes(spark, sf)
    per_item = _ranked(sel.select(nodes, "li@a.0@href"))
    fourth = sel.select(nodes, "nav@tag.a.3@href").select("page_id", F.lit(1000).cast("bigint").alias("ix"), "value")
    return per_item.unionByName(fourth).unionByName(_ranked(sel.select(nodes, "li@a.1@href")))


@query("c12_text_match", f"""WITH {LI}, t AS (SELECT page_id, href, {TXT} AS v FROM lis),
hits AS (SELECT page_id, href, v, CASE WHEN v = 'the' THEN 0 ELSE 1 END AS r FROM t WHERE v LIKE '%the%')
SELECT page_id, href AS value FROM hits h WHERE r = (SELECT min(r) FROM hits g WHERE g.page_id = h.page_id)""")
def c12(spark, sf):
    nodes = _nodes(spark, sf)
    hits = sel.text_match(sel.select_nodes(nodes, "nav"), nodes, "the")
    # The deepest match may be the anchor, or its item when both hold the same text.
    return sel.extract_attr(sel.select_within(hits, nodes, "a"), nodes, "href").select("page_id", "value")


@query("c13_each", f"WITH {LI} SELECT page_id, ix * 2 - 1 AS ix, 'li' AS value FROM lis UNION ALL SELECT page_id, ix * 2, 'a' FROM lis")
def c13(spark, sf):
    nodes = _nodes(spark, sf)
    both = sel.each(sel.select_nodes(nodes, "nav@li"), nodes)
    return _ranked(both.join(nodes.select("page_id", "node_id", F.col("tag").alias("value")), ["page_id", "node_id"]))


@query("c14_dedup_nodes", f"WITH {LI} SELECT page_id, count(*) AS n FROM lis GROUP BY page_id")
def c14(spark, sf):
    nodes = _nodes(spark, sf)
    li = sel.select_nodes(nodes, "li")
    return sel.dedup_nodes(li.unionByName(li).unionByName(sel.children(sel.select_nodes(nodes, "ul"), nodes))).groupBy("page_id").agg(F.count("*").alias("n"))


@query("c15_root_fallback", "SELECT page_id, 'html' AS tag FROM pages")
def c15(spark, sf):
    nodes = _nodes(spark, sf)
    empty = sel.root_fallback(nodes, "").unionByName(sel.root_fallback(nodes, "class.gone"))
    return empty.join(nodes.select("page_id", "node_id", "tag"), ["page_id", "node_id"]).select("page_id", "tag")


@query("c16_extract_attr", f"WITH {LI} SELECT page_id, count(*) AS n, count(*) AS blanks FROM lis GROUP BY page_id")
def c16(spark, sf):
    values = sel.select(_nodes(spark, sf), "nav@a@data-none")
    return values.groupBy("page_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "").alias("blanks"))


@query("c17_extract_text", f"SELECT page_id, {duck.clean(duck.parsed('txt'))} AS value FROM (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS txt FROM pages) t")
def c17(spark, sf):
    return sel.select(_nodes(spark, sf), "h1@text").select("page_id", "value")


@query("c18_extract_own_text", f"SELECT page_id, {duck.html_text('txt')} AS value FROM (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS txt FROM pages) t")
def c18(spark, sf):
    return sel.select(_nodes(spark, sf), "article@ownText", table(spark, sf, "pages")).select("page_id", "value")


@query("c19_extract_html", """
SELECT page_id, regexp_extract(html, '(?s)<nav>.*</nav>') AS outer_html, regexp_extract(html, '(?s)<nav>(.*)</nav>', 1) AS inner_html FROM pages""")
def c19(spark, sf):
    nodes, pages = _nodes(spark, sf), table(spark, sf, "pages")
    outer = sel.select(nodes, "nav@outerHtml", pages).select("page_id", F.col("value").alias("outer_html"))
    return outer.join(sel.select(nodes, "nav@html", pages).select("page_id", F.col("value").alias("inner_html")), "page_id")


@query("c20_links_by_text", f"WITH {LI} SELECT page_id, min_by(href, ix) AS href FROM lis WHERE lower({TXT}) LIKE '%en%' OR lower({TXT}) LIKE '%th%' GROUP BY page_id")
def c20(spark, sf):
    return sel.links_by_text(_nodes(spark, sf), ["EN", "th"])


@query("user_rule_function", f"WITH {LI} SELECT page_id, ix, replace({TXT}, 'e', 'E') || '!' AS value FROM lis")
def user_rule_function(spark, sf):
    """A function of the user's over the values of a field rule."""
    register_rule_function("shout", lambda values: values.str.replace("e", "E") + "!")
    values = sel.select(_nodes(spark, sf), "nav@li@text")
    return _ranked(values.withColumn("value", rule_function("shout", F.col("value"))))
