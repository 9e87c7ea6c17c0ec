"""The audit (G): stages over the given pages, verdicts over derived stage results.

Every page stands for a source that was fetched once; its rules are those of
the shape it belongs to.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators import audit
from pageloom.operators.content import extract_content
from pageloom.operators.lists import content_links, doc_text_of
from pageloom.operators.media import media_catalog
from pageloom.plans import duck
from pageloom.plans.q_content import ARTICLES
from pageloom.plans.q_lists import ALL, ITEMS, JSON_BODIES, LINKS, PAGE_TEXT, SHOWN, shown
from pageloom.plans.registry import query
from pageloom.plans.tables import _fill, DERIVED, duck_sql, nodes_table, rule_pages, rule_sources, table

FETCH = f", f AS ({_fill(DERIVED['fx_fetch_log'], 'duckdb', lambda t: t)})"
BAD = "(f.error IS NOT NULL OR f.status NOT BETWEEN 200 AND 299)"
WHY = "coalesce(f.error, 'http ' || CAST(f.status AS STRING))"


def _fetch_log(spark, sf):
    return table(spark, sf, "fx_fetch_log").select(F.col("page_id").alias("source_id"), "status", "error", "body_chars")


def _targets(spark, sf):
    pages = rule_pages(spark, sf).select(F.col("page_id").alias("source_id"), F.col("url").alias("source_url"), "source_no")
    return pages.join(rule_sources(spark, sf), "source_no")


@query("g4_stage_homepage", duck_sql("fx_fetch_log") + """
SELECT page_id AS source_id, 'homepage' AS key, CASE WHEN error IS NOT NULL OR status NOT BETWEEN 200 AND 299 THEN 'fail' ELSE 'ok' END AS state,
  CASE WHEN error IS NOT NULL THEN 'unreachable' WHEN status NOT BETWEEN 200 AND 299 THEN 'http_status' ELSE 'ok' END AS code,
  CASE WHEN error IS NOT NULL THEN error WHEN status NOT BETWEEN 200 AND 299 THEN 'http ' || CAST(status AS STRING) ELSE 'chars=' || CAST(body_chars AS STRING) END AS detail FROM fx_fetch_log""")
def g4(spark, sf):
    return audit.stage_homepage(_targets(spark, sf), _fetch_log(spark, sf))


def _source_items(spark, sf):
    return shown(spark, sf).select(F.col("page_id").alias("source_id"), "ix", "title", "link")


@query("g5_stage_list", LINKS + ITEMS + SHOWN + FETCH + f""", s AS (SELECT page_id, count(*) AS n, count(CASE WHEN link <> '' THEN 1 END) AS linked, min_by(title, ix) AS first FROM shown GROUP BY page_id),
c AS (SELECT page_id, length({PAGE_TEXT}) AS chars FROM pages)
SELECT f.page_id AS source_id, 'list' AS key,
  CASE WHEN {BAD} THEN 'fail' WHEN f.source_no = 2 THEN 'ok' WHEN coalesce(linked, 0) = 0 THEN 'warn' ELSE 'ok' END AS state,
  CASE WHEN {BAD} THEN 'fetch_failed' WHEN f.source_no = 2 THEN 'single_page' WHEN s.n IS NULL THEN CASE WHEN f.source_no IN (6, 7, 8) THEN 'no_items_script' ELSE 'no_items' END
    WHEN linked = 0 THEN CASE WHEN f.source_no IN (3, 8) THEN 'no_link_rule' ELSE 'no_links' END ELSE 'items' END AS code,
  CASE WHEN {BAD} THEN {WHY} WHEN f.source_no = 2 THEN 'chars=' || CAST(chars AS STRING) WHEN coalesce(linked, 0) > 0 THEN 'items=' || CAST(s.n AS STRING) || ' first=' ||
    CASE WHEN length(first) <= 24 THEN first ELSE substr(first, 1, 11) || '…' || right(first, 11) END ELSE 'items=' || CAST(coalesce(s.n, 0) AS STRING) END AS detail
FROM f LEFT JOIN s ON f.page_id = s.page_id JOIN c ON f.page_id = c.page_id""")
def g5(spark, sf):
    chars = doc_text_of(nodes_table(spark, sf)).select(F.col("page_id").alias("source_id"), F.length("page_text").cast("bigint").alias("chars"))
    return audit.stage_list(_targets(spark, sf), _fetch_log(spark, sf), _source_items(spark, sf), chars)


@query("g6_stage_detail", duck_sql("fx_json_bodies") + ", " + ALL + ITEMS + SHOWN + JSON_BODIES + ARTICLES + FETCH + f""",
linked AS (SELECT page_id, count(*) AS n FROM shown WHERE link <> '' GROUP BY page_id), t AS (SELECT page_id, length(content_text) AS chars FROM articles)
SELECT f.page_id AS source_id, 'detail' AS key, CASE WHEN n IS NULL THEN 'skip' WHEN {BAD} OR chars = 0 THEN 'fail' WHEN chars < 120 THEN 'warn' ELSE 'ok' END AS state,
  CASE WHEN n IS NULL THEN 'nothing_to_open' WHEN {BAD} THEN 'fetch_failed' WHEN chars = 0 THEN 'no_text' WHEN chars < 120 THEN 'thin_text' ELSE 'text' END AS code,
  CASE WHEN n IS NULL THEN '' WHEN {BAD} THEN {WHY} ELSE 'chars=' || CAST(chars AS STRING) || ' media=0' END AS detail
FROM f LEFT JOIN linked ON f.page_id = linked.page_id JOIN t ON f.page_id = t.page_id""")
def g6(spark, sf):
    """The first linked item each page's listing shows, taken to open into the page itself."""
    nodes, pages = nodes_table(spark, sf), rule_pages(spark, sf)
    first = _source_items(spark, sf).filter("link <> ''").groupBy("source_id").agg(F.min_by("link", "ix").alias("detail_url"))
    articles = extract_content(pages, nodes, rule_sources(spark, sf))
    media = media_catalog(nodes).groupBy("page_id").agg(F.count("*").alias("media"))
    articles = articles.join(media, "page_id", "left").select(
        F.col("page_id").alias("source_id"), F.length("content_text").cast("bigint").alias("chars"), "media")
    return audit.stage_detail(_targets(spark, sf).join(first, "source_id", "left"), _fetch_log(spark, sf), articles)


@query("g7_stage_search", LINKS + FETCH + f""", n AS (SELECT page_id, count(*) AS n FROM numbered WHERE title LIKE '%e%' GROUP BY page_id),
k AS (SELECT page_id, substr(CASE WHEN page_id % 5 = 0 THEN url ELSE 'Site ' || CAST(page_id AS STRING) || ' name' END, 1, 8) AS word FROM pages)
SELECT f.page_id AS source_id, 'search' AS key, CASE WHEN f.page_id % 4 = 0 THEN 'skip' WHEN {BAD} THEN 'fail' WHEN n IS NULL THEN 'warn' ELSE 'ok' END AS state,
  CASE WHEN f.page_id % 4 = 0 THEN 'no_search' WHEN {BAD} THEN 'fetch_failed' WHEN n IS NULL THEN 'no_results' ELSE 'results' END AS code,
  CASE WHEN f.page_id % 4 = 0 THEN '' WHEN {BAD} THEN {WHY} ELSE 'keyword=' || word || ' n=' || CAST(coalesce(n, 0) AS STRING) END AS detail
FROM f LEFT JOIN n ON f.page_id = n.page_id JOIN k ON f.page_id = k.page_id""")
def g7(spark, sf):
    """Sources searched for their name; the links holding an "e" stand for the results."""
    i = F.col("source_id")
    targets = _targets(spark, sf).withColumn("source_name", F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("Site "), i.cast("string"), F.lit(" name"))))
    targets = targets.withColumn("search_url", F.when(i % 4 == 0, "").otherwise("/s?q={{keyWord}}"))
    items = content_links(nodes_table(spark, sf), table(spark, sf, "pages")).filter(F.col("title").contains("e"))
    return audit.stage_search(targets, _fetch_log(spark, sf), items.select(F.col("page_id").alias("source_id")))


STAGES = duck_sql("fx_stages")
HEALTH = STAGES + """, health AS (SELECT run_no, max(source_id) AS source_id, max(item_count) AS item_count, max(usable) AS usable, max(checked_s) AS checked_s,
    bool_or(state = 'fail') AS any_fail, bool_or(state = 'warn') AS any_warn, bool_and(state IN ('ok', 'skip')) AND max(usable) > 0 AS ok,
    coalesce(min_by(key || ': ' || detail, stage_no) FILTER (state = 'fail'), min_by(key || ': ' || detail, stage_no) FILTER (state = 'warn'),
      'ok: ' || CAST(max(item_count) AS STRING) || ' items') AS status FROM fx_stages GROUP BY run_no) """


def _health(spark, sf):
    s = table(spark, sf, "fx_stages")
    facts = s.filter("key = 'rule'").select("run_no", "source_id", "item_count", "usable", "checked_s")
    health = audit.summarize_health(s.select("run_no", "key", "state", "detail"), facts.select("run_no", "item_count", "usable"), ["run_no"])
    return health.join(facts.select("run_no", "source_id", "checked_s"), "run_no")


@query("g8_summarize_health", HEALTH + "SELECT run_no, ok, status, item_count FROM health")
def g8(spark, sf):
    return _health(spark, sf).select("run_no", "ok", "status", "item_count")


@query("g9_outcome_counts", HEALTH + """
SELECT count(*) AS total, count(CASE WHEN k = 'ok' THEN 1 END) AS ok, count(CASE WHEN k = 'warn' THEN 1 END) AS warn, count(CASE WHEN k = 'failed' THEN 1 END) AS failed
FROM (SELECT CASE WHEN any_fail THEN 'failed' WHEN any_warn THEN 'warn' WHEN ok THEN 'ok' ELSE 'warn' END AS k FROM health) t""")
def g9(spark, sf):
    return audit.outcome_counts(_health(spark, sf))


BUCKETS = STAGES + """, b AS (SELECT run_no, enable_js, single_page, CASE WHEN front IS NOT NULL THEN CASE WHEN regexp_matches(front, 'timed out|dns|connection') THEN 'unreachable' ELSE 'degraded' END
    WHEN single_page THEN CASE WHEN f THEN 'rule-broken' ELSE 'working' END WHEN items > 0 THEN 'working' ELSE 'rule-broken' END AS bucket
  FROM (SELECT run_no, bool_or(single_page) AS single_page, bool_or(enable_js) AS enable_js, bool_or(state = 'fail') AS f, max(item_count) AS items,
    min_by(lower(detail), stage_no) FILTER (state = 'fail' AND key IN ('homepage', 'list')) AS front FROM fx_stages GROUP BY run_no) t) """


def _buckets(spark, sf):
    s = table(spark, sf, "fx_stages")
    facts = s.filter("key = 'rule'").select("run_no", "item_count", "single_page", "enable_js")
    return audit.failure_bucket(s.select("run_no", "key", "state", "detail"), facts, ["run_no"])


@query("g10_failure_bucket", BUCKETS + "SELECT run_no, bucket FROM b")
def g10(spark, sf):
    return _buckets(spark, sf).select("run_no", "bucket")


@query("g11_pass_rate_report", BUCKETS + """
SELECT bucket, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM b), 1) AS share, count(CASE WHEN NOT enable_js THEN 1 END) AS no_script,
  count(CASE WHEN enable_js THEN 1 END) AS script, count(CASE WHEN single_page THEN 1 END) AS single, (SELECT count(*) FROM b) AS verified, true AS reconciled FROM b GROUP BY bucket""")
def g11(spark, sf):
    return audit.pass_rate_report(_buckets(spark, sf)).withColumn("share", F.col("share").cast("double"))


@query("g12_rule_fit", """
WITH snaps AS (SELECT doc_id % 200 AS source_id, doc_id, text, CASE doc_id % 200 % 4 WHEN 0 THEN 'the' WHEN 1 THEN 'zzz-gone' WHEN 2 THEN 'elle' ELSE 'nicht' END AS name,
  CASE WHEN doc_id % 29 = 0 THEN NULL ELSE text END AS html, CASE WHEN doc_id % 200 % 5 = 0 THEN 0 ELSE doc_id % 3 END AS openable FROM documents),
s AS (SELECT source_id, count(*) AS snapshots, bool_or(coalesce(contains(html, name), false)) AS present, bool_and(html IS NOT NULL AND lower(html) LIKE '%ing%') AS blocked,
  min(CASE WHEN html IS NOT NULL THEN openable END) AS lo, max(CASE WHEN html IS NOT NULL THEN openable END) AS hi FROM snaps GROUP BY source_id)
SELECT source_id, snapshots, CASE WHEN blocked AND NOT present THEN 'blocked' WHEN NOT present THEN 'redesigned' WHEN lo <> hi THEN 'intermittent'
  WHEN coalesce(hi, 0) = 0 THEN 'engine_defect' ELSE 'working' END AS verdict FROM s""")
def g12(spark, sf):
    """Documents as snapshots of 200 sources, words as the containers their rules name."""
    i, k = F.col("doc_id"), F.col("doc_id") % 200
    docs = table(spark, sf, "documents")
    snaps = docs.select(k.alias("source_id"), F.when(i % 29 != 0, F.col("text")).alias("html"), F.when(k % 5 == 0, 0).otherwise(i % 3).alias("openable"))
    rule = F.when(k % 4 == 0, "tag.div@class.the@tag.li").when(k % 4 == 1, ".zzz-gone@text").when(k % 4 == 2, "id.elle").otherwise("#nicht@text.x")
    sources = docs.select(k.alias("source_id"), rule.alias("rule_articles")).distinct()
    return audit.rule_fit(sources, snaps, ["ing"])


PASSES = duck_sql("fx_passes")


@query("g13_ab_compare", PASSES + """, w AS (SELECT name, pass_no FROM fx_passes WHERE works)
SELECT name, 'gained' AS change FROM (SELECT name FROM w WHERE pass_no = 1 EXCEPT SELECT name FROM w WHERE pass_no = 0) a
UNION ALL SELECT name, 'lost' FROM (SELECT name FROM w WHERE pass_no = 0 INTERSECT SELECT name FROM fx_passes WHERE pass_no = 1 AND NOT works) b
UNION ALL SELECT name, 'drift' FROM (SELECT name FROM w WHERE pass_no = 0 EXCEPT SELECT name FROM w WHERE pass_no = 2) c""")
def g13(spark, sf):
    return audit.ab_compare(table(spark, sf, "fx_passes"))


@query("g14_no_verdict_guard", PASSES + """
SELECT pass_no, count(*) AS measured, count(bucket) AS classified, count(*) - count(bucket) AS missing, count(*) = count(bucket) AS complete FROM fx_passes GROUP BY pass_no""")
def g14(spark, sf):
    return audit.no_verdict_guard(table(spark, sf, "fx_passes"))


LATEST = HEALTH + ", latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY checked_s DESC, run_no DESC) AS rn FROM health) t WHERE rn = 1) "
SRC = ", src AS (SELECT 'src' || CAST(c_custkey % 120 AS STRING) AS source_id, min(c_name) AS source_name FROM customer GROUP BY 1) "


def _sources(spark, sf):
    return table(spark, sf, "customer").groupBy(F.concat(F.lit("src"), (F.col("c_custkey") % 120).cast("string")).alias("source_id")).agg(
        F.min("c_name").alias("source_name"))


@query("g15_verdict_table", LATEST + SRC + """
SELECT s.source_id, source_name, CASE WHEN l.ok IS NULL THEN 'none' WHEN any_fail THEN 'fail' ELSE 'warn' END AS overall
FROM src s LEFT JOIN latest l ON s.source_id = l.source_id WHERE l.ok IS NULL OR any_fail OR NOT l.ok""")
def g15(spark, sf):
    latest = audit.latest_health(_health(spark, sf)).select("source_id", "ok", "any_fail", "status")
    return audit.verdict_table(_sources(spark, sf), latest, only_problems=True).select("source_id", "source_name", "overall")


@query("g16_apply_health", LATEST + SRC + """
SELECT s.source_id, l.source_id IS NOT NULL AS has_health, coalesce(l.ok, true) AS health_ok, coalesce(l.checked_s, 0) AS checked_s
FROM src s LEFT JOIN latest l ON s.source_id = l.source_id""")
def g16(spark, sf):
    s = _sources(spark, sf).withColumns({"has_health": F.lit(False), "health_ok": F.lit(True), "checked_s": F.lit(0).cast("bigint")})
    return audit.apply_health(s, _health(spark, sf)).select("source_id", "has_health", "health_ok", "checked_s")


@query("g17_render_failure_reason", f"""WITH {duck.ANCHORS}, n AS (SELECT page_id, count(*) AS n FROM anchors GROUP BY page_id)
SELECT p.page_id AS source_id, CASE WHEN p.page_id % 6 = 0 THEN NULL WHEN p.page_id % 6 = 1 THEN 'not_loaded' WHEN p.page_id % 6 = 2 THEN 'no_links_generated' WHEN coalesce(n, 0) = 0 THEN 'no_links_generated' ELSE 'rules_mismatch' END AS reason
FROM pages p LEFT JOIN n ON p.page_id = n.page_id""")
def g17(spark, sf):
    """Pages as rendered snapshots; a sixth of them did not load, a sixth came without links."""
    k = F.col("page_id") % 6
    links = nodes_table(spark, sf).filter("tag = 'a'").groupBy("page_id").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "pages").select("page_id").join(links, "page_id", "left").select(
        F.col("page_id").alias("source_id"), (k != 1).alias("loaded"), F.when(k == 2, 0).otherwise(F.coalesce("n", F.lit(0))).alias("link_count"),
        F.when(k == 0, 1).otherwise(0).alias("openable"))
    return audit.render_failure_reason(rows).select("source_id", "reason")
