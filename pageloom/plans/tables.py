"""The input tables of the registered queries, all derived from the given ones.

Each derivation is one SQL text that both engines read; where the dialects
differ the text holds a ``{name}`` slot filled from ``DIALECT``. Every table
grows with the data. The arithmetic only decides which shape a row takes; no
derivation drops rows to stay small.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.nodes import shred_pages
from pageloom.session import is_there, shared_dir, spread
from pageloom.sources.tables import save_nodes

GIVEN = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
         "conversations").split()

TEXT_KEYS = {"pages": "page_id", "documents": "doc_id"}
# Tables whose few stored bytes a row become a text that is worked on at length.
DENSE_KEYS = {"part": "p_partkey"}
DENSE_PART_BYTES = 16 << 10

DIALECT = {
    "spark": {
        "plus_s": lambda a, b: f"{a} + make_dt_interval(0, 0, 0, {b})",
        "each": lambda name, values: f"LATERAL VIEW explode(array({values})) each_row AS {name}",
        "nl": "chr(10)",
    },
    "duckdb": {
        "plus_s": lambda a, b: f"{a} + to_seconds({b})",
        "each": lambda name, values: f", (SELECT unnest([{values}]) AS {name}) each_row",
        "nl": "chr(10)",
    },
}

# The rule shapes a page's source can have: pages are spread over the first twelve, JSON bodies over the others.
RULE_SHAPES = """
SELECT * FROM (VALUES
 (0, 'healthy list', 'tag.nav@tag.li', 'a@text', 'a@href', '', '', '', false),
 (1, 'dead class', 'class.gone@all', 'a@text', 'a@href', '', '', 'class.gone-too', false),
 (2, 'whole page', 'body', '', '', '', '', '', false),
 (3, 'bare address', '', '', '', '', '', '', false),
 (4, 'indexed', 'nav@li', 'li@a.0@text', 'li@a.0@href', '', '', 'article', false),
 (5, 'xpath', '//nav/ul/li', '//a/text()', 'a@href', '', '', '', false),
 (6, 'children', 'tag.ul@children', '@text', 'a@href', '', '', '', true),
 (7, 'script', '@js:java.getElements(1)', '', '', '', '', '', true),
 (8, 'no address rule', 'ul li@all', 'a@text', '', '', '', '', true),
 (9, 'inferred', '', 'a@text', 'a@href', '', '', '', false),
 (10, 'parent step', 'nav@li@a@parent', 'a@text', 'a@href', '', '', 'article@p', false),
 (11, 'sibling step', 'nav@li@next', 'a@all@text', 'a@href', 'img@src', '', '', false),
 (12, 'json path', '$.data.list', '$.title', '/v/{{$.aid}}', '', '', '<h3>{{$.data.list[0].title}}</h3><img src="/i/{{$.data.list[0].aid}}.png">', false),
 (13, 'json descent', '$..book', '$.title', '$.url', '', '', '$..title', false),
 (14, 'json inferred', '', '$.name##[aeiou]##_', '$.book.none||$.url||$.id', '', '', '', false),
 (15, 'json filter', '$.data[?(@.id > 50)]', '$.name', 'https://x.example/{{$.id}}?t={{$.time##2##$0!}}', '', '$.time', '$.data[?(@.time == ''2024'')].name', false),
 (16, 'json slice', '$.data.list[-1:]', '$.none||$.title||$.vod_name', 'u/{{$.aid}}', '$.vod_pic', '', '$.data.list[1].title', false),
 (17, 'json bad path', '$.data[', '$.title', '', '', '', '$.data[?(', false),
 (18, 'json any member', '$[*]', '$.book[''title'']', '$.url', '', '', '$[0].book.title', false)
) AS t(source_no, source_name, rule_articles, rule_title, rule_link, rule_image, rule_pub_date, rule_content, enable_js)
"""

DERIVED: dict[str, str] = {
    "fx_history": """
SELECT user_id, url, source_id, source_name, title, viewed_at FROM (
  SELECT user_id,
    'https://site' || CAST(event_id % 40 AS STRING) || '.example/a/' || CAST(event_id % 400 AS STRING) AS url,
    CASE WHEN event_id % 40 % 9 = 0 THEN '' ELSE 's' || CAST(event_id % 40 % 9 AS STRING) END AS source_id,
    'Source ' || CAST(event_id % 40 % 9 AS STRING) AS source_name,
    'Article ' || CAST(event_id % 400 AS STRING) AS title, ts AS viewed_at,
    row_number() OVER (PARTITION BY user_id, event_id % 400 ORDER BY ts DESC, event_id DESC) AS rn
  FROM {events} WHERE event_type IN ('view','click')) t WHERE rn = 1""",
    "fx_opened": """
SELECT event_id, user_id,
  'https://site' || CAST(event_id % 40 AS STRING) || '.example/a/' || CAST(event_id % 400 AS STRING) AS url,
  's' || CAST(event_id % 40 % 9 AS STRING) AS source_id, 'Source ' || CAST(event_id % 40 % 9 AS STRING) AS source_name,
  'Article ' || CAST(event_id % 400 AS STRING) AS title, ts AS viewed_at
FROM {events} WHERE event_type IN ('view','click')""",
    "fx_progress_events": """
SELECT event_id, user_id,
  'https://site' || CAST(event_id % 40 AS STRING) || '.example/a/' || CAST(event_id % 400 AS STRING) AS url,
  CAST(CAST(floor(value * 100) AS BIGINT) % 121 - 10 AS DOUBLE) / 100 AS ratio_raw,
  {plus_s:ts|event_id * 37 % 5400} AS updated_at
FROM {events} WHERE event_type IN ('view','click','purchase')""",
    "fx_progress": """
SELECT user_id, url, CAST(least(greatest(ratio_raw, 0), 1) AS FLOAT) AS ratio, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, url ORDER BY updated_at DESC, event_id DESC) AS rn
  FROM {fx_progress_events}) t WHERE rn = 1""",
    "fx_fetch_log": """
SELECT page_id, url,
  CAST(CASE WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 23 = 0 THEN 503 ELSE 200 END AS INT) AS status,
  CASE WHEN page_id % 29 = 0 THEN 'connection timed out' END AS error,
  CAST(length(html) AS BIGINT) AS body_chars, CAST(page_id % 12 AS INT) AS source_no
FROM {pages}""",
    "fx_lrc": """
SELECT conv_id AS track_id, turn AS line_no,
  CASE WHEN turn = 0 THEN '[offset:' || CAST((conv_id % 21 - 10) * 50 AS STRING) || ']'
       ELSE '[' || lpad(CAST(turn * 7 % 60 AS STRING), 2, '0') || ':' || lpad(CAST(conv_id * 13 % 60 AS STRING), 2, '0')
            || '.' || lpad(CAST(conv_id * 7 % 100 AS STRING), 2, '0') || ']'
            || CASE WHEN turn % 3 = 2 THEN '[' || lpad(CAST(turn * 11 % 60 AS STRING), 2, '0') || ':30:5]' ELSE '' END
            || replace(text, {nl}, ' ') END AS raw_line
FROM {conversations}""",
    "fx_shelf": """
SELECT DISTINCT user_id, 's' || CAST(event_id % 9 AS STRING) AS source_id, 'all' AS category,
  CAST(min(ts) OVER (PARTITION BY user_id, event_id % 9) AS TIMESTAMP) AS added_at
FROM {events} WHERE event_type = 'signup'""",
    "fx_source_records": """
SELECT c_custkey AS rec_no, c_custkey % 7 AS collection_no,
  'Site ' || CAST(c_custkey % 900 AS STRING) AS name,
  'https://site' || CAST(c_custkey % 900 AS STRING) || '.example/' AS url,
  CASE WHEN c_custkey % 5 = 0 THEN 'All::/{{{{page}}}}$$$New::/new/' || {nl} || 'Search::/s?a::b'
       WHEN c_custkey % 5 = 1 THEN '::/x/{{{{page}}}}' || {nl} || {nl} || 'no cell' || {nl} || ' Top :: https://site' || CAST(c_custkey % 900 AS STRING) || '.example '
       WHEN c_custkey % 5 = 2 THEN c_mktsegment || '::/seg/' || lower(c_mktsegment) || '$$$$$$Search::/find'
       ELSE '' END AS sort_url,
  CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 6 = 1 THEN 'body' WHEN c_custkey % 6 = 2 THEN '$.data.list'
       WHEN c_custkey % 6 = 3 THEN '//div.' || lower(c_mktsegment) || '/a[@href]'
       WHEN c_custkey % 6 = 4 THEN 'class.' || lower(c_mktsegment) || '@tag.li:contains(x)@all' ELSE '<js>java.get($.x)</js>' END AS rule_articles,
  CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'a.0@text' WHEN c_custkey % 4 = 2 THEN '$.title##<.*?>##' ELSE 'h2@a@text' END AS rule_title,
  CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'a@href' ELSE 'https://x.example/v?id={{{{$.id}}}}' END AS rule_link,
  CASE WHEN c_custkey % 4 < 2 THEN '' ELSE 'id.content@html' END AS rule_content,
  CASE WHEN c_custkey % 3 = 0 THEN '/search?q={{{{keyWord}}}}&p={{{{page}}}}' WHEN c_custkey % 3 = 1 THEN '' ELSE 'find/{{{{keyWord}}}}/{{{{page<0>}}}}' END AS search_url,
  CASE WHEN c_custkey % 4 = 0 THEN '{{"User-Agent":"UA ' || CAST(c_custkey AS STRING) || '","X-N":' || CAST(c_nationkey AS STRING) || ',"Y":true,"Z":[1]}}'
       WHEN c_custkey % 4 = 1 THEN 'Referer: https://r.example/' || CAST(c_nationkey AS STRING) || {nl} || ' Cookie : a=b:c ' || {nl} || 'junk'
       ELSE '' END AS header,
  CASE WHEN c_custkey % 8 = 0 THEN '' ELSE c_mktsegment END AS source_group,
  CAST(c_custkey % 10 AS BIGINT) AS custom_order, c_custkey % 3 = 0 AS enable_js, c_custkey % 4 <> 0 AS enabled,
  c_custkey % 11 = 0 AS favorite,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'Collection ' || CAST(c_custkey % 7 AS STRING) END AS collection
FROM {customer}""",
    "fx_sources": """
SELECT 's' || CAST(rec_no AS STRING) AS source_id, name AS source_name,
  'https://site' || CAST(rec_no AS STRING) || '.example/' AS source_url,
  source_group, custom_order, header, sort_url, rule_articles, rule_title, rule_link, rule_content, search_url, enable_js,
  enabled, favorite, collection, rec_no % 3 <> 1 AS has_health, rec_no % 5 <> 0 AS health_ok,
  CAST(1704067200 + rec_no % 10 * 86400 AS BIGINT) AS checked_s
FROM {fx_source_records}""",
    "fx_history_sources": """
SELECT DISTINCT source_id, 'https://' || source_id || '.example/' AS source_url FROM {fx_history}
WHERE source_id NOT IN ('', 's3')""",
    "fx_links": """
SELECT page_id,
  CASE page_id % 16 WHEN 0 THEN '/a/./b/../c?x=1' WHEN 1 THEN '../up/' WHEN 2 THEN './here' WHEN 3 THEN '?q=' || CAST(page_id AS STRING)
    WHEN 4 THEN '#top' WHEN 5 THEN '//cdn.example/x.mp3' WHEN 6 THEN CAST(660000 + page_id AS STRING) WHEN 7 THEN '#' || CAST(page_id AS STRING)
    WHEN 8 THEN 'javascript:void(0)' WHEN 9 THEN 'file.m3u8?tok=1' WHEN 10 THEN '  http://abs.example/Path  ' WHEN 11 THEN 'data:image/png;base64,AA'
    WHEN 12 THEN '/ünï/' || CAST(page_id AS STRING) WHEN 13 THEN 'importApp(1)' WHEN 14 THEN '../../../x/y.' WHEN 15 THEN 'plain' END AS href,
  url AS base, regexp_replace(url, '^.*/', '') AS tail,
  CASE page_id % 7 WHEN 0 THEN 'My Music Box' WHEN 1 THEN 'Movie night' WHEN 2 THEN 'Photo gallery' WHEN 3 THEN 'A BOOK' WHEN 4 THEN '歌曲 top'
    ELSE 'Plain title' END AS title
FROM {pages}""",
    "fx_json_bodies": """
SELECT p_partkey AS body_id,
  CASE WHEN p_partkey % 6 = 0 THEN 'plain ' || p_name
       WHEN p_partkey % 6 = 1 THEN '{{"data":{{"list":[{{"aid":' || CAST(p_partkey AS STRING) || ',"title":"' || p_name || '","vod_pic":"/i/' || CAST(p_size AS STRING) || '.png"}},{{"aid":' || CAST(p_partkey + 1 AS STRING) || ',"title":"","vod_name":"' || p_brand || '"}}]}}}}'
       WHEN p_partkey % 6 = 2 THEN '{{"data":[{{"id":' || CAST(p_partkey AS STRING) || ',"name":"' || p_name || '","time":"2024"}}],"next":"/p/2"}}'
       WHEN p_partkey % 6 = 3 THEN ' [{{"url":"/u/' || CAST(p_partkey AS STRING) || '","book":{{"title":"' || p_type || '"}}}}]'
       WHEN p_partkey % 6 = 4 THEN '{{"box":{{"rows2":[{{"book":{{"title":"deep ' || p_brand || '"}}}}]}},"book":{{"title":"top"}},"data":[]}}'
       ELSE '{{"broken":' || p_name END AS body
FROM {part}""",
    "fx_json_pages": """
SELECT -1 - p_partkey AS page_id, 'https://api.example/list/' || CAST(p_partkey AS STRING) AS url, body AS html,
  CAST(12 + CAST(floor(p_partkey / 6) AS BIGINT) % 7 AS INT) AS source_no
FROM (SELECT body_id AS p_partkey, body FROM {fx_json_bodies}) b""",
    "fx_highlights": """
SELECT doc_id * 10 + k AS hl_no, doc_id % 25 AS user_id, 'https://docs.example/' || CAST(doc_id AS STRING) AS url,
  'Doc ' || CAST(doc_id AS STRING) AS title, source AS source_name,
  CASE WHEN doc_id % 13 = 0 AND k = 2 THEN '   ' ELSE ' ' || split_part(text, {nl}, CAST(CASE WHEN k = 2 THEN 1 ELSE k + 1 END AS INT)) || ' ' END AS text,
  CASE WHEN doc_id % 4 = 0 THEN 'note ' || lang ELSE '' END AS note,
  CAST(1704067200 + doc_id * 7 % 100000 + k AS BIGINT) AS created_s
FROM {documents} {each:k|0, 1, 2}""",
    "fx_media_pages": """
SELECT page_id, url,
  '<html><body><ul><li><a href="/m/t' || CAST(page_id % 5 AS STRING) || '.mp3?k=1">Track ' || CAST(page_id AS STRING) || '</a><audio src="/m/t' || CAST(page_id % 5 AS STRING) || '.mp3?k=1"></audio>'
  || CASE WHEN page_id % 3 = 0 THEN '<a href="/l/T-' || CAST(page_id % 5 AS STRING) || '.lrc">lyrics</a>' WHEN page_id % 3 = 1 THEN '<a data-lrc="/l/other.lrc" href="/x">w</a>' ELSE '' END || '</li></ul>'
  || CASE WHEN page_id % 2 = 0 THEN '<video poster="/p.jpg"><source src="https://v.example/' || CAST(page_id AS STRING) || '.m3u8"><track kind="subtitles" src="/s/' || CAST(page_id AS STRING) || '.vtt" srclang="en" default><track kind="chapters" src="/c.vtt"></video>' ELSE '' END
  || '<img data-src="/i/' || CAST(page_id AS STRING) || '.jpg" src="data:image/gif;base64,R0"><img src="data:image/gif;base64,R0"><img src="//img.example/b.png">'
  || '<script>var a="/ad.js"</script></body></html>' AS html
FROM {pages}""",
    "fx_stages": """
SELECT page_id AS run_no, 'src' || CAST(page_id % 97 AS STRING) AS source_id, page_id % 3 AS run_id,
  CASE stage_no WHEN 0 THEN 'rule' WHEN 1 THEN 'homepage' WHEN 2 THEN 'list' WHEN 3 THEN 'detail' ELSE 'search' END AS key, stage_no,
  CASE WHEN stage_no = 0 THEN 'ok' WHEN (page_id + stage_no) % 11 = 0 THEN 'fail' WHEN (page_id * 3 + stage_no) % 7 = 0 THEN 'warn'
       WHEN stage_no = 4 AND page_id % 2 = 0 THEN 'skip' ELSE 'ok' END AS state,
  CASE WHEN (page_id + stage_no) % 11 <> 0 THEN 'fine' WHEN page_id % 2 = 0 THEN 'connection timed out' ELSE 'http 403' END AS detail,
  CAST(page_id % 9 AS BIGINT) AS item_count, CAST(page_id % 9 % 4 AS BIGINT) AS usable,
  CAST(1704067200 + page_id * 60 AS BIGINT) AS checked_s, page_id % 5 = 0 AS single_page, page_id % 4 = 0 AS enable_js
FROM {pages} {each:stage_no|0, 1, 2, 3, 4}""",
    "fx_passes": """
SELECT o_orderkey % 3 AS pass_no, 'src' || CAST(o_custkey AS STRING) AS name, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 1 AS works,
  max(CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE o_orderpriority END) AS bucket
FROM {orders} GROUP BY o_orderkey % 3, o_custkey""",
}


def _fill(sql: str, dialect: str, refer) -> str:
    """Fill dialect and table slots of a derivation."""
    import re

    words = DIALECT[dialect]

    def slot(m):
        name, _, args = m.group(1).partition(":")
        if name in words:
            word = words[name]
            return word(*args.split("|")) if callable(word) else word
        return refer(name)

    out = re.sub(r"(?<!\{)\{([A-Za-z_]\w*(?::[^{}]*)?)\}(?!\})", slot, sql)
    return out.replace("{{", "{").replace("}}", "}")


def duck_sql(*names: str) -> str:
    """A WITH clause defining derived tables (and what they build on) for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order or name in GIVEN:
            return
        sql = RULE_SHAPES if name == "fx_rules" else DERIVED[name]
        for other in DERIVED:
            if "{" + other + "}" in sql:
                visit(other)
        order.append(name)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({_fill(RULE_SHAPES if n == 'fx_rules' else DERIVED[n], 'duckdb', lambda t: t)})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table as a DataFrame."""
    if name in GIVEN:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name in DENSE_KEYS:
            return spread(df, DENSE_KEYS[name], DENSE_PART_BYTES)
        # The text tables are worked on row by row at length.
        return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df
    if name == "fx_rules":
        return spark.sql(RULE_SHAPES)
    used: dict[str, DataFrame] = {}

    def refer(t: str) -> str:
        used.setdefault(t, table(spark, sf_dir, t))
        return "{" + t + "}"

    text = _fill(DERIVED[name], "spark", lambda t: f"@@{t}@@")
    # spark.sql() formats its text itself, so braces meant as text are doubled again.
    text = text.replace("{", "{{").replace("}", "}}")
    import re

    text = re.sub(r"@@(\w+)@@", lambda m: refer(m.group(1)), text)
    return spark.sql(text, **used)


_WRITTEN: dict[tuple[str, str], DataFrame] = {}
NODE_BUCKETS = 16  # a table for a cluster has thousands


def nodes_table(spark: SparkSession, sf_dir: str, source: str = "pages") -> DataFrame:
    """The node table of a snapshot, shredded once per session and then read."""
    key = (spark.sparkContext.applicationId, f"{sf_dir}|{source}")
    if key not in _WRITTEN or not is_there(_WRITTEN[key]):
        tag = hashlib.sha256("|".join(key).encode()).hexdigest()[:16]
        path = os.path.join(shared_dir(spark), "tables", f"nodes-{tag}")
        _WRITTEN[key] = save_nodes(shred_pages(table(spark, sf_dir, source)), f"nodes_{tag}", path, NODE_BUCKETS)
    return _WRITTEN[key]


def web_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All pages, the given ones and the JSON bodies, with their sources' numbers, and their nodes."""
    pages = rule_pages(spark, sf_dir).unionByName(table(spark, sf_dir, "fx_json_pages"))
    return pages, nodes_table(spark, sf_dir).unionByName(nodes_table(spark, sf_dir, "fx_json_pages"))


def rule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the number of the source they belong to."""
    return table(spark, sf_dir, "pages").withColumn("source_no", (F.col("page_id") % 12).cast("int"))


def rule_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule shapes of the sources pages belong to."""
    return table(spark, sf_dir, "fx_rules")
