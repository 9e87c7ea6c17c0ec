"""Reading analytics (H) over histories and positions derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.hashing import highlight_id
from pageloom.functions.text import strip
from pageloom.operators import marks, reading
from pageloom.plans.duck import WS, strip as sql_strip
from pageloom.plans.registry import query
from pageloom.plans.tables import duck_sql, table

NOW = "2024-01-17 12:00:00"

WINDOWS = """windows AS (
  SELECT h.user_id, h.url, h.viewed_at, least(h.viewed_at, coalesce(p.updated_at, h.viewed_at)) AS start_at,
    least(1800, coalesce(abs(CAST(floor(epoch(p.updated_at)) AS BIGINT) - CAST(floor(epoch(h.viewed_at)) AS BIGINT)), 0)) AS secs
  FROM fx_history h LEFT JOIN fx_progress p ON h.user_id = p.user_id AND h.url = p.url)"""
# A window of at most half an hour touches one day or two.
SPLIT = """split AS (
  SELECT user_id, url, CAST(s AS DATE) AS day, CAST(least(secs, epoch(CAST(CAST(s AS DATE) + 1 AS TIMESTAMP)) - epoch(s)) AS BIGINT) AS day_secs
  FROM (SELECT *, date_trunc('second', start_at) AS s FROM windows WHERE secs > 0) w
  UNION ALL
  SELECT user_id, url, CAST(s AS DATE) + 1, CAST(secs - (epoch(CAST(CAST(s AS DATE) + 1 AS TIMESTAMP)) - epoch(s)) AS BIGINT)
  FROM (SELECT *, date_trunc('second', start_at) AS s FROM windows WHERE secs > 0) w
  WHERE secs > epoch(CAST(CAST(s AS DATE) + 1 AS TIMESTAMP)) - epoch(s))"""
DAILY = """daily AS (
  SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, coalesce(articles, 0) AS articles, coalesce(secs, 0) AS secs
  FROM (SELECT user_id, CAST(viewed_at AS DATE) AS day, count(*) AS articles FROM fx_history GROUP BY ALL) a
  FULL JOIN (SELECT user_id, day, CAST(sum(day_secs) AS BIGINT) AS secs FROM split GROUP BY ALL) b ON a.user_id = b.user_id AND a.day = b.day)"""
READING = duck_sql("fx_history", "fx_progress") + f",{WINDOWS},{SPLIT},{DAILY} "


def _records(spark, sf):
    return table(spark, sf, "fx_history"), table(spark, sf, "fx_progress")


@query("h1_reading_stats", READING + f"""
SELECT user_id, CAST(sum(CASE WHEN day = DATE '2024-01-17' THEN articles ELSE 0 END) AS BIGINT) AS today_articles,
  CAST(sum(CASE WHEN day = DATE '2024-01-17' THEN secs ELSE 0 END) // 60 AS BIGINT) AS today_minutes,
  CAST(sum(CASE WHEN day BETWEEN DATE '2024-01-15' AND DATE '2024-01-17' THEN articles ELSE 0 END) AS BIGINT) AS week_articles,
  CAST(sum(CASE WHEN day BETWEEN DATE '2024-01-15' AND DATE '2024-01-17' THEN secs ELSE 0 END) // 60 AS BIGINT) AS week_minutes,
  CAST(sum(articles) AS BIGINT) AS all_articles, CAST(sum(secs) // 60 AS BIGINT) AS all_minutes
FROM daily GROUP BY user_id""")
def h1(spark, sf):
    return reading.reading_stats(*_records(spark, sf), F.lit(NOW).cast("timestamp_ntz"))


@query("h2_reading_window", READING + "SELECT user_id, url, CAST(secs AS BIGINT) AS secs FROM windows")
def h2(spark, sf):
    return reading.reading_windows(*_records(spark, sf)).select("user_id", "url", "secs")


@query("h3_split_across_days", READING + "SELECT user_id, url, day, day_secs FROM split")
def h3(spark, sf):
    return reading.split_across_days(reading.reading_windows(*_records(spark, sf))).select("user_id", "url", "day", "day_secs")


@query("h4_daily_reading", READING + "SELECT user_id, day, articles, secs FROM daily")
def h4(spark, sf):
    return reading.daily_reading(*_records(spark, sf))


@query("h5_top_sources", duck_sql("fx_history") + """
SELECT user_id, CASE WHEN source_id = '' THEN source_name ELSE source_id END AS source_key, count(*) AS articles, max(source_name) AS source_name
FROM fx_history GROUP BY 1, 2""")
def h5(spark, sf):
    return reading.top_sources(table(spark, sf, "fx_history"))


@query("h6_continue_reading", duck_sql("fx_history", "fx_progress") + """
SELECT user_id, url, title, source_id, source_name, viewed_at, ratio, CAST(rank AS INT) AS rank FROM (
  SELECT r.*, p.ratio, row_number() OVER (PARTITION BY r.user_id ORDER BY viewed_at DESC, r.url) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY viewed_at DESC, url) AS rn FROM fx_history) r
  JOIN fx_progress p ON r.user_id = p.user_id AND r.url = p.url
  WHERE rn <= 200 AND p.ratio > CAST(0.02 AS FLOAT) AND p.ratio < CAST(0.98 AS FLOAT)) t WHERE rank <= 5""")
def h6(spark, sf):
    out = reading.continue_reading(*_records(spark, sf))
    return out.select("user_id", "url", "title", "source_id", "source_name", "viewed_at", "ratio", "rank")


@query("h7_record_history", duck_sql("fx_opened") + """
SELECT user_id, url, title, viewed_at, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY viewed_at DESC, event_id DESC) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, url ORDER BY viewed_at DESC, event_id DESC) AS rn FROM fx_opened) a WHERE rn = 1) b
WHERE n <= 500""")
def h7(spark, sf):
    opened = table(spark, sf, "fx_opened")
    half = F.col("event_id") % 2 == 0
    out = reading.record_history(opened.filter(half), opened.filter(~half))
    return out.select("user_id", "url", "title", "viewed_at", "event_id")


@query("h8_list_history", duck_sql("fx_history") + """
SELECT user_id, url, title, viewed_at, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY viewed_at DESC, url) AS rank FROM fx_history) t
WHERE rank <= 100 AND lower(title) LIKE '%article 1%'""")
def h8(spark, sf):
    return reading.list_history(table(spark, sf, "fx_history"), 100, "Article 1").select("user_id", "url", "title", "viewed_at", "rank")


@query("h9_upsert_progress", duck_sql("fx_progress") + """
SELECT user_id, url, ratio, updated_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC) AS n FROM fx_progress) t WHERE n <= 500""")
def h9(spark, sf):
    return reading.upsert_progress(None, table(spark, sf, "fx_progress_events"))


@query("h10_progress_for", duck_sql("fx_progress", "fx_history") + """
SELECT user_id, url, ratio, updated_at FROM fx_progress p
WHERE EXISTS (SELECT 1 FROM fx_history h WHERE h.user_id = p.user_id AND h.url = p.url AND h.source_id = 's3')""")
def h10(spark, sf):
    urls = table(spark, sf, "fx_history").filter("source_id = 's3'").select("user_id", "url")
    return reading.progress_for(table(spark, sf, "fx_progress"), urls)


@query("h11_contents_marks", duck_sql("fx_progress", "fx_history") + """
SELECT h.user_id, h.url AS link, p.ratio,
  CASE WHEN p.ratio IS NULL THEN 'unread' WHEN p.ratio >= CAST(0.98 AS FLOAT) THEN 'finished' ELSE 'started' END AS mark
FROM fx_history h LEFT JOIN fx_progress p ON h.user_id = p.user_id AND h.url = p.url""")
def h11(spark, sf):
    items = table(spark, sf, "fx_history").select("user_id", F.col("url").alias("link"))
    return reading.contents_marks(items, table(spark, sf, "fx_progress")).select("user_id", "link", "ratio", "mark")


SHELF_ITEMS = """items AS (
  SELECT DISTINCT 's' || CAST(event_id % 9 AS STRING) AS source_id, 'all' AS category,
    'https://site' || CAST(event_id % 40 AS STRING) || '.example/a/' || CAST(event_id % 400 AS STRING) AS link, event_id % 9 = 4 AS has_next
  FROM events WHERE event_id % 9 <> 5)"""


@query("h12_shelf_progress", duck_sql("fx_shelf", "fx_history_sources", "fx_progress") + f""",{SHELF_ITEMS}
SELECT s.user_id, s.source_id, s.category, s.added_at,
  CASE WHEN k.source_id IS NOT NULL THEN coalesce(max(l.total), 0) END AS total,
  CASE WHEN k.source_id IS NULL THEN 0 ELSE count(CASE WHEN p.ratio >= CAST(0.98 AS FLOAT) THEN 1 END) END AS finished,
  CASE WHEN k.source_id IS NULL THEN 0 ELSE count(CASE WHEN p.ratio > CAST(0.02 AS FLOAT) AND p.ratio < CAST(0.98 AS FLOAT) THEN 1 END) END AS partial,
  CASE WHEN k.source_id IS NULL THEN 'source_gone' WHEN coalesce(max(l.total), 0) = 0 THEN 'list_empty' WHEN max(CAST(l.more AS INT)) = 1 THEN 'first_page_only' ELSE '' END AS note
FROM fx_shelf s LEFT JOIN fx_history_sources k ON s.source_id = k.source_id
LEFT JOIN (SELECT source_id, category, count(*) AS total, bool_or(has_next) AS more FROM items GROUP BY ALL) l ON s.source_id = l.source_id AND s.category = l.category
LEFT JOIN items i ON s.source_id = i.source_id AND s.category = i.category
LEFT JOIN fx_progress p ON p.user_id = s.user_id AND p.url = i.link
GROUP BY s.user_id, s.source_id, s.category, s.added_at, k.source_id""")
def h12(spark, sf):
    e = F.col("event_id")
    text = lambda c: c.cast("string")
    items = table(spark, sf, "events").filter(e % 9 != 5).select(
        F.concat(F.lit("s"), text(e % 9)).alias("source_id"), F.lit("all").alias("category"),
        F.concat(F.lit("https://site"), text(e % 40), F.lit(".example/a/"), text(e % 400)).alias("link"), (e % 9 == 4).alias("has_next")).distinct()
    out = reading.shelf_progress(table(spark, sf, "fx_shelf"), table(spark, sf, "fx_history_sources"), items, table(spark, sf, "fx_progress"))
    return out.withColumn("added_at", F.col("added_at").cast("timestamp_ntz"))


@query("h13_highlight_id", duck_sql("fx_highlights") + f"""
SELECT hl_no, 'h' || lpad(lower(hex(CAST(list_reduce(
    list_concat([CAST(14695981039346656037 AS HUGEINT)], list_transform(regexp_extract_all(hex(encode(url) || '\\x00'::BLOB || encode({sql_strip('text')})), '..'), lambda b: CAST(CAST('0x' || b AS INT) AS HUGEINT))),
    lambda h, b: (xor(h, b) * 1099511628211) & 18446744073709551615) AS UBIGINT))), 16, '0') AS id FROM fx_highlights""")
def h13(spark, sf):
    rows = table(spark, sf, "fx_highlights")
    return rows.select("hl_no", highlight_id(F.col("url"), strip(F.col("text"))).alias("id"))


HIGHLIGHTS = duck_sql("fx_highlights") + f""", trimmed AS (SELECT * REPLACE ({sql_strip('text')} AS text) FROM fx_highlights),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, url, text ORDER BY hl_no) AS rn FROM trimmed
  WHERE text <> '' AND length(text) <= 2000) t WHERE rn = 1) """


def _added(spark, sf):
    rows = table(spark, sf, "fx_highlights")
    shape = rows.withColumn("id", F.lit("")).select("user_id", "id", "url", "title", "source_name", "text", "note", "created_s", "hl_no").schema
    stored = spark.createDataFrame([], shape)
    return marks.add_highlights(stored, rows, "hl_no")


@query("h14_add_highlights", HIGHLIGHTS + """
SELECT user_id, url, text, hl_no, '' AS reason FROM kept
UNION ALL SELECT user_id, url, text, hl_no, CASE WHEN text = '' THEN 'empty' ELSE 'too_long' END FROM trimmed WHERE text = '' OR length(text) > 2000""")
def h14(spark, sf):
    added, rejects = _added(spark, sf)
    columns = ["user_id", "url", "text", "hl_no", "reason"]
    return added.withColumn("reason", F.lit("")).select(columns).unionByName(rejects.select(columns))


@query("h15_update_notes", HIGHLIGHTS + """
SELECT hl_no, CASE WHEN hl_no % 20 = 0 THEN 'new ' || title WHEN hl_no % 20 = 10 THEN '' ELSE note END AS note, 'kept' AS part FROM kept
UNION ALL SELECT doc_id, 'x', 'unknown' FROM documents""")
def h15(spark, sf):
    added, _ = _added(spark, sf)
    n = F.col("hl_no") % 20
    notes = added.filter(n.isin(0, 10)).select("user_id", "id", "hl_no", F.when(n == 0, F.concat(F.lit(" new "), "title")).alias("new_note"))
    lost = table(spark, sf, "documents").select((F.col("doc_id") % 25).alias("user_id"), F.lit("h?").alias("id"), F.col("doc_id").alias("hl_no"), F.lit("x").alias("new_note"))
    done, unknown = marks.update_notes(added, notes.unionByName(lost))
    return done.select("hl_no", "note", F.lit("kept").alias("part")).unionByName(
        unknown.select("hl_no", F.col("new_note").alias("note"), F.col("reason").alias("part")))


@query("h16_search_highlights", HIGHLIGHTS + """
SELECT user_id, count(*) AS total, count(CASE WHEN note <> '' THEN 1 END) AS noted,
  count(CASE WHEN note <> '' AND (lower(text) LIKE '%the%' OR lower(note) LIKE '%the%' OR lower(title) LIKE '%the%' OR lower(source_name) LIKE '%the%') THEN 1 END) AS shown
FROM kept GROUP BY user_id""")
def h16(spark, sf):
    return marks.highlight_totals(_added(spark, sf)[0], "The", only_notes=True)


@query("h16_found_highlights", HIGHLIGHTS + "SELECT hl_no, url FROM kept WHERE lower(text) LIKE '%the%' OR lower(note) LIKE '%the%' OR lower(source_name) LIKE '%the%' OR lower(title) LIKE '%the%'")
def h16_found(spark, sf):
    return marks.search_highlights(_added(spark, sf)[0], "The").select("hl_no", "url")


@query("h17_list_highlights", HIGHLIGHTS + "SELECT user_id, url, hl_no, created_s FROM kept")
def h17(spark, sf):
    return marks.list_highlights(_added(spark, sf)[0]).select("user_id", "url", "hl_no", "created_s")


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '[{WS[1:-1]}\\x{{FEFF}}]+', '', 'g')"



@query("h18_locate_highlights", HIGHLIGHTS + f"""
SELECT hl_no, CAST(length({_bare('d.text')}) - length(replace({_bare('d.text')}, {_bare('k.text')}, '')) AS BIGINT)
  // length({_bare('k.text')}) AS occurrences
FROM kept k JOIN documents d ON k.url = 'https://docs.example/' || CAST(d.doc_id AS STRING)""")
def h18(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("article_text"))
    return marks.locate_highlights(_added(spark, sf)[0], docs).select("hl_no", "occurrences")


SHELF = """, adds AS (SELECT user_id, 'k' || CAST(event_id % 50 AS STRING) AS id, event_id AS ord, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS added_s
  FROM events WHERE event_type <> 'error'),
stored AS (SELECT user_id, 'k' || CAST(max(event_id) % 50 AS STRING) AS id, CAST(19720 AS BIGINT) AS added_s FROM events WHERE event_type = 'error' GROUP BY user_id),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY ord) AS rn FROM adds) a
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = a.user_id AND s.id = a.id)),
numbered AS (SELECT user_id, id, ord, added_s, row_number() OVER (PARTITION BY user_id ORDER BY ord) AS i FROM firsts),
stamped AS (SELECT n.user_id, id, i + greatest(max(n.added_s - i) OVER (PARTITION BY n.user_id ORDER BY ord ROWS UNBOUNDED PRECEDING), coalesce(t.top, 0)) AS added_s
  FROM numbered n LEFT JOIN (SELECT user_id, max(added_s) AS top FROM stored GROUP BY user_id) t ON n.user_id = t.user_id),
shelf AS (SELECT user_id, id, added_s FROM stored UNION ALL SELECT user_id, id, added_s FROM stamped) """


def _shelf(spark, sf):
    e = table(spark, sf, "events")
    ident = lambda c: F.concat(F.lit("k"), (c % 50).cast("string"))
    adds = e.filter("event_type <> 'error'").select(
        "user_id", ident(F.col("event_id")).alias("id"), F.col("event_id").alias("ord"), F.floor(reading.seconds_of(F.col("ts")) / 86400).alias("added_s"))
    stored = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max("event_id").alias("m")).select(
        "user_id", ident(F.col("m")).alias("id"), F.lit(19720).cast("bigint").alias("added_s"))
    return marks.add_shelf(stored, adds, "ord")


@query("h19_add_shelf", "WITH x AS (SELECT 1)" + SHELF + "SELECT user_id, id, added_s FROM shelf")
def h19(spark, sf):
    return _shelf(spark, sf)


@query("h20_remove_shelf", "WITH x AS (SELECT 1)" + SHELF + "SELECT user_id, id, added_s FROM shelf WHERE id NOT IN ('k1', 'k2', 'k3')")
def h20(spark, sf):
    shelf = _shelf(spark, sf)
    return marks.list_shelf(marks.remove_shelf(shelf, shelf.filter(F.col("id").isin("k1", "k2", "k3")).select("user_id", "id")))


@query("h20_on_shelf", "WITH x AS (SELECT 1)" + SHELF + """
SELECT DISTINCT e.user_id, 'k' || CAST(e.event_id % 60 AS STRING) AS id FROM events e
JOIN shelf s ON s.user_id = e.user_id AND s.id = 'k' || CAST(e.event_id % 60 AS STRING)""")
def h20_on(spark, sf):
    ids = table(spark, sf, "events").select("user_id", F.concat(F.lit("k"), (F.col("event_id") % 60).cast("string")).alias("id")).distinct()
    return marks.on_shelf(ids, _shelf(spark, sf))


@query("h21_clear_history", duck_sql("fx_history", "fx_progress") + """
SELECT 'history' AS part, user_id, url FROM fx_history WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 150)
UNION ALL SELECT 'progress', user_id, url FROM fx_progress WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 150)""")
def h21(spark, sf):
    users = table(spark, sf, "events").filter("value > 150").select("user_id").distinct()
    history, progress = marks.clear_history(*_records(spark, sf), users)
    return history.select(F.lit("history").alias("part"), "user_id", "url").unionByName(
        progress.select(F.lit("progress").alias("part"), "user_id", "url"))


@query("h22_playback_resume", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN
    CASE WHEN event_id % 10 <> 4 AND p >= 10 AND d > 0 AND p < d * 0.95 AND p < d - 1 THEN p END
  WHEN d > 0 AND p / d > 0.02 AND p / d < 0.98 THEN p END AS resume_at
FROM (SELECT event_id, value AS p, CAST(event_id % 97 AS DOUBLE) AS d FROM events) e""")
def h22(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        "event_id", F.col("value").alias("position"), (e % 97).cast("double").alias("duration"), (e % 10 == 4).alias("completed"),
        F.when(e % 2 == 0, "audio").otherwise("video").alias("kind"))
    return reading.playback_resume(rows).select("event_id", "resume_at")


@query("h23_retain_newest", """
SELECT cache_id, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM (
  SELECT source AS cache_id, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id * 7919 % 100003 DESC, doc_id) AS n FROM documents) t
WHERE n <= 60 GROUP BY cache_id""")
def h23(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("cache_id"), F.col("doc_id").alias("key"), F.col("text").alias("body"), (F.col("doc_id") * 7919 % 100003).alias("cached_at"))
    return reading.retain_newest(docs, 60)[1]
