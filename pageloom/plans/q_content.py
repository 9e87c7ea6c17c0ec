"""Articles, media and lyrics (F) over the given pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators import content, lyrics, media
from pageloom.plans import duck
from pageloom.plans.registry import query
from pageloom.plans.q_lists import JSON_BODIES
from pageloom.plans.tables import duck_sql, nodes_table, rule_sources, table, web_pages

BODY = "regexp_extract(html, '(?s)<article>.*</article>')"
FIRST_P = "regexp_extract(html, '(?s)<article>.*?(<p>.*?)(<p>|</p>|</article>)', 1)"


# The paragraphs of an article, ended by their end tag or by what begins next.
PARAGRAPHS = f"""list_transform(string_split({BODY}, '<p>')[2:], lambda x: '<p>' || CASE WHEN contains(x, '</p>') THEN substr(x, 1, strpos(x, '</p>') + 3)
  ELSE regexp_replace(x, '</article>$', '') END)"""
# Two blanks a level, members in order of their names.
INDENTED = """array_to_string(list_transform(string_split(json_pretty(CASE kind WHEN 3 THEN '[{"book":' || (v->'$[0].book') || ',"url":' || (v->'$[0].url') || '}]'
  WHEN 4 THEN '{"book":' || (v->'$.book') || ',"box":' || (v->'$.box') || ',"data":[]}' ELSE CAST(v AS STRING) END), chr(10)),
  lambda l: repeat(' ', (length(l) - length(ltrim(l))) // 2) || ltrim(l)), chr(10))"""
ARTICLES = f""", html_pages AS (SELECT page_id, html, page_id % 12 AS k, {BODY} AS a, list_filter({PARAGRAPHS}, lambda p: strlen(p) > 40)[1] AS p FROM pages),
html_cut AS (SELECT page_id, k, html, CASE WHEN k = 4 AND strlen(a) > 40 THEN a WHEN k = 10 AND p IS NOT NULL THEN p END AS by_rule, CASE WHEN strlen(a) > 120 THEN a END AS usual FROM html_pages),
json_made AS (SELECT *, CASE WHEN v IS NULL THEN NULL
    WHEN s = 12 THEN '<h3>' || coalesce(v->>'$.data.list[0].title', '') || '</h3><img src="https://api.example/i/' || coalesce(v->>'$.data.list[0].aid', '') || '.png">'
    WHEN s = 13 THEN CASE kind WHEN 1 THEN v->>'$.data.list[0].title' WHEN 3 THEN v->>'$[0].book.title' WHEN 4 THEN 'top' END
    WHEN s = 15 AND kind = 2 THEN v->>'$.data[0].name' WHEN s = 18 AND kind = 3 THEN v->>'$[0].book.title' END AS made FROM jb),
json_shown AS (SELECT *, CASE WHEN made IS NULL AND v IS NOT NULL THEN {INDENTED} END AS pretty FROM json_made),
articles AS (
  SELECT page_id, CAST(k AS INT) AS source_no, CASE WHEN by_rule IS NOT NULL THEN 'rule' WHEN usual IS NOT NULL THEN 'container' ELSE 'page' END AS origin,
    coalesce(by_rule, usual, html) AS content_html, CASE WHEN by_rule IS NULL AND usual IS NULL THEN {duck.readable('html')} ELSE {duck.html_text('coalesce(by_rule, usual)')} END AS content_text FROM html_cut
  UNION ALL SELECT -1 - body_id, CAST(s AS INT), CASE WHEN made IS NOT NULL THEN 'rule' WHEN pretty IS NOT NULL THEN 'json' ELSE 'page' END,
    coalesce(made, '<pre>' || {duck.entities('pretty')} || '</pre>', body),
    CASE WHEN made IS NOT NULL OR pretty IS NOT NULL THEN {duck.html_text('coalesce(made, pretty)')} ELSE {duck.readable('body')} END FROM json_shown)"""


@query("f1_extract_content", duck_sql("fx_json_bodies") + JSON_BODIES + ARTICLES + "SELECT * FROM articles")
def f1(spark, sf):
    """The articles of all pages, HTML and JSON, under all rule shapes."""
    return content.extract_content(*web_pages(spark, sf), rule_sources(spark, sf))


@query("f1_extract_json_content", duck_sql("fx_json_bodies") + """
SELECT body_id, '<h3>' || coalesce(v->>'$.data[0].name', '') || '</h3><img src="https://api.example/i/' || coalesce(v->>'$.data[0].id', '') || '.png">' AS content_html,
  coalesce(v->>'$.data[0].name', '') AS content_text
FROM (SELECT body_id, json(body) AS v FROM fx_json_bodies WHERE json_valid(body) AND regexp_matches(body, '^\\s*[{\\[]')) t""")
def f1_json(spark, sf):
    return content.extract_json_content(
        table(spark, sf, "fx_json_bodies"), '<h3>{{$.data[0].name}}</h3><img src="/i/{{$.data[0].id}}.png">', F.lit("https://api.example/p?x=1"))


HREF = "concat(replace(replace(html, '<a href=\"/', '<a href=\"./k/../'), '<br>', '<img src=''i.png'' data-src=\"#\"><video poster = \"//v.example/p\">'), '<a href=\"https://abs.example/x\">')"


def _absolutized() -> str:
    origin = duck.origin("url")
    folder = f"({origin} || regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '[^/]*$', ''))"
    # The links are the only relative addresses with non-ASCII characters.
    link = duck.encode("regexp_extract(p, '^\\./k/\\.\\./([^\"]*)', 1)")
    cut = f"CASE WHEN p LIKE './k/../%' THEN {folder} || {link} || regexp_replace(p, '^[^\"]*', '') ELSE p END"
    text = f"array_to_string(list_transform(string_split({HREF}, 'href=\"'), lambda p: {cut}), 'href=\"')"
    return f"replace({text}, 'src=''i.png''', 'src=''' || {folder} || 'i.png''')"


@query("f3_absolutize_urls", f"SELECT page_id, {_absolutized()} AS html FROM pages")
def f3(spark, sf):
    html = F.replace(F.col("html"), F.lit('<a href="/'), F.lit('<a href="./k/../'))
    html = F.replace(html, F.lit("<br>"), F.lit("<img src='i.png' data-src=\"#\"><video poster = \"//v.example/p\">"))
    html = F.concat(html, F.lit('<a href="https://abs.example/x">'))
    return table(spark, sf, "pages").select("page_id", content.absolutize_urls(html, F.col("url")).alias("html"))


TITLE = duck.clean(duck.entities("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))
HEADING = duck.clean(duck.parsed("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))


@query("f4_page_title", f"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {TITLE} WHEN length({HEADING}) < 200 THEN {HEADING} ELSE '' END AS title FROM pages""")
def f4(spark, sf):
    """Every other page goes without its title tag, so headings have to serve."""
    bare = F.regexp_replace("html", "<title>.*?</title>", "")
    pages = table(spark, sf, "pages").withColumn("html", F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(bare))
    return content.page_title(pages, nodes_table(spark, sf))


MEDIA = duck_sql("fx_media_pages")
ORIGIN = duck.origin("url")


def _media(spark, sf):
    return nodes_table(spark, sf, "fx_media_pages"), table(spark, sf, "fx_media_pages")


@query("f5_media_catalog", MEDIA + """
SELECT page_id, 'source' AS tag, 'https://v.example/' || CAST(page_id AS STRING) || '.m3u8' AS media_url FROM fx_media_pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'img', '//img.example/b.png' FROM fx_media_pages""")
def f5(spark, sf):
    return media.media_catalog(_media(spark, sf)[0])


@query("f6_image_catalog", MEDIA + f"""
SELECT page_id, {ORIGIN} || '/i/' || CAST(page_id AS STRING) || '.jpg' AS image_url FROM fx_media_pages
UNION ALL SELECT page_id, regexp_extract(url, '^[a-z]+:') || '//img.example/b.png' FROM fx_media_pages""")
def f6(spark, sf):
    return media.image_catalog(*_media(spark, sf))


@query("f7_audio_catalog", MEDIA + f"SELECT page_id, {ORIGIN} || '/m/t' || CAST(page_id % 5 AS STRING) || '.mp3?k=1' AS audio_url FROM fx_media_pages")
def f7(spark, sf):
    return media.audio_catalog(*_media(spark, sf)).select("page_id", "audio_url")


@query("f8_track_titles", MEDIA + f"""
SELECT page_id, {ORIGIN} || '/m/t' || CAST(page_id % 5 AS STRING) || '.mp3?k=1' AS audio_url, 'Track ' || CAST(page_id AS STRING) AS track_title FROM fx_media_pages""")
def f8(spark, sf):
    nodes, pages = _media(spark, sf)
    return media.track_titles(media.audio_catalog(nodes, pages), media.page_links(nodes, pages))


@query("f9_subtitle_catalog", MEDIA + f"""
SELECT page_id, {ORIGIN} || '/s/' || CAST(page_id AS STRING) || '.vtt' AS subtitle_url, 'en' AS label, 'en' AS lang, true AS is_default FROM fx_media_pages WHERE page_id % 2 = 0""")
def f9(spark, sf):
    return media.subtitle_catalog(*_media(spark, sf))


@query("f10_pair_lyrics", MEDIA + f"""
SELECT page_id, {ORIGIN} || '/m/t' || CAST(page_id % 5 AS STRING) || '.mp3?k=1' AS audio_url,
  CASE page_id % 3 WHEN 0 THEN {ORIGIN} || '/l/T-' || CAST(page_id % 5 AS STRING) || '.lrc' WHEN 1 THEN {ORIGIN} || '/l/other.lrc' END AS lyric_url FROM fx_media_pages""")
def f10(spark, sf):
    nodes, pages = _media(spark, sf)
    return media.pair_lyrics(media.audio_catalog(nodes, pages), media.lyric_links(nodes, pages))


@query("f11_presentation_mode", MEDIA + """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'music' WHEN 1 THEN 'rich' WHEN 2 THEN 'video' ELSE 'rich' END AS mode FROM fx_media_pages""")
def f11(spark, sf):
    """How the media pages open when half of them come without their audio."""
    nodes, pages = _media(spark, sf)
    count = lambda df, name: df.groupBy("page_id").agg(F.count("*").alias(name))
    audio = media.audio_catalog(nodes, pages).filter("page_id % 4 = 0")
    video = media.media_catalog(nodes).filter(F.col("media_url").rlike(r"\.(m3u8|mp4|webm|mov|mkv)"))
    rows = pages.select("page_id", F.col("html").alias("content_html"), F.lit("").alias("content_text"))
    for df, name in ((audio, "n_audio"), (video, "n_video"), (media.image_catalog(nodes, pages), "n_images")):
        rows = rows.join(count(df, name), "page_id", "left")
    return content.presentation_mode(rows.na.fill(0, ["n_audio", "n_video", "n_images"])).select("page_id", "mode")


# Ends are marked, then cut: a run of terminators, or a full stop before white space.
SENTENCES = r"""SELECT doc_id, s AS sentence FROM (SELECT doc_id, unnest(string_split(
  regexp_replace(regexp_replace(text, '([。！？；…!?;]+)', '\1' || chr(1), 'g'), '\.(\s)', '.' || chr(1) || '\1', 'g'), chr(1))) AS s FROM documents) t
WHERE regexp_matches(s, '\S')"""


@query("f13_split_sentences", f"SELECT doc_id, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM ({SENTENCES}) q GROUP BY doc_id")
def f13(spark, sf):
    """Cutting loses and adds nothing: the characters of all sentences, per document."""
    rows = content.split_sentences(table(spark, sf, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.sum(F.length("sentence")).cast("bigint").alias("chars"))


def _piece(dots: int) -> str:
    """The next piece of a long sentence where that many full stops stand at the limit."""
    head = f"regexp_extract(rest, '(?s)^.{{71,{139 + dots}}}[,，、]')"
    return f"WHEN regexp_matches(rest, '^[^。！？；…!?;]{{139}}\\.{{{dots}}}[^。！？；…!?;.]') THEN CASE WHEN {head} <> '' THEN {head} ELSE substr(rest, 1, {140 + dots}) END"


CUT_SENTENCES = SENTENCES.replace("SELECT doc_id, s AS sentence FROM (SELECT doc_id, unnest(", "SELECT doc_id, n, s AS sentence FROM (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS s FROM (SELECT doc_id, (").replace(
    " AS s FROM documents) t", " AS l FROM documents) d) t")


@query("f13_sentences", f"""WITH RECURSIVE cut AS (
  SELECT doc_id, n, 0 AS k, CASE WHEN length(sentence) < 140 THEN sentence END AS piece, CASE WHEN length(sentence) < 140 THEN '' ELSE sentence END AS rest FROM ({CUT_SENTENCES}) q
  UNION ALL SELECT doc_id, n, k + 1, take, substr(rest, length(take) + 1) FROM (
    SELECT *, CASE {' '.join(_piece(dots) for dots in range(4))} ELSE rest END AS take FROM cut WHERE rest <> '') c)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS INT) AS ix, piece AS sentence FROM cut
WHERE regexp_matches(regexp_replace(piece, '[\\x{{00A0}}\\x{{3000}}\\x{{FEFF}}]', '', 'g'), '\\S')""")
def f13_sentences(spark, sf):
    """Every sentence, cut at the default limit, in its place."""
    return content.split_sentences(table(spark, sf, "documents"), "doc_id", "text")


LRC = duck_sql("fx_lrc") + r""", stamped AS (
  SELECT track_id, line_no, raw_line, 0 AS stamp_no, regexp_extract(raw_line, '^\[(\d+:\d+[.:]\d+)\]', 1) AS s FROM fx_lrc
  UNION ALL SELECT track_id, line_no, raw_line, 1, regexp_extract(raw_line, '^\[[^\]]*\]\[(\d+:\d+[.:]\d+)\]', 1) FROM fx_lrc),
lines AS (SELECT track_id, line_no, CAST(stamp_no AS INT) AS stamp_no,
    (CAST(split_part(s, ':', 1) AS BIGINT) * 60 + CAST(regexp_extract(s, ':(\d+)', 1) AS BIGINT)) * 1000 + CAST(rpad(regexp_extract(s, '(\d+)$', 1), 3, '0') AS BIGINT) AS t_ms,
    trim(regexp_replace(raw_line, '^(\[\d+:\d+[.:]\d+\])+', '')) AS text FROM stamped WHERE s <> ''),
offsets AS (SELECT track_id, CAST(regexp_extract(raw_line, '^\[offset:(-?\d+)\]', 1) AS BIGINT) AS file_ms FROM fx_lrc WHERE raw_line LIKE '[offset:%') """


@query("f15_parse_lrc", LRC + "SELECT track_id, line_no, stamp_no, t_ms, text FROM lines")
def f15(spark, sf):
    return lyrics.parse_lrc(table(spark, sf, "fx_lrc"))


@query("f16_lrc_offset", LRC + "SELECT track_id, file_ms FROM offsets")
def f16(spark, sf):
    return lyrics.lrc_offset(table(spark, sf, "fx_lrc"))


POSITIONS = ", positions AS (SELECT event_id AS pos_id, event_id % (SELECT max(conv_id) + 1 FROM conversations) AS track_id, CAST(floor(value * 10) AS BIGINT) % 700 / 10.0 AS position FROM events) "


def _positions(spark, sf):
    tracks = table(spark, sf, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    e = table(spark, sf, "events").crossJoin(F.broadcast(tracks))  # one row
    return e.select(F.col("event_id").alias("pos_id"), (F.col("event_id") % F.col("n")).alias("track_id"),
                    (F.floor(F.col("value") * 10) % 700 / 10.0).cast("double").alias("position"))


@query("f17_lyric_at", LRC + POSITIONS + """
SELECT p.pos_id, p.track_id, CAST(p.position AS DOUBLE) AS position, l.t_ms AS line_ms, l.text AS line_text FROM positions p LEFT JOIN offsets o ON p.track_id = o.track_id
LEFT JOIN LATERAL (SELECT t_ms, text FROM lines l WHERE l.track_id = p.track_id
  AND l.t_ms <= CAST(round(p.position * 1000) AS BIGINT) - coalesce(o.file_ms, 0) ORDER BY t_ms DESC, line_no DESC, stamp_no DESC LIMIT 1) l ON true""")
def f17(spark, sf):
    lrc = table(spark, sf, "fx_lrc")
    return lyrics.lyric_at(lyrics.parse_lrc(lrc), _positions(spark, sf), lyrics.lrc_offset(lrc).withColumnRenamed("file_ms", "offset_ms"))


@query("f18_effective_offset", LRC + """
SELECT t.track_id, CAST(greatest(-5000, least(5000, coalesce(CASE WHEN t.track_id % 3 = 0 THEN t.track_id * 100 - 4000 END,
  CASE WHEN t.track_id % 4 = 1 THEN -70 END, o.file_ms, 0))) AS BIGINT) AS offset_ms
FROM (SELECT DISTINCT track_id FROM fx_lrc) t LEFT JOIN offsets o ON t.track_id = o.track_id""")
def f18(spark, sf):
    lrc = table(spark, sf, "fx_lrc")
    t = F.col("track_id")
    tracks = lrc.select("track_id", (t % 4).alias("source_id")).distinct()
    song = tracks.filter(t % 3 == 0).select("track_id", (t * 100 - 4000).alias("song_ms"))
    source = tracks.filter("source_id = 1").select("source_id").distinct().withColumn("source_ms", F.lit(-70))
    return lyrics.effective_offset(tracks, song, source, lyrics.lrc_offset(lrc))
