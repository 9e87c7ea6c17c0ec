"""Text, address, JSON and rule expressions (A5, B6, B16, D4-D6, D13, D17, E, F2, F12, F19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions import jsonpath, rules, text, times, urls
from pageloom.plans import duck
from pageloom.plans.registry import query
from pageloom.plans.tables import duck_sql, table

DIRTY = """dirty AS (SELECT doc_id,
  chr(8203) || '  ' || replace(text, '. ', chr(160) || chr(12288) || '&amp;lt; &#8217;&#x4e2d;' || chr(9) || '&ldquo;') || ' &nbsp; &#39;x&apos;' || chr(65279) AS t FROM documents)"""


def _dirty(spark, sf):
    """Document texts with entities and unusual white space worked into every sentence."""
    c = lambda n: F.decode(F.unhex(F.lit(f"{n:08x}")), "UTF-32")
    joint = F.concat(c(160), c(12288), F.lit("&amp;lt; &#8217;&#x4e2d;\t&ldquo;"))
    t = F.concat(c(8203), F.lit("  "), F.replace(F.col("text"), F.lit(". "), joint), F.lit(" &nbsp; &#39;x&apos;\ufeff"))
    return table(spark, sf, "documents").select("doc_id", t.alias("t"))


@query("e1_clean_text", f"WITH {DIRTY} SELECT doc_id, {duck.clean('t')} AS cleaned FROM dirty")
def e1(spark, sf):
    return _dirty(spark, sf).select("doc_id", text.clean_text(F.col("t")).alias("cleaned"))


@query("e2_html_to_text", f"SELECT page_id, {duck.html_text('html')} AS plain FROM pages")
def e2(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("plain"))


@query("e3_decode_entities", f"WITH {DIRTY} SELECT doc_id, {duck.entities('t')} AS decoded FROM dirty")
def e3(spark, sf):
    return _dirty(spark, sf).select("doc_id", text.decode_entities(F.col("t")).alias("decoded"))


def _bodies(spark, sf):
    return table(spark, sf, "fx_json_bodies")


VALID = "CASE WHEN json_valid(body) AND regexp_matches(body, '^\\s*[{\\[]') THEN json(body) END"


@query("e4_json_path", duck_sql("fx_json_bodies") + f"""
SELECT body_id, array_to_string(list_filter(list_concat(coalesce(v->>'$.data.list[*].title', []), coalesce(v->>'$.data[*].name', [])), lambda x: x IS NOT NULL), '|') AS found
FROM (SELECT body_id, {VALID} AS v FROM fx_json_bodies) t""")
def e4(spark, sf):
    v = F.try_parse_json("body")
    found = F.concat(jsonpath.json_path(v, "$.data.list[*].title"), jsonpath.json_path(v, "data.name"))
    return _bodies(spark, sf).select("body_id", F.array_join(F.coalesce(found, F.array().cast("array<string>")), "|").alias("found"))


FORMS = [
    "$.data.list[0:1].title", "$.data.list[-1].aid", "$.data.list[1,0].aid", "$.data.list[0]['title','aid']", "$.data.list[?(@.aid > 100)].aid",
    "$.data[?(@.time == '2024' && @.id)].name", "$[?(@.book)].url", "$..title", "$..rows2[*].book.title", "$.data.list[::-1].aid", "$.data.list[", "$.data[?(@.x >", "$$.next"]


@query("e4_json_forms", duck_sql("fx_json_bodies") + f"""
, b AS (SELECT body_id, {VALID} AS v FROM fx_json_bodies),
e AS (SELECT body_id, i, v->('$.data.list[' || CAST(i AS STRING) || ']') AS e FROM b, (SELECT unnest([0, 1]) AS i) x WHERE json_array_length(v, '$.data.list') > i),
f AS (SELECT body_id, 0 AS form, 0 AS ix, e->>'$.title' AS text FROM e WHERE i = 0
  UNION ALL SELECT body_id, 1, 0, e->>'$.aid' FROM e WHERE i = 1
  UNION ALL SELECT body_id, 2, 1 - i, e->>'$.aid' FROM e
  UNION ALL SELECT body_id, 3, k, CASE k WHEN 0 THEN e->>'$.title' ELSE e->>'$.aid' END FROM e, (SELECT unnest([0, 1]) AS k) y WHERE i = 0
  UNION ALL SELECT body_id, 4, row_number() OVER (PARTITION BY body_id ORDER BY i) - 1, e->>'$.aid' FROM e WHERE CAST(e->>'$.aid' AS BIGINT) > 100
  UNION ALL SELECT body_id, 5, 0, v->>'$.data[0].name' FROM b WHERE v->>'$.data[0].time' = '2024'
  UNION ALL SELECT body_id, 6, 0, v->>'$[0].url' FROM b WHERE v->>'$[0].book' IS NOT NULL
  UNION ALL SELECT body_id, 7, generate_subscripts(l, 1) - 1, unnest(l) FROM (SELECT body_id, CASE WHEN body_id % 6 = 4 THEN ['top', v->>'$.box.rows2[0].book.title'] ELSE v->>'$..title' END AS l FROM b WHERE v IS NOT NULL) t
  UNION ALL SELECT body_id, 8, 0, v->>'$.box.rows2[0].book.title' FROM b WHERE v->>'$.box.rows2[0]' IS NOT NULL
  UNION ALL SELECT body_id, 9, 1 - i, e->>'$.aid' FROM e)
SELECT body_id, CAST(form AS INT) AS form, CAST(ix AS INT) AS ix, text FROM f""")
def e4_forms(spark, sf):
    """Paths of every form, as rows, over every body; three of them are no paths, which stops nothing."""
    forms = spark.createDataFrame(list(enumerate(FORMS)), "form int, path string").select("form", jsonpath.path_plan(F.col("path")).alias("steps"))
    plans = F.array(*[F.struct(F.lit(i).alias("form"), F.lit(p).alias("path")) for i, p in enumerate(FORMS)])
    rows = _bodies(spark, sf).select("body_id", F.try_parse_json("body").alias("v"), F.explode(plans).alias("f"))
    rows = rows.select("body_id", "v", F.col("f.form").alias("form")).join(F.broadcast(forms), "form")  # the forms above, no more
    texts = F.transform(jsonpath.json_select(F.col("v"), F.col("steps")), jsonpath.json_text)
    return rows.filter("v is not null").select("body_id", "form", F.posexplode(texts).alias("ix", "text"))


@query("e4_json_descend", duck_sql("fx_json_bodies") + f"""
SELECT body_id, unnest(coalesce(v->>'$..title', [])) AS text FROM (SELECT body_id, {VALID} AS v FROM fx_json_bodies) t""")
def e4_deep(spark, sf):
    return jsonpath.json_descend(_bodies(spark, sf), "title").select("body_id", "text")


@query("e5_json_first_of", duck_sql("fx_json_bodies") + f"""
SELECT body_id, coalesce(nullif(v->>'$.book.title', ''), nullif(v->>'$[0].book.title', ''), nullif(v->>'$.data[0].name', ''), nullif(v->>'$.data.list[0].title', ''), '') AS title
FROM (SELECT body_id, {VALID} AS v FROM fx_json_bodies) t""")
def e5(spark, sf):
    v = F.try_parse_json("body")
    rule = "$.book.title || $.data[0].name||$.data.list[0].title"
    return _bodies(spark, sf).select("body_id", jsonpath.json_first_of(v, rule).alias("title"))


@query("e6_json_steps", duck_sql("fx_json_bodies") + f"""
SELECT body_id, coalesce(v->>'$.data.list[1].aid', '') AS second FROM (SELECT body_id, {VALID} AS v FROM fx_json_bodies) t
WHERE json_array_length(v, '$.data.list') > 1""")
def e6(spark, sf):
    found = jsonpath.json_values(F.try_parse_json("body"), "$.data.list")
    out = jsonpath.json_steps(found, [("children", ""), ("next", ""), ("attr", "aid")])
    return _bodies(spark, sf).select("body_id", F.explode(out).alias("second"))


@query("e7_render_template", duck_sql("fx_json_bodies") + f"""
SELECT body_id, 'https://x.example/' || coalesce(v->>'$.data.list[0].aid', '') || '?n=' || regexp_replace(coalesce(v->>'$.data.list[0].title', ''), '[aeiou]', '_', 'g') || '!' AS link
FROM (SELECT body_id, {VALID} AS v FROM fx_json_bodies) t WHERE v IS NOT NULL""")
def e7(spark, sf):
    v = F.try_parse_json(F.when(jsonpath.is_json_body(F.col("body")), F.col("body")))
    rows = _bodies(spark, sf).select("body_id", v.alias("v")).filter("v is not null")
    template = "https://x.example/{{$.data.list[0].aid}}?n={{ data.list[0].title##[aeiou]##_ }}!"
    return rows.select("body_id", rules.render_template(F.col("v"), template).alias("link"))


@query("e8_regex_op", """
SELECT doc_id, regexp_replace(text, '(?i)(?:THE|\\s(an?)d\\b)', '<\\1>', 'g') AS replaced, regexp_replace(text, '[0-9]+', '', 'g') AS stripped FROM documents""")
def e8(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", rules.regex_op(c, r"THE|\s(an?)d\b", "<$1>", ignore_case=True).alias("replaced"),
        rules.regex_suffix(rules.regex_suffix(c, "[0-9]+##"), "(unclosed##x").alias("stripped"))


@query("e9_fill_vars", duck_sql("fx_source_records") + """
SELECT rec_no, replace(replace(replace(replace(search_url, '{{keyWord}}', name), '<keyWord>', name), '{{page}}', '3'), '<page>', '3') AS filled FROM fx_source_records""")
def e9(spark, sf):
    values = F.create_map(F.lit("page"), F.lit("3"), F.lit("keyWord"), F.col("name"))
    return table(spark, sf, "fx_source_records").select("rec_no", rules.fill_vars(F.col("search_url"), values).alias("filled"))


@query("e10_json_field_default", duck_sql("fx_json_bodies") + f"""
SELECT body_id, coalesce(nullif(trim(e->>'$.vod_name'), ''), nullif(trim(e->>'$.name'), ''), nullif(trim(e->>'$.title'), ''), '') AS title,
  coalesce(e->>'$.vod_id', e->>'$.url', e->>'$.link', e->>'$.play_url', '') AS link, coalesce(e->>'$.vod_pic', e->>'$.pic', '') AS image,
  coalesce(e->>'$.vod_time', e->>'$.time', '') AS date
FROM (SELECT body_id, coalesce(v->'$.data.list[1]', v->'$.data[0]', v->'$[0]') AS e FROM (SELECT body_id, {VALID} AS v FROM fx_json_bodies) t) u WHERE e IS NOT NULL""")
def e10(spark, sf):
    v = F.try_parse_json("body")
    first = F.coalesce(*[F.try_variant_get(v, F.lit(p), "variant") for p in ("$.data.list[1]", "$.data[0]", "$[0]")])
    rows = _bodies(spark, sf).select("body_id", first.alias("e")).filter("e is not null")
    return rows.select("body_id", *[
        F.trim(jsonpath.json_field_default(F.col("e"), rule)).alias(name)
        for name, rule in [("title", "ruleTitle"), ("link", "ruleLink"), ("image", "ruleImage"), ("date", "rulePubDate")]])


@query("e11_infer_json_list", duck_sql("fx_json_bodies") + f"""
SELECT body_id, CASE WHEN json_type(v, '$.data') = 'ARRAY' AND json_array_length(v, '$.data') > 0 THEN '$.data'
  WHEN json_type(v, '$.data.list') = 'ARRAY' THEN '$.list' WHEN json_type(v, '$.box.rows2') = 'ARRAY' THEN '$.rows2' ELSE '' END AS rule
FROM (SELECT body_id, {VALID} AS v FROM fx_json_bodies) t""")
def e11(spark, sf):
    return jsonpath.infer_json_list(_bodies(spark, sf), "body_id")


@query("e12_lookup_verdict", duck_sql("fx_json_bodies") + f"""
SELECT body_id, CASE WHEN v IS NULL OR json_array_length(v, '$.data.list') IS NULL OR json_array_length(v, '$.data.list') = 0 THEN 'no_match'
  WHEN trim(coalesce(v->>'$.data.list[1].title', '')) = '' THEN 'empty_values' ELSE 'values' END AS verdict, 'bad_path' AS broken,
  CASE WHEN json_array_length(v, '$.data') > 0 THEN 'values' ELSE 'no_match' END AS filtered,
  CASE WHEN body_id % 6 = 1 THEN CASE WHEN v IS NULL THEN 'no_match' ELSE 'values' END WHEN body_id % 6 IN (3, 4) AND v IS NOT NULL THEN 'values' ELSE 'no_match' END AS deep
FROM (SELECT body_id, {VALID} AS v FROM fx_json_bodies) t""")
def e12(spark, sf):
    rows = _bodies(spark, sf).select("body_id", F.try_parse_json("body").alias("v"))  # parsed once for all checks
    check = lambda p: jsonpath.lookup_verdict(jsonpath.json_path(F.col("v"), p), F.lit(jsonpath.path_steps(p) is not None))
    return rows.select(
        "body_id", check("$.data.list[1].title").alias("verdict"), check("$.data[?(").alias("broken"), check("$.data[?(@.time=='2024')].name").alias("filtered"),
        check("$..title").alias("deep"))


@query("e13_is_json_body", duck_sql("fx_json_bodies") + f"SELECT body_id, {VALID} IS NOT NULL AS is_json FROM fx_json_bodies")
def e13(spark, sf):
    return _bodies(spark, sf).select("body_id", jsonpath.is_json_body(F.col("body")).alias("is_json"))


@query("e14_format_time", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS plain, strftime(ts, '%Y/%-m ') || CASE WHEN hour(ts) % 12 = 0 THEN '12' ELSE CAST(hour(ts) % 12 AS STRING) END
  || strftime(ts, ' %p %a %H:%M:%S.%g') AS full, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS shanghai, '' AS bad FROM events""")
def e14(spark, sf):
    rows = table(spark, sf, "events")
    ms = F.floor(times.epoch_micros(F.col("ts")) / 1000)
    return rows.select(
        "event_id", times.format_time(ms).alias("plain"), times.format_time(ms, "yyyy/M h a EEE HH:mm:ss.SSS").alias("full"),
        times.format_time(ms, "yyyy-MM-dd HH:mm:ss", "Asia/Shanghai").alias("shanghai"), times.format_time(F.col("event_type")).alias("bad"))


@query("e15_format_time_utc", """
SELECT event_id, strftime(ts + to_minutes(330), '%Y-%m-%d %H:%M:%S') AS at_530, strftime(ts - to_hours(event_id % 12), '%Y/%m/%d') AS shifted FROM events""")
def e15(spark, sf):
    rows = table(spark, sf, "events")
    ms = F.floor(times.epoch_micros(F.col("ts")) / 1000)
    return rows.select("event_id", times.format_time_utc(ms, "YYYY-MM-DD HH:mm:ss", 5.5).alias("at_530"),
                       times.format_time_utc(ms, "yyyy/MM/dd", -(F.col("event_id") % 12)).alias("shifted"))


@query("e16_coding", """
SELECT doc_id, to_base64(encode(text)) AS b64, text AS back, url_encode(text) AS quoted, text AS unquoted,
  regexp_extract(text, '([A-Z][a-z]+) ([a-z]+)', 0) || chr(10) || regexp_extract(text, '([A-Z][a-z]+) ([a-z]+)', 1) || chr(10) || regexp_extract(text, '([A-Z][a-z]+) ([a-z]+)', 2) AS found,
  lang = '' AS blank FROM documents""")
def e16(spark, sf):
    c = F.col("text")
    # The SQL function keeps "-_.~" only; the five further marks are compared through it.
    quoted = text.url_quote(c)
    for char, code in [("!", "%21"), ("*", "%2A"), ("'", "%27"), ("(", "%28"), (")", "%29")]:
        quoted = F.replace(quoted, F.lit(char), F.lit(code))
    found = text.first_match(c, r"([A-Z][a-z]+) ([a-z]+)")
    return table(spark, sf, "documents").select(
        "doc_id", text.b64_encode(c).alias("b64"), text.b64_decode(text.b64_encode(c)).alias("back"), quoted.alias("quoted"),
        text.url_unquote(text.url_quote(c)).alias("unquoted"), F.when(found == "", "\n\n").otherwise(found).alias("found"),
        text.is_blank(F.col("lang")).alias("blank"))


@query("e17_report_text", """
SELECT doc_id, CASE WHEN length(s) <= 40 THEN s ELSE substr(s, 1, 19) || '…' || right(s, 19) END AS short,
  CASE WHEN length(p) > 90 THEN substr(p, 1, 90) || '…' ELSE p END AS preview,
  CASE WHEN n < 1024 THEN CAST(n AS STRING) || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS size
FROM (SELECT doc_id, {0} AS s, trim(regexp_replace(text, '[{1}\\x{{FEFF}}]+', ' ', 'g')) AS p, n_chars * 977 AS n FROM documents) t""".format(
    duck.strip("text"), duck.WS[1:-1]))
def e17(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", text.short_text(c, 40).alias("short"), text.preview(c).alias("preview"), text.size_label(F.col("n_chars") * 977).alias("size"))


@query("f2_readable_text", f"SELECT page_id, {duck.readable('html')} AS readable FROM pages")
def f2(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.readable_text(F.col("html")).alias("readable"))


UNSAFE = "replace(html, '<nav>', '<nav onclick=\"go(1)\" class=\"n\"><a href=\"javascript:x()\">j</a><iframe src=\"/f\"></iframe>')"


def _sanitized_sql() -> str:
    out = UNSAFE
    for tag in "script style link meta iframe object embed form noscript".split():
        out = rf"regexp_replace({out}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
        out = rf"regexp_replace({out}, '(?is)</?{tag}\b[^>]*>', '', 'g')"
    return f"replace(replace({out}, ' onclick=\"go(1)\"', ' '), '<a href=\"javascript:x()\">', '<a >')"


@query("f12_sanitize_html", f"SELECT page_id, {_sanitized_sql()} AS safe FROM pages")
def f12(spark, sf):
    html = F.replace(F.col("html"), F.lit("<nav>"), F.lit(
        '<nav onclick="go(1)" class="n"><a href="javascript:x()">j</a><iframe src="/f"></iframe>'))
    return table(spark, sf, "pages").select("page_id", text.sanitize_html(html).alias("safe"))


@query("f19_block_wall", """
SELECT doc_id, CASE WHEN lower(text) LIKE '%that the%' THEN 'that THE' WHEN lower(text) LIKE '%elle%' THEN 'elle' END AS marker FROM documents""")
def f19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.block_wall(F.col("text"), ["that THE", "elle"]).alias("marker"))


LINKS = duck_sql("fx_links")
H = duck.strip("href")


@query("d4_is_plausible_link", LINKS + f"SELECT page_id, {duck.plausible('h')} AS ok FROM (SELECT *, {H} AS h FROM fx_links) t")
def d4(spark, sf):
    return table(spark, sf, "fx_links").select("page_id", urls.is_plausible_link(F.col("href")).alias("ok"))


@query("d5_resolve_link", LINKS + f"""
SELECT page_id, {duck.resolve('h', 'base')} AS link, {duck.absolute('h', 'base')} AS absolute FROM (SELECT *, {H} AS h FROM fx_links) t""")
def d5(spark, sf):
    return table(spark, sf, "fx_links").select(
        "page_id", urls.resolve_link(F.col("href"), F.col("base")).alias("link"), urls.absolute_url(F.col("href"), F.col("base")).alias("absolute"))


@query("d6_classify_kind", LINKS + f"SELECT page_id, {duck.kind('title', 'h')} AS kind FROM (SELECT *, {H} AS h FROM fx_links) t")
def d6(spark, sf):
    return table(spark, sf, "fx_links").select("page_id", urls.classify_kind(F.col("title"), F.col("href")).alias("kind"))


@query("d17_valid_article_url", LINKS + """
SELECT page_id, reason = '' AS ok, reason FROM (SELECT page_id, CASE WHEN h = '' THEN 'empty' WHEN NOT regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'malformed'
  WHEN regexp_matches(h, '^https?://[^/?#]') OR h LIKE 'file:%' THEN '' WHEN regexp_matches(h, '^https?:') THEN 'malformed'
  ELSE 'scheme:' || regexp_extract(h, '^([a-z]+):', 1) END AS reason
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN base WHEN page_id % 3 = 1 THEN trim(href) ELSE 'file:///x' END AS h FROM fx_links) t) u""")
def d17(spark, sf):
    n = F.col("page_id") % 3
    h = F.when(n == 0, F.col("base")).when(n == 1, F.col("href")).otherwise("file:///x")
    return table(spark, sf, "fx_links").select("page_id", urls.valid_article_url(h).alias("v")).select("page_id", "v.ok", "v.reason")


@query("a5_numeric_id", """
SELECT page_id, nullif(regexp_extract(regexp_extract(url, '[^/]*$'), '^[0-9]+'), '') AS id,
  regexp_matches(regexp_extract(rtrim(regexp_replace(url, '[?#].*$', ''), '/'), '[^/]*$'), '^[0-9]') AS is_detail FROM pages""")
def a5(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.numeric_id(F.col("url")).alias("id"), urls.is_detail_link(F.col("url")).alias("is_detail"))


@query("b6_parse_headers", duck_sql("fx_source_records") + """
SELECT rec_no, k, v FROM (
  SELECT rec_no, unnest(json_keys(header)) AS k, json_extract_string(header, '$."' || unnest(json_keys(header)) || '"') AS v
  FROM (SELECT rec_no, CASE WHEN header LIKE '{%' THEN header END AS header FROM fx_source_records) j WHERE header IS NOT NULL) a WHERE k <> 'Z'
UNION ALL
SELECT rec_no, trim(split_part(l, ':', 1)), trim(substr(l, strpos(l, ':') + 1)) FROM (
  SELECT rec_no, unnest(string_split(header, chr(10))) AS l FROM fx_source_records WHERE header NOT LIKE '{%') b WHERE l LIKE '%:%'""")
def b6(spark, sf):
    return table(spark, sf, "fx_source_records").select("rec_no", F.explode(rules.parse_headers(F.col("header"))).alias("k", "v"))


@query("b16_classify_rule", duck_sql("fx_source_records") + """
SELECT rec_no, f AS field, CASE WHEN r = '' THEN 'empty' WHEN regexp_matches(r, '^(@js:|<js>|<js )|java\\.|evalJS\\(|cache\\.') THEN 'script'
  WHEN contains(r, '{{') THEN 'template' WHEN contains(r, '##') THEN 'regex' WHEN regexp_matches(r, '^[$@]') THEN 'json'
  WHEN regexp_matches(r, '^(//|\\./)|text\\(\\)$|\\[@') THEN 'xpath' ELSE 'plain' END AS kind
FROM (SELECT rec_no, 'list' AS f, rule_articles AS r FROM fx_source_records UNION ALL SELECT rec_no, 'title', rule_title FROM fx_source_records
  UNION ALL SELECT rec_no, 'link', rule_link FROM fx_source_records) t""")
def b16(spark, sf):
    rows = table(spark, sf, "fx_source_records")
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("r")) for n, c in
                      [("list", "rule_articles"), ("title", "rule_title"), ("link", "rule_link")]])
    return rows.select("rec_no", F.explode(pairs).alias("p")).select("rec_no", "p.field", rules.classify_rule(F.col("p.r")).alias("kind"))
