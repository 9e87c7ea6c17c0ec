import pytest
from pyspark.sql import functions as F

from pageloom.operators import lists, media
from pageloom.operators import select as sel
from pageloom.operators.content import extract_content, page_title
from pageloom.operators.nodes import page_rows, shred_pages
from pageloom.operators.rulesets import plan_steps, rule_values, run_rules

YARD = """<html><head><title>Sheds</title></head><body><section class="yard">
<figure class="entry"><img src="/pic/oak.webp" alt="oak"><figcaption><a href="/hut/oak" rel="o">Oak hut</a></figcaption></figure>
<figure class="entry low"><img src="/pic/pine.webp" alt="pine"><figcaption><a href="/hut/pine">Pine hut</a></figcaption></figure>
<figure class="entry"><img src="/pic/clay.webp" alt="clay"><figcaption><a href="/hut/clay">Clay &amp; straw</a></figcaption></figure>
<figure class="entry"><img src="/pic/tin.webp" alt="tin"><figcaption><a href="/hut/tin">Tin hut</a></figcaption></figure>
</section><article id="terms"><h3>Rules</h3><p>Wipe <i>boots</i></p></article>
<nav class="turn"><a href="javascript:go()">next</a><a href="/yard/2">next yard</a></nav></body></html>"""
TIMES = """<table><tr><td><a href="/row/7">Seven</a></td><td>fetch it</td></tr><tr><td><a href="/row/8">Eight</a></td><td>read on</td></tr></table>"""
NESTED = "<main id=w><i>→ open every chapter</i><div id=v>before<b>open</b></div></main>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://s.example/yard", YARD), (2, "https://s.example/b", TIMES), (3, "https://s.example/n", NESTED)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def nodes(pages):
    return shred_pages(pages).cache()


def values(nodes, rule, page, pages=None):
    rows = sel.select(nodes.filter(F.col("page_id") == page), rule, pages).collect()
    return [r["value"] for r in sorted(rows, key=lambda r: r["ord"])]


@pytest.mark.parametrize("page,rule,want", [
    (1, "class.entry@all", ["Oak hut", "Pine hut", "Clay & straw", "Tin hut"]),
    (1, "figcaption@a@href", ["/hut/oak", "/hut/pine", "/hut/clay", "/hut/tin"]),
    (1, "figure.entry.low@img@data-x", [""]),
    (1, "class.entry@all@img@alt", ["oak", "pine", "clay", "tin"]),
    (1, "class.yard@children@img@src", ["/pic/oak.webp", "/pic/pine.webp", "/pic/clay.webp", "/pic/tin.webp"]),
    (1, "class.yard@child.2@a@href", ["/hut/clay"]),
    (1, "class.yard@child.7@a@href", []),
    (1, "class.low@prev@a@href", ["/hut/oak"]),
    (1, "class.low@next@a@href", ["/hut/clay"]),
    (1, "class.turn@next@text", []),
    (1, "figure@next@text", ["Pine hut", "Clay & straw", "Tin hut"]),
    (1, "figcaption@parent@parent@class", ["yard"]),
    (1, "id.terms@text", ["RulesWipe boots"]),
    (1, "#terms@tag.p.0@text", ["Wipe boots"]),
    (1, "[rel]@href", ["/hut/oak"]),
    (1, "section.yard figcaption", ["Oak hut", "Pine hut", "Clay & straw", "Tin hut"]),
    (1, "//figure.entry/figcaption/a[\\@rel='o']/text()", ["Oak hut"]),
    (1, "//section.yard/figure[3]//img@src", ["/pic/clay.webp"]),
    (1, "class.none@text", []),
    (1, "9x..@y", []),
    (1, "class.turn@text.next yard@href", ["/yard/2"]),
    (2, "table@tr@a.0@href", ["/row/7", "/row/8"]),
    (2, "tr@all@text.fetch it", ["fetch it"]),
    (2, "table@tag.a.1@href", ["/row/8"]),
    (3, "id.w@text.open", ["open"]),
    (3, "id.w@text.ope", ["→ open every chapter", "open"]),
    (3, "@text", ["→ open every chapterbeforeopen"]),
    (3, "[id]@id", ["w", "v"]),
])
def test_rules(nodes, page, rule, want):
    assert values(nodes, rule, page) == want


def test_both_ways_of_running_rules_agree(spark, nodes, pages):
    rules = ["class.entry@a@href", "//figure[2]//img@src", "table@tr@a.0@href", "tr@all@text.fetch it", "id.w@text.ope", "class.yard@child.1@a@href",
             "class.low@prev@a@href", "figcaption@parent@parent@class", "@text", "section.yard figcaption", "id.terms@ownText", "p@html", "i@outerHtml"]
    start = nodes.filter("node_id = 0").select("page_id", F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule_id"), F.lit(0).alias("ctx"),
                                               "node_id", F.array().cast("array<int>").alias("ord"))
    steps = plan_steps(spark.createDataFrame([(r, r) for r in rules], "rule_id string, rule string"))
    got = {}
    for r in rule_values(run_rules(nodes, start, steps), nodes, pages).collect():
        got.setdefault((r["page_id"], r["rule_id"]), []).append((r["ord"], r["value"]))
    for rule in rules:
        for page in (1, 2, 3):
            assert [x for _, x in sorted(got.get((page, rule), []))] == values(nodes, rule, page, pages), (rule, page)


def test_markup_is_the_source(nodes, pages):
    assert values(nodes, "id.terms@p.0@outerHtml", 1, pages) == ["<p>Wipe <i>boots</i></p>"]
    assert values(nodes, "id.terms@html", 1, pages) == ["<h3>Rules</h3><p>Wipe <i>boots</i></p>"]
    assert values(nodes, "id.terms@ownText", 1, pages) == ["Rules  Wipe  boots"]


def test_a_match_keeps_itself_and_is_not_descended_into(nodes):
    assert sorted(r["node_id"] for r in sel.select_within(sel.select_nodes(nodes, "#v"), nodes, "div").collect()) == [
        r["node_id"] for r in nodes.filter(F.col("attrs")["id"] == "v").collect()]


def test_node_table_is_a_tree():
    html = "<p>a<p>b<ul><li>1<li>2</ul><table><tr><td>x<td>y<tr><td>z</table>é<br><img src=x>t<!-- c --></b></i><script>var a='</p>'</script>"
    rows = list(page_rows(1, html))
    ids = {r[1]: r for r in rows}
    assert [r[1] for r in rows] == list(range(len(rows)))
    for r in rows:
        anc, up = [], r[2]
        while up is not None:
            anc.insert(0, up)
            up = ids[up][2]
        assert r[4] == len(anc) and (not anc or anc[-1] == r[2])
        assert all(a < r[1] <= ids[a][3] for a in anc)
        assert r[9] <= r[11] <= r[12] <= r[10] and r[13] <= r[14]
        for a in anc:
            assert ids[a][9] <= r[9] and r[10] <= ids[a][10] and ids[a][13] <= r[13] and r[14] <= ids[a][14]
    tags = [r[7] for r in rows]
    assert tags.count("p") == 2 and tags.count("li") == 2 and tags.count("td") == 3 and tags.count("tr") == 2
    raw = html.encode()
    assert [raw[r[9]:r[10]].decode() for r in rows if r[7] == "li"] == ["<li>1", "<li>2"]
    whole = rows[0][15].decode()
    assert whole == "ab12xyzét" + "var a='</p>'"


def test_odd_pages_do_not_stop_the_job():
    for html in ("", None, "<", "<p", "&", "<a href='x", "</div>" * 50, "<div>" * 300, "<![CDATA[x]]>", "\ud800<p>x", "<p\n\nid=1>é"):
        rows = list(page_rows(1, html))
        assert rows[0][7] == "html" and rows[0][3] == len(rows) - 1


SOURCES = [
    (0, "class.entry@all", "figcaption@text", "a@href", "img@src", "", "id.terms", False),
    (1, "tr@all", "a@text", "td@onclick", "", "", "", True),
    (2, "class.gone", "a@text", "a@href", "", "", "", False),
]


@pytest.fixture(scope="module")
def shop(spark):
    sources = spark.createDataFrame(SOURCES, "source_no int, rule_articles string, rule_title string, rule_link string, rule_image string, "
                                             "rule_pub_date string, rule_content string, enable_js boolean")
    rows = [(1, "https://s.example/yard", YARD, 0), (2, "https://s.example/b", TIMES, 1), (3, "https://s.example/x", YARD, 2), (4, "https://s.example/q", "<p>quiet</p>", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, source_no int")
    nodes = shred_pages(pages).cache()
    boxes = lists.extract_containers(pages, nodes, sources).cache()
    return pages, nodes, sources, boxes, lists.extract_list(pages, nodes, sources, boxes).cache()


def test_list_items(shop):
    got = [(r["title"], r["link"], r["image"], r["kind"]) for r in shop[4].filter("page_id = 1").orderBy("box_ord").collect()]
    names = {"oak": "Oak hut", "pine": "Pine hut", "clay": "Clay & straw", "tin": "Tin hut"}
    assert got == [(name, f"https://s.example/hut/{k}", f"https://s.example/pic/{k}.webp", "article") for k, name in names.items()]
    assert [r["link"] for r in shop[4].filter("page_id = 2").collect()] == ["", ""]


def test_broken_rules_are_named_and_quiet_pages_are_not(shop):
    pages, nodes, sources, boxes, items = shop
    shape = lists.list_shape(pages, sources, boxes, items, lists.content_links(nodes, pages))
    got = {r["page_id"]: r["diagnosis"] for r in lists.diagnose_list(shape).collect()}
    assert got == {1: None, 2: "nothing_openable", 3: "rule_matched_nothing", 4: None}


def test_links_stand_in_for_a_dead_rule(shop):
    pages, nodes, sources, _, items = shop
    shown = lists.link_fallback(pages, items, lists.content_links(nodes, pages), sources)
    per_page = {(r["page_id"], r["fallback"]): r["count"] for r in shown.groupBy("page_id", "fallback").count().collect()}
    assert per_page == {(1, False): 4, (2, False): 2, (3, True): 5}


def test_render_list_and_next_page(shop):
    pages, nodes, sources, _, items = shop
    assert [r["page_id"] for r in lists.needs_render(pages, items, sources).collect()] == [2]
    assert {r["page_id"]: r["next_url"] for r in lists.next_page(pages, nodes).collect()} == {
        1: "https://s.example/yard/2", 3: "https://s.example/yard/2"}


def test_list_rule_is_inferred(shop):
    assert {r["page_id"]: r["rule"] for r in lists.infer_list_rule(shop[1]).collect()} == {1: "class.entry@all", 3: "class.entry@all"}


def test_content_falls_back_step_by_step(spark, shop):
    pages, nodes, sources, _, _ = shop
    got = {r["page_id"]: (r["origin"], r["content_text"]) for r in extract_content(pages, nodes, sources).collect()}
    assert got[1] == ("rule", "Rules  Wipe  boots") and got[4] == ("page", "quiet")
    assert {r["page_id"]: r["title"] for r in page_title(pages, nodes).collect()} == {1: "Sheds", 2: "", 3: "Sheds", 4: ""}


MUSIC = "<h1>m</h1><ul>" + "".join(
    f'<li><a href="/m?t={i}">Song {i}</a><audio src="/d/track-{i}.wav"></audio>' + (f'<a href="/d/Track-{i}.lrc">lyrics</a>' if i < 2 else "") + "</li>"
    for i in range(3)) + "</ul>"
VIDEO = '<video src="https://v.example/m.m3u8"><track kind="subtitles" src="s.vtt" srclang="zh" label="L" default><track src="s.vtt"><track kind="chapters" src="c.vtt"></video>'


def test_media(spark):
    pages = spark.createDataFrame([(1, "https://s.example/m.html", MUSIC), (2, "https://s.example/v/x", VIDEO)], "page_id long, url string, html string")
    nodes = shred_pages(pages)
    paired = media.pair_lyrics(media.audio_catalog(nodes, pages), media.lyric_links(nodes, pages)).orderBy("audio_url").collect()
    assert [(r["audio_url"][-11:], r["lyric_url"] and r["lyric_url"][-11:]) for r in paired] == [
        ("track-0.wav", "Track-0.lrc"), ("track-1.wav", "Track-1.lrc"), ("track-2.wav", None)]
    subs = media.subtitle_catalog(nodes, pages).collect()
    assert [(r["subtitle_url"], r["label"], r["lang"], r["is_default"]) for r in subs] == [("https://s.example/v/s.vtt", "L", "zh", True)]
    assert [r["media_url"] for r in media.media_catalog(nodes).collect()] == ["https://v.example/m.m3u8"]
