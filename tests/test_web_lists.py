"""Lists and articles of HTML and JSON pages under rules that are rows."""

import json

from pageloom.operators.content import extract_content
from pageloom.operators.lists import all_containers, extract_containers, extract_list, json_containers, link_fallback, content_links, page_rules
from pageloom.operators.nodes import shred_pages

FEED = {"feed": {"posts": [{"h": "One", "id": 7, "img": "/1.png"}, {"h": "", "name": "Two", "id": 8}, {"h": "One again", "id": 7}]}, "pages": 3}
CARDS = "<section class=card><h4>A</h4><a href='/a'>open</a></section><section class=card><h4>B</h4><a href='b.html'>open</a></section>"
SOURCES = [
    # source_no, articles, title, link, image, date, content
    (1, "$.feed.posts", "$.h", "/p/{{$.id}}", "$.img", "", "{{$.feed.posts[0].h}}: <img src='i.png'>"),
    (2, "", "$.h", "$.id", "", "", "$..h"),
    (3, "section.card", "h4@text", "a@href", "", "", "section"),
    (4, "$.feed[", "$.h", "", "", "", ""),
    (5, "body", "", "", "", "", "@js:x"),
    (6, "$.feed.posts[?(@.id > 7)]", "$.name", "", "", "", "{{$.none}}"),
    (7, "", "", "", "", "", ""),
]
PAGES = [
    (1, "https://e.example/l/", json.dumps(FEED), 1), (2, "https://e.example/l/", json.dumps({"list": [{"h": "L", "id": 5}]}), 2), (3, "https://e.example/l/", CARDS, 3),
    (4, "https://e.example/l/", json.dumps(FEED), 4), (5, "https://e.example/l/", "<p>All of it</p>", 5), (6, "https://e.example/l/", json.dumps(FEED), 6),
    (7, "https://e.example/l/", CARDS, 1), (8, "https://e.example/l/", "", 7), (9, "https://e.example/l/", None, 2), (10, "https://e.example/l/", '{"a":[]}', 3),
]


def tables(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, source_no int")
    sources = spark.createDataFrame(
        SOURCES, "source_no int, rule_articles string, rule_title string, rule_link string, rule_image string, rule_pub_date string, rule_content string")
    return pages, shred_pages(pages), sources


def test_lists_of_all_kinds_in_one_plan(spark):
    pages, nodes, sources = tables(spark)
    rules = page_rules(pages, nodes, sources)
    kinds = {r.page_id: (r.kind, r.rule) for r in rules.collect()}
    assert kinds == {1: ("json", "$.feed.posts"), 2: ("json", "$.list"), 3: ("elements", "section.card"), 4: ("json", "$.feed["), 5: ("page", "body"),
                     6: ("json", "$.feed.posts[?(@.id > 7)]"), 7: ("none", "$.feed.posts"), 8: ("page", ""), 9: ("page", ""), 10: ("elements", "section.card")}
    boxes, values = extract_containers(pages, nodes, sources, rules), json_containers(pages, rules)
    items = extract_list(pages, nodes, sources, boxes, rules, values)
    got = {}
    for r in items.collect():
        got.setdefault(r.page_id, []).append((r.box_ord[-1], r.title, r.link, r.image))
    got = {k: [x[1:] for x in sorted(rows)] for k, rows in got.items()}
    assert got == {
        1: [("One", "https://e.example/p/7", "https://e.example/1.png"), ("Two", "https://e.example/p/8", "")],
        2: [("L", "https://e.example/5", "")],
        3: [("A", "https://e.example/a", ""), ("B", "https://e.example/l/b.html", "")],
        5: [("All of it", "", "")],
        6: [("Two", "", "")]}
    count = {r.page_id: r["count"] for r in all_containers(rules, boxes, values).groupBy("page_id").count().collect()}
    assert count == {1: 3, 2: 1, 3: 2, 5: 1, 6: 1, 8: 1, 9: 1}
    shown = link_fallback(pages, items, content_links(nodes, pages), sources).collect()
    assert {(r.page_id, r.title) for r in shown if r.page_id == 5} == {(5, "All of it")}  # a page that is its own list is listed


def test_articles_of_all_kinds(spark):
    pages, nodes, sources = tables(spark)
    got = {r.page_id: (r.origin, r.content_html, r.content_text) for r in extract_content(pages, nodes, sources).collect()}
    assert got[1] == ("rule", "One: <img src='https://e.example/l/i.png'>", "One:")
    assert got[2] == ("rule", "L", "L")
    assert got[3][0] == "rule" and got[3][1].startswith("<section class=card><h4>A</h4>")
    text = json.dumps(FEED, indent=2, sort_keys=True)
    assert got[4] == ("json", f"<pre>{text}</pre>", "\n".join(x.strip() for x in text.split("\n")))
    assert got[5][0] == "page" and got[6][0] == "json" and got[7][0] == "page"
    assert got[10] == ("json", '<pre>{\n  "a": []\n}</pre>', '{\n"a": []\n}')
    assert got[8][:2] == ("page", "") and got[9][0] == "page"


def test_many_sources_make_no_larger_plan(spark):
    pages, nodes, sources = tables(spark)
    rules = page_rules(pages, nodes, sources)
    size = len(json_containers(pages, rules)._jdf.queryExecution().optimizedPlan().toString())
    more = sources.unionByName(sources.selectExpr("source_no + 100 AS source_no", *[c for c in sources.columns if c != "source_no"]))
    rules = page_rules(pages, nodes, more)
    assert len(json_containers(pages, rules)._jdf.queryExecution().optimizedPlan().toString()) == size
