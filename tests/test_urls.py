import pytest
from pyspark.sql import functions as F

from pageloom.functions import urls as u

BASE = "https://Site.Example:443/a/b/c?x=1#f"


@pytest.mark.parametrize("href,want", [
    ("", ""), ("d", "https://site.example/a/b/d"), ("../d", "https://site.example/a/d"), ("../../../d", "https://site.example/d"),
    ("./", "https://site.example/a/b/"), ("..", "https://site.example/a/"), ("/d/./e/../f?q#g", "https://site.example/d/f?q#g"),
    ("?q=1", "https://site.example/a/b/c?q=1"), ("#top", "https://site.example/a/b/c?x=1#top"), ("//cdn/x", "https://cdn/x"),
    ("http://o/P", "http://o/P"), ("mailto:a@b", "mailto:a@b"), ("/ü x", "https://site.example/%C3%BC%20x"),
])
def test_absolute_url(one, href, want):
    assert one(u.absolute_url(F.lit(href), F.lit(BASE))) == want


def test_unusable_base_leaves_the_reference(one):
    assert one(u.absolute_url(F.lit("x/y"), F.lit("not a base"))) == "x/y"
    assert one(u.absolute_url(F.lit("//h/p"), F.lit(""))) == "https://h/p"


@pytest.mark.parametrize("value,ok", [
    ("660000", True), ("#12", True), ("importApp(1)", False), ("javascript:x.y", False), ("DATA:x.y", False), ("a b.c", False), ("<a.b", False),
    ("plain", False), ("file.m3u8", True), ("./x", True), ("/x", True), ("", False), ("a." + "x" * 2000, False),
])
def test_plausible_links(one, value, ok):
    assert one(u.is_plausible_link(F.lit(value))) is ok


def test_bare_numbers_hang_off_the_host(one):
    assert one(u.resolve_link(F.lit("660000"), F.lit("https://h.example/cache.php?m=1"))) == "https://h.example/660000"
    assert one(u.resolve_link(F.lit("#7"), F.lit("https://h.example:8080/x"))) == "https://h.example:8080/7"
    assert one(u.resolve_link(F.lit("go()"), F.lit("https://h.example"))) == ""


@pytest.mark.parametrize("title,link,kind", [
    ("t", "https://music.example/a.mp4", "video"), ("t", "https://x/a.m4a?b", "music"), ("动漫 music", "", "music"), ("Photo", "/x", "image"),
    ("小说", "/x.html", "novel"), ("plain", "https://video.example/x", "article"),
])
def test_kinds_ignore_the_host(one, title, link, kind):
    assert one(u.classify_kind(F.lit(title), F.lit(link))) == kind


def test_page_slots(one):
    assert one(u.expand_page(F.lit("/l/{{page}}/{{ bookPage }}/{{page<0>}}/{{page<3>}}/{{x}}"), F.lit(2))) == "/l/2/2/1/4/{{x}}"


def test_ids_and_detail_links(one):
    assert one(u.numeric_id(F.lit("/c/id/203.html")), u.numeric_id(F.lit("/c/x"))) == ("203", None)
    links = ["/c/203.html", "/c/42/", "/203.json", "/x", "#1", "/1 2", "mailto:1", "/9.png?x"]
    assert one(*[u.is_detail_link(F.lit(x)) for x in links]) == (True, True, False, False, False, False, False, False)


def test_article_addresses(one):
    got = one(*[u.valid_article_url(F.lit(x))["reason"] for x in ["", "http://h", "file:///x", "ftp://h", "no scheme", "https://"]])
    assert got == ("empty", "", "", "scheme:ftp", "malformed", "malformed")
