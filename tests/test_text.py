from pyspark.sql import functions as F

from pageloom.functions import text as t
from pageloom.functions import times
from pageloom.functions.hashing import highlight_id, source_id
from pageloom.operators.content import absolutize_urls, sentences_of


def test_clean_text_squeezes_every_kind_of_space(one):
    assert one(t.clean_text(F.lit("​ a 　\t b﻿ \n"))) == "a b"


def test_entities_are_decoded_in_order_so_ampersands_decode_twice(one):
    assert one(t.decode_entities(F.lit("&amp;lt;&nbsp;&#8217;&#x4E2D;&#xFEFF;&#xD800;&#99999999999;&#1a;&bogus;"))) == "< ’中﻿���&bogus;"


def test_html_to_text_keeps_lines_and_drops_blank_ones(one):
    assert one(t.html_to_text(F.lit("<div> a <b>b</b></div><p></p>\n<li>c&amp;d</li>e<br>f"))) == "a  b\nc&d\ne\nf"


def test_readable_text_drops_chrome_but_not_everything(one):
    page = "<nav>menu menu menu</nav><p>" + "words " * 10 + "</p><script>x</script>"
    assert one(t.readable_text(F.lit(page))) == ("words " * 10).strip()
    assert one(t.readable_text(F.lit("<nav>only a menu</nav>"))) == "only a menu"


def test_sanitize(one):
    html = '<p onclick="x()" class="a">t<a href=" javascript:go()">l</a><script>s()</script><img src=x onerror=y></p><iframe src="/f"/>'
    out = one(t.sanitize_html(F.lit(html)))
    for gone in ("onclick", "javascript", "script", "onerror", "iframe"):
        assert gone not in out
    assert 'class="a"' in out and "src=x" in out


def test_report_text(one):
    assert one(t.short_text(F.lit("abcdefghij"), 7)) == "abc…hij"
    assert one(t.short_text(F.lit(" abc "), 7)) == "abc"
    assert one(t.preview(F.lit("a\n b"), 90)) == "a b"
    assert one(t.size_label(F.lit(812)), t.size_label(F.lit(12595)), t.size_label(F.lit(4194304))) == ("812 B", "12.3 KB", "4.0 MB")
    assert one(t.size_label(F.lit(12544)), t.size_label(F.lit(12646))) == ("12.2 KB", "12.3 KB")


def test_coding(one):
    assert one(t.b64_decode(t.b64_encode(F.lit("é中" * 60)))) == "é中" * 60
    assert one(t.b64_decode(F.lit("***"))) == ""
    assert one(t.url_quote(F.lit("a b!~*'()é"))) == "a%20b!~*'()%C3%A9"
    assert one(t.url_unquote(F.lit("a%20b+c")), t.url_unquote(F.lit("%zz"))) == ("a b+c", "%zz")
    assert one(t.first_match(F.lit("x12y"), r"(\d)(\d)")) == "12\n1\n2"
    assert one(t.first_match(F.lit("x12y"), r"(?P<a_b>\d)")) == "1\n1"
    assert one(t.first_match(F.lit("x12y"), "a{")) == ""


def test_formatting_times(one):
    ms = F.lit(1700000000123)
    assert one(times.format_time(ms)) == "2023-11-14"
    assert one(times.format_time(ms, "yyyy/M/d h:mm a EEEE SSS")) == "2023/11/14 10:13 PM Tuesday 123"
    assert one(times.format_time(ms, "HH", "Asia/Shanghai")) == "06"
    assert one(times.format_time_utc(ms, "YYYY-MM-DD HH:mm", 5.5)) == "2023-11-15 03:43"
    assert one(times.format_time(F.lit("soon"))) == "" and one(times.format_time(ms, "")) == ""


def test_highlight_id_is_fnv1a(one):
    h = 0xCBF29CE484222325
    for b in "https://x/é".encode() + b"\0" + "passage 中".encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert one(highlight_id(F.lit("https://x/é"), F.lit("passage 中"))) == f"h{h:016x}"
    assert len(one(source_id(F.lit("n"), F.lit("u")))) == 16


def test_absolutize(one):
    html = "<img src='a.png'><a href=\"/b\">x</a><a href='#c'>y</a><video poster = \"//v/p\"></video>"
    out = one(absolutize_urls(F.lit(html), F.lit("https://s.example/d/e?f")))
    assert out == "<img src='https://s.example/d/a.png'><a href=\"https://s.example/b\">x</a><a href='#c'>y</a><video poster = \"//v/p\"></video>"


def test_sentences(one):
    assert one(sentences_of(F.lit("你好！！真的吗？是。 v1.2 is out. Yes"))) == ["你好！！", "真的吗？", "是。", " v1.2 is out.", " Yes"]
    run = "a" * 100 + "," + "b" * 60 + "。"
    assert one(sentences_of(F.lit(run))) == ["a" * 100 + ",", "b" * 60 + "。"]
    early = "a" * 10 + "," + "b" * 200
    assert one(sentences_of(F.lit(early))) == ["a" * 10 + "," + "b" * 129, "b" * 71]
    assert one(sentences_of(F.lit("  \n "))) == []


def test_sentences_lose_nothing_on_long_texts(spark):
    texts = ["x" * 50_000, "a.b" * 20_000, "word, " * 10_000, "!" * 5_000 + "é" * 5_000]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", sentences_of(F.col("t")).alias("s")).collect()
    for r in rows:
        assert "".join(r["s"]) == r["t"].rstrip() or "".join(r["s"]) == r["t"]
        assert max(map(len, r["s"])) <= 145 or r["t"].startswith("!")
