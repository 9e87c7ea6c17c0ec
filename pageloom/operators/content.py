"""Article bodies, titles, presentation, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.jsonpath import first_text, is_json_body, json_path, json_text
from pageloom.functions.pretty import indented
from pageloom.functions.rules import json_by_rule, looks_like_script, render_template, rule_plan
from pageloom.functions.text import clean_text, decode_entities, html_to_text, page_title_tag, readable_text
from pageloom.functions.urls import absolute_url
from pageloom.operators.nodes import page_texts
from pageloom.operators.rulesets import plan_steps, run_rules
from pageloom.operators.select import match_simple, node_text
from pageloom.session import materialize

# --- fixed values -----------------------------------------------------------
CONTENT_CANDIDATES = [
    "class.article-content", "class.content", "class.post-content", "class.entry-content", "class.theme-content",
    "id.content", "id.article", "article",
]
MIN_RULE_BYTES, MIN_CANDIDATE_BYTES = 40, 120
TITLE_KEYS = ["title", "name", "vod_name"]
MAX_HEADING_CHARS = 200
ADDRESS_ATTRIBUTE = r"""(?i)(src|poster|href)\s*=\s*["']([^"']+)["']"""
SENTENCE_ENDS = "。！？；…!?;"
COMMAS = "，,、"
MAX_SENTENCE_CHARS = 140
# ---------------------------------------------------------------------------


def absolutize_urls(html: Column, base: Column) -> Column:
    """relative ``src``, ``poster`` and ``href`` values made absolute."""
    pieces = F.split(html, "(?=" + ADDRESS_ATTRIBUTE + ")")
    head = "^" + ADDRESS_ATTRIBUTE

    def one(piece: Column) -> Column:
        value = F.trim(F.regexp_extract(piece, head, 2))
        written = F.regexp_extract(piece, head, 0)
        kept = (value == "") | value.rlike(r"^(data:|#|https?://|//)")
        quote = F.when(written.contains("'"), F.lit("'")).otherwise(F.lit('"'))
        fresh = F.concat(F.regexp_extract(piece, head, 1), F.lit("="), quote, absolute_url(value, base), quote)
        return F.when(kept, piece).otherwise(F.concat(fresh, F.substr(piece, F.length(written) + 1)))

    return F.when(base == "", html).otherwise(F.array_join(F.transform(pieces, one), ""))


def _content_nodes(pages: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """The one element per page that holds its article: the rule's, else a usual container."""
    rule = F.col("rule_id")
    src = sources.select("source_no", F.trim("rule_content").alias("rule_id"))
    src = src.filter((rule != "") & ~looks_like_script(rule) & ~rule.contains("{{") & ~rule.startswith("$"))
    ruled = pages.select("page_id", "source_no").join(src, "source_no")
    start = ruled.select("page_id", "rule_id", F.lit(0).alias("ctx"), F.lit(0).alias("node_id"),
                         F.array().cast("array<int>").alias("ord"))
    steps = plan_steps(src.select("rule_id", rule.alias("rule")).distinct())
    size = F.col("src_to") - F.col("src_from")
    at = nodes.select("page_id", "node_id", "src_from", "src_to")
    by_rule = run_rules(nodes, start, steps).join(at, ["page_id", "node_id"]).filter(size > MIN_RULE_BYTES)
    by_rule = by_rule.select("page_id", F.lit(0).alias("rank"), "ord", "node_id", "src_from", "src_to")
    ranks = F.array_compact(F.array(*[F.when(match_simple(c), F.lit(i + 1)) for i, c in enumerate(CONTENT_CANDIDATES)]))
    usual = nodes.filter(size > MIN_CANDIDATE_BYTES).select(
        "page_id", F.explode(ranks).alias("rank"), F.array("node_id").alias("ord"), "node_id", "src_from", "src_to")
    return by_rule.unionByName(usual).groupBy("page_id").agg(
        F.min_by(F.struct("rank", "node_id", "src_from", "src_to"), F.struct("rank", "ord")).alias("w")).select("page_id", "w.*")


def _with_json_rules(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages with ``json`` (their parsed body) and ``made``, what their source's template or path makes of it."""
    rule = F.trim("rule_content")
    mine = sources.filter(~looks_like_script(rule) & (rule.contains("{{") | rule.rlike(r"^[$@]")))
    plans = materialize(mine.select("source_no", rule_plan(rule).alias("_plan")), "content_rules")
    rows = pages.select("page_id", "source_no", "url", "html", F.try_parse_json(F.when(is_json_body(F.col("html")), F.col("html"))).alias("json"))
    rows = rows.join(plans, "source_no", "left").withColumn("made", F.when(F.col("json").isNotNull(), json_by_rule(F.col("json"), F.col("_plan"))))
    return rows.withColumn("made", F.when((F.trim("made") != "") & ~F.col("made").contains("{{"), F.col("made"))).drop("_plan")


def extract_content(pages: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """article markup and text per page, with where it came from.

    ``pages`` carries ``source_no``; relative addresses resolve against the page.
    A JSON body is put through its source's template or path, as rows for any number of sources; what
    that leaves goes by the element rule, then a usual container, then as indented JSON or the whole page.
    """
    chosen = _content_nodes(pages, nodes, sources)
    rows = _with_json_rules(pages, sources).join(chosen, "page_id", "left")
    made, ranked, is_json = F.col("made").isNotNull(), F.col("rank").isNotNull(), F.col("json").isNotNull()
    cut = F.substring(F.col("html").cast("binary"), F.col("src_from") + 1, F.col("src_to") - F.col("src_from")).cast("string")
    origin = F.when(made | (F.col("rank") == 0), "rule").when(ranked, "container").when(is_json, "json").otherwise("page")
    rows = rows.withColumn("markup", absolutize_urls(F.when(made, F.col("made")).when(ranked, cut), F.col("url"))).withColumn("origin", origin)
    rows = rows.withColumn("pretty", indented(F.when(F.col("origin") == "json", F.to_json("json"))))
    whole = F.when(F.col("pretty").isNotNull(), F.concat(F.lit("<pre>"), decode_entities(F.col("pretty")), F.lit("</pre>"))).otherwise(F.col("html"))
    text = F.when(F.col("markup").isNotNull(), html_to_text(F.col("markup"))).when(
        F.col("pretty").isNotNull(), html_to_text(F.col("pretty"))).otherwise(readable_text(F.col("html")))
    return rows.select("page_id", "source_no", "origin", F.coalesce("markup", whole).alias("content_html"), text.alias("content_text"))


def extract_json_content(bodies: DataFrame, rule: str, base: Column, text: str = "body") -> DataFrame:
    """F1 for JSON bodies of one source: the rule as template or path, else nothing."""
    v = F.try_parse_json(F.when(is_json_body(F.col(text)), F.col(text)))
    raw = render_template(v, rule) if "{{" in rule else first_text(json_path(v, rule))
    html = absolutize_urls(F.when(v.isNotNull(), raw), base)
    keep = [c for c in bodies.columns if c != text]
    rows = bodies.select(*keep, html.alias("content_html")).filter(F.trim("content_html") != "")
    return rows.withColumn("content_text", html_to_text(F.col("content_html")))


def page_title(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """JSON title keys, the title tag, then h1, h2 or ``.title`` when short."""
    v = F.try_parse_json(F.when(is_json_body(F.col("html")), F.col("html")))
    from_json = F.coalesce(*[
        F.when(F.trim(t) != "", clean_text(t)) for t in
        [json_text(F.try_variant_get(v, F.lit(f"$.{k}"), "variant")) for k in TITLE_KEYS]])
    rows = pages.select("page_id", F.coalesce(from_json, page_title_tag(F.col("html"))).alias("tagged"))
    rank = F.when(F.col("tag") == "h1", 0).when(F.col("tag") == "h2", 1).when(match_simple("class.title"), 2)
    heads = nodes.select("page_id", "node_id", "t_from", "t_to", rank.alias("rank")).filter(F.col("rank").isNotNull())
    # Only pages without a title tag need their headings' text.
    heads = heads.join(rows.filter(F.col("tagged").isNull()).select("page_id"), "page_id", "left_semi").join(page_texts(nodes), "page_id")
    heads = heads.withColumn("head", node_text(F.col("t_from"), F.col("t_to"), F.col("doc_text"))).filter(F.col("head") != "")
    first = heads.groupBy("page_id", "rank").agg(F.min_by("head", "node_id").alias("head"))
    first = first.filter(F.length("head") < MAX_HEADING_CHARS).groupBy("page_id").agg(F.min_by("head", "rank").alias("head"))
    return rows.join(first, "page_id", "left").select("page_id", F.coalesce("tagged", "head", F.lit("")).alias("title"))


def presentation_mode(articles: DataFrame) -> DataFrame:
    """how an article opens: music, video, gallery, rich or text.

    Needs ``n_audio, n_video, n_images, content_html, content_text``.
    """
    rich = F.col("content_html").rlike(r"(?i)<(video|img|p|h[1-6]|table|ul|ol|pre)\b")
    mode = (
        F.when(F.col("n_audio") > 0, "music")
        .when(F.col("n_video") > 0, "video")
        .when((F.col("n_images") >= 3) & (F.trim("content_text") == ""), "gallery")
        .when(rich, "rich").otherwise("text"))
    return articles.withColumn("mode", mode)


def sentences_of(text: Column, limit: int = MAX_SENTENCE_CHARS) -> Column:
    """the sentences of a text as an array.

    Runs of terminators stay together; a full stop ends a sentence before white
    space or the end. A run of ``limit`` characters without terminator is cut
    behind its last comma past the middle, else at the limit.
    """
    t = SENTENCE_ENDS
    whole = F.split(text, rf"(?<=[{t}])(?![{t}])|(?<=\.)(?=\s)")
    half = limit // 2 + 1
    # A full stop inside a run defers the cut by one character.
    cuts = "|".join(
        rf"(?=[^{t}]{{{limit - 1}}}\.{{{k}}}[^{t}.])(?:.{{{half},{limit - 1 + k}}}[{COMMAS}]|.{{{limit + k}}})" for k in range(4))
    pieces = F.transform(whole, lambda s: F.when(F.length(s) < limit, F.array(s)).otherwise(
        F.regexp_extract_all(s, F.lit(rf"(?s)({cuts}|.+)"), F.lit(1))))
    return F.filter(F.flatten(pieces), lambda s: F.regexp_replace(s, r"[\s\x{00A0}\x{3000}\x{FEFF}]+", "") != "")


def split_sentences(articles: DataFrame, key: str, text: str, limit: int = MAX_SENTENCE_CHARS) -> DataFrame:
    """F13 as rows: ``key, ix, sentence``."""
    return articles.select(key, F.posexplode(sentences_of(F.col(text), limit)).alias("ix", "sentence"))
