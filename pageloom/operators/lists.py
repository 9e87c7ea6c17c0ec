"""Pages and rules to list items, next pages and diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.jsonpath import is_json_body, json_items, json_list_rule, json_select, json_text, json_values, path_plan
from pageloom.functions.rules import json_field, json_fields_by, looks_like_script, rule_plan
from pageloom.functions.text import clean_text, html_to_text, meta_refresh
from pageloom.functions.urls import absolute_url, classify_kind, expand_page, origin_of, resolve_link
from pageloom.operators.common import first_per_key
from pageloom.operators.nodes import page_texts
from pageloom.operators.rulesets import plan_steps, rule_values, run_rules
from pageloom.session import materialize
from pageloom.operators.select import is_simple, links_by_text, match_simple, match_selector, node_text

# --- fixed values -----------------------------------------------------------
FALLBACK_MIN_LINKS = 3
MAX_LINKS = 200
MIN_TITLE_CHARS, MAX_TITLE_CHARS = 2, 120
LIST_CANDIDATES = [
    "class.video-card", "class.book-item", "class.post-item", "class.item", "class.list-item", "class.entry",
    "class.article", "class.res", "ul li", "article",
]
NEXT_LABELS = ["下一页", "下页", "next", "»", ">", "末页"]
NEXT_KEYS = ["page", "pageurl", "page_url", "next"]
FIELDS = ["title", "link", "image", "date"]
RULE_NAMES = ["ruleTitle", "ruleLink", "ruleImage", "rulePubDate"]
RULE_COLUMNS = ["rule_title", "rule_link", "rule_image", "rule_pub_date"]
# ---------------------------------------------------------------------------


def is_single_page(rule_articles: Column, rule_link: Column) -> Column:
    return (F.lower(F.trim(rule_articles)) == "body") & (F.trim(rule_link) == "")


def doc_text_of(nodes: DataFrame) -> DataFrame:
    return page_texts(nodes).select("page_id", clean_text(F.col("doc_text").cast("string")).alias("page_text"))


def field_value(values: DataFrame, keys: list[str], defaults: Column | None = None) -> DataFrame:
    """D3: the first non-blank value per key in result order; a default fills the rest."""
    kept = values.withColumn("value", F.trim(F.col("value"))).filter(F.col("value") != "")
    out = kept.groupBy(*keys).agg(F.min_by("value", "ord").alias("value"))
    return out if defaults is None else out.withColumn("value", F.coalesce(F.col("value"), defaults))


def single_page_items(pages: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources whose list is the page itself give one item with the page's text."""
    rule = F.trim(F.col("rule_articles"))
    mine = sources.filter(rule.isin("", "body", "$")).select("source_no", "rule_title")
    rows = pages.join(mine, "source_no").join(doc_text_of(nodes), "page_id")
    return rows.select(
        "page_id", "source_no", F.col("page_text").alias("title"), F.lit("").alias("link"), F.lit("").alias("image"),
        F.lit("").alias("date"), classify_kind(F.col("page_text"), F.lit("")).alias("kind"))


def content_links(nodes: DataFrame, pages: DataFrame, limit: int = MAX_LINKS) -> DataFrame:
    """The links of a page that lead to content, in page order."""
    href = F.col("attrs")["href"]
    anchors = nodes.filter((F.col("tag") == "a") & href.isNotNull())
    anchors = anchors.select("page_id", "node_id", F.trim(href).alias("href"), "t_from", "t_to")
    anchors = anchors.filter((F.col("href") != "") & ~F.col("href").rlike(r"^(#|javascript:|mailto:|tel:)"))
    a = anchors.join(page_texts(nodes), "page_id").withColumn("title", node_text(F.col("t_from"), F.col("t_to"), F.col("doc_text")))
    a = a.filter(F.length("title").between(MIN_TITLE_CHARS, MAX_TITLE_CHARS)).drop("doc_text")
    a = a.join(pages.select("page_id", "url"), "page_id")
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    a = a.filter(bare(F.col("href")) != bare(F.col("url"))).withColumn("link", absolute_url(F.col("href"), F.col("url")))
    a = a.filter(F.col("link").rlike("^https?://"))
    once = a.groupBy("page_id", "link").agg(F.min_by("title", "node_id").alias("title"), F.min("node_id").alias("node_id"))
    ranked = once.withColumn("ix", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")))
    kept = ranked.filter(F.col("ix") <= limit)
    return kept.select("page_id", "ix", "title", "link", classify_kind(F.col("title"), F.col("link")).alias("kind"))


def infer_list_rule(nodes: DataFrame, candidates: list[str] = LIST_CANDIDATES, least: int = FALLBACK_MIN_LINKS) -> DataFrame:
    """Per page the first candidate selector with at least ``least`` matches."""
    simple = [(i, c) for i, c in enumerate(candidates) if is_simple(c)]
    ranks = F.array_compact(F.array(*[F.when(match_simple(c), F.lit(i)) for i, c in simple]))
    hits = nodes.select("page_id", F.explode(ranks).alias("rank"))
    for i, c in enumerate(candidates):
        if not is_simple(c):
            hits = hits.unionByName(match_selector(nodes, c).select("page_id", F.lit(i).alias("rank")))
    enough = hits.groupBy("page_id", "rank").count().filter(F.col("count") >= least)
    names = F.array(*[F.lit(c + "@all") for c in candidates])
    return enough.groupBy("page_id").agg(F.min_by(F.struct("rank", "count"), "rank").alias("w")).select(
        "page_id", F.get(names, F.col("w.rank")).alias("rule"), F.col("w.count").alias("matches"))


def _has_list_rules() -> Column:
    return (F.trim("rule_articles") != "") | (F.trim("rule_title") != "") | (F.trim("rule_link") != "")


def _json_value() -> Column:
    return F.try_parse_json(F.when(is_json_body(F.col("html")), F.col("html")))


def page_rules(pages: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """What each page's list is taken by: ``page_id, source_no, rule, kind``.

    ``kind`` is ``json`` for a path on a JSON body, ``page`` where the page itself
    is the one container, ``script``, ``none`` for a path on another body, and
    ``elements``. A page whose source has no rule gets an inferred one: where its
    JSON keeps a list, or the first usual selector with enough matches; with neither it is its own list.
    Only pages without a rule are looked at for that.
    """
    src = sources.select("source_no", F.trim("rule_articles").alias("rule"))
    rows = pages.select("page_id", "source_no", "html").join(src, "source_no")
    given = rows.filter("rule <> ''").select("page_id", "source_no", "rule", is_json_body(F.col("html")).alias("json"))
    open_ones = rows.filter("rule = ''").select("page_id", "source_no", "html", is_json_body(F.col("html")).alias("json"))
    by_json = open_ones.filter("json").select("page_id", "source_no", json_list_rule(_json_value(), F.col("html")).alias("rule"), "json")
    other = open_ones.filter(~F.col("json")).select("page_id", "source_no", "json")
    guesses = infer_list_rule(nodes.join(other.select("page_id").distinct(), "page_id", "left_semi")).select("page_id", "rule")
    by_nodes = other.join(guesses, "page_id", "left").select("page_id", "source_no", F.coalesce("rule", F.lit("")).alias("rule"), "json")
    rule = F.col("rule")
    kind = (
        F.when(rule.isin("", "body", "$"), "page").when(looks_like_script(rule), "script")
        .when(F.col("json") & rule.rlike(r"^[$@]"), "json").when(rule.startswith("$"), "none").otherwise("elements"))
    every = given.unionByName(by_json).unionByName(by_nodes)
    return materialize(every.select("page_id", "source_no", "rule", kind.alias("kind")), "page_rules")


def extract_containers(pages: DataFrame, nodes: DataFrame, sources: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """The elements that hold the list items of every page: ``page_id, source_no, node_id, ord``."""
    rules = page_rules(pages, nodes, sources) if rules is None else rules
    rows = rules.filter("kind = 'elements'")
    steps = plan_steps(rows.select(F.col("rule").alias("rule_id"), "rule").distinct())
    start = rows.select("page_id", F.col("rule").alias("rule_id"), F.col("source_no").alias("ctx"), F.lit(0).alias("node_id"),
                        F.array().cast("array<int>").alias("ord"))
    hits = run_rules(nodes, start, steps)
    return hits.select("page_id", F.col("ctx").alias("source_no"), "node_id", "ord")


def json_containers(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The JSON values that hold the list items: ``page_id, source_no, ix, v``; an array found stands for its elements."""
    mine = rules.filter("kind = 'json'").select("page_id", "source_no", "rule")
    # A path is taken apart once, not for each page it is used on.
    plans = materialize(mine.select("rule").distinct().select("rule", path_plan(F.col("rule")).alias("steps")), "paths")
    rows = pages.select("page_id", _json_value().alias("v")).join(mine.join(plans, "rule"), "page_id")
    found = F.transform(json_select(F.col("v"), F.col("steps")), lambda x: F.coalesce(json_items(x), F.array(x)))
    return rows.select("page_id", "source_no", F.posexplode(F.flatten(found)).alias("ix", "v"))


def all_containers(rules: DataFrame, elements: DataFrame, values: DataFrame) -> DataFrame:
    """One row for each container of any kind: ``page_id, source_no``; a page that is its own list is one."""
    keys = ["page_id", "source_no"]
    return elements.select(keys).unionByName(values.select(keys)).unionByName(rules.filter("kind = 'page'").select(keys))


def _element_fields(pages: DataFrame, nodes: DataFrame, sources: DataFrame, containers: DataFrame) -> DataFrame:
    """``page_id, source_no, box_ord`` and the fields of each element, unresolved."""
    fields = F.array(*[
        F.struct(F.lit(name).alias("field"), F.trim(F.col(rule)).alias("rule")) for name, rule in zip(FIELDS, RULE_COLUMNS)])
    wanted = sources.select("source_no", F.explode(fields).alias("f")).select("source_no", "f.field", "f.rule")
    wanted = wanted.filter((F.col("rule") != "") & ~looks_like_script(F.col("rule")))
    steps = plan_steps(wanted.select(F.col("rule").alias("rule_id"), "rule").distinct())
    boxes = containers.select("page_id", "source_no", F.col("node_id").alias("ctx"), F.col("ord").alias("box_ord"))
    start = boxes.join(wanted, "source_no").select(
        "page_id", F.col("rule").alias("rule_id"), "ctx", F.col("ctx").alias("node_id"),
        F.array().cast("array<int>").alias("ord")).distinct()
    values = field_value(rule_values(run_rules(nodes, start, steps, in_container=True), nodes, pages), ["page_id", "rule_id", "ctx"])
    found = boxes.join(wanted, "source_no").join(values.withColumnRenamed("rule_id", "rule"), ["page_id", "rule", "ctx"], "left")
    wide = found.groupBy("page_id", "source_no", "ctx").agg(*[
        F.max(F.when(F.col("field") == name, F.col("value"))).alias(name) for name in FIELDS])
    at = nodes.select("page_id", F.col("node_id").alias("ctx"), "t_from", "t_to")
    titled = sources.select("source_no", (F.trim("rule_title") == "").alias("_text_title"))
    rows = boxes.join(wide, ["page_id", "source_no", "ctx"], "left").join(titled, "source_no")
    rows = rows.join(at, ["page_id", "ctx"]).join(page_texts(nodes), "page_id")
    box_text = F.when(F.col("_text_title"), node_text(F.col("t_from"), F.col("t_to"), F.col("doc_text")))
    return rows.select("page_id", "source_no", "box_ord", F.coalesce(box_text, F.col("title"), F.lit("")).alias("title"),
                       *[F.coalesce(c, F.lit("")).alias(c) for c in ("link", "image", "date")])


def _json_fields(values: DataFrame, sources: DataFrame) -> DataFrame:
    """The same for JSON containers; rules of any number of sources are rows, taken apart once."""
    rules = F.array(*[F.when(looks_like_script(F.col(c)), "").otherwise(F.col(c)) for c in RULE_COLUMNS])
    plans = materialize(sources.select("source_no", F.transform(rules, rule_plan).alias("plans")), "json_rules")
    rows = values.join(plans, "source_no")
    rows = rows.select("page_id", "source_no", F.array("ix").alias("box_ord"), json_fields_by(F.col("v"), F.col("plans"), RULE_NAMES).alias("f"))
    return rows.select("page_id", "source_no", "box_ord", *[F.get("f", F.lit(i)).alias(name) for i, name in enumerate(FIELDS)])


def _page_fields(nodes: DataFrame, sources: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for pages that are their own list: a fragment of plain text, in which rules for elements find nothing."""
    mine = sources.filter((F.trim("rule_title") == "") | F.trim("rule_title").rlike(r"^@(text|Text|textNodes|TextNodes|ownText|OwnText)$"))
    rows = rules.filter("kind = 'page'").join(mine.select("source_no"), "source_no", "left_semi").join(doc_text_of(nodes), "page_id")
    return rows.select("page_id", "source_no", F.array(F.lit(0)).alias("box_ord"), F.col("page_text").alias("title"),
                       *[F.lit("").alias(c) for c in ("link", "image", "date")])


def _items(fields: DataFrame, urls: DataFrame) -> DataFrame:
    """Items from fields: cleaned, resolved against their page, without rows that have neither title, link nor image."""
    rows = fields.withColumn("title", clean_text(F.col("title")))
    rows = rows.filter((F.col("title") != "") | (F.col("link") != "") | (F.col("image") != "")).join(urls, "page_id")
    rows = rows.withColumn("link", resolve_link(F.col("link"), F.col("url")))
    return rows.select(
        "page_id", "source_no", "box_ord", F.when(F.col("title") == "", clean_text(F.col("link"))).otherwise(F.col("title")).alias("title"),
        "link", absolute_url(F.col("image"), F.col("url")).alias("image"), clean_text(F.col("date")).alias("date"),
        classify_kind(F.col("title"), F.col("link")).alias("kind"))


def extract_list(pages: DataFrame, nodes: DataFrame, sources: DataFrame, containers: DataFrame | None = None,
                 rules: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """List items of every page by its source's rules, before any fallback.

    ``pages`` carries ``page_id, url, html, source_no``. Elements, JSON values and whole
    pages (D2) run in one plan, for any number of sources; rows without title, link and image are dropped, a
    missing title falls back to the container's text, then to the link. Sources without any rule are
    extracted by the inferred one; whether their items are shown is for :func:`link_fallback`.
    """
    rules = page_rules(pages, nodes, sources) if rules is None else rules
    containers = extract_containers(pages, nodes, sources, rules) if containers is None else containers
    values = json_containers(pages, rules) if values is None else values
    fields = _element_fields(pages, nodes, sources, containers).unionByName(_json_fields(values, sources)).unionByName(
        _page_fields(nodes, sources, rules))
    return dedup_items(_items(fields, pages.select("page_id", "url")), ["page_id", "source_no"], "box_ord")


def extract_json_list(bodies: DataFrame, list_rule: str, rules: dict[str, str], base: Column, text: str = "body") -> DataFrame:
    """D1 for JSON bodies of one source: elements of the list rule, fields by path,
    template, clean-up operator or the usual key names."""
    found = json_values(F.try_parse_json(F.col(text)), list_rule)
    items = F.flatten(F.transform(found, lambda x: F.coalesce(json_items(x), F.array(x))))
    keep = [c for c in bodies.columns if c != text]
    rows = bodies.select(*keep, base.alias("_base"), F.posexplode(items).alias("ix", "v"))
    v = F.col("v")
    raw = {name: json_field(v, rules.get(rule, ""), rule) for name, rule in zip(FIELDS, RULE_NAMES)}
    rows = rows.select(*keep, "ix", "_base", *[c.alias(n) for n, c in raw.items()])
    rows = rows.withColumn("title", clean_text(F.col("title"))).filter(
        (F.col("title") != "") | (F.col("link") != "") | (F.col("image") != ""))
    rows = rows.withColumn("link", resolve_link(F.col("link"), F.col("_base")))
    return rows.select(
        *keep, "ix", F.when(F.col("title") == "", clean_text(F.col("link"))).otherwise(F.col("title")).alias("title"), "link",
        absolute_url(F.col("image"), F.col("_base")).alias("image"), clean_text(F.col("date")).alias("date"),
        classify_kind(F.col("title"), F.col("link")).alias("kind"))


def dedup_items(items: DataFrame, by: list[str], order: str = "ix") -> DataFrame:
    """The first item per link within ``by``; items without a link all stay."""
    linked = first_per_key(items.filter(F.col("link") != ""), [*by, "link"], [F.col(order)])
    return linked.select(items.columns).unionByName(items.filter(F.col("link") == ""))


def link_fallback(pages: DataFrame, items: DataFrame, links: DataFrame, sources: DataFrame, minimum: int = FALLBACK_MIN_LINKS) -> DataFrame:
    """The listing shown for each page: rule items, or the page's links.

    Links replace a listing with nothing to open when there are at least
    ``minimum`` of them, and stand in for sources that have no rules at all (any
    number) or only the whole-page rule. JSON bodies and scripts keep what they got.
    """
    src = sources.select(
        "source_no", (~_has_list_rules()).alias("bare"), looks_like_script(F.col("rule_articles")).alias("script"),
        ((F.lower(F.trim("rule_articles")) == "body") & (F.trim("rule_title") == "") & (F.trim("rule_link") == "")).alias("body_only"))
    n_links = links.groupBy("page_id").agg(F.count("*").alias("n_links"))
    n_open = items.groupBy("page_id").agg(F.count_if(F.col("link") != "").alias("n_open"))
    per_page = (
        pages.select("page_id", "source_no", is_json_body(F.col("html")).alias("json")).join(src, "source_no")
        .join(n_links, "page_id", "left").join(n_open, "page_id", "left").na.fill(0, ["n_links", "n_open"]))
    shown = (
        F.when(F.col("json"), False)
        .when(F.col("bare"), F.col("n_links") > 0)
        .when(F.col("body_only") & (F.col("n_links") >= minimum), True)
        .otherwise((F.col("n_open") == 0) & ~F.col("script") & (F.col("n_links") >= minimum)))
    choice = per_page.select("page_id", "source_no", shown.alias("by_links"))
    from_links = choice.filter("by_links").join(links, "page_id").select(
        "page_id", "source_no", "ix", "title", "link", F.lit("").alias("image"), F.lit("").alias("date"), "kind", F.lit(True).alias("fallback"))
    own = items.join(choice.filter(~F.col("by_links")).select("page_id"), "page_id", "left_semi")
    own = own.select("page_id", "source_no", F.element_at("box_ord", -1).alias("ix") if "box_ord" in items.columns else "ix",
                     "title", "link", "image", "date", "kind", F.lit(False).alias("fallback"))
    return from_links.unionByName(own)


def list_shape(pages: DataFrame, sources: DataFrame, containers: DataFrame, items: DataFrame, links: DataFrame,
               minimum: int = FALLBACK_MIN_LINKS) -> DataFrame:
    """Per page whether it has a list rule, and how many containers, openable
    items and fallback links the rules came to."""
    boxes = containers.groupBy("page_id").agg(F.count("*").alias("containers"))
    opened = items.groupBy("page_id").agg(F.count_if(F.col("link") != "").alias("openable"))
    n_links = links.groupBy("page_id").agg(F.count("*").alias("n_links"))
    rule = F.lower(F.trim("rule_articles"))
    by_design = ~_has_list_rules() | ((rule == "body") & (F.trim("rule_title") == "") & (F.trim("rule_link") == ""))
    src = sources.select("source_no", (F.trim("rule_articles") != "").alias("has_rule"), by_design.alias("by_design"),
                         looks_like_script(F.col("rule_articles")).alias("script"))
    rows = (
        pages.select("page_id", "source_no").join(src, "source_no").join(boxes, "page_id", "left")
        .join(opened, "page_id", "left").join(n_links, "page_id", "left").na.fill(0, ["containers", "openable", "n_links"]))
    links_shown = F.col("by_design") & (F.col("n_links") >= F.when(F.col("has_rule"), minimum).otherwise(1))
    replaced = (F.col("openable") == 0) & ~F.col("script") & (F.col("n_links") >= minimum)
    return rows.select(
        "page_id", "source_no", (F.col("has_rule") & ~links_shown).alias("has_rule"),
        F.when(links_shown, 0).otherwise(F.col("containers")).alias("containers"),
        F.when(links_shown, F.col("n_links")).otherwise(F.col("openable")).alias("openable"),
        F.when(links_shown | replaced, F.col("n_links")).otherwise(0).alias("fallback_links"))


def diagnose_list(shape: DataFrame, minimum: int = FALLBACK_MIN_LINKS) -> DataFrame:
    """A code where a rule demonstrably failed; null for quiet pages."""
    code = (
        F.when(~F.col("has_rule"), None)
        .when((F.col("containers") == 0) & (F.col("fallback_links") >= minimum), F.lit("rule_matched_nothing"))
        .when((F.col("containers") > 0) & (F.col("openable") == 0), F.lit("nothing_openable")))
    return shape.withColumn("diagnosis", code.cast("string"))


def next_page(pages: DataFrame, nodes: DataFrame, rule_values_: DataFrame | None = None, labels: list[str] = NEXT_LABELS) -> DataFrame:
    """The address of the next page: JSON keys, else the rule's value when it
    looks like an address, else the first link with a "next" label."""
    v = F.try_parse_json(F.when(is_json_body(F.col("html")), F.col("html")))
    texts = [json_text(F.try_variant_get(v, F.lit(f"$.{k}"), "variant")) for k in NEXT_KEYS]
    from_json = F.coalesce(*[F.when(t.rlike(r"^(http|/)"), t) for t in texts])
    rows = pages.select("page_id", "url", v.isNotNull().alias("_json"), from_json.alias("_from_json"))
    rows = rows.join(links_by_text(nodes, labels), "page_id", "left")
    if rule_values_ is not None:
        rows = rows.join(rule_values_.select("page_id", F.col("value").alias("_rule")), "page_id", "left")
    else:
        rows = rows.withColumn("_rule", F.lit(None).cast("string"))
    ruled = F.when(F.col("_rule").rlike(r"^(http|/)") | F.col("_rule").contains("page"), F.col("_rule"))
    target = F.when(F.col("_json"), F.col("_from_json")).otherwise(F.coalesce(ruled, F.col("href")))
    return rows.select("page_id", absolute_url(target, F.col("url")).alias("next_url")).filter(F.col("next_url").isNotNull())


def expand_page_urls(templates: DataFrame, first: int, last: int) -> DataFrame:
    """One row per template and page number with the slots filled."""
    rows = templates.withColumn("page", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return rows.withColumn("page_url", expand_page(F.col("template"), F.col("page")))


def search_urls(sources: DataFrame, requests: DataFrame) -> DataFrame:
    """The address that searches a source for a keyword; ``requests`` is
    ``source_id, keyword``."""
    rows = requests.join(sources.select("source_id", "source_url", "search_url"), "source_id")
    filled = F.replace(F.col("search_url"), F.lit("{{keyWord}}"), F.col("keyword"))
    own = absolute_url(F.trim(expand_page(filled, F.lit(1))), F.col("source_url"))
    q = F.url_encode(F.col("keyword"))
    plain = F.concat(F.regexp_replace(absolute_url(F.lit("search"), F.col("source_url")), r"[?#].*$", ""),
                     F.lit("?keyword="), q, F.lit("&wd="), q)
    general = F.when(origin_of(F.col("source_url")) != "", plain)
    return rows.select("source_id", "keyword", F.when(F.trim("search_url") != "", own).otherwise(general).alias("search_page"))


def needs_render(pages: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages worth a browser: script sources with nothing openable and a body."""
    opened = items.filter(F.trim("link") != "").select("page_id").distinct()
    script = sources.filter("enable_js").select("source_no")
    body = pages.filter((F.trim("html") != "") & F.col("url").startswith("http")).select("page_id", "url", "source_no")
    return body.join(script, "source_no", "left_semi").join(opened, "page_id", "left_anti").select("page_id", "url", "source_no")


def needs_refetch(pages: DataFrame) -> DataFrame:
    """Pages with no text of their own that refresh to another address."""
    target = meta_refresh(F.col("html"))
    rows = pages.filter(target.isNotNull() & (html_to_text(F.col("html")) == ""))
    return rows.select("page_id", absolute_url(target, F.col("url")).alias("target")).filter(F.trim("target") != "")
