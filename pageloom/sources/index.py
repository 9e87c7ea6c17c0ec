"""A2-A5: index pages that list shared collections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import clean_text
from pageloom.functions.urls import absolute_url, is_detail_link, numeric_id, origin_of
from pageloom.operators.nodes import page_texts
from pageloom.operators.within import inside
from pageloom.operators.select import class_list, node_text
from pageloom.session import materialize

# --- fixed values -----------------------------------------------------------
CARD_CLASS, TABLE_CLASS = "ylist", "layui-table-tbody"
AUTHOR_LABEL, SOURCES_LABEL, COUNT_LABEL, DOWNLOADS_LABEL = "用户", "源数量", "数量", "下载"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class IndexPaths:
    """Where a repository keeps its pages; every site has its own words for it."""

    index: str = "/index.html"
    index_page: str = "/index_{page}.html"
    json: str = "/json/id/{id}.json"

    @property
    def json_folder(self) -> str:
        folder = self.json.strip().strip("/").rpartition("/")[0]
        return folder[: -len("/id")].rpartition("/")[2] if folder.endswith("/id") else ""


def index_url(base: Column, page: Column, paths: IndexPaths) -> Column:
    root = F.regexp_replace(base, "/+$", "")
    later = F.replace(F.lit(paths.index_page), F.lit("{page}"), page.cast("string"))
    return F.concat(root, F.when(page <= 1, F.lit(paths.index)).otherwise(later))


def index_urls(sites: DataFrame, pages: int, paths: IndexPaths) -> DataFrame:
    """A3: the addresses of the first ``pages`` index pages of each site (``base``)."""
    rows = sites.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    return rows.withColumn("index_page_url", index_url(F.col("base"), F.col("page"), paths))


def derive_download_url(page_url: Column, paths: IndexPaths) -> Column:
    """The download address a detail page's own path implies, null when it implies none."""
    number = numeric_id(page_url)
    path = F.regexp_extract(page_url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(page_url, r"^[^?#]*([?#].*)?$", 1)
    prefix = F.regexp_extract(path, r"^(.*)/[^/]+/id/[0-9][^/]*$", 1)
    ok = path.rlike(r"^.*/[^/]+/id/[0-9][^/]*$") & number.isNotNull() & F.lit(bool(paths.json_folder))
    return F.when(ok, F.concat(origin_of(page_url), prefix, F.lit(f"/{paths.json_folder}/id/"), number, F.lit(".json"), rest))


def discover_download_url(links: DataFrame, collections: DataFrame, paths: IndexPaths) -> DataFrame:
    """A4: a download address per collection: the page's ``.json`` link with its id,
    else its first ``.json`` link, else one derived from the page's path, else an error.

    ``links``: ``coll_key, ix, href``; ``collections``: ``coll_key, page_url, base``.
    """
    is_json = F.lower(F.regexp_extract("href", r"^([^?#]*)", 1)).endswith(".json")
    found = links.filter(is_json).join(collections, "coll_key")
    found = found.withColumn("_link", absolute_url(F.col("href"), F.col("base")))
    other = F.coalesce(numeric_id(F.col("_link")) != numeric_id(F.col("page_url")), F.lit(True))
    best = found.groupBy("coll_key").agg(F.min_by("_link", F.struct(other, "ix")).alias("_linked"))
    rows = collections.join(best, "coll_key", "left")
    url = F.coalesce("_linked", derive_download_url(F.col("page_url"), paths))
    return rows.select("coll_key", "page_url", url.alias("download_url"),
                       F.when(url.isNull(), F.lit("no_download_address")).alias("error"))


def read_collection_index(nodes: DataFrame, pages: DataFrame, paths: IndexPaths = IndexPaths()) -> DataFrame:
    """A2: one row per collection listed on index pages.

    Cards are read where a page yields any, table rows otherwise. ``pages``
    carries ``page_id`` and ``url`` (the site the links resolve against).
    """
    has = lambda name: F.array_contains(class_list(F.col("attrs")), name)
    cards = nodes.filter(has(CARD_CLASS)).select("page_id", F.col("node_id").alias("box"), "last_desc", F.lit(True).alias("card"))
    bodies = nodes.filter(F.col("tag") == "tbody").select(
        "page_id", F.col("node_id").alias("body"), F.col("last_desc").alias("body_last"), has(TABLE_CLASS).alias("styled"))
    rows = nodes.filter(F.col("tag") == "tr").select("page_id", F.col("node_id").alias("box"), "last_desc")
    rows = inside(bodies, rows, ["page_id"], "body", "body_last", "box", itself=False).groupBy("page_id", "box", "last_desc").agg(F.max("styled").alias("styled"))
    styled = rows.groupBy("page_id").agg(F.max("styled").alias("page_styled"))
    rows = rows.join(styled, "page_id").filter(F.col("styled") == F.col("page_styled"))
    boxes = cards.unionByName(rows.select("page_id", "box", "last_desc", F.lit(False).alias("card")))

    parts = nodes.filter(F.col("tag").isin("a", "span", "p", "td")).select(
        "page_id", "node_id", "tag", F.coalesce(F.col("attrs")["href"], F.lit("")).alias("href"), "t_from", "t_to")
    parts = inside(boxes, parts, ["page_id"], "box", "last_desc", "node_id").join(page_texts(nodes), "page_id")
    parts = parts.withColumn("text", node_text(F.col("t_from"), F.col("t_to"), F.col("doc_text"))).drop("doc_text")
    parts = materialize(parts, "index_parts")
    is_a = F.col("tag") == "a"
    href_rank = F.when(is_a & is_detail_link(F.col("href")), 0).when(is_a & F.lower("href").endswith(".json"), 1)
    fact = (F.col("tag") == F.when(F.col("card"), "span").otherwise("td")) & (F.col("text") != "")
    count_label = F.when(F.col("card"), SOURCES_LABEL).otherwise(COUNT_LABEL)

    def first(value: Column, where: Column) -> Column:
        return F.min_by(F.when(where, value), F.when(where, F.col("node_id")))

    dated = F.when(F.col("card"), F.col("tag") == "p").otherwise(F.col("tag") == "td") & (F.col("text") != "")
    boxed = parts.groupBy("page_id", "box", "card").agg(
        F.min_by(F.when(href_rank.isNotNull(), F.col("href")), F.when(href_rank.isNotNull(), F.struct(href_rank, F.col("node_id")))).alias("href"),
        first(F.col("text"), is_a & (F.col("text") != "")).alias("title"),
        first(F.col("text"), fact & F.col("text").contains(AUTHOR_LABEL)).alias("author"),
        first(F.col("text"), fact & F.col("text").contains(count_label)).alias("counted"),
        first(F.col("text"), fact & F.col("text").contains(DOWNLOADS_LABEL)).alias("loaded"),
        first(F.col("text"), dated).alias("date"))
    boxed = boxed.filter("href is not null")
    # A page with cards is not read as a table.
    carded = boxed.groupBy("page_id").agg(F.max("card").alias("page_card"))
    boxed = boxed.join(carded, "page_id").filter(F.col("card") == F.col("page_card"))
    after = lambda c, label: F.coalesce(F.regexp_replace(F.substr(c, F.instr(c, label) + F.length(label)), "[^0-9]", "").try_cast("bigint"), F.lit(0))
    out = boxed.join(pages.select("page_id", "url"), "page_id")
    page_url = absolute_url(F.col("href"), F.col("url"))
    number = numeric_id(F.regexp_replace(F.trim("href"), "/+$", ""))
    out = out.select(
        F.concat_ws(":", "page_id", "box").alias("coll_key"), "page_id", number.alias("id"), F.coalesce("title", F.lit("")).alias("title"),
        clean_text(F.coalesce(F.regexp_extract("author", r"^[^:：]*[:：](.*)$", 1), F.lit(""))).alias("author"),
        after(F.coalesce("counted", F.lit("")), F.lit(COUNT_LABEL)).alias("source_count"),
        after(F.coalesce("loaded", F.lit("")), F.lit(DOWNLOADS_LABEL)).alias("downloads"),
        F.coalesce("date", F.lit("")).alias("date"), page_url.alias("page_url"), F.col("url").alias("base"))
    out = materialize(out, "index_rows")
    hrefs = parts.filter(is_a).select(F.concat_ws(":", "page_id", "box").alias("coll_key"), F.col("node_id").alias("ix"), "href")
    urls = discover_download_url(hrefs, out.select("coll_key", "page_url", "base"), paths)
    return out.drop("base").join(urls.select("coll_key", "download_url", "error"), "coll_key")
