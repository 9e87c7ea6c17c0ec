"""The library of rule sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.hashing import source_id, source_key
from pageloom.functions.rules import CENSUS_CONSTRUCTS
from pageloom.functions.text import strip
from pageloom.operators.common import contains_any, first_per_key

# --- fixed values -----------------------------------------------------------
HOME_CATEGORY, DEFAULT_CATEGORY, OTHER_GROUP = "首页", "默认", "其他"
# ---------------------------------------------------------------------------


def display_name() -> Column:
    return F.when(F.trim("source_name") == "", F.col("source_url")).otherwise(F.col("source_name"))


def merge_sources(library: DataFrame, incoming: DataFrame, collection: str, now: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """Add the sources whose identity is new; the first of equal ones wins.

    Returns the library after the merge and one row of counts. ``order`` is the
    position in the batch.
    """
    keyed = incoming.withColumn("_key", source_key(F.col("source_name"), F.col("source_url")))
    first = first_per_key(keyed, ["_key"], [F.col(order)])
    known = library.select(source_key(F.col("source_name"), F.col("source_url")).alias("_key"))
    fresh = first.join(known, "_key", "left_anti").withColumn("_base", source_id(F.col("source_name"), F.col("source_url")))
    # Different identities with one hash prefix are numbered; such groups are tiny.
    taken = library.select(F.col("source_id").alias("_base")).distinct().withColumn("_taken", F.lit(1))
    nth = F.row_number().over(Window.partitionBy("_base").orderBy("_key")) - 1
    fresh = fresh.join(taken, "_base", "left").withColumn("_n", nth + F.coalesce("_taken", F.lit(0)))
    suffixed = F.substring(F.sha2(F.concat("_key", F.lit("|"), F.col("_n").cast("string")), 256), 1, 16)
    fresh = fresh.withColumn("source_id", F.when(F.col("_n") == 0, F.col("_base")).otherwise(suffixed))
    fresh = fresh.withColumns({
        "enabled": F.lit(True), "favorite": F.lit(False), "collection": F.lit(collection), "added_at": now, "note": F.lit("")})
    merged = library.unionByName(fresh.drop("_key", "_base", "_taken", "_n", order), allowMissingColumns=True)
    total = incoming.agg(F.count("*").alias("total"))
    added = fresh.agg(F.count("*").alias("added"))
    counts = total.crossJoin(added).select("added", (F.col("total") - F.col("added")).alias("skipped"))
    return merged.select(*library.columns), counts


def explode_categories(sources: DataFrame) -> DataFrame:
    """Category rows of each source; one home row for sources that name none."""
    lines = sources.select("source_id", F.posexplode(F.split("sort_url", r"\r?\n")).alias("line_no", "line"))
    cells = lines.select("source_id", "line_no", F.posexplode(F.split(strip(F.col("line")), r"\$\$\$")).alias("cell_no", "cell"))
    cell = strip(F.col("cell"))
    url = F.substring_index(cell, "::", -1)
    name = strip(F.expr("substring(trim(cell), 1, length(trim(cell)) - length(substring_index(trim(cell), '::', -1)) - 2)"))
    named = cells.filter(cell.contains("::")).select(
        "source_id", F.when(name == "", F.lit(DEFAULT_CATEGORY)).otherwise(name).alias("name"), strip(url).alias("category_url"),
        (F.col("line_no") * 100 + F.col("cell_no")).alias("row")).filter("category_url <> ''")
    home = sources.join(named.select("source_id").distinct(), "source_id", "left_anti").select(
        "source_id", F.lit(HOME_CATEGORY).alias("name"), F.col("source_url").alias("category_url"), F.lit(0).alias("row"))
    return named.unionByName(home).withColumn("paged", F.col("category_url").contains("{{page}}"))


def patch_sources(sources: DataFrame, patches: DataFrame) -> DataFrame:
    """Replace the fields a patch sets; ``patches``: ``source_id, new_*`` nullable."""
    rows = sources.join(patches, "source_id", "left")
    for name in ("enabled", "favorite", "custom_order", "note"):
        if f"new_{name}" in patches.columns:
            rows = rows.withColumn(name, F.coalesce(F.col(f"new_{name}"), F.col(name)))
    return rows.select(*sources.columns)


def remove_sources(sources: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources that stay, and how many went."""
    gone = sources.join(ids, "source_id", "left_semi").agg(F.count("*").alias("removed"))
    return sources.join(ids, "source_id", "left_anti"), gone


def list_sources(sources: DataFrame, text: str = "") -> DataFrame:
    """Sources whose name, address, group or collection contains the text, in display order."""
    rows = sources.withColumn("display_name", display_name())
    rows = rows.filter(contains_any(["display_name", "source_url", "source_group", "collection"], text))
    return rows.orderBy(F.col("custom_order").desc(), "display_name", "source_id")


def group_by_collection(sources: DataFrame) -> DataFrame:
    """Every source under its collection, with the collection's size.

    Kept as rows in listing order instead of one array per collection: a
    collection may hold a third of the library.
    """
    rows = sources.withColumn("group_name", F.coalesce(F.nullif("collection", F.lit("")), F.lit(OTHER_GROUP)))
    sizes = rows.groupBy("group_name").agg(F.count("*").alias("group_size"))
    rows = rows.withColumn("display_name", display_name()).join(sizes, "group_name")
    return rows.orderBy("group_name", F.col("custom_order").desc(), "display_name", "source_id").select(
        "group_name", "group_size", "source_id", "display_name", "custom_order")


def source_summary(sources: DataFrame) -> DataFrame:
    """Display name, category count, search and script flags per source."""
    cats = explode_categories(sources).groupBy("source_id").agg(F.count("*").alias("category_count"))
    rows = sources.join(cats, "source_id")
    return rows.select("source_id", display_name().alias("display_name"), "category_count",
                       (F.trim("search_url") != "").alias("has_search"), F.col("enable_js").alias("js_enabled"))


def library_stats(sources: DataFrame, collections: DataFrame, history: DataFrame) -> DataFrame:
    """One row of counts; each table is aggregated once, only scalars meet."""
    s = sources.agg(
        F.count("*").alias("sources"), F.count_if("enabled").alias("enabled"), F.count_if("favorite").alias("favorites"),
        F.count_if("has_health").alias("checked"), F.count_if(F.col("has_health") & F.col("health_ok")).alias("working"))
    c = collections.agg(F.count("*").alias("collections"))
    h = history.agg(F.count("*").alias("history"))
    return s.crossJoin(c).crossJoin(h)


def upsert_collections(collections: DataFrame, incoming: DataFrame, order: str = "added_at") -> DataFrame:
    """Replace collections by address (the last of a batch wins), newest first."""
    rest = [c for c in incoming.columns if c != "url"]
    latest = incoming.groupBy("url").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select("url", "_row.*").select(*collections.columns)
    kept = collections.join(latest.select("url"), "url", "left_anti")
    return kept.unionByName(latest).orderBy(F.col(order).desc(), "url")


def largest_collections(index: DataFrame, n: int = 15) -> DataFrame:
    """The collections with the most sources."""
    return index.orderBy(F.col("source_count").desc(), "id").limit(n)


def rule_construct_census(sources: DataFrame, fields: list[str], constructs: list[str] = CENSUS_CONSTRUCTS, by: tuple[str, ...] = ()) -> DataFrame:
    """Per construct how many sources use it and how often it occurs."""
    blob = F.concat_ws("\n", *fields)
    hits = F.array(*[F.struct(
        F.lit(c).alias("construct"),
        F.floor((F.length("_blob") - F.length(F.replace("_blob", F.lit(c)))) / len(c)).cast("bigint").alias("n")) for c in constructs])
    rows = sources.select(*by, blob.alias("_blob")).select(*by, F.explode(hits).alias("h"))
    return rows.groupBy(*by, F.col("h.construct").alias("construct")).agg(
        F.count_if(F.col("h.n") > 0).alias("sources"), F.sum("h.n").alias("hits"))


def find_sources(sources: DataFrame, keys: DataFrame, by: str = "source_id") -> DataFrame:
    """The sources behind ids or base addresses."""
    return sources.join(keys, by, "left_semi")
