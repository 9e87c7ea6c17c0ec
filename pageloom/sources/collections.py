"""A1, B1, B2: shared collections of rule sources, read from JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.rules import parse_headers

# --- fixed values -----------------------------------------------------------
WRAPPER_KEYS = ["data", "sources", "list", "items", "result"]
# record key -> column; the type is the column's
TEXT_FIELDS = {
    "sourceUrl": "source_url", "sourceName": "source_name", "sourceGroup": "source_group", "sourceIcon": "source_icon",
    "header": "header", "sortUrl": "sort_url", "ruleArticles": "rule_articles", "ruleTitle": "rule_title",
    "ruleLink": "rule_link", "ruleImage": "rule_image", "rulePubDate": "rule_pub_date", "ruleNextPage": "rule_next_page",
    "style": "style", "ruleContent": "rule_content", "searchUrl": "search_url", "ruleSearch": "rule_search",
    "ruleSearchList": "rule_search_list", "ruleSearchName": "rule_search_name", "ruleSearchLink": "rule_search_link",
    "ruleSearchCover": "rule_search_cover", "injectJs": "inject_js",
}
NUMBER_FIELDS = {"customOrder": "custom_order", "articleStyle": "article_style"}
FLAG_FIELDS = {"singleUrl": "single_url", "enableJs": "enable_js"}
DEFAULT_TRUE_FIELDS = {"enabledCookieJar": "enabled_cookie_jar", "loadWithBaseUrl": "load_with_base_url"}
LEGACY_FIELDS = {
    "rule_link": ["articleUrl"], "rule_title": ["itemTitle"], "rule_content": ["itemContent", "itemDescription"],
    "rule_image": ["itemImage"],
}
# ---------------------------------------------------------------------------


def _text(v: Column, key: str) -> Column:
    return F.try_variant_get(v, F.lit(f"$.{key}"), "string")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def split_collections(files: DataFrame, key: str, text: str = "body") -> tuple[DataFrame, DataFrame]:
    """Collection texts to ``key, ix, record`` variants and ``key, ix, reason`` rejects.

    A file is an array, or an object with one under the first wrapper key that
    holds an array. Records without an address are dropped silently; records that
    are no objects, or hold a wrong type in a known field, are rejected.
    """
    parsed = files.select(key, F.try_parse_json(F.col(text)).alias("v"))
    arrays = [F.try_variant_get(F.col("v"), F.lit("$"), "array<variant>")]
    arrays += [F.try_variant_get(F.col("v"), F.lit(f"$.{k}"), "array<variant>") for k in WRAPPER_KEYS]
    parsed = parsed.withColumn("records", F.coalesce(*arrays))
    no_list = parsed.filter("records is null").select(
        key, F.lit(-1).alias("ix"), F.when(F.col("v").isNull(), F.lit("not_json")).otherwise(F.lit("no_source_array")).alias("reason"))
    rows = parsed.select(key, F.posexplode("records").alias("ix", "record"))
    bad_field = F.lit(None).cast("string")
    for name in reversed([*TEXT_FIELDS, *FLAG_FIELDS, *NUMBER_FIELDS]):
        v = F.try_variant_get(F.col("record"), F.lit(f"$.{name}"), "variant")
        want = ["STRING"] if name in TEXT_FIELDS else ["BOOLEAN"] if name in FLAG_FIELDS else ["BIGINT"]
        bad_field = F.when(v.isNotNull() & ~_kind(v).isin(want), F.lit(name)).otherwise(bad_field)
    reason = F.when(_kind(F.col("record")) != "OBJECT", F.lit("not_an_object")).otherwise(F.concat(F.lit("bad_type:"), bad_field))
    rows = rows.withColumn("reason", reason)
    rejects = no_list.unionByName(rows.filter("reason is not null").select(key, "ix", "reason"))
    good = rows.filter("reason is null").drop("reason")
    return good.filter(F.trim(F.coalesce(_text(F.col("record"), "sourceUrl"), F.lit(""))) != ""), rejects


def read_collection(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1: collection files to source records and rejects, keyed by file.

    A file of which nothing but rejects came out is an error row of its own.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    good, rejects = split_collections(files, "file")
    dead = rejects.filter("ix >= 0").select("file").distinct().join(good.select("file").distinct(), "file", "left_anti")
    return good, rejects.unionByName(dead.select("file", F.lit(-1).alias("ix"), F.lit("no_usable_source").alias("reason")))


def upgrade_legacy(records: DataFrame) -> DataFrame:
    """B2: the rule columns of a record with legacy names taken over.

    A legacy value is used only when the new key is absent; a record without a
    list rule whose link is empty, paged or scripted reads the page itself.
    """
    rows = records
    v = F.col("record")
    present = lambda k: F.try_variant_get(v, F.lit(f"$.{k}"), "variant").isNotNull()
    for column, olds in LEGACY_FIELDS.items():
        new = next(k for k, c in TEXT_FIELDS.items() if c == column)
        old = F.coalesce(*[F.nullif(_text(v, o), F.lit("")) for o in olds], F.lit(""))
        rows = rows.withColumn(column, F.when(present(new), F.coalesce(_text(v, new), F.lit(""))).otherwise(old))
    link = F.col("rule_link")
    whole = (link == "") | link.contains("{{page}}") | link.contains("java.") | link.contains("<js>")
    articles = F.when(present("ruleArticles"), F.coalesce(_text(v, "ruleArticles"), F.lit(""))).when(whole, F.lit("body")).otherwise(F.lit(""))
    return rows.withColumn("rule_articles", articles)


def normalize_sources(records: DataFrame) -> DataFrame:
    """B1: records on the fixed schema, unknown keys kept as JSON text in ``extra``."""
    rows = upgrade_legacy(records)
    v = F.col("record")
    done = {"rule_link", "rule_title", "rule_content", "rule_image", "rule_articles"}
    for name, column in TEXT_FIELDS.items():
        if column not in done:
            rows = rows.withColumn(column, F.coalesce(_text(v, name), F.lit("")))
    for name, column in NUMBER_FIELDS.items():
        rows = rows.withColumn(column, F.coalesce(F.try_variant_get(v, F.lit(f"$.{name}"), "bigint"), F.lit(0)))
    for name, column in FLAG_FIELDS.items():
        rows = rows.withColumn(column, F.coalesce(F.try_variant_get(v, F.lit(f"$.{name}"), "boolean"), F.lit(False)))
    for name, column in DEFAULT_TRUE_FIELDS.items():
        rows = rows.withColumn(column, F.coalesce(F.try_variant_get(v, F.lit(f"$.{name}"), "boolean"), F.lit(True)))
    known = [*TEXT_FIELDS, *NUMBER_FIELDS, *FLAG_FIELDS, *DEFAULT_TRUE_FIELDS]
    members = F.try_variant_get(v, F.lit("$"), "map<string,variant>")
    extra = F.transform_values(F.map_filter(members, lambda k, x: ~k.isin(known)), lambda k, x: F.to_json(x))
    return rows.withColumn("extra", extra).withColumn("headers", parse_headers(F.col("header"))).drop("record")
