"""The audit of a source library, stage by stage.

Details are stable codes with numbers beside them; wording is presentation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import WALL_MARKERS, block_wall, short_text
from pageloom.functions.urls import absolute_url
from pageloom.operators.common import first_per_key
from pageloom.operators.library import HOME_CATEGORY, display_name, explode_categories
from pageloom.operators.lists import is_single_page

# --- fixed values -----------------------------------------------------------
STALE_SECONDS = 3 * 24 * 3600
SEARCH_WORDS = ["搜索", "搜", "search", "keyword"]
TRANSPORT_WORDS = ["无法访问", "网络请求失败", "timed out", "超时", "dns", "connection"]
THIN_TEXT_CHARS = 120
STAGES = ["rule", "homepage", "list", "detail", "search"]
# ---------------------------------------------------------------------------

STAGE_COLUMNS = ["source_id", "key", "state", "code", "detail"]


def _stage(df: DataFrame, key: str, state: Column, code: Column, detail: Column) -> DataFrame:
    return df.select("source_id", F.lit(key).alias("key"), state.alias("state"), code.alias("code"), detail.alias("detail"))


def audit_scope(sources: DataFrame, scope: str, now_s: int | Column, ids: DataFrame | None = None) -> DataFrame:
    """G1: the sources a run covers: all, failed, unchecked or stale.

    Uses ``has_health, health_ok, checked_s``.
    """
    now = now_s if isinstance(now_s, Column) else F.lit(now_s)
    chosen = {
        "failed": F.col("has_health") & ~F.col("health_ok"),
        "unchecked": ~F.col("has_health"),
        "stale": ~F.col("has_health") | F.coalesce(~F.col("health_ok"), F.lit(False)) | (now - F.col("checked_s") > STALE_SECONDS),
    }.get(scope, F.lit(True))
    rows = sources.filter(chosen)
    return rows if ids is None else rows.join(ids, "source_id", "left_semi")


def probe_category(sources: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """The category worth probing: the site root, else the first that is no
    search box, else the root itself."""
    categories = explode_categories(sources) if categories is None else categories
    rows = categories.join(sources.select("source_id", "source_url"), "source_id")
    bare = lambda c: F.regexp_replace(F.trim(c), "/+$", "")
    is_root = bare(absolute_url(F.col("category_url"), F.col("source_url"))) == bare(F.col("source_url"))
    search = F.lit(False)
    for word in SEARCH_WORDS:
        search = search | F.lower("name").contains(word)
    rank = F.when(is_root, 0).when(~search, 1).otherwise(2)
    best = rows.groupBy("source_id").agg(
        F.min_by(F.struct("name", "category_url", "source_url", rank.alias("rank")), F.struct(rank, "row")).alias("w"))
    none = F.col("w.rank") == 2
    return best.select("source_id", F.when(none, F.lit(HOME_CATEGORY)).otherwise(F.col("w.name")).alias("category"),
                       F.when(none, F.col("w.source_url")).otherwise(F.col("w.category_url")).alias("category_url"))


def stage_rule(sources: DataFrame) -> DataFrame:
    """What a source declares; informational, never a failure."""
    cats = explode_categories(sources).groupBy("source_id").agg(F.count("*").alias("n_categories"))
    rows = sources.join(cats, "source_id")
    blank = lambda c: F.trim(c) == ""
    missing = F.array_join(F.array_compact(F.array(
        F.when(blank("rule_articles"), F.lit("ruleArticles")), F.when(blank("rule_content"), F.lit("ruleContent")))), ",")
    code = (
        F.when(blank("rule_articles") & blank("rule_title") & blank("rule_link"), "bare_address")
        .when(is_single_page(F.col("rule_articles"), F.col("rule_link")), "single_page")
        .when(missing != "", F.concat(F.lit("missing:"), missing)).otherwise("complete"))
    return _stage(rows, "rule", F.lit("ok"), code, F.concat(F.lit("categories="), F.col("n_categories").cast("string")))


def stage_homepage(targets: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Did the home page answer? ``fetch_log``: ``source_id, status, error, body_chars``."""
    rows = targets.select("source_id").join(fetch_log, "source_id", "left")
    bad = ~F.col("status").between(200, 299)
    state = F.when(F.col("status").isNull() | F.col("error").isNotNull() | bad, "fail").otherwise("ok")
    code = (
        F.when(F.col("status").isNull() & F.col("error").isNull(), "not_fetched")
        .when(F.col("error").isNotNull(), "unreachable").when(bad, "http_status").otherwise("ok"))
    detail = F.when(F.col("error").isNotNull(), F.col("error")).when(bad, F.concat(F.lit("http "), F.col("status").cast("string"))).otherwise(
        F.coalesce(F.concat(F.lit("chars="), F.col("body_chars").cast("string")), F.lit("")))
    return _stage(rows, "homepage", state, code, detail)


def _fetch_failure() -> Column:
    return F.col("error").isNotNull() | F.col("status").isNull() | ~F.col("status").between(200, 299)


def _why() -> Column:
    return F.coalesce(F.col("error"), F.concat(F.lit("http "), F.col("status").cast("string")), F.lit("not fetched"))


def stage_list(targets: DataFrame, fetch_log: DataFrame, items: DataFrame, page_text: DataFrame) -> DataFrame:
    """What the list rule made of the probed page.

    ``targets``: ``source_id, rule_articles, rule_link, enable_js``; ``items``:
    ``source_id, ix, title, link``; ``page_text``: ``source_id, chars``.
    """
    got = items.groupBy("source_id").agg(
        F.count("*").alias("n"), F.count_if(F.trim("link") != "").alias("linked"), F.min_by("title", "ix").alias("first_title"))
    rows = targets.join(fetch_log, "source_id", "left").join(got, "source_id", "left").join(page_text, "source_id", "left")
    rows = rows.na.fill(0, ["n", "linked", "chars"])
    single = is_single_page(F.col("rule_articles"), F.col("rule_link"))
    failed = _fetch_failure()
    state = (
        F.when(failed, "fail").when(single & (F.col("chars") == 0), "fail").when(single, "ok")
        .when(F.col("n") == 0, "warn").when(F.col("linked") == 0, "warn").otherwise("ok"))
    code = (
        F.when(failed, "fetch_failed").when(single & (F.col("chars") == 0), "no_text").when(single, "single_page")
        .when((F.col("n") == 0) & F.col("enable_js"), "no_items_script").when(F.col("n") == 0, "no_items")
        .when((F.col("linked") == 0) & (F.trim("rule_link") == ""), "no_link_rule").when(F.col("linked") == 0, "no_links").otherwise("items"))
    detail = (
        F.when(failed, _why()).when(single, F.concat(F.lit("chars="), F.col("chars").cast("string")))
        .when(F.col("linked") > 0, F.concat(F.lit("items="), F.col("n").cast("string"), F.lit(" first="), short_text(F.col("first_title"), 24)))
        .otherwise(F.concat(F.lit("items="), F.col("n").cast("string"))))
    return _stage(rows, "list", state, code, detail)


def stage_detail(targets: DataFrame, fetch_log: DataFrame, articles: DataFrame) -> DataFrame:
    """Did the first linked item open into text? ``targets`` has ``detail_url``
    (null when nothing can be opened); ``articles``: ``source_id, chars, media``."""
    rows = targets.select("source_id", "detail_url").join(fetch_log, "source_id", "left").join(articles, "source_id", "left")
    rows = rows.na.fill(0, ["chars", "media"])
    skip = F.coalesce(F.trim("detail_url"), F.lit("")) == ""
    failed = _fetch_failure()
    state = F.when(skip, "skip").when(failed, "fail").when(F.col("chars") == 0, "fail").when(F.col("chars") < THIN_TEXT_CHARS, "warn").otherwise("ok")
    code = F.when(skip, "nothing_to_open").when(failed, "fetch_failed").when(F.col("chars") == 0, "no_text").when(
        F.col("chars") < THIN_TEXT_CHARS, "thin_text").otherwise("text")
    detail = F.when(skip, "").when(failed, _why()).otherwise(
        F.concat(F.lit("chars="), F.col("chars").cast("string"), F.lit(" media="), F.col("media").cast("string")))
    return _stage(rows, "detail", state, code, detail)


def stage_search(targets: DataFrame, fetch_log: DataFrame, items: DataFrame) -> DataFrame:
    """Did a search find anything? ``targets``: ``source_id, search_url, source_name,
    source_url``; ``items``: one row per result on the search page."""
    found = items.groupBy("source_id").agg(F.count("*").alias("n"))
    rows = targets.join(fetch_log, "source_id", "left").join(found, "source_id", "left").na.fill(0, ["n"])
    skip = F.trim("search_url") == ""
    failed = _fetch_failure()
    keyword = F.substring(F.trim(display_name()), 1, 8)
    state = F.when(skip, "skip").when(failed, "fail").when(F.col("n") == 0, "warn").otherwise("ok")
    code = F.when(skip, "no_search").when(failed, "fetch_failed").when(F.col("n") == 0, "no_results").otherwise("results")
    detail = F.when(skip, "").when(failed, _why()).otherwise(
        F.concat(F.lit("keyword="), F.coalesce(F.nullif(keyword, F.lit("")), F.lit("2024")), F.lit(" n="), F.col("n").cast("string")))
    return _stage(rows, "search", state, code, detail)


def stage_order(key: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), key)


def summarize_health(stages: DataFrame, counts: DataFrame, by: list[str]) -> DataFrame:
    """The verdict of each run: first failure, else first warning, else fine.

    ``counts``: ``by + item_count, usable``. At most five stages meet per run.
    """
    order = stage_order(F.col("key"))
    bad = F.col("state").isin("fail", "warn")
    rank = F.struct(F.when(F.col("state") == "fail", 0).otherwise(1), order)
    worst = F.min_by(F.when(bad, F.concat_ws(": ", "key", "detail")), F.when(bad, rank))
    folded = stages.groupBy(*by).agg(
        worst.alias("worst"), F.bool_and(F.col("state").isin("ok", "skip")).alias("clean"),
        F.bool_or(F.col("state") == "fail").alias("any_fail"), F.bool_or(F.col("state") == "warn").alias("any_warn"))
    rows = folded.join(counts, by)
    status = F.coalesce("worst", F.concat(F.lit("ok: "), F.col("item_count").cast("string"), F.lit(" items")))
    return rows.select(*by, (F.col("clean") & (F.col("usable") > 0)).alias("ok"), status.alias("status"), "item_count", "any_fail", "any_warn")


def outcome() -> Column:
    """failed, warn or ok of one health row."""
    return F.when(F.col("any_fail"), "failed").when(F.col("any_warn"), "warn").when(F.col("ok"), "ok").otherwise("warn")


def outcome_counts(health: DataFrame) -> DataFrame:
    """Totals over a run."""
    kind = outcome()
    return health.agg(F.count("*").alias("total"), F.count_if(kind == "ok").alias("ok"),
                      F.count_if(kind == "warn").alias("warn"), F.count_if(kind == "failed").alias("failed"))


def failure_bucket(stages: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """Working, unreachable, degraded or rule-broken.

    ``facts``: ``by + item_count, single_page``. A failed home page or list
    decides first; transport words in its detail make it unreachable.
    """
    low = F.lower("detail")
    transport = F.lit(False)
    for word in TRANSPORT_WORDS:
        transport = transport | low.contains(word)
    front = (F.col("state") == "fail") & F.col("key").isin("homepage", "list")
    folded = stages.groupBy(*by).agg(
        F.min_by(F.when(front, transport), F.when(front, stage_order(F.col("key")))).alias("front_transport"),
        F.bool_or(F.col("state") == "fail").alias("any_fail"),
        F.bool_or((F.col("key") == "list") & F.col("detail").contains("no links")).alias("unlinked"))
    rows = folded.join(facts, by)
    bucket = (
        F.when(F.col("front_transport"), "unreachable").when(F.col("front_transport") == F.lit(False), "degraded")
        .when(F.col("single_page"), F.when(F.col("any_fail"), "rule-broken").otherwise("working"))
        .when((F.col("item_count") > 0) & ~F.col("unlinked"), "working").otherwise("rule-broken"))
    return rows.withColumn("bucket", bucket)


def pass_rate_report(buckets: DataFrame) -> DataFrame:
    """Count and share per bucket with the profile of the run, and whether every
    verified source has one bucket. ``buckets``: ``bucket, enable_js, single_page``."""
    per = buckets.groupBy("bucket").agg(
        F.count("*").alias("n"), F.count_if(~F.col("enable_js")).alias("no_script"), F.count_if("enable_js").alias("script"),
        F.count_if("single_page").alias("single"))
    # Four buckets at most reach this window.
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(everything)
    known = F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0)).over(everything)
    return per.select("bucket", "n", F.round(F.col("n") * 100.0 / total, 1).alias("share"), "no_script", "script", "single",
                      total.alias("verified"), (total == known).alias("reconciled"))


def container_names(rule: Column) -> Column:
    """The class and id names a rule finds its containers by."""
    name = r"(?:class\.|id\.|(?<!tag)(?<!text)[.#])([\p{L}\p{N}_-]+)"
    return F.array_distinct(F.regexp_extract_all(rule, F.lit(name), F.lit(1)))


def rule_fit(sources: DataFrame, snapshots: DataFrame, markers: list[str] = WALL_MARKERS) -> DataFrame:
    """Does a rule still describe the pages it was written for?

    ``snapshots``: ``source_id, html`` (null when the capture failed) and
    ``openable``, the entries the rule yields.
    """
    rows = snapshots.join(sources.select("source_id", container_names(F.col("rule_articles")).alias("names")), "source_id")
    present = F.exists("names", lambda n: F.col("html").contains(n))
    rows = rows.select("source_id", "openable", F.coalesce(present, F.lit(False)).alias("present"),
                       block_wall(F.col("html"), markers).isNotNull().alias("walled"), F.col("html").isNotNull().alias("captured"))
    seen = F.when(F.col("captured"), F.col("openable"))
    folded = rows.groupBy("source_id").agg(
        F.bool_or("present").alias("present"), F.bool_and(F.col("walled") & F.col("captured")).alias("blocked"),
        F.min(seen).alias("least"), F.max(seen).alias("most"), F.count("*").alias("snapshots"))
    verdict = (
        F.when(F.col("blocked") & ~F.col("present"), "blocked").when(~F.col("present"), "redesigned")
        .when(F.col("least") != F.col("most"), "intermittent").when(F.coalesce("most", F.lit(0)) == 0, "engine_defect").otherwise("working"))
    return folded.select("source_id", "snapshots", verdict.alias("verdict"))


def ab_compare(passes: DataFrame) -> DataFrame:
    """What a switch changed between passes 0 (off), 1 (on) and 2 (off again):
    ``name, change`` with gained, lost and drift. ``passes``: ``pass_no, name, works``."""
    working = lambda n: passes.filter((F.col("pass_no") == n) & F.col("works")).select("name")
    measured_on = passes.filter(F.col("pass_no") == 1).select("name")
    off, on, off_again = working(0), working(1), working(2)
    gained = on.subtract(off).withColumn("change", F.lit("gained"))
    lost = off.intersect(measured_on).subtract(on).withColumn("change", F.lit("lost"))
    drift = off.subtract(off_again).withColumn("change", F.lit("drift"))
    return gained.unionByName(lost).unionByName(drift)


def no_verdict_guard(passes: DataFrame) -> DataFrame:
    """Rows measured and rows with a verdict per pass, and whether they agree."""
    good = F.col("bucket").isNotNull() & (F.col("bucket") != "error")
    per = passes.groupBy("pass_no").agg(F.count("*").alias("measured"), F.count_if(good).alias("classified"))
    return per.withColumn("missing", F.col("measured") - F.col("classified")).withColumn("complete", F.col("missing") == 0)


def overall() -> Column:
    return F.when(F.col("ok").isNull(), "none").when(F.col("any_fail"), "fail").when(F.col("ok"), "ok").otherwise("warn")


def verdict_table(sources: DataFrame, health: DataFrame, only_problems: bool = False) -> DataFrame:
    """Sources with their verdict, problems first, then by name."""
    rows = sources.join(health, "source_id", "left").withColumn("overall", overall())
    if only_problems:
        rows = rows.filter(F.col("overall") != "ok")
    rank = F.when(F.col("overall") == "fail", 0).when(F.col("overall") == "warn", 1).when(F.col("overall") == "none", 2).otherwise(3)
    return rows.withColumn("rank", rank).orderBy("rank", "source_name", "source_id")


def latest_health(health: DataFrame) -> DataFrame:
    """The newest verdict per source; ties go to the later run."""
    return first_per_key(health, ["source_id"], [-F.col("checked_s"), -F.col("run_no")])


def apply_health(sources: DataFrame, health: DataFrame) -> DataFrame:
    """The newest verdict written onto each source; others keep theirs."""
    new = latest_health(health).select("source_id", F.col("ok").alias("_ok"), F.col("checked_s").alias("_at"))
    rows = sources.join(new, "source_id", "left")
    return rows.withColumns({
        "has_health": F.col("has_health") | F.col("_at").isNotNull(), "health_ok": F.coalesce("_ok", "health_ok"),
        "checked_s": F.coalesce("_at", "checked_s")}).drop("_ok", "_at")


def render_failure_reason(snapshots: DataFrame) -> DataFrame:
    """Why a rendered page still gives nothing: ``source_id, loaded, link_count, openable``."""
    reason = (
        F.when(F.col("openable") > 0, None).when(~F.col("loaded"), "not_loaded")
        .when(F.col("link_count") == 0, "no_links_generated").otherwise("rules_mismatch"))
    return snapshots.withColumn("reason", reason.cast("string"))
