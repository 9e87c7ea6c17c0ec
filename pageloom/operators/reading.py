"""Reading analytics. Every table carries ``user_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.times import epoch_micros, local_day
from pageloom.operators.common import contains_any, first_per_key, join_skewed, top_per_group
from pageloom.session import materialize

# --- fixed values -----------------------------------------------------------
ARTICLE_CAP_SECONDS = 30 * 60
STARTED, FINISHED = 0.02, 0.98
HISTORY_KEPT, PROGRESS_KEPT, RESUME_WINDOW, CACHE_KEPT = 500, 500, 200, 200
RESUME_MIN_SECONDS, RESUME_MAX_RATIO = 10, 0.95
# ---------------------------------------------------------------------------



def epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def seconds_of(c: Column) -> Column:
    """Whole seconds since the epoch of a UTC instant."""
    return F.floor(epoch_micros(c) / 1000000)


def newest(c: str) -> Column:
    """Order for "newest first" inside min_by structs."""
    return -epoch_micros(F.col(c))


def started(ratio: Column) -> Column:
    return ratio > F.lit(STARTED).cast("float")


def finished(ratio: Column) -> Column:
    return ratio >= F.lit(FINISHED).cast("float")


def reading_window(opened: Column, saved: Column, cap_s: int = ARTICLE_CAP_SECONDS) -> Column:
    """H2: seconds between the two records of an article, at most the cap."""
    gap = F.abs(seconds_of(saved) - seconds_of(opened))
    return F.least(F.coalesce(gap, F.lit(0)), F.lit(cap_s)).cast("bigint")


def reading_windows(history: DataFrame, progress: DataFrame) -> DataFrame:
    """Per article opened: its start and credited seconds (zero without a position)."""
    rows = history.join(progress.select("user_id", "url", "updated_at"), ["user_id", "url"], "left")
    start = F.least(F.col("viewed_at").cast("timestamp_ntz"), F.coalesce("updated_at", "viewed_at").cast("timestamp_ntz"))
    return rows.select("user_id", "url", "viewed_at", start.alias("start_at"),
                       reading_window(F.col("viewed_at"), F.col("updated_at")).alias("secs"))


def split_across_days(windows: DataFrame, tz: str = "UTC") -> DataFrame:
    """H3: credited seconds per local day a window touches."""
    # Days begin at local midnight, but seconds are counted between instants, so a
    # clock change inside a window costs or adds nothing.
    start = F.timestamp_add("SECOND", seconds_of(F.col("start_at")), epoch())
    end = F.timestamp_add("SECOND", seconds_of(F.col("start_at")) + F.col("secs"), epoch())
    rows = windows.filter(F.col("secs") > 0).withColumn("_from", start).withColumn("_to", end)
    last = F.timestamp_add("SECOND", F.lit(-1), F.col("_to"))
    rows = rows.withColumn("day", F.explode(F.sequence(local_day(F.col("_from"), tz), local_day(last, tz))))
    midnight = lambda d: F.convert_timezone(F.lit(tz), F.lit("UTC"), d.cast("timestamp_ntz"))
    inside = seconds_of(F.least("_to", midnight(F.date_add("day", 1)))) - seconds_of(F.greatest("_from", midnight(F.col("day"))))
    return rows.withColumn("day_secs", inside.cast("bigint")).drop("_from", "_to")


def daily_reading(history: DataFrame, progress: DataFrame, tz: str = "UTC") -> DataFrame:
    """H4: articles opened and seconds read per reader and local day."""
    # Opening needs no position, so it is counted without the join.
    opened = history.groupBy("user_id", local_day(F.col("viewed_at"), tz).alias("day")).agg(F.count("*").alias("articles"))
    read = split_across_days(reading_windows(history, progress), tz).groupBy("user_id", "day").agg(F.sum("day_secs").alias("secs"))
    both = opened.join(read, ["user_id", "day"], "full_outer")
    return both.select("user_id", "day", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("secs", F.lit(0)).alias("secs"))


def reading_stats(history: DataFrame, progress: DataFrame, now: Column, tz: str = "UTC") -> DataFrame:
    """H1: articles and whole minutes today, this week (from Monday) and in all."""
    days = daily_reading(history, progress, tz)
    today = local_day(now, tz)
    is_today = F.col("day") == today
    in_week = F.col("day").between(F.to_date(F.date_trunc("week", today)), today)
    pick = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    minutes = lambda c: F.floor(c / 60).cast("bigint")
    return days.groupBy("user_id").agg(
        pick(is_today, "articles").alias("today_articles"), minutes(pick(is_today, "secs")).alias("today_minutes"),
        pick(in_week, "articles").alias("week_articles"), minutes(pick(in_week, "secs")).alias("week_minutes"),
        F.sum("articles").alias("all_articles"), minutes(F.sum("secs")).alias("all_minutes"))


def top_sources(history: DataFrame) -> DataFrame:
    """H5: articles per reader and source (its id, else its name), busiest first."""
    key = F.when(F.col("source_id") == "", F.col("source_name")).otherwise(F.col("source_id"))
    rows = history.groupBy("user_id", key.alias("source_key")).agg(
        F.count("*").alias("articles"), F.max_by("source_name", F.struct(F.col("source_name") != "", "viewed_at", "url")).alias("source_name"))
    return rows.orderBy("user_id", F.col("articles").desc(), "source_name", "source_key")


def record_history(history: DataFrame, opened: DataFrame, keep: int = HISTORY_KEPT) -> DataFrame:
    """H7: one row per reader and address, the newest; the newest ``keep`` per reader.

    ``event_id`` breaks ties between equal times, the later one wins.
    """
    return latest_history(history.unionByName(opened, allowMissingColumns=True), keep)


def latest_history(rows: DataFrame, keep: int = HISTORY_KEPT) -> DataFrame:
    """Of rows of a history the newest per reader and address, the newest ``keep`` per reader."""
    latest = first_per_key(rows, ["user_id", "url"], [newest("viewed_at"), -F.col("event_id")])
    kept = top_per_group(latest, ["user_id"], [F.col("viewed_at").desc(), F.col("event_id").desc()], keep, ["url"])
    return kept.drop("_rank")


def list_history(history: DataFrame, limit: int, text: str = "") -> DataFrame:
    """H8: per reader the newest ``limit`` rows, then those whose title (or address
    when it has none) contains the text."""
    newest_rows = top_per_group(history, ["user_id"], [F.col("viewed_at").desc(), F.col("url")], limit, ["url"])
    rows = newest_rows.withColumn("_shown", F.when(F.col("title") == "", F.col("url")).otherwise(F.col("title")))
    return rows.filter(contains_any(["_shown"], text)).drop("_shown").withColumnRenamed("_rank", "rank")


def upsert_progress(progress: DataFrame | None, events: DataFrame, keep: int = PROGRESS_KEPT, with_event: bool = False) -> DataFrame:
    """H9: the latest clamped position per reader and address, newest ``keep`` per reader.

    ``with_event`` keeps ``event_id``, so that ties with later events do not depend on the order of arrival.
    """
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ratio_raw"))).cast("float")
    new = events.select("user_id", "url", ratio.alias("ratio"), "updated_at", "event_id")
    if progress is not None:
        # Positions stored without the event they are from lose ties against new ones.
        event = F.col("event_id") if "event_id" in progress.columns else F.lit(-1).cast("bigint")
        new = new.unionByName(progress.select("user_id", "url", "ratio", "updated_at", event.alias("event_id")))
    return latest_positions(new, keep).select("user_id", "url", "ratio", "updated_at", *["event_id"] * with_event)


def latest_positions(rows: DataFrame, keep: int = PROGRESS_KEPT) -> DataFrame:
    """Of positions with their ``event_id`` the latest per reader and address, the newest ``keep`` per reader."""
    latest = first_per_key(rows, ["user_id", "url"], [newest("updated_at"), -F.col("event_id")])
    kept = top_per_group(latest, ["user_id"], [F.col("updated_at").desc(), F.col("event_id").desc()], keep, ["url"])
    return kept.select("user_id", "url", "ratio", "updated_at", "event_id")


def progress_for(progress: DataFrame, urls: DataFrame) -> DataFrame:
    """Positions for many addresses; those never opened are absent."""
    return progress.join(urls, ["user_id", "url"], "left_semi")


def continue_reading(history: DataFrame, progress: DataFrame, n: int = 5) -> DataFrame:
    """H6: per reader the newest ``n`` half-read articles among the newest 200 opened."""
    order = [F.col("viewed_at").desc(), F.col("url")]
    recent = top_per_group(history, ["user_id"], order, RESUME_WINDOW, ["url"]).drop("_rank")
    half = progress.filter(started(F.col("ratio")) & ~finished(F.col("ratio"))).select("user_id", "url", "ratio")
    # At most 200 rows per reader are left, so the last ranking is small.
    rows = recent.join(half, ["user_id", "url"])
    return top_per_group(rows, ["user_id"], order, n, ["url"]).withColumnRenamed("_rank", "rank")


def contents_marks(items: DataFrame, progress: DataFrame) -> DataFrame:
    """List items marked finished, started or unread."""
    rows = items.join(progress.select("user_id", F.col("url").alias("link"), "ratio"), ["user_id", "link"], "left")
    mark = F.when(F.col("ratio").isNull(), "unread").when(finished(F.col("ratio")), "finished").otherwise("started")
    return rows.withColumn("mark", mark)


def _items_read(shelf: DataFrame, items: DataFrame, progress: DataFrame) -> DataFrame:
    """Positions on the items of the lists on each reader's shelf: ``user_id, source_id, category, ratio``.

    Each reader is looked up from the smaller side: the shelf, with all items of its lists,
    or the positions, with all lists that hold their links. Which is smaller is
    counted beforehand from the lengths of lists and the places of links, so neither long lists
    nor a link that stands in very many of them is repeated for readers whose other side is
    small. Keys that many rows share are dealt over many parts.
    """
    keys = ["source_id", "category"]
    # All three are read several times below.
    owned = materialize(shelf.select("user_id", *keys).distinct(), "shelf_lists")
    listed = materialize(items.select(*keys, "link"), "list_items")
    seen = materialize(progress.select("user_id", F.col("url").alias("link"), "ratio"), "positions")
    lengths = listed.groupBy(*keys).agg(F.count("*").alias("_n"))
    places = listed.groupBy("link").agg(F.count("*").alias("_n"))
    by_shelf = join_skewed(owned, lengths, keys).groupBy("user_id").agg(F.sum("_n").alias("_items"))
    by_links = join_skewed(seen.select("user_id", "link"), places, ["link"]).groupBy("user_id").agg(F.sum("_n").alias("_places"))
    # Readers who lack one side have nothing to find.
    first = materialize(by_shelf.join(by_links, "user_id").select("user_id", (F.col("_places") < F.col("_items")).alias("_by_links")), "readers")
    own = owned.join(first.filter(~F.col("_by_links")), "user_id", "left_semi")
    from_shelf = join_skewed(own, listed, keys).join(seen, ["user_id", "link"])
    put = join_skewed(seen, first.filter("_by_links").select("user_id"), ["user_id"])
    from_links = join_skewed(put, listed, ["link"]).join(owned, ["user_id", *keys])
    out = ["user_id", *keys, "ratio"]
    return from_shelf.select(out).unionByName(from_links.select(out))


def shelf_progress(shelf: DataFrame, sources: DataFrame, items: DataFrame, progress: DataFrame) -> DataFrame:
    """Per shelf entry how many items there are, are finished and are begun.

    ``sources``: ``source_id`` of the library; ``items``: ``source_id, category,
    link`` of first pages plus ``has_next``. Positions are counted per reader and
    list.
    """
    lists = items.groupBy("source_id", "category").agg(F.count("*").alias("total"), F.bool_or("has_next").alias("more"))
    read = _items_read(shelf, items, progress).groupBy("user_id", "source_id", "category").agg(
        F.count_if(finished(F.col("ratio"))).alias("finished"),
        F.count_if(started(F.col("ratio")) & ~finished(F.col("ratio"))).alias("partial"))
    known = sources.select("source_id").distinct().withColumn("_known", F.lit(True))
    rows = (
        shelf.join(known, "source_id", "left").join(lists, ["source_id", "category"], "left")
        .join(read, ["user_id", "source_id", "category"], "left"))
    gone = F.col("_known").isNull()
    total = F.when(~gone, F.coalesce("total", F.lit(0)))
    note = F.when(gone, "source_gone").when(total == 0, "list_empty").when(F.col("more"), "first_page_only").otherwise("")
    count = lambda c: F.when(gone, 0).otherwise(F.coalesce(c, F.lit(0))).cast("bigint")
    return rows.select("user_id", "source_id", "category", "added_at", total.alias("total"), count("finished").alias("finished"),
                       count("partial").alias("partial"), note.alias("note"))


def playback_resume(positions: DataFrame) -> DataFrame:
    """Where playback starts again: ``kind, position, duration, completed``;
    null starts from the top."""
    p, d = F.col("position"), F.col("duration")
    audio = ~F.col("completed") & (p >= RESUME_MIN_SECONDS) & (d > 0) & (p < d * RESUME_MAX_RATIO) & (p < d - 1)
    video = (d > 0) & (p / d > STARTED) & (p / d < FINISHED)
    ok = F.when(F.col("kind") == "audio", audio).otherwise(F.when(d > 0, video))
    return positions.withColumn("resume_at", F.when(ok, F.least(p, d)))


def retain_newest(articles: DataFrame, n: int = CACHE_KEPT) -> tuple[DataFrame, DataFrame]:
    """The newest ``n`` cached articles of each cache, and entries and bytes held.

    ``articles``: ``cache_id, key, body, cached_at``. Ranking moves only keys and
    times; bodies are fetched for the rows that stay.
    """
    keys = articles.select("cache_id", "key", "cached_at", F.octet_length("body").alias("size"))
    kept = top_per_group(keys, ["cache_id"], [F.col("cached_at").desc(), F.col("key")], n, ["key"]).drop("_rank")
    stats = kept.groupBy("cache_id").agg(F.count("*").alias("entries"), F.sum("size").cast("bigint").alias("bytes"))
    return articles.join(kept.select("cache_id", "key"), ["cache_id", "key"], "left_semi"), stats
