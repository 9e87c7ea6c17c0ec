"""Highlights, notes, shelf, clearing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.hashing import highlight_id
from pageloom.functions.text import SPACE, strip
from pageloom.operators.common import contains_any, first_per_key, join_skewed
from pageloom.session import materialize

# --- fixed values -----------------------------------------------------------
MAX_PASSAGE_CHARS = 2000
# ---------------------------------------------------------------------------


def add_highlights(highlights: DataFrame, incoming: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Highlights after an import, and the rejected rows with a reason.

    Identity is reader, address and trimmed passage; the stored row or the first
    of the batch wins. Ids come from the identity (H13).
    """
    rows = incoming.withColumn("text", strip(F.col("text")))
    reason = F.when(F.col("text") == "", "empty").when(F.length("text") > MAX_PASSAGE_CHARS, "too_long")
    rejects = rows.withColumn("reason", reason).filter("reason is not null")
    good = rows.filter(reason.isNull())
    first = first_per_key(good, ["user_id", "url", "text"], [F.col(order)])
    known = highlights.select("user_id", "url", "text")
    fresh = first.join(known, ["user_id", "url", "text"], "left_anti")
    # Ids cost a turn for each byte and highlights are read several times (H15, H17, H18): written once.
    fresh = materialize(fresh.withColumn("id", highlight_id(F.col("url"), F.col("text"))), "highlights")
    return highlights.unionByName(fresh.select(*highlights.columns)), rejects


def update_notes(highlights: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes set, replaced or cleared by id, and the notes that found no
    highlight or are too long. ``notes``: ``user_id, id, new_note``."""
    cleaned = notes.withColumn("new_note", strip(F.coalesce("new_note", F.lit(""))))
    fit = cleaned.filter(F.length("new_note") <= MAX_PASSAGE_CHARS)
    unknown = fit.join(highlights, ["user_id", "id"], "left_anti").withColumn("reason", F.lit("unknown"))
    long = cleaned.filter(F.length("new_note") > MAX_PASSAGE_CHARS).withColumn("reason", F.lit("too_long"))
    rows = highlights.join(fit.select("user_id", "id", "new_note"), ["user_id", "id"], "left")
    done = rows.withColumn("note", F.coalesce("new_note", "note")).select(*highlights.columns)
    return done, unknown.unionByName(long)


def search_highlights(highlights: DataFrame, text: str = "", only_notes: bool = False) -> DataFrame:
    """Highlights whose passage, note, title or source contains the text."""
    rows = highlights.filter(contains_any(["text", "note", "title", "source_name"], text))
    return rows.filter(F.col("note") != "") if only_notes else rows


def highlight_totals(highlights: DataFrame, text: str = "", only_notes: bool = False) -> DataFrame:
    """Per reader all highlights, those with a note, and those shown."""
    shown = contains_any(["text", "note", "title", "source_name"], text)
    if only_notes:
        shown = shown & (F.col("note") != "")
    return highlights.groupBy("user_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("note") != "").alias("noted"), F.count_if(shown).alias("shown"))


def list_highlights(highlights: DataFrame, url: str | None = None) -> DataFrame:
    """All of them newest first, or those of one article in the order made."""
    if url is None:
        return highlights.orderBy("user_id", F.col("created_s").desc(), "id")
    return highlights.filter(F.col("url") == url).orderBy("user_id", "created_s", "id")


def locate_highlights(highlights: DataFrame, articles: DataFrame) -> DataFrame:
    """How often each passage occurs in its article, white space ignored.

    ``articles``: ``url, article_text``. Occurrences do not overlap; 0 is valid.
    The white space of an article is removed once, before the join.
    """
    bare = lambda c: F.regexp_replace(c, rf"[{SPACE}\x{{FEFF}}]+", "")
    flat = articles.select("url", bare(F.col("article_text")).alias("_flat"))
    rows = join_skewed(highlights.withColumn("_needle", bare(F.col("text"))), flat, ["url"], "left")
    count = F.floor((F.length("_flat") - F.length(F.replace("_flat", F.col("_needle"), F.lit("")))) / F.length("_needle"))
    found = F.when((F.col("_needle") == "") | F.col("_flat").isNull(), 0).otherwise(count).cast("bigint")
    return rows.withColumn("occurrences", found).drop("_flat", "_needle")


SLICES = 256


def add_shelf(shelf: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Shelf after additions; an entry already there stays as it is.

    Each new stamp is at least one second past every stamp before it, so with
    rank ``i`` in batch order it is ``i + max(running max of stamp - i, newest
    stored)``. Ranks and running maxima are taken inside slices of the batch
    order first and carried over one row per reader and slice, so no reader's
    additions have to meet in one task. ``added_s`` is in whole seconds and
    ``order`` a whole number.
    """
    first = first_per_key(incoming, ["user_id", "id"], [F.col(order)])
    # Read four times below.
    fresh = materialize(first.join(shelf.select("user_id", "id"), ["user_id", "id"], "left_anti"), "shelf_additions")
    span = fresh.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    fresh = fresh.crossJoin(F.broadcast(span))  # the span is one row
    fresh = fresh.withColumn("_slice", F.floor((F.col(order) - F.col("_lo")) * SLICES / (F.col("_hi") - F.col("_lo") + 1)))
    inside = Window.partitionBy("user_id", "_slice").orderBy(order)
    fresh = fresh.withColumn("_i", F.row_number().over(inside))
    so_far = F.max(F.col("added_s") - F.col("_i")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    fresh = fresh.withColumn("_run", so_far)
    per = fresh.groupBy("user_id", "_slice").agg(F.count("*").alias("_n"), F.max(F.col("added_s") - F.col("_i")).alias("_m"))
    earlier = Window.partitionBy("user_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    per = per.withColumn("_carry", F.max(F.col("_m") - F.col("_before")).over(earlier))
    top = shelf.groupBy("user_id").agg(F.max("added_s").alias("_top"))
    rows = fresh.join(per.select("user_id", "_slice", "_before", "_carry"), ["user_id", "_slice"]).join(top, "user_id", "left")
    running = F.greatest(F.col("_run") - F.col("_before"), F.col("_carry"), F.coalesce("_top", F.lit(0)))
    rows = rows.withColumn("added_s", F.col("_before") + F.col("_i") + running)
    return shelf.unionByName(rows.select(*shelf.columns))


def list_shelf(shelf: DataFrame) -> DataFrame:
    """Newest first."""
    return shelf.orderBy("user_id", F.col("added_s").desc(), "id")


def remove_shelf(shelf: DataFrame, ids: DataFrame) -> DataFrame:
    """The shelf without the given entries."""
    return shelf.join(ids, ["user_id", "id"], "left_anti")


def on_shelf(ids: DataFrame, shelf: DataFrame) -> DataFrame:
    """The given entries that are on the shelf."""
    return ids.join(shelf.select("user_id", "id"), ["user_id", "id"], "left_semi")


def clear_history(history: DataFrame, progress: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """History and positions without those of the given readers."""
    return history.join(users, "user_id", "left_anti"), progress.join(users, "user_id", "left_anti")
