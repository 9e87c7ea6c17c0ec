"""Media, images, audio, subtitles and lyric files of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.urls import absolute_url, is_audio_url
from pageloom.operators.nodes import page_texts
from pageloom.operators.select import node_text

# --- fixed values -----------------------------------------------------------
MEDIA_TAGS = ["video", "audio", "source", "img"]
MEDIA_ATTRIBUTES = ["src", "data-src", "data-original", "poster"]
IMAGE_ATTRIBUTES = ["data-src", "src", "data-original"]
SUBTITLE_KINDS = ["", "subtitles", "captions"]
DEFAULT_SUBTITLE_LABEL = "字幕"
LYRIC_KEY_EXTENSIONS = r"(?i)\.(lrc|mp3|flac|m4a|aac|wav|ogg|opus)$"
# ---------------------------------------------------------------------------


def _attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def _usable_media(nodes: DataFrame) -> DataFrame:
    """Media elements with their first usable address, in catalogue order."""
    values = [F.when((F.trim(_attr(a)) != "") & ~_attr(a).startswith("data:"), _attr(a)) for a in MEDIA_ATTRIBUTES]
    kind = F.array_position(F.array(*[F.lit(t) for t in MEDIA_TAGS]), F.col("tag"))
    rows = nodes.filter(F.col("tag").isin(MEDIA_TAGS))
    return rows.select("page_id", "tag", F.coalesce(*values).alias("raw"), F.struct(kind, "node_id").alias("ord")).filter("raw is not null")


def _once(rows: DataFrame) -> DataFrame:
    """Each address once per page, where it first appeared."""
    return rows.groupBy("page_id", "media_url").agg(F.min("ord").alias("ord"), F.min_by("tag", "ord").alias("tag"))


def media_catalog(nodes: DataFrame) -> DataFrame:
    """playable and viewable addresses of a page that are absolute as written."""
    rows = _usable_media(nodes).filter(F.col("raw").rlike("^(https?:)?//")).withColumnRenamed("raw", "media_url")
    return _once(rows).select("page_id", "tag", "media_url")


def image_catalog(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """images of a page, lazy addresses first, resolved and unique."""
    raw = F.coalesce(*[F.nullif(_attr(a), F.lit("")) for a in IMAGE_ATTRIBUTES])
    rows = nodes.filter(F.col("tag") == "img").select("page_id", "tag", raw.alias("raw"), F.struct("node_id").alias("ord"))
    rows = rows.filter(~F.col("raw").startswith("data:")).join(pages.select("page_id", "url"), "page_id")
    return _once(rows.withColumn("media_url", absolute_url(F.col("raw"), F.col("url")))).select(
        "page_id", F.col("media_url").alias("image_url"))


def audio_catalog(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """directly playable audio of a page, resolved and unique."""
    rows = _usable_media(nodes).join(pages.select("page_id", "url"), "page_id")
    rows = rows.withColumn("media_url", absolute_url(F.col("raw"), F.col("url")))
    rows = rows.filter(is_audio_url(F.col("media_url")) & F.col("media_url").rlike("^(https?:)?//"))
    return _once(rows).select("page_id", F.col("media_url").alias("audio_url"), F.col("ord"))


def page_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Every anchor with its resolved address and text."""
    a = nodes.filter((F.col("tag") == "a") & (_attr("href") != ""))
    a = a.select("page_id", "node_id", _attr("href").alias("href"), "t_from", "t_to").join(page_texts(nodes), "page_id")
    a = a.withColumn("text", node_text(F.col("t_from"), F.col("t_to"), F.col("doc_text"))).drop("doc_text")
    a = a.join(pages.select("page_id", "url"), "page_id")
    return a.select("page_id", "node_id", absolute_url(F.col("href"), F.col("url")).alias("link_url"), "text")


def track_titles(audio: DataFrame, links: DataFrame) -> DataFrame:
    """F8: audio files named by the text of the last anchor with the same address."""
    named = links.groupBy("page_id", F.col("link_url").alias("audio_url")).agg(F.max_by("text", "node_id").alias("track_title"))
    return audio.join(named, ["page_id", "audio_url"], "left").select(
        "page_id", "audio_url", F.coalesce("track_title", F.lit("")).alias("track_title"))


def subtitle_catalog(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """subtitle and caption tracks, each address once."""
    rows = nodes.filter((F.col("tag") == "track") & F.lower(_attr("kind")).isin(SUBTITLE_KINDS) & (_attr("src") != ""))
    lang = F.coalesce(F.nullif(_attr("srclang"), F.lit("")), _attr("lang"))
    label = F.coalesce(F.nullif(_attr("label"), F.lit("")), F.nullif(lang, F.lit("")), F.lit(DEFAULT_SUBTITLE_LABEL))
    rows = rows.select("page_id", "node_id", _attr("src").alias("src"), label.alias("label"), lang.alias("lang"),
                       F.col("attrs")["default"].isNotNull().alias("is_default")).join(pages.select("page_id", "url"), "page_id")
    rows = rows.withColumn("subtitle_url", absolute_url(F.col("src"), F.col("url")))
    return rows.groupBy("page_id", "subtitle_url").agg(
        F.min_by(F.struct("label", "lang", "is_default"), "node_id").alias("w")).select("page_id", "subtitle_url", "w.*")


def lyric_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Lyric files a page links to: ``page_id, node_id, lyric_url``."""
    raw = F.coalesce(F.col("attrs")["data-lrc"], F.when(
        (F.col("tag") == "a") | ((F.col("tag") == "link") & (_attr("rel") == "lyrics")), F.col("attrs")["href"]))
    rows = nodes.select("page_id", "node_id", raw.alias("raw")).filter((F.col("raw") != "") & ~F.col("raw").startswith("data:"))
    rows = rows.join(pages.select("page_id", "url"), "page_id").withColumn("lyric_url", absolute_url(F.col("raw"), F.col("url")))
    rows = rows.filter(F.col("lyric_url").rlike(r"(?i)\.lrc(\?|#|$)"))
    return rows.groupBy("page_id", "lyric_url").agg(F.min("node_id").alias("node_id"))


def lyric_key(url: Column) -> Column:
    """``song-01.mp3`` to ``song01``, so a link and a track can be compared."""
    name = F.element_at(F.split(F.regexp_extract(url, r"^([^?#]*)", 1), "/"), -1)
    return F.regexp_replace(F.lower(F.regexp_replace(name, LYRIC_KEY_EXTENSIONS, "")), "[^a-z0-9一-龥]", "")


def pair_lyrics(tracks: DataFrame, links: DataFrame) -> DataFrame:
    """tracks with their lyric file by name; a page's only file serves its only track.

    ``tracks``: ``page_id, audio_url``; ``links``: ``page_id, node_id, lyric_url``.
    """
    by_key = links.groupBy("page_id", lyric_key(F.col("lyric_url")).alias("_key")).agg(F.max_by("lyric_url", "node_id").alias("_named"))
    only_file = links.groupBy("page_id").agg(F.count("*").alias("_files"), F.max("lyric_url").alias("_file"))
    only_track = tracks.groupBy("page_id").agg(F.count("*").alias("_tracks"))
    rows = tracks.withColumn("_key", lyric_key(F.col("audio_url"))).join(by_key, ["page_id", "_key"], "left")
    rows = rows.join(only_file, "page_id", "left").join(only_track, "page_id")
    alone = F.when((F.col("_files") == 1) & (F.col("_tracks") == 1), F.col("_file"))
    return rows.select("page_id", "audio_url", F.coalesce("_named", alone).alias("lyric_url"))
