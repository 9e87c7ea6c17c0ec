"""Timed lyric lines and the line showing at a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
STAMP = r"\[(\d{1,3}):(\d{1,2})(?:[.:](\d{1,3}))?\]"
PLAIN_STAMP = r"\[\d{1,3}:\d{1,2}(?:[.:]\d{1,3})?\]"
METADATA = r"(?i)^\[(ti|ar|al|by|offset|re|ve|length):"
OFFSET_LIMIT_MS = 5000
# ---------------------------------------------------------------------------
BUCKET_MS = 30_000


def lrc_lines(files: DataFrame, text: str = "raw") -> DataFrame:
    """Whole lyric files to one row per line: ``… , line_no, raw_line``."""
    keep = [c for c in files.columns if c != text]
    return files.select(*keep, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line_no", "raw_line"))


def parse_lrc(lines: DataFrame) -> DataFrame:
    """``track_id, line_no, stamp_no, t_ms, text``; one row per leading stamp.

    Metadata and unstamped lines are dropped, empty text is kept. Times are whole
    milliseconds: a fraction has at most three digits.
    """
    line = F.trim(F.col("raw_line"))
    lead = F.regexp_extract(line, rf"^(?:{PLAIN_STAMP})+", 0)
    rows = lines.select("track_id", "line_no", line.alias("line"), lead.alias("lead"))
    rows = rows.filter((F.col("lead") != "") & ~F.col("line").rlike(METADATA))
    rows = rows.select(
        "track_id", "line_no", F.trim(F.substr("line", F.length("lead") + 1)).alias("text"),
        F.posexplode(F.regexp_extract_all("lead", F.lit(f"({PLAIN_STAMP})"), F.lit(1))).alias("stamp_no", "stamp"))
    part = lambda i: F.regexp_extract("stamp", STAMP, i)
    whole = (part(1).cast("bigint") * 60 + part(2).cast("bigint")) * 1000
    fraction = F.rpad(part(3), 3, "0").cast("bigint")
    return rows.select("track_id", "line_no", "stamp_no", (whole + fraction).alias("t_ms"), "text")


def lrc_offset(lines: DataFrame) -> DataFrame:
    """F16: the first ``[offset:±n]`` of each file in milliseconds."""
    n = F.regexp_extract("raw_line", r"(?i)^\s*\[offset:\s*([+-]?\d+)\s*\]", 1).try_cast("bigint")
    rows = lines.select("track_id", "line_no", n.alias("file_ms")).filter("file_ms is not null")
    return rows.groupBy("track_id").agg(F.min_by("file_ms", "line_no").alias("file_ms"))


def clamp_offset(ms: Column) -> Column:
    return F.greatest(F.lit(-OFFSET_LIMIT_MS), F.least(F.lit(OFFSET_LIMIT_MS), ms))


def effective_offset(tracks: DataFrame, song: DataFrame, source: DataFrame, files: DataFrame) -> DataFrame:
    """the offset of each track: its own, else its source's, else the file's, else 0.

    ``tracks``: ``track_id, source_id``; ``song``: ``track_id, song_ms``;
    ``source``: ``source_id, source_ms``; ``files``: ``track_id, file_ms``.
    """
    rows = tracks.join(song, "track_id", "left").join(source, "source_id", "left").join(files, "track_id", "left")
    return rows.select("track_id", clamp_offset(F.coalesce("song_ms", "source_ms", "file_ms", F.lit(0))).cast("bigint").alias("offset_ms"))


def lyric_at(lines: DataFrame, positions: DataFrame, offsets: DataFrame) -> DataFrame:
    """the line showing at each position (an as-of join).

    ``positions``: ``pos_id, track_id, position`` in seconds. Line times are whole
    milliseconds, so a position only matters to the millisecond: equal
    ``(track, millisecond)`` pairs are answered once and joined back. Answers are
    found in buckets of 30 seconds, which hold at most 30,000 distinct
    milliseconds of each kind however popular the track is; what a bucket inherits
    from earlier ones comes from one row per bucket.
    """
    asked = positions.join(offsets, "track_id", "left")
    at_ms = F.floor(F.col("position") * 1000 + 1e-6) - clamp_offset(F.coalesce("offset_ms", F.lit(0)))
    asked = asked.select("pos_id", "track_id", "position", at_ms.cast("bigint").alias("t_ms"))
    said = lines.groupBy("track_id", "t_ms").agg(F.max_by(F.struct("t_ms", "text"), F.struct("line_no", "stamp_no")).alias("line"))
    points = asked.select("track_id", "t_ms").distinct().withColumn("line", F.lit(None).cast(said.schema["line"].dataType))
    points = points.unionByName(said).groupBy("track_id", "t_ms").agg(F.max("line").alias("line"))
    points = points.withColumn("bucket", F.floor(F.col("t_ms") / BUCKET_MS))
    last_of = points.groupBy("track_id", "bucket").agg(F.max("line").alias("last"))
    before = Window.partitionBy("track_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inherited = last_of.withColumn("inherited", F.last("last", ignorenulls=True).over(before)).select("track_id", "bucket", "inherited")
    so_far = Window.partitionBy("track_id", "bucket").orderBy("t_ms").rowsBetween(Window.unboundedPreceding, 0)
    answers = points.withColumn("here", F.last("line", ignorenulls=True).over(so_far)).join(inherited, ["track_id", "bucket"])
    answers = answers.select("track_id", "t_ms", F.coalesce("here", "inherited").alias("answer"))
    return asked.join(answers, ["track_id", "t_ms"], "left").select(
        "pos_id", "track_id", "position", F.col("answer.t_ms").alias("line_ms"), F.col("answer.text").alias("line_text"))
