"""Histories, positions, highlights, shelves, lyrics: expected values by hand or brute force."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pageloom.operators import audit, common, library, lyrics, marks, reading
from pageloom.operators.common import first_per_key, top_per_group

H = "user_id long, url string, source_id string, source_name string, title string, viewed_at timestamp_ntz"
P = "user_id long, url string, ratio float, updated_at timestamp_ntz"


def at(text):
    return dt.datetime.fromisoformat(text)


def record(url, viewed, source="s1", name="S1"):
    return (1, url, source, name, "t " + url, at(viewed))


def stats(spark, history, progress, now, tz="UTC"):
    h = spark.createDataFrame(history, H)
    p = spark.createDataFrame(progress, P)
    return reading.reading_stats(h, p, F.lit(now).cast("timestamp_ntz"), tz).first()


def test_periods(spark):
    """Wednesday: three articles today, one the night before last week, caps and gaps."""
    history = [record("a", "2024-01-17 09:00"), record("b", "2024-01-17 10:00"), record("c", "2024-01-17 11:00"), record("d", "2024-01-14 10:00"),
               record("e", "2024-01-15 08:00")]
    progress = [(1, "a", 0.5, at("2024-01-17 09:10")), (1, "b", 1.0, at("2024-01-17 18:00")), (1, "d", 0.1, at("2024-01-14 09:50")),
                (1, "e", 0.1, at("2024-01-15 08:00"))]
    r = stats(spark, history, progress, "2024-01-17 20:00")
    assert (r["today_articles"], r["today_minutes"]) == (3, 40)
    assert (r["week_articles"], r["week_minutes"]) == (4, 40)
    assert (r["all_articles"], r["all_minutes"]) == (5, 50)


def test_midnight_is_split(spark):
    r = stats(spark, [record("a", "2024-01-16 23:50")], [(1, "a", 0.5, at("2024-01-17 00:10"))], "2024-01-17 12:00")
    assert (r["today_minutes"], r["all_minutes"], r["today_articles"]) == (10, 20, 0)


def test_days_are_the_readers(spark):
    """15:50 UTC is ten to midnight in Shanghai."""
    history, progress = [record("a", "2024-01-16 15:50")], [(1, "a", 0.5, at("2024-01-16 16:10"))]
    assert stats(spark, history, progress, "2024-01-16 17:00", "Asia/Shanghai")["today_minutes"] == 10
    assert stats(spark, history, progress, "2024-01-16 17:00")["today_minutes"] == 20


def test_clock_change_costs_nothing(spark):
    """Cairo skips from midnight to one o'clock on 2023-04-28; twenty minutes stay twenty."""
    history, progress = [record("a", "2023-04-27 21:50")], [(1, "a", 0.5, at("2023-04-27 22:10"))]
    days = reading.daily_reading(spark.createDataFrame(history, H), spark.createDataFrame(progress, P), "Africa/Cairo").collect()
    assert {str(d["day"]): d["secs"] for d in days} == {"2023-04-27": 600, "2023-04-28": 600}


def test_results_do_not_depend_on_the_session_zone(spark):
    history = [record(str(i), f"2024-03-{9 + i % 3:02d} {i % 24:02d}:{i * 7 % 60:02d}") for i in range(60)]
    progress = [(1, str(i), 0.5, h[5] + dt.timedelta(minutes=i)) for i, h in enumerate(history)]

    def run():
        days = reading.daily_reading(spark.createDataFrame(history, H), spark.createDataFrame(progress, P), "Europe/Berlin")
        return sorted((str(d["day"]), d["articles"], d["secs"]) for d in days.collect())

    want = run()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert run() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_top_sources_use_the_name_where_there_is_no_id(spark):
    rows = [record("a", "2024-01-01 00:00", "", "B"), record("b", "2024-01-01 00:00", "", "B"), record("c", "2024-01-01 00:00", "x", "A"),
            record("d", "2024-01-01 00:00", "y", "C"), record("e", "2024-01-01 00:00", "y", "")]
    got = [(r["source_key"], r["articles"], r["source_name"]) for r in reading.top_sources(spark.createDataFrame(rows, H)).collect()]
    assert got == [("B", 2, "B"), ("y", 2, "C"), ("x", 1, "A")]


def test_top_per_group_is_exact_on_a_hot_group(spark):
    rnd = random.Random(1)
    rows = [(0 if i % 3 else rnd.randrange(5), rnd.randrange(1000), i) for i in range(6000)]
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "g int, v int, id int")
    for r in top_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 37, ["id"]).collect():
        got[r["g"]].append((r["_rank"], r["id"]))
    for g in range(5):
        want = [i for _, i in sorted((-v, i) for k, v, i in rows if k == g)[:37]]
        assert [i for _, i in sorted(got[g])] == want


def test_first_per_key_keeps_whole_rows_with_nulls(spark):
    df = spark.createDataFrame([(1, None, 2), (1, "b", 1), (2, None, 5)], "k int, v string, o int")
    assert sorted(map(tuple, first_per_key(df, ["k"], [F.col("o")]).collect())) == [(1, "b", 1), (2, None, 5)]


def test_history_keeps_the_newest_of_each_address(spark):
    rows = [(1, f"u{i % 7}", at("2024-01-01 00:00") + dt.timedelta(minutes=i), i) for i in range(50)]
    df = spark.createDataFrame(rows, "user_id long, url string, viewed_at timestamp_ntz, event_id long")
    got = reading.record_history(df.filter("event_id < 20"), df.filter("event_id >= 20"), keep=3).collect()
    assert sorted(r["event_id"] for r in got) == [47, 48, 49]


def test_positions_are_clamped_and_late_ones_lose(spark):
    e = "user_id long, url string, ratio_raw double, updated_at timestamp_ntz, event_id long"
    events = spark.createDataFrame([(1, "a", 1.4, at("2024-01-02"), 1), (1, "b", -0.2, at("2024-01-01"), 2)], e)
    stored = spark.createDataFrame([(1, "b", 0.5, at("2024-01-03"))], P)
    got = {r["url"]: round(r["ratio"], 2) for r in reading.upsert_progress(stored, events).collect()}
    assert got == {"a": 1.0, "b": 0.5}


def test_continue_reading_thresholds(spark):
    ratios = {"a": 0.02, "b": 0.021, "c": 0.97, "d": 0.98, "e": 1.0}
    history = [record(u, f"2024-01-01 0{i}:00") for i, u in enumerate(ratios)]
    progress = [(1, u, r, at("2024-01-02")) for u, r in ratios.items()]
    got = reading.continue_reading(spark.createDataFrame(history, H), spark.createDataFrame(progress, P)).orderBy("rank").collect()
    assert [r["url"] for r in got] == ["c", "b"]


def test_playback(spark):
    rows = [("audio", 9.9, 100.0, False), ("audio", 10.0, 100.0, False), ("audio", 95.0, 100.0, False), ("audio", 50.0, 100.0, True), ("audio", 11.2, 12.0, False),
            ("video", 2.0, 100.0, False), ("video", 3.0, 100.0, False), ("video", 98.0, 100.0, False), ("video", 1.0, 0.0, False)]
    df = spark.createDataFrame(rows, "kind string, position double, duration double, completed boolean")
    assert [r["resume_at"] for r in reading.playback_resume(df).collect()] == [None, 10.0, None, None, None, None, 3.0, None, None]


def test_shelf_progress_notes(spark):
    shelf = spark.createDataFrame([(1, s, "all", at("2024-01-01")) for s in ("gone", "empty", "long", "short")],
                                  "user_id long, source_id string, category string, added_at timestamp_ntz")
    sources = spark.createDataFrame([("empty",), ("long",), ("short",)], "source_id string")
    items = spark.createDataFrame([("long", "all", f"l{i}", True) for i in range(3)] + [("short", "all", "s0", False)],
                                  "source_id string, category string, link string, has_next boolean")
    progress = spark.createDataFrame([(1, "l0", 0.98, at("2024-01-01")), (1, "l1", 0.5, at("2024-01-01")), (2, "l2", 1.0, at("2024-01-01"))], P)
    got = {r["source_id"]: (r["total"], r["finished"], r["partial"], r["note"]) for r in reading.shelf_progress(shelf, sources, items, progress).collect()}
    assert got == {"gone": (None, 0, 0, "source_gone"), "empty": (0, 0, 0, "list_empty"), "long": (3, 1, 1, "first_page_only"), "short": (1, 0, 0, "")}


def test_skewed_join_against_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_SHARE", 4)
    monkeypatch.setattr(common, "SPLITS", 5)
    rnd = random.Random(2)
    left = spark.createDataFrame([(0 if i % 5 else rnd.randrange(9), rnd.choice("ab"), i // 3) for i in range(400)], "k int, c string, x int")
    right = spark.createDataFrame([(k, c, f"{k}{c}{i}") for k in range(7) for c in "ab" for i in range(k % 3)] + [(0, "a", "z"), (0, "b", "z")], "k int, c string, y string")
    for how in ("inner", "left"):
        got, want = common.join_skewed(left, right, ["k", "c"], how), left.join(right, ["k", "c"], how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_shelf_progress_with_a_link_on_every_list(spark, monkeypatch):
    """The banner stands in every list, and one list is on every shelf."""
    monkeypatch.setattr(common, "HEAVY_SHARE", 10)
    rnd = random.Random(9)
    links = [(f"s{i}", "all", link, False) for i in range(20) for link in ("banner", f"l{i}a", f"l{i % 4}b")]
    shelf = [(u, f"s{s}", "all", at("2024-01-01")) for u in range(6) for s in {0, *rnd.sample(range(20), 5)}]
    seen = [(u, link, rnd.choice([0.01, 0.5, 1.0]), at("2024-01-01")) for u in range(6) for link in {x[2] for x in links} if rnd.random() < 0.6]
    ratio = {(u, link): r for u, link, r, _ in seen}
    out = reading.shelf_progress(
        spark.createDataFrame(shelf, "user_id long, source_id string, category string, added_at timestamp_ntz"),
        spark.createDataFrame([(f"s{i}",) for i in range(20)], "source_id string"),
        spark.createDataFrame(links, "source_id string, category string, link string, has_next boolean"), spark.createDataFrame(seen, P)).collect()
    assert len(out) == len(shelf)
    for r in out:
        got = [ratio.get((r["user_id"], link), 0) for s, _, link, _ in links if s == r["source_id"]]
        assert (r["total"], r["finished"], r["partial"]) == (3, sum(x >= 0.98 for x in got), sum(0.02 < x < 0.98 for x in got))


def test_shelf_stamps_are_strict(spark):
    rnd = random.Random(3)
    stored = [(u, f"k{u}", 1000 + u) for u in range(3)]
    adds = [(0 if i % 3 else rnd.randrange(3), f"k{rnd.randrange(90)}", i, rnd.randrange(900, 1100)) for i in range(700)]
    want = {(u, k): s for u, k, s in stored}
    for u, k, _, s in adds:
        if (u, k) not in want:
            newest = max(v for (w, _), v in want.items() if w == u)
            want[(u, k)] = max(s, newest + 1)
    shelf = marks.add_shelf(spark.createDataFrame(stored, "user_id long, id string, added_s long"),
                            spark.createDataFrame(adds, "user_id long, id string, ord long, added_s long"), "ord")
    assert {(r["user_id"], r["id"]): r["added_s"] for r in shelf.collect()} == want


def test_highlights(spark):
    stored = spark.createDataFrame([(1, "h0", "u", "t", "s", "kept", "n", 1)],
                                   "user_id long, id string, url string, title string, source_name string, text string, note string, created_s long")
    new = [(1, "u", " kept ", 2), (1, "u", "x", 3), (1, "u", " x", 4), (1, "u", "  ", 5), (1, "v", "y" * 2001, 6), (2, "u", "kept", 7)]
    batch = spark.createDataFrame([(u, url, "t", "s", text, "", n) for u, url, text, n in new],
                                  "user_id long, url string, title string, source_name string, text string, note string, created_s long")
    added, rejects = marks.add_highlights(stored, batch, "created_s")
    assert sorted((r["user_id"], r["text"], r["created_s"]) for r in added.collect()) == [(1, "kept", 1), (1, "x", 3), (2, "kept", 7)]
    assert sorted(r["reason"] for r in rejects.collect()) == ["empty", "too_long"]
    notes = spark.createDataFrame([(1, "h0", " "), (1, "h?", "n"), (1, "h0x", "z" * 2001)], "user_id long, id string, new_note string")
    done, bad = marks.update_notes(stored, notes)
    assert [r["note"] for r in done.collect()] == [""] and sorted(r["reason"] for r in bad.collect()) == ["too_long", "unknown"]


def test_passages_are_found_across_white_space(spark):
    hl = spark.createDataFrame([(1, "u", "a b"), (2, "u", "zz"), (3, "u", " "), (4, "gone", "a"), (5, "u", "aa")], "n int, url string, text string")
    articles = spark.createDataFrame([("u", "xa\n b, A B a　b aaa")], "url string, article_text string")
    got = {r["n"]: r["occurrences"] for r in marks.locate_highlights(hl, articles).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 0, 5: 1}


LRC = "[ti:x]\r\n[offset: +500 ]\n[00:01.5][00:03:05]one\n[00:02]\nplain\n [00:10.123] t [00:11] \r[100:00.00]late"


def test_lyric_files(spark):
    lines = lyrics.lrc_lines(spark.createDataFrame([(7, LRC)], "track_id long, raw string"))
    got = sorted((r["t_ms"], r["text"]) for r in lyrics.parse_lrc(lines).collect())
    assert got == [(1500, "one"), (2000, ""), (3050, "one"), (10123, "t [00:11]"), (6000000, "late")]
    assert [r["file_ms"] for r in lyrics.lrc_offset(lines).collect()] == [500]


def test_lyric_at_against_brute_force(spark):
    """One track holds two thirds of all lines and positions; buckets are crossed and empty."""
    rnd = random.Random(5)
    lines = [(0 if i % 3 else rnd.randrange(1, 4), i, 0, rnd.randrange(0, 200_000) // 50 * 50, f"l{i}") for i in range(400)]
    positions = [(i, 0 if i % 3 else rnd.randrange(1, 5), rnd.randrange(-50, 3000) / 10) for i in range(1500)]
    offsets = [(0, 250), (1, -9000)]
    got = lyrics.lyric_at(
        spark.createDataFrame(lines, "track_id long, line_no int, stamp_no int, t_ms long, text string"),
        spark.createDataFrame(positions, "pos_id int, track_id long, position double"), spark.createDataFrame(offsets, "track_id long, offset_ms long")).collect()
    by_track = defaultdict(list)
    for track, no, _, t, text in lines:
        by_track[track].append((t, no, text))
    shift = {0: 250, 1: -5000}
    assert len(got) == len(positions)
    for r in got:
        now = round(r["position"] * 1000) - shift.get(r["track_id"], 0)
        seen = [x for x in by_track[r["track_id"]] if x[0] <= now]
        assert r["line_text"] == (max(seen)[2] if seen else None)


def test_categories(spark):
    s = spark.createDataFrame([("a", "https://a/", "All::/{{page}}$$$New::/n\n\nx\nS::/q?a::b\n ::/d"), ("b", "https://b/{{page}}", "")],
                              "source_id string, source_url string, sort_url string")
    got = sorted((r["source_id"], r["row"], r["name"], r["category_url"], r["paged"]) for r in library.explode_categories(s).collect())
    assert got == [("a", 0, "All", "/{{page}}", True), ("a", 1, "New", "/n", False), ("a", 300, "S::/q?a", "b", False), ("a", 400, "默认", "/d", False),
                   ("b", 0, "首页", "https://b/{{page}}", True)]


def test_equal_hash_prefixes_get_suffixes(spark, monkeypatch):
    monkeypatch.setattr(library, "source_id", lambda name, url: F.lit("same"))
    lib = spark.createDataFrame([("same", "L", "u")], "source_id string, source_name string, source_url string")
    new = spark.createDataFrame([("A", "u", 1), ("B", "u", 2), ("A ", "u", 3), ("L", "u", 4)], "source_name string, source_url string, pos int")
    merged, counts = library.merge_sources(lib, new, "c", F.lit(0), "pos")
    ids = [r["source_id"] for r in merged.collect()]
    assert len(ids) == len(set(ids)) == 3 and tuple(counts.first()) == (2, 2)


def test_audit_verdicts(spark):
    stages = [("a", "list", "warn", "thin"), ("a", "homepage", "fail", "HTTP 403"), ("b", "rule", "ok", ""), ("b", "search", "skip", ""), ("c", "list", "fail", "Connection reset"),
              ("d", "list", "warn", "no links"), ("e", "detail", "fail", "x")]
    s = spark.createDataFrame(stages, "source_id string, key string, state string, detail string")
    facts = spark.createDataFrame([("a", 3, 3, False), ("b", 0, 0, True), ("c", 1, 1, False), ("d", 4, 0, False), ("e", 0, 1, True)],
                                  "source_id string, item_count long, usable long, single_page boolean")
    health = {r["source_id"]: (r["ok"], r["status"]) for r in audit.summarize_health(s, facts.drop("single_page"), ["source_id"]).collect()}
    assert health["a"] == (False, "homepage: HTTP 403") and health["b"] == (False, "ok: 0 items") and health["d"] == (False, "list: no links")
    buckets = {r["source_id"]: r["bucket"] for r in audit.failure_bucket(s, facts, ["source_id"]).collect()}
    assert buckets == {"a": "degraded", "b": "working", "c": "unreachable", "d": "rule-broken", "e": "rule-broken"}


@pytest.mark.parametrize("rule,names", [
    ("class.update_area_lists@tag.li", ["update_area_lists"]), ("#main.big@text.x", ["main", "big"]), ("tag.div", []), ("id.a-b@class.a-b", ["a-b"]),
])
def test_container_names(one, rule, names):
    assert one(audit.container_names(F.lit(rule))) == names


def test_pass_rate_reconciles(spark):
    rows = [("working", True, False)] * 99 + [("rule-broken", True, True)] * 13 + [("degraded", False, False)]
    report = audit.pass_rate_report(spark.createDataFrame(rows, "bucket string, enable_js boolean, single_page boolean")).collect()
    assert {r["bucket"]: float(r["share"]) for r in report} == {"working": 87.6, "rule-broken": 11.5, "degraded": 0.9}
    assert all(r["reconciled"] and r["verified"] == 113 for r in report)
