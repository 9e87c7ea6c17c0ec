"""A drained stream leaves what the batch operator computes, replays included."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pageloom.operators.reading import daily_reading, upsert_progress
from pageloom.streaming import incremental as inc

E = "user_id long, url string, ratio_raw double, updated_at timestamp_ntz, event_id long"


def events(spark, n=200):
    base = dt.datetime(2024, 1, 1)
    rows = [(i % 5, f"u{i * 7 % 11}", i % 13 / 10, base + dt.timedelta(minutes=i * 37 % 97), i) for i in range(n)]
    return spark.createDataFrame(rows, E)


def rows_of(df):
    return sorted(map(tuple, df.select("user_id", "url", "ratio", "updated_at").collect()))


def test_stream_equals_batch_in_several_runs(spark, tmp_path):
    df = events(spark)
    source, target, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    for part in range(2):
        df.filter(F.col("event_id") % 2 == part).repartition(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        inc.stream_progress(stream, target, check, fold_every=3).awaitTermination()
    assert rows_of(inc.progress_table(spark, target).read()) == rows_of(upsert_progress(None, df))


def parts_of(df, n):
    """Batches of positions as the stream hands them to its table."""
    return [upsert_progress(None, df.filter(F.col("event_id") % n == i), with_event=True) for i in range(n)]


def test_a_replayed_batch_changes_nothing_and_another_stream_adds(spark, tmp_path):
    df, table = events(spark), inc.progress_table(spark, str(tmp_path / "t"))
    first, second, other = parts_of(df, 3)
    assert not table.exists()
    table.append(first, "a", 0)
    table.append(second, "a", 1)
    table.append(second, "a", 1)
    assert table.compact() and not table.compact()
    want = rows_of(upsert_progress(None, df.filter("event_id % 3 < 2")))
    assert rows_of(table.read()) == want
    table.append(second, "a", 1)  # after the fold: the base has it
    assert rows_of(table.read()) == want and not table.compact()
    table.append(other, "b", 0)
    assert rows_of(table.read()) == rows_of(upsert_progress(None, df)) == rows_of(table.read(range(64)))
    assert len(table.read([0]).collect()) < len(table.read().collect())


def test_a_fold_that_died_is_done_again(spark, tmp_path):
    df, table = events(spark), inc.progress_table(spark, str(tmp_path / "t"))
    for i, rows in enumerate(parts_of(df, 3)):
        table.append(rows, "a", i)
        if i == 0:
            table.compact()
    # A base without its list of batches, and a batch that was not written to its end.
    parts_of(df, 3)[0].write.parquet(str(tmp_path / "t/base/000000000001/rows"))
    parts_of(df, 3)[0].write.parquet(str(tmp_path / "t/log/a-000000000009"))
    (tmp_path / "t/log/a-000000000009/_SUCCESS").unlink()
    want = rows_of(upsert_progress(None, df))
    assert rows_of(table.read()) == want
    assert table.compact() and rows_of(table.read()) == want


def size_of(folder):
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


def test_storage_stays_bounded_and_a_batch_writes_its_own_rows_only(spark, tmp_path):
    table, folder = inc.progress_table(spark, str(tmp_path / "t")), tmp_path / "t"
    rows = upsert_progress(None, events(spark), with_event=True).cache()
    sizes = []
    for n in range(50):
        before = {p for p in folder.rglob("*.parquet")}
        table.append(rows.filter(F.col("user_id") == n % 5), "a", n)
        fresh = {p for p in folder.rglob("*.parquet")} - before
        assert all(p.parent.name == f"a-{n:012d}" for p in fresh)
        table.compact(8)
        sizes.append(size_of(folder))
    assert max(sizes[25:]) <= 1.1 * max(sizes[:25])
    assert len(list((folder / "log").iterdir())) <= 16 and len(list((folder / "base").iterdir())) <= 2
    assert rows_of(table.read()) == rows_of(rows)


def test_a_reader_that_began_before_a_fold_finds_its_files(spark, tmp_path):
    table = inc.progress_table(spark, str(tmp_path / "t"))
    first, second = parts_of(events(spark), 2)
    table.append(first, "a", 0)
    table.compact()
    table.append(second, "a", 1)
    begun = table.read()
    table.compact()
    assert rows_of(begun) == rows_of(table.read())


def test_ties_across_batches_go_to_the_later_event(spark, tmp_path):
    """Equal times: the order in which batches arrive does not matter."""
    at = dt.datetime(2024, 1, 1)
    for order in ([1, 2], [2, 1]):
        source, target, check = (str(tmp_path / f"{x}{order[0]}") for x in ("in", "out", "check"))
        for event in order:
            spark.createDataFrame([(1, "u", event / 10, at, event)], E).write.mode("append").parquet(source)
            inc.stream_progress(spark.readStream.schema(E).parquet(source), target, check).awaitTermination()
        assert [round(r.ratio, 3) for r in inc.progress_table(spark, target).read().collect()] == [0.2]


def test_readers_without_a_position_have_their_days(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 9)
    opened = spark.createDataFrame(
        [(1, "u", at, 1), (2, "u", at, 2)], "user_id long, url string, viewed_at timestamp_ntz, event_id long")
    opened.write.parquet(str(tmp_path / "opened"))
    events(spark, 0).union(spark.createDataFrame([(1, "u", 0.5, at + dt.timedelta(minutes=5), 1)], E)).write.parquet(str(tmp_path / "positions"))
    read = lambda name, like: spark.readStream.schema(like).parquet(str(tmp_path / name))
    tables = [str(tmp_path / x) for x in ("history", "progress", "daily")]
    inc.stream_reading_minutes(read("opened", opened.schema), read("positions", E), *tables, str(tmp_path / "check")).awaitTermination()
    got = inc.reading_tables(spark, *tables)[2].read().select("user_id", "articles", "secs").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 300), (2, 1, 0)]


def test_interleaved_arrivals_and_a_restart(spark, tmp_path):
    """Positions before and after what they belong to, over several runs of one job and one that goes on by a clock."""
    rnd, start = random.Random(6), dt.datetime(2024, 1, 1, 22)
    shown = [(u, f"u{i}", start + dt.timedelta(minutes=rnd.randrange(300)), 10 * u + i) for u in range(4) for i in range(6)]
    placed = [(u, url, rnd.random(), at + dt.timedelta(minutes=rnd.randrange(50)), 1000 + n) for n, (u, url, at, _) in enumerate(shown) if rnd.random() < 0.8]
    both = [("opened", r) for r in shown] + [("positions", r) for r in placed]
    rnd.shuffle(both)
    schemas = {"opened": "user_id long, url string, viewed_at timestamp_ntz, event_id long", "positions": E}
    tables = [str(tmp_path / x) for x in ("history", "progress", "daily")]
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    start_job = lambda trigger: inc.stream_reading_minutes(
        *(spark.readStream.schema(schemas[n]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in ("opened", "positions")),
        *tables, str(tmp_path / "check"), fold_every=3, trigger=trigger)
    for turn in range(4):
        for name, schema in schemas.items():
            rows = [r for kind, r in both[turn::4] if kind == name]
            if rows:
                spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(str(tmp_path / name))
        if turn < 3:
            start_job(None).awaitTermination()
        else:
            running = start_job({"processingTime": "0 seconds"})
            running.processAllAvailable()
            running.stop()
    want = daily_reading(spark.createDataFrame(shown, schemas["opened"]), upsert_progress(None, spark.createDataFrame(placed, E)), "UTC")
    columns = ["user_id", "day", "articles", "secs"]
    assert sorted(map(tuple, inc.reading_tables(spark, *tables)[2].read().select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
