import random
import zlib
from collections import Counter, defaultdict

from pageloom.llm import queries, skew
from pageloom.llm.binpack import Tree, best_fit_decreasing, into_shards, rounded, shard_by_size
from tests.llm.helpers import empty, frame, prose


def one_by_one(sizes, capacity):
    """Best-fit decreasing, group by group over a list of shards."""
    rooms = []
    for size in sorted((s for s, n in sizes for _ in range(n)), reverse=True):
        fitting = [(room, j) for j, room in enumerate(rooms) if room >= size]
        if fitting:
            room, j = min(fitting)
            rooms[j] = room - size
        else:
            rooms.append(max(capacity, size) - size)
    return sorted(rooms)


def test_packing_equals_placing_one_by_one():
    rng = random.Random(2)
    for _ in range(200):
        sizes = list(Counter(rng.randint(1, rng.choice([5, 60, 400])) for _ in range(rng.randint(1, 80))).items())
        capacity = rng.randint(20, 300)
        placed = best_fit_decreasing(sizes, capacity)
        assert Counter(sizes_of(placed)) == Counter(s for s, n in sizes for _ in range(n))
        used = defaultdict(int)
        for s, n, shard in placed:
            used[shard] += s * n
        assert sorted(used) == list(range(len(used)))
        own = {shard: s for s, n, shard in placed if s > capacity}
        assert sorted(max(capacity, own.get(j, 0)) - u for j, u in used.items()) == one_by_one(sizes, capacity)


def sizes_of(placed):
    return [s for s, n, _ in placed for _ in range(n)]


def test_tree_against_a_sorted_list():
    rng = random.Random(4)
    tree, flat = Tree(), []
    for j in range(20_000):
        if rng.random() < 0.6:
            entry = (rng.randint(0, 3000), j)
            tree.add(entry)
            flat.append(entry)
        elif j % 5 == 0:
            least = rng.randint(0, 3200)
            want = min((e for e in flat if e[0] >= least), default=None)
            assert tree.take(least) == want
            if want:
                flat.remove(want)
    assert sorted(e for leaf in tree.leaves for e in leaf) == sorted(flat)


def test_number_of_shards_is_kept_and_sizes_are_near():
    rng = random.Random(6)
    sizes = list(Counter(rng.randint(20, 3000) for _ in range(5000)).items()) + [(4_000_000, 1)]
    used = defaultdict(int)
    for s, n, shard in into_shards(sizes, 40):
        used[shard] += s * n
    assert sorted(used) == list(range(40))
    rest = sorted(used.values())[:-1]
    assert used[0] == 4_000_000 and rest[-1] - rest[0] < 0.02 * rest[0]
    assert into_shards([], 40) == [] and into_shards([(5, 1)], 40) == [(5, 1, 0)]


def test_rounding(spark):
    got = spark.range(1, 70_000, 7).selectExpr("id").select("id", rounded("id").alias("r")).collect()
    assert all(r.id <= r.r < r.id * (1 + 2 ** -9) and (r.id >= 2 ** 11 or r.id == r.r) for r in got)


def rows_of(rng):
    rows = [(i, prose(rng, rng.randint(0, 40))) for i in range(300)]
    rows += [(1000 + i, "hot text " * 5) for i in range(200)] + [(2000, None), (2001, ""), (2002, "long " * 9000), (2003, None), (None, "é"), (None, "é"), (7, rows[7][1])]
    return rows


def check(found, rows, shards):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots, place = defaultdict(list), defaultdict(set)
    for r in found:
        slots[r.shard].append(r.slot)
        place[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for p in place.values())  # equal texts stay together
    assert shards is None or set(slots) <= set(range(shards))


def test_documents(spark, monkeypatch):
    rows = rows_of(random.Random(8))
    for hot, slices in ((1000, 64), (3, 2)):
        monkeypatch.setattr(skew, "HOT_SHARE", hot)
        monkeypatch.setattr(skew, "SLICES", slices)
        found = shard_by_size(frame(spark, rows, 5), shards=12).collect()
        check(found, rows, 12)
    load = Counter()
    for r in found:
        load[r.shard] += r.size
    # The long text and the hot group are larger than a share; all else is even.
    assert len(load) == 12 and max(sorted(load.values())[:10]) - min(load.values()) < 300
    found = shard_by_size(frame(spark, rows, 5), capacity=4000).collect()
    check(found, rows, None)
    load, groups = Counter(), defaultdict(set)
    for r in found:
        load[r.shard] += r.size
        groups[r.shard].add(r.text_crc32)
    assert all(load[s] <= 4000 or len(groups[s]) == 1 for s in load)
    assert shard_by_size(empty(spark), shards=4).collect() == []


def test_query(spark, tmp_path):
    rows = rows_of(random.Random(9))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_balanced_shards(spark, str(tmp_path))
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = found.collect()
    check(found, rows, 40)
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}
