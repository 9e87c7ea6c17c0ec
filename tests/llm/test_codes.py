import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from pageloom.llm import codes, queries
from pageloom.llm.codes import assign, compress, cuts, tree_order
from pageloom.llm.sql import CODES_SQL

SCHEMA = "vec_id long, embedding array<float>, label int, key string, code string, n int, of string, points binary"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, c, "k", "c", 1, "o", b"p") for i, v, c in rows], SCHEMA).repartition(parts)


def brute(rows, parts=16, entries=64, rounds=2):
    """The rounds with every distance, in Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) >= parts]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    at = cuts(len(kept[0][1]), parts)
    ints = [[[math.floor(256 * x) for x in v[a:b]] for a, b in zip(at, at[1:])] for _, v, _ in kept]
    books = [[ints[i][j] for i in range(min(entries, len(kept)))] for j in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    for turn in range(rounds + 1):
        code = [[min(range(len(books[j])), key=lambda e: (far(v[j], books[j][e]), e)) for j in range(parts)] for v in ints]
        if turn == rounds:
            break
        new = []
        for j, book in enumerate(books):
            members = [[v[j] for v, c in zip(ints, code) if c[j] == e] for e in range(len(book))]
            new.append([[sum(col) // len(m) for col in zip(*m)] if m else book[e] for e, m in enumerate(members)])
        books = new
    error = [sum(far(v[j], books[j][c[j]]) for j in range(parts)) for v, c in zip(ints, code)]
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in cs), e, by_label[r[2]]) for r, cs, e in zip(kept, code, error)), key=repr), sha


def test_assignment_against_all_distances():
    rng = np.random.default_rng(1)
    for turn in range(200):
        n, k, d, wide = int(rng.integers(1, 600)), int(rng.integers(1, 70)), int(rng.integers(1, 6)), int(rng.choice([2, 9, 200, 100_000]))
        points = rng.integers(-wide, wide, (n, d))
        points = points[tree_order(points, codes.LEAF)]
        entries = points[rng.integers(0, n, k)] if turn % 2 else rng.integers(-wide, wide, (k, d))
        code, sums, counts = assign(points, entries)
        want = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (code == want).all()
        assert (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == points[want == e].sum(0)).all() for e in range(k))


def test_whole_nodes_are_assigned(monkeypatch):
    """Points in far clumps never reach the leaves."""
    rng = np.random.default_rng(2)
    entries = rng.integers(-5, 5, (16, 4)) + np.arange(16)[:, None] * 1000
    points = np.repeat(entries, 256, 0) + rng.integers(-9, 9, (4096, 4))
    monkeypatch.setattr(codes, "_uncertain", None)
    code, _, counts = assign(points[tree_order(points, codes.LEAF)], entries)
    assert (counts == 256).all() and sorted(code.tolist()) == np.repeat(np.arange(16), 256).tolist()


def vectors(rng, n, width, wide=0.3):
    return [[round(rng.gauss(0, wide), 2) for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize("width, n", [(16, 90), (35, 130), (64, 40)])
def test_table(spark, width, n):
    rng = random.Random(width)
    rows = [(i * 3, v, rng.choice([None, 1, 2, 2, 2])) for i, v in enumerate(vectors(rng, n, width))]
    rows += [(1, None, 1), (-5, [None] + [0.0] * (width - 1), 1), (-4, [float("nan")] * width, 1), (-3, [float("inf")] * width, 2), (-2, [], 1), (4, [0.5], 1),
             (None, rows[3][1], None), (6, rows[0][1], 2), (6, rows[0][1], 2), (5, rows[1][1] + [1.0], 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    out, books = compress(frame(spark, rows))
    want, sha = brute(rows)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=repr) == want
    assert codes.digest(books) == sha


def test_small_blocks_and_hot_labels(spark, monkeypatch):
    from pageloom.llm import skew

    monkeypatch.setattr(codes, "BLOCK_ROWS", 7)
    monkeypatch.setattr(skew, "HOT_SHARE", 3)
    rng = random.Random(7)
    rows = [(i, [float(np.float32(x)) for x in v], rng.choice([0] * 9 + [None, 3, 4])) for i, v in enumerate(vectors(rng, 80, 16, 0.02))]
    out, _ = compress(frame(spark, rows, 5), entries=12, rounds=3)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=repr) == brute(rows, entries=12, rounds=3)[0]


def test_empty_and_too_large(spark):
    out, books = compress(frame(spark, []))
    assert out.collect() == [] and books == []
    out, _ = compress(frame(spark, [(1, None, 3)]))
    assert out.columns == ["vec_id", "label", "code", "error", "label_error"] and out.collect() == []
    with pytest.raises(ValueError):
        compress(frame(spark, [(1, [1e9] * 16, 3)]))


def test_query_against_sql(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, v, i % 5 or None) for i, v in enumerate(vectors(rng, 120, 32))] + [(500, None, 1), (501, [float("nan")] * 32, 1)]
    frame(spark, rows, 1).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.op13_vector_codes(spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.execute(CODES_SQL)
    assert found.columns == [c[0] for c in want.description]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want.fetchall())
