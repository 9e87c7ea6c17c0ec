import hashlib
import random
import re
import zlib

import numpy as np

from pageloom.llm import queries
from pageloom.llm.runs import periodic_runs, runs
from tests.llm.helpers import empty, frame, prose


def brute(w, shortest=12):
    """Every lag over the whole text; of its stretches those that no shorter period explains."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            stretch = w[i - q: j]
            if len(stretch) >= max(shortest, 2 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((i - q, len(stretch), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def shapes(rng):
    """Texts of few words that repeat in all the ways the search treats apart."""
    few = lambda n, a: [rng.randint(0, a) for _ in range(n)]
    yield few(rng.randint(1, 90), rng.randint(1, 3))
    yield [w for _ in range(rng.randint(1, 8)) for w in few(rng.randint(1, 9), 2) * rng.randint(1, 6)]
    yield [w for _ in range(rng.randint(1, 6)) for w in [0] * rng.randint(1, 25) + [1] * rng.randint(0, 2)]
    unit = few(rng.randint(1, 7), 2)
    long = unit * 30
    yield long[rng.randint(0, 6): rng.randint(12, 70)] + long[rng.randint(0, 6): rng.randint(12, 70)] + long[: rng.randint(0, 30)]
    cut = long[: rng.randint(1, 40)]
    yield cut * rng.randint(1, 4) + few(1, 3) + cut * rng.randint(0, 3)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 90:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1][: rng.randint(1, 90)]


def test_runs_against_every_lag():
    rng = random.Random(5)
    for _ in range(250):
        for w in shapes(rng):
            for shortest in (12, 5):
                assert runs(np.array(w, np.int64), shortest) == brute(w, shortest), w


def test_long_repetitive_texts_stay_cheap():
    blocks = ([0] * 1000 + [1]) * 20
    assert runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert (0, len(blocks), 1001) in runs(np.array(blocks, np.int64))
    header = [x for j in range(3000) for x in [*range(8), *range(9 + 8 * j, 17 + 8 * j)]]
    assert runs(np.array(header, np.int64)) == []


def test_columns_nulls_and_white_space(spark):
    unit = "ab cd e"
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "  " + " \n".join([unit] * 5) + "\ttail "), (5, "x " * 11), (6, "x " * 12), (6, "x " * 12),
            (None, "é " * 13), (7, "a a " * 12), (8, "a b " * 3)]
    found = {}
    for r in periodic_runs(frame(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert found[1] == found[2] == found[3] == [(0, [], "")]
    assert found[4] == [(16, [(0, 15, 3)], "ab cd e tail")]
    assert found[5] == [(11, [], " ".join("x" * 11))]
    assert found[6] == [(12, [(0, 12, 1)], "x")] * 2
    assert found[None] == [(13, [(0, 13, 1)], "é")]
    assert found[7] == [(12, [(0, 12, 1)], "a a")]  # only ASCII white space parts words
    assert found[8] == [(3, [], "a b a b a b")]
    assert periodic_runs(empty(spark)).collect() == []


def expected(doc_id, text):
    """The contract of the query, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    every = brute(words)
    gone = {i for s, m, q in every for i in range(s + q, s + m)}
    best = min(every, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(every), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in every)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_its_contract(spark, tmp_path):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 60), ["a", "b", "c\n", "d  e"] if i % 2 else None) for i in range(150)] + [None, "", "one"]
    rows = list(enumerate(texts))
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert found == {i: expected(i, t) for i, t in rows}
