import random

import pytest

from pageloom.llm import substrings
from tests.llm.helpers import empty, frame, prose


def brute(rows):
    low = -(1 << 63)
    docs = [(low if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, x in docs:
        for i in range(len(x) - 49):
            first[x[i:i + 50]] = min(d, first.get(x[i:i + 50], d))
    out = []
    for (d, x), (key, _) in zip(docs, rows):
        gone = bytearray(len(x))
        for i in range(len(x) - 49):
            if first[x[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        out.append((key, len(x), sum(gone), bytes(c for c, g in zip(x, gone) if not g)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [2, 256])
def test_against_every_window(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST", most)
    rng = random.Random(5)
    passage, other = prose(rng, 40), prose(rng, 30)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(20)]
    rows += [(100 + i, f"{prose(rng, 5)} {passage} é {prose(rng, 5)}") for i in range(12)]  # a passage with its own surroundings each time
    rows += [(200 + i, passage[: rng.randint(60, len(passage))] + other[rng.randint(0, 40):]) for i in range(8)]
    rows += [(300, "a" * 400), (301, "b" + "a" * 300), (302, "ab" * 100), (303, "ba" * 90)]
    rows += [(400, passage), (401, passage), (400, passage), (400, passage + "!"), (None, other), (None, None), (402, ""), (403, None), (404, "x" * 49)]
    rows += [(500, prose(rng, 20_000)), (501, "é" * 80), (502, "aé" + "é" * 80)]
    assert rows_of(substrings.remove_repeats(frame(spark, rows))) == brute(rows)


def test_empty(spark):
    assert substrings.remove_repeats(empty(spark)).collect() == []
