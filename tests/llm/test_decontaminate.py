import random
import re

from pageloom.llm.decontaminate import decontaminate
from tests.llm.helpers import empty, frame, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, bench):
    windows = {}
    for item, text in bench:
        w = words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i:i + m]), set()).add(str(item))
    out = []
    for d, text in rows:
        w, hit, items = words(text), set(), set()
        for m in range(1, 11):
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in windows:
                    hit.update(range(i, i + m))
                    items |= windows[tuple(w[i:i + m])]
        out.append((d, len(w), len(hit), sorted(items), bool(hit)))
    return sorted(out, key=repr)


def test_against_every_window(spark):
    rng = random.Random(8)
    bench = [(i, prose(rng, rng.randint(10, 40))) for i in range(20)]
    bench += [(20, "Rare zq"), (21, "just THREE words-here"), (22, ""), (23, None), (24, bench[0][1]), (25, "é ü ß"), (26, "solo9")]
    rows = [(i, prose(rng, rng.randint(0, 50))) for i in range(30)]
    for i in range(30):
        text = bench[rng.randrange(20)][1].split()
        cut = rng.randint(0, max(0, len(text) - 10))
        part = text[cut: cut + rng.randint(8, 14)]
        rows.append((100 + i, f"{prose(rng, 6)}, {' '.join(part).upper() if i % 2 else '  '.join(part)}. {prose(rng, 6)}"))
    rows += [(200, bench[1][1] + " " + bench[1][1]), (201, "a rare ZQ, rare zq rare"), (202, "É ü ß é ü ß"), (203, None), (204, ""), (205, "solo9 solo9"),
             (205, "solo9 solo9"), (None, bench[2][1]), (206, bench[0][1]), (207, prose(rng, 30_000) + " " + bench[3][1])]
    frame_b = spark.createDataFrame([(i, t, 1, "x") for i, t in bench], "item_id long, text string, mark int, key string")
    found = decontaminate(frame(spark, rows), frame_b).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found), key=repr) == brute(rows, bench)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate(frame(spark, [(1, "a b")]), bench).collect()] == [(2, 0)]
    assert decontaminate(empty(spark), bench).collect() == []
