import random
import re

from pageloom.llm.neardup import jaccard_join
from tests.llm.helpers import empty, frame, prose


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    linked = [[j for j, b in enumerate(sets) if i != j and a and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, js in enumerate(linked):
        for j in js:
            top[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(((d, ids.get(root(i)), len(linked[i]), len({sets[j] for j in linked[i]} - {sets[i]})) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(1, 80))) for i in range(60)]
    for base in range(8):
        text = prose(rng, rng.randint(60, 300))
        rows += [(1000 + 50 * base + k, edited(rng, text, k % 4)) for k in range(rng.randint(2, 7))]
    hot = prose(rng, 200)
    rows += [(2000 + k, edited(rng, hot, rng.randint(0, 2))) for k in range(90)]  # more than a bucket holds
    shared = prose(rng, 30)
    rows += [(3000 + k, f"{shared} {prose(rng, 25)}") for k in range(90)]  # alike in part only
    rows += [(4000, "One two"), (4001, "one, two!"), (4002, ""), (4003, None), (4004, "..."), (4000, "One two"), (None, "one two"), (None, hot), (4005, prose(rng, 30_000))]
    got = sorted(((r.doc_id, r.class_id, r.n_links, r.n_texts) for r in jaccard_join(frame(spark, rows)).collect()), key=repr)
    want = brute(rows)
    assert got == want


def test_nothing_linked_and_empty(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l")]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join(frame(spark, rows)).collect()) == [(1, 1, 0), (2, 2, 0)]
    assert jaccard_join(empty(spark)).collect() == []
