import hashlib
import random

import xxhash
from pyspark.sql import functions as F

from pageloom.llm import fingerprints as fp
from tests.llm.helpers import empty, frame, prose


def prints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = fp.fingerprint(df, ["i"], "t")
    return {r.i: (list(r.exact), list(r.like)) for r in out.collect()}


def test_sums_of_paragraphs(spark):
    a, b = "one two three four", "five six"
    found = prints(spark, [f"{a}\n{b}", f"{b}\n{a}", a, b, f"{a}\n{b}\n{a}"])
    assert found[0] == found[1] != found[2]
    for part, modulus in ((0, 1 << 32), (1, fp.MODULUS)):
        assert [(x + y) % modulus for x, y in zip(found[2][part], found[3][part])] == found[0][part]
        assert [(x - y) % modulus for x, y in zip(found[4][part], found[2][part])] == found[0][part]


def test_plus_and_minus(spark):
    r = spark.range(1).select(fp.plus(F.array(F.lit(5)), F.array(F.lit(9)), 8).alias("p"), fp.minus(F.array(F.lit(5)), F.array(F.lit(9)), 8).alias("m")).first()
    assert (list(r.p), list(r.m)) == ([6], [4])


def test_likeness_components_by_hand(spark):
    text = "a b c d a b c\nx"
    like = [0] * fp.LIKE
    unsigned = lambda h: h & (1 << 64) - 1

    def chained(words):
        seed = 42
        for w in words:
            seed = xxhash.xxh64_intdigest(w.encode(), seed=unsigned(seed))
        return seed

    words = text.split("\n")[0].split()
    runs = {chained(words[i:i + 3]) for i in range(len(words) - 2)} | {chained(["x"])}
    for h in runs:
        like[h & fp.LIKE - 1] += ((h >> 40) & 1) * 2 - 1
    assert prints(spark, [text])[0][1] == [x % fp.MODULUS for x in like]


def test_edits(spark):
    rng = random.Random(10)
    rows = [(i * 7, "\n".join(prose(rng, 12) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "é"), (1003, "same text here"), (1004, "same text here"), (None, "first"), (1005, prose(rng, 20_000))]
    found = {r.doc_id: r for r in fp.fingerprint_edits(frame(spark, rows), buckets=5).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after, r = t or "", after or "", found[d]
        half = len(t) // 2
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert found[1003].fingerprint == found[1004].fingerprint and found[1003].near_next == 1
    long = [found[d] for d, t in rows if t and len(t) > 800 and d]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)
    assert abs(sum(r.near_edited for r in long) / len(long) - 0.5) < 0.15


def test_repeated_rows_and_empty(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, "d")]
    found = fp.fingerprint_edits(frame(spark, rows)).collect()
    assert len(found) == 4 and len({r.fingerprint for r in found}) == 3
    assert fp.fingerprint_edits(empty(spark)).collect() == []
