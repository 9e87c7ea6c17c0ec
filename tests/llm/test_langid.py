import random

from pageloom.llm import langid
from tests.llm.helpers import empty, frame, prose

VOCABULARY = {
    "aa": ["strand", "klippe", "vandet", "haven", "solen"], "bb": ["ciudad", "montaña", "pequeño", "río", "bosque"], "cc": ["дерево", "река", "город", "солнце", "море"]}


def docs(n=90):
    rng = random.Random(1)
    return [(i, prose(rng, rng.randint(5, 60), VOCABULARY[lang]), lang) for i, lang in enumerate(["aa", "bb", "cc"] * (n // 3))]


def test_held_out_and_odd_texts(spark):
    known = frame(spark, docs())
    model = langid.learn(known.filter(~langid.held_out("doc_id")))
    odd = [(1000, None), (1001, ""), (1002, "123 !?"), (1003, "río"), (1004, "zzz qqq"), (1005, "море " * 20_000), (None, "strand haven"), (1003, "río")]
    found = langid.identify(frame(spark, docs() + odd), model, ("doc_id", "lang", "score", "text")).toDF("doc_id", "lang", "old", "text", "pred", "score", "n").collect()
    assert len(found) == 98
    assert all(r.pred == r.lang for r in found if r.doc_id is not None and r.doc_id < 1000)
    by = {r.doc_id: r for r in found}
    assert [by[i].pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].pred == "bb" and by[1004].pred in VOCABULARY and by[1005].pred == "cc" and by[None].pred == "aa"
    assert all(0 <= r.score <= 1 for r in found)


def test_filter_and_more_than_64_languages(spark):
    rng = random.Random(2)
    names = [f"l{i:02d}" for i in range(70)]
    rows = [(i, prose(rng, 30, [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}{k % 7}ow" .replace("0", "o").replace("1", "i").replace("2", "u").replace("3", "e").replace("4", "a").replace("5", "y").replace("6", "w") for x in ("mir", "tol", "ben")]), names[k])
            for i, k in enumerate(list(range(70)) * 2)]
    model = langid.learn(frame(spark, rows))
    assert model.masks.shape[0] == 2
    found = langid.identify(frame(spark, rows), model, ("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 130
    source = frame(spark, rows + [(500, "12"), (501, None)])
    kept = langid.keep_known(source, model)
    assert kept.columns == source.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows}


def test_nothing_to_learn(spark):
    model = langid.learn(frame(spark, [(1, "abc", None)]))
    assert [(r.lang_pred, r.score) for r in langid.identify(frame(spark, [(1, "abc")]), model).collect()] == [("und", 0.0)]
    assert langid.identify(empty(spark), model).collect() == []
