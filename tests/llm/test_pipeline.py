import random

import corpus_pipeline
from pageloom.llm.queries import LLM_QUERIES
from tests.llm.helpers import frame, prose

WORDS = [f"{a}{b}" for a in ("tho", "ner", "ing", "sta", "wel") for b in ("d", "mer", "lin", "ost", "ath")]


def test_each_stage_takes_effect(spark, tmp_path):
    rng = random.Random(13)
    text = lambda n: "\n".join(prose(rng, 12, WORDS) for _ in range(n))
    base, item, block = text(15), prose(rng, 30, WORDS), text(30)
    rows = [(i, text(rng.randint(3, 9))) for i in range(40)]
    single = prose(rng, 150, WORDS)  # one line: nothing for the line stage
    rows += [(110, single), (111, single + " lastly")]
    rows += [(100, base), (101, base.replace("thod", "THOD")), (102, base + "\nlast words"), (103, f"{text(3)}\n{item}\n{text(3)}"), (104, "!!! 12"), (105, None)]
    rows += [(200, block), (201, f"{text(4)}\n{block}\n{text(4)}"), (40, text(2)), (None, text(3))]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, texts = {}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id for r in docs.collect()}
        if name != "packing":
            texts[name] = {r.doc_id: r.text for r in docs.collect()}
            assert docs.columns == frame(spark, rows).columns
    clean = {*range(41), None}
    assert all(clean <= ids for ids in seen.values())
    assert not seen["language_id"] & {104, 105} and 103 in seen["near_duplicates"] and 103 not in seen["decontamination"]
    assert {110, 111} <= seen["line_dedup"] and seen["near_duplicates"] & {110, 111} == {110}
    old, left = base.replace("thod", "THOD").split("\n"), texts["line_dedup"].get(101, "").split("\n")
    assert 100 in seen["line_dedup"] and all("THOD" in line for line in old if line in left and line not in base.split("\n"))
    assert all(line in left for line in old if "THOD" in line)  # what is new in a copy stays
    assert len(texts["line_dedup"][102]) < len(base) / 2  # what is left of it is alike nothing
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == seen["packing"]


def test_registered():
    assert "pipeline" in LLM_QUERIES and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in LLM_QUERIES} - {"pipeline"}
