import random
from collections import Counter

import pyarrow as pa

from pageloom.llm import linededup, tokens
from pageloom.llm.linededup import BOUNDARIES, OF, _lines, dedup_lines
from pageloom.session import BATCH_BYTES
from tests.llm.helpers import TOKENIZER, empty, frame, prose


def test_repeated_blocks_go_and_all_else_stays(spark):
    rng = random.Random(9)
    block = "\n".join(prose(rng, 8) for _ in range(40))
    rows = [(i, "\n".join(prose(rng, 6) for _ in range(rng.randint(1, 12)))) for i in range(30)]
    rows += [(100 + i, f"{prose(rng, 5)}\n{prose(rng, 5)}\n{block}\n{prose(rng, 5)}") for i in range(20)]
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (203, "\n\n\n"), (204, block), (205, block), (205, block), (206, "one line"), (207, "one line"), (None, block)]
    source = frame(spark, rows)
    found = dedup_lines(source).collect()
    assert len(found) == len(rows)
    text = {}
    for r in found:
        text.setdefault(r.doc_id, []).append(r.text)
    old = {}
    for d, t in rows:
        old.setdefault(d, []).append(t)
    for d in range(30):
        assert text[d] == old[d]  # clean documents are left alone
    assert text[200] == [None] and text[201] == [""] and text[202] == ["\n\n\n"] == text[203] and text[206] == ["one line"] == text[207]
    # Whatever was removed stands in what was kept: each line of the block once at least, and most repeats are gone.
    lines = Counter(line for ts in text.values() for t in ts for line in (t or "").split("\n"))
    assert all(lines[line] >= 1 for line in block.split("\n"))
    assert sum(lines[line] for line in block.split("\n")) < 0.35 * 25 * 40
    for r in found:
        if r.text is not None:
            given = (old[r.doc_id][0] or "").split("\n")
            assert r.n_lines == len(given) and r.n_removed_lines <= r.n_lines
            left = iter(given)
            assert all(any(line == x for x in left) for line in r.text.split("\n") if line)  # in order
    plain = dedup_lines(source, report=False)
    assert plain.columns == source.columns
    assert sorted(((r.doc_id, r.text) for r in plain.collect()), key=repr) == sorted(((r.doc_id, r.text) for r in found), key=repr)


def hashes_of(texts):
    """The rolling hash of each line with the next, as the operator finds it."""
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], names=["key", "mark", "text"])
    return [h for part in _lines(iter([batch])) for h in part.column("hashes").to_pylist()]


def test_chunks_of_a_text_do_not_depend_on_the_text_before_it(spark):
    rng = random.Random(13)
    copies = ["\n".join(prose(rng, 5) for _ in range(rng.randint(2, 9))) for _ in range(60)]
    alone = [hashes_of([t])[0] for t in copies]
    for _ in range(5):
        mixed = [x for t in copies for x in (prose(rng, 3) + "\n" + prose(rng, 4), t)]
        assert hashes_of(mixed)[1::2] == alone
    rows = [(i, t) for i, t in enumerate(copies)]
    rows += [(1000 + 2 * i + j, x) for i, t in enumerate(copies) for j, x in enumerate((prose(rng, 6), t))]
    for parts in (1, 7):
        lost = {r.doc_id: r.n_removed_lines for r in dedup_lines(frame(spark, rows, parts)).collect()}
        for i, own in enumerate(alone):
            whole = any(h is not None and h % OF < BOUNDARIES for h in own)
            assert lost[i] == 0 and lost[1000 + 2 * i + 1] == (len(own) if whole else 0)


def brute(rows):
    """Pair by pair over plain lists: chunks that repeat, the stretches beside them, the first place of each pair's bytes."""
    texts = {d: t.split("\n") for d, t in rows}
    hashes = {d: hashes_of([t])[0] for d, t in rows}
    places = Counter((hashes[d][i]) for d in texts for i in range(len(texts[d]) - 1) if hashes[d][i] is not None)
    is_chunk = lambda h: h is not None and h % OF < BOUNDARIES
    candidates = []
    for d in sorted(texts):
        h = hashes[d]
        seeds = {i for i in range(len(h)) if is_chunk(h[i]) and places[h[i]] > 1}
        taken = set(seeds)
        for i in seeds:
            for step in (1, -1):
                j = i + step
                while 0 <= j < len(h) and h[j] is not None and not is_chunk(h[j]):
                    taken.add(j)
                    j += step
        candidates += [(d, i, "\n".join(texts[d][i: i + 2])) for i in sorted(taken)]
    first = {}
    for d, i, b in candidates:
        first[b] = min(first.get(b, (d, i)), (d, i))
    gone = {(d, j) for d, i, b in candidates if (d, i) != first[b] for j in (i, i + 1)}
    out = {}
    for d, t in rows:
        pieces = t.split("\n")
        ended = [x + "\n" for x in pieces[:-1]] + [pieces[-1]]
        out[d] = "".join(x for j, x in enumerate(ended) if (d, j) not in gone)
    return out


def test_against_pairs_over_plain_lists(spark):
    rng = random.Random(21)
    words = ["a", "b", "", "c d", "é"]
    rows = [(i, "\n".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    passages = ["\n".join(prose(rng, 7) for _ in range(n)) for n in (4, 5, 6, 9)]
    rows += [(100 + i, f"{prose(rng, 5)}\n{rng.choice(passages)}\n{prose(rng, 5)}") for i in range(60)]
    assert {r.doc_id: r.text for r in dedup_lines(frame(spark, rows, 4)).collect()} == brute(rows)


def test_passages_in_other_surroundings_are_found(spark):
    """Of passages of four lines or more, nine lines in ten go."""
    rng = random.Random(17)
    other = lambda: "\n".join(prose(rng, 6) for _ in range(5))
    for n in (4, 6, 10):
        rows = []
        for i in range(300):
            passage = "\n".join(prose(rng, 6) for _ in range(n))
            rows += [(2 * i, f"{other()}\n{passage}\n{other()}"), (2 * i + 1, f"{other()}\n{passage}\n{other()}")]
        found = dedup_lines(frame(spark, rows)).collect()
        removed = {r.doc_id: r.n_removed_lines for r in found}
        assert all(removed[2 * i] == 0 for i in range(300))
        assert sum(removed[2 * i + 1] for i in range(300)) >= 0.9 * n * 300
        assert all(removed[2 * i + 1] in (*range(2, n + 1), 0) for i in range(300))


def test_long_texts_go_to_python_in_small_batches(spark, tmp_path, monkeypatch):
    """Batches of a number of rows would hold all of these texts at once."""
    noted = str(tmp_path / "batches")

    def seen(batches):
        for batch in batches:
            with open(noted, "a") as f:
                f.write(f"{batch.nbytes}\n")
            yield from _lines(iter([batch]))

    monkeypatch.setattr(linededup, "_lines", seen)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [(i, "\n".join(f"{i} {j} " + "x" * 500 for j in range(16))) for i in range(3000)]
    assert dedup_lines(frame(spark, rows, 1), report=False).count() == len(rows)
    with open(noted) as f:
        sizes = [int(x) for x in f]
    assert sum(sizes) > 5 * BATCH_BYTES and max(sizes) < 1.5 * BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_a_worker_that_encoded_before_lets_go_of_the_encoder():
    tokens.Encoder.of(TOKENIZER)
    assert tokens._worker().encoders
    assert hashes_of(["one\ntwo"])
    assert not hasattr(tokens._worker(), "encoders")


def test_empty(spark):
    assert dedup_lines(empty(spark)).collect() == []
