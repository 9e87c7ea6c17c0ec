import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pageloom.llm import shards
from pageloom.llm.packing import pack
from pageloom.llm.tokens import Encoder
from tests.llm.helpers import TOKENIZER, empty, frame, prose

ODD = ["", "a  b\n\n c", "\ttab", "日本語 text", "<|endoftext|> x", "it's we'll 'tis", "x y  z", "  ", "\n", "é" * 30, "1234 5,6", "a\x1cb"]


def plain(texts):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_the_tokenizers(monkeypatch):
    from pageloom.llm import tokens

    rng = random.Random(4)
    alphabet = [*" \n'abcXYZé12.,!?-", "'s", "  ", "日", "\t", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    for held in (1_000_000, 10):
        monkeypatch.setattr(tokens, "HELD", held)
        encoder = Encoder(TOKENIZER)
        got = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(texts), 250) for x in encoder.encode(texts[i:i + 250])]
        assert got == plain(texts)


def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 900))) for i in range(120)] + [(500 + i, t) for i, t in enumerate(ODD)]
    rows += [(600, None), (600, None), (None, "x"), (601, prose(rng, 4000)), (602, prose(rng, 20))]
    found = pack(frame(spark, rows), TOKENIZER).collect()
    want = {}
    for d, t in rows:
        ids = [*plain([t or ""])[0], 0]
        want.setdefault(d, []).append(ids)
    docs, bins = {}, {}
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length <= 2048 and (r.piece == 0 or r.length == 2048)
        docs.setdefault(r.doc_id, []).append((r.piece, r.start, ids))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, texts in want.items():
        assert sorted(x for _, _, ids in sorted(docs[d]) for x in ids) == sorted(x for ids in texts for x in ids)
        if len(texts) == 1:
            assert [x for _, _, ids in sorted(docs[d]) for x in ids] == texts[0]
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(len(ids) for texts in want.values() for ids in texts)
    assert len(bins) <= -(-total // 2048) + 1
    assert pack(empty(spark), TOKENIZER).collect() == []


def test_perfect_hash():
    for n in (0, 1, 2, 7, 1000):
        keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
        _, slots = shards.perfect_hash(keys)
        assert sorted(slots.tolist()) == list(range(len(keys)))


def test_shards(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i * 3 - 40, prose(rng, rng.randint(0, 50))) for i in range(150)] + [(2000 + i, t) for i, t in enumerate(ODD)]
    rows += [(3000, None), (3001, prose(rng, 9000)), (3002, "same"), (3002, "same"), (3002, "other"), (None, "null key"), (None, None)]
    folder = f"file://{tmp_path}/shards"
    shards.write_shards(frame(spark, rows), folder, TOKENIZER, n_shards=4)
    read = sorted(shards.read_shards(spark, folder).collect(), key=lambda r: r.start)
    assert [r.key for r in read] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    start = 0
    for r in read:
        assert r.start == start and r.n_tokens * 4 == len(r.ids)
        start += r.n_tokens
    want = sorted(((d, zlib.crc32(np.array([*plain([t or ""])[0], 2], "<u4").tobytes())) for d, t in rows), key=repr)
    assert sorted(((r.key, zlib.crc32(r.ids)) for r in read), key=repr) == want
    keys = frame(spark, [(k, "") for k in (-40, 2003, 3002, 3001, 99_999, -39, 3002)] + [(None, "")])
    found = shards.lookup(keys, folder).collect()
    by = {}
    for r in found:
        by.setdefault(r.key, []).append(zlib.crc32(r.ids))
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(c for d, c in want if d == k) for k in (-40, 2003, 3002, 3001)}
    # All of them by the index: the rows that reading in order gives.
    every = frame(spark, rows).drop("extra")
    assert sorted(map(repr, shards.read_by_key(every, folder).collect())) == sorted(map(repr, read))
    with pytest.raises(RuntimeError, match="were written"):
        shards.read_by_key(every.filter("doc_id <> 3001"), folder)
    assert shards.lookup(keys, folder, many=True).orderBy("key", "start").collect() == shards.lookup(keys, folder).orderBy("key", "start").collect()


def test_a_key_over_several_shards(spark, tmp_path):
    rows = [(5, f"text {i}") for i in range(300)] + [(k, "other") for k in (1, 2, 9)] + [(None, f"none {i}") for i in range(700)]
    folder = f"file://{tmp_path}/hot"
    manifest = shards.write_shards(frame(spark, rows), folder, TOKENIZER, n_shards=12)
    assert manifest.filter("low <= 5 and high >= 5").count() > 1
    read = shards.read_shards(spark, folder).collect()
    assert len(read) == len(rows)
    assert sorted(map(repr, shards.read_by_key(frame(spark, rows), folder).collect())) == sorted(map(repr, read))


def test_no_shards(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    shards.write_shards(empty(spark), folder, TOKENIZER, n_shards=2)
    assert shards.read_shards(spark, folder).collect() == []
    assert shards.lookup(frame(spark, [(1, "")]), folder).collect() == []
    assert shards.read_by_key(empty(spark), folder).collect() == []
